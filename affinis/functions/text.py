"""Text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from affinis import settings

# One token per Han character, one per other run of letters or digits.
TOKEN_PATTERN = r"(\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+)"


def tokens(text: Column) -> Column:
    """Lower-case search tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def phrase_prefix_at(text: Column, keyword: str) -> Column:
    """Position of the first token where ``keyword`` occurs as a phrase whose
    last token may be the start of a word; null when there is none.

    Tokens hold no blanks, so over blank-separated tokens the phrase is a plain
    substring search that starts at a blank.
    """
    wanted = tokens(F.lit(keyword))
    needle = F.concat(F.lit(" "), F.array_join(wanted, " "))
    # Cheap test on the raw text first; most texts stop here.
    possible = (F.size(wanted) > 0) & F.lower(text).contains(F.get(wanted, F.lit(0)))
    words = F.when(possible, F.concat(F.lit(" "), F.array_join(tokens(text), " ")))
    before = F.call_function("substring_index", words, needle, F.lit(1))
    return F.when(
        words.contains(needle), F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) + 1
    )


def release_year(title: Column) -> Column:
    """Year in front of the closing character of a title such as ``Name (2005)``."""
    text = F.trim(title)
    year = F.substring(text, F.length(text) - 4, F.lit(4)).try_cast("int")
    return F.when(
        title.isNull() | (F.length(text) < 6), F.lit(settings.DEFAULT_RELEASE_YEAR)
    ).otherwise(year)


def day_millis(text: Column) -> Column:
    """Epoch milliseconds of the leading ``yyyy-MM-dd``; needs a UTC session."""
    return F.unix_millis(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def two_decimals(number: Column) -> Column:
    """Fixed two-decimals text, for export only."""
    return F.format_number(number, settings.DECIMALS)


def without_prefix(key: Column, prefix: str) -> Column:
    """The numeric id behind a key prefix."""
    return F.substring(key, F.lit(len(prefix) + 1), F.length(key)).try_cast("long")
