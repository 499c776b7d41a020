"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``score`` adds one struct of counts to every row and ``judge`` turns a table of rules over ratios of those
counts into one boolean expression. The plan is a scan and projections: no shuffle, no Python, no row count
to grow with, and a lost executor costs its own splits only. Every text is counted whole.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged alike;
an empty table gives an empty one; further columns pass through untouched, whatever their names.
Equal three-word windows of a text are found by the high bits of a 64-bit hash and then compared word by word; where
different windows share these bits, all windows that have them are sorted by their words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from affinis.llm.store import named, rename

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: At least so many low bits of a window's hash give way to its place.
PLACE_BITS = 24
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as with on by at an be this was are from or "
    "der die das und ist nicht ein eine den dem des von zu im mit auf für sich auch "
    "le la les un une et est dans que qui pour sur par pas au avec ce il du "
    "el los las una y en es por con para se su al lo del como más no"
).split()


class Rule(NamedTuple):
    """Reject a text unless ``low <= value / per <= high``; the bounds are part of what is kept.
    Without ``per`` the count itself is held against the bounds."""

    name: str
    value: str
    per: str | None
    low: float
    high: float


#: Ratios of counts; distinct stop words by number, which tells prose from lists and tables.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop", None, 2.0, 1e9),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.6),
    Rule("ellipsis_lines", "n_ellipsis", "n_lines", 0.0, 0.5),
    Rule("bullet_lines", "n_bullets", "n_lines", 0.0, 0.9),
)


def score(docs: DataFrame, text_col: str = "text", out: str = "counts") -> DataFrame:
    """``docs`` and a struct of counts under the name ``out`` (which must be free)."""
    names = {}
    for k in ("text", "words", "lines", "mask", "grams", "mixed", "alike", "again"):
        names[k] = rename([*docs.columns, out, *names.values()], f"_{k}")
    text, words, lines, mask, grams, mixed, alike, again = (F.col(names[k]) for k in names)
    n, spaces = F.size(words), F.lit(" \t\n\x0b\x0c\r")

    def same(a: Column, b: Column) -> Column:
        """Two windows of one text, told apart by hash and then by their words; false beyond the ends."""
        i, j = a.bitwiseAND(F.bitwise_not(mask)).cast("int"), b.bitwiseAND(F.bitwise_not(mask)).cast("int")
        return F.coalesce(
            (a.bitwiseAND(mask) == b.bitwiseAND(mask)) & (F.get(words, i) == F.get(words, j))
            & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2)),
            F.lit(False))

    step = docs.withColumn(names["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    step = step.withColumns({
        names["words"]: F.when(F.btrim(text, spaces) == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.btrim(text, spaces), SPACE + "+")),
        names["lines"]: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    # The low bits of a window's hash give way to its place: sorted as plain numbers, equal windows are neighbours.
    bits = F.greatest(F.lit(PLACE_BITS), F.ceil(F.log2(n + F.lit(2)))).cast("int")
    step = step.withColumn(names["mask"], F.call_function("shiftleft", F.lit(-1).cast("long"), bits))
    step = step.withColumn(names["grams"], F.sort_array(F.slice(F.transform(
        words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(mask)
        .bitwiseOR(i.cast("long"))), F.lit(1), F.greatest(n - 2, F.lit(0)))))
    # Different windows may share their high bits and part equal ones. Usually there are none.
    step = step.withColumn(names["mixed"], F.array_distinct(F.transform(F.filter(grams, lambda x, i: (
        x.bitwiseAND(mask) == F.get(grams, i - 1).bitwiseAND(mask)) & ~same(x, F.get(grams, i - 1))), lambda x: x.bitwiseAND(mask))))

    def spelled(x: Column) -> Column:
        p = x.bitwiseAND(F.bitwise_not(mask))
        at = p.cast("int")
        return F.struct(F.get(words, at).alias("a"), F.get(words, at + 1).alias("b"), F.get(words, at + 2).alias("c"), p.alias("p"))

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    step = step.withColumn(names["alike"], F.when(F.size(mixed) > 0, F.sort_array(F.transform(
        F.filter(grams, lambda x: F.array_contains(mixed, x.bitwiseAND(mask))), spelled))))
    found = F.transform(
        F.filter(grams, lambda x, i: same(x, F.get(grams, i - 1)) | same(x, F.get(grams, i + 1))),
        lambda x: x.bitwiseAND(F.bitwise_not(mask)))
    parted = F.transform(
        F.filter(alike, lambda x, i: equal(x, F.get(alike, i - 1)) | equal(x, F.get(alike, i + 1))), lambda x: x["p"])
    step = step.withColumn(names["again"], F.sort_array(F.when(F.size(mixed) > 0, F.array_union(found, parted)).otherwise(found)))
    # A repeated window covers the words up to the next repeated one, three at most.
    covered = F.aggregate(
        F.transform(again, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(again, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_stop": F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))),
        "n_ellipsis": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
    }
    struct = F.struct(*(v.cast("long").alias(k) for k, v in counts.items()))
    # Always true, but not deterministic: keeps a filter on the counts above this projection. Pushed below, each
    # use of a count would be replaced by its whole expression.
    struct = F.when(F.monotonically_increasing_id() >= 0, struct)
    return step.withColumn(out, struct).drop(*names.values())


def base_failed(counts: str = "counts") -> Column:
    c = F.col(counts)
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def judge(rules=RULES, counts: str = "counts") -> Column:
    """True where every rule holds. A ratio over nothing counts as 0."""
    c, verdict = F.col(counts), F.lit(True)
    for rule in rules:
        value, per = c[rule.value].cast("double"), c[rule.per].cast("double") if rule.per else F.lit(1.0)
        verdict = verdict & (value >= rule.low * per) & (value <= rule.high * per)
    return verdict


def rate(docs: DataFrame, text_col: str = "text", rules=RULES, out: str = "quality") -> DataFrame:
    """``docs`` and a struct ``out``: the counts, ``base_failed`` and ``kept``."""
    counts = rename([*docs.columns, out], "_counts")
    scored = score(docs, text_col, counts)
    c = F.col(counts)
    return scored.withColumn(out, c.withField("base_failed", base_failed(counts)).withField(
        "kept", ~base_failed(counts) & judge(rules, counts))).drop(counts)


def keep(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows whose text passes, with the columns of ``docs``."""
    verdict = rename(docs.columns, "_quality")
    return rate(docs, text_col, rules, verdict).where(F.col(verdict)["kept"]).select(*(named(c) for c in docs.columns))
