"""Expressions over nested lists, tags and maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _last_counts(tags: Column) -> Column:
    """``[[tag, count], ...]`` as structs, keeping the last entry of each tag."""
    entries = F.transform(
        tags,
        lambda t, i: F.struct(
            F.get(t, F.lit(0)).alias("tag"),
            F.get(t, F.lit(1)).try_cast("int").alias("n"),
            i.alias("at"),
        ),
    )
    return F.filter(
        entries,
        lambda e: ~F.exists(
            F.slice(entries, e["at"] + 2, F.size(entries)),
            lambda later: later["tag"].eqNullSafe(e["tag"]),
        ),
    )


def sort_tags(tags: Column) -> Column:
    """Tags by descending count, equal counts by name; null stays null.

    A tag given twice counts with its last entry; an unreadable count sorts last.
    """
    keyed = F.transform(
        _last_counts(tags),
        lambda e: F.struct(
            e["n"].isNull().alias("unread"),
            (-e["n"].cast("long")).alias("down"),
            e["tag"].alias("tag"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda e: e["tag"])


def tag_counts(tags: Column) -> Column:
    """``[[tag, count], ...]`` as a map; the last entry of a tag wins."""
    return F.map_from_entries(
        F.transform(
            F.filter(_last_counts(tags), lambda e: e["tag"].isNotNull()),
            lambda e: F.struct(e["tag"], e["n"]),
        )
    )


def positions(array: Column, names: list[str]) -> list[Column]:
    """The first elements as columns, null past the end."""
    return [F.get(array, F.lit(i)).alias(name) for i, name in enumerate(names)]


def tag_names(tags: Column, names: list[str]) -> list[Column]:
    """The ``name`` of the first elements of an array of structs."""
    return [F.get(tags, F.lit(i))["name"].alias(name) for i, name in enumerate(names)]


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not at every mention in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def favourite_tags(tag_lists: Column) -> Column:
    """Tags of several tag lists by how often they occur, then by name: one sort, then lengths of runs.

    Nothing that is sorted is null, so ``sort_array`` gives what ``array_sort`` does, without a comparator run for each pair.
    """

    def ranked(tags: Column) -> Column:
        numbered = F.transform(tags, lambda t, i: F.struct(i.alias("at"), t.alias("tag")))
        heads = F.filter(numbered, lambda e: (e["at"] == 0) | (F.get(tags, e["at"] - 1) != e["tag"]))
        counted = _bound(heads, lambda h: F.transform(h, lambda e, k: F.struct(
            (e["at"] - F.coalesce(F.get(h, k + 1)["at"], F.size(tags))).alias("down"), e["tag"].alias("tag"))))
        return F.transform(F.sort_array(counted), lambda e: e["tag"])

    return _bound(F.sort_array(F.filter(F.flatten(tag_lists), lambda t: t.isNotNull())), ranked)


def places(words: Column) -> Column:
    """``[(word, places), ...]`` of the different words, places from 0 and ascending: one sort, then its runs."""

    def runs(pairs: Column) -> Column:
        starts = F.transform(pairs, lambda e, i: F.struct(i.alias("start"), e["word"].alias("word")))
        heads = F.filter(starts, lambda e: (e["start"] == 0) | (F.get(pairs, e["start"] - 1)["word"] != e["word"]))
        return _bound(heads, lambda h: F.transform(h, lambda e, k: F.struct(
            e["word"].alias("word"),
            F.transform(
                F.slice(pairs, e["start"] + 1, F.coalesce(F.get(h, k + 1)["start"], F.size(pairs)) - e["start"]), lambda x: x["at"]
            ).alias("places"))))

    return _bound(F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))), runs)


def newest_first(collects: Column, by: int = 2) -> Column:
    """Item ids of ``[[item, rating, ts], ...]`` ordered by one text field, last first."""
    keyed = F.transform(
        collects,
        lambda c, i: F.struct(F.get(c, F.lit(by)).alias("k"), i.alias("at"), F.get(c, F.lit(0)).alias("item")),
    )
    return F.transform(F.reverse(F.array_sort(keyed)), lambda e: e["item"])


def info_pairs(info: Column) -> Column:
    """A map as a list of ``[key, value]`` in key order."""
    return F.array_sort(F.transform(F.map_entries(info), lambda e: F.array(e["key"], e["value"])))
