"""Mixing sources to target weights by Pareto order sampling.

Sources get targets by weight, with a ceiling on repeats. Where a source's target is ``r`` times its size, its documents
are wanted ``r`` times on average (by words), but not equally: a document's number leans with its worth, from 0 to 1, by
``r + slope * (worth - mean worth)``. The slope is ``LEAN`` of the steepest that keeps all numbers between 0 and the
ceiling; worth grows with length, so documents with more context come more often. The mean is weighted by words, so the
wanted words still sum to the target. A document wanted ``e`` times is taken ``floor(e)`` times for certain; the rest is
its odds of inclusion in a sample without replacement. Its order is Pareto sampling's: a uniform number ``u`` fixed by
the row gives the odds ``u / (1 - u)``, divided by the odds of inclusion, and the smallest ranks are taken. The fixed size
is one of words: the ranks are cut where the taken words are full, and up to ``CLOSERS`` documents whose sizes come
nearest to the gap left close it. These few a source go by size and not by rank.

At scale: one scan of the texts, stored as a slim table. A source may hold a third of all rows, so no task
ever ranks a source: rows equal in rank, id, size and certain copies become one group with their number, ranks fall into cells,
cells are summed (at most ``CELLS`` rows a source), and only the cell in which a source fills up is opened, twice.
How many of a group's rows fit is found by division; rows of groups taken in part are made anew, in pieces. Per-source figures are one row a source and are joined by
their measured size.

Defined results: null texts have size 0; null sources are one source, sorted last; sizes of 0 take 0. Repeated
rows are separate documents with equal ``u``, taken one by one; equal ranks go by id and size, so rows that swap are equal.
An empty table gives an empty one. Other columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.llm.store import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
LEAN = 0.5
CONTEXT = 200
CELLS = 4096
CLOSERS = 3
PIECE = 1000
SPACES = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space: the places where one begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the row, on a grid of 2^-52."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def by_length(size: Column) -> Column:
    """Worth in thousandths, a whole number: 0 for no words, half at ``CONTEXT`` words, towards 1 beyond."""
    return F.floor(size * 1000 / (size + CONTEXT)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row per source with its size: adds ``target``.

    Targets are ``c * weight`` up to ``repeats`` times the size, with ``c`` such that they sum to ``share`` of
    all: sources are ordered by the ``c`` at which they are full, and ``c`` is right where the next is not full.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") - 1) % len(weights) + 1)
    w = sizes.withColumn("place", F.row_number().over(by_name).cast("int")).withColumn("weight", weight)
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    w = w.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # c if all sources before this one are full and this one is the first that is not.
    w = w.withColumn("c", (F.lit(float(share)) * F.sum("source_size").over(everything)
                           - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("c") <= F.col("full_at"), F.struct("full_at", "place", "c"))).over(everything)["c"]
    w = w.withColumn("level", level)
    full = F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap"))
    return w.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _fill(sums: DataFrame, key: list[str], need: str) -> DataFrame:
    """Of cells with their sizes, the one in which each source fills up, and what is then still needed."""
    order = Window.partitionBy("source").orderBy(*key)
    run = F.sum("size").over(order)
    cells = sums.withColumn("left", F.col(need) - (run - F.col("size"))).where((F.col("left") > 0) & (F.col("left") <= F.col("size")))
    return cells.select("source", F.struct(*key).alias("cell"), F.col("left"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17, lean: float = LEAN, worth: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words ``taken``.

    ``worth`` is a column of ``docs`` in thousandths (0 to 1000, null: 0), instead of that by length; ``lean`` 0 wants all alike.
    """
    by_worth = by_length(F.col("size")) if worth is None else F.col("worth")
    given = F.lit(0) if worth is None else F.least(F.greatest(F.coalesce(worth, F.lit(0)), F.lit(0)), F.lit(1000))
    slim = settle(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"),
        given.cast("long").alias("worth"),
    ).withColumn("worth", by_worth), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("worth")).alias("source_worth"))
    worths = settle(sizes.select(F.col("source").alias("s0"), "source_worth"), "mix-worths")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sizes, weights, share, repeats).withColumn("ratio", ratio)
    plan = plan.join(worths, F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    mean = F.when(F.col("source_size") > 0, F.col("source_worth") / F.col("source_size")).otherwise(0.0)
    # The steepest slope, in copies per thousandth, that leaves the least worth at 0 or more and the most at the ceiling or less.
    steepest = F.when(F.col("mean") > 0, F.least(F.col("ratio") / F.col("mean"), (repeats - F.col("ratio")) / (1000 - F.col("mean"))))
    slope = F.when((F.col("mean") > 0) & (F.col("mean") < 1000), F.lit(float(lean)) * F.greatest(steepest, F.lit(0.0))).otherwise(0.0)
    plan = settle(plan.withColumn("mean", mean).withColumn("slope", slope).select(
        F.col("source").alias("of"), "source_size", "target", "ratio", "mean", "slope"), "mix-plan")

    wanted = F.col("ratio") + F.col("slope") * (F.col("worth") - F.col("mean"))
    wanted = F.least(F.greatest(wanted, F.lit(0.0)), F.lit(float(repeats)))
    asked = slim.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("wanted", wanted)
    asked = asked.withColumn("whole", F.floor("wanted")).withColumn("odds", F.col("wanted") - F.col("whole"))
    certain = asked.groupBy("of", "target").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    certain = settle(certain.select(F.col("of").alias("s0"), (F.col("target") - F.col("certain")).alias("need")), "mix-certain")

    # Pareto ranks: random odds over inclusion odds, brought to [0, 1) so that they fall into cells.
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("odds") / (1 - F.col("odds")))
    place = q / (1 + q)
    ranked = asked.join(certain, F.col("source").eqNullSafe(F.col("s0"))).drop("s0", "of")
    ranked = ranked.withColumn("rank", F.when(F.col("odds") > 0, place))
    # Rows equal in all that orders them, with their number.
    groups = ranked.where(F.col("rank").isNotNull()).groupBy("source", "need", "rank", "doc_id", "size", "whole").agg(F.count("*").alias("copies"))
    groups = groups.withColumn("coarse", F.floor(F.col("rank") * CELLS).cast("int"))
    groups = groups.withColumn("fine", F.floor((F.col("rank") * CELLS - F.col("coarse")) * CELLS).cast("int"))
    groups = settle(groups.withColumn("words", F.col("size") * F.col("copies")), "mix-groups")

    first = _fill(groups.groupBy("source", "need", "coarse").agg(F.sum("words").alias("size")), ["coarse"], "need")
    first = settle(first.select(F.col("source").alias("s1"), F.col("cell.coarse").alias("c1"), F.col("left").alias("need1")), "mix-cells")
    same = F.col("source").eqNullSafe(F.col("s1")) & (F.col("coarse") == F.col("c1"))
    opened = groups.join(first, same)
    second = _fill(opened.groupBy("source", "need1", "fine").agg(F.sum("words").alias("size")), ["fine"], "need1")
    second = settle(second.select(F.col("source").alias("s2"), F.col("cell.fine").alias("c2"), F.col("left").alias("need2")), "mix-cells")
    rows = opened.join(second, F.col("source").eqNullSafe(F.col("s2")) & (F.col("fine") == F.col("c2")))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "whole")
    rows = rows.withColumn("left", F.col("need2") - (F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")))
    # The group in which the words are full; how many of its copies come before the document at which they are; the gap.
    here = F.struct("rank", "doc_id", "size", "whole")
    edge = rows.where((F.col("left") > 0) & (F.col("left") <= F.col("words"))).groupBy("source").agg(
        F.min(F.struct(here.alias("it"), "copies", "left")).alias("edge"))
    size, left = F.col("edge.it.size"), F.col("edge.left")
    fit = F.ceil(left / size) - 1
    fit = fit + F.when(left - fit * size > size, 1).otherwise(0)
    limit = F.struct(F.col("edge.it").alias("it"), F.col("edge.copies").alias("copies"))
    gaps = settle(edge.select(
        F.col("source").alias("s3"), limit.alias("limit"), fit.alias("fit"), (left - fit * size).alias("gap"),
        F.filter(F.array(limit), lambda x: F.lit(False)).alias("more")), "mix-gaps")
    of_source = F.col("source").eqNullSafe(F.col("s3"))
    # A source whose sample needs no words has no edge and takes none.
    first_part = F.coalesce(here < F.col("limit.it"), F.lit(False))

    def used(it: Column) -> Column:
        """How many documents of a group not before the edge are taken."""
        picks = F.size(F.filter("more", lambda x: x["it"].eqNullSafe(it)))
        return picks + F.when(it.eqNullSafe(F.col("limit.it")), F.col("fit")).otherwise(0)

    for _ in range(CLOSERS):
        off = F.abs(F.col("size") - F.col("gap"))
        close = groups.join(gaps, of_source).where(~first_part & (off < F.col("gap")) & (used(here) < F.col("copies"))).groupBy("s3").agg(
            F.min(F.struct(off.alias("off"), here.alias("it"), "copies")).alias("close"))
        close = settle(close.select(F.col("s3").alias("s4"), "close"), "mix-close")
        pick = F.struct(F.col("close.it").alias("it"), F.col("close.copies").alias("copies"))
        gaps = settle(gaps.join(close, F.col("s3").eqNullSafe(F.col("s4")), "left").select(
            "s3", "limit", "fit",
            (F.col("gap") - F.coalesce(F.col("close.it.size"), F.lit(0))).alias("gap"),
            F.when(F.col("close").isNull(), F.col("more")).otherwise(F.array_append("more", pick)).alias("more"),
        ), "mix-gaps")

    # Groups taken in part, at most CLOSERS + 1 a source: their rows are equal and are made from their number, piece by piece.
    part = gaps.select("s3", "limit", "fit", "more", F.explode(F.array_distinct(F.array_append("more", F.col("limit")))).alias("x"))
    part = part.select("s3", F.col("x.it").alias("it"), F.col("x.copies").alias("copies"), used(F.col("x.it")).alias("used"))
    part = part.join(plan, F.col("s3").eqNullSafe(F.col("of"))).select(
        F.col("it.doc_id").alias("doc_id"), F.col("it.size").alias("size"), "source_size", "target", F.col("it.whole").alias("whole"), "copies", "used",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE))).alias("piece"))
    last = F.least("copies", (F.col("piece") + 1) * PIECE) - 1
    part = part.repartition("doc_id", "size", "piece").withColumn("number", F.explode(F.sequence(F.col("piece") * PIECE, last)))
    taken = (F.col("size") * (F.col("whole") + F.when(F.col("number") < F.col("used"), 1).otherwise(0))).cast("long").alias("taken")
    part = part.select("doc_id", "size", "source_size", "target", taken)

    # All other rows go by their value alone.
    done = ranked.join(gaps, of_source, "left")
    within = F.coalesce(here.eqNullSafe(F.col("limit.it")) | F.exists("more", lambda x: x["it"].eqNullSafe(here)), F.lit(False))
    taken = (F.col("size") * (F.col("whole") + F.when(first_part, 1).otherwise(0))).cast("long").alias("taken")
    return done.where(~within).select("doc_id", "size", "source_size", "target", taken).unionAll(part)
