"""Ordered work per key that stays spread out when one key holds most rows.

A window over a key runs in one task. That is right for ordinary keys and fatal
for one with a third of all rows. Here such keys are found by a map-side
combined count and cut into pieces along their order: a range shuffle puts
neighbouring rows together, the pieces are stored once in the shared folder,
and only small per-piece summaries and the few rows that a frame reaches back
over are handed from one piece to the next. No row is dropped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from affinis import settings
from affinis.session import offered, settled

PIECE = "_piece"
CARRIED = "_carried"


def split_hot(
    df: DataFrame, key: str, hot_rows: int = settings.HOT_KEY_ROWS, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys with more than ``hot_rows`` rows.

    There can be at most ``rows / hot_rows`` such keys. Their list is counted, and
    broadcast only if short; else the joins shuffle, and skewed keys are split
    there. ``counted`` may name a cheaper frame to
    count in: one that holds at least the rows of ``df``.
    """
    source = df if counted is None else counted
    hot = source.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    if hot.isEmpty():
        return df, None
    keys = offered(settled(hot.select("_hot")))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")


def cut(df: DataFrame, key: str, order: Sequence[str], piece_rows: int) -> DataFrame:
    """Rows with a ``_piece`` number that grows along the order of each key."""
    parts = max(2, -(-df.count() // piece_rows))
    return settled(
        df.repartitionByRange(parts, key, *order).withColumn(PIECE, F.spark_partition_id())
    )


def with_carried_rows(pieces: DataFrame, key: str, order: Sequence[str], rows: int) -> DataFrame:
    """Each piece plus the ``rows`` rows that precede it, marked ``_carried``.

    The rows come from the end of the piece before, and from further back when
    that piece is shorter than ``rows``.
    """
    down = [F.col(c).desc() for c in order]
    sizes = pieces.groupBy(key, PIECE).agg(F.least(F.count(F.lit(1)), F.lit(rows)).alias("_size"))
    along = W.partitionBy(key).orderBy(PIECE)
    before = F.coalesce(F.sum("_size").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("_before", before)
    # A piece has at least one row, so at most ``rows`` pieces lie within reach.
    reach = F.collect_list(F.struct(F.col(PIECE).alias("piece"), "_before")).over(along.rowsBetween(1, rows))
    targets = settled(
        placed.withColumn("_reach", reach)
        .withColumn("_next", F.explode("_reach"))
        .select(
            F.col(key).alias("_key"),
            F.col(PIECE).alias("_from"),
            F.col("_next.piece").alias("_to"),
            (F.col("_next._before") - F.col("_before") - F.col("_size")).alias("_between"),
        )
    )
    # Most keys lie within one piece; only rows that another piece follows are looked at.
    followed = offered(settled(targets.select("_key", "_from").distinct()))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(PIECE) == F.col("_from"))
    ends = (
        pieces.join(followed, same, "left_semi")
        .withColumn("_back", F.row_number().over(W.partitionBy(key, PIECE).orderBy(*down)))
        .where(F.col("_back") <= rows)
    )
    carried = (
        ends.join(targets, same)
        .where(F.col("_back") + F.col("_between") <= rows)
        .withColumn(PIECE, F.col("_to"))
        .select(*pieces.columns)
        .withColumn(CARRIED, F.lit(True))
    )
    return pieces.withColumn(CARRIED, F.lit(False)).unionByName(carried)


def over_recent_rows(
    pieces: DataFrame,
    key: str,
    order: Sequence[str],
    rows: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """``compute`` with frames of at most ``rows`` preceding rows, piece by piece."""
    done = compute(with_carried_rows(pieces, key, order, rows), [key, PIECE])
    return done.where(~F.col(CARRIED)).drop(CARRIED)


def running_totals(values: DataFrame, key: str, at: str, sums: Sequence[str], piece_rows: int) -> DataFrame:
    """Running sums along ``at`` for a frame with one row per ``key, at``."""
    pieces = cut(values, key, [at], piece_rows)
    local = W.partitionBy(key, PIECE).orderBy(at)
    earlier = W.partitionBy(key).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    totals = pieces.groupBy(key, PIECE).agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select(
        F.col(key).alias("_key"),
        F.col(PIECE).alias("_at_piece"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
    )
    within = pieces.select(key, at, PIECE, *[F.sum(c).over(local).alias(c) for c in sums])
    joined = within.join(
        offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col(PIECE) == F.col("_at_piece"))
    )
    return joined.select(
        key, at, *[(F.coalesce(F.col(c), F.lit(0)) + F.col(f"_off_{c}")).alias(c) for c in sums]
    )


def row_numbers(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    name: str,
    hot_rows: int = settings.HOT_KEY_ROWS,
    piece_rows: int = settings.CHUNK_ROWS,
) -> DataFrame:
    """Position of each row along ``order`` within its key, from 1."""
    cold, hot = split_hot(df, key, hot_rows)
    plain = cold.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))
    if hot is None:
        return plain
    pieces = cut(hot, key, order, piece_rows)
    earlier = W.partitionBy(key).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(key, PIECE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(key).alias("_key"),
            F.col(PIECE).alias("_at_piece"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        )
    )
    local = F.row_number().over(W.partitionBy(key, PIECE).orderBy(*order))
    numbered = pieces.withColumn("_local", local).join(
        offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col(PIECE) == F.col("_at_piece"))
    )
    far = numbered.withColumn(name, F.col("_local") + F.col("_off")).select(*df.columns, name)
    return plain.withColumn(name, F.col(name).cast("long")).unionByName(far)
