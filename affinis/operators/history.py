"""What a user liked and how they rated, as of each of their samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis import settings
from affinis.functions import arrays
from affinis.operators import pieces
from affinis.session import offered, settled

TIE_BREAK = ("ts", "event_id")


def _recent(partition: list[str], order: Sequence[str], rows: int):
    return W.partitionBy(*partition).orderBy(*order).rowsBetween(-rows, -1)


def _by_recent_rows(df, user, order, rows, compute, hot_rows, piece_rows):
    cold, hot = pieces.split_hot(df, user, hot_rows)
    plain = compute(cold, [user])
    if hot is None:
        return plain
    cut = pieces.cut(hot, user, order, piece_rows)
    far = pieces.over_recent_rows(cut, user, order, rows, compute)
    return plain.unionByName(far.select(*plain.columns))


def add_positive_history(
    samples: DataFrame,
    user: str = "user_id",
    item: str = "item_id",
    order: Sequence[str] = TIE_BREAK,
    rows: int = settings.HISTORY_ROWS,
    hot_rows: int = settings.HOT_KEY_ROWS,
    piece_rows: int = settings.CHUNK_ROWS,
) -> DataFrame:
    """Items liked among the previous ``rows`` samples of any label, newest first."""

    def compute(df: DataFrame, partition: list[str]) -> DataFrame:
        liked = F.collect_list(F.when(F.col("label") == 1, F.col(item)))
        return df.withColumn("positive_history", F.reverse(liked.over(_recent(partition, order, rows))))

    return _by_recent_rows(samples, user, order, rows, compute, hot_rows, piece_rows)


def _last_positives(df: DataFrame, partition: list[str], item: str, order: Sequence[str], rows: int, shown: int) -> DataFrame:
    """The last ``shown`` liked items within ``rows`` rows, as columns.

    A null-skipping ``lag`` finds each of them without building the list of
    liked items for every row; the row number tells whether it is near enough.
    """
    spec = f"PARTITION BY {', '.join(f'`{c}`' for c in partition)} ORDER BY {', '.join(f'`{c}`' for c in order)}"
    here = W.partitionBy(*partition).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(here)).withColumn(
        "_hit", F.when(F.col("label") == 1, F.struct(F.col("_rn").alias("rn"), F.col(item).alias("item")))
    )
    seen = numbered.select(
        *df.columns,
        "_rn",
        *[F.expr(f"lag(_hit, {i}) IGNORE NULLS OVER ({spec})").alias(f"_hit_{i}") for i in range(1, shown + 1)],
    )
    return seen.select(
        *df.columns,
        *[
            F.when(F.col(f"_hit_{i}.rn") >= F.col("_rn") - rows, F.col(f"_hit_{i}.item")).alias(f"user_rated_item_{i}")
            for i in range(1, shown + 1)
        ],
    )


# Whole numbers below this are exact as doubles.
_EXACT = float(2**53)


def _whole(df: DataFrame, rating: str) -> bool:
    return dict(df.dtypes)[rating] in ("tinyint", "smallint", "int", "bigint")


def _deviation(n: Column, s: Column, ss: Column, other: Column) -> Column:
    """The deviation from count, sum and sum of squares of whole numbers, as doubles; ``other`` where they get too large.

    The sums are exact, so the figure does not depend on the order in which rows are added, nor does its rounding.
    """
    return F.when(n * ss < _EXACT, F.sqrt(F.try_divide(n * ss - s * s, n * (n - 1)))).otherwise(other)


def _running_stats(df: DataFrame, partition: list[str], ts: str, rating: str) -> DataFrame:
    """Count, mean and deviation up to now; rows of the same time share them."""
    upto = W.partitionBy(*partition).orderBy(ts)
    deviation = F.stddev_samp(rating).over(upto)
    if _whole(df, rating):
        r = F.col(rating).cast("double")
        n, s, ss = (x.over(upto) for x in (F.count(rating), F.sum(r), F.sum(r * r)))
        deviation = _deviation(n.cast("double"), s, ss, deviation)
    return df.select(
        *df.columns,
        F.count(F.lit(1)).over(upto).alias("user_rating_count"),
        F.avg(rating).over(upto).alias("user_avg_rating"),
        deviation.alias("user_rating_stddev"),
    )


def _running_stats_of_hot(
    hot: DataFrame, user: str, ts: str, rating: str, piece_rows: int, stored: DataFrame | None = None
) -> DataFrame:
    """The same figures from running sums over one row per user and time.

    ``stored`` may name a cheaper frame with the ratings of ``hot``; it is read several times.
    Ratings are taken relative to the user's mean, so that sums of squares stay
    small; there is one mean per hot user. That of whole ratings is made whole, and their sums are exact.
    """
    given = hot if stored is None else stored.select(user, ts, rating)
    whole = _whole(hot, rating)
    mean = F.coalesce(F.avg(rating), F.lit(0.0))
    means = settled(given.groupBy(F.col(user).alias("_user")).agg((F.round(mean) if whole else mean).alias("_mean")))
    means = offered(means)
    centred = given.join(means, F.col(user).eqNullSafe(F.col("_user"))).drop("_user")
    r = F.col(rating).cast("double") - F.col("_mean")
    per_time = centred.groupBy(user, ts, "_mean").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(r).alias("_n"),
        F.sum(r).alias("_s"),
        F.sum(r * r).alias("_ss"),
    )
    sums = pieces.running_totals(per_time.drop("_mean"), user, ts, ["_rows", "_n", "_s", "_ss"], piece_rows)
    sums = sums.join(means, F.col(user).eqNullSafe(F.col("_user"))).drop("_user")
    n, s, ss = (F.col(c).cast("double") for c in ("_n", "_s", "_ss"))
    deviation = F.sqrt(F.greatest(F.try_divide(ss - F.try_divide(s * s, n), n - 1), F.lit(0.0)))
    average = F.col("_mean") + F.try_divide(s, n)
    if whole:
        deviation = _deviation(n, s, ss, deviation)
        average = F.try_divide(F.col("_mean") * n + s, n)
    stats = sums.select(
        F.col(user).alias("_user"),
        F.col(ts).alias("_ts"),
        F.col("_rows").alias("user_rating_count"),
        average.alias("user_avg_rating"),
        deviation.alias("user_rating_stddev"),
    )
    same = F.col(user).eqNullSafe(F.col("_user")) & F.col(ts).eqNullSafe(F.col("_ts"))
    return hot.join(stats, same).drop("_user", "_ts")


def add_running_stats(
    samples: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    rating: str = "rating",
    hot_rows: int = settings.HOT_KEY_ROWS,
    piece_rows: int = settings.CHUNK_ROWS,
) -> DataFrame:
    """Running count, mean and deviation of a user's ratings, the current row
    and all rows of the same time included. One rating has deviation 0."""
    cold, hot = pieces.split_hot(samples, user, hot_rows)
    stats = _running_stats(cold, [user], ts, rating)
    if hot is not None:
        stats = stats.unionByName(
            _running_stats_of_hot(hot, user, ts, rating, piece_rows).select(*stats.columns)
        )
    return stats.na.fill(0, ["user_avg_rating", "user_rating_stddev"])


def add_user_features(
    samples: DataFrame,
    user: str = "user_id",
    item: str = "item_id",
    order: Sequence[str] = TIE_BREAK,
    rows: int = settings.HISTORY_ROWS,
    shown: int = settings.HISTORY_SHOWN,
    hot_rows: int = settings.HOT_KEY_ROWS,
    piece_rows: int = settings.CHUNK_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """History and running figures of each sample, for users past their first.

    Both window groups share one shuffle and one sort: the row windows order by
    time and tie-break, and that order also serves the windows over time alone.
    """
    ts = order[0]
    cold, hot = pieces.split_hot(samples, user, hot_rows, counted)

    def recent(df: DataFrame, partition: list[str]) -> DataFrame:
        return _last_positives(df, partition, item, order, rows, shown)

    out = _running_stats(recent(cold, [user]), [user], ts, "rating")
    if hot is not None:
        cut = pieces.cut(hot, user, order, piece_rows)
        far = pieces.over_recent_rows(cut, user, order, rows, recent).drop(pieces.PIECE)
        far = _running_stats_of_hot(far, user, ts, "rating", piece_rows, cut)
        out = out.unionByName(far.select(*out.columns))
    known = [c for c in ("rating", "votes", "score") if c in out.columns]
    return out.na.fill(0, [*known, "user_avg_rating", "user_rating_stddev"]).where(
        F.col("user_rating_count") > 1
    )


def add_release_year_stats(
    samples: DataFrame,
    user: str = "user_id",
    year: str = "release_year",
    order: Sequence[str] = TIE_BREAK,
    rows: int = settings.HISTORY_ROWS,
    hot_rows: int = settings.HOT_KEY_ROWS,
    piece_rows: int = settings.CHUNK_ROWS,
) -> DataFrame:
    """Mean and deviation of the release years of the previous ``rows`` samples."""

    def compute(df: DataFrame, partition: list[str]) -> DataFrame:
        w = _recent(partition, order, rows)
        return df.select(
            *df.columns,
            F.avg(year).over(w).alias("user_avg_release_year"),
            F.stddev_samp(year).over(w).alias("user_release_year_stddev"),
        )

    out = _by_recent_rows(samples, user, order, rows, compute, hot_rows, piece_rows)
    return out.na.fill(0, ["user_avg_release_year", "user_release_year_stddev"])


def add_favourite_tags(
    samples: DataFrame,
    user: str = "user_id",
    tags: str = "tags",
    order: Sequence[str] = TIE_BREAK,
    rows: int = settings.HISTORY_ROWS,
    hot_rows: int = settings.HOT_KEY_ROWS,
    piece_rows: int = settings.CHUNK_ROWS,
) -> DataFrame:
    """Tags of the items liked among the previous ``rows`` samples, most frequent first."""

    def compute(df: DataFrame, partition: list[str]) -> DataFrame:
        liked = F.collect_list(F.when(F.col("label") == 1, F.col(tags)))
        return df.withColumn("favourite_tags", arrays.favourite_tags(liked.over(_recent(partition, order, rows))))

    return _by_recent_rows(samples, user, order, rows, compute, hot_rows, piece_rows)
