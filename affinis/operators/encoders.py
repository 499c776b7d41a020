"""Feature encodings shared by the rankers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis import settings

NUMERIC = ["votes", "score", "user_rating_count", "user_avg_rating", "user_rating_stddev"]
ITEM_TAGS = [f"item_tag_{i}" for i in (1, 2, 3)]
USER_TAGS = [f"user_tag_{i}" for i in (1, 2, 3, 4, 5)]


def cross_bucket(item="item_id", last="user_rated_item_1", buckets: int = settings.CROSS_BUCKETS):
    """Bucket of an item together with the last liked item; 0 stands for none.

    The number of buckets is the contract, not which pair lands where.
    """
    pair = F.concat_ws("|", F.col(item).cast("string"), F.coalesce(F.col(last), F.lit(0)).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(pair), 1, 15), 16, 10).cast("long"), F.lit(buckets))


def tag_encoder(vocabulary: DataFrame, columns: list[str]) -> PipelineModel:
    """One-hot columns ``<column>_hot`` over one vocabulary; unknown and missing
    tags become all zeros. The vocabulary's size is checked before it is read."""
    names = [r["name"] for r in vocabulary.select("name").distinct().orderBy("name").limit(settings.MAX_VOCABULARY + 1).collect()]
    if len(names) > settings.MAX_VOCABULARY:
        raise ValueError(f"more than {settings.MAX_VOCABULARY} tags; use the hashed tag vectors instead")
    index = StringIndexerModel.from_arrays_of_labels(
        [names] * len(columns), columns, outputCols=[f"{c}_at" for c in columns], handleInvalid="keep"
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}_at" for c in columns], outputCols=[f"{c}_hot" for c in columns], dropLast=True
    )
    spark = vocabulary.sparkSession
    # The last index marks unknown tags, so one row fixes the width.
    width = spark.range(1).select(*[F.lit(float(len(names))).alias(f"{c}_at") for c in columns])
    return PipelineModel([index, hot.fit(width)])


def bucket_encoder(spark: SparkSession, columns: dict[str, int]) -> PipelineModel:
    """One-hot columns ``<column>_hot`` for ids in ``0 .. buckets - 1``.

    The width is given, so nothing has to be learned from the data. Ids have to
    be passed through :func:`in_buckets` first.
    """
    width = spark.range(1).select(*[F.lit(float(n)).alias(c) for c, n in columns.items()])
    return PipelineModel([
        OneHotEncoder(inputCols=list(columns), outputCols=[f"{c}_hot" for c in columns], dropLast=True).fit(width)
    ])


def in_buckets(column, buckets: int):
    """An id as category. Ids beyond the range share the categories by hash, so
    that none is lost; only a null id encodes to zeros."""
    inside = F.when((column >= 0) & (column < buckets), column)
    return F.coalesce(inside, F.when(column.isNotNull(), F.pmod(F.xxhash64(column), F.lit(buckets))), F.lit(buckets)).cast("double")


def numeric_vector(output: str = "numbers") -> VectorAssembler:
    return VectorAssembler(inputCols=NUMERIC, outputCol=output, handleInvalid="keep")


def vector_or_zeros(column, size: int):
    return array_to_vector(F.coalesce(column, F.array_repeat(F.lit(0.0), size)))


def with_model_inputs(
    samples: DataFrame,
    user_emb: DataFrame,
    item_emb: DataFrame,
    size: int = settings.EMBEDDING_SIZE,
    user_buckets: int = settings.USER_ID_BUCKETS,
    item_buckets: int = settings.ITEM_ID_BUCKETS,
) -> DataFrame:
    """Samples with the columns all rankers read: vectors of both sides, tag
    lists, id categories and the crossed bucket. A missing vector is zeros.

    Vectors are converted once a user or item, before the join, not once a sample."""
    users = user_emb.select(F.col("id").alias("user_id"), vector_or_zeros(F.col("emb"), size).alias("_user_vector"))
    items = item_emb.select(F.col("id").alias("item_id"), vector_or_zeros(F.col("emb"), size).alias("_item_vector"))
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), size))
    tags = [c for c in ITEM_TAGS + USER_TAGS if c in samples.columns]
    missing = [c for c in ITEM_TAGS + USER_TAGS if c not in samples.columns]
    filled = samples.withColumns({c: F.lit("") for c in missing}) if missing else samples
    filled = filled.na.fill("", tags).na.fill(0, [c for c in NUMERIC if c in samples.columns])
    joined = filled.join(items, "item_id", "left").join(users, "user_id", "left")
    return joined.withColumns({
        "user_vector": F.coalesce("_user_vector", zeros),
        "item_vector": F.coalesce("_item_vector", zeros),
        # A missing tag is a word of its own, so no list is ever without words.
        "item_tags": F.array(*ITEM_TAGS),
        "user_tags": F.array(*USER_TAGS),
        "user_bucket": in_buckets(F.col("user_id"), user_buckets),
        "item_bucket": in_buckets(F.col("item_id"), item_buckets),
        "cross_bucket": cross_bucket().cast("double"),
    }).drop("_user_vector", "_item_vector")
