"""Embeddings as text lines ``id:v1 v2 ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.functions import vectors


def lines(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(vectors.to_line(F.col("id"), F.col("emb")).alias("value"))


def parse(text: DataFrame) -> DataFrame:
    value = F.col("value")
    return text.select(vectors.line_id(value).alias("id"), vectors.line_vector(value).alias("emb"))


def write(embeddings: DataFrame, path: str) -> None:
    lines(embeddings).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))
