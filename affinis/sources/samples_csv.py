"""Training samples as CSV files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinis import schemas


def write(samples: DataFrame, path: str) -> None:
    """One file per partition; the job stays as parallel as the frame."""
    samples.write.option("header", True).mode("overwrite").csv(path)


def write_split(train: DataFrame, test: DataFrame, folder: str) -> None:
    write(train, f"{folder}/trainSample")
    write(test, f"{folder}/testSample")


def read(spark: SparkSession, path: str, schema=schemas.TRAINING_SAMPLE) -> DataFrame:
    """Rows that do not fit the schema are left out; missing numbers count as 0."""
    return (
        spark.read.schema(schema)
        .options(header=True, mode="DROPMALFORMED", enforceSchema=True)
        .csv(path)
        .na.fill(0)
    )
