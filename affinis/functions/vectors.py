"""Vector expressions over ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two vectors: -1 when one is null or the lengths differ, null
    when one has no direction."""
    unusable = u.isNull() | v.isNull() | (F.size(u) != F.size(v))
    return F.when(unusable, F.lit(-1.0)).otherwise(F.try_divide(dot(u, v), norm(u) * norm(v)))


def add(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda x, y: x + y)


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def to_commas(v: Column) -> Column:
    return F.concat_ws(",", F.transform(v, lambda x: x.cast("string")))


def from_commas(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))


def to_line(id_: Column, v: Column) -> Column:
    """``id:v1 v2 ...``"""
    return F.concat(id_.cast("string"), F.lit(":"), F.concat_ws(" ", F.transform(v, lambda x: x.cast("string"))))


def line_id(line: Column) -> Column:
    return F.get(F.split(line, ":", 2), F.lit(0)).try_cast("long")


def line_vector(line: Column) -> Column:
    return F.transform(
        F.split(F.get(F.split(line, ":", 2), F.lit(1)), " "), lambda x: x.try_cast("double")
    )
