"""Phrase-prefix search through a stored positional index instead of a scan of every text.

The index has a row per text and token with the token's positions. It is split by documents, so that changed documents
rewrite only their buckets, and sorted by token within each file: the words of a search reach the scan as equalities and
one prefix, which row-group bounds and bloom filters answer without reading the rest. A phrase is found where each of its words
has a position that many places behind one start.

At scale: building moves each text once, to its bucket, and groups its tokens within the row that holds it; a search moves the positions of its own words
only, summed by document and start. Results are those of ``operators.search``.

Defined results: null and texts without tokens have no rows and match nothing; a keyword without tokens matches nothing;
repeated documents match once, at the first match of either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from affinis import settings
from affinis.functions import arrays, text as text_fn
from affinis.sources.buckets import BucketTable


def _sources(documents: DataFrame, key: str, name: str) -> DataFrame:
    # Texts of one id are told apart, or words of two would meet in one phrase.
    return documents.select(F.col(key).alias("id"), F.xxhash64(F.col(name)).alias("copy"), F.col(name).alias("text"))


def _postings(sources: DataFrame) -> DataFrame:
    """A row per text and token: its positions, from 0, ascending. Each row is worked on by itself; nothing is moved."""
    found = sources.select("id", "copy", arrays.places(text_fn.tokens(F.col("text"))).alias("_places"))
    return found.select("id", "copy", F.inline("_places").alias("token", "positions"))


def postings(documents: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """A row per document and token with its positions; a document given twice has its rows twice."""
    return _postings(_sources(documents, key, name))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", buckets: int = 64):
        schema = StructType.fromDDL(f"id {id_type}, copy long, token string, positions array<int>")
        self.spark, self.table = spark, BucketTable(spark, path, schema, "id", buckets, sort="token")

    def create(self, documents: DataFrame, key: str = "id", name: str = "name") -> None:
        self.table.create_from(_sources(documents, key, name), _postings, F.coalesce(F.octet_length("text"), F.lit(0)))

    def update(self, documents: DataFrame, gone: DataFrame | None = None, key: str = "id", name: str = "name") -> list[int]:
        """Changed or new documents take the place of their old rows; those of ``gone`` lose theirs. Returns the buckets rewritten."""
        ids = documents.select(F.col(key).alias("id"))
        if gone is not None:
            ids = ids.unionAll(gone.select(F.col(key).alias("id")))
        buckets = self.table.touched(ids)
        kept = self.table.part(buckets).join(ids.distinct(), "id", "left_anti")
        self.table.replace(buckets, kept.unionByName(postings(documents, key, name)))
        return buckets

    def words_of(self, keyword: str) -> list[str]:
        return self.spark.range(1).select(text_fn.tokens(F.lit(keyword)).alias("words")).first()["words"]

    def hits(self, words: list[str]) -> DataFrame:
        """Rows of the index that a phrase of these words, the last one open, needs."""
        asked = F.col("token").startswith(words[-1])
        if words[:-1]:
            asked = asked | F.col("token").isin(words[:-1])
        return self.table.read().where(asked)

    def matches(self, keyword: str) -> DataFrame:
        """(id, match_at) of the documents that hold the keyword as a phrase, its last word as a prefix; places count from 1."""
        words = self.words_of(keyword)
        if not words:
            return self.table.read().where(F.lit(False)).select("id", F.lit(0).alias("match_at"))
        nothing = F.array().cast("array<struct<start: int, part: int>>")

        def starts_of(part: int):
            word = F.col("token")
            fits = word.startswith(words[part]) if part == len(words) - 1 else word == words[part]
            return F.when(fits, F.transform("positions", lambda p: F.struct((p - part).alias("start"), F.lit(part).alias("part")))).otherwise(nothing)

        starts = F.concat(*map(starts_of, range(len(words))))
        found = self.hits(words).select("id", "copy", F.explode(starts).alias("x")).groupBy("id", "copy", F.col("x.start").alias("start"))
        whole = found.agg(F.size(F.collect_set("x.part")).alias("n")).where(F.col("n") == len(words))
        return whole.groupBy("id").agg((F.min("start") + 1).alias("match_at"))

    def page(self, documents: DataFrame, keyword: str, size: int = settings.SEARCH_SIZE) -> DataFrame:
        """First page of matching documents: earliest match, then most popular, then id."""
        return documents.join(self.matches(keyword), "id").orderBy(
            "match_at", F.col("rating.total").desc_nulls_last(), F.col("rating.score").desc_nulls_last(), "id").limit(size)

    def suggest(self, documents: DataFrame, keyword: str, size: int = settings.SEARCH_SIZE) -> DataFrame:
        """Names of the first matching documents."""
        return self.page(documents.select("id", "api.name_cn", "rating"), keyword, size).select("id", F.col("name_cn").alias("name"))
