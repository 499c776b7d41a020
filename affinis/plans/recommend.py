"""Recommendations, similar items and similar users for many keys in one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis import settings
from affinis.operators import lists, search
from affinis.operators.scoring import top_k_cosine
from affinis.session import settled

# A scorer takes ranked candidates ``user_id, item_id, rank, score`` and returns
# those it can score with a new ``score``; null keeps the recall order.
Scorer = Callable[[DataFrame], DataFrame]


def candidates_with_vectors(item_emb: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Items that may be recommended: those with a vector, inside the catalogue if given."""
    known = item_emb.where(F.col("emb").isNotNull())
    if catalogue is None:
        return known
    return known.join(catalogue.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")


def recall(
    user_emb: DataFrame,
    item_emb: DataFrame,
    k: int = settings.RECALL_SIZE,
    collected: DataFrame | None = None,
    catalogue: DataFrame | None = None,
    **sizes,
) -> DataFrame:
    """``user_id, item_id, score, rank``: the items closest to each user that
    they have not collected."""
    exclude = None
    if collected is not None:
        exclude = collected.select(F.col("user_id").alias("query_id"), "item_id")
    found = top_k_cosine(user_emb, candidates_with_vectors(item_emb, catalogue), k, exclude=exclude, **sizes)
    return found.withColumnRenamed("query_id", "user_id")


def rank(candidates: DataFrame, model: str, scorers: Mapping[str, Scorer] | None = None) -> DataFrame:
    """Reorder recalled candidates with a scorer.

    ``emb`` and unknown names keep the recall order, and so does a user none of
    whose candidates got a score. Items the scorer leaves out drop from the
    lists of the other users.
    """
    scorer = (scorers or {}).get(model)
    if scorer is None:
        return candidates
    # The scorer and the join below must see the same rows, made once.
    candidates = settled(candidates)
    scored = scorer(candidates).select("user_id", "item_id", F.col("score").alias("_score"))
    both = candidates.join(scored, ["user_id", "item_id"], "left")
    answered = F.max(F.col("_score").isNotNull()).over(W.partitionBy("user_id"))
    kept = both.withColumn("_answered", answered).where(~F.col("_answered") | F.col("_score").isNotNull())
    by_score = W.partitionBy("user_id").orderBy(
        F.col("_score").desc_nulls_last(), F.when(F.col("_answered"), F.col("item_id")).otherwise(F.col("rank"))
    )
    return kept.select(
        "user_id",
        "item_id",
        F.coalesce("_score", "score").alias("score"),
        F.row_number().over(by_score).alias("rank"),
    )


def cold_start(
    users: DataFrame,
    documents: DataFrame,
    k: int = settings.MAX_RECOMMENDATIONS,
    start: int = 0,
    size: int | None = None,
) -> DataFrame:
    """The popularity list for each user, or one page of it; nothing is excluded.

    The list has a fixed greatest length, so it enters the plan as one value and
    only the asked page is repeated per user.
    """
    total, score = F.col("total"), F.col("score")
    ranked = F.array_sort(
        F.collect_list(
            F.struct(
                total.isNull().alias("a"), (-total).alias("b"), score.isNull().alias("c"), (-score).alias("d"), "id"
            )
        )
    )
    ids = F.slice(F.transform(ranked, lambda r: r["id"]), 1, k)
    shown = F.slice(ids, start + 1, k if size is None else size)
    found = search.popular(documents).agg(F.struct(shown.alias("ids"), F.size(ids).alias("total"))).scalar()
    listed = users.select("user_id", found.alias("_list"))
    return listed.select("user_id", F.posexplode("_list.ids"), "_list.total").select(
        "user_id",
        F.col("col").alias("item_id"),
        F.lit(None).cast("double").alias("score"),
        (F.col("pos") + start + 1).alias("rank"),
        F.col("total").cast("long").alias("total"),
    )


class _Asked:
    """The asked users by where their list comes from."""

    def __init__(self, users: DataFrame, model: str, user_emb: DataFrame, stored: DataFrame | None, as_of: Column | None):
        rest = users.select("user_id").distinct()
        self.served = None
        if stored is not None:
            young = lists.fresh(stored.where(F.col("model") == model), as_of, settings.RECOMMENDATION_TTL_SECONDS)
            young = young.join(rest, "user_id", "left_semi")
            self.served = young.select("user_id", "item_id", "score", "rank").withColumn("source", F.lit("stored"))
            rest = rest.join(young.select("user_id").distinct(), "user_id", "left_anti")
        vectors = user_emb.where(F.col("emb").isNotNull())
        self.warm = vectors.join(rest.select(F.col("user_id").alias("id")), "id", "left_semi")
        self.cold = rest.join(vectors.select(F.col("id").alias("user_id")), "user_id", "left_anti")


def _own_lists(
    asked: _Asked, model, item_emb, collected, scorers, catalogue, recall_size, max_size
) -> DataFrame:
    """Lists made for the user, stored or scored now."""
    k = max_size if model == "emb" else recall_size
    ranked = rank(recall(asked.warm, item_emb, k, collected, catalogue), model, scorers)
    out = ranked.withColumn("source", F.lit("scored"))
    if asked.served is not None:
        out = out.unionByName(asked.served)
    return lists.cap(out, max_size)


def recommend_lists(
    users: DataFrame,
    model: str,
    *,
    user_emb: DataFrame,
    item_emb: DataFrame,
    collected: DataFrame,
    documents: DataFrame,
    scorers: Mapping[str, Scorer] | None = None,
    stored: DataFrame | None = None,
    as_of: Column | None = None,
    catalogue: DataFrame | None = None,
    recall_size: int = settings.RECALL_SIZE,
    max_size: int = settings.MAX_RECOMMENDATIONS,
) -> DataFrame:
    """Full lists ``user_id, item_id, score, rank, source`` of the asked users.

    Stored lists of the same model that are still fresh are served as they are.
    Users without a vector get the popularity list, the others recall and rank.
    Vectors are used more than once: pass them from storage.
    """
    asked = _Asked(users, model, user_emb, stored, as_of)
    own = _own_lists(asked, model, item_emb, collected, scorers, catalogue, recall_size, max_size)
    popular = cold_start(asked.cold, documents, max_size).drop("total")
    return own.unionByName(popular.withColumn("source", F.lit("popular")))


def recommend(
    users: DataFrame,
    model: str,
    start: int,
    size: int,
    *,
    user_emb: DataFrame,
    item_emb: DataFrame,
    collected: DataFrame,
    documents: DataFrame,
    scorers: Mapping[str, Scorer] | None = None,
    stored: DataFrame | None = None,
    as_of: Column | None = None,
    catalogue: DataFrame | None = None,
    recall_size: int = settings.RECALL_SIZE,
    max_size: int = settings.MAX_RECOMMENDATIONS,
) -> DataFrame:
    """One page per asked user, with ``total`` and ``has_more``."""
    asked = _Asked(users, model, user_emb, stored, as_of)
    own = _own_lists(asked, model, item_emb, collected, scorers, catalogue, recall_size, max_size)
    popular = cold_start(asked.cold, documents, max_size, start, size).withColumns(
        {"source": F.lit("popular"), "has_more": F.lit(start + size) < F.col("total")}
    )
    return lists.page(own, "user_id", start, size).unionByName(popular)


def similar_items(item_emb: DataFrame, keys: DataFrame | None = None, k: int = settings.MAX_SIMILAR_ITEMS, **sizes) -> DataFrame:
    """The items closest to each item, itself excluded."""
    return _similar(item_emb, keys, k, **sizes)


def similar_users(user_emb: DataFrame, keys: DataFrame | None = None, k: int = settings.MAX_SIMILAR_USERS, **sizes) -> DataFrame:
    """The users closest to each user; users without a vector get no list.

    Lists are kept to a fixed length and cut on reading, so a short first
    request does not shorten later ones.
    """
    return _similar(user_emb, keys, k, **sizes)


def _similar(emb: DataFrame, keys: DataFrame | None, k: int, **sizes) -> DataFrame:
    emb = settled(emb.select("id", "emb"))
    asked = emb if keys is None else emb.join(keys.select("id").distinct(), "id", "left_semi")
    found = top_k_cosine(asked, emb, k, exclude_self=True, stored=True, **sizes)
    return found.select(F.col("query_id").alias("id"), F.col("item_id").alias("similar_id"), "score", "rank")


def to_store(ranked: DataFrame, model: str, computed_at: Column) -> DataFrame:
    """Lists with the model they belong to and the time they were made."""
    return ranked.select("user_id", "item_id", "score", "rank").withColumns(
        {"model": F.lit(model), "computed_at": computed_at}
    )
