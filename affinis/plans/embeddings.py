"""The vector job: from interactions to item vectors, user vectors and buckets."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from affinis import settings
from affinis.operators import embeddings
from affinis.session import settled
from affinis.sources import embedding_text, keyvalue


class EmbeddingTables(NamedTuple):
    item_emb: DataFrame
    user_emb: DataFrame
    buckets: DataFrame


def embedding_tables(
    interactions: DataFrame,
    order: Sequence[str] = ("ts", "event_id"),
    weight=None,
    partitions: int | None = None,
    min_count: int = 5,
    **training,
) -> EmbeddingTables:
    """Train on the users' sequences and average over what each user collected.

    The vectors are stored once; they are small next to the interactions.
    """
    sequences = settled(embeddings.item_sequences(interactions, order, min_count=min_count))
    model = embeddings.train_item2vec(sequences, partitions=partitions, min_count=min_count, **training)
    item_emb = settled(embeddings.item_vectors(model))
    user_emb = settled(embeddings.user_vectors(interactions, item_emb, weight))
    return EmbeddingTables(item_emb, user_emb, embeddings.bucket(embeddings.fit_buckets(item_emb), item_emb))


def write(tables: EmbeddingTables, folder: str) -> None:
    """Text files and key-value entries of both vector tables."""
    embedding_text.write(tables.item_emb, f"{folder}/itemEmb")
    embedding_text.write(tables.user_emb, f"{folder}/userEmb")
    keyvalue.write(
        keyvalue.encode_vectors(tables.item_emb, settings.ITEM_EMBEDDING_PREFIX).unionByName(
            keyvalue.encode_vectors(tables.user_emb, settings.USER_EMBEDDING_PREFIX)
        ),
        f"{folder}/embeddings",
    )
