"""Top-k in tiles against brute force, and that tiles which can't help are not visited."""

import numpy as np
import pandas as pd
import pytest

from affinis.operators import tiles
from affinis.operators.tiles import top_k_tiles
from test_scoring import EMB, brute, clustered, result, same

SIZES = [dict(), dict(tile_rows=16, pack_rows=8), dict(tile_rows=10, pack_rows=8, queries_per_task=7)]


@pytest.mark.parametrize("sizes", SIZES)
def test_tiles_equal_brute_force(spark, sizes):
    items, queries = clustered(160, 1), [(1000 + i, v) for i, v in clustered(40, 2)]
    seen = {(1000 + q, i) for q in range(40) for i in range(q % 7 * 10)}
    ex = spark.createDataFrame([*seen, *seen, (None, 1), (1000, None)], "query_id long, item_id long")
    q, i = spark.createDataFrame(queries, EMB), spark.createDataFrame(items, EMB)
    same(result(top_k_tiles(q, i, 12, exclude=ex, **sizes)), brute(queries, items, 12, seen))
    same(result(top_k_tiles(i, i, 7, exclude_self=True, **sizes)), brute(items, items, 7, exclude_self=True))


@pytest.mark.parametrize("sizes", SIZES[1:])
def test_odd_vectors(spark, sizes):
    items = clustered(40, 3) + [(900, [0.0] * 6), (901, [1.0, 2.0]), (902, None)]
    queries = [(1, [1.0] * 6), (2, [2.0, 1.0]), (3, [0.0] * 6), (4, None)]
    q, i = spark.createDataFrame(queries, EMB), spark.createDataFrame(items, EMB)
    same(result(top_k_tiles(q, i, 60, **sizes)), brute([x for x in queries if x[1]], items, 60))
    same(result(top_k_tiles(q, i, 3, **sizes)), brute([x for x in queries if x[1]], items, 3))


def test_no_items_or_no_queries(spark):
    none, some = spark.createDataFrame([], EMB), spark.createDataFrame(clustered(5, 4), EMB)
    assert top_k_tiles(none, some, 3).count() == 0 and top_k_tiles(some, none, 3).count() == 0


def test_tiles_below_the_kth_score_are_not_visited():
    r = np.random.default_rng(1)
    plan = tiles.Plan(np.eye(12), [(t, 0.2, 1) for t in range(12)])
    near = [list(np.eye(12)[i % 12] + r.normal(size=12) * 0.01) for i in range(120)]
    frame = pd.DataFrame({"id": range(120), "emb": near, "taken": None, "least": 0.95})
    packs = pd.concat(tiles._visits(plan, 0, 12, 1000)(iter([frame])))
    assert sum(map(len, packs["ids"])) == 120  # one tile each, of twelve
    frame["least"] = np.nan
    assert sum(map(len, pd.concat(tiles._visits(plan, 0, 12, 1000)(iter([frame])))["ids"])) == 12 * 120
    # Rounds part the tiles: every query sees each tile once.
    rounds = [pd.concat(tiles._visits(plan, a, b, 7)(iter([frame]))) for a, b in ((0, 1), (1, 3), (3, 7), (7, 15))]
    seen = sorted((t, q) for p in rounds for t, ids in zip(p["tile"], p["ids"]) for q in ids)
    assert seen == sorted((t, q) for t in range(12) for q in range(120))


def test_a_query_travels_to_a_group_of_tiles_once(spark):
    """However small the tiles: sixteen of ten items lie in one block, so a query goes there once and not sixteen times."""
    items = spark.createDataFrame(clustered(160, 1), EMB)
    plan = tiles._plan(items, 10)
    frame = pd.DataFrame(clustered(40, 2), columns=["id", "emb"]).assign(taken=None, least=np.nan)
    packs = pd.concat(tiles._visits(plan, 0, 16, 8)(iter([frame])))
    assert sum(map(len, packs["ids"])) == 40


def test_groups_hold_whole_tiles_up_to_their_size():
    r = np.random.default_rng(3)
    pivots = r.normal(size=(50, 8))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    plan = tiles._grouped(pivots, [(t, 30, 0.3) for t in range(50)] + [(tiles.IRREGULAR, 250, 0.0)], 100)
    groups = pd.Series(plan.group_of)
    assert set(groups.index) == {*range(50), tiles.IRREGULAR} and groups.drop(tiles.IRREGULAR).value_counts().max() == 3
    assert plan.blocks[tiles.IRREGULAR] == 3 and set(plan.blocks.values()) == {1, 3}
    # A group's bound is the highest of its tiles'.
    alone = tiles.Plan(pivots, [(t, 0.3, 1) for t in range(50)])
    queries = list(r.normal(size=(20, 8)))
    one, many = alone.bounds(queries), plan.bounds(queries)
    for g in set(groups.drop(tiles.IRREGULAR)):
        mine = [t for t in range(50) if plan.group_of[t] == g]
        assert np.allclose(many[:, list(plan.tile).index(g)], one[:, mine].max(axis=1))


def test_a_query_travels_once_a_round_however_many_groups_it_visits(spark, monkeypatch):
    """Sixteen groups of ten items, all of them wanted: what is stored and shipped of a round are the queries, not queries times groups."""
    monkeypatch.setattr(tiles.settings, "ITEM_BLOCK_ROWS", 10)
    stored, settled = [], tiles.settled

    def counted(df):
        out = settled(df)
        stored.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(tiles, "settled", counted)
    r = np.random.default_rng(5)
    items, queries = [(i, r.normal(size=6).tolist()) for i in range(160)], [(1000 + i, r.normal(size=6).tolist()) for i in range(40)]
    q, i = spark.createDataFrame(queries, EMB), spark.createDataFrame(items, EMB)
    same(result(top_k_tiles(q, i, 12, tile_rows=10, pack_rows=8)), brute(queries, items, 12))
    asked = [n for columns, n in stored if {"vector", "taken"} <= columns]
    assert len(asked) > 2 and max(asked) == 40


def test_rows_of_a_repeated_query_share_one_list(spark):
    items, queries = clustered(60, 6), clustered(30, 7)
    twice = spark.createDataFrame(queries + queries[:5], EMB)
    got = top_k_tiles(twice, spark.createDataFrame(items, EMB), 4, tile_rows=10)
    assert got.groupBy("query_id").count().where("count > 4").count() == 0 and got.count() == 30 * 4
