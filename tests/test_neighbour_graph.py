"""The neighbour graph against the exact nearest."""

import numpy as np

from affinis.operators.neighbour_graph import neighbour_graph, recall_of
from affinis.operators.scoring import top_k_cosine
from test_scoring import EMB


def exact(df, k):
    return top_k_cosine(df, df, k, exclude_self=True).selectExpr("query_id AS id", "item_id AS other", "score")


def test_recall_on_clusters_with_a_hub(spark):
    r = np.random.default_rng(2)
    middle = r.normal(size=(12, 16)) * 2
    rows = [(i, list(map(float, middle[i % 12] + r.normal(size=16)))) for i in range(600)]
    # One direction that lies near everything of its cluster, many times over.
    rows += [(1000 + i, list(map(float, middle[0]))) for i in range(60)]
    df = spark.createDataFrame(rows, EMB)
    graph = neighbour_graph(df, 8, block=40).cache()
    assert recall_of(graph, exact(df.where("id < 1000"), 8).where("id % 12 <> 0")).first()[0] >= 0.9
    lists = graph.groupBy("id").agg({"rank": "max", "*": "count"}).collect()
    assert len(lists) == 660 and all(x[1] == x[2] == 8 for x in lists)
    true = {(x.id, x.other): x.score for x in exact(df, 700).collect()}
    assert all(abs(true[x.id, x.other] - x.score) < 2e-6 for x in graph.collect())


def test_odd_vectors_and_small_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 2.0, 3.0]), (6, [-1.0, 0.0])]
    got = neighbour_graph(spark.createDataFrame(rows, EMB), 5)
    assert {(x.id, x.other, x.rank) for x in got.collect()} == {(1, 2, 1), (1, 6, 2), (2, 1, 1), (2, 6, 2), (6, 2, 1), (6, 1, 2)}
    assert neighbour_graph(spark.createDataFrame([], EMB), 5).collect() == []
    assert neighbour_graph(spark.createDataFrame(rows[:1], EMB), 5).collect() == []


def test_recall_is_reached_where_neighbours_tell_nothing(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, list(map(float, r.normal(size=64)))) for i in range(1500)], EMB)
    got = neighbour_graph(df, 5, width=5, block=40).cache()
    assert recall_of(got, exact(df, 5)).first()[0] >= 0.9
    assert got.count() == 7500 and got.columns == ["id", "other", "score", "rank"]
