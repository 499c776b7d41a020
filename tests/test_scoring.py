import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators.scoring import top_k_cosine

EMB = "id long, emb array<double>"


def brute(queries, items, k, exclude=(), exclude_self=False):
    out = {}
    for q, u in queries:
        scored = []
        for i, v in items:
            if v is None or (q, i) in exclude or (exclude_self and q == i):
                continue
            if len(u) != len(v):
                s = -1.0
            else:
                n = np.linalg.norm(u) * np.linalg.norm(v)
                s = None if n == 0 else round(float(np.dot(u, v) / n), 6)
            scored.append((s is None, -(s if s is not None else 0), i, s))
        out[q] = [(i, s) for _, _, i, s in sorted(scored)[:k]]
    return out


def result(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def clustered(n, seed, dims=6, centres=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, dims)) * 3
    # A third of the vectors are the very same one.
    return [
        (i, [1.0] * dims if i % 3 == 0 else list(map(float, middle[i % centres] + r.normal(size=dims) * 0.2)))
        for i in range(n)
    ]


def same(got, want):
    assert set(got) == {q for q, rows in want.items() if rows}
    for q, rows in got.items():
        assert [i for i, _ in rows] == [i for i, _ in want[q]]
        for (_, a), (_, b) in zip(rows, want[q]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 2e-6)


PATHS = [dict(), dict(item_block_rows=16, query_block_rows=8), dict(item_block_rows=16, query_block_rows=8, resident_bytes=0)]


@pytest.mark.parametrize("sizes", PATHS)
def test_top_k_equals_brute_force(spark, sizes):
    items, queries = clustered(160, 1), [(1000 + i, v) for i, v in clustered(40, 2)]
    seen = {(1000 + q, i) for q in range(40) for i in range(q % 7 * 10)}
    ex = spark.createDataFrame([*seen, *seen], "query_id long, item_id long")
    q, i = spark.createDataFrame(queries, EMB), spark.createDataFrame(items, EMB)
    same(result(top_k_cosine(q, i, 12, **sizes)), brute(queries, items, 12))
    same(result(top_k_cosine(q, i, 12, exclude=ex, **sizes)), brute(queries, items, 12, seen))
    same(result(top_k_cosine(i, i, 7, exclude_self=True, **sizes)), brute(items, items, 7, exclude_self=True))
    same(result(top_k_cosine(q, i, 500, **sizes)), brute(queries, items, 500))


@pytest.mark.parametrize("sizes", PATHS)
def test_odd_vectors(spark, sizes):
    items = clustered(40, 3) + [(900, [0.0] * 6), (901, [1.0, 2.0]), (902, None)]
    queries = [(1, [1.0] * 6), (2, [2.0, 1.0]), (3, [0.0] * 6)]
    q, i = spark.createDataFrame(queries, EMB), spark.createDataFrame(items, EMB)
    same(result(top_k_cosine(q, i, 60, **sizes)), brute(queries, items, 60))


def test_no_items_or_no_queries(spark):
    none = spark.createDataFrame([], EMB)
    some = spark.createDataFrame(clustered(5, 4), EMB)
    assert top_k_cosine(none, some, 3).count() == 0
    assert top_k_cosine(some, none, 3).count() == 0


def test_far_cells_are_skipped():
    from affinis.operators.blocks import visits

    pivots = np.eye(3)
    cells = [(0, 10, 0.1), (1, 10, 0.1), (2, 10, 0.1)]
    keep = visits([np.array([1.0, 0.01, 0.0])], np.array([5]), pivots, cells)
    assert keep.tolist() == [[True, False, False]]
    keep = visits([np.array([1.0, 0.01, 0.0])], np.array([15]), pivots, cells)
    assert keep[0][:2].all()


def test_scores_are_symmetric_and_bounded(spark):
    i = spark.createDataFrame(clustered(60, 5), EMB)
    rows = {(r["query_id"], r["item_id"]): r["score"] for r in top_k_cosine(i, i, 100, exclude_self=True).collect()}
    assert len(rows) == 60 * 59
    assert all(-1 <= s <= 1 and s == rows[(b, a)] for (a, b), s in rows.items())


def test_plans_hold_no_cross_join(spark):
    i = spark.createDataFrame(clustered(60, 6), EMB)
    for sizes in PATHS:
        plan = top_k_cosine(i, i, 3, exclude_self=True, **sizes)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert F


def test_long_top_lists_are_cut_before_the_shuffle(spark):
    from affinis.operators.latest import top_rows

    rows = spark.range(20_000).select((F.col("id") % 3).alias("key"), "id")
    top = top_rows(rows, "key", [F.col("id").desc()], 5000)
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert top.groupBy("key").count().where("count = 5000").count() == 3


def _asked(n, width, seed):
    import pyarrow as pa

    r = np.random.default_rng(seed)
    vectors = [v.tobytes() for v in r.normal(size=(n, width))]
    return pa.record_batch({"id": pa.array(range(n), pa.int64()), "vector": vectors, "taken": pa.array([[i, i + 1] for i in range(n)], pa.list_(pa.int64()))})


def test_memory_does_not_grow_with_the_items():
    """The best rows of a chunk of queries are all that a task keeps: 200,000 items cost no more than 20,000."""
    import tracemalloc

    from affinis.operators.scoring import _Chunk

    peaks = []
    for items in (20_000, 200_000):
        chunk, r = _Chunk([_asked(256, 8, 1)], 500, False, 2048), np.random.default_rng(2)
        tracemalloc.start()
        for s in range(0, items, 10_000):
            chunk.meet(np.arange(s, s + 10_000), r.normal(size=80_000), np.arange(10_001) * 8)
        rows = sum(b.num_rows for b in chunk.found())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == 256 * 500
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("sizes", PATHS)
def test_rows_are_final_and_nothing_is_broadcast(spark, sizes):
    """Taken items are masked where they are scored: no rows beside the k best are made, joined or ranked, and no side of vectors is sent to the driver."""
    i = spark.createDataFrame(clustered(200, 7), EMB)
    taken = spark.range(200).selectExpr("0 as query_id", "id as item_id").where("item_id < 150")
    found = top_k_cosine(i, i, 5, exclude=taken, **sizes)
    assert {r["rank"] for r in found.collect()} == {1, 2, 3, 4, 5} and found.where("query_id = 0 and item_id < 150").count() == 0
    above = found._jdf.queryExecution().optimizedPlan().toString()
    if sizes.get("resident_bytes") == 0:
        assert "Window" not in above and "Join" not in above


def test_chunks_of_a_task_share_one_pass_of_the_items(spark):
    items, queries = clustered(160, 8), clustered(160, 9)
    q, i = spark.createDataFrame(queries, EMB), spark.createDataFrame(items, EMB)
    found = top_k_cosine(q, i, 4, item_block_rows=16, query_block_rows=8, resident_bytes=0)
    # 20 chunks of 8 queries in two rounds of four tasks.
    assert found.rdd.getNumPartitions() == 8
    same(result(found), brute(queries, items, 4))


@pytest.mark.parametrize("early", [0, 25])
def test_screening_in_single_precision_loses_nothing(monkeypatch, early):
    """Near ties closer than single precision can tell, repeated vectors and ones without a direction."""
    from affinis.operators import scoring

    monkeypatch.setattr(scoring, "_EARLY", early)
    r = np.random.default_rng(10)
    base = r.normal(size=(40, 16))
    vectors = np.concatenate([base[r.integers(0, 40, 4000)] * (1 + r.normal(size=(4000, 1)) ** 2), r.normal(size=(2000, 16))])
    vectors[:2000] += r.normal(size=(2000, 16)) * 1e-7
    vectors = vectors[r.permutation(6000)]
    vectors[::97] = 0.0
    batch = _asked(64, 16, 11)
    asked = np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(64, 16)
    chunk, kinds = scoring._Chunk([batch], 50, False, 256), []
    add = chunk.best.add
    monkeypatch.setattr(chunk.best, "add", lambda cos, *more: kinds.append(cos.dtype) or add(cos, *more))
    for s in range(0, 6000, 1000):
        chunk.meet(np.arange(s, s + 1000), vectors[s: s + 1000].ravel(), np.arange(1001) * 16)
    got = {}
    for b in chunk.found():
        for q, i, score in zip(*(b.column(c).to_pylist() for c in ("query_id", "item_id", "score"))):
            got.setdefault(q, []).append((i, score))
    same(got, brute(list(enumerate(asked)), list(enumerate(vectors)), 50, {(q, i) for q in range(64) for i in (q, q + 1)}))
    assert kinds[-1] == np.float32


def test_small_chunks_do_not_make_the_items_travel_more_often(spark):
    """As many passes as tasks are worth it, however few queries lie in a chunk; the ids that went past are held once."""
    from affinis.operators import scoring

    items, queries = clustered(120, 1), [(1000 + i, v) for i, v in clustered(600, 2)]
    q, i = spark.createDataFrame(queries, EMB), spark.createDataFrame(items, EMB)
    got = top_k_cosine(q, i, 5, query_block_rows=4, item_block_rows=7, resident_bytes=0)
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    same(result(got), brute(queries, items, 5))
    # 540,000 queries of 300 rows each: once for each 26,666 queries, not for each 256.
    assert scoring.passes(540_000, 64, 300, 8) == 24 and scoring.passes(540_000, 4096, 2000, 8) == 136
    chunks = [scoring._Chunk([_asked(6, 3, 1)], 2, False, 4) for _ in range(3)]
    r = np.random.default_rng(2)
    scoring._meet(chunks, np.arange(10), r.normal(size=30), np.arange(11) * 3)
    assert all(c.seen[0] is chunks[0].seen[0] and c.n_seen == 10 for c in chunks)
