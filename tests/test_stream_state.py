"""Streams that keep users in state, and ingest in which every row has a fate."""

import datetime as dt
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest

from affinis import settings
from affinis.streaming import refresh, user_state
from affinis.streaming.fates import CountedIngest
from affinis.streaming.revisions import RevisionTable

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def write(spark, rows, path, parts=2):
    spark.createDataFrame(rows, refresh.INTERACTIONS).repartition(parts).write.mode("append").parquet(path)


def plain_features(rows):
    """Features of each user as of the newest row, from all rows at once."""
    out = {}
    for user in {r[1] for r in rows if r[1] is not None}:
        mine = [r for r in rows if r[1] == user]
        timed = sorted((r for r in mine if r[4] is not None), key=lambda r: (r[4], r[0]))
        liked = [r[2] for r in reversed(timed[-settings.HISTORY_ROWS - 1: -1]) if r[3] is not None and (r[3] >= 6 or r[3] == 0)][:5]
        rated = [r[3] for r in mine if r[3] is not None]
        out[user] = (*liked, *[0] * (5 - len(liked)), len(mine), round(statistics.fmean(rated), 6) if rated else None,
                     round(statistics.stdev(rated), 6) if len(rated) > 1 else 0.0, timed[-1][4] if timed else None)
    return out


def test_state_alone_equals_all_rows_at_once(spark, tmp_path):
    """Three deliveries out of order with a restart before each; a busy user; null ratings, times and users; copies."""
    r = random.Random(5)
    rows = [(i, r.choice([1, 1, 1, 2, 3, 4]), r.randint(1, 50), r.choice([None, *range(11)]), at(r.randint(0, 500))) for i in range(600)]
    rows += [(700, 5, 1, None, None), (701, 6, 2, 8, None), (702, 6, 3, 7, at(3)), (703, None, 1, 1, at(1)), (704, 7, 9, 0, at(10)), (705, 7, 8, 5, at(11))]
    r.shuffle(rows)
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(3):
        write(spark, rows[k::3] + rows[:40], src, 3)
        table = RevisionTable(spark, out, user_state.FEATURES)
        stream = refresh.ingest(refresh.read(spark, src, refresh.INTERACTIONS), "36500 days")
        user_state.keep_state_features(stream, table, checkpoint).awaitTermination()
    rounded = lambda x: None if x is None else round(x, 6)
    got = {x.user_id: (*x[1:6], x.user_rating_count, rounded(x.user_avg_rating), rounded(x.user_rating_stddev), x.last_ts) for x in table.latest("user_id").collect()}
    assert got == plain_features(rows)
    # Only touched users are put out again.
    assert table.all().where("user_id = 7").count() <= 2 < table.all().where("user_id = 1").count()


def test_parts_of_a_user_merge_in_any_order():
    r = random.Random(1)
    for _ in range(50):
        values = [r.uniform(-1e6, 1e6) for _ in range(r.randint(0, 30))]
        parts, i = [], 0
        while i < len(values):
            n = r.randint(1, 6)
            part = values[i: i + n]
            mean = statistics.fmean(part)
            parts.append((len(part) + 1, len(part), mean, sum((x - mean) ** 2 for x in part)))
            i += n
        r.shuffle(parts)
        total = (0, 0, 0.0, 0.0)
        for p in parts:
            total = user_state.merge(total, p)
        assert total[:2] == (len(values) + len(parts), len(values))
        if len(values) > 1:
            assert total[3] / (len(values) - 1) == pytest.approx(statistics.variance(values))


def test_a_task_hands_on_one_bounded_row_a_user():
    n = 5000
    batch = pa.record_batch({
        "user_id": pa.array([1] * n), "event_id": pa.array(range(n)), "item_id": pa.array(range(n)), "rating": pa.array([3.0] * n),
        "liked": pa.array([True] * n), "us": pa.array(range(n, 0, -1))})
    (part,) = user_state._partials(iter([batch]))
    assert part.num_rows == 1 and part.column("events").to_pylist() == [n]
    assert part.column("times").to_pylist()[0] == list(range(n - user_state.KEPT + 1, n + 1))


def test_every_row_has_one_fate(spark, tmp_path):
    batches = [
        [(1, 1, 1, 5, at(0)), (2, 1, 1, 5, at(100)), (2, 1, 1, 5, at(100)), (None, 1, 1, 5, at(50)), (None, 1, 1, 5, at(50)), (9, 1, 1, 5, None)],
        # Mark: 100 - 60 = 40. A copy within it is repeated, one behind it late, as is a new event.
        [(2, 1, 1, 5, at(100)), (1, 1, 1, 5, at(0)), (3, 1, 1, 5, at(39)), (4, 1, 1, 5, at(40)), (9, 1, 1, 5, None), (5, 1, 1, 5, at(300))],
        # Mark: 240.
        [(6, 1, 1, 5, at(239)), (7, 1, 1, 5, at(240)), (5, 1, 1, 5, at(300)), (9, 1, 1, 5, None)],
    ]
    ingest = CountedIngest(spark, str(tmp_path / "t"), refresh.INTERACTIONS, delay="60 minutes")
    src = str(tmp_path / "in")
    for rows in batches:
        write(spark, rows, src)
        ingest.start(refresh.read(spark, src, refresh.INTERACTIONS), str(tmp_path / "c")).awaitTermination()

    def counts():
        return [tuple(r) for r in ingest.counts.all().orderBy("batch_id").select("batch_id", "given", "kept", "late", "repeated", "watermark").collect()]

    def ids(table):
        return sorted((r.batch_id, r.event_id or -1) for r in table.all().select("batch_id", "event_id").collect())

    want = [(0, 6, 5, 0, 1, None), (1, 6, 2, 2, 2, at(40)), (2, 4, 1, 1, 2, at(240))]
    assert counts() == want
    assert ids(ingest.kept) == [(0, -1), (0, -1), (0, 1), (0, 2), (0, 9), (1, 4), (1, 5), (2, 7)] and ids(ingest.late) == [(1, 1), (1, 3), (2, 6)]
    # A batch taken again changes nothing, also not those after it.
    ingest.take(spark.createDataFrame(batches[1], refresh.INTERACTIONS), 1)
    assert counts() == want and len(ids(ingest.kept)) == 8


def test_no_rows_and_no_times(spark, tmp_path):
    ingest = CountedIngest(spark, str(tmp_path / "t"), refresh.INTERACTIONS, delay="60 minutes")
    for k, rows in enumerate(([], [(1, 1, 1, 5, None)], [(1, 1, 1, 5, None), (2, 1, 1, 5, at(0))], [])):
        ingest.take(spark.createDataFrame(rows, refresh.INTERACTIONS), k)
    got = [tuple(r) for r in ingest.counts.all().orderBy("batch_id").select("given", "kept", "late", "repeated").collect()]
    assert got == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 0, 1), (0, 0, 0, 0)]


def test_state_needs_no_setting_of_the_session(spark, tmp_path):
    """Spark's default store can't hold a state of several parts."""
    name, plain = user_state._STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, plain)
    try:
        write(spark, [(1, 1, 5, 8, at(1)), (2, 1, 6, 2, at(2))], str(tmp_path / "in"))
        table = RevisionTable(spark, str(tmp_path / "out"), user_state.FEATURES)
        stream = refresh.ingest(refresh.read(spark, str(tmp_path / "in"), refresh.INTERACTIONS), "36500 days")
        user_state.keep_state_features(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        assert [tuple(r)[:2] + (r.user_rating_count,) for r in table.latest("user_id").collect()] == [(1, 5, 2)]
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)


def test_a_task_gathers_its_batches_before_it_hands_on_rows():
    def batch(k):
        n = 40
        return pa.record_batch({
            "user_id": pa.array([i % 4 for i in range(n)]), "event_id": pa.array([k * n + i for i in range(n)]), "item_id": pa.array([None, 2] * 20, pa.int64()),
            "rating": pa.array([None, 7.0, 8.0, 9.0] * 10), "liked": pa.array([False, True] * 20), "us": pa.array([k * n + i for i in range(n)])})

    (part,) = user_state._partials(batch(k) for k in range(30))
    assert part.column("user_id").to_pylist() == [0, 1, 2, 3] and part.column("events").to_pylist() == [300] * 4
    assert part.column("rated").to_pylist() == [0, 300, 300, 300] and part.column("mean").to_pylist() == [0, 7, 8, 9]
    assert part.column("ids").to_pylist()[1] == [4 * i + 1 for i in range(300 - user_state.KEPT, 300)] and set(part.column("items").to_pylist()[0]) == {None}


def test_equal_times_go_by_id_and_none_comes_first():
    rows = np.array([(5, 2, 1, True, False, False), (5, 0, 3, True, True, False), (5, 1, 2, False, False, True), (4, 9, 4, True, False, False)], user_state._ROW)
    assert user_state.newest(rows)["item"].tolist() == [4, 3, 2, 1] and user_state.newest(rows, 2)["item"].tolist() == [2, 1]


def test_a_batch_opens_one_store_for_each_slot(spark, tmp_path):
    before = spark.conf.get(user_state._PARTITIONS)
    spark.conf.set(user_state._PARTITIONS, "24")
    try:
        write(spark, [(1, 1, 5, 8, at(1)), (2, 1, 6, 2, at(2)), (None, 1, None, 7, at(2))], str(tmp_path / "in"))
        table = RevisionTable(spark, str(tmp_path / "out"), user_state.FEATURES)
        stream = refresh.ingest(refresh.read(spark, str(tmp_path / "in"), refresh.INTERACTIONS), "36500 days")
        user_state.keep_state_features(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        assert [tuple(r)[:3] + (r.user_rating_count,) for r in table.latest("user_id").collect()] == [(1, None, 5, 3)]
        assert spark.conf.get(user_state._PARTITIONS) == "24"
        slots = spark.sparkContext.defaultParallelism
        assert f'"{user_state._PARTITIONS}":"{slots}"' in (tmp_path / "checkpoint" / "offsets" / "0").read_text()
    finally:
        spark.conf.set(user_state._PARTITIONS, before)
