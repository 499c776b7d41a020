"""Tables by key bucket, the text index over them, and sketches by day."""

import os

import pytest
from hypothesis import HealthCheck, given, settings as conf, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from affinis.operators import search
from affinis.operators.day_sketches import DaySketches
from affinis.operators import text_index
from affinis.operators.text_index import TextIndex
from affinis.sources import buckets
from affinis.sources.buckets import BucketTable

SCHEMA = "id long, name string, score double"


def table(spark, path, rows, buckets=8):
    t = BucketTable(spark, str(path), StructType.fromDDL(SCHEMA), buckets=buckets)
    t.create(spark.createDataFrame(rows, SCHEMA))
    return t


def files(path):
    return {os.path.join(top, f): os.stat(os.path.join(top, f)).st_mtime_ns for top, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_five_mixed_batches_rewrite_only_what_they_touch(spark, tmp_path):
    state = {i: (i, f"n{i}", i / 2) for i in range(200)}
    t = table(spark, tmp_path / "t", list(state.values()), 64)
    for k in range(5):
        ups = [(k * 7, f"up{k}", 1.0), (1000 + k, f"new{k}", None)]
        pat = [(k * 11 + 1, f"patched{k}", None), (5000, "unknown", 1.0)]
        gone = [(k * 13 + 2,), (6000,)]
        before = files(tmp_path / "t")
        touched = t.change(spark.createDataFrame(ups, SCHEMA), spark.createDataFrame(pat, SCHEMA), spark.createDataFrame(gone, "id long"))
        after = files(tmp_path / "t")
        changed = {os.path.dirname(p) for p in before.keys() ^ after.keys()}
        assert {int(p.rsplit("=", 1)[1]) for p in changed} == set(touched) and len(touched) <= 6
        # Files of other buckets are the same ones.
        assert all(after[p] == m for p, m in before.items() if os.path.dirname(p) not in changed)
        state |= {r[0]: r for r in ups}
        for i, name, _ in pat:
            if i in state:
                state[i] = (i, name, state[i][2])
        for (i,) in gone:
            state.pop(i, None)
        assert rows_of(t.read()) == sorted(state.values(), key=repr)


def test_buckets_may_become_empty_and_changes_may_be_none(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(1, "a", 1.0), (None, "b", 2.0)], 4)
    assert t.change() == []
    assert t.change(deletes=spark.createDataFrame([(1,)], "id long")) and rows_of(t.read()) == [(None, "b", 2.0)]
    assert t.change(upserts=spark.createDataFrame([], SCHEMA)) == []
    assert t.change(upserts=spark.createDataFrame([(1, "again", None)], SCHEMA)) and rows_of(t.read()) == [(1, "again", None), (None, "b", 2.0)]
    empty = table(spark, tmp_path / "e", [])
    assert empty.read().collect() == [] and empty.of_keys(spark.createDataFrame([(3,)], "id long")).collect() == []


def test_repeated_ids_fail_before_anything_is_written(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(1, "a", 1.0)])
    before = files(tmp_path / "t")
    with pytest.raises(Exception, match="several changes of one id"):
        t.change(spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], SCHEMA))
    assert files(tmp_path / "t") == before


def test_point_reads_open_few_row_groups(spark, tmp_path):
    """40 of 20,000 ids in 1000 buckets: the share of files, of one row group each, that the scan opens."""
    t = BucketTable(spark, str(tmp_path / "t"), StructType.fromDDL(SCHEMA), buckets=1000)
    t.create(spark.range(20_000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(1.0).alias("score")))
    asked = spark.range(0, 20_000, 500)
    assert t.of_keys(asked).count() == 40
    part = t.part(t.touched(asked))
    plan = part._jdf.queryExecution().executedPlan()
    assert plan.executeCollect() is not None
    opened = plan.collectLeaves().apply(0).metrics().apply("numFiles").value()
    assert 0 < opened <= 40 < 0.05 * len(files(tmp_path / "t"))


# Text index

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab c-刀剑"), max_size=12)), max_size=6)


def index(spark, path, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    found = TextIndex(spark, str(path), buckets=3)
    found.create(docs)
    return found, docs


def test_index_matches_as_the_scan_does(spark, tmp_path):
    texts = ["a b a b c", "ab c", None, "", "a-b", "b a", "刀剑神域 a", "a a b", "A B", "c ab ca", "--", "bc a bcc"]
    found, docs = index(spark, tmp_path / "i", texts)
    for keyword in ("a b", "a", "a a b", "刀剑", "刀", "b c", "", "--", "x", "a bc", "ab"):
        assert rows_of(found.matches(keyword)) == rows_of(search.matches(docs, keyword, "name").select("id", "match_at")), keyword


@conf(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS, TEXTS)
def test_index_after_changes(spark, tmp_path_factory, texts, changed):
    found, docs = index(spark, tmp_path_factory.mktemp("i"), texts)
    new = spark.createDataFrame(list(enumerate(changed)), "id long, name string")
    gone = spark.createDataFrame([(5,)], "id long")
    found.update(new.where("id <> 5"), gone)
    now = docs.join(new, "id", "left_anti").unionByName(new).where("id <> 5")
    for keyword in ("a", "a b", "刀"):
        assert rows_of(found.matches(keyword)) == rows_of(search.matches(now, keyword, "name").select("id", "match_at"))


def test_words_of_two_texts_never_meet(spark, tmp_path):
    docs = spark.createDataFrame([(1, "small x"), (1, "y ring")], "id long, name string")
    found = TextIndex(spark, str(tmp_path / "i"), buckets=2)
    found.create(docs)
    assert rows_of(found.matches("small ring")) == [] and rows_of(found.matches("small x")) == [(1, 1)]


def test_a_search_prunes_by_words(spark, tmp_path):
    found, _ = index(spark, tmp_path / "i", ["a b"])
    plan = found.hits(["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,b)" in plan and "EqualTo(token,a)" in plan


def test_tokens_are_not_moved_when_the_index_is_built(spark, tmp_path):
    texts = ["b a b", None, "", "刀 c 刀 c c", "b a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    made = text_index.postings(docs)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r.token, list(r.positions)) for r in made.collect())
    assert got == [(0, "a", [1]), (0, "b", [0, 2]), (3, "c", [1, 3, 4]), (3, "刀", [0, 2]), (4, "a", [1]), (4, "b", [0, 2])]
    # A document given twice matches once, and one task makes the rows of a bounded part of the texts.
    found = TextIndex(spark, str(tmp_path / "i"), buckets=2)
    found.create(docs.unionAll(docs))
    assert rows_of(found.matches("a b")) == [(0, 2), (4, 2)]


def test_sources_of_a_large_bucket_go_to_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "SOURCE_BYTES", 100)
    t = BucketTable(spark, str(tmp_path / "t"), StructType.fromDDL("id long, n int"), buckets=2)
    t.create_from(spark.range(200), lambda rows: rows.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")), F.lit(8))
    assert t.read().count() == 400 and len(t.of_keys(spark.createDataFrame([(7,)], "id long")).collect()) == 2
    assert t.read().where("n = 1").select("id").distinct().count() == 200
    assert len([f for f in t.read().inputFiles()]) >= 16


# Sketches by day

def test_merged_sketches_are_within_their_error(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).select(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 60_000).alias("ts"), "id")
    sketches = DaySketches(spark, str(tmp_path / "s"))
    for k in range(4):
        sketches.add(rows.where(F.col("id") % 4 == k), "ts", k)
    for share in (0.1, 0.5, 0.8):
        got = sketches.split_point(share).first()
        rank = (got.split_at - 1_700_000_000_000) / 60_000 / n
        assert got.n == n and abs(rank - share) < 0.02
    # A batch written again changes nothing, and a range of days counts its own rows.
    sketches.add(rows.where(F.col("id") % 4 == 0), "ts", 0)
    assert sketches.split_point(0.5).first().n == n
    day = rows.where(F.to_date("ts") == "2023-11-20").count()
    assert sketches.split_point(0.5, first="2023-11-20", last="2023-11-20").first().n == day == 1440


def test_no_times_no_point(spark, tmp_path):
    sketches = DaySketches(spark, str(tmp_path / "s"))
    sketches.add(spark.createDataFrame([(None,)], "ts timestamp"), "ts", 0)
    assert tuple(sketches.split_point(0.8).first()) == (None, 0, 0)
