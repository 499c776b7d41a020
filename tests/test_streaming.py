from pyspark.sql import functions as F

from affinis.streaming import refresh
from affinis.streaming.revisions import RevisionTable
from workload import tables as t


def write_files(spark, folder, path, parts=3, replay=True):
    events = t.interactions(spark, folder)
    bounds = [r[0] for r in events.selectExpr(f"percentile(event_id, array(0.33, 0.66))").collect()][0]
    cuts = [events.where(F.col("event_id") <= bounds[0]),
            events.where((F.col("event_id") > bounds[0]) & (F.col("event_id") <= bounds[1])),
            events.where(F.col("event_id") > bounds[1])]
    for i, part in enumerate(cuts):
        part.repartition(1).write.mode("append").parquet(f"{path}/{i}")
    if replay:
        cuts[2].limit(50).repartition(1).write.mode("append").parquet(f"{path}/3")
    return events


def source(spark, path):
    raw = refresh.read(spark, f"{path}/*", refresh.INTERACTIONS, maxFilesPerTrigger=1)
    return refresh.ingest(raw, "365 days")


def test_running_features_equal_batch_and_ignore_replays(spark, folder, tmp_path):
    src = str(tmp_path / "in")
    events = write_files(spark, folder, src)
    table = RevisionTable(spark, str(tmp_path / "out"), refresh.RUNNING_FEATURES)
    refresh.keep_running_features(source(spark, src), table, str(tmp_path / "cp")).awaitTermination()

    def rounded(df):
        return sorted(
            (r["user_id"], r["user_rating_count"], round(r["user_avg_rating"], 6), round(r["user_rating_stddev"], 6), r["last_ts"])
            for r in df.collect()
        )

    assert rounded(table.latest("user_id")) == rounded(refresh.running_features(events))
    assert table.all().select("batch_id").distinct().count() > 1


def test_touched_users_are_recomputed(spark, folder, tmp_path):
    src = str(tmp_path / "in")
    events = write_files(spark, folder, src)
    kept = RevisionTable(spark, str(tmp_path / "kept"), refresh.INTERACTIONS, key="user_id", buckets=4)
    schema = ("user_id long, " + ", ".join(f"user_rated_item_{i} long" for i in range(1, 6))
              + ", user_rating_count long, user_avg_rating double, user_rating_stddev double")
    results = RevisionTable(spark, str(tmp_path / "res"), schema)
    refresh.keep_refreshed(
        source(spark, src), kept, results, lambda every, touched: refresh.touched_features(every, touched), str(tmp_path / "cp")
    ).awaitTermination()
    want = refresh.touched_features(events, events)
    cols = results.latest("user_id").columns

    def rounded(df):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())

    assert rounded(results.latest("user_id")) == rounded(want)
    assert kept.all().count() == events.count()
    one = events.where("user_id = 1").select("user_id")
    own = kept.of_keys(one, 10**6)
    assert own.count() == one.count()


def test_rows_beyond_the_delay_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")

    def put(i, rows):
        spark.createDataFrame(rows, "event_id long, user_id long, item_id long, rating int, s long").withColumn(
            "ts", F.timestamp_seconds("s")).drop("s").repartition(1).write.parquet(f"{src}/{i}")

    table = RevisionTable(spark, str(tmp_path / "out"), refresh.RUNNING_FEATURES)

    def run():
        raw = refresh.read(spark, f"{src}/*", refresh.INTERACTIONS)
        refresh.keep_running_features(refresh.ingest(raw, "1 hour"), table, str(tmp_path / "cp")).awaitTermination()

    put(0, [(1, 1, 1, 5, 100_000)])
    run()
    put(1, [(2, 1, 1, 5, 200_000)])
    run()
    put(2, [(3, 1, 1, 5, 150_000), (4, 1, 1, 5, 199_000)])
    run()
    assert table.latest("user_id").first()["user_rating_count"] == 3


def test_refreshed_lists_read_stored_vectors_items_and_documents(spark, folder, monkeypatch):
    from workload import queries

    given, lists = [], queries.rec.recommend_lists
    monkeypatch.setattr(queries.rec, "recommend_lists", lambda users, model, **k: given.append(k) or lists(users, model, **k))
    queries.QUERIES["stream_refresh"](spark, folder)
    assert len(given) == 3
    for frames in given:
        for name in ("user_emb", "item_emb", "documents", "collected"):
            assert all("/settled-" in f for f in frames[name].inputFiles()), name
    # What does not change is stored once, not for every batch.
    for name in ("item_emb", "documents"):
        assert len({f for frames in given for f in frames[name].inputFiles()}) == len(given[0][name].inputFiles())
