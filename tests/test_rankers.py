import math

import pytest
from pyspark.sql import functions as F

from affinis.operators import embeddings, encoders, features, rankers, samples
from affinis.plans import features as plan
from affinis.session import settled
from affinis.sources import collections
from workload import tables as t


@pytest.fixture(scope="module")
def frames(spark, folder):
    inter = t.interactions(spark, folder)
    rows = settled(plan.training_samples(inter, collections.item_columns(t.items(spark, folder))))
    train, test = samples.split_by_time(rows, error=0.0)
    emb = settled(t.item_emb(spark, folder))
    users = settled(embeddings.user_vectors(inter, emb))
    sizes = dict(size=64, user_buckets=100, item_buckets=300)
    ready = [settled(encoders.with_model_inputs(f, users, emb, **sizes)) for f in (train, test)]
    return ready, users, emb, rows


def in_range(df):
    return all(0 <= r["score"] <= 1 for r in df.collect())


def test_encoders(spark):
    vocabulary = spark.createDataFrame([("a",), ("b",)], "name string")
    df = spark.createDataFrame([("a", "zz"), ("b", None)], "item_tag_1 string, item_tag_2 string")
    got = encoders.tag_encoder(vocabulary, ["item_tag_1", "item_tag_2"]).transform(df).collect()
    assert [r["item_tag_1_hot"].toArray().tolist() for r in got] == [[1, 0], [0, 1]]
    assert [r["item_tag_2_hot"].toArray().tolist() for r in got] == [[0, 0], [0, 0]]
    ids = spark.createDataFrame([(0,), (2,), (10**12,), (-1,), (None,)], "id long").select(encoders.in_buckets(F.col("id"), 3).alias("id"))
    hot = encoders.bucket_encoder(spark, {"id": 3}).transform(ids).collect()
    got = [r["id_hot"].toArray().tolist() for r in hot]
    assert got[:2] == [[1, 0, 0], [0, 0, 1]] and got[4] == [0, 0, 0]
    assert all(sum(x) == 1 for x in got[:4])  # no id is lost, whatever its size


def test_cross_bucket_range(spark):
    df = spark.range(500).select(F.col("id").alias("item_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("user_rated_item_1"))
    got = [r[0] for r in df.select(encoders.cross_bucket()).collect()]
    assert min(got) >= 0 and max(got) < 10000 and len(set(got)) > 400


def test_wide_and_deep_saves_and_recommends(spark, folder, frames, tmp_path):
    (train, test), users, emb, rows = frames
    model, metrics = rankers.fit_and_evaluate(rankers.wide_and_deep(spark, size=64), train, test)
    m = metrics.first()
    assert m["loss"] > 0 and 0 <= m["accuracy"] <= 1 and 0 <= m["roc_auc"] <= 1 and 0 <= m["pr_auc"] <= 1
    path = rankers.save(model, str(tmp_path))
    assert path.endswith("/001")
    a = {r["event_id"]: r["score"] for r in rankers.predict(model, test, ["event_id"]).collect()}
    b = {r["event_id"]: r["score"] for r in rankers.predict(rankers.load(path), test, ["event_id"]).collect()}
    assert a == b
    scorer = rankers.scorer(
        model, features.latest_item_features(rows), features.latest_user_features(rows), users, emb,
        size=64, user_buckets=100, item_buckets=300,
    )
    asked = users.select(F.col("id").alias("user_id")).crossJoin(emb.select(F.col("id").alias("item_id")))
    got = scorer(asked.withColumns({"rank": F.lit(1), "score": F.lit(0.0)}))
    known = features.latest_item_features(rows).count()
    assert got.count() == known * users.count() and in_range(got)


def test_other_rankers_predict_probabilities(spark, frames):
    (train, test), users, emb, _ = frames
    vocabulary = spark.createDataFrame([("ECONOMY",), ("click",)], "name string")
    for pipeline in (
        rankers.embedding_mlp(size=64, iterations=2),
        rankers.neural_cf(size=64, iterations=2),
        rankers.deep_fm(vocabulary, 100, 300, size=64, iterations=2),
    ):
        got = rankers.predict(rankers.fit(pipeline, train), test)
        assert got.count() == test.count() and in_range(got)
        assert {r["actual"] for r in rankers.shown(got).collect()} <= {"Good Rating", "Bad Rating"}


def test_two_tower_scores_pairs(frames):
    (train, test), *_ = frames
    model = rankers.two_tower(train, rank=4, iterations=2)
    got = model.score(test.select("user_id", "item_id"))
    assert got.count() == test.count()


def test_two_tower_takes_ids_of_any_size(spark):
    rows = [(10**15 + u, -(10**12) + i, int(u % 2 == i % 2)) for u in range(6) for i in range(8)]
    train = spark.createDataFrame(rows, "user_id long, item_id long, label int")
    asked = spark.createDataFrame([(10**15, -(10**12)), (10**15, -(10**12) + 1), (5, 5)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id): r.prediction for r in rankers.two_tower(train, rank=2).score(asked).collect()}
    assert got[10**15, -(10**12)] > got[10**15, -(10**12) + 1] and got[5, 5] is None


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "label int, score double")
    m = rankers.evaluate(df).first()
    assert m["loss"] == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(0.4) + math.log(0.4)) / 4)
    assert m["accuracy"] == 0.5
    assert m["roc_auc"] == pytest.approx(0.75)


def test_item2vec_and_buckets(spark, folder):
    sequences = embeddings.item_sequences(t.interactions(spark, folder))
    vec = embeddings.item_vectors(embeddings.train_item2vec(sequences, size=8, iterations=1))
    rows = vec.collect()
    assert rows and all(len(r["emb"]) == 8 and all(map(math.isfinite, r["emb"])) for r in rows)
    model = embeddings.fit_buckets(vec)
    assert all(len(r["buckets"]) == 3 for r in embeddings.bucket(model, vec).collect())


def test_nearest_finds_the_vector_itself(spark, folder):
    from pyspark.ml.linalg import Vectors

    emb = t.item_emb(spark, folder)
    key = Vectors.dense(emb.where("id = 3").first()["emb"])
    got = embeddings.nearest(embeddings.fit_buckets(emb, 2.0), emb, key).collect()
    assert got[0]["id"] == 3 and len(got) == 5


def test_user_vectors_count_items_without_a_vector(spark):
    inter = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (2, 9), (3, 2)], "user_id long, item_id long")
    emb = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 5.0])], "id long, emb array<double>")
    got = {r["id"]: r["emb"] for r in embeddings.user_vectors(inter, emb).collect()}
    assert got == {1: [2.0, 0.0], 3: [0.0, 5.0]}
    weighted = embeddings.user_vectors(inter, emb, F.when(F.col("item_id") == 9, 2.0).otherwise(1.0))
    assert {r["id"]: r["emb"] for r in weighted.collect()}[1] == [1.5, 0.0]


def test_categories_are_those_of_the_ids_trained_on(spark):
    rows = spark.createDataFrame([(7_000_000, 5, 1), (7_000_000, 9, 0), (-3, 9, 1)], "user_id long, item_id long, label int")
    places = rankers.id_places(rows)
    assert places.sizes == {"user_buckets": 2, "item_buckets": 2}
    asked = spark.createDataFrame([(-3, 5), (7_000_000, 9), (4, 9), (None, 6)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): (r["user_bucket"], r["item_bucket"]) for r in places.encode(asked).collect()}
    # The category past the last one stands for none.
    assert got == {(-3, 5): (0.0, 0.0), (7_000_000, 9): (1.0, 1.0), (4, 9): (2.0, 1.0), (None, 6): (2.0, 2.0)}
    few = rankers.id_places(rows, user_buckets=1)
    assert few.sizes["user_buckets"] == 1 and {r["user_bucket"] for r in few.encode(rows).collect()} == {0.0}
    assert rankers.id_places(rows.where("false")).sizes == {"user_buckets": 1, "item_buckets": 1}


def test_deepfm_holds_weights_of_trained_ids_only(spark, folder, monkeypatch):
    from workload import queries

    widths, fm = [], rankers.deep_fm
    monkeypatch.setattr(rankers, "deep_fm", lambda vocabulary, **sizes: widths.append(sizes) or fm(vocabulary, iterations=1, **sizes))
    assert queries.QUERIES["deepfm"](spark, folder).where("in_range").count() > 0
    events = queries.t.interactions(spark, folder)
    assert widths[0]["user_buckets"] <= events.select("user_id").distinct().count() < queries.t.all_users(spark, folder).count()
    assert widths[0]["item_buckets"] <= events.select("item_id").distinct().count()


def test_shards_fill_the_slots_while_they_stay_large():
    assert [embeddings.shards(n, 12) for n in (0, 9_000, 15_000, 90_000, 540_000)] == [1, 1, 3, 12, 36]
    assert embeddings.shards(90_000) == 5


def test_vectors_are_converted_once_a_user_or_item(spark):
    rows = spark.createDataFrame([(u, i, 1) for u in range(3) for i in range(3)], "user_id long, item_id long, user_rated_item_1 long")
    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "id long, emb array<double>")
    got = encoders.with_model_inputs(rows, emb, emb, size=2)
    for r in got.collect():
        assert r["user_vector"].toArray().tolist() == ([1.0, 2.0] if r["user_id"] == 0 else [0.0, 0.0])
        assert r["item_vector"].toArray().tolist() == ([1.0, 2.0] if r["item_id"] == 0 else [0.0, 0.0])
    joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    # Above the joins only the zeros for a missing vector are left.
    assert "_emb" not in joined[0] and "emb#" not in joined[0] and joined[1].count("coalesce(emb#") == 2


def test_split_reads_no_text_for_times(spark):
    rows = spark.range(200).select("id", F.timestamp_micros(F.col("id") * 40_000_000_000 - 10**12).alias("ts"))
    by_time = samples.split_by_time(rows, error=0.0)
    by_text = samples.split_by_time(rows.withColumn("ts", F.col("ts").cast("string")), error=0.0)
    assert [[r["id"] for r in f.orderBy("id").collect()] for f in by_time] == [[r["id"] for r in f.orderBy("id").collect()] for f in by_text]
    assert "try_to_timestamp" not in by_time[0]._jdf.queryExecution().analyzed().toString()
    assert "gettimestamp" not in by_time[0]._jdf.queryExecution().optimizedPlan().toString().lower()


def test_only_items_with_a_vector_reach_the_wide_sums(spark):
    inter = spark.createDataFrame([(None, 1, 2.0), (1, 1, 1.0), (1, None, 3.0), (1, 9, 4.0), (2, 9, 1.0)], "user_id long, item_id long, w double")
    emb = spark.createDataFrame([(1, [8.0, 0.0]), (9, None)], "id long, emb array<double>")
    found = embeddings.user_vectors(inter, emb, F.col("w"))
    assert {r["id"]: r["emb"] for r in found.collect()} == {None: [8.0, 0.0], 1: [1.0, 0.0]}
    # Every pair of user and item went into them by an outer join.
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert embeddings.user_vectors(inter, emb.where("id = 9"), F.col("w")).count() == 0


def test_every_tag_trained_on_gets_a_vector(spark):
    """Also one that comes in a single distinct list, whatever the number of its samples."""
    tags = [("common", "a", ""), ("common", "b", ""), ("alone", "c", "")]
    train = spark.createDataFrame([(list(x), ["u", "v", "", "", ""]) for x in tags * 5], "item_tags array<string>, user_tags array<string>")
    stages = rankers.wide_and_deep(spark, size=4).getStages()
    (item_stage, _) = [s for s in stages if isinstance(s, rankers.Word2Vec)]
    model = rankers.fit(rankers.Pipeline(stages=[item_stage]), train)
    assert {r["word"] for r in model.stages[0].getVectors().collect()} == {"common", "alone", "a", "b", "c", ""}


def test_candidates_with_large_ids_are_scored_too(spark):
    from affinis.operators import payload

    asked = spark.createDataFrame([(1, 10**9), (1, 5), (1, 6)], "user_id long, item_id long")
    known = spark.createDataFrame([(10**9,), (5,)], "item_id long")
    ids = lambda df: sorted(r["item_id"] for r in df.collect())
    assert ids(payload.eligible(asked, known)) == [5] and ids(payload.eligible(asked, known, None)) == [5, 10**9]


def test_recommend_wide_deep_leaves_no_candidate_out_for_its_id(spark, folder, monkeypatch):
    from workload import queries

    asked = []
    monkeypatch.setattr(queries, "_model_frames", lambda *_: ((None, None), None, None, None))
    monkeypatch.setattr(queries, "_id_ranges", lambda *_: {})
    for module, name in ((queries.rankers, "fit"), (queries.rankers, "wide_and_deep"), (queries.features, "latest_item_features"),
                         (queries.features, "latest_user_features"), (queries.rec, "recommend")):
        monkeypatch.setattr(module, name, lambda *a, **b: None)
    monkeypatch.setattr(queries.rankers, "scorer", lambda *a, **b: asked.append(b))
    queries.QUERIES["recommend_wide_deep"](spark, folder)
    assert asked == [{"id_bound": None}]
