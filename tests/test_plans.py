import math

from affinis import schemas, settings
from affinis.plans import embeddings as emb_plan, features as feature_plan, recommend as rec
from affinis.sources import collections, embedding_text, keyvalue, samples_csv
from workload import tables as t


def test_feature_job_writes_samples_and_stores(spark, folder, tmp_path):
    inter = t.interactions(spark, folder)
    items = collections.item_columns(t.items(spark, folder))
    tables = feature_plan.feature_tables(inter, items, split_error=0.0)
    assert tables.train.count() + tables.test.count() == tables.samples.count()
    feature_plan.write(tables, str(tmp_path))
    stored = spark.read.schema(schemas.KEY_VALUE).parquet(str(tmp_path / "userFeatures"))
    assert keyvalue.prefix_count(stored, settings.USER_FEATURE_PREFIX).first()["n"] == tables.user_features.count()
    header = spark.read.option("header", True).csv(str(tmp_path / "trainSample"))
    assert {"user_id", "item_id", "label", "user_avg_rating", "item_tag_1"} <= set(header.columns)
    assert header.count() == tables.train.count()
    schema = type(schemas.TRAINING_SAMPLE)([schemas.TRAINING_SAMPLE[c] if c in schemas.TRAINING_SAMPLE.names
                                            else header.schema[c] for c in header.columns])
    back = samples_csv.read(spark, str(tmp_path / "trainSample"), schema)
    assert back.count() == tables.train.count()


def test_vector_job_feeds_recommendations(spark, folder, tmp_path):
    inter = t.interactions(spark, folder)
    tables = emb_plan.embedding_tables(inter, iterations=1, size=8)
    assert tables.buckets.count() == tables.item_emb.count()
    emb_plan.write(tables, str(tmp_path))
    back = {r["id"]: r["emb"] for r in embedding_text.read(spark, str(tmp_path / "userEmb")).collect()}
    want = {r["id"]: r["emb"] for r in tables.user_emb.collect()}
    assert back.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-12) for k in want for a, b in zip(want[k], back[k]))
    page = rec.recommend(
        t.all_users(spark, folder), "emb", 0, 5, user_emb=tables.user_emb, item_emb=tables.item_emb,
        collected=inter, documents=t.items(spark, folder),
    )
    known = t.all_users(spark, folder).count()
    assert page.select("user_id").distinct().count() == known
