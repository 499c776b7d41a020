import pytest
from pyspark.sql import functions as F

from affinis import schemas, session, settings
from affinis.operators import features
from affinis.sources import collections, embedding_text, index, keyvalue, samples_csv
from affinis.streaming.revisions import RevisionTable


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id long, name string, score double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_replaces_and_adds(spark, base):
    delta = spark.createDataFrame([(2, "B", None), (9, "new", 9.0)], "id long, name string, score double")
    assert rows(index.upsert(base, delta)) == [(1, "a", 1.0), (2, "B", None), (3, "c", 3.0), (9, "new", 9.0)]


def test_upsert_last_version_wins(spark, base):
    delta = spark.createDataFrame([(2, "old", 0.0, 1), (2, "new", 0.0, 2)], "id long, name string, score double, v int")
    assert (2, "new", 0.0) in rows(index.upsert(base, delta, version="v"))


def test_patch_keeps_other_fields(spark, base):
    delta = spark.createDataFrame([(2, "B"), (9, "x")], "id long, name string")
    assert rows(index.patch(base, delta)) == [(1, "a", 1.0), (2, "B", 2.0), (3, "c", 3.0)]


def test_patch_can_set_null(spark, base):
    delta = spark.createDataFrame([(2, None, True), (3, "z", False)], "id long, name string, has_name boolean")
    assert sorted(rows(index.patch(base, delta)), key=str) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)]


def test_delete_and_get(spark, base):
    ids = spark.createDataFrame([(2,), (77,)], "id long")
    assert rows(index.delete(base, ids)) == [(1, "a", 1.0), (3, "c", 3.0)]
    assert rows(index.get(base, ids)) == [(2, "b", 2.0)]


def test_find_one(base):
    assert collections.find_one(base, F.col("score") > 1.5).count() == 1
    assert collections.find_one(base, F.col("score") > 10).count() == 0


def test_scans_prune_and_rename(spark, tmp_path):
    path = str(tmp_path / "items")
    doc = (1, "n", [["a", "1"]], 1.0, 2, "N (2001)", (2, 1.0), {"k": "v"}, (1, "n"))
    spark.createDataFrame([doc], schemas.ITEM).write.json(path)
    got = collections.items(spark, path, "json")
    assert got.columns == ["item_id", "tags", "score", "votes", "release_year"]
    assert got.first()["tags"] == [["a", "1"]]
    path = str(tmp_path / "users")
    spark.createDataFrame([(1, [["1", "7", "t"]], [("x",)], (1, "u"))], schemas.USER_COLLECTION).write.parquet(path)
    got = collections.user_collections(spark, path)
    assert got.columns == ["user_id", "collects", "user_tags"]


def test_tag_vocabulary(spark):
    tags = spark.createDataFrame([("a", 2), ("b", 1), ("a", 5)], schemas.TAG)
    assert rows(collections.tag_vocabulary(tags)) == [("a",)]


def test_key_value_round_trip(spark, tmp_path):
    feats = spark.createDataFrame([(5, "a", "b", "", 3, 7.5)], schemas.ITEM_FEATURES)
    path = str(tmp_path / "kv")
    keyvalue.write(keyvalue.encode(feats, settings.ITEM_FEATURE_PREFIX, "item_id"), path)
    pairs = spark.read.schema(schemas.KEY_VALUE).parquet(path)
    assert pairs.first()["key"] == "animeF:5"
    asked = spark.createDataFrame([(5,), (6,)], "id long")
    got = keyvalue.decode_json(keyvalue.point_read(pairs, asked, settings.ITEM_FEATURE_PREFIX), schemas.ITEM_FEATURES)
    assert sorted(map(tuple, got.select("id", "item_id", "votes", "score").collect()), key=str) == [(5, 5, 3, 7.5), (6, None, None, None)]
    assert keyvalue.prefix_count(pairs, "userF:").first()["n"] == 0
    plan = keyvalue.prefix_scan(pairs, "animeF:")._jdf.queryExecution().toString()
    assert "StringStartsWith(key,animeF:)" in plan


def test_numbers_stored_as_text_are_read(spark):
    pairs = spark.createDataFrame([("userF:1", '{"user_id":"1","user_avg_rating":"7.50","user_rated_item_1":""}')], schemas.KEY_VALUE)
    got = keyvalue.decode_json(keyvalue.prefix_scan(pairs, "userF:"), schemas.USER_FEATURES).first()
    assert (got["id"], got["user_id"], got["user_avg_rating"], got["user_rated_item_1"]) == (1, 1, 7.5, None)


def test_tag_and_vector_values(spark):
    docs = spark.createDataFrame([(1, [["a", "1"], ["a", "2"]]), (2, None)], "id long, tags array<array<string>>")
    pairs = keyvalue.encode_tags(docs)
    assert rows(pairs) == [("tag:1", '{"a":2}')]
    assert keyvalue.decode_tags(pairs).first()["tags"] == {"a": 2}
    emb = spark.createDataFrame([(1, [0.5, -1.0])], schemas.EMBEDDING)
    stored = keyvalue.encode_vectors(emb, settings.USER_EMBEDDING_PREFIX)
    assert rows(stored) == [("userEmb:1", "0.5,-1.0")]
    assert keyvalue.decode_vectors(stored).first()["emb"] == [0.5, -1.0]


def test_embedding_files(spark, tmp_path):
    emb = spark.createDataFrame([(1, [0.5, -1.0]), (2, [1e-7, 3.0])], schemas.EMBEDDING)
    embedding_text.write(emb, str(tmp_path / "e"))
    assert rows(embedding_text.read(spark, str(tmp_path / "e"))) == rows(emb)


def test_csv_drops_malformed_rows_and_fills(spark, tmp_path):
    path = tmp_path / "s"
    path.mkdir()
    (path / "a.csv").write_text("user_id,rating\n1,5\n2,\nx,7\n3,1,9\n4,0\n")
    schema = type(schemas.TRAINING_SAMPLE)([f for f in schemas.TRAINING_SAMPLE.fields if f.name in ("user_id", "rating")])
    assert rows(samples_csv.read(spark, str(path), schema)) == [(1, 5), (2, 0), (4, 0)]


def test_export_formats_text(spark):
    df = spark.createDataFrame([(1, 7.456, 0.0)], "user_id long, user_avg_rating double, user_rating_stddev double")
    assert tuple(features.for_export(df).first()) == (1, "7.46", "0.00")


def test_revision_table(spark, tmp_path):
    table = RevisionTable(spark, str(tmp_path / "r"), "k long, v long")

    def put(values, batch):
        table.write(spark.createDataFrame(values, "k long, v long"), batch)

    put([(1, 1), (2, 1)], 0)
    put([(1, 2), (1, 3)], 1)
    put([(1, 2), (1, 3)], 1)
    assert rows(table.latest_lists("k")) == [(1, 2), (1, 3), (2, 1)]
    assert table.latest("k").count() == 2
    assert rows(table.upto(0).drop("batch_id")) == [(1, 1), (2, 1)]
    assert rows(table.compact("k", str(tmp_path / "c")).all().drop("batch_id")) == [(1, 2), (1, 3), (2, 1)]


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_upsert_refuses_repeated_ids_without_an_order(spark, base):
    delta = spark.createDataFrame([(2, "x", 1.0), (2, "y", 2.0)], base.schema)
    with pytest.raises(Exception, match="several changes of one id"):
        index.upsert(base, delta).collect()


def test_every_patch_of_a_batch_applies(spark, base):
    delta = spark.createDataFrame(
        [(2, None, 9.0, 1), (2, "late", None, 2), (3, "a", 1.0, 5), (3, "b", None, 4), (8, "no", 1.0, 1)], "id long, name string, score double, v int")
    assert (2, "late", 9.0) in rows(index.patch(base, delta, version="v"))
    assert (3, "a", 1.0) in rows(index.patch(base, delta, version="v"))
    assert len(rows(index.patch(base, delta, version="v"))) == 3
