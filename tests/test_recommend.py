import datetime as dt

import pytest
from pyspark.sql import functions as F

from affinis import settings
from affinis.operators import lists, payload, search
from affinis.plans import recommend as rec
from affinis.sources import collections

NOW = dt.datetime(2024, 1, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def world(spark):
    docs = spark.createDataFrame(
        [(i, (i % 4, float(i)), (i, f"item {i}")) for i in range(12)],
        "id long, rating struct<total:long, score:double>, api struct<id:long, name_cn:string>",
    )
    item_emb = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "id long, emb array<double>")
    user_emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, emb array<double>")
    collected = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 9)], "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    return dict(documents=docs, item_emb=item_emb, user_emb=user_emb, collected=collected), users


def by_user(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["user_id"], r["rank"])):
        out.setdefault(r["user_id"], []).append(r["item_id"])
    return out


POPULAR = [11, 7, 3, 10, 6, 2, 9, 5, 1, 8, 4, 0]


def test_warm_and_cold_users(world):
    inputs, users = world
    got = by_user(rec.recommend_lists(users, "emb", **inputs))
    assert got == {1: [2, 3, 4, 5, 6, 7, 8, 9], 2: [8, 7, 6, 5, 4, 3, 2, 1, 0], 3: POPULAR}


def test_recommended_and_collected_are_disjoint(world):
    inputs, users = world
    own = rec.recommend_lists(users, "emb", **inputs).where("source = 'scored'")
    assert own.join(inputs["collected"], ["user_id", "item_id"]).count() == 0


def test_pages_put_together_are_the_list(world):
    inputs, users = world
    whole = by_user(rec.recommend_lists(users, "emb", **inputs))
    seen = {}
    for start in range(0, 20, 5):
        page = rec.recommend(users, "emb", start, 5, **inputs)
        for r in page.collect():
            assert r["total"] == len(whole[r["user_id"]])
            assert r["has_more"] == (start + 5 < r["total"])
        for u, items in by_user(page).items():
            seen.setdefault(u, []).extend(items)
    assert seen == whole
    assert rec.recommend(users, "emb", 50, 5, **inputs).count() == 0


def test_catalogue_limits_candidates(spark, world):
    inputs, users = world
    only = spark.createDataFrame([(4,), (5,), (99,)], "item_id long")
    got = by_user(rec.recommend_lists(users, "emb", catalogue=only, **inputs))
    assert got[1] == [4, 5]


def test_rank_models(world):
    inputs, users = world

    def scorer(candidates):
        # Knows nothing of user 2 and leaves out odd items.
        return candidates.where("user_id = 1 and item_id % 2 = 0").withColumn("score", F.col("item_id") / 10)

    scorers = {"mine": scorer}
    got = by_user(rec.recommend_lists(users, "mine", scorers=scorers, **inputs))
    assert got[1] == [8, 6, 4, 2]
    assert got[2] == [8, 7, 6, 5, 4, 3, 2, 1, 0]
    assert got[3] == POPULAR
    assert by_user(rec.recommend_lists(users, "other", scorers=scorers, **inputs))[1] == [2, 3, 4, 5, 6, 7, 8, 9]
    assert by_user(rec.recommend_lists(users, "mine", scorers=scorers, recall_size=3, **inputs))[1] == [4, 2]


def test_stored_lists_are_served_while_fresh(spark, world):
    inputs, users = world
    stored = spark.createDataFrame(
        [
            (1, 42, 1.0, 1, "emb", NOW - dt.timedelta(seconds=299)),
            (2, 43, 1.0, 1, "emb", NOW - dt.timedelta(seconds=300)),
            (3, 44, 1.0, 1, "other", NOW),
        ],
        "user_id long, item_id long, score double, rank int, model string, computed_at timestamp",
    )
    got = by_user(rec.recommend_lists(users, "emb", stored=stored, as_of=F.lit(NOW), **inputs))
    assert got[1] == [42] and got[2][0] == 8 and got[3] == POPULAR


def test_similar_lists(world):
    inputs, _ = world
    rows = rec.similar_items(inputs["item_emb"]).where("id = 0").orderBy("rank").collect()
    assert [r["similar_id"] for r in rows] == list(range(1, 10))
    assert rec.similar_users(inputs["user_emb"]).count() == 2


def test_list_helpers(spark):
    rows = spark.createDataFrame([(1, r, r * 10) for r in range(1, 8)] + [(2, 1, 5)], "user_id long, rank int, item_id long")
    assert lists.cap(rows, 3).count() == 4
    page = lists.page(rows, "user_id", 5, 5).orderBy("rank").collect()
    assert [(r["rank"], r["has_more"]) for r in page] == [(6, False), (7, False)]
    assert lists.page_or_all(rows, "user_id", 2, 3).count() == 3 + 1
    stored = lists.to_text(rows, "user_id", settings.USER_RECS_PREFIX)
    assert {r["key"]: r["value"] for r in stored.collect()} == {"userRec:1": "10,20,30,40,50,60,70", "userRec:2": "5"}
    back = lists.from_text(stored, settings.USER_RECS_PREFIX, "user_id")
    assert sorted(map(tuple, back.collect())) == sorted((u, r, i) for u, r, i in map(tuple, rows.collect()))
    assert [r["item_id"] for r in lists.one_page(rows.orderBy("user_id", "rank"), 2, 2).collect()] == [30, 40]


def test_documents_of_a_page(spark, world):
    inputs, _ = world
    rows = spark.createDataFrame([(3, 1), (50, 2)], "item_id long, rank int")
    got = lists.with_documents(rows, inputs["documents"]).orderBy("rank").select("rank", "api.name_cn").collect()
    assert [tuple(r) for r in got] == [(1, "item 3"), (2, None)]


def test_popular_is_ordered_and_bounded(world):
    inputs, _ = world
    assert [r["id"] for r in search.popular(inputs["documents"]).collect()] == POPULAR
    assert [r["id"] for r in search.popular(inputs["documents"], 2).collect()] == [11, 7]


def test_search_and_suggest(world):
    inputs, _ = world
    assert [r["id"] for r in search.search_items(inputs["documents"], "ITEM 1").collect()] == [11, 10, 1]
    assert [r["name"] for r in search.suggest(inputs["documents"], "item 1").collect()] == ["item 11", "item 10", "item 1"]
    assert search.suggest(inputs["documents"], "it").count() == 10


def test_details_of_unknown_ids(spark):
    docs = spark.createDataFrame([(1, {"b": "2", "a": "1"})], "id long, info map<string,string>")
    got = collections.item_details(docs, spark.createDataFrame([(1,), (2,)], "id long")).orderBy("id").collect()
    assert [(r["id"], r["found"], r["info"]) for r in got] == [(1, True, [["a", "1"], ["b", "2"]]), (2, False, None)]


def test_payload_and_answers(spark):
    rows = spark.createDataFrame([(1, 7, 2, 0.5), (1, 8, 1, 0.25)], "user_id long, item_id long, rank int, votes double")
    sent = payload.score_payload(rows, ["votes"]).first()["payload"]
    assert sent == '{"instances":[{"user_id":1,"item_id":8,"votes":0.25},{"user_id":1,"item_id":7,"votes":0.5}]}'
    answers = spark.createDataFrame([(1, '{"predictions": [[0.9], [0.1]]}')], "user_id long, answer string")
    asked = rows.withColumn("position", F.col("rank") - 1)
    got = {r["item_id"]: r["score"] for r in payload.parse_scores(answers, asked).collect()}
    assert got == {8: 0.9, 7: 0.1}


def test_eligible_items(spark):
    feats = spark.createDataFrame([(1, "a"), (400000, "b")], "item_id long, item_tag_1 string")
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 400000)], "user_id long, item_id long")
    assert [r["item_id"] for r in payload.eligible(asked, feats).collect()] == [1]
