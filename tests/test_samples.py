import random
import statistics

import pytest
from pyspark.sql import functions as F

from affinis import settings
from affinis.operators import embeddings, features, history, pieces, samples
from affinis.plans import features as plan

SCHEMA = "event_id long, user_id long, item_id long, rating int, ts timestamp"


def skewed(n=1500, seed=1):
    """One user has a third of the rows; times tie often, ratings may be null."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if r.random() < 0.34 else r.randrange(1, 60)
        rating = None if r.random() < 0.05 else r.randrange(0, 11)
        rows.append((i, user, r.randrange(0, 40), rating, r.randrange(0, n // 6)))
    return rows


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, rating int, s long")
    return raw.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def brute(rows, reach=100):
    """History and running figures in plain Python."""
    by_user = {}
    for row in sorted(rows, key=lambda x: (x[1], x[4], x[0])):
        by_user.setdefault(row[1], []).append(row)
    out = {}
    for mine in by_user.values():
        for at, (event, _, _, _, ts) in enumerate(mine):
            before = mine[max(0, at - reach):at]
            liked = [i for _, _, i, r, _ in before if r is not None and (r >= 6 or r == 0)][::-1]
            upto = [r for _, _, _, r, t in mine if t <= ts]
            known = [r for r in upto if r is not None]
            mean = statistics.fmean(known) if known else 0.0
            dev = statistics.stdev(known) if len(known) > 1 else 0.0
            out[event] = (liked, len(upto), round(mean, 6), round(dev, 6))
    return out


def test_label_rules(spark):
    df = spark.createDataFrame([(6,), (5,), (0,), (None,), (10,)], "rating int")
    assert [r["label"] for r in samples.add_label(df).collect()] == [1, 0, 1, 0, 1]


def test_explode_decodes_text_and_drops_empty_lists(spark):
    docs = spark.createDataFrame(
        [(1, [["7", "9", "2020-01-01"], ["8", "x", "2020-01-02"]], [("a",), ("b",)]), (2, [], [("c",)])],
        "user_id long, collects array<array<string>>, user_tags array<struct<name:string>>",
    )
    got = [tuple(r) for r in samples.explode_collects(docs).select("user_id", "item_id", "rating", "user_tag_1", "user_tag_3").collect()]
    assert got == [(1, 7, 9, "a", None), (1, 8, None, "a", None)]
    labels = [r["label"] for r in samples.add_label(samples.explode_collects(docs)).collect()]
    assert labels == [1, 0]


@pytest.mark.parametrize("hot_rows", [10**9, 100, 0])
def test_user_features_match_brute_force(spark, hot_rows):
    """In one piece, with the hot user in pieces, and with everybody in pieces."""
    rows = skewed()
    df = samples.add_label(frame(spark, rows))
    want = brute(rows)
    sizes = dict(hot_rows=hot_rows, piece_rows=60)
    got = {r["event_id"]: r for r in history.add_user_features(df, **sizes).collect()}
    assert set(got) == {e for e, w in want.items() if w[1] > 1}
    for event, row in got.items():
        liked, n, mean, dev = want[event]
        shown = [row[f"user_rated_item_{i}"] for i in range(1, 6)]
        assert shown == (liked + [None] * 5)[:5]
        assert row["user_rating_count"] == n
        assert row["user_avg_rating"] == pytest.approx(mean, abs=1e-6)
        assert row["user_rating_stddev"] == pytest.approx(dev, abs=1e-6)
    lists = history.add_positive_history(df, **sizes).collect()
    assert len(lists) == len(rows)
    assert {r["event_id"]: r["positive_history"] for r in lists} == {e: w[0] for e, w in want.items()}


@pytest.mark.parametrize("piece_rows", [7, 60, 400])
def test_short_pieces_reach_back_over_several(spark, piece_rows):
    rows = skewed(300)
    df = samples.add_label(frame(spark, rows))
    got = history.add_positive_history(df, hot_rows=0, piece_rows=piece_rows).collect()
    assert {r["event_id"]: r["positive_history"] for r in got} == {e: w[0] for e, w in brute(rows).items()}


def test_other_windows_in_pieces_equal_plain_ones(spark):
    df = samples.add_label(frame(spark, skewed())).withColumns({
        "release_year": (F.lit(1990) + F.col("item_id")).cast("int"),
        "tags": F.array(F.concat(F.lit("t"), F.col("item_id") % 5), F.concat(F.lit("u"), F.col("item_id") % 3)),
    })
    for add in (history.add_release_year_stats, history.add_favourite_tags, history.add_running_stats):
        def result(**sizes):
            rows = add(df, **sizes).drop("rating", "ts", "tags").collect()
            return sorted(
                (tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows), key=lambda r: int(r[0])
            )

        assert result() == result(hot_rows=50, piece_rows=80), add.__name__


def test_hot_keys_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    df = samples.add_label(frame(spark, skewed()))
    plain = sorted(map(repr, history.add_running_stats(df).select("event_id", "user_rating_count").collect()))
    monkeypatch.setattr(settings, "BROADCAST_ROWS", 0)
    cold, hot = pieces.split_hot(df, "user_id", 1)
    for part in (cold, hot):
        assert "ResolvedHint" not in part._jdf.queryExecution().analyzed().toString()
    assert cold.count() + hot.count() == df.count()
    assert sorted(map(repr, history.add_running_stats(df, hot_rows=1, piece_rows=80).select("event_id", "user_rating_count").collect())) == plain


@pytest.mark.parametrize("hot_rows", [10**9, 100, 0])
def test_row_numbers_and_sequences(spark, hot_rows):
    rows = skewed()
    df = frame(spark, rows)
    numbered = pieces.row_numbers(df, "user_id", ["ts", "event_id"], "n", hot_rows, 90).collect()
    seen = {}
    for row in sorted(numbered, key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        seen[row["user_id"]] = seen.get(row["user_id"], 0) + 1
        assert row["n"] == seen[row["user_id"]]
    parts = embeddings.item_sequences(df, length=50, hot_rows=hot_rows, piece_rows=90).collect()
    assert max(len(p["items"]) for p in parts) == 50
    whole = {}
    for p in sorted(parts, key=lambda p: (p["user_id"], p["segment"])):
        whole.setdefault(p["user_id"], []).extend(p["items"])
    want = {}
    for e, u, i, _, s in sorted(rows, key=lambda x: (x[4], x[0]), reverse=True):
        want.setdefault(u, []).append(str(i))
    assert whole == want


def test_single_interaction_has_no_deviation_and_is_dropped(spark):
    df = samples.add_label(frame(spark, [(1, 1, 1, 7, 5)]))
    assert history.add_running_stats(df).first()["user_rating_stddev"] == 0.0
    assert history.add_user_features(df).count() == 0


def test_item_features_drop_unknown_items_and_fill(spark):
    items = spark.createDataFrame(
        [(1, [["a", "1"], ["b", "4"]], 7.5, 10, "N (2001)")],
        "item_id long, tags array<array<string>>, score double, votes long, release_year string",
    )
    df = frame(spark, [(1, 1, 1, 7, 5), (2, 1, 1, 3, 6), (3, 1, 2, 9, 7)])
    rows = plan.training_samples(df, items)
    got = [(r["event_id"], r["item_tag_1"], r["item_tag_3"], r["user_rated_item_1"]) for r in rows.collect()]
    assert got == [(2, "b", None, 1)]
    latest = features.latest_item_features(rows).first()
    assert (latest["item_tag_3"], latest["votes"]) == ("", 10)
    assert features.latest_user_features(rows).first()["user_rated_item_2"] == 0


def test_histogram_shares_sum_to_one(spark):
    got = samples.rating_histogram(frame(spark, skewed())).collect()
    assert sum(r["n"] for r in got) == 1500
    assert sum(r["share"] for r in got) == pytest.approx(1)


@pytest.mark.parametrize("error", [0.0, 0.05])
def test_split_parts_cover_the_samples(spark, error):
    df = frame(spark, [(i, 1, 1, 5, i * 86_400) for i in range(1000)])
    train, test = samples.split_by_time(df, error=error)
    a, b = {r["event_id"] for r in train.collect()}, {r["event_id"] for r in test.collect()}
    assert not a & b and len(a | b) == 1000
    assert abs(len(a) - 800) <= (0 if error == 0 else 50)


def test_busy_users_with_fractional_ratings(spark):
    rows = [(u, i, 0.5 + (i * 7 + u) % 11 / 2, f"2024-01-{1 + i // 4:02d}") for u in (1, 2) for i in range(60)]
    rows += [(3, i, 7.3, f"2024-01-{1 + i:02d}") for i in range(25)] + [(3, 99, None, "2024-02-01")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, rating double, ts string").withColumn("ts", F.to_timestamp("ts"))
    shown = ["user_id", "event_id", "user_rating_count", F.round("user_avg_rating", 9), F.round("user_rating_stddev", 9)]
    plain = sorted(map(tuple, history.add_running_stats(df).select(*shown).collect()))
    assert sorted(map(tuple, history.add_running_stats(df, hot_rows=10, piece_rows=16).select(*shown).collect())) == plain


@pytest.mark.parametrize("hot_rows", [10**9, 0])
def test_a_deviation_on_the_edge_of_two_decimals_is_exact(spark, hot_rows):
    """64 ratings of deviation 3.375; one update a row gives 3.37499.., which rounds the other way."""
    ratings = [5, 7, 1, 10, 0, 10, 3, 1, 7, 0, 10, 10, 6, 5, 9, 4, 8, 10, 10, 4, 4, 10, 8, 8, 10, 7, 10, 3, 1, 9, 0, 2,
               6, 3, 1, 8, 7, 8, 6, 7, 3, 0, 0, 1, 4, 6, 4, 7, 9, 1, 10, 5, 9, 8, 9, 8, 6, 3, 1, 5, 1, 3, 1, 5]
    df = frame(spark, [(i, 1, 0, r, i) for i, r in enumerate(ratings)])
    rows = history.add_running_stats(df, hot_rows=hot_rows, piece_rows=20).where("event_id = 63")
    assert rows.first()["user_rating_stddev"] == 3.375
    assert features.for_export(rows).first()["user_rating_stddev"] == "3.38"


def test_ratings_too_large_for_exact_sums_keep_their_deviation(spark):
    df = frame(spark, [(i, 1, 0, 2_000_000_000 + i % 2, i) for i in range(4)])
    for hot_rows in (10**9, 0):
        rows = history.add_running_stats(df, hot_rows=hot_rows, piece_rows=2).where("event_id = 3").first()
        assert abs(rows["user_rating_stddev"] - (1 / 3) ** 0.5) < 1e-5


def test_pieces_move_few_rows_and_are_worked_on_once(spark, monkeypatch):
    """Rows are carried only from pieces that another one of their user follows; figures are summed from stored rows."""
    plan_of, plans, keep = lambda df: df._jdf.queryExecution().optimizedPlan().toString(), [], history.settled
    monkeypatch.setattr(history, "settled", lambda df: plans.append(plan_of(df)) or keep(df))
    df = samples.add_label(frame(spark, skewed(400)))
    history.add_user_features(df, hot_rows=20, piece_rows=60)
    assert plans and not any("Window" in p for p in plans)
    cut = pieces.cut(df, "user_id", history.TIE_BREAK, 60)
    assert "LeftSemi" in plan_of(pieces.with_carried_rows(cut, "user_id", history.TIE_BREAK, 5))
