import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from affinis.functions import arrays, text, vectors

TAGS = "tags array<array<string>>"


def one(spark, schema, value, expr):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first()["x"]


def test_sort_tags_edges(spark):
    def run(v):
        return one(spark, TAGS, v, arrays.sort_tags(F.col("tags")))

    assert run([["a", "1"], ["b", "2"], ["a", "3"]]) == ["a", "b"]
    assert run(None) is None
    assert run([]) == []
    assert run([["z", "2"], ["y", "2"], ["x", "many"]]) == ["y", "z", "x"]


def test_tag_counts_last_wins(spark):
    got = one(spark, TAGS, [["a", "1"], ["b", "2"], ["a", "3"]], arrays.tag_counts(F.col("tags")))
    assert got == {"a": 3, "b": 2}


def test_positions_past_the_end_are_null(spark):
    df = spark.createDataFrame([(["a"],)], "tags array<string>")
    assert tuple(df.select(*arrays.positions(F.col("tags"), ["p", "q"])).first()) == ("a", None)


def test_tag_names(spark):
    df = spark.createDataFrame([([("a",), ("b",)],)], "tags array<struct<name:string>>")
    assert tuple(df.select(*arrays.tag_names(F.col("tags"), ["p", "q", "r"])).first()) == ("a", "b", None)


def test_favourite_tags(spark):
    got = one(spark, "t array<array<string>>", [["a", "b"], ["b", "c"], ["c", "b"]], arrays.favourite_tags(F.col("t")))
    assert got == ["b", "c", "a"]


def test_favourite_tags_equal_counting(spark):
    r = random.Random(3)
    lists = [[[r.choice([None, "é", "b", "a b", "c", "ä"]) for _ in range(r.randint(0, 5))] for _ in range(r.randint(0, 8))] for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*lists, None, []])], "i int, t array<array<string>>")
    got = dict(df.select("i", arrays.favourite_tags(F.col("t"))).collect())
    for i, tags in enumerate(lists):
        n = Counter(t for one_list in tags for t in one_list if t is not None)
        assert got[i] == sorted(n, key=lambda t: (-n[t], t.encode()))
    assert got[60] is None and got[61] == []


def test_newest_first_orders_by_time_or_rating(spark):
    rows = [["1", "9", "2020-01-01"], ["2", "3", "2021-01-01"], ["3", "5", "2019-01-01"]]
    assert one(spark, TAGS, rows, arrays.newest_first(F.col("tags"))) == ["2", "1", "3"]
    assert one(spark, TAGS, rows, arrays.newest_first(F.col("tags"), by=1)) == ["1", "3", "2"]


def test_release_year(spark):
    def run(v):
        return one(spark, "t string", v, text.release_year(F.col("t")))

    assert run("Name (2005)") == 2005
    assert run("  Name (2005)  ") == 2005
    assert run(None) == 1990
    assert run("(20)") == 1990
    assert run("no year here") is None


def test_day_millis_uses_the_leading_day(spark):
    assert one(spark, "t string", "1970-01-02 23:59:59", text.day_millis(F.col("t"))) == 86_400_000
    assert one(spark, "t string", "soon", text.day_millis(F.col("t"))) is None


def test_two_decimals(spark):
    assert one(spark, "x double", 1234.5, text.two_decimals(F.col("x"))) == "1,234.50"


def test_phrase_prefix_against_brute_force(spark):
    names = ["刀剑神域", "Sword Art Online", "art of sword", "The Art", "sword-art", "", "x刀剑", "swordart on"]
    keys = ["刀剑", "sword a", "art", "SWORD ART", "剑神", "art o", "", "!", "d art"]

    def words(s):
        out = []
        for run in re.findall(r"[^\W_]+", s.lower()):
            out += re.findall(r"[一-鿿]|[^一-鿿]+", run)
        return out

    def expected(name, key):
        w, k = words(name), words(key)
        for i in range(len(w) - len(k) + 1 if k else 0):
            if w[i:i + len(k) - 1] == k[:-1] and w[i + len(k) - 1].startswith(k[-1]):
                return i + 1
        return None

    df = spark.createDataFrame([(n,) for n in names], "name string")
    for key in keys:
        got = {r["name"]: r["at"] for r in df.withColumn("at", text.phrase_prefix_at(F.col("name"), key)).collect()}
        assert got == {n: expected(n, key) for n in names}, key


def test_cosine_edges(spark):
    def run(u, v):
        df = spark.createDataFrame([(u, v)], "u array<double>, v array<double>")
        return df.select(vectors.cosine(F.col("u"), F.col("v")).alias("x")).first()["x"]

    assert run([1.0, 0.0], [0.0, 2.0]) == 0.0
    assert math.isclose(run([1.0, 1.0], [2.0, 2.0]), 1.0)
    assert run([0.0, 0.0], [1.0, 1.0]) is None
    assert run([1.0], [1.0, 1.0]) == -1.0
    assert run(None, [1.0]) == -1.0


def test_vector_codecs_round_trip(spark):
    v = [0.1, -2.5e-9, 3.0]
    df = spark.createDataFrame([(7, v)], "id long, emb array<double>")
    line = df.select(vectors.to_line(F.col("id"), F.col("emb")).alias("l"), vectors.to_commas(F.col("emb")).alias("c"))
    back = line.select(vectors.line_id(F.col("l")), vectors.line_vector(F.col("l")), vectors.from_commas(F.col("c"))).first()
    assert tuple(back) == (7, v, v)


def test_favourite_tags_sort_without_a_comparator_for_each_pair(spark):
    df = spark.createDataFrame([([["b", None, "a"], None, ["b"]],), ([],), ([[None]],), (None,)], "t array<array<string>>")
    made = df.select(arrays.favourite_tags(F.col("t")).alias("f"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    got = [r["f"] for r in made.collect()]
    assert got == [r["f"] for r in df.select(_sorted_by_comparator(F.col("t")).alias("f")).collect()] and got[1] == []


def _sorted_by_comparator(tag_lists):
    tags = F.filter(F.flatten(tag_lists), lambda x: x.isNotNull())
    pairs = F.transform(F.array_distinct(tags), lambda x: F.struct((-F.size(F.filter(tags, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda e: e["x"])
