import pathlib
import re

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

ROOT = pathlib.Path(__file__).resolve().parent.parent
# Slow ones run in the driver's check and in oracle_check.py.
SLOW = {
    "wide_deep", "embedding_mlp", "ncf", "deepfm", "two_tower", "model_metrics", "shown_predictions",
    "recommend_wide_deep", "recommend_neural_cf", "recommend_wide_deep_lists", "recommend_neural_cf_lists",
}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_names_are_query_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - SLOW))
def test_query_equals_its_sql(spark, folder, con, name):
    df = contract.queries()[name](spark, folder)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) == ""


def test_library_does_not_gather_data():
    """Only listed, bounded reads reach the driver."""
    allowed = {
        # One row per item block; vectors below the size limit; the checked vocabulary.
        ("scoring.py", ".collect()"): 2,
        ("scoring.py", ".toPandas()"): 1,
        ("encoders.py", ".collect()"): 1,
        # At most MAX_TILES pivots and as many sizes; at most MAX_PIVOTS pivots.
        ("tiles.py", ".collect()"): 2,
        ("neighbour_graph.py", ".collect()"): 1,
        # One number per bucket.
        ("revisions.py", ".collect()"): 1,
    }
    words = (".collect()", ".toPandas()", "repartition(1)", "coalesce(1)", "crossJoin", "localCheckpoint", "F.udf(")
    for path in (ROOT / "affinis").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        code = path.read_text()
        for word in words:
            assert code.count(word) <= allowed.get((path.name, word), 0), (path, word)
        assert not re.search(r"@F?\.?udf", code)
