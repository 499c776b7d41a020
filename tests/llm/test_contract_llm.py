"""What the package may gather, and what its native operators may not use."""

import pathlib

FOLDER = pathlib.Path(__file__).resolve().parents[2] / "affinis" / "llm"
BOUNDED = {
    # Windows of the benchmark, in automata of a given size.
    ("decontamination.py", ".collect()"): 1,
    # Words, symbols and contexts by their least share of all tokens; one row per class; one per context.
    ("suffix_tree.py", ".toPandas()"): 4,
    # Pairs that two vocabularies can link, and their counts.
    ("alignment.py", ".toArrow()"): 2,
    # Terms of one block of queries.
    ("ranking.py", ".toArrow()"): 1,
    # Ids that part the batches: EDGE_SAMPLE for every BATCH_BYTES of text.
    ("lines.py", ".collect()"): 1,
    # Nodes of a bounded sample, at most MOST_NODES; counts of counts up to 1000.
    ("language.py", ".toArrow()"): 2,
}


def test_what_reaches_the_driver():
    for path in FOLDER.glob("*.py"):
        code = path.read_text()
        for word in (".collect()", ".toPandas()", ".toArrow()", "repartition(1)", "coalesce(1)", "crossJoin", "localCheckpoint", "tempfile", "F.udf("):
            assert code.count(word) <= BOUNDED.get((path.name, word), 0), (path, word)


def test_native_operators_use_no_python_in_tasks():
    for name in ("quality.py", "mixing.py", "lines.py"):
        code = (FOLDER / name).read_text()
        assert not any(word in code for word in ("mapIn", "applyIn", "pandas", "pyarrow", ".rdd", "udf("))
