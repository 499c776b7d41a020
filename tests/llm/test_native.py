"""Quality rules, mixing and line dedup against plain Python, on odd documents."""

import hashlib
from collections import Counter, defaultdict

import edge
import pytest
from pyspark.sql import functions as F

from affinis.llm import lines, mixing, quality


def _counts(text):
    w = edge.words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i: i + 3])] > 1 for k in range(3)}
    held = [x for x in (text or "").split("\n") if edge.words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(held) - len(set(held)), len(covered))


def test_quality_counts(spark):
    out = quality.rate(edge.frame(spark))
    got = edge.pairs(out, "text", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed")
    want = []
    for row in edge.documents():
        c = _counts(row[1])
        want.append((row[1], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=repr)
    kept = out.where("quality.kept").select("doc_id").collect()
    assert {r[0] for r in kept} >= {1, 2, 3, 9, 10, 13} and not {r[0] for r in kept} & {4, 5, 6, 7, 11, 12}


def test_repeats_are_found_between_windows_of_equal_bits(spark, monkeypatch):
    # With four bits of the hash left, most equal windows have others between them.
    monkeypatch.setattr(quality, "PLACE_BITS", 60)
    texts = [edge.prose(1, 80) + "\nx\n" + edge.prose(1, 80), edge.prose(2, 90), "a b c d a b c x a b c", "a " * 90, None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.counts.n_repeat_words for r in quality.score(docs).collect()}
    assert got == {t: _counts(t)[4] for t in texts}


def test_quality_keeps_columns(spark):
    docs = edge.frame(spark)
    kept = quality.keep(docs)
    assert kept.schema == docs.schema and kept.count() < docs.count()
    assert quality.keep(edge.frame(spark, [])).count() == 0


def test_rules_are_a_table(spark):
    rules = (quality.Rule("short", "n_words", None, 0, 5),)
    out = quality.rate(edge.frame(spark), rules=rules)
    assert out.where("quality.kept").count() == 0


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, left = {}, dict(weight)
    while True:
        room = 1.5 * sum(sizes.values()) - sum(full.values())
        over = {s: 2.0 * sizes[s] for s in left if room * left[s] / sum(left.values()) > 2 * sizes[s]} if left else {}
        if not over:
            return full | {s: room * w / sum(left.values()) for s, w in left.items()}
        full |= over
        left = {s: w for s, w in left.items() if s not in over}


def test_mixing(spark):
    docs = edge.documents()
    out = mixing.mix(edge.frame(spark)).collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r[3]] += len(edge.words(r[1]))
    want = sorted(_targets(sizes).values())
    assert len(out) == len(docs)
    assert sorted({round(r.target, 6) for r in out}) == sorted({round(t, 6) for t in want})
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    again = mixing.mix(edge.frame(spark)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert mixing.mix(edge.frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [3, 400])
def test_mix_comes_near_its_targets(spark, n):
    rows = [(i, edge.prose(i, 20 + i % 90), "en", f"s{i % 4 if i % 3 else 0}", 1) for i in range(n)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in out:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        largest[r.source_size] = max(largest[r.source_size], r.size)
    for s in taken:
        assert abs(taken[s] - target[s]) <= (largest[s] if n < 10 else 0.02 * target[s])


def _wanted(sizes, ratio, worths=None):
    """Copies wanted of each document of one source."""
    worths = worths or [n * 1000 // (n + mixing.CONTEXT) for n in sizes]
    mean = sum(n * w for n, w in zip(sizes, worths)) / sum(sizes)
    slope = mixing.LEAN * min(ratio / mean, (2 - ratio) / (1000 - mean))
    return [ratio + slope * (w - mean) for w in worths]


def _mixed(rows):
    """The sample of one source, row by row; (size, taken) of each."""
    wanted = _wanted([n for _, n, _ in rows], 1.5)
    rank = lambda u, e: (u / (1 - u)) / (e % 1 / (1 - e % 1))
    ranked = sorted(((rank(u, e), i is not None, i, n, int(e)) for (i, n, u), e in zip(rows, wanted)), key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
    total = sum(r[3] for r in ranked)
    taken = [r[4] for r in ranked]
    gap = total * 1.5 - sum(r[3] * r[4] for r in ranked)
    for k, r in enumerate(ranked):
        if r[3] >= gap:
            break
        gap -= r[3]
        taken[k] += 1
    for _ in range(mixing.CLOSERS):
        off = [(abs(r[3] - gap), k) for k, r in enumerate(ranked) if taken[k] == r[4] and abs(r[3] - gap) < gap]
        if off:
            taken[min(off)[1]] += 1
            gap -= ranked[min(off)[1]][3]
    return sorted((repr(r[2]), r[3], r[3] * t) for r, t in zip(ranked, taken))


@pytest.mark.parametrize("given", [False, True])
def test_documents_come_as_often_as_wanted(spark, given):
    # Three kinds of documents in two sources, one of which is short of its share and repeats.
    sizes, worths = [20, 100, 400], [900, 300, 0]
    rows = [(i, " ".join(["w"] * sizes[i % 3]), "a" if i % 10 else "b", worths[i % 3]) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, worth long").repartition(4)
    out = mixing.mix(docs, worth=F.col("worth") if given else None).groupBy("source_size", "target", "size").agg(
        F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert len(out) == 6
    for source in {r.source_size for r in out}:
        kinds = sorted((r for r in out if r.source_size == source), key=lambda r: r.size)
        wanted = _wanted([r.size * r.n for r in kinds], kinds[0].target / source, worths if given else [r.size * 1000 // (r.size + mixing.CONTEXT) for r in kinds])
        assert all(abs(r.taken / r.size / r.n - e) < 0.03 for r, e in zip(kinds, wanted)), (kinds, wanted)
        assert abs(sum(r.taken for r in kinds) - kinds[0].target) <= 20


@pytest.mark.parametrize("copies,seed,fixed", [(5000, 0, 7), (5000, 1, None), (3, 2, 7), (1, 3, 7)])
def test_mix_takes_repeated_rows_one_by_one(spark, copies, seed, fixed):
    # Most words are in rows that repeat, so the edge falls among them; closers pick from small groups of repeats.
    rows = [(fixed, edge.prose(seed, 11))] * copies + [(100 + i // 3, edge.prose(500 + i // 3, 1 + i // 3 % 12)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(docs)
    u = docs.select("doc_id", mixing.word_count(docs.text), mixing.uniform(docs.doc_id, docs.text, 17)).collect()
    assert sorted((repr(r.doc_id), r.size, r.taken) for r in out.collect()) == _mixed([tuple(r) for r in u])
    target = out.first().target
    assert abs(sum(r.taken for r in out.collect()) - target) <= 6


def _deduped(rows):
    key = lambda x: edge.lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    first = {k: min(v, key=lambda i: (i is None, i or 0)) for k, v in holders.items()}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if first.get(key(x), i) == i]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [None, 1, 9])
def test_line_dedup(spark, batches):
    docs = edge.documents()
    extra = [(100 + i, f"a line that all share\nown line number {i}\n{edge.prose(i, 24)}", "en", "s", 1, *docs[0][5:]) for i in range(40)]
    out = lines.line_counts(edge.frame(spark, docs + extra), batches=batches)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == _deduped([(r[0], r[1]) for r in docs + extra])


def test_line_dedup_keeps_columns(spark):
    docs = edge.frame(spark)
    out = lines.dedup(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert lines.dedup(edge.frame(spark, [])).count() == 0


def test_line_dedup_by_text_ids_compacts_and_leaves_no_table(spark, monkeypatch):
    levels = []
    close = lines.LineRuns.close
    monkeypatch.setattr(lines.LineRuns, "close", lambda self: (levels.append([len(x) for x in self.levels]), close(self)))
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(f"é{i % 7}-{i}", f"a line that all share\nline of some {i // 3}\n{edge.prose(i, 24)}") for i in range(90)] + [(None, "a line that all share"), ("", None)]
    out = lines.line_counts(spark.createDataFrame(rows, "doc_id string, text string").repartition(4))
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in out.collect()}
    first, groups = min(i for i, _ in rows if i), defaultdict(list)
    for n in range(90):
        groups[n // 3].append(rows[n][0])
    assert got[None] == (1, 1) and got[""] == (1, 0)
    assert all(got[i][1] == (i != first) + (i != min(groups[n // 3])) for n, (i, _) in enumerate(rows[:90]))
    assert levels == [[1, 1]] and {t.name for t in spark.catalog.listTables()} == before


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, 2)
    for i in range(9):
        batch = spark.createDataFrame([(bytearray([k]), i, 0, 0) for k in range(i, i + 3)], "key binary, doc long, text_hash long, place int")
        dropped = {r.key[0] for r in runs.add(batch).collect()}
        assert dropped == (set() if i == 0 else {i, i + 1})
    assert [len(level) for level in runs.levels] == [1, 2]
