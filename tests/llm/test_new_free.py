"""Operators 11 to 13 against plain readings."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import edge
from affinis.llm import alignment, language, queries, ranking, words

A, B = queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.load(A), alignment.load(B)


def plain_alignment(text, a, b):
    """Tokens of whole texts: numbers, links and groups, or None."""
    data = (" " + (text or "")).encode()
    if not text:
        return None
    ids = a.spaced(text), b.spaced(text)
    ends = []
    for x, t in zip(ids, (a, b)):
        if b"".join(t.bytes[i] for i in x) != data:
            return None
        places, at = {}, 0
        for k, i in enumerate(x):
            at += len(t.bytes[i])
            places[at] = k
        ends.append(places)
    common = sorted(set(ends[0]) & set(ends[1]))
    links = [(ids[0][ends[0][e]], ids[1][ends[1][e]]) for e in common]
    groups, i, j = [], 0, 0
    for e in common:
        x, y = ends[0][e] + 1, ends[1][e] + 1
        groups.append(",".join(map(str, ids[0][i:x])) + "|" + ",".join(map(str, ids[1][j:y])))
        i, j = x, y
    return len(ids[0]), len(ids[1]), links, ";".join(groups)


def plain_rows(texts, a, b):
    found = [plain_alignment(t, a, b) for t in texts]
    count = Counter(x for f in found if f for x in f[2])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        f[0], f[1], len(f[2]), len(f[2]), sum(count[x] == best[x[1]] for x in f[2]), sum(count[x] for x in f[2]), f[3]) for f in found]


ODD_TEXTS = [
    "a  b\n\n c \n", " lead", "\nlead", "trail ", "tab\tx", "　wide  space", "▁ mark", "a▁b", "x y", "<|endoftext|> <s> </s> <0x41>", "\0", "don't we'll", "emoji \U0001F600\U0001F600",
    "()();\n\t{\r\n}", "1234567 89", "\n", " ", "café ﬁne ́x", "z" * 2000, "a \n b", "﻿bom",
]


def test_alignment_equals_whole_encodings(spark, tokenizers):
    rows = edge.documents()
    rows += [(100 + i, t, *rows[0][2:]) for i, t in enumerate(ODD_TEXTS)]
    docs = edge.frame(spark, rows)
    out = alignment.align(docs, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    wanted = [(r[0], *x) for r, x in zip(rows, plain_rows([r[1] for r in rows], *tokenizers))]
    assert edge.pairs(out, *out.columns) == sorted(wanted, key=repr)
    assert sum(x[1] == 0 for x in wanted) >= 5  # null, empty and texts that aren't given back


def test_alignment_of_nothing(spark):
    docs = edge.frame(spark, edge.documents()).where("doc_id = -1")
    assert alignment.align(docs, A, B).collect() == []
    silent = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(silent, A, B).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_query_digests_groups(spark, folder):
    import hashlib

    row = queries.op11_token_alignment(spark, folder).orderBy("doc_id").first()
    text = spark.read.parquet(f"{folder}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    groups = plain_alignment(text, alignment.load(A), alignment.load(B))[3]
    assert row.groups_sha256 == hashlib.sha256(groups.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t.,'abcdeXYZ09é日▁　("), max_size=30), max_size=6))
def test_alignment_of_pieces_in_any_company(texts):
    """Texts that share a memory are aligned as each would be alone."""
    aligner = _aligner()
    memory = alignment._Memory(aligner, alignment.Counts(alignment.perfect_hash(np.empty(0, np.int64)), *(np.empty(0, t) for t in (np.int64, np.int64, bool))))
    for text, found in zip(texts, memory.of(texts)):
        plain = plain_alignment(text, aligner.a, aligner.b)
        assert ";".join(memory.groups[i] for i in found) == (plain[3] if plain else "")


_kept: list = []


def _aligner():
    if not _kept:
        _kept.append(alignment.Aligner(A, B))
    return _kept[0]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-2**63, 2**63 - 1), max_size=3000), st.sets(st.integers(-2**63, 2**63 - 1), max_size=50))
def test_perfect_hash_is_minimal_and_perfect(keys, others):
    keys = np.array(sorted(keys), np.int64)
    h = alignment.perfect_hash(keys)
    assert sorted(alignment.number(h, keys).tolist()) == list(range(len(keys)))
    at = alignment.number(h, np.array(sorted(others), np.int64))
    assert ((at >= -1) & (at < max(len(keys), 1))).all()


def test_uncounted_pairs_count_nothing():
    keys = np.arange(0, 5000, 5, dtype=np.int64)
    h = alignment.perfect_hash(keys)
    ordered = np.empty_like(keys)
    ordered[alignment.number(h, keys)] = keys
    counts = alignment.Counts(h, ordered, ordered * 2, np.ones(len(keys), bool))
    n, best = counts.find(np.arange(5000))
    assert (n == np.where(np.arange(5000) % 5 == 0, 2 * np.arange(5000), 0)).all() and (best == (np.arange(5000) % 5 == 0)).all()


def test_vectors_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "SLICE", 16)
    docs = spark.createDataFrame([(i, edge.prose(i % 7, 40)) for i in range(60)], "doc_id long, text string").repartition(9)
    counts = alignment.pair_counts(docs, A, B)
    a, b = alignment.load(A), alignment.load(B)
    wanted = Counter(x for i in range(60) for x in plain_alignment(edge.prose(i % 7, 40), a, b)[2])
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(counts.key, counts.count)} == dict(wanted)
    assert len(wanted) < alignment.most_pairs(a.bytes, b.bytes) < 1_000_000


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    terms = [(i, [edge.lower(w) for w in TERM.findall(t or "")]) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    counts = [Counter(t) for _, t in terms]
    df = Counter(w for c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for (i, t), c in zip(terms, counts):
            m = 10 + 90 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                        for w in {edge.lower(w) for w in TERM.findall(text or "")} if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_scoring_all(spark):
    rows = edge.documents()
    r = random.Random(3)
    rows += [(1000 + i, " ".join(r.choice(["the", "of", "and", "rare%d" % r.randint(0, 90), "x%d" % r.randint(0, 9)]) for _ in range(r.randint(1, 60))), *rows[0][2:])
             for i in range(700)]
    items = [(i, " ".join(r.choice(["the", "of", "And", "rare%d" % r.randint(0, 99), "X%d" % r.randint(0, 9), "none"]) for _ in range(12))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "absent terms only"), (None, "the of x1"), (103, edge.prose(1)), (104, "é 日本")]
    docs, queries_ = edge.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    wanted = plain_search([(x[0], x[1]) for x in rows], items)
    for shard_tokens, block_terms in ((ranking.SHARD_TOKENS, ranking.QUERY_TERMS), (2000, 60)):
        found = ranking.search(ranking.build_index(docs, shard_tokens=shard_tokens), queries_, block_terms=block_terms)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert edge.pairs(found, *found.columns) == wanted


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 12))
def test_skipping_loses_no_document(seed, n, k):
    """Windows and bounds of any size against scores of all documents."""
    r = np.random.default_rng(seed)
    m = r.integers(10, 200, n)
    lists, total = [], np.zeros(n, np.int64)
    for _ in range(r.integers(1, 8)):
        docs = np.flatnonzero(r.random(n) < r.choice([0.01, 0.1, 0.6, 1.0]))
        if not len(docs):
            continue
        tf, weight = r.integers(1, 4, len(docs)), int(r.choice([0, 5, 300, 6000]))
        at = np.arange(0, len(docs), ranking.BLOCK)
        bounds = weight * ranking.impact(np.maximum.reduceat(tf, at), np.minimum.reduceat(m[docs], at))
        lists.append(ranking.Postings(weight, docs, tf, bounds, int(bounds.max())))
        total[docs] += weight * ranking.impact(tf, m[docs])
    order = np.lexsort((np.arange(n), -total))
    order = order[total[order] > 0][:k]
    for short, window in ((0, 7), (20, 50), (1000, 10)):
        docs, score = ranking.top(lists, m, k, short, window) if lists else (np.empty(0, int), np.empty(0, int))
        assert docs.tolist() == order.tolist() and score.tolist() == total[order].tolist()


def test_search_of_nothing(spark):
    docs, items = edge.frame(spark), spark.createDataFrame([(1, "the")], "item_id long, text string")
    index = ranking.build_index(docs)
    assert ranking.search(index, items.where("item_id = 2")).collect() == []
    assert ranking.search(ranking.build_index(docs.where("doc_id = -1")), items).collect() == []


# Language

def plain_costs(samples, text, order=language.ORDER):
    """Code length of a text in each language, byte by byte, from counts of all contexts."""
    out = {}
    for lang, texts in samples.items():
        seen: dict = defaultdict(Counter)
        for t in texts:
            for w in t.encode().lower().split():
                w = b" " + w
                for i in range(1, len(w)):
                    for k in range(min(order, i) + 1):
                        seen[w[i - k: i]][w[i]] += 1
        bits = 0.0
        for w in text.encode().lower().split():
            w = b" " + w
            for i in range(1, len(w)):
                for k in range(min(order, i), -1, -1):
                    c = seen.get(w[i - k: i])
                    if c is None:
                        continue
                    if w[i] in c:
                        bits -= math.log2(c[w[i]] / (sum(c.values()) + len(c)))
                        break
                    bits -= math.log2(len(c) / (sum(c.values()) + len(c)))
                else:
                    bits += 8
        out[lang] = bits
    return out


def test_code_lengths_equal_a_walk_of_the_trees(spark, monkeypatch):
    monkeypatch.setattr(language, "_PLACES", 37)
    samples = {"de": ["der die und das ist nicht", "über die Brücke"], "en": ["the and of that is not", "the bridge"], "fr": ["le la et que ce n'est pas"]}
    rows = [(x, t) for x, ts in samples.items() for t in ts]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["de", "en", "fr"]
    for text in ("the Brücke", "n'est", "zzz 日本", "a b c", "dieser thesaurus"):
        found = language.code_lengths(model, language.words(text.encode())).sum(axis=0)
        assert np.allclose(found, list(plain_costs(samples, text).values()))


def test_languages_of_odd_documents(spark):
    rows = edge.documents() + [(50, "12 .. 34", *edge.documents()[0][2:]), (51, "日本語", *edge.documents()[0][2:])]
    docs = edge.frame(spark, rows)
    model = language.learn(docs)
    out = language.predict(docs, model)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["lang_pred", "score"]
    texts = Counter((r[0], edge.lower(r[1] or "")) for r in rows)
    assert out.count() == sum(texts.values())
    for r in out.select("doc_id", "lang_pred", "score").collect():
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        if r.doc_id in (4, 5, 6, 50):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    nothing = language.learn(docs.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language.predict(docs.where("doc_id = -1"), model).collect() == []


def test_bounded_sample_and_nodes(spark):
    docs = spark.createDataFrame([("en" if i % 2 else "xx", edge.prose(i)) for i in range(80)], "lang string, text string")
    small = language.learn(docs, sample_bytes=20_000, most_nodes=300)
    assert small.languages and sum(len(x.key) for x in small.levels) <= 300
    again = language.learn(docs, sample_bytes=20_000, most_nodes=300)
    assert all((x.key == y.key).all() and np.array_equal(x.cost, y.cost, equal_nan=True) for x, y in zip(small.levels, again.levels))


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op13_language_id(spark, folder).collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out) > 250


def test_long_words_are_told_apart():
    """Words on which a polynomial modulo 2^64 is known to fail."""
    import pyarrow as pa

    def thue_morse(n: int, flip: int) -> str:
        return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))

    for n in (1024, 2048, 4096):
        _, data, offsets = next(words.chunks(pa.array([thue_morse(n, 0) + " " + thue_morse(n, 1)])))
        a, b = words.hashes(words.split(data, offsets))
        assert a != b
