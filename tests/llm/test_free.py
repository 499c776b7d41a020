"""The other operators against plain Python, exact round trips and properties, on odd documents."""

import gzip
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import archives, decontamination, jaccard, rendering, substrings, suffix_tree, tokens, words as W

public_tokenizers = pytest.importorskip("public_tokenizers")


# Words

@pytest.mark.parametrize("n", [1, 2, 5, 12, 35])
def test_grams_and_bounds(n):
    h = W.mix(np.arange(200, dtype=np.uint64))
    doc = np.array([0, 0, 40, 41, 41, 150, 200])
    got = W.grams(h, n)
    assert len(got) == 201 - n and len(set(got.tolist())) == len(got)
    assert (W.grams(np.concatenate([h[:3], h]), n)[3:] == got).all()
    owner = np.repeat(np.arange(6), np.diff(doc))
    assert (W.inside(doc, n, 200) == (owner[: 201 - n] == owner[n - 1:])).all()


# Suffix tree

def test_suffix_tree_scores(spark):
    rows = edge.documents() + [(200 + i, edge.prose(i % 6, 150), "en", "s", 1, *edge.documents()[0][5:]) for i in range(60)]
    docs = edge.frame(spark, rows)
    out = suffix_tree.held_out(F.col("doc_id"))
    model, counts = suffix_tree.learn(docs.where(~out))
    got = suffix_tree.score(docs, model, counts).collect()
    plain = {(r[0], r[1]): [edge.lower(w) for w in edge.words(r[1])] for r in rows}
    c, texts = Counter(), 0
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            c.update(plain[r[0], r[1]])
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + 1
    assert (model.tokens, model.distinct) == (n, v)
    c[None] = texts

    def base(ws):
        return sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None])

    want = sorted((round(base(plain[r[0], r[1]]), 4), len(plain[r[0], r[1]]) + 1, sum(c[w] > 0 for w in [*plain[r[0], r[1]], None])) for r in rows)
    assert sorted((round(r.base_score, 4), r.n_tokens, r.n_known) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)

    # Every state's distribution over symbols sums to 1, and so does each class over its words and one unknown.
    size = model.vocabulary.size
    states = 0
    for k, level in enumerate(model.levels):
        for number in np.flatnonzero(~np.isnan(level.log_rest))[:40]:
            numbers = [*suffix_tree._of_suffix(model.levels[:k], level.code, np.array([number]), size), np.array([number])]
            numbers = [np.repeat(x, size) for x in numbers]
            p = 10 ** suffix_tree._log_next(model.root, model.levels[: k + 1], numbers, np.arange(size), size)
            assert abs(p.sum() - 1) < 1e-9
            states += 1
    assert states and abs((10 ** model.root).sum() - 1) < 1e-9

    # The longest retained suffix decides: a text scored by hand.
    def by_hand(ws):
        codes = {int(k): i for i, k in enumerate(model.vocabulary.key)}
        symbols, total = [], 0.0
        for w in ws:
            data = np.frombuffer(w.encode(), np.uint8)
            one = W.split(data, np.array([0, len(data)]))
            row = codes.get(int(W.hashes(one).view(np.int64)[0]), -1)
            s = int(model.vocabulary.symbol[row]) if row >= 0 else -1
            if s < 0:
                s = 1 + int(suffix_tree.word_classes(one)[0])
                total += math.log10(c[w] + 0.5) - model.rest[s - 1]
            symbols.append(s)
        for i, s in enumerate([*symbols, suffix_tree.END]):
            log, number = model.root[s], 0
            for k, level in enumerate(model.levels, 1):
                if i < k:
                    break
                at = np.flatnonzero(level.code == number * size + symbols[i - k])
                if not len(at):
                    break
                number = int(at[0])
                if not math.isnan(level.log_rest[number]):
                    there = np.flatnonzero(level.next_code == number * size + s)
                    log = level.next_log[there[0]] if len(there) else log + level.log_rest[number]
            total += log
        return total

    by_base = defaultdict(list)
    for r in got:
        by_base[round(r.base_score, 4)].append(r.score)
    for key in [(1, rows[0][1]), (10, rows[9][1]), (14, rows[13][1]), (4, None), (203, rows[-57][1])]:
        assert min(abs(x - by_hand(plain[key])) for x in by_base[round(base(plain[key]), 4)]) < 1e-6


def test_suffix_tree_without_training(spark):
    model, counts = suffix_tree.learn(edge.frame(spark, []))
    got = suffix_tree.score(edge.frame(spark), model, counts).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in got) and len(got) == len(edge.documents())


# Decontamination

def _alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", edge.lower(text or ""))


def _contaminated(text, items):
    ws, hit, ids = _alnum(text), set(), set()
    for i, t in items:
        q = _alnum(t)
        for k in range(max(1, len(q) - 9) if q else 0):
            gram = q[k: k + 10]
            for a in range(len(ws) - len(gram) + 1):
                if ws[a: a + len(gram)] == gram:
                    hit.update(range(a, a + len(gram)))
                    ids.add(i)
    return len(ws), len(hit), sorted({str(i) for i in ids if i is not None})


@pytest.mark.parametrize("bound", [10_000_000, 400])
def test_decontamination(spark, bound):
    passage = edge.prose(50, 40)
    items = [(1, passage), (2, "One,"), (3, None), (4, "..."), (None, edge.prose(51, 12)), (1, passage), (10, edge.prose(52, 9)), (7, "é ü")]
    docs = edge.documents() + [
        (300, edge.prose(8, 30) + " " + passage.upper().replace(" ", " - ") + " " + edge.prose(9, 30), *edge.documents()[0][2:]),
        (301, "x " + edge.prose(51, 12) + edge.prose(52, 9), *edge.documents()[0][2:]), (302, passage[: len(passage) // 3], *edge.documents()[0][2:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.scan(edge.frame(spark, docs), bench, max_characters=bound).collect()
    got = sorted((r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), list(r["items"])) for r in out)
    assert got == sorted(_contaminated(r[1], items) for r in docs)
    text = {r[0]: r[1] for r in docs}
    for r in out:
        for s in r.spans if r.doc_id in (300, 301) else ():
            assert len(_alnum(text[r.doc_id][s["start"]: s["stop"]])) == s["last"] - s["first"] + 1
    clean = decontamination.clean(edge.frame(spark, docs), bench)
    assert clean.schema.names == edge.frame(spark).schema.names
    assert clean.count() == sum(not _contaminated(r[1], items)[1] for r in docs)
    assert decontamination.clean(edge.frame(spark), bench.where("false")).count() == len(edge.documents())


# Jaccard join

def _near(rows, threshold=0.8):
    classes = defaultdict(list)
    for i, t in rows:
        w = tuple(edge.lower(x) for x in edge.words(t))
        classes[w if w else ("", i, id(t))].append(i)
    keys = list(classes)
    sets = [{w[k: k + 5] for k in range(max(1, len(w) - 4))} if w[0] else set() for w in keys]
    links, top = Counter(), list(range(len(keys)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    groups = defaultdict(list)
    for k, w in enumerate(keys):
        groups[find(k)] += classes[w]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, least(groups[find(k)]), least(classes[w]), links[k]) for k, w in enumerate(keys) for i in classes[w]), key=repr)


def _copies(n, seed):
    r = random.Random(seed)
    base = edge.prose(seed, 300).split()
    for i in range(n):
        ws = list(base)
        for _ in range(r.randint(0, 9)):
            ws[r.randrange(len(ws))] = f"w{r.randrange(10**6)}"
        yield " ".join(ws)


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    extra = edge.documents()[0][2:]
    rows = [r for r in edge.documents() if r[0] is not None or r[1]]  # rows without id and words cannot be told apart below
    rows += [(500 + i, t, *extra) for i, t in enumerate(_copies(70, 5))] + [(700 + i, t, *extra) for i, t in enumerate(_copies(6, 6))]
    out = jaccard.near_duplicates(edge.frame(spark, rows))
    assert edge.pairs(out, "doc_id", "class_id", "copy_of", "n_links") == _near([(r[0], r[1]) for r in rows])
    kept = jaccard.keep(edge.frame(spark, rows))
    assert kept.schema.names == edge.frame(spark).schema.names
    groups = {g for i, g, *_ in _near([(r[0], r[1]) for r in rows])}
    # 9 is the id of two documents with different texts.
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=repr) == sorted([*groups, 9], key=repr)


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(edge.frame(spark, [])).count() == 0
    assert jaccard.keep(edge.frame(spark, [])).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    needed = jaccard.needed_matches()
    rng = np.random.default_rng(1)
    for n, m in needed.items():
        assert (rng.binomial(n, 0.8, 200_000) < m).mean() < 1e-4


# Substring dedup

def _without_repeats(rows):
    seen = Counter()
    split = [edge.words(t) for _, t in rows]
    for ws in split:
        seen.update(tuple(ws[k: k + 35]) for k in range(len(ws) - 34))
    out = []
    for (i, _), ws in zip(rows, split):
        gone = {k + j for k in range(len(ws) - 34) if seen[tuple(ws[k: k + 35])] > 1 for j in range(35)}
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [64, 3])
def test_substring_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    passage, extra = " ".join(edge.prose(60, 80).split()), edge.documents()[0][2:]
    rows = edge.documents() + [
        (400 + i, f"{edge.prose(600 + i, 20 + i)} {' '.join(passage.split()[i % 7: 80 - i % 5])} {edge.prose(900 + i, 30)}", *extra) for i in range(90)]
    rows += [(600, "the " * 300, *extra), (601, "the cat " * 40 + "end", *extra), (602, passage, *extra), (603, " ".join(passage.split()[:35]), *extra), (604, " ".join(passage.split()[:34]), *extra)]
    out = substrings.dedup(edge.frame(spark, rows))
    assert edge.pairs(out, "doc_id", "n_words", "n_removed", "text") == _without_repeats([(r[0], r[1]) for r in rows])
    assert substrings.dedup(edge.frame(spark, [])).count() == 0


def test_leftmost():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 3, 8, 24):
        assert substrings._leftmost(v, width).tolist() == [i + int(np.argmin(v[i: i + width])) for i in range(301 - width)]


# Token counts

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    odd = "a<|endoftext|>b <|startoftext|> İ ΟΔΟΣ it's don't 'S \x1c\x85 x ́y " * 30
    texts = [r[1] for r in edge.documents()] + [odd, "日本語" * 3000, "ab" * 9000 + " " + odd]
    rows = [(i, t, *edge.documents()[0][2:]) for i, t in enumerate(texts)]
    got = dict(tokens.count_tokens(edge.frame(spark, rows), path, chunk=4000).select("doc_id", "n_tokens").collect())
    assert got == {i: len(tokens.encode(t or "", path)[0]) for i, t in enumerate(texts)}
    assert tokens.count_tokens(edge.frame(spark, []), path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("chunk,overlap", [(300, 50), (1000, 100), (5000, 20)])
def test_splicing(name, chunk, overlap):
    path = public_tokenizers.path(name)
    text = edge.prose(1, 900) + " <|endoftext|> " + "q" * 4000 + " é日本 \n\n  x" * 50 + edge.prose(2, 900)
    assert tokens.count_spliced(text, path, chunk, overlap) == len(tokens.encode(text, path)[0])


def test_only_space_free_patterns_count_by_pieces():
    assert tokens.splits_at_space(public_tokenizers.path("word_bpe_49k.json"))
    assert not tokens.splits_at_space(public_tokenizers.path("byte_bpe_50k.json"))


# Archives

def test_archives(spark, tmp_path):
    big, odd = "<p>same</p>" * 200, "a\r\n\r\nWARC/1.1\r\nb\nhttp://x 1 2 t 3\n"
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", None), (4, "", ""), (5, "http://e", odd), (6, "u", "é" * 499), (7, "u", "é" * 499),
            (8, "u", "é" * 500), (9, "u", "é" * 500), (None, "n", big), (9, "u", "é" * 500), (10, "filedesc://x", odd * 50)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, part int")
    archives.write_arc(pages, str(tmp_path / "arc"), part_bytes=3000)
    records = archives.read_arc(spark, str(tmp_path / "arc"))
    got = sorted((((r.page_id, r.payload.decode()) for r in records.collect())), key=repr)
    # A page whose url looks like a version block's is an ordinary one.
    assert got == sorted(((r[0], r[2] or "") for r in rows), key=repr)
    archives.to_warc(records, str(tmp_path / "warc"))
    back = archives.read_warc(spark, str(tmp_path / "warc")).collect()
    assert all(r.sound for r in back) and len(back) == len(got)
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), i or -1)
    text = dict((i, h) for i, _, h in rows)
    for r in back:
        h = text[r.page_id] or ""
        first = top.get(h, r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert r.payload_bytes == len(h.encode()) and (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or r.payload.decode() == h


def test_heads_in_any_encoding_and_bytes_of_any_kind(spark, tmp_path):
    head = b"HTTP/1.0 200 OK\r\nServer: caf\xe9\r\nX-Page-Id: 7\r\n\r\n"
    blocks = [head + b"\xff\x00\r\n\xfe", b"\x89PNG no head"]
    arc = b"filedesc://x 0.0.0.0 20240101000000 text/plain 76\n1 0 y\n" + (archives.FIELDS[1] + "\n\n").encode().ljust(70, b"\n")
    for i, block in enumerate(blocks):
        arc += f"http://{i} 1.2.3.4 20010203040506 text/html {len(block)}\n".encode() + block + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc").write_bytes(arc)
    archives.to_warc(archives.read_arc(spark, str(tmp_path / "arc")), str(tmp_path / "warc"))
    back = sorted(archives.read_warc(spark, str(tmp_path / "warc")).collect(), key=lambda r: r.url)
    assert [(r.page_id, r.record_type, r.sound, bytes(r.payload), r.date) for r in back] == [
        (7, "response", True, b"\xff\x00\r\n\xfe", "2001-02-03T04:05:06Z"), (None, "resource", True, blocks[1], "2001-02-03T04:05:06Z")]


def test_equal_pages_are_dealt_over_the_parts(spark, tmp_path):
    pages = spark.range(2000).select(F.lit(None).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 100).alias("html"))
    archives.write_arc(pages, str(tmp_path / "arc"), part_bytes=40_000)
    sizes = [sum(1 for _ in archives.parse_arc(gzip.decompress(f.read_bytes()))) for f in (tmp_path / "arc").glob("*.gz")]
    assert sum(sizes) == 2000 and len(sizes) > 10 and max(sizes) < 500
    with pytest.raises(TypeError):
        archives.write_arc(pages.withColumn("page_id", F.lit("a")), str(tmp_path / "text"))


def test_empty_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives.write_arc(pages, str(tmp_path / "arc"))
    archives.to_warc(archives.read_arc(spark, str(tmp_path / "arc")), str(tmp_path / "warc"))
    assert archives.read_warc(spark, str(tmp_path / "warc")).count() == 0


def test_damaged_arc():
    head = b"filedesc://x 0.0.0.0 20240101000000 text/plain 20\n1 0 y\nURL IP-address\n\n"
    data = head + b"http://a b 1.2.3.4 20240101000000 text/html 3\nabc\nnot a header\n\nhttp://c 1.2.3.4 20240101000000 text/html 99\nshort"
    got = [(f["URL"], block, cut) for f, block, cut in archives.parse_arc(data)]
    assert got == [("http://a b", b"abc", False), ("http://c", b"short", True)]


# Rendering

@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("a < b &amp; c", "a < b & c"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
    ("<ol start=4><li>a</li><li>b</li></ol>", "4. a\n5. b"), ("<pre>x\n  y</pre>z", "x\n  y\n\nz"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>d</table>", "a  b\n   c\nd"),
    ("a<script>'<p>'</script><style>b{}</style><!-- c -->d", "ad"), ("<p hidden>a</p><p style='display: none'>b</p>c", "c"),
    ("<style>.x{display:none}</style><i class='y x'>a</i>b", "b"), ("<b style='visibility:hidden'>a<i style='visibility:visible'>b</i></b>", "b"),
    ("<details>no<summary>s</summary>no</details><details open>yes</details>", "s\nyes"), ("<title>t</title><h1>a</h1>b", "a\n\nb"),
    ("<dl><dt>a<dd>b</dl>", "a\n  b"), ("x</p>y</b>z", "x\n\nyz"), ("<p", ""), ("a<p title='x>b", "a\n\nb"),
])
def test_rendering(html, text):
    assert rendering.render(html) == text


@pytest.mark.parametrize("css,hidden", [
    ("@media print{.x{display:none}}", False), ("@media (max-width:600px){.y, .x{display:none}} .z{color:red}", False),
    ("@media screen and (max-width:600px){.x{display:none}}", False), ("@media not screen{.x{display:none}}", False),
    ("@media print, screen{.x{display:none}}", True), ("@media only screen{.x{display:none}}", True), ("@media all{@media print{.x{display:none}}}", False),
    ("@media not print{.x{display:none}}", True), ("@media print{.y{color:red}} .x{display:none}", True), ("@media print{.y{color:red}}.x{display:none", True),
    ("@import 'a{';.x{display:none}", True), (".y::before{content:'}'} .x{display:none}", True), (".y{color:red;.x{display:none}}", False),
    (".x{@media print{display:none}}", False), ("@container (width<9px){.x{display:none}}", False), ("@layer a{.x{display:none}}", True),
    ("@supports not (a:b){.x{display:none}}", False), ("/* } */.x{color:red;display:none}", True), ("}.x{display:none}", True),
])
def test_rendering_applies_rules_of_every_screen(css, hidden):
    assert rendering.render(f"<style>{css}</style><p class=x>a</p>b") == ("b" if hidden else "a\n\nb")


@pytest.mark.parametrize("html,text", [
    ("<style media=print>.x{display:none}</style><i class=x>a</i>b", "ab"), ("<style media=screen>.x{display:none}</style><i class=x>a</i>b", "b"),
    ("<p>a<svg viewBox='0 0 1 1'><title>no</title>no<rect/><text x=1>b <tspan>c</tspan><tspan x=1 dy=9>d</tspan></text><g><text>e</text></g></svg>f", "a\nb c\nd\ne\nf"),
    ("a<svg><defs><text>no</text></defs><style/><text display=none>no</text><text visibility='hidden'>no</text></svg>b", "ab"),
    ("<style>svg{display:none}</style>a<svg><text>no</text></svg>b", "ab"), ("<svg><foreignObject><p>a</p></foreignObject><text>b</text></svg>c", "a\n\nb\nc"),
    ("<svg><g><p>a</p>b", "a\n\nb"), ("<svg><g>" * 300 + "<text>a", "a"), ("<svg><foreignObject>" * 300 + "a", "a"), ("<table><tr><td><svg><text>a</text></svg><td>b</table>", "a  b"),
])
def test_rendering_of_drawings_and_media(html, text):
    assert rendering.render(html) == text


def test_rendering_keeps_all_words_and_ends():
    deep = "<div><b>" * 3000 + "deep" + "</b></div>" * 3000
    assert rendering.render(deep) == "deep"
    assert "x" in rendering.render("<table><tr><td>" * 300 + "x")
    for nasty in ("<a " * 20_000, "<!--" * 20_000, "<p x=" + "'" * 20_001, "<ul><li>" * 3000, "&" * 20_000, "<table>" * 2000):
        rendering.render(nasty)


def test_extract(spark):
    rows = [(1, "<p>a", "t"), (None, None, "t"), (1, "<p>a", "t")]
    out = rendering.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert edge.pairs(out, "page_id", "text") == sorted([(1, "a"), (None, ""), (1, "a")], key=repr)
