"""The operators that SQL can express, as DuckDB SQL over a table with the columns of ``documents``."""

from __future__ import annotations

from affinis.llm import mixing as _mixing, quality as _quality

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def quality_counts(docs: str) -> str:
    """doc_id, text and the counts of the quality rules."""
    stop = ", ".join(f"'{w}'" for w in _quality.STOP_WORDS)
    return f"""
    WITH split AS MATERIALIZED (SELECT *, row_number() OVER () AS q_row, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
        FROM {docs}),
    single AS (SELECT q_row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
    grams AS (SELECT q_row, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM single
        WINDOW o AS (PARTITION BY q_row ORDER BY i)),
    again AS (SELECT q_row, i FROM (SELECT *, count(*) OVER (PARTITION BY q_row, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
    covered AS (SELECT q_row, count(DISTINCT p) AS n FROM (SELECT q_row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY q_row)
    SELECT split.*, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(list_intersect(words, [{stop}])) AS BIGINT) AS n_stop,
        CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS BIGINT) AS n_ellipsis,
        CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS BIGINT) AS n_bullets
    FROM split LEFT JOIN covered USING (q_row)"""


def _base() -> str:
    return "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _rules() -> str:
    return " AND ".join(
        f"{r.value}::DOUBLE >= {r.low} * {r.per or 1}::DOUBLE AND {r.value}::DOUBLE <= {r.high} * {r.per or 1}::DOUBLE"
        for r in _quality.RULES)


def quality(docs: str) -> str:
    return f"""
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_base()} AS base_failed,
        NOT {_base()} AND {_rules()} AS kept FROM ({quality_counts(docs)})"""


def quality_kept(docs: str) -> str:
    return f"SELECT doc_id, text, lang, source, n_chars FROM ({quality_counts(docs)}) WHERE NOT {_base()} AND {_rules()}"


def _closer(n: int) -> str:
    """One more closing document: per source the row nearest to the gap, then the gap it leaves."""
    before = f"g{n - 1}"
    taken = "".join(f" AND coalesce(r.row_no <> {before}.x{k}, true)" for k in range(1, n))
    kept = "".join(f", x{k}" for k in range(1, n))
    return f"""
    c{n} AS (SELECT source, row_no AS pick, size AS pick_size FROM (
        SELECT r.source, r.row_no, r.size, row_number() OVER (PARTITION BY r.source
            ORDER BY abs(r.size - {before}.gap), r.row_no) AS first
        FROM ranked r JOIN {before} ON r.source IS NOT DISTINCT FROM {before}.source
        WHERE r.row_no >= {before}.edge AND abs(r.size - {before}.gap) < {before}.gap{taken}) WHERE first = 1),
    g{n} AS (SELECT {before}.source, edge, gap - coalesce(pick_size, 0) AS gap{kept}, pick AS x{n}
        FROM {before} LEFT JOIN c{n} ON {before}.source IS NOT DISTINCT FROM c{n}.source)"""


def mixing(docs: str) -> str:
    """Pareto order sampling with the whole order of each source spelled out."""
    weights = ", ".join(str(float(w)) for w in _mixing.WEIGHTS)
    rounds = range(1, _mixing.CLOSERS + 1)
    last = f"g{_mixing.CLOSERS}"
    picked = " OR ".join(f"r.row_no IS NOT DISTINCT FROM {last}.x{k}" for k in rounds)
    return f"""
    WITH slim AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) AS BIGINT) AS size,
            size * 1000 // (size + {_mixing.CONTEXT}) AS worth,
            (('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE
             + 0.5) / 4503599627370496.0 AS u FROM {docs}),
    sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CAST(sum(size * worth) AS BIGINT) AS source_worth FROM slim GROUP BY source),
    weighted AS (SELECT *, source_size * {float(_mixing.REPEATS)} AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized),
    placed AS (SELECT *, ([{weights}])[(place - 1) % {len(_mixing.WEIGHTS)} + 1]::DOUBLE AS weight FROM weighted),
    levels AS (SELECT *, cap / weight AS full_at,
            ({_mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM placed),
    level AS (SELECT first(c ORDER BY full_at, place) AS level FROM levels WHERE c <= full_at),
    plan AS (SELECT source, source_size, source_worth, CASE WHEN level IS NULL OR level * weight >= cap THEN cap ELSE level * weight END AS target
        FROM levels, level),
    shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
        CASE WHEN source_size > 0 THEN source_worth / source_size ELSE 0.0 END AS mean FROM plan),
    slopes AS (SELECT *, CASE WHEN mean > 0 AND mean < 1000 THEN {_mixing.LEAN}::DOUBLE
        * greatest(least(ratio / mean, ({_mixing.REPEATS} - ratio) / (1000 - mean)), 0.0) ELSE 0.0 END AS slope FROM shares),
    asked AS (SELECT slim.*, slopes.* EXCLUDE (source),
        least(greatest(ratio + slope * (worth - mean), 0.0), {float(_mixing.REPEATS)}) AS wanted
        FROM slim JOIN slopes ON slim.source IS NOT DISTINCT FROM slopes.source),
    odds AS (SELECT *, floor(wanted) AS whole, wanted - floor(wanted) AS odds,
        target - sum(size * floor(wanted)) OVER (PARTITION BY source) AS need FROM asked),
    keyed AS (SELECT *, CASE WHEN odds > 0 THEN
            ((u / (1 - u)) / (odds / (1 - odds))) / (1 + (u / (1 - u)) / (odds / (1 - odds))) END AS rank FROM odds),
    ranked AS (SELECT *, row_number() OVER o AS row_no, sum(size) OVER o AS run FROM keyed
        WINDOW o AS (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
    g0 AS (SELECT source, row_no AS edge, CAST(need - (run - size) AS DOUBLE) AS gap FROM ranked
        WHERE rank IS NOT NULL AND need - (run - size) > 0 AND need - (run - size) <= size),
    {", ".join(_closer(n) for n in rounds)}
    SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * (r.whole + CASE WHEN
        {last}.edge IS NOT NULL AND (r.row_no < {last}.edge OR {picked}) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM ranked r LEFT JOIN {last} ON r.source IS NOT DISTINCT FROM {last}.source"""


def line_parts(docs: str) -> str:
    """One row per line: row number of its document, place, text, key, and whether it goes."""
    return f"""
    SELECT *, length(key) >= 10 AND owner IS DISTINCT FROM doc_id AS gone FROM (
        SELECT *, min(doc_id) OVER (PARTITION BY key) AS owner FROM (
            SELECT * EXCLUDE (parts), unnest(parts) AS line, generate_subscripts(parts, 1) AS place,
                translate(trim(unnest(parts), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT *, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs})))"""


def line_dedup(docs: str) -> str:
    return f"""
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM ({line_parts(docs)}) GROUP BY row_no"""


def line_dedup_kept(docs: str) -> str:
    return f"""
    SELECT any_value(doc_id) AS doc_id, CASE WHEN any_value(text) IS NOT NULL THEN
            coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') END AS text,
        any_value(lang) AS lang, any_value(source) AS source,
        CAST(length(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS BIGINT) AS n_chars
    FROM ({line_parts(docs)}) GROUP BY row_no"""


_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"


def _hits(docs: str) -> str:
    """CTEs: words of documents and every hit of an item's window."""
    return f"""
    item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item, least(len(w), 10) AS size,
            array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
    doc_words AS (SELECT *, row_number() OVER () AS row_no, {_ALNUM} AS w FROM {docs}),
    grams AS (SELECT row_no, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
        FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS i
            FROM doc_words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
    hits AS (SELECT row_no, i, grams.size, item FROM grams JOIN windows USING (gram, size))"""


def decontamination(docs: str) -> str:
    return f"""
    WITH {_hits(docs)},
    places AS (SELECT row_no, count(DISTINCT p) AS n FROM (SELECT row_no, unnest(range(i, i + size)) AS p FROM hits) GROUP BY row_no),
    found AS (SELECT row_no, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT row_no, item FROM hits WHERE item IS NOT NULL) GROUP BY row_no)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
    FROM doc_words LEFT JOIN places USING (row_no) LEFT JOIN found USING (row_no)"""


def decontamination_kept(docs: str) -> str:
    return f"""
    WITH {_hits(docs)}
    SELECT doc_id, text, lang, source, n_chars FROM doc_words WHERE row_no NOT IN (SELECT row_no FROM hits)"""


def archives() -> str:
    return """
    WITH sized AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    topped AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM sized)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN top <> page_id THEN top END AS refers_to FROM topped"""


def near_duplicates_kept(docs: str) -> str:
    """All pairs of classes that share a shingle, their similarity, and groups by reachability."""
    return f"""
    WITH RECURSIVE worded AS MATERIALIZED (SELECT *, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}+') AS w FROM {docs}),
    keyed AS (SELECT *, array_to_string(w, ' ') AS k FROM worded WHERE len(w) > 0),
    classes AS MATERIALIZED (SELECT k, any_value(w) AS w, min(row_no) AS c FROM keyed GROUP BY k),
    single AS (SELECT c, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM classes),
    shingles AS MATERIALIZED (SELECT DISTINCT c, g FROM (SELECT c, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' '
            || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM single WINDOW o AS (PARTITION BY c ORDER BY i)) WHERE g IS NOT NULL
        UNION SELECT c, k FROM classes WHERE len(w) < 5),
    sizes AS MATERIALIZED (SELECT c, count(*) AS n FROM shingles GROUP BY c),
    common AS (SELECT a.c AS u, b.c AS v, count(*) AS n FROM shingles a JOIN shingles b USING (g) WHERE a.c <> b.c GROUP BY ALL),
    links AS MATERIALIZED (SELECT u, v FROM common JOIN sizes x ON x.c = u JOIN sizes y ON y.c = v
        WHERE 10 * common.n >= 8 * (x.n + y.n - common.n)),
    reach AS (SELECT c AS u, c AS v FROM classes UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
    grouped AS (SELECT u, min(v) AS grp FROM reach GROUP BY u),
    ranked AS (SELECT keyed.*, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS LAST, row_no) AS place
        FROM keyed JOIN classes USING (k) JOIN grouped ON u = c)
    SELECT doc_id, text, lang, source, n_chars FROM ranked WHERE place = 1
    UNION ALL SELECT doc_id, text, lang, source, n_chars FROM worded WHERE len(w) = 0"""


def pipeline(docs: str) -> str:
    return f"""
    WITH passed AS MATERIALIZED ({quality_kept(docs)}), lined AS MATERIALIZED ({line_dedup_kept("passed")}),
    distinct_docs AS MATERIALIZED ({near_duplicates_kept("lined")}), clean_docs AS MATERIALIZED ({decontamination_kept("distinct_docs")})
    SELECT * FROM ({mixing("clean_docs")})"""


def substring_dedup(docs: str) -> str:
    """All windows of all documents, grouped by their words."""
    return f"""
    WITH split AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words FROM {docs}),
    single AS MATERIALIZED (SELECT row_no, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
    windows AS (SELECT row_no, i, md5(string_agg(w, ' ') OVER o) AS g, count(*) OVER o AS n FROM single
        WINDOW o AS (PARTITION BY row_no ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
    twice AS MATERIALIZED (SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM windows WHERE n = 35) WHERE c > 1),
    gone AS (SELECT DISTINCT row_no, unnest(range(i, i + 35)) AS i FROM twice),
    kept AS (SELECT row_no, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM single ANTI JOIN gone USING (row_no, i) GROUP BY row_no)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (row_no)"""


def ranking(docs: str, items: str, k: int = 10) -> str:
    """The k documents of highest score of each item, scored in whole numbers."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {terms} AS t FROM {docs}),
 k AS (SELECT doc_id, row_number() OVER () AS row_no, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
 s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM k),
 q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM {items})),
 p AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(t) AS term FROM k) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
 m AS (SELECT row_no, doc_id, 10 + (90 * n * docs) // words AS m FROM k, s),
 scored AS (SELECT item_id, row_no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row_no) GROUP BY ALL),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
