"""The queries again as SQL over the given tables, for DuckDB."""

from __future__ import annotations

PARTS: dict[str, str] = {
    "inter": """
        SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
               CAST(floor(value) AS INTEGER) % 11 AS rating, ts
        FROM events""",
    "samples": """
        SELECT *, CASE WHEN rating >= 6 OR rating = 0 THEN 1 ELSE 0 END AS label FROM inter""",
    "big": """
        SELECT l_orderkey, l_linenumber, l_partkey AS item_id, l_suppkey, l_extendedprice, l_shipdate,
               o_custkey AS user_id, o_orderdate AS ts, CAST(l_quantity AS INTEGER) % 11 AS rating
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "big_samples": """
        SELECT *, CASE WHEN rating >= 6 OR rating = 0 THEN 1 ELSE 0 END AS label FROM big""",
    "votes": "SELECT l_partkey, count(*) AS votes FROM lineitem GROUP BY 1",
    "items": """
        SELECT p_partkey AS id, p_name AS name, (p_partkey % 100) / 10.0 AS score, coalesce(votes, 0) AS votes,
               1990 + p_size % 30 AS release_year, p_brand, p_type, p_size
        FROM part LEFT JOIN votes ON p_partkey = l_partkey""",
    "raw_tags": """
        SELECT p_partkey AS id, 0 AS pos, p_type AS tag, p_size AS n FROM part
        UNION ALL SELECT p_partkey, 1, p_brand, p_size % 7 + 1 FROM part
        UNION ALL SELECT p_partkey, 2, split_part(p_name, ' ', 1), p_partkey % 11 FROM part
        UNION ALL SELECT p_partkey, 3, split_part(p_name, ' ', 2), p_partkey % 5 FROM part""",
    "tag_counts": "SELECT id, tag, arg_max(n, pos) AS n FROM raw_tags GROUP BY id, tag",
    "ranked_tags": """
        SELECT id, tag, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, tag) AS r FROM tag_counts""",
    "top_tags": """
        SELECT id, max(CASE WHEN r = 1 THEN tag END) AS item_tag_1, max(CASE WHEN r = 2 THEN tag END) AS item_tag_2,
               max(CASE WHEN r = 3 THEN tag END) AS item_tag_3, string_agg(tag, ',' ORDER BY r) AS tags
        FROM ranked_tags GROUP BY id""",
    "joined": """
        SELECT s.*, i.score, i.votes, i.release_year, t.item_tag_1, t.item_tag_2, t.item_tag_3
        FROM samples s JOIN items i ON s.item_id = i.id JOIN top_tags t ON s.item_id = t.id""",
    "user_tags": """
        SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS user_tag_1,
               max(CASE WHEN r = 2 THEN event_type END) AS user_tag_2,
               max(CASE WHEN r = 3 THEN event_type END) AS user_tag_3,
               max(CASE WHEN r = 4 THEN event_type END) AS user_tag_4,
               max(CASE WHEN r = 5 THEN event_type END) AS user_tag_5
        FROM (SELECT user_id, event_type,
                     row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
              FROM events GROUP BY user_id, event_type)
        GROUP BY user_id""",
    "item_emb": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings",
    "item_numbers": "SELECT id, unnest(emb) AS v, generate_subscripts(emb, 1) AS pos FROM item_emb",
    "user_sizes": "SELECT user_id, count(*) AS n FROM inter GROUP BY user_id",
    "user_dims": """
        SELECT user_id, pos, sum(v) AS s FROM (
            SELECT user_id, unnest(emb) AS v, generate_subscripts(emb, 1) AS pos
            FROM inter JOIN item_emb ON item_id = id) GROUP BY user_id, pos""",
    "user_emb": """
        SELECT user_id AS id, list(s / n ORDER BY pos) AS emb FROM user_dims JOIN user_sizes USING (user_id)
        GROUP BY user_id""",
    "recalled": """
        SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
        FROM (SELECT u.id AS user_id, i.id AS item_id, round(list_cosine_similarity(u.emb, i.emb), 6) AS score
              FROM user_emb u, item_emb i)
        WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM inter)""",
    "popular": """
        SELECT id, row_number() OVER (ORDER BY votes DESC, score DESC, id) AS rank FROM items
        ORDER BY votes DESC, score DESC, id LIMIT 5000""",
    "all_users": "SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM events",
    "cold": "SELECT user_id FROM all_users WHERE user_id NOT IN (SELECT id FROM user_emb)",
    "changes": """
        SELECT s_suppkey * 30 AS id, s_name AS name, round(s_acctbal, 2) AS score,
               CAST(s_nationkey AS BIGINT) AS votes, 1 AS version FROM supplier
        UNION ALL SELECT s_suppkey * 60, s_name || ' again', round(s_acctbal, 2), NULL, 2 FROM supplier""",
    "change": """
        SELECT id, name, score, votes FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM changes) WHERE r = 1""",
    "tag_dict": """
        SELECT name, CAST(count(*) AS INTEGER) AS "count" FROM (
            SELECT split_part(p_name, ' ', 1) AS name FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part
            UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part
            UNION ALL SELECT 'part ' || CAST(p_partkey AS VARCHAR) FROM part) GROUP BY name""",
}

PARTS["after_0"] = "SELECT id, name, score, votes FROM items"
for _k in range(5):
    PARTS[f"upserts_{_k}"] = f"""
        SELECT id, name, score, votes FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM changes WHERE id % 7 = {_k}) WHERE r = 1"""
    PARTS[f"upserted_{_k}"] = f"""
        SELECT * FROM after_{_k} WHERE id NOT IN (SELECT id FROM upserts_{_k}) UNION ALL SELECT * FROM upserts_{_k}"""
    PARTS[f"after_{_k + 1}"] = f"""
        SELECT id, coalesce(s_name || ' patched', name) AS name, score, votes
        FROM upserted_{_k} LEFT JOIN supplier ON s_suppkey * 45 = id AND s_suppkey % 5 = {_k}
        WHERE id NOT IN (SELECT s_suppkey * 70 FROM supplier WHERE s_suppkey % 5 = {_k})"""
PARTS["own_delivery"] = "SELECT *, least((day(ts) - 1) // 10, 2) AS own FROM inter"
PARTS["delivered"] = """
    SELECT event_id, user_id, item_id, rating, ts, CASE WHEN event_id % 20 = 7 THEN least(own + 1, 2) ELSE own END AS b FROM own_delivery
    UNION ALL SELECT event_id, user_id, item_id, rating, ts, own + 1 FROM own_delivery WHERE event_id % 6 = 1 AND own < 2"""
PARTS["marks"] = """
    SELECT b AS of, (SELECT max(ts) FROM delivered x WHERE x.b < k.b) - INTERVAL 3 DAY AS mark FROM (SELECT DISTINCT b FROM delivered) k"""
PARTS["late_or_not"] = "SELECT delivered.*, mark, coalesce(ts < mark, false) AS late FROM delivered JOIN marks ON b = of"
PARTS["fates"] = """
    SELECT *, CASE WHEN late THEN 'late' WHEN row_number() OVER (PARTITION BY event_id, late ORDER BY b) = 1 THEN 'kept' ELSE 'repeated' END AS fate
    FROM late_or_not"""


def _features(source: str, order: str, carried: str) -> str:
    """History and running figures over a sample table."""
    liked = f"list(item_id) FILTER (WHERE label = 1) OVER (PARTITION BY user_id ORDER BY {order} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"
    upto = "OVER (PARTITION BY user_id ORDER BY ts)"
    shown = ", ".join(f"list_reverse(h)[{i}] AS user_rated_item_{i}" for i in range(1, 6))
    return f"""
        SELECT {carried}, {shown}, user_rating_count, user_avg_rating, user_rating_stddev FROM (
            SELECT *, {liked} AS h, count(*) {upto} AS user_rating_count, avg(rating) {upto} AS user_avg_rating,
                   coalesce(stddev_samp(rating) {upto}, 0) AS user_rating_stddev
            FROM {source})
        WHERE user_rating_count > 1"""


PARTS["training"] = _features(
    "joined", "ts, event_id",
    "event_id, user_id, item_id, rating, label, ts, votes, score, item_tag_1, item_tag_2, item_tag_3",
)
PARTS["training_big"] = _features(
    "big_samples", "ts, l_orderkey, l_linenumber, item_id, l_suppkey, l_extendedprice, l_shipdate",
    "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, user_id, item_id, rating, label, ts",
)
PARTS["plain_features"] = _features("samples", "ts, event_id", "event_id, user_id, item_id, rating, label, ts")
PARTS["item_features"] = """
    SELECT item_id, item_tag_1, item_tag_2, item_tag_3, votes, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) AS r FROM training)
    WHERE r = 1"""
RATED = ", ".join(f"coalesce(user_rated_item_{i}, 0) AS user_rated_item_{i}" for i in range(1, 6))
PARTS["user_features"] = f"""
    SELECT user_id, {RATED}, user_rating_count, user_avg_rating, user_rating_stddev FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM training)
    WHERE r = 1"""
PARTS["days"] = "SELECT *, epoch_ms(date_trunc('day', ts)) AS day_ms FROM training"
PARTS["split_at"] = """
    SELECT min(day_ms) AS split_ms FROM (
        SELECT day_ms, sum(count(*)) OVER (ORDER BY day_ms) AS upto, sum(count(*)) OVER () AS total
        FROM days GROUP BY day_ms) WHERE upto >= ceil(total * CAST(0.8 AS DOUBLE))"""
PARTS["recall_300"] = "SELECT * FROM recalled WHERE rank <= 300"
TAGS = ", ".join(f"coalesce(user_tag_{i}, '') AS user_tag_{i}" for i in range(1, 6))
TAG_NAMES = ", ".join(f"user_tag_{i}" for i in range(1, 6))
PARTS["eligible"] = f"""
    SELECT c.user_id, c.item_id, c.rank, f.votes, f.score, f.item_tag_1, f.item_tag_2, f.item_tag_3,
           u.user_rating_count, u.user_avg_rating, u.user_rating_stddev, u.user_rated_item_1, {TAGS},
           row_number() OVER (PARTITION BY c.user_id ORDER BY c.rank) - 1 AS position
    FROM recall_300 c JOIN item_features f USING (item_id) JOIN user_features u USING (user_id)
        LEFT JOIN user_tags USING (user_id)
    WHERE c.item_id < 323877"""

PARTS["vocabulary"] = """
    SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM tag_dict WHERE "count" > 1"""


def _needs(sql: str) -> list[str]:
    """The parts a statement uses, in the order they are defined."""
    import re

    seen: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in PARTS:
            if name in words and name not in seen:
                seen.add(name)
                todo.append(PARTS[name])
    return [name for name in PARTS if name in seen]


def statement(sql: str) -> str:
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in _needs(sql))
    return f"WITH {parts}\n{sql}" if parts else sql


STATS = "user_rating_count, round(user_avg_rating, 6) AS user_avg_rating, round(user_rating_stddev, 6) AS user_rating_stddev"
RATED_PLAIN = ", ".join(f"user_rated_item_{i}" for i in range(1, 6))
PAGE = """
    SELECT user_id, item_id, rank, total, 40 < total AS has_more FROM (
        SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM ({lists}))
    WHERE rank > 20 AND rank <= 40"""
BIG_KEY = "l_orderkey, l_linenumber, item_id, l_suppkey, l_extendedprice, epoch_us(l_shipdate) AS shipdate_us"
SPLIT = """
    SELECT event_id, user_id, item_id, rating, label FROM days, split_at WHERE day_ms {op} split_ms"""
WORDS = "' ' || array_to_string(regexp_extract_all(lower({text}), '(\\p{{Han}}|[\\p{{L}}\\p{{N}}]+)', 1), ' ')"

SQL: dict[str, str] = {
    "explode_collects": """
        SELECT user_id, item_id, rating, epoch_us(ts) AS ts_us, user_tag_1, user_tag_2, user_tag_3, user_tag_4, user_tag_5
        FROM inter JOIN user_tags USING (user_id)""",
    "label": "SELECT event_id, rating, label FROM samples",
    "rating_histogram": """
        SELECT rating, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM inter GROUP BY rating""",
    "rating_histogram_big": """
        SELECT rating, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM big GROUP BY rating""",
    "user_history": """
        SELECT event_id, user_id, coalesce(array_to_string(list_reverse(h), ','), '') AS history FROM (
            SELECT *, list(item_id) FILTER (WHERE label = 1) OVER (
                PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS h
            FROM samples)""",
    "user_history_ties": f"""
        SELECT {BIG_KEY}, user_id, coalesce(array_to_string(list_reverse(h), ','), '') AS history FROM (
            SELECT *, list(item_id) FILTER (WHERE label = 1) OVER (
                PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, item_id, l_suppkey, l_extendedprice, l_shipdate
                ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS h
            FROM big_samples)""",
    "user_running_stats": f"""
        SELECT {BIG_KEY}, user_id, user_rating_count, round(user_avg_rating, 6) AS user_avg_rating,
               round(user_rating_stddev, 6) AS user_rating_stddev FROM (
            SELECT *, count(*) OVER w AS user_rating_count, avg(rating) OVER w AS user_avg_rating,
                   coalesce(stddev_samp(rating) OVER w, 0) AS user_rating_stddev
            FROM big_samples WINDOW w AS (PARTITION BY user_id ORDER BY ts))""",
    "formatted_stats": """
        SELECT event_id, format('{:,.2f}', avg(rating) OVER w) AS user_avg_rating,
               format('{:,.2f}', coalesce(stddev_samp(rating) OVER w, 0)) AS user_rating_stddev
        FROM inter WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
    "training_samples": f"""
        SELECT event_id, user_id, item_id, rating, label, epoch_us(ts) AS ts_us, votes, round(score, 6) AS score,
               item_tag_1, item_tag_2, item_tag_3, {RATED_PLAIN}, {STATS} FROM training""",
    "training_samples_ties": f"""
        SELECT {BIG_KEY}, user_id, rating, label, epoch_us(ts) AS ts_us, {RATED_PLAIN}, {STATS} FROM training_big""",
    "release_year_stats": """
        SELECT event_id, round(coalesce(avg(release_year) OVER w, 0), 6) AS user_avg_release_year,
               round(coalesce(stddev_samp(release_year) OVER w, 0), 6) AS user_release_year_stddev
        FROM joined WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""",
    "favourite_tags": """
        SELECT event_id, coalesce(string_agg(tag, ',' ORDER BY n DESC, tag), '') AS tags FROM (
            SELECT a.event_id, t.tag, count(t.tag) AS n
            FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM joined) a
            LEFT JOIN (SELECT user_id, item_id, label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM joined) b
              ON a.user_id = b.user_id AND b.r BETWEEN a.r - 100 AND a.r - 1 AND b.label = 1
            LEFT JOIN tag_counts t ON t.id = b.item_id
            GROUP BY a.event_id, t.tag) GROUP BY event_id""",
    "item_tags": "SELECT id, tags, item_tag_1, item_tag_2, item_tag_3 FROM top_tags",
    "tag_frequency": """
        SELECT user_id, tag, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS rank FROM (
            SELECT user_id, tag, count(*) AS n FROM samples JOIN tag_counts ON item_id = id WHERE label = 1
            GROUP BY user_id, tag)""",
    "sample_item_join": """
        SELECT event_id, item_id, label, votes, round(score, 6) AS score, release_year, item_tag_1, item_tag_2, item_tag_3
        FROM joined""",
    "sample_item_join_big": """
        SELECT item_id, item_tag_1, count(*) AS n, sum(label) AS likes, max(votes) AS votes
        FROM big_samples b JOIN items i ON b.item_id = i.id JOIN top_tags t ON t.id = i.id GROUP BY item_id, item_tag_1""",
    "release_year": "SELECT id, CAST(release_year AS INTEGER) AS release_year FROM items",
    "split_train": SPLIT.format(op="<="),
    "split_test": SPLIT.format(op=">"),
    "split_point": "SELECT split_ms AS split_at FROM split_at",
    "train_csv": f"""
        SELECT user_id, item_id, rating, label, votes, round(score, 6) AS score, item_tag_1, item_tag_2, item_tag_3,
               {RATED}, user_rating_count,
               CAST(replace(format('{{:,.2f}}', user_avg_rating), ',', '') AS DOUBLE) AS user_avg_rating,
               CAST(replace(format('{{:,.2f}}', user_rating_stddev), ',', '') AS DOUBLE) AS user_rating_stddev
        FROM days, split_at WHERE day_ms <= split_ms""",
    "latest_item_features": "SELECT item_id, item_tag_1, item_tag_2, item_tag_3, votes, round(score, 6) AS score FROM item_features",
    "latest_user_features": f"SELECT user_id, {RATED_PLAIN}, {STATS} FROM user_features",
    "kv_point_read": """
        SELECT p_partkey AS id, f.item_id IS NOT NULL AS found, f.item_tag_1, f.item_tag_2, f.item_tag_3, f.votes,
               round(f.score, 6) AS score
        FROM part LEFT JOIN item_features f ON p_partkey = item_id""",
    "kv_prefix_scan": f"SELECT user_id AS id, {RATED_PLAIN}, {STATS} FROM user_features",
    "kv_prefix_count": "SELECT count(*) AS n FROM item_emb",
    "kv_vectors": "SELECT id, len(emb) AS dims, round(list_sum(emb), 6) AS total FROM item_emb",
    "tag_map": "SELECT id, tag, n FROM tag_counts",
    "training_samples_nested": f"""
        SELECT user_id, item_id, rating, label, epoch_us(ts) AS ts_us, votes, round(score, 6) AS score, item_tag_1, item_tag_2,
               item_tag_3, {RATED_PLAIN}, {STATS}, {TAG_NAMES} FROM training JOIN user_tags USING (user_id)""",
    "latest_user_features_nested": f"""
        SELECT user_id, {RATED_PLAIN}, {STATS}, {TAGS} FROM user_features JOIN user_tags USING (user_id)""",
    "score_payload": f"""
        SELECT user_id, position, item_id, votes, round(score, 6) AS score, item_tag_1, item_tag_2, item_tag_3,
               {STATS}, user_rated_item_1, {TAG_NAMES} FROM eligible""",
    "score_parse": "SELECT user_id, item_id, rank, round(score / 10, 6) AS score FROM eligible",
    "user_embedding": """
        SELECT id, len(emb) AS dims, round(list_sum(emb), 6) AS total,
               array_to_string(list_transform(emb, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS micros
        FROM user_emb""",
    "user_embedding_sparse": """
        SELECT user_id AS id, round(sum(v) / max(n), 6) AS total FROM (
            SELECT user_id, list_sum(emb) AS v, 0 AS n FROM big JOIN item_emb ON item_id = id
            UNION ALL SELECT user_id, NULL, count(*) FROM big GROUP BY user_id)
        GROUP BY user_id HAVING sum(v) IS NOT NULL""",
    "user_embedding_weighted": """
        SELECT user_id AS id, round(sum(w * v) / sum(w), 6) AS total, round(sum(w * f) / sum(w), 6) AS first FROM (
            SELECT user_id, list_sum(emb) AS v, emb[1] AS f,
                   (CASE WHEN rating > 0 THEN rating ELSE 6 END)
                   * exp(-((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 86400000000.0) / 90.0) AS w
            FROM inter JOIN item_emb ON item_id = id) GROUP BY user_id""",
    "embedding_text_roundtrip": """
        SELECT id, pos, round(v, 6) AS v FROM (SELECT id, unnest(emb) AS v, generate_subscripts(emb, 1) AS pos FROM item_emb)""",
    "recall_topk": "SELECT user_id, item_id, score, rank FROM recall_300",
    "similar_items": """
        SELECT id, similar_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, similar_id) AS rank FROM (
                SELECT a.id, b.id AS similar_id, round(list_cosine_similarity(a.emb, b.emb), 6) AS score
                FROM item_emb a, item_emb b WHERE a.id <> b.id)) WHERE rank <= 2000""",
    "similar_items_page": """
        SELECT id, similar_id, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, similar_id) AS rank FROM (
                SELECT a.id, b.id AS similar_id, round(list_cosine_similarity(a.emb, b.emb), 6) AS score
                FROM item_emb a, item_emb b WHERE a.id <> b.id)) WHERE rank > 5 AND rank <= 15""",
    "similar_users": """
        SELECT id, similar_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, similar_id) AS rank FROM (
                SELECT a.id, b.id AS similar_id, round(list_cosine_similarity(a.emb, b.emb), 6) AS score
                FROM user_emb a, user_emb b WHERE a.id <> b.id)) WHERE rank <= 1000""",
    "cosine": """
        SELECT event_id, round(list_cosine_similarity(u.emb, i.emb), 6) AS cosine
        FROM inter JOIN user_emb u ON u.id = user_id JOIN item_emb i ON i.id = item_id""",
    "recommend": PAGE.format(lists="""
        SELECT user_id, item_id, rank FROM recalled WHERE rank <= 1000
        UNION ALL SELECT user_id, id, rank FROM cold, popular WHERE rank <= 1000"""),
    "recommend_unknown_model": PAGE.format(lists="""
        SELECT user_id, item_id, rank FROM recalled WHERE rank <= 300
        UNION ALL SELECT user_id, id, rank FROM cold, popular WHERE rank <= 1000"""),
    "cold_start": "SELECT user_id, id AS item_id, rank FROM cold, popular WHERE rank <= 1000",
    "popularity": "SELECT id, rank FROM popular",
    "page": """
        SELECT user_id, item_id, rank, total, 310 < total AS has_more FROM (
            SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM recalled WHERE rank <= 1000)
        WHERE rank > 290 AND rank <= 310""",
    "list_text": "SELECT user_id, item_id, rank FROM recalled WHERE rank <= 1000",
    "hydrate": """
        SELECT user_id, rank, i.id AS api_id, i.name AS name_cn FROM recall_300 LEFT JOIN items i ON item_id = i.id""",
    "search": """
        SELECT id, name, CAST(1 AS INTEGER) AS match_at FROM items WHERE starts_with(lower(name), 'small ri')
        ORDER BY votes DESC, score DESC, id LIMIT 10""",
    "suggest": """
        SELECT id, name FROM (
            SELECT id, name, votes, score, CASE WHEN starts_with(name, 'r') THEN 1 ELSE 2 END AS m FROM items
            WHERE starts_with(split_part(name, ' ', 1), 'r') OR starts_with(split_part(name, ' ', 2), 'r'))
        ORDER BY m, votes DESC, score DESC, id LIMIT 10""",
    "text_matches": f"""
        SELECT doc_id, CAST(length(h) - length(replace(h, ' ', '')) + 1 AS INTEGER) AS match_at FROM (
            SELECT doc_id, substr(words, 1, instr(words, ' of the by') - 1) AS h FROM (
                SELECT doc_id, {WORDS.format(text='text')} AS words FROM documents)
            WHERE contains(words, ' of the by'))""",
    "documents_after_changes": "SELECT id, name, round(score, 6) AS score, votes FROM after_5",
    "bucket_point_read": "SELECT id, name, round(score, 6) AS score, votes FROM items WHERE id IN (SELECT id FROM changes)",
    "split_point_daily": """
        SELECT count(*) AS n, count(DISTINCT (event_id % 3, ts::DATE)) AS sketches, true AS within_error FROM training""",
    "stream_fates": """
        SELECT b AS batch_id, count(*) AS given, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'late') AS late,
               count(*) FILTER (fate = 'repeated') AS repeated, epoch_us(min(mark)) AS watermark_us, epoch_us(max(ts) FILTER (fate = 'kept')) AS last_us
        FROM fates GROUP BY b""",
    "stream_late_rows": "SELECT b AS batch_id, event_id, user_id, item_id, rating, epoch_us(ts) AS ts_us FROM fates WHERE fate = 'late'",
    "stream_state_features": f"""
        SELECT user_id, {RATED}, {STATS}, epoch_us(ts) AS last_us FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM plain_features)
        WHERE r = 1""",
    "recall_tiles": "SELECT user_id, item_id, score, rank FROM recalled WHERE rank <= 50",
    "similar_items_tiles": """
        SELECT id, similar_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, similar_id) AS rank FROM (
                SELECT a.id, b.id AS similar_id, round(list_cosine_similarity(a.emb, b.emb), 6) AS score
                FROM item_emb a, item_emb b WHERE a.id <> b.id)) WHERE rank <= 20""",
    "item_graph": "SELECT id, 10 AS n, 10 AS right_scores, true AS recall_reached FROM item_emb",
    "find_all": "SELECT id, name, round(score, 6) AS score, votes, 4 AS n_tags FROM items",
    "vector_sums": """
        SELECT a.id, CAST(a.pos - 1 AS INTEGER) AS pos, round(a.v + 0.5::DOUBLE * b.v, 6) AS value
        FROM item_numbers a JOIN item_numbers b ON b.id = a.id + 1 AND b.pos = a.pos""",
    "recall_catalogue": """
        SELECT user_id, item_id, score, r AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM recalled
            WHERE item_id % 3 = 0 AND item_id IN (SELECT id FROM items)) WHERE r <= 50""",
    "recommend_stored": """
        SELECT user_id, item_id, 51 - rank AS rank, 'stored' AS source FROM recalled WHERE rank <= 50 AND user_id % 4 = 0
        UNION ALL SELECT user_id, item_id, rank, 'scored' FROM recalled WHERE rank <= 100 AND user_id % 4 <> 0
        UNION ALL SELECT user_id, id, rank, 'popular' FROM cold, popular WHERE rank <= 100""",
    **{f"{name}_lists": """
        SELECT id AS user_id, 'scored' AS source, 20 AS n, 1 AS first_rank, 20 AS last_rank, 20 AS items, 0 AS collected, 0 AS unknown FROM user_emb
        UNION ALL SELECT user_id, 'popular', 20, 1, 20, 20, 0, 0 FROM cold""" for name in ("recommend_wide_deep", "recommend_neural_cf")},
    "item_detail": """
        SELECT k.id, i.id IS NOT NULL AS found, i.name,
               CASE WHEN i.id IS NOT NULL THEN 'brand=' || p_brand || ';size=' || CAST(p_size AS VARCHAR) || ';type=' || p_type END AS info
        FROM (SELECT DISTINCT id FROM changes) k LEFT JOIN items i ON i.id = k.id""",
    "user_profile": """
        SELECT a.user_id, e.user_id IS NOT NULL AS found, e.user_id AS id, 'user ' || CAST(e.user_id AS VARCHAR) AS nickname
        FROM all_users a LEFT JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = a.user_id""",
    "find_one": "SELECT id, name FROM items WHERE id = 0",
    "upsert": """
        SELECT id, name, round(score, 6) AS score, votes FROM items WHERE id NOT IN (SELECT id FROM changes)
        UNION ALL SELECT id, name, round(score, 6), votes FROM change""",
    "patch": """
        SELECT i.id, coalesce(c.name, i.name) AS name, round(coalesce(c.score, i.score), 6) AS score,
               coalesce(c.votes, i.votes) AS votes
        FROM items i LEFT JOIN (SELECT id, arg_max(name, version) FILTER (name IS NOT NULL) AS name,
                arg_max(score, version) FILTER (score IS NOT NULL) AS score,
                arg_max(votes, version) FILTER (votes IS NOT NULL) AS votes FROM changes GROUP BY id) c ON c.id = i.id""",
    "delete": """
        SELECT id, name, round(score, 6) AS score, votes FROM items WHERE id NOT IN (SELECT id FROM changes)""",
    "get_by_id": """
        SELECT id, name, round(score, 6) AS score, votes FROM items WHERE id IN (SELECT id FROM changes)""",
    "item_sequences": """
        SELECT user_id, CAST(floor((r - 1) / 1000) AS INTEGER) AS segment, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY r) AS items
        FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM inter)
        GROUP BY user_id, floor((r - 1) / 1000)""",
    "item_sequences_nested": """
        SELECT user_id, CAST(floor(event_id / 64) AS BIGINT) AS page, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts DESC) AS items
        FROM inter GROUP BY user_id, floor(event_id / 64)""",
    "tag_vocabulary": 'SELECT name FROM tag_dict WHERE "count" > 1',
    "item_id_text": "SELECT CAST(id AS VARCHAR) AS id FROM items",
    "catalogue": "SELECT id AS item_id FROM items",
    "split_point_sketch": "SELECT true AS within_error",
    "item2vec": "SELECT item_id AS id, 20 AS dims FROM inter GROUP BY item_id HAVING count(*) >= 5",
    "lsh_buckets": "SELECT id, 3 AS tables FROM item_emb",
    "nearest_items": "SELECT 5 AS n, true AS itself, true AS exact_distances",
    "cross_feature": """
        SELECT event_id, ('0x' || substr(md5(item_id || '|' || coalesce(user_rated_item_1, 0)), 1, 15))::BIGINT % 10000 AS bucket
        FROM training""",
    **{name: f"SELECT event_id, user_id, item_id, label, true AS in_range FROM ({SPLIT.format(op='>')})"
       for name in ("wide_deep", "embedding_mlp", "ncf", "deepfm")},
    "two_tower": f"""
        SELECT event_id, user_id IN (SELECT user_id FROM ({SPLIT.format(op='<=')})) AND item_id IN (
            SELECT item_id FROM ({SPLIT.format(op='<=')})) AS known FROM ({SPLIT.format(op='>')})""",
    "model_metrics": "SELECT true AS loss_sound, true AS accuracy_sound, true AS roc_auc_sound, true AS pr_auc_sound",
    "shown_predictions": "SELECT 12 AS n, true AS worded_right",
    "tag_one_hot": """
        SELECT event_id, coalesce(a.i, -1) AS item_tag_1_at, coalesce(b.i, -1) AS item_tag_2_at,
               coalesce(c.i, -1) AS item_tag_3_at
        FROM training LEFT JOIN vocabulary a ON item_tag_1 = a.name LEFT JOIN vocabulary b ON item_tag_2 = b.name
        LEFT JOIN vocabulary c ON item_tag_3 = c.name""",
    "stream_user_features": """
        SELECT user_id, count(*) AS user_rating_count, round(avg(rating), 6) AS user_avg_rating,
               round(coalesce(stddev_samp(rating), 0), 6) AS user_rating_stddev, epoch_us(max(ts)) AS last_us
        FROM inter GROUP BY user_id""",
    "stream_last_positives": f"""
        SELECT user_id, {RATED}, {STATS} FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM plain_features)
        WHERE r = 1""",
    "stream_refresh": "SELECT user_id, item_id, rank FROM recall_300",
    "fresh_recs": """
        SELECT user_id, item_id, rank FROM recall_300 JOIN (
            SELECT user_id, max(ts) AS computed_at FROM events GROUP BY user_id) USING (user_id)
        WHERE computed_at + INTERVAL 300 SECOND > (SELECT max(ts) FROM events)""",
}


# From the index as from the scan.
SQL |= {f"{name}_indexed": SQL[name] for name in ("search", "suggest", "text_matches")}


def oracle_sql() -> dict[str, str]:
    return {name: statement(sql) for name, sql in SQL.items()}
