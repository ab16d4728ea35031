"""SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

WORD = "[\\x20\\x09-\\x0D]+"
WORDS = "list_filter(string_split_regex({0}, '" + WORD + "'), lambda w: w <> '')"

OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, text, source, {WORDS.format('text')} AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
split_lines AS (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, text, source, {WORDS.format('lower(line)')} AS w FROM split_lines),
frequent AS (SELECT source, array_to_string(w, ' ') AS x FROM lines WHERE len(w) > 0 GROUP BY ALL HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'text ' || text)) > 50),
lost AS (SELECT doc_id, sum(len(w)) AS n FROM lines JOIN frequent ON frequent.x = array_to_string(w, ' ') AND frequent.source IS NOT DISTINCT FROM lines.source WHERE len(w) > 0 GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, text FROM w),
s AS (SELECT doc_id, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d)),
b AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words FROM m JOIN s USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_words <= 0.5 * n_words AS kept, lost_words FROM b"""

OP5 = """WITH d AS (SELECT vec_id, embedding AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.e[i] > 0) <> (d.e[i] > 0) AS INTEGER))) AS INTEGER) AS distance FROM d AS q, d WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10"""

OP8 = """WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS owner FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND owner <> page_id THEN owner END AS refers_to FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op5_exact_topk": OP5, "op8_warc_salvage": OP8}
