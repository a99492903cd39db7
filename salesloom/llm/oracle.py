"""SQL of another engine (DuckDB) for the operators that SQL can express.

It shares nothing with the operators but the fixed word list of the quality rules.
"""

from __future__ import annotations

from salesloom.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))

QUALITY = rf"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS gram FROM split, unnest(range(1, len(ws) - 1)) AS t(i)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
base AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           len(list_filter(ws, lambda w: w IN ({_STOP})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines
    FROM split LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * n_symbols <= 10 * n_words AND 100 * n_stop_words >= 6 * n_words
          AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_dup_lines <= 70 * n_lines AS kept
FROM judged
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(ws[i:i + 12], ' ') AS gram
    FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
    SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram
    FROM docs, sizes, unnest(range(1, len(ws) - size + 2)) AS t(i)),
hits AS (SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, unnest(range(size)) AS t(k) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(w.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(w.n, 0) > 0 AND 20 * coalesce(w.n, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit_words w USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
typed AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM typed
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
grams AS (
    SELECT lang, 1 AS words, unnest(ws) AS phrase FROM pieces
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))) FROM pieces
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) FROM pieces
    UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score
    FROM f c, unnest(range(1, c.words)) AS s(k), f x, f y
    WHERE c.words > 1 AND x.lang = c.lang AND y.lang = c.lang
      AND x.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ')
      AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase, max(a) AS longer
    FROM f, unnest(range(2, words)) AS s(k), unnest(range(1, words - k + 2)) AS t(i) WHERE words > 2 GROUP BY ALL),
kept AS (
    SELECT w.* FROM weakest w LEFT JOIN longer o USING (lang, phrase)
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * w.a)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": QUALITY, "op4_decontamination": CONTAMINATION, "op8_warc": WARC, "op13_collocations": PHRASES}
