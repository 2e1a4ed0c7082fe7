"""DuckDB SQL for the queries of the operators that SQL can express whole.

The other queries rest on classifiers, tokenizers, fingerprints, automata, alignments or mined rules; their tests hold
them against brute force. What fixed rules decide in three of them is held against SQL by queries of its own.
"""

from __future__ import annotations

QUALITY = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
      FROM w LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 4 * word_chars OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_upper > 60 * word_chars) AS kept
FROM b
"""

CHAT = r"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
             replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>') AS head FROM n),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
             coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(body) + length(head) + length('<|im_start|>') + length('<|im_end|>') + 2) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM a
"""


LICENSES = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' AND ws[i + 1] = 'by') AS a, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS b,
  list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved') AS c FROM w)
SELECT doc_id, len(ws) AS n_words, len(a) + len(b) + len(c) AS n_base, list_min(list_concat(a, b, c)) - 1 AS first_word, list_max(list_concat(a, b, c)) - 1 AS last_word,
  array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p
"""

PERSONAL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(y AS HUGEINT), 999) > 255)) = 0)) AS n_ip,
  list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 14 AND 19) AS cards,
  len(list_filter(list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 10 AND 15)) AS n_phone FROM d)
SELECT doc_id, n_email, n_ip, len(list_filter(cards, lambda c: list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN c[length(c) - i + 1]::INT ELSE c[length(c) - i + 1]::INT * 2 // 10 + c[length(c) - i + 1]::INT * 2 % 10 END)) % 10 = 0)) AS n_card, n_phone FROM m
"""

URLS = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT p.*, v.* FROM p LEFT JOIN (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS v(verdict, h, q)
  ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q))
SELECT page_id, host, path, h || q AS rule, verdict FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) = 1
"""


def crc32(text: str) -> str:
    """The CRC-32 of a string's UTF-8 bytes: each byte is mixed in, then eight shifts follow."""
    steps = f"flatten(list_transform(range(0, length(hex({text})) // 2), lambda i: [CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


IMPORTANCE = rf"""
WITH f AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), coalesce(text, '') FROM benchmark),
d AS (SELECT side, doc_id, rid, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM f),
w AS (SELECT side, rid, unnest(ws) AS w FROM d),
k AS MATERIALIZED (SELECT w, {crc32("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM w)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM w JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM n) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM n) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n),
x AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN k USING (w) JOIN g USING (bucket) WHERE side = 'd' GROUP BY rid),
r AS (SELECT doc_id, rid, len(ws) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN x USING (rid) WHERE side = 'd'),
o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r LEFT JOIN o USING (rid)
"""


def vector_codes(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """SQL of op12 for vectors of parts * width components: rounds of assignment and floored means."""
    distance = " + ".join(f"(v[{i}] - c[{i}]) * (v[{i}] - c[{i}])" for i in range(1, width + 1))
    means = ", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in range(1, width + 1))
    with_ = [
        f"""e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT vec_id, p, x[{width} * p + 1 : {width} * p + {width}] AS v FROM e, (SELECT unnest(range({parts})) AS p))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < {entries})",
        "c0 AS MATERIALIZED (SELECT p, k, v AS c FROM v JOIN s USING (vec_id))",
    ]
    for r in range(rounds + 1):
        with_.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min(({distance}) * {entries} + k) AS m FROM v JOIN c{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            moved = f"SELECT p, m % {entries} AS k, [{means}] AS moved FROM a{r} GROUP BY p, m % {entries}"
            with_.append(f"c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(moved, c) AS c FROM c{r} LEFT JOIN ({moved}) USING (p, k))")
    return f"""WITH {", ".join(with_)},
o AS (SELECT vec_id, string_agg(format('{{:02x}}', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM o JOIN e USING (vec_id)"""


LM = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {crc32("CAST(doc_id AS VARCHAR)")} % 10 = 0 AS held_out,
             list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), '') AS ws FROM documents),
w AS (SELECT rid, held_out, unnest(ws) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
t AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base FROM w LEFT JOIN c USING (w), t GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 5) AS base_score FROM d JOIN s USING (rid), t
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_chat_formatting": CHAT, "op9_quality_rules": QUALITY, "op11_importance_resampling": IMPORTANCE, "op12_vector_codes": vector_codes(),
        "base_licenses": LICENSES, "base_personal_data": PERSONAL, "base_url_rules": URLS, "base_lm_scores": LM,
    }
