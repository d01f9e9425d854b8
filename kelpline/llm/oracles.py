"""DuckDB SQL with the results of the queries that SQL can express, by plain definitions."""

from __future__ import annotations

import math

from kelpline.llm.common import LOWER, UPPER
from kelpline.llm.licenses import PHRASES, TEMPLATES, block_of
from kelpline.llm.url_filter import BLOCKED_NAMES, RULES

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontaminate() -> str:
    return f"""
WITH doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
item AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, s, gram.n AS n FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS i FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN ids USING (doc_id)"""


def licenses(threshold: float = 0.9) -> str:
    """Blocks begin at every word of the texts that hold enough of a template's words at all."""
    rows = ", ".join(f"('{label}', {words}, {math.ceil(threshold * len(words))}, {block_of(n)})" for label, n, words in TEMPLATES)
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES.items())
    return f"""
WITH doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
template AS (SELECT * FROM (VALUES {rows}) v(label, t, need, size)),
phrase AS (SELECT * FROM (VALUES {phrases}) v(label, p)),
place AS (SELECT doc_id, label, s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM doc WHERE list_contains(w, 'license')), phrase
          WHERE w[s:s + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(s) - 1 AS first_word, max(s) - 1 AS last_word FROM place GROUP BY doc_id),
held AS (SELECT doc_id, w, label, t, need, size FROM (SELECT doc_id, w, list_distinct(w) AS own FROM doc) JOIN template ON len(own) >= need AND len(list_intersect(t, own)) >= need),
block AS (SELECT doc_id, label, t, need, len(list_intersect(t, w[b + 1:b + size])) AS n FROM (SELECT *, unnest(range(0, len(w))) AS b FROM held)),
met AS (SELECT doc_id, label, n / len(t) AS c FROM block WHERE n >= need),
label AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels FROM (SELECT DISTINCT doc_id, label, true AS base FROM place) GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM met) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM met GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN label USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""


def url_filter() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    names = ", ".join(f"'{n}'" for n in BLOCKED_NAMES)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') ELSE '' END AS r FROM pages),
b AS (SELECT page_id, CASE WHEN strpos(r, '/') > 0 THEN left(r, strpos(r, '/') - 1) ELSE r END AS h, CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM a),
page AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, path FROM b),
rule AS (SELECT * FROM (VALUES {rules}) v(verdict, rhost, rpath)),
fit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
        FROM page JOIN rule ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page.page_id, host, path, rule, coalesce(verdict, CASE WHEN list_has_any(string_split(host, '.'), [{names}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN fit USING (page_id)"""


def line_dedup() -> str:
    """A document is a row, as in the operator: rows that repeat a doc_id count each."""
    blanks = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
WITH line AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') AS key FROM line),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.key = c.key GROUP BY r"""


def filter_audit() -> str:
    """Each order and step judged on its own; a document is a row."""
    blanks = "[^\\x20\\x09-\\x0D]+"
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{blanks}') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM doc GROUP BY t),
fail AS (SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
                {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)}} AS f FROM doc JOIN first USING (t)),
grouped AS (SELECT part, [x FOR x IN ['A', 'B', 'C', 'D', 'E'] IF CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END] AS bad,
                   count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fail GROUP BY part, bad),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
seq AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS own, string_split(filter_order[1:s - 1], '') AS before FROM seq, range(1, 6) r(s)),
judged AS (SELECT part, filter_order, step, own, n, good, toxic, bad, list_contains(bad, own) AS fails, list_has_any(bad, before) AS gone FROM grouped, steps),
counted AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
                   sum(n) FILTER (bad = [own]) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
            FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted"""


def resample() -> str:
    """Sums of distinct words by a table of 256 remainders that SQL makes itself."""
    halve = "lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    step = "range(256)"
    for _ in range(8):
        step = f"list_transform({step}, {halve})"
    return f"""
WITH rem AS MATERIALIZED (SELECT {step} AS r),
doc AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
word AS (SELECT k, unnest(w) AS w FROM doc),
wanted AS (SELECT unnest({WORDS}) AS w FROM benchmark),
own AS (SELECT w, count(*) AS n FROM word GROUP BY w),
target AS (SELECT w, count(*) AS n FROM wanted GROUP BY w),
bytes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM own UNION SELECT w FROM target)),
crc AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, x: xor(c >> 8, r[(xor(c, x) & 255) + 1]), 4294967295)) % 10000 AS b
        FROM bytes, rem),
s AS (SELECT b, sum(n) AS s FROM own JOIN crc USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM target JOIN crc USING (w) GROUP BY b),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (total.s + 10000) / ((s.s + 1.0::DOUBLE) * (total.t + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), total),
weight AS (SELECT k, sum(g) AS weight FROM word JOIN crc USING (w) JOIN gain USING (b) GROUP BY k),
scored AS (SELECT k, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM doc LEFT JOIN weight USING (k)),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS rank, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM noisy LEFT JOIN ranked USING (k)"""
