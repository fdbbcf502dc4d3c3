"""SQL (DuckDB) for the queries that SQL can express on whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM t),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * both_ >= 90 * (nx.n_shingles + ny.n_shingles - both_)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.y, r.root FROM r JOIN u ON r.node = u.x)
SELECT n.doc_id, n_shingles, min(root) AS component_id FROM n JOIN r ON n.doc_id = r.node GROUP BY ALL"""

OP3 = f"""WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS g FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS g FROM t, k WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP5 = rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)]) AS g FROM t WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g) WHERE times > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{PLAIN}') GROUP BY doc_id),
m AS (SELECT t.doc_id, source, len(w) AS n_words, coalesce(list_sum([length(y) FOR y IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > word_chars OR (n_dup_lines > 0 AND 20 * n_dup_lines > n_words) AS failed FROM m),
hosts AS (SELECT source, count(*) AS n, count_if(failed) AS bad, count_if(failed) / count(*) AS rate FROM f GROUP BY source),
prior AS (SELECT avg(rate) AS m, var_pop(rate) AS v FROM hosts),
v AS (SELECT source, (bad + p.m * k) / (n + k) > 0.5 AS rejected FROM hosts, (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS k FROM prior) p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

OP1 = """WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM t WHERE length(h) >= 100),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS g FROM s),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
d AS (SELECT w.doc_id, p FROM w JOIN f USING (g) WHERE first < doc_id),
o AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
k AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY ALL),
kept AS (SELECT r.doc_id, run, substring(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS before, a, b FROM r JOIN t USING (doc_id)),
z AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(before, '' ORDER BY a) AS head FROM kept GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substring(h, 2 * last + 1), h))) AS kept_sha256 FROM t LEFT JOIN z USING (doc_id)"""

ORACLES = {"op1_suffix_dedup": OP1, "op2_jaccard": OP2, "op3_decontaminate": OP3, "op5_quality_rules": OP5}
