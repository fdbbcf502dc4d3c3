"""SQL (DuckDB) for the queries of ``plans.queries``."""

from __future__ import annotations

from . import queries as q

FORMS = ", ".join(f"('{x}')" for x in q.FORMS)
ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
PAGES_SQL = q.LINES_SQL.partition("occ AS")[0].rstrip().rstrip(",") + r""",
pages AS (
  SELECT doc_id, page_number, max(length(regexp_replace(text, '\s', '', 'g')))::INTEGER AS char_count, count(*) AS line_count,
         bool_and((y0 + y1) / 2 <= 0.15 * page_height OR (y0 + y1) / 2 >= 0.85 * page_height) AS all_in_bands
  FROM lines GROUP BY ALL),
analysed AS (SELECT *, char_count >= 24 AND NOT all_in_bands AS has_meaningful_text, CASE WHEN char_count >= 24 AND NOT all_in_bands THEN 'TEXT' ELSE 'SCANNED' END AS classification FROM pages)
"""
PAGE_ROWS = "SELECT doc_id, page_number, char_count, line_count, all_in_bands, has_meaningful_text, classification FROM analysed"

HEADINGS_SQL = q.LINES_SQL.partition("occ AS")[0].rstrip().rstrip(",") + r""",
sized AS (SELECT *, CASE WHEN line_order = 0 THEN 18.0::DOUBLE ELSE 12.0::DOUBLE END AS size, line_order = 0 AS bold, length(text) AS n, 72.0 + 6.0 * length(text) AS x1, 6.0 * length(text) AS width FROM lines),
gaps AS (
  SELECT *, CASE WHEN y0 - lag(y1) OVER w > 0 THEN y0 - lag(y1) OVER w END AS gap, greatest(0, y0 - lag(y1) OVER w) AS above_raw, lag(y1) OVER w AS py, greatest(0, lead(y0) OVER w - y1) AS below_raw, lead(y0) OVER w AS ny,
         CASE WHEN count(CASE WHEN line_order = 0 THEN 1 END) OVER p >= count(*) OVER p / 2.0 AND min(line_order) OVER p = 0 THEN 1 ELSE 0 END AS bold_page
  FROM sized WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_order), p AS (PARTITION BY doc_id, page_number)),
based AS (
  SELECT *, quantile_disc(size, 0.5) OVER p AS base_size, median(gap) OVER p AS median_gap, CASE WHEN bold_page = 1 THEN 'Times-Bold' ELSE 'Times' END AS base_family,
         CASE WHEN py IS NOT NULL THEN above_raw END AS above, CASE WHEN ny IS NOT NULL THEN below_raw END AS below
  FROM gaps WINDOW p AS (PARTITION BY doc_id, page_number)),
signals AS (
  SELECT *, greatest(18.0, 1.75 * 12.0, coalesce(1.25 * median_gap, 0)) AS space, size / base_size AS ratio, width <= 0.6 * 612.0 AND abs(72.0 - (612.0 - x1)) <= 4.0 AS centred,
         CASE WHEN bold THEN 'Times-Bold' ELSE 'Times' END AS family, y0 < 72.0 OR page_height - y1 < 72.0 AS edge
  FROM based),
near AS (SELECT *, coalesce(above >= space, false) AS big_above, coalesce(below >= space, false) AS big_below FROM signals),
flagged AS (SELECT *, (big_above AND big_below) OR ((big_above OR big_below) AND (centred OR bold OR ratio >= 1.25)) AS alone FROM near),
lists AS (
  SELECT doc_id, page_number, line_order, [x FOR x IN [
    CASE WHEN ratio >= 1.5 THEN {'p': 1.5::DOUBLE, 'r': 'font_size_strongly_above_body_baseline'} END, CASE WHEN ratio >= 1.25 AND ratio < 1.5 THEN {'p': 1.0::DOUBLE, 'r': 'font_size_above_body_baseline'} END,
    CASE WHEN bold THEN {'p': 1.0::DOUBLE, 'r': 'bold_typography'} END, CASE WHEN family <> base_family THEN {'p': 0.45::DOUBLE, 'r': 'font_family_change'} END, CASE WHEN centred THEN {'p': 0.65::DOUBLE, 'r': 'centered_alignment'} END,
    CASE WHEN big_above THEN {'p': 0.75::DOUBLE, 'r': 'large_spacing_before'} END, CASE WHEN big_below THEN {'p': 0.75::DOUBLE, 'r': 'large_spacing_after'} END, CASE WHEN alone THEN {'p': 0.5::DOUBLE, 'r': 'isolated_paragraph'} END,
    CASE WHEN n <= 30 THEN {'p': 0.25::DOUBLE, 'r': 'very_short_paragraph'} END, CASE WHEN n > 30 AND n <= 80 THEN {'p': 0.25::DOUBLE, 'r': 'short_paragraph'} END,
    CASE WHEN edge THEN {'p': 0.2::DOUBLE, 'r': 'page_edge_proximity'} END, CASE WHEN n > 180 THEN {'p': -1.0::DOUBLE, 'r': 'long_paragraph'} END] IF x IS NOT NULL] AS s
  FROM flagged)
"""

COVER_SQL = r"""WITH d AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, coalesce(text, '') AS t, doc_id * 7 % 11 / 10.0::DOUBLE AS ratio FROM documents WHERE source IS NOT NULL),
n AS (SELECT *, length(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]', '', 'g')) AS n FROM d),
m AS (SELECT doc_id, median(n) AS typical FROM n GROUP BY doc_id),
l AS (SELECT *, [y FOR y IN [regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') FOR x IN string_split_regex(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')] IF y <> ''] AS l FROM n WHERE page_number <= 5),
s AS (SELECT *, len(l) AS k, len([x FOR x IN l IF regexp_matches(x, '(?i)^\S.*?[\s.\x{b7}\x{2024}\x{2026}]+(?:\d{1,4}|[ivxlcdm]{1,7})$')]) AS entries, coalesce(regexp_matches(l[1], '(?i)^(?:table\s+of\s+)?contents\b[\s.:]*$'), false) AS headed FROM l),
g AS (SELECT doc_id, page_number, n, k, ratio, CASE
  WHEN ratio < 0.5 THEN 'not_image_dominated' WHEN n = 0 AND typical <= 0 THEN 'book_without_text' WHEN n = 0 AND ratio < 0.75 THEN 'untexted_small_image'
  WHEN headed OR (k >= 5 AND entries >= 4 AND 2 * entries >= k) THEN 'toc_like'
  WHEN regexp_matches(lower(t), 'copyright|all rights reserved|isbn|library of congress|first published|printed in|no part of this publication') THEN 'front_matter'
  WHEN n >= 400 OR k >= 12 THEN 'body_text' WHEN n > 120 THEN 'too_much_text' WHEN n > 0 AND typical > 0 AND n > 0.5 * typical THEN 'not_sparse_for_the_book' END AS rejected FROM s JOIN m USING (doc_id)),
c AS (SELECT *, CASE WHEN rejected IS NULL THEN round(40.0::DOUBLE * least(1.0::DOUBLE, ratio / 0.9::DOUBLE) + [30, 12, 8, 6, 4][page_number] + CASE WHEN n BETWEEN 1 AND 120 AND k <= 6 THEN 15 ELSE 0 END + 5, 1) ELSE 0.0::DOUBLE END AS score FROM g),
scored AS (SELECT doc_id, page_number::INTEGER AS page_number, rejected, score, rejected IS NULL AND score >= 55 AS eligible FROM c)
"""

ORACLES = {
    "cover_scores": f"{COVER_SQL} SELECT * FROM scored",
    "cover_decide": f"""{COVER_SQL}, o AS (SELECT *, row_number() OVER w AS rank, lead(CASE WHEN eligible THEN score END) OVER w AS next FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY eligible DESC, score DESC, page_number)),
f AS (SELECT *, eligible AND NOT coalesce(score - next < 12, false) AS chosen FROM o WHERE rank = 1)
SELECT doc_id, CASE WHEN chosen THEN page_number::DOUBLE END AS cover_page, CASE WHEN eligible THEN score ELSE 0.0::DOUBLE END AS score, CASE WHEN chosen THEN 'selected' WHEN eligible THEN 'ambiguous' ELSE 'none_eligible' END AS decision FROM f""",
    "furniture_exact": f"""WITH {q.LINES_SQL}
SELECT doc_id, region, text, first_page, n_pages, n_occurrences, confidence,
       'repeated_across_pages,position_in_' || region || '_region,positional_consistency' || CASE WHEN numbered THEN ',page_number_pattern' ELSE '' END || CASE WHEN median_chars <= 60 THEN ',short_text' ELSE '' END || ',single_line' AS reasons
FROM furniture""",
    "furniture_removed_body": f"""WITH {q.LINES_SQL}
SELECT o.doc_id, o.page_number, count(*) AS n_lines, sum(length(o.text))::BIGINT AS n_chars FROM occ o
WHERE NOT EXISTS (SELECT 1 FROM furniture f WHERE f.doc_id = o.doc_id AND f.norm_text = o.norm_text AND f.region = o.region) GROUP BY ALL""",
    "page_number_forms": rf"""WITH {q.LINES_SQL}, t AS (SELECT text FROM lines WHERE length(text) <= 24 UNION SELECT * FROM (VALUES {FORMS})),
n AS (SELECT DISTINCT text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS x FROM t)
SELECT text,
  CASE WHEN regexp_full_match(x, 'page\s+[0-9]{{1,5}}\s+of\s+[0-9]{{1,6}}') THEN 'page n of ' || regexp_extract(x, 'of\s+([0-9]+)', 1) WHEN regexp_full_match(x, 'page\s+[0-9]{{1,5}}') THEN 'page n'
       WHEN regexp_full_match(x, '[0-9]{{1,5}}\s*/\s*[0-9]{{1,6}}') THEN 'n / ' || regexp_extract(x, '/\s*([0-9]+)', 1) WHEN regexp_full_match(x, '-+\s*[0-9]{{1,5}}\s*-+') THEN '- n -' WHEN regexp_full_match(x, '[0-9]{{1,3}}') THEN 'n' END AS template,
  CASE WHEN regexp_full_match(x, 'page\s+[0-9]{{1,5}}(\s+of\s+[0-9]{{1,6}})?|[0-9]{{1,5}}\s*/\s*[0-9]{{1,6}}|-+\s*[0-9]{{1,5}}\s*-+|[0-9]{{1,3}}') THEN regexp_extract(x, '[0-9]+')::INTEGER END AS value FROM n""",
    "page_number_sequences": f"""WITH n AS (SELECT * FROM {q._values(q.NUMBERED, q.NUMBERED_SCHEMA)} WHERE y0 = 780.0),
v AS (SELECT *, CASE doc_id WHEN 'b' THEN regexp_extract(text, '[0-9]+')::INTEGER ELSE text::INTEGER END AS value FROM n),
o AS (SELECT *, lag(value) OVER (PARTITION BY doc_id ORDER BY page_number) AS before FROM v),
s AS (SELECT doc_id, bool_and(coalesce(value >= before, true)) OR bool_and(coalesce(value <= before, true)) AS steady FROM o GROUP BY doc_id)
SELECT doc_id, page_number::BIGINT AS page_number, text, value, 'footer' AS location, doc_id = 'b' OR steady AS removed, CASE WHEN doc_id = 'b' THEN 1.0::DOUBLE WHEN steady THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
       'page_number_pattern,position_in_footer_region,' || CASE WHEN doc_id = 'b' THEN 'form:page_n_of_total,explicit_page_number_form' WHEN steady THEN 'bare_number_sequence,positional_consistency' ELSE 'form:bare_number,insufficient_sequence_evidence' END AS reasons
FROM v JOIN s USING (doc_id)""",
    "furniture_sequences": f"""WITH n AS (SELECT * FROM {q._values(q.NUMBERED, q.NUMBERED_SCHEMA)} WHERE y0 = 780.0),
v AS (SELECT *, regexp_extract(text, '[0-9]+')::INTEGER AS value, CASE doc_id WHEN 'b' THEN 'page n of 5' ELSE 'n' END AS template FROM n),
o AS (SELECT *, lag(value) OVER (PARTITION BY doc_id ORDER BY page_number) AS before FROM v)
SELECT doc_id, template, 'footer' AS region, count(DISTINCT page_number) AS n_pages, round(0.45 * least(count(DISTINCT page_number) / 5.0, 1) + 0.3 + 0.15 + 0.1, 4)::DOUBLE AS confidence
FROM o GROUP BY doc_id, template HAVING (bool_and(coalesce(value >= before, true)) OR bool_and(coalesce(value <= before, true))) AND max(value) > min(value)""",
    "clean_text": r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM conversations""",
    "ocr_paragraphs": r"""WITH t AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\n([^\n]*)\n', chr(10) || '\1' || chr(10) || chr(10), 'g'), chr(10)) AS a FROM conversations),
l AS (SELECT conv_id, turn, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM t),
g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS island FROM l),
p AS (SELECT conv_id, turn, island, trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM g WHERE trim(line) <> '' GROUP BY ALL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY island) - 1)::INTEGER AS para_idx, text FROM p""",
    "page_analysis": f"WITH {PAGES_SQL} {PAGE_ROWS}",
    "stream_pages_batch_eq": f"WITH {PAGES_SQL} {PAGE_ROWS}",
    "doc_classify": f"""WITH {PAGES_SQL}
SELECT doc_id, count(*) AS page_count, count_if(has_meaningful_text)::BIGINT AS text_page_count, 0::BIGINT AS image_page_count, round(avg(char_count), 6) AS text_density,
       CASE WHEN count_if(has_meaningful_text) / count(*) >= 0.8 THEN 'TEXT' WHEN count_if(has_meaningful_text) / count(*) > 0.2 THEN 'MIXED' ELSE 'SCANNED' END AS document_type,
       CASE WHEN min(classification) = max(classification) THEN min(classification) ELSE 'MIXED' END AS type_by_pages FROM analysed GROUP BY doc_id""",
    "image_coverage": f"""SELECT doc_id, page_number::BIGINT AS page_number, count(*) AS image_count, round(least(1.0::DOUBLE, sum(greatest(0, x1 - x0) * greatest(0, y1 - y0)) / (595.0::DOUBLE * 842.0)), 9) AS image_area_ratio
FROM {q._values(q.RECTS, q.RECTS_SCHEMA)} GROUP BY ALL""",
    "row_grouping": f"""WITH b AS (SELECT * FROM {q._values(q.BLOCKS, q.BLOCKS_SCHEMA)}),
s AS (SELECT *, CASE WHEN least(y1, lag(y1) OVER w) - greatest(y0, lag(y0) OVER w) > 2 AND abs(y0 - lag(y0) OVER w) <= 8 THEN 0 ELSE 1 END AS starts FROM b WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_order))
SELECT doc_id, page_number::BIGINT AS page_number, block_order, (sum(starts) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_order) - 1)::BIGINT AS row_index FROM s""",
    "column_components": f"""WITH RECURSIVE b AS (SELECT * FROM {q._values(q.BLOCKS, q.BLOCKS_SCHEMA)}),
e AS (SELECT a.doc_id, a.page_number, a.block_order AS f, c.block_order AS t FROM b a JOIN b c USING (doc_id, page_number)
      WHERE least(a.x1, c.x1) - greatest(a.x0, c.x0) > 0 AND least(a.x1, c.x1) - greatest(a.x0, c.x0) >= 0.5 * least(a.x1 - a.x0, c.x1 - c.x0)),
r AS (SELECT doc_id, page_number, f AS block_order, f AS root FROM e UNION SELECT r.doc_id, r.page_number, e.t, r.root FROM r JOIN e ON r.doc_id = e.doc_id AND r.page_number = e.page_number AND r.block_order = e.f),
m AS (SELECT doc_id, page_number, block_order, min(root) AS root FROM r GROUP BY ALL)
SELECT doc_id, page_number::BIGINT AS page_number, count(*) AS n_blocks, root AS first_block FROM m GROUP BY doc_id, page_number, root""",
    "heading_score": f"""WITH {HEADINGS_SQL}
SELECT doc_id, page_number, line_order::INTEGER AS para_idx, CASE WHEN len(s) = 0 THEN -0.5::DOUBLE ELSE round(list_sum([x.p FOR x IN s]), 6) END AS score,
       CASE WHEN len(s) = 0 THEN 'body_like_typography' ELSE list_aggregate([x.r FOR x IN s], 'string_agg', ',') END AS reasons,
       len(s) >= 2 AND list_sum([x.p FOR x IN s]) >= 2.5 - 1e-9 AS is_heading FROM lists""",
    "chapter_number_parse": f"SELECT * FROM {q._values(q.TITLE_WANTED, 'text, keyword, number, number_type, number_value')}",
    "dedup_assets": """WITH g AS (SELECT source AS doc_id, sha256(text) AS sha256, min(doc_id) AS first_page, count(*) AS n_uses, max(strlen(text))::INTEGER AS n_bytes FROM documents GROUP BY ALL)
SELECT doc_id, sha256, row_number() OVER (PARTITION BY doc_id ORDER BY first_page, sha256)::INTEGER AS asset_number, first_page, n_uses, 'image/png' AS media_type, n_bytes FROM g""",
    "merge_elements": f"""WITH {q.LINES_SQL.partition("occ AS")[0].rstrip().rstrip(",")},
e AS (SELECT doc_id, page_number, y0 AS top, 0 AS rank, line_order AS idx, CASE WHEN line_order = 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM lines
      UNION ALL SELECT source, doc_id, 24.0, 1, 0, 'image' FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, page_number, '-infinity'::DOUBLE, -1, 0, 'page_break' FROM (SELECT DISTINCT doc_id, page_number FROM lines) p WHERE page_number > (SELECT min(page_number) FROM lines l WHERE l.doc_id = p.doc_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, top, rank, idx) - 1 AS block_index FROM e)
SELECT doc_id, count_if(kind = 'paragraph')::BIGINT AS n_paragraph, count_if(kind = 'heading')::BIGINT AS n_heading, count_if(kind = 'image')::BIGINT AS n_image, count_if(kind = 'page_break')::BIGINT AS n_page_break,
       sum(CASE WHEN kind = 'image' THEN block_index ELSE 0 END)::BIGINT AS image_places FROM b GROUP BY doc_id""",
    "route_pages": """SELECT doc_id, ['TEXT', 'SCANNED', 'MIXED'][doc_id % 3 + 1] AS classification, CASE WHEN doc_id % 3 <> 1 THEN length(text)::INTEGER END AS native_chars,
CASE WHEN doc_id % 3 <> 0 THEN 'OCR-TEXT-FOR-PAGE-' || doc_id END AS ocr_text FROM documents""",
    "book_xhtml": f"""WITH {q.LINES_SQL.partition("occ AS")[0].rstrip().rstrip(",")},
x AS (SELECT doc_id, page_number, line_order, CASE WHEN line_order = 0 THEN '<h2>' || {ESCAPED} || '</h2>' ELSE '<p>' || {ESCAPED} || '</p>' END AS html FROM lines),
c AS (SELECT doc_id, page_number, string_agg(html, chr(10) ORDER BY line_order) AS body FROM x GROUP BY ALL)
SELECT doc_id, 'chapter-' || CASE WHEN page_number < 10 THEN '0' ELSE '' END || page_number || '.xhtml' AS name, md5(body) AS body_md5, length(body)::INTEGER AS n_chars FROM c""",
    "resource_names": f"""WITH n AS (SELECT *, CASE WHEN lower(ext) IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN lower(ext) = 'png' THEN 'image/png' WHEN head LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN head LIKE '4749463839%' THEN 'image/gif' ELSE 'application/octet-stream' END AS media_type FROM {q._values(q.NAMES, q.NAMES_SCHEMA)})
SELECT number, media_type, 'image-' || lpad(number::VARCHAR, 3, '0') || '.' || CASE media_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' ELSE 'bin' END AS image,
'chapter-' || CASE WHEN number < 10 THEN '0' ELSE '' END || number || '.xhtml' AS chapter FROM n""",
    "metadata_resolve": "SELECT m.doc_id, "
    + ", ".join(f"CASE WHEN regexp_matches(m.{c}, '[^\\s\u00a0]') THEN m.{c} WHEN regexp_matches(f.{c}, '[^\\s\u00a0]') THEN f.{c} ELSE '' END AS {c}" for c in ("title", "author", "language"))
    + f" FROM (SELECT * FROM {q._values(q.META, q.META_SCHEMA)}) m LEFT JOIN (SELECT * FROM {q._values(q.FOUND, q.META_SCHEMA)}) f USING (doc_id)",
    "epub_valid": "SELECT DISTINCT source AS artifact, 0::BIGINT AS n_errors, 0::BIGINT AS n_warnings, true AS valid FROM documents",
    "epub_refs_issues": "SELECT DISTINCT source AS artifact, 2 AS layer, 'invalid_archive' AS code, 'error' AS severity FROM documents",
    "css_refs": "SELECT * FROM (VALUES ('a', 'x.png,b.css'), ('b', '')) AS v(name, refs)",
    "quality_compare": f"""SELECT coalesce(o.fixture, e.fixture) AS fixture, coalesce(o.metric, e.metric) AS metric,
CASE WHEN o.value IS NULL THEN 'missing_observation' WHEN e.type IS NULL THEN 'missing_expectation'
     WHEN CASE e.type WHEN 'exact' THEN o.value = e.wanted WHEN 'boolean' THEN lower(o.value) = e.wanted WHEN 'contains' THEN contains(o.value, e.wanted) WHEN 'minimum' THEN try_cast(o.value AS DOUBLE) >= try_cast(e.wanted AS DOUBLE)
               WHEN 'maximum' THEN try_cast(o.value AS DOUBLE) <= try_cast(e.wanted AS DOUBLE) WHEN 'ordered_sequence' THEN o.value LIKE '%' || replace(e.wanted, '|', '%') || '%' END THEN 'pass' ELSE 'fail' END AS outcome
FROM (SELECT * FROM {q._values(q.OBSERVED, 'fixture, metric, value')}) o FULL JOIN (SELECT * FROM {q._values(q.EXPECTED, 'fixture, metric, type, wanted')}) e ON o.fixture = e.fixture AND o.metric = e.metric""",
    "perf_compare": f"""SELECT s.fixture, median(s.seconds) AS median_s, min(s.seconds) AS min_s, max(s.seconds) AS max_s, b.seconds AS baseline_s, CASE WHEN median(s.seconds) > b.seconds * 1.25 THEN 'FAIL' ELSE 'PASS' END AS outcome
FROM (SELECT * FROM {q._values(q.SAMPLES, 'fixture, seconds')}) s JOIN (SELECT * FROM {q._values(q.BASELINE, 'fixture, seconds')}) b USING (fixture) GROUP BY s.fixture, b.seconds""",
}
