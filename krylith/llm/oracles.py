"""DuckDB SQL for the text queries that SQL can express, over whole tables with unique ids."""

from __future__ import annotations

from krylith.llm.decontaminate import UNITS

_SOLID, _ODD = r"[^\x20\x09-\x0D]", r"[^\p{L}\p{N}\x20\x09-\x0D\x01]"
_NAME = rf"'([^.!?\x20\x09-\x0D][\x20\x09-\x0D])(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || 'p\2', 'g'"

#: Word by word; a name's mark may hide the next one from the pattern, so names are marked twice. Windows are
#: compared as text, short and placeholder-heavy ones by containment.
DECONTAMINATE = rf"""
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, replace(coalesce(text, ''), chr(1), '') AS line FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'item', item_id, replace(coalesce(text, ''), chr(1), '') FROM benchmark WHERE item_id IS NOT NULL),
named AS (SELECT kind, id, regexp_extract_all(regexp_replace(regexp_replace(line, {_NAME}), {_NAME}), '{_SOLID}+') AS w FROM texts),
words AS (SELECT kind, id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM named),
marked AS (
  SELECT kind, id, place, CASE
    WHEN regexp_full_match(word, '{_ODD}*[0-9][^\p{{L}}\x20\x09-\x0D]*\p{{L}}{{1,4}}{_ODD}*') THEN chr(1) || 'u' || word
    WHEN regexp_full_match(word, '{_ODD}*[0-9][^\p{{L}}\x20\x09-\x0D]*') THEN chr(1) || 'n' || word
    WHEN regexp_full_match(word, '(?i)(?:{'|'.join(UNITS)}){_ODD}*') THEN chr(1) || 'u' || word
    ELSE word END AS word
  FROM words),
plainer AS (SELECT kind, id, place, regexp_replace(lower(word), '{_ODD}+', '', 'g') AS word FROM marked),
tokens AS (
  SELECT kind, id, row_number() OVER (PARTITION BY kind, id ORDER BY place) AS place, word, starts_with(word, chr(1)) AS slot,
    CASE WHEN starts_with(word, chr(1)) THEN substr(word, 1, 2) ELSE word END AS form, CASE WHEN starts_with(word, chr(1)) THEN substr(word, 3) ELSE word END AS plain
  FROM plainer WHERE word <> ''),
spans AS (
  SELECT kind, id, place, count(*) OVER six AS n, count(*) FILTER (WHERE slot) OVER six AS n_slots, string_agg(form, ' ') OVER six AS form, string_agg(plain, ' ') OVER six AS plain, list(word) OVER six AS w
  FROM tokens WINDOW six AS (PARTITION BY kind, id ORDER BY place ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
lines AS (SELECT kind, id, count(*) AS n, string_agg(plain, ' ' ORDER BY place) AS plain FROM tokens GROUP BY kind, id),
exact AS (
  SELECT id AS item_id, plain FROM spans WHERE kind = 'item' AND n = 6 AND n_slots * 2 > 6
  UNION SELECT id, plain FROM lines WHERE kind = 'item' AND n < 6),
forms AS (SELECT id AS item_id, place, form, list_filter(w, lambda x: starts_with(x, chr(1))) AS slots FROM spans WHERE kind = 'item' AND n = 6 AND n_slots * 2 <= 6),
total AS (
  SELECT item_id, count(DISTINCT form) AS of_form, count(DISTINCT form) + count(DISTINCT plain) AS of_all
  FROM (SELECT item_id, form, NULL AS plain FROM forms UNION ALL SELECT item_id, NULL, plain FROM exact) GROUP BY item_id),
met AS (
  SELECT d.id AS doc_id, item_id, d.place - i.place AS diagonal, d.form, slots, list_filter(d.w, lambda x: starts_with(x, chr(1))) AS doc_slots
  FROM spans d JOIN forms i ON d.form = i.form WHERE d.kind = 'doc' AND d.n = 6),
filled AS (
  SELECT doc_id, item_id, diagonal, count(DISTINCT i) AS n_values, count(DISTINCT i || ' ' || d) AS n_pairs
  FROM (SELECT doc_id, item_id, diagonal, unnest(slots) AS i, unnest(doc_slots) AS d FROM met) GROUP BY doc_id, item_id, diagonal),
good AS (
  SELECT doc_id, item_id, form, NULL AS plain, coalesce(n_values, 0) AS n_values FROM met LEFT JOIN filled USING (doc_id, item_id, diagonal) WHERE coalesce(n_values, 0) = coalesce(n_pairs, 0)
  UNION ALL SELECT id, item_id, NULL, exact.plain, 0 FROM lines JOIN exact ON contains(' ' || lines.plain || ' ', ' ' || exact.plain || ' ') WHERE kind = 'doc'),
per AS (
  SELECT doc_id, item_id, count(DISTINCT form) AS n_form, count(DISTINCT form) + count(DISTINCT plain) AS n_all, max(n_values) AS n_slots FROM good GROUP BY doc_id, item_id),
judged AS (
  SELECT *, of_form > 0 AND n_form::DOUBLE / of_form >= 0.3::DOUBLE AND n_form >= least(3, of_form) AS by_form, n_all::DOUBLE / of_all >= 0.3::DOUBLE AND n_all >= least(3, of_all) AS by_all FROM per JOIN total USING (item_id))
SELECT doc_id, item_id, CASE WHEN by_form THEN n_form ELSE n_all END AS n_windows, CASE WHEN by_form THEN of_form ELSE of_all END AS n_item_windows, n_slots,
  CASE WHEN by_form THEN n_form::DOUBLE / of_form ELSE n_all::DOUBLE / of_all END AS covered
FROM judged WHERE by_form OR by_all
"""

#: By brute force: all pairs that share a shingle, counted on their full sets; components by closure of the links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts),
spans AS (SELECT doc_id, n_words, place, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS phrase FROM words),
shingles AS (SELECT DISTINCT doc_id, md5(phrase) AS shingle FROM spans WHERE place <= greatest(n_words - 4, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM ways UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
least AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM texts d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: By brute force: each window of 35 words is grouped by all its words.
SUBSTRING_DEDUP = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts),
spans AS (SELECT r, place, word, count(*) OVER later AS n, string_agg(word, ' ') OVER later AS phrase FROM words
          WINDOW later AS (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
judged AS (SELECT r, place, word, n = 35 AND count(*) OVER (PARTITION BY CASE WHEN n = 35 THEN md5(phrase) END) > 1 AS again FROM spans),
covered AS (SELECT r, place, word, bool_or(again) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM judged),
cut AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)
"""

#: One prefix sum over each source's keys.
MIXING = r"""
WITH marks AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN marks USING (doc_id)),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER w AS turn,
    (sum(source_size) OVER () * 1.5::DOUBLE - (sum(2.0::DOUBLE * source_size) OVER w - 2.0::DOUBLE * source_size)) / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level
  FROM sources WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
reached AS (SELECT arg_min(level, turn) AS level FROM levels WHERE 2.0::DOUBLE * source_size >= level * weight),
aimed AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(reached.level * weight, 2.0::DOUBLE * source_size)) AS target FROM levels, reached),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aimed),
placed AS (
  SELECT s.*, source_size, target, epochs,
    sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2::DOUBLE AS middle
  FROM sized s JOIN whole a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""
