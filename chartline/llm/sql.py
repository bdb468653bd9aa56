"""SQL for the results of operators whose own method SQL does not have."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), cut AS (
  SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS spot FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[spot : spot + size - 1], ' ') AS piece FROM cut
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), places AS (
  SELECT row, s.size, unnest(range(1, len(w) - s.size + 2)) AS spot, w FROM docs, (SELECT DISTINCT size FROM windows) s WHERE len(w) >= s.size
), hits AS (
  SELECT p.row, p.spot, p.size, x.item FROM (SELECT row, spot, size, array_to_string(w[spot : spot + size - 1], ' ') AS piece FROM places) p
  JOIN windows x ON p.size = x.size AND p.piece = x.piece
), words AS (
  SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(spot, spot + size)) AS word FROM hits) GROUP BY row
), named AS (
  SELECT row, list_sort(list(DISTINCT item)) AS items FROM hits WHERE item IS NOT NULL GROUP BY row
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(len(n.items), 0) AS n_items,
       sha256(coalesce(array_to_string(n.items, ','), '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h ON d.row = h.row LEFT JOIN named n ON d.row = n.row
"""

JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(text, '') AS raw, {_WORDS} AS w FROM documents
), sets AS (
  SELECT doc_id, raw, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1),
         lambda k: array_to_string(w[k : k + 4], ' ')))) AS s FROM docs
), classes AS (
  SELECT min(doc_id) AS copy_id, count(*) AS n_copies, s FROM sets GROUP BY s, CASE WHEN len(s) = 0 THEN raw END
), shingles AS (
  SELECT copy_id, unnest(s) AS g FROM classes
), common AS (
  SELECT a.copy_id AS x, b.copy_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.copy_id < b.copy_id GROUP BY ALL
), linked AS (
  SELECT x, y FROM common JOIN classes p ON x = p.copy_id JOIN classes q ON y = q.copy_id
  WHERE c * 10 >= 8 * (len(p.s) + len(q.s) - c)
), both_ways AS (
  SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked
), reach AS (
  SELECT copy_id AS x, copy_id AS y FROM classes WHERE copy_id IN (SELECT x FROM both_ways)
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), groups AS (
  SELECT x, min(y) AS class_id FROM reach GROUP BY x
), counts AS (
  SELECT x, count(*) AS n_links FROM both_ways GROUP BY x
)
SELECT d.doc_id, coalesce(g.class_id, c.copy_id) AS class_id, c.copy_id, coalesce(n.n_links, 0) AS n_links, c.n_copies
FROM sets d JOIN classes c ON d.s = c.s AND (len(d.s) > 0 OR EXISTS (SELECT 1 FROM sets o WHERE o.doc_id = c.copy_id AND o.raw = d.raw))
LEFT JOIN groups g ON c.copy_id = g.x LEFT JOIN counts n ON c.copy_id = n.x
"""
