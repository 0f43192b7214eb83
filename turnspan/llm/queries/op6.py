"""op6_near_duplicates: the class of every document, with DuckDB SQL that compares all texts sharing a shingle."""

from turnspan.llm.neardup import classes
from turnspan.llm.registry import register, table

SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN len(a) > 0 THEN a ELSE b END AS w FROM (
    SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS b
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))
), grams AS (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), counts AS (
  SELECT doc_id, g, count(*) AS n FROM grams GROUP BY doc_id, g
), sizes AS (
  SELECT doc_id, sum(n) AS n FROM counts GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM counts a JOIN counts b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * m >= 4 * (p.n + q.n - m)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM d UNION SELECT y, root FROM reach JOIN edges ON reach.doc_id = x
)
SELECT doc_id, min(root)::BIGINT AS class_id FROM reach GROUP BY doc_id
"""


@register("op6_near_duplicates", SQL)
def op6_near_duplicates(spark, sf_dir):
    """Null and wordless texts are alone in their class; see turnspan.llm.neardup for the other edge cases."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
