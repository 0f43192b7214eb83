"""op4_decontamination: the whole documents table against the whole benchmark, with DuckDB SQL."""

from pyspark.sql import functions as F

from turnspan.llm.decontaminate import flag
from turnspan.llm.registry import register, table

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH items AS (
  SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), places AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT r, i, places.n, item FROM places JOIN windows ON places.n = windows.n AND places.g = windows.g
), inside AS (
  SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(generate_series(0, n - 1)) AS j FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN inside ON d.r = inside.r LEFT JOIN named ON d.r = named.r
"""


@register("op4_decontamination", SQL)
def op4_decontamination(spark, sf_dir):
    """A null text has no words; see turnspan.llm.decontaminate for the other edge cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    flagged = flag(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return flagged.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        F.col("dc_hit").alias("n_hit"),
        F.col("dc_items").alias("n_items"),
        F.col("dc_items_sha256").alias("items_sha256"),
        (F.col("dc_hit") > 0).alias("contaminated"),
    )
