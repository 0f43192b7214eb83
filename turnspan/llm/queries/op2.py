"""op2_quality_rules: the whole documents table judged by the rules, with DuckDB SQL for the same rows."""

from pyspark.sql import functions as F

from turnspan.llm.quality_rules import STOP_WORDS, judge
from turnspan.llm.registry import register, table

_STOP = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), places AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM places) WHERE n > 1
), repeats AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS p FROM twice, generate_series(0, 4) AS s(j)) GROUP BY r
), m AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
         (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats ON d.r = repeats.r
), v AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
         AND word_chars / n_words BETWEEN 1.5 AND 25
         AND n_symbols / n_words <= 0.25
         AND n_dup_lines / greatest(n_lines, 1) <= 0.5
         AND (n_words < 50 OR n_stop_words / n_words >= 0.01)
         AND n_capitals / greatest(word_chars, 1) <= 0.5
         AND n_bangs / n_words <= 0.5 AS kept
FROM v
"""


@register("op2_quality_rules", SQL)
def op2_quality_rules(spark, sf_dir):
    """A null text has no words and fails; see turnspan.llm.quality_rules for the other edge cases."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), out="q")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"q.m.{x}").alias(x) for x in measures], F.col("q.base_failed").alias("base_failed"), F.col("q.kept").alias("kept"))
