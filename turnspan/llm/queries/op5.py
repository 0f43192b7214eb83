"""op5_token_counts: token totals of all documents by source, language and tokenizer version; and
totals of words, which SQL can say too."""

import uuid

from pyspark.sql import functions as F

from turnspan.llm.registry import register, table
from turnspan.llm.token_counts import TOKENIZERS, Rollup, bpe_counts_by, deletes, inserts, revisions, word_counts
from turnspan.session import cut, shared_dir

VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")

WORDS_SQL = r"""
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
FROM documents GROUP BY source, lang
"""


def _rollup(spark):
    return Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir, tokenizers: str = TOKENIZERS):
    """The true totals of two vocabularies, by signed batches over the whole table: all documents are
    inserted with their words as a first estimate of the first version; a batch sent again is ignored;
    the estimates are revised to the counts of tokens; documents enter under the second version; and a
    version of plain words, which is retired, is inserted and deleted. A null text has no tokens; see
    turnspan.llm.token_counts for the other edge cases."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    counts = docs.withColumn("words", F.col("text"))
    counts = word_counts(counts, "words", "n_words")
    counts = cut(bpe_counts_by(counts, {version: f"{tokenizers}/{version}.tiktoken" for version in VERSIONS}))
    rollup = _rollup(spark)
    as_version = lambda version, n: counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("n_tokens"))
    estimates = counts.select("source", "lang", F.lit(VERSIONS[0]).alias("tokenizer"), F.col("n_words").alias("n_tokens"), F.col(VERSIONS[0]).alias("new_tokens"))
    rollup.commit("estimate-1", inserts(estimates))
    rollup.commit("estimate-1", inserts(estimates))
    rollup.commit("count-1", revisions(estimates))
    rollup.commit("count-2", inserts(as_version(VERSIONS[1], VERSIONS[1])))
    rollup.commit("words-1", inserts(as_version("words", "n_words")))
    rollup.commit("words-retired", deletes(as_version("words", "n_words")))
    return rollup.totals()


@register("token_counts_words", WORDS_SQL)
def token_counts_words(spark, sf_dir):
    """A rollup of word counts, compacted between its batches: half of the documents, then the rest."""
    counts = word_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit("words").alias("tokenizer"), "text"))
    first = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True))
    rollup = _rollup(spark)
    rollup.commit("part-1", inserts(counts.filter(first)))
    rollup.compact()
    rollup.commit("part-2", inserts(counts.filter(~first)))
    return rollup.totals()
