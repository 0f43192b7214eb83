"""op9_language_id: the language of every document, learnt from three folds of four."""

from pyspark.sql import functions as F

from turnspan.llm.batches import fold
from turnspan.llm.language import fit, identify
from turnspan.llm.registry import register, table

FOLDS, HELD_OUT = 4, 2


def model_of(docs):
    return fit(docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", "text", "lang"))


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    """Null and letterless texts are `und`; see turnspan.llm.language for the other edge cases."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), model_of(docs), keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
