"""op8_toxicity: a toxicity score for every document, learnt from four folds of five."""

from pyspark.sql import functions as F

from turnspan.llm.batches import fold
from turnspan.llm.registry import register, table
from turnspan.llm.toxicity import fit, score

FOLDS, HELD_OUT, CUT = 5, 0, 0.5


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    """Null and empty texts are scored too; see turnspan.llm.toxicity for the other edge cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    scored = score(docs, model, keep=["doc_id"])
    held_out = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
