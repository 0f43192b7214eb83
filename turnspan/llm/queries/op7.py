"""op7_quality_rank: a quality score for every document, learnt from four folds of five."""

from pyspark.sql import functions as F

from turnspan.llm.batches import fold
from turnspan.llm.quality_rank import CUT, described, fit, score
from turnspan.llm.registry import register, table
from turnspan.session import cut

FOLDS, HELD_OUT = 5, 0


@register("op7_quality_rank")
def op7_quality_rank(spark, sf_dir):
    """Null and empty texts are scored too; see turnspan.llm.quality_rank for the other edge cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = cut(described(docs, keep=["doc_id"]))  # texts are read once, to learn and to score
    model = fit(docs, labels.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT), x_col="x")
    scored = score(docs, model, keep=["doc_id"], x_col="x")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
