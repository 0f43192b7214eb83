"""op1_mixing: the whole documents table mixed to target weights."""

from pyspark.sql import functions as F

from turnspan.llm.mixing import taken
from turnspan.llm.registry import register, table


@register("op1_mixing")
def op1_mixing(spark, sf_dir):
    """A null text has size 0; see turnspan.llm.mixing for the other edge cases. shards: where the
    splitting tree puts each draw of the document."""
    rows = taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))
