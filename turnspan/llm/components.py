"""Connected components of a graph of integer ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnspan.session import cut

PART_ROWS = 50_000


def parts_of(rows: int) -> int:
    """In how many partitions a table of so many short rows is kept. Each partition of a checkpoint is
    a file of its own, and without its native library Hadoop starts a process for each file that it
    writes; so many tiny partitions cost more than their rows."""
    return rows // PART_ROWS + 1


def _plain(df: DataFrame) -> DataFrame:
    """The rows of a checkpoint without what the optimizer knows of its order, partitioning and values: that
    doubles with each round, and planning would soon take longer than the work."""
    spark, q = df.sparkSession, df._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(q.toRdd(), df._jdf.schema(), False), spark)


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long): root is the least id of its component.
    most: a number that the rows of `edges` don't exceed, where one is known.

    Each round hangs larger neighbours on a node's least neighbour, then smaller ones, until every
    component is one star. Only least ids are aggregated by node, so nodes with many neighbours
    cost a partial aggregation and a join that Spark can split; nothing is gathered by node. Tables
    are kept in partitions of about PART_ROWS rows, as a round of many tiny ones is mostly files.
    Edges with a null end or from a node to itself are left out.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e if most is None else e.coalesce(parts_of(most)))
    count, before = e.count(), None

    def held(df: DataFrame) -> DataFrame:  # no table of a round has more rows than twice the links
        return cut(df.coalesce(parts_of(2 * count)))

    e = _plain(e.coalesce(parts_of(2 * count)))
    while True:  # a number of rounds that grows with the logarithm of the nodes
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least ids are written before they are joined: a join of two shuffled tables is one that
        # adaptive execution can split at a node with very many neighbours.
        least = held(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = held(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        down = held(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = _plain(held(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()))
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
