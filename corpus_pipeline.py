"""A training-corpus pipeline in five stages over the documents table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the rows that go
on, with the columns of documents. The last one adds `copies`: where the mix places a document.

Edge cases follow the operators': a null or letterless text goes in the first stage, a text of too
few words in the second; rows of one id become one in the third; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnspan.llm.decontaminate import decontaminate
from turnspan.llm.language import identify
from turnspan.llm.mixing import mix
from turnspan.llm.neardup import deduplicate
from turnspan.llm.quality_rules import keep
from turnspan.llm.queries.op9 import model_of
from turnspan.llm.registry import register, table
from turnspan.session import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are too far from every known language, or have no letters."""
    prefix = "__li_"
    found = identify(docs, model_of(docs), prefix=prefix)
    return found.filter(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix="__dc_")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: its documents, each with the places of its copies."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Centroids, signatures and the splitting tree are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
