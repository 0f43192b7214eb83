"""Each pipeline stage, on its own input, against what SQL or plain Python says of it."""

import os

import duckdb
import pytest

import corpus_pipeline
import turnspan.llm.queries  # noqa: F401
from turnspan.llm import language, mixing, registry
from turnspan.llm.queries.op9 import model_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def by_sql(path, name, where):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return {r[0] for r in con.sql(f"SELECT doc_id FROM ({registry.ORACLES[name]}) WHERE {where}").fetchall()}


def test_stages_against_plain_versions(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = registry.table(spark, SF, "documents")
    written = {}
    for name in stages:
        before = docs
        stages[name](spark, docs, SF).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        written[name] = (before, docs, path)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after, _ = written["language_id"]
    found = language.identify(before, model_of(before), prefix="p_", keep=["doc_id"])
    assert ids(after) == ids(found.filter("not p_rejected")) and len(ids(before) - ids(after)) <= 0.02 * before.count()
    assert ids(written["quality_rules"][1]) == by_sql(written["language_id"][2], "op2_quality_rules", "kept")
    assert ids(written["near_duplicates"][1]) == by_sql(written["quality_rules"][2], "op6_near_duplicates", "doc_id = class_id")
    assert ids(written["decontamination"][1]) == by_sql(written["near_duplicates"][2], "op4_decontamination", "NOT contaminated")
    before, after, _ = written["mixing"]
    want = {r.doc_id: len(r.draws) for r in mixing.taken(before).collect() if r.draws}
    assert {r.doc_id: len(r.copies) for r in after.collect()} == want
    assert all(after.schema[f.name].dataType == f.dataType for f in before.schema)
