"""The registered queries beside their SQL, and the pipeline's stages."""

import os

import pytest

import corpus_pipeline
import turnspan.llm.queries  # noqa: F401
from compare import compare
from turnspan.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same, note = compare(spark, SF, name)
    assert same, note


def test_pipeline_stages(spark):
    docs = registry.table(spark, SF, "documents")
    before, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        assert after.columns[: len(docs.columns)] == docs.columns, name
        kept = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids, name
        before, ids = after, set(kept)
    whole = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert whole == ids


CONTRACTS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op6_near_duplicates": "doc_id class_id",
    "op7_quality_rank": "doc_id held_out score predicted",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_html_text": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_columns(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns = CONTRACTS[name].split()
    assert df.columns[: len(columns)] == columns
    assert df.count() == registry.table(spark, SF, "pages" if "page_id" in columns else "documents").count()
