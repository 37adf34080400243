"""The registered queries: their SQL twins, and what they return."""

import pytest

import __spark_entry__ as entry
from gate.check import compare, connection
from hushframe.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": "doc_id keep_id group_size kept text_sha256", "op2": "doc_id fingerprint component_id",
    "op3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op4": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5": "doc_id held_out score predicted", "op6": "doc_id piece start length ids_crc32 sequence_id offset", "op7": "doc_id n_words n_removed kept_sha256",
    "op11": "anchor_id positive_id rank negative_id positive_score negative_score", "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13": "doc_id n_shingles component_id kept",
    "op8": "page_id url text n_chars", "op9": "doc_id size source_size target taken", "op10": "page_id payload_bytes payload_digest record_type refers_to",
}


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {*COLUMNS, "pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connection(sf), ORACLES[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.split("_")[0] in ("op3", "op9"):
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_whole_tables_are_returned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op4_suffix_array", "op5_toxicity", "op2_simhash"):
        assert QUERIES[name](spark, sf).select("doc_id").distinct().count() == docs
