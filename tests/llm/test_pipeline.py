import re

import corpus_pipeline
from molspark.llm import adaptive_rules, contamination, secrets, simhash
from molspark.staging import stage
from tests.llm.helpers import FOLDER, SCHEMA


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "mask_secrets", "encode"]
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, FOLDER), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(kept[name]) <= {r.doc_id for r in before.collect()}
    good = {r.doc_id for r in adaptive_rules.judge(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("kept").collect()}
    assert set(kept["quality_rules"]) == good
    groups = [r.component_id for r in simhash.near_duplicates(docs).collect()]
    assert len(groups) == len(set(groups))
    assert contamination.contaminated(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0
    assert secrets.find_secrets(docs).where("n_hex > 0 OR n_access > 0").count() == 0
    assert any(secrets.MASK in t for t in kept["mask_secrets"].values()) or not any(re.search("[0-9a-f]{32}", t) for t in kept["decontaminate"].values())
    coded = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()}
    assert {i: r.decoded for i, r in coded.items()} == kept["mask_secrets"]


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded"] and found.count() > 0


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, FOLDER), name)
        assert docs.count() == 0
