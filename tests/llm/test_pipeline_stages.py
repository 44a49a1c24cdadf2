import corpus_pipeline

from .test_decontamination import shingles
from .test_near_copies import survivors


def test_each_stage_against_plain_python_with_the_similarity_rule(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, text = dict(corpus_pipeline.STAGES), {r.doc_id: r.text for r in docs.collect()}
    first = corpus_pipeline.written(stages["quality rules"](spark, docs, sf))
    ids = sorted(r.doc_id for r in first.collect())
    second = corpus_pipeline.written(stages["SimHash near-dedup"](spark, first, sf))
    stay = {ids[k] for k in survivors([text[k] for k in ids])}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == stay
    third = corpus_pipeline.written(stages["benchmark decontamination"](spark, second, sf))
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {k for k in stay if not any(q and 5 * len(q & shingles(text[k])) >= 4 * len(q) for q in items)}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == clean
    fourth = corpus_pipeline.written(stages["PII"](spark, third, sf))
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == clean
    last = stages["packing"](spark, fourth, sf).collect()
    assert {r.doc_id for r in last} == clean


def test_extra_columns_with_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).selectExpr("*", "1 AS row", "'a' AS node", "2 AS kept", "3 AS fp", "4 AS m", "5 AS found", "6 AS t", "7 AS component", "8 AS length")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf))
        assert out.columns == docs.columns
        docs = out
    corpus_pipeline.packing(spark, docs, sf).collect()
