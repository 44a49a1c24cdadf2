import corpus_pipeline

from .test_decontamination import shingles
from .test_filters import measures
from .test_near_copies import survivors


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]
    text = {r.doc_id: r.text for r in docs.collect()}

    first = stages["quality rules"](spark, docs, sf)
    assert first.columns == columns
    kept = {r.doc_id for r in first.collect()}
    for k, t in text.items():
        n = measures(t)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert k not in kept
    first = corpus_pipeline.written(first)

    second = corpus_pipeline.written(stages["SimHash near-dedup"](spark, first, sf))
    ids = sorted(kept)
    similar = {ids[k] for k in survivors([text[k] for k in ids])}  # five words, a similarity of 0.8
    stay = {r.doc_id for r in second.collect()}
    assert second.columns == columns and stay == similar

    third = corpus_pipeline.written(stages["benchmark decontamination"](spark, second, sf))
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {k for k in stay if not any(q and 5 * len(q & shingles(text[k])) >= 4 * len(q) for q in items)}
    assert third.columns == columns and {r.doc_id for r in third.collect()} == clean

    fourth = corpus_pipeline.written(stages["PII"](spark, third, sf))
    assert fourth.columns == columns and {r.doc_id for r in fourth.collect()} == clean
    assert not [r for r in fourth.where("text LIKE '%@mail%'").collect() if r.text == text[r.doc_id]]

    last = stages["packing"](spark, fourth, sf).collect()
    assert {r.doc_id for r in last} == clean
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(last)


def test_nulls_and_empty_tables(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, sf).collect()
