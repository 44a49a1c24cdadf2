import random

import pytest
from pyspark.sql import functions as F

from stratafolio.llm import suffix_dedup

from .test_suffix_dedup import brute


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, as on tables too large to send, and as many partitions as asked for."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_passage_of_many_texts_is_not_one_task(shuffled, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefg hé", k=150))
    texts = ["".join(rng.choices("xyz ", k=rng.randint(20, 90))) + f"#{k}#" + passage + "".join(rng.choices("xyz ", k=rng.randint(20, 90))) for k in range(160)]
    spreads = []

    def write(df):
        out = written(df)
        if set(df.columns) == {"h", "x", "key", "lo", "hi", "m"}:  # all runs, then those with a seed in several places
            placed = df.select("h", F.spark_partition_id().alias("task"))
            spread = placed.groupBy("h").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks")).orderBy(F.desc("n")).first()
            spreads.append((spread.n, spread.tasks))
        return out

    written = suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", write)
    docs = shuffled.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(docs, 64, 16).collect()}
    assert [got[k] for k in range(len(texts))] == brute([t.encode() for t in texts], 64)
    assert len(spreads) == 2 and spreads[1][0] >= len(texts) and spreads[1][1] > 1


def test_joined_is_the_inner_join(shuffled):
    rows = shuffled.createDataFrame([(k % 7 if k < 40 else k, k) for k in range(60)], "h long, v long").repartition(5)
    keys = shuffled.createDataFrame([(0, 6), (3, 6), (45, 1), (99, 1)], "h long, places long")
    for bound in (0, 2, 9):
        got = suffix_dedup.joined(rows, keys, ["h"], F.col("places") > bound)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keys, "h").collect()))
