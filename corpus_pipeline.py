"""The corpus pipeline: quality rules, near-dedup, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. No stage is expressible in SQL as a whole
(tokenizer ids, fingerprint components), so the pipeline is tested against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafolio.llm.common import table, written
from stratafolio.llm.decontamination import leaks_of
from stratafolio.llm.near_copies import grouped
from stratafolio.llm.packing import pack
from stratafolio.llm.pii import pseudonymised
from stratafolio.llm.quality_rules import judge


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies have a Jaccard similarity of at least 0.8 of five-word shingles, in one step or several. Of each group, the row
    whose doc_id names it stays; every row is judged by its own text, also where a doc_id repeats. Rows without a doc_id stay only
    where their whole group has none."""
    found, named = grouped(docs)
    gone = found.select("row", "doc.doc_id", "node").join(named, "node").where("NOT doc_id <=> component_id").select("row")
    return found.join(gone, "row", "left_anti").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(F.size(leaks_of(F.col("text"), table(spark, sf_dir, "benchmark"))) == 0)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonymised(docs)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", pseudonyms), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
