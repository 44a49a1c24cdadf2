"""The registered queries of the training-data operators and, where SQL can say it, their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table
from .oracles import ORACLES  # noqa: F401  registered with the queries


def op1_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .packing import pack

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), tokenizer)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), with_text=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *(F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hexadecimal, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymised

    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "text", F.size("found").cast("long").alias("n_found"), F.array_join("found.kind", ",").alias("kinds"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predicted, trained

    docs = table(spark, sf_dir, "documents")
    model = trained(docs.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    out = predicted(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import judged, outcomes_of

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, outcomes_of(pages, table(spark, sf_dir, "labels")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import scored, trained

    docs = table(spark, sf_dir, "documents")
    model, counts = trained(docs.where(remainder(F.col("doc_id"), 7) != 2).select("text"))
    out = scored(docs, model, counts)
    return out.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import scored, trained

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = trained(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    out = scored(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mined

    return mined(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_language_id, op3_pii, op4_url_filters, op5_suffix_dedup, op6_quality_rules, op7_lm_scoring, op8_quality_classifier, op9_decontamination, op10_simhash, op11_resampling, op12_collocations, op13_exact_dedup)}

