"""Page states: which pages need recognition, what recognition made of them, and what that says of the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality

# Reasons that make a text layer untrustworthy, states that keep a page from being ready, the default thresholds.
DAMAGE = ("control_characters", "c1_or_del_characters", "cid_style_glyph_runs", "replacement_chars", "cid_font_unsupported")
OPEN = ("ocr_low_confidence", "ocr_failed", "needs_ocr_unmet", "missing_content", "damaged_text_layer")
LEAST_CONFIDENCE, MOST_PAGES = 0.6, 200


def _reasons() -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.concat(quality.ocr_reasons(F.length(text), text), F.when(F.coalesce("unmapped", F.lit(False)), F.array(F.lit("cid_font_unsupported"))).otherwise(F.array().cast("array<string>")))


def to_recognise(pages: DataFrame, keys: list[str], most: int | None = MOST_PAGES) -> DataFrame:
    """keys, page and reasons of the pages (keys.., page, text, unmapped) whose text layer is missing, sparse or damaged: the first `most` of a document, or all."""
    wanted = pages.withColumn("reasons", _reasons()).where(F.size("reasons") > 0)
    if most is None:
        return wanted.select(*keys, "page", "reasons")
    return wanted.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("page"))).where(F.col("n") <= most).select(*keys, "page", "reasons")


def page_states(pages: DataFrame, keys: list[str], recognised: DataFrame | None = None, least_confidence: float = LEAST_CONFIDENCE, fallback_below: float = 0.0) -> DataFrame:
    """keys, page, text (what counts), state, confidence and reasons of pages (keys.., page, text, unmapped; a null text is a page without content).

    recognised: keys, page, ocr_text, confidence, failed, and those of a fallback engine, fallback_text and fallback_confidence (null where none
    ran). A page that needs recognition takes it: a damaged layer is replaced, a sparse one is followed by it. The fallback's text counts where
    the first engine found nothing or was less sure than `fallback_below`. Pages that got none are needs_ocr_unmet; text that is still damaged without recognition is a
    damaged_text_layer; what was recognised with too little confidence is ocr_low_confidence.
    """
    blank = lambda t: F.coalesce(~t.rlike(r"(?U)\S"), F.lit(True))
    rated = pages.withColumn("reasons", _reasons())
    if recognised is None:
        read = rated.withColumn("r", F.lit(None).cast("struct<ocr_text:string,confidence:double,failed:boolean,fallback_text:string,fallback_confidence:double>"))
    else:
        values = F.struct("ocr_text", F.col("confidence").cast("double").alias("confidence"), "failed", "fallback_text", F.col("fallback_confidence").cast("double").alias("fallback_confidence"))
        read = rated.join(recognised.select(*keys, "page", values.alias("r")), [*keys, "page"], "left")
    r, layer = F.col("r"), F.coalesce("text", F.lit(""))
    wants = F.size("reasons") > 0
    second = (blank(r["ocr_text"]) | (r["confidence"] < fallback_below)) & ~blank(r["fallback_text"])
    got = F.when(second, r["fallback_text"]).otherwise(r["ocr_text"])
    sure = F.when(second, F.greatest(r["confidence"], r["fallback_confidence"])).otherwise(r["confidence"])
    applied = wants & r.isNotNull() & ~F.coalesce(r["failed"], F.lit(False)) & ~blank(got)
    damaged = F.arrays_overlap("reasons", F.array(*map(F.lit, DAMAGE)))
    text = F.when(applied & damaged, got).when(applied, F.regexp_replace(F.concat(layer, F.lit("\n"), got), r"(?U)^\s+|\s+$", "")).otherwise(layer)
    state = F.when(applied & (sure < least_confidence), "ocr_low_confidence").when(applied, "ocr_applied").when(wants & r["failed"], "ocr_failed").when(wants, "needs_ocr_unmet").otherwise("text_layer")
    seen = read.select(*keys, "page", F.col("text").isNull().alias("missing"), text.alias("text"), state.alias("state"), F.when(applied, sure).alias("confidence"), "reasons")
    still = F.size(quality.damage_tags(F.col("text"))) > 0
    return seen.withColumn("state", F.when(still & (F.col("state") != "ocr_applied"), "damaged_text_layer").otherwise(F.col("state")))


def document_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pages, chars_per_page, page_ocr_status (in page order), counts of unmet, missing and unsure pages, and status of the pages' documents: failed
    without any text, review while a page is open, else ready. Gathered are numbers and states, never texts."""
    page = F.struct("page", F.length("text").alias("chars"), "state")
    per = states.groupBy(*keys).agg(F.array_sort(F.collect_list(page)).alias("p"), F.count_if(F.col("state") == "needs_ocr_unmet").alias("unmet_ocr_pages"), F.count_if("missing").alias("missing_content_pages"), F.count_if(F.col("state") == "ocr_low_confidence").alias("low_confidence_pages"), F.bool_or(F.col("text").rlike(r"(?U)\S")).alias("some"), F.bool_or(F.col("state").isin(*OPEN) | F.col("missing")).alias("open"))
    status = F.when(~F.coalesce("some", F.lit(False)), "failed").when(F.col("open"), "review").otherwise("ready")
    return per.select(*keys, F.size("p").alias("pages"), F.col("p.chars").alias("chars_per_page"), F.col("p.state").alias("page_ocr_status"), "unmet_ocr_pages", "missing_content_pages", "low_confidence_pages", status.alias("status"))
