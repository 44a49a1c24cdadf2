"""Metadata flags, contract checks, byte ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import iso_day

# Parts of a document type that mark a financial filing; the fiscal-year words of a title.
FINANCIAL = ("report", "earnings", "results", "interim", "annual", "quarter", "公告", "報告", "报告", "財報", "财报", "季報", "季报", "年報", "年报", "中期", "业绩", "業績")
FISCAL_TITLE = r"(20\d{2})\s*(?:財政年度|财政年度|財務年度|财务年度)(中期)?"
SUSPECT_DAYS = 400


def flags_of(period: Column, published: Column, title: Column, symbol: Column, doc_type: Column) -> Column:
    """Advisory flags of a document's stored metadata, in a fixed order."""
    period, symbol = F.trim(F.coalesce(period, F.lit(""))), F.trim(F.coalesce(symbol, F.lit("")))
    day, published_day = iso_day(period), iso_day(published)
    years = F.regexp_extract_all(title, F.lit(FISCAL_TITLE), 1)
    halves = F.regexp_extract_all(title, F.lit(FISCAL_TITLE), 2)
    annual = lambda y: F.array(*(F.concat(y, F.lit(e)) for e in ("-03-31", "-12-31")))
    interim = lambda y: F.array(F.concat((y.cast("int") - 1).cast("string"), F.lit("-09-30")), *(F.concat(y, F.lit(e)) for e in ("-06-30", "-09-30", "-12-31")))
    expected = F.flatten(F.zip_with(years, halves, lambda y, h: F.when(h == "", annual(y)).otherwise(interim(y))))
    financial = F.lower(F.coalesce(doc_type, F.lit(""))).rlike("|".join(FINANCIAL))
    return F.array_compact(
        F.array(
            F.when((period != "") & ~period.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("period_invalid")),
            F.when(F.abs(F.datediff(published_day, day)) > SUSPECT_DAYS, F.lit("period_suspect")),
            F.when(day.isNotNull() & (F.size(years) > 0) & ~F.array_contains(expected, day.cast("string")), F.lit("period_title_mismatch")),
            F.when(financial & (period == ""), F.lit("period_missing")),
            F.when(financial & (symbol == ""), F.lit("symbol_missing")),
        )
    )


def effective_date(*candidates: Column) -> Column:
    """The first known date, as ten characters."""
    return F.coalesce(*(F.nullif(F.substring(c, 1, 10), F.lit("")) for c in candidates))


def evidence_errors(block: Column) -> Column:
    """Contract violations of an evidence block struct, in the order of its fields."""
    text = lambda c: F.coalesce(F.length(block[c]) > 0, F.lit(False))
    checks = [(~text(c), f"{c} missing") for c in ("source", "doc_id", "source_version", "extraction_id", "block_id", "text")]
    checks += [(~F.coalesce(block["source_sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "source_sha256 malformed"), (~F.coalesce(block["block_type"].isin("paragraph", "heading", "table", "ocr", "page"), F.lit(False)), "block_type unknown")]
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))


def byte_range(header: Column, size: Column) -> Column:
    """(kind, start, end) of an HTTP range header: full, range or invalid."""
    text = F.trim(header)
    form = r"^bytes=(\d*)-(\d*)$"
    spec = F.regexp_extract(text, form, 0)
    digits = lambda k: F.regexp_replace(F.regexp_extract(text, form, k), "^0+(?=.)", "")
    first, last = (F.when(F.length(digits(k)) > 18, F.lit(10**18)).otherwise(digits(k).try_cast("long")) for k in (1, 2))  # beyond any size
    suffix = first.isNull()
    start = F.when(suffix, F.greatest(F.lit(0).cast("long"), size - last)).otherwise(first)
    end = F.when(suffix, size - 1).otherwise(F.least(F.coalesce(last, size - 1), size - 1))
    bad = (spec == "") | (suffix & (last.isNull() | (last <= 0))) | (start < 0) | (start >= size) | (F.coalesce(last, size - 1) < start) & ~suffix
    none = F.lit(None).cast("long")
    kind = F.when(F.coalesce(header, F.lit("")) == "", "full").when(F.coalesce(bad, F.lit(True)), "invalid").otherwise("range")
    return F.struct(kind.alias("kind"), F.when(kind == "range", start).otherwise(none).alias("start"), F.when(kind == "range", end).otherwise(none).alias("end"))
