"""Text quality: damage signals, status lattice, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of quality policy 2.
POLICY = 2
LEAST_CHARS, MOST_REPLACED, MOST_CONTROL, MOST_C1 = 40, 0.02, 0.02, 0.02
LINE_SHARE, LEAST_LINES, SPARSE_SHARE = 0.6, 8, 0.5
CONTROL, C1, HIGH = r"[\x00-\x08\x0b\x0c\x0e-\x1f]", r"[\x7f-\x9f]", r"[\x{a0}-\x{ff}]"


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.lit(1), F.length(text))


def _tags(*conditions: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(tag)) for c, tag in conditions)))


def _damage(text: Column) -> list[tuple[Column, str]]:
    return [
        ((_share(text, CONTROL) > MOST_CONTROL) | text.rlike(CONTROL + "{4,}"), "control_characters"),
        (_share(text, C1) > MOST_C1, "c1_or_del_characters"),
        ((F.regexp_count(text, F.lit(HIGH + "{6,}")) >= 3) | text.rlike(HIGH + "{18,}"), "cid_style_glyph_runs"),
    ]


def damage_tags(text: Column) -> Column:
    """Signs of a damaged text layer; a maximal run counts once."""
    return _tags(*_damage(text))


def replaced(text: Column) -> Column:
    return _share(text, r"\x{fffd}") > MOST_REPLACED


def usable(text: Column) -> Column:
    """Whether a block may serve as evidence."""
    bad = replaced(text)
    for condition, _ in _damage(text):
        bad = bad | condition
    return ~bad


def stripped_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\R|[\x1c-\x1e]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def most_common_share(lines: Column) -> Column:
    """Share of the most common value: the longest run in the sorted array."""
    ordered = F.array_sort(lines)
    run = F.aggregate(ordered, F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(x == a["last"], a["run"] + 1).otherwise(1)).alias("best")), lambda a: a["best"])
    return F.when(F.size(lines) > 0, run / F.size(lines)).otherwise(F.lit(0.0))


def assessed(text: Column, lines: Column, page_chars: Column | None = None) -> Column:
    """(status, issues) of a text; lines are its stripped non-blank lines."""
    conditions = [(F.length(text) < LEAST_CHARS, "too_short"), (replaced(text), "replacement_chars"), *_damage(text), ((F.size(lines) >= LEAST_LINES) & (most_common_share(lines) > LINE_SHARE), "repetitive_lines")]
    if page_chars is not None:
        conditions.append(((F.size(page_chars) > 0) & (F.size(F.filter(page_chars, lambda n: n == 0)) / F.size(page_chars) > SPARSE_SHARE), "mostly_sparse_pages"))
    blank = F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))
    issues = F.when(blank, F.array(F.lit("no_text"))).otherwise(_tags(*conditions))
    return F.struct(F.when(blank, "failed").when(F.size(issues) > 0, "review").otherwise("ready").alias("status"), issues.alias("issues"))


def ocr_reasons(page_chars: Column, text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return _tags((page_chars == 0, "no_text_layer"), ((page_chars != 0) & (F.length(trimmed) < 10), "very_sparse_text"), (replaced(text), "replacement_chars"), *_damage(text))


def worst_status(*statuses: Column) -> Column:
    """ready < review < failed; an unknown status weighs as review."""
    weight = lambda s: F.when(s == "ready", 0).when(s == "failed", 2).otherwise(1)
    return F.get(F.array(F.lit("ready"), F.lit("review"), F.lit("failed")), F.greatest(F.lit(0), *map(weight, statuses)))


# Markers in an extraction's issues that speak of damage, and parsers whose text isn't trusted.
DAMAGE_MARKERS = ("cid_font_unsupported", "control_characters", "c1_or_del_characters", "cid_style_glyph_runs")
LEGACY_PARSERS = "^stdlib-pdf"


def recommended_action(parser: Column, status: Column, issues: Column, damaged_pages: Column, pages: Column, usable_blocks: Column, blocks: Column, source_available: Column) -> Column:
    flagged = F.arrays_overlap(issues, F.array(*map(F.lit, DAMAGE_MARKERS))) | (damaged_pages > 0)
    return (
        F.when(~source_available, "missing_source")
        .when(parser.rlike(LEGACY_PARSERS), "native_reextract")
        .when(flagged & (pages > 0) & (damaged_pages >= F.greatest(F.lit(1), F.floor(pages / 2))), "ocr")
        .when(flagged | (usable_blocks < blocks) | (status == "failed"), "manual_review")
        .otherwise("keep")
    )


# How a list of charts, a caption and a line of numbers look, and how many of them speak of a chart.
CHART_LIST = "(?i)图表目录|圖表目錄|list of (?:figures|tables)"
CAPTION = r"(?im)^\s*(?:图(?:表)?|圖(?:表)?|figure|fig\.?|chart|exhib[iIl]t)\s*\d+"
NUMBER_LINE, NUMBER_LINE_LENGTH = r"[\s\d.,%％+−\-–—()（）:/年月日]+", 30
CAPTIONED_LINES, MANY_LINES, LONG_RUN = 8, 24, 8


def chart_signal(text: Column, lines: Column) -> Column:
    """(kind, requires_review, caption_count, numeric_lines, longest_numeric_run) of a block."""
    navigation = text.rlike(CHART_LIST)
    captions = F.regexp_count(text, F.lit(CAPTION))
    # one letter a line, so that runs of numeric lines are runs of letters
    marks = F.array_join(F.transform(lines, lambda x: F.when((F.length(x) <= NUMBER_LINE_LENGTH) & x.rlike(f"^(?U){NUMBER_LINE}$"), "n").otherwise("-")), "")
    longest = F.coalesce(F.array_max(F.transform(F.split(marks, "-+"), lambda run: F.length(run))), F.lit(0))
    count = F.length(F.replace(marks, F.lit("-"), F.lit("")))
    risk = ((captions > 0) & (count >= CAPTIONED_LINES)) | ((count >= MANY_LINES) & (longest >= LONG_RUN))
    kind = F.when(navigation, "navigation").when(risk, "chart_or_table_candidate").otherwise("unclassified")
    return F.struct(kind.alias("kind"), (risk & ~navigation).alias("requires_review"), captions.alias("caption_count"), count.alias("numeric_lines"), longest.alias("longest_numeric_run"))
