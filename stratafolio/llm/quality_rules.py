"""Quality rules: one threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent function words by language. The rule that counts them holds for texts of these languages, or of none given.
STOP_WORDS = {
    "en": "the of and to in is that for it as with was on are be this by from or an at not a",
    "fr": "le la les de des du et un une en que qui dans pour par sur est au avec",
    "de": "der die das und in den von zu mit sich ist ein eine auf für im dem des nicht als auch es an er",
    "es": "el la los las de que y en un una por con para se del al lo no su es como",
}
SYMBOLS = "#*$%&|<>"

@dataclass(frozen=True)
class Rule:
    """A ratio of two measures and the bounds it must keep, where the text has at least so many words and the measure `where` holds."""

    name: str
    over: str
    under: str
    least: float | None = None
    most: float | None = None
    words: int = 0
    where: str | None = None


#: The threshold table. Ratios are compared by multiplication; a zero denominator keeps the rule.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbols", "n_symbols", "n_words", most=0.25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.4),
    Rule("stop_words", "n_stop_words", "n_words", least=0.04, words=50, where="stop_language"),
    Rule("upper_case", "n_upper", "word_chars", most=0.4),
    Rule("exclamations", "n_exclaim", "n_words", most=0.25),
    Rule("digits", "n_digits", "word_chars", most=0.4),
    Rule("bullets", "n_bullet_lines", "n_lines", most=0.9),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=0.3),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def occurrences(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def windows_of(words: Column, size: Column) -> Column:
    """A hash of each window of three words, in order."""
    three = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), three)).otherwise(F.array().cast("array<bigint>"))


def twice(ordered: Column) -> Column:
    """Hashes that occur twice or more in the sorted array, each once."""
    return F.array_distinct(F.filter(ordered, lambda h, k: h == F.get(ordered, k - 1)))


def marked(windows: Column, repeated: Column, few: int = 24) -> Column:
    """Positions of the windows whose hash is repeated, ascending.

    A few repeated hashes are looked up directly; many are found by sorting (hash, position) and comparing
    neighbours, so that the cost stays n log n however repetitive the text is.
    """
    at = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    direct = F.filter(at, lambda x: F.array_contains(repeated, x["h"]))
    return F.when(F.size(repeated) <= few, F.transform(direct, lambda x: x["i"])).otherwise(F.sort_array(sorted_twice(F.sort_array(at))))


def sorted_twice(ordered: Column) -> Column:
    """Of (hash, position) in order of hash, the positions with an equal neighbour."""
    numbered = F.arrays_zip(ordered["h"].alias("h"), ordered["i"].alias("i"), F.concat(F.array(F.lit(None).cast("bigint")), F.slice(ordered["h"], 1, F.size(ordered) - 1)).alias("before"), F.concat(F.slice(ordered["h"], 2, F.size(ordered)), F.array(F.lit(None).cast("bigint"))).alias("after"))
    return F.transform(F.filter(numbered, lambda x: x["h"].eqNullSafe(x["before"]) | x["h"].eqNullSafe(x["after"])), lambda x: x["i"])


def covered(at: Column) -> Column:
    """Words under the marked windows: each adds what the next one doesn't cover."""
    each = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), p + 3) - p))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame) -> DataFrame:
    """docs with the measures in columns under `m`; other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(F.struct("*").alias("row"), text.alias("t"), words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    step = step.select("*", F.size("w").alias("n"))
    step = step.select("*", windows_of(F.col("w"), F.col("n")).alias("h"))
    step = step.select("*", F.sort_array("h").alias("ordered"))
    step = step.select("*", twice(F.col("ordered")).alias("repeated"))
    step = step.select("*", F.when(F.size("repeated") == 0, F.array().cast("array<int>")).otherwise(marked(F.col("h"), F.col("repeated"))).alias("at"))
    language = F.coalesce(F.col("row.lang").cast("string").isin(*STOP_WORDS), F.lit(True)) if "lang" in docs.columns else F.lit(True)
    stop = sorted({form for words in STOP_WORDS.values() for w in words.split() for form in (w, w.capitalize(), w.upper())})
    m = {
        "n_words": F.col("n").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": occurrences(F.col("t"), SYMBOLS),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": covered(F.col("at")),
        "n_stop_words": F.size(F.filter("w", lambda w: w.isin(stop))).cast("long"),
        "n_upper": occurrences(F.col("t"), "A-Z"),
        "n_exclaim": occurrences(F.col("t"), "!"),
        "n_digits": occurrences(F.col("t"), "0-9"),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(f"^[{SPACE}]*[-*•]"))).cast("long"),
        "stop_language": language,
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))).cast("long"),
    }
    # A filter on the verdict must not move below this step and compute the measures again inside itself; a row number stops it.
    return step.select("row", F.struct(*(c.alias(k) for k, c in m.items())).alias("m"), F.monotonically_increasing_id().alias("place"))


def failed_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measures break: the table as one expression."""
    out = []
    for r in rules:
        over, under = m[r.over], m[r.under]
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (over < F.lit(r.least) * under)
        if r.most is not None:
            bad = bad | (over > F.lit(r.most) * under)
        bad = bad & m[r.where] if r.where else bad
        out.append(F.when(bad & (under > 0) & (m["n_words"] >= r.words), F.lit(r.name)))
    return F.array_compact(F.array(*out))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of docs: `row` (its columns as they were, whatever their names), `m` (measures),
    `broken` (rules broken, in table order), `base_failed` and `kept`.

    A null text counts as empty: no words, so it fails the base. A column `lang` says which language's rules apply; without it, or where it is
    null, all do. Repeated rows are judged alike, an empty table
    gives no rows, a text of any length is measured whole.
    """
    scored = measured(docs).select("*", failed_rules(F.col("m"), rules).alias("broken"), base_failed(F.col("m")).alias("base_failed"))
    return scored.select("*", (~F.col("base_failed") & (F.size("broken") == 0) & (F.col("place") >= 0)).alias("kept"))
