"""Text: tokens, snippets, escapes, citations, estimates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The three ranges of Han characters that become terms, and the shape of a Latin term.
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
LATIN_TERM = "[A-Za-z0-9][A-Za-z0-9._%+-]*"
QUERY_CHARS = 2000

# Frequent traditional characters and their simplified forms, version 1 of our own table.
TRADITIONAL = "財報業績說國際開關東門車馬魚鳥書長風電話語學會員經濟動產發證據點類數體現實預測風險資料庫總結構優勢"
SIMPLIFIED = "财报业绩说国际开关东门车马鱼鸟书长风电话语学会员经济动产发证据点类数体现实预测风险资料库总结构优势"
FOLDING = "nfkc+t2s-1"


def normalized(text: Column) -> Column:
    """NFKC, then traditional to simplified by our table; null and empty pass through. Python, as Spark has no NFKC."""
    table = str.maketrans(TRADITIONAL, SIMPLIFIED)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([t if not t else unicodedata.normalize("NFKC", t).translate(table) for t in batch.to_pylist()], pa.string())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def tokens(text: Column) -> Column:
    """Terms in order: Latin terms lowered, then of each Han run its characters and its pairs."""
    latin = F.transform(F.regexp_extract_all(text, F.lit(LATIN_TERM), 0), lambda t: F.lower(t))
    runs = F.regexp_extract_all(text, F.lit(f"[{HAN}]+"), 0)
    singles = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i, F.lit(1)))
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(latin, F.flatten(F.transform(runs, lambda r: F.concat(singles(r), pairs(r)))))


def distinct_terms(text: Column) -> Column:
    """The terms of the whole text in order, each once."""
    return F.array_distinct(tokens(text))


def query_terms(query: Column) -> Column:
    """The terms of what a person typed, of which QUERY_CHARS characters count (STR3). Searches by texts of a table take distinct_terms."""
    return distinct_terms(F.substring(query, 1, QUERY_CHARS))


def snippet(text: Column, terms: Column, width: int = 80) -> tuple[Column, Column]:
    """The text around the first match, and the spans of the first match of each term, ordered; a prefix without a match."""
    low = F.lower(text)
    spans = F.array_sort(F.filter(F.transform(terms, lambda t: F.struct((F.position(F.lower(t), low) - 1).alias("start"), (F.position(F.lower(t), low) - 1 + F.length(t)).alias("end"))), lambda s: s["start"] >= 0))
    first = F.get(spans, F.lit(0))["start"]
    lo = F.greatest(F.lit(0), first - width // 4)
    hi = F.least(F.length(text), lo + width)
    shown = F.when(F.size(spans) == 0, F.substring(text, 1, width)).otherwise(F.substr(text, F.greatest(F.lit(0), hi - width) + 1, hi - F.greatest(F.lit(0), hi - width)))
    return shown, spans


def decoded(content: Column) -> Column:
    """(text, encoding) of bytes: utf-8, or utf-8-replaced where something malformed became a replacement character."""
    fine = F.is_valid_utf8(content.cast("string"))
    return F.struct(F.make_valid_utf8(content.cast("string")).alias("text"), F.when(content.isNotNull(), F.when(fine, "utf-8").otherwise("utf-8-replaced")).alias("encoding"))


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def display_title(title: Column) -> Column:
    """Percent-decoded if that leaves no percent sign; a plus stays a plus."""
    trimmed = F.trim(F.coalesce(title, F.lit("")))
    decoded = F.try_url_decode(F.replace(trimmed, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(trimmed, F.lit("%")) & decoded.isNotNull() & (decoded != "") & (decoded != trimmed) & ~F.contains(decoded, F.lit("%")), decoded).otherwise(trimmed)


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


# Characters that YAML and Markdown read as more than themselves.
YAML_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\x00", "\\0"))
MARKDOWN_SPECIAL = r"([\\`*_{}\[\]()#+.!|<>&~])"


def yaml_scalar(text: Column) -> Column:
    """A double-quoted YAML scalar; control characters are written as escapes."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    for char, escape in YAML_ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(escape))
    control = F.filter(F.array(*(F.lit(chr(k)) for k in (*range(1, 9), 11, 12, *range(14, 32), 127))), lambda x: F.contains(out, x))
    out = F.when(out.rlike(r"[\x01-\x1f\x7f]"), F.aggregate(control, out, lambda a, x: F.replace(a, x, F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(x))), 2, "0"))))).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def markdown_text(text: Column, block: bool = False) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    out = F.regexp_replace(out, MARKDOWN_SPECIAL, r"\\$1")
    return out if block else F.replace(out, F.lit("\n"), F.lit(" "))


def safe_filename(name: Column, longest: int = 120) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(cleaned == "", "unnamed").otherwise(cleaned), 1, longest)


def safe_component(value: Column) -> Column:
    """An identifier as a path component: a valid one as it is, another cleaned and with a short digest, so that no two meet."""
    cleaned = F.substring(F.regexp_replace(value, r"[^\p{L}\p{N}._-]", "_"), 1, 96)
    bare = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(valid_id(value), value).otherwise(F.concat(F.when(bare == "", "id").otherwise(bare), F.lit("-"), F.substring(F.sha2(value, 256), 1, 12)))


def ascii_folded(value: Column) -> Column:
    """The ASCII letters of a text once marks are taken off (NFKD); what has none is dropped."""

    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield pa.array([v if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii") for v in batch.to_pylist()], pa.string())

    run.__annotations__ = {"values": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(value)


def safe_url(url: Column) -> Column:
    trimmed = F.trim(url)
    return F.when(F.lower(trimmed).rlike("^https?://"), trimmed)


def normalized_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(F.coalesce(symbol, F.lit(""))))


def human_size(size: Column) -> Column:
    """A size to one place, half to even as C and Python print it: ten times a fraction of a power of two is exact, so rint sees the tie itself."""
    out = F.lit("unknown")
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        shown = F.concat(size.cast("long").cast("string"), F.lit(" B")) if power == 0 else F.format_string(f"%.1f {unit}", F.rint(size / F.lit(float(1024**power)) * 10) / 10)
        out = F.when(size.isNotNull() & ((size < 1024.0 ** (power + 1)) | F.lit(unit == "TB")), shown).otherwise(out)
    return out


def format_of(media_type: Column, ext: Column) -> Column:
    value = F.lower(F.coalesce(F.nullif(ext, F.lit("")), F.nullif(media_type, F.lit("")), F.lit("")))
    has = lambda *marks: value.rlike("|".join(marks))
    return F.when(has("pdf"), "pdf").when(has("htm"), "html").when(has("png", "jpg", "jpeg", "image"), "img").when(has("text") | (value == "txt"), "txt").otherwise("other")


def language_of(value: Column) -> Column:
    return F.substring(F.lower(F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))), 1, 8)


def estimated_tokens(text: Column) -> Column:
    """The measuring heuristic: a token for each Han character, a quarter for each other."""
    han = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return F.coalesce(F.bround(han + (F.length(text) - han) / F.lit(4.0), 0).cast("long"), F.lit(0))


def reserved_tokens(text: Column) -> Column:
    """The budget's upper bound."""
    text = F.coalesce(text, F.lit(""))
    han = F.regexp_count(text, F.lit(r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"))
    return (han + F.floor((F.length(text) - han + 3) / 4) + 8).cast("long")


def citations(text: Column) -> Column:
    """Numbers cited as [n], distinct and ascending; none is too long (up to 38 digits are told apart, longer ones are the greatest)."""
    most = "9" * 38
    digits = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda n: F.when(F.length(n) > 38, F.lit(most)).otherwise(n).cast("decimal(38,0)"))))


def valid_citations(text: Column, sources: Column) -> Column:
    return F.filter(citations(text), lambda n: (n >= 1) & (n <= sources))


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(\.\d+)?\s*(%|亿|万|bn|mm)?"), 0)


def links(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), 1)


def wikilinks(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"\[\[([^\]|#]+)"), 1)


def redacted(text: Column) -> Column:
    """Tokens and secrets in log lines replaced."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(authorization|token|secret|password|api[_-]?key)(\s*[:=]\s*)\S+", "$1$2***"), r"https?://[^\s@/]+@", "https://***@")


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$"), F.lit(False))


def safe_relative_path(path: Column) -> Column:
    return F.when(path.rlike(r"^[^/\\\x00][^\\\x00]*$") & ~path.rlike(r"(^|/)\.\.?(/|$)"), path)
