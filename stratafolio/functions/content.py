"""Functions of projected content, JSON values and raw bytes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import estimated_tokens

# Page states and their categories, roles of excluded fragments, marks of page objects and of object streams. The texts of errors below are fixed, too.
CATEGORIES = {"text_layer": "native", "ocr_applied": "ocr"}
ROLES = ("axis", "legend", "unassigned_value")
PAGE_OBJECT = r"/Type\s*/Page[^s]"
OBJECT_STREAM = r"/Type ?/ObjStm"


def _over_texts(name: str, kind: str, arrow: pa.DataType, f: Callable) -> Callable[[Column], Column]:
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield pa.array([f(v) for v in batch.to_pylist()], arrow)

    run.__name__, run.__annotations__ = name, {"values": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lambda value: F.arrow_udf(run, kind)(value)


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces, so that equal values are equal texts; null where the text is no JSON."""
    return _over_texts("canonical_json", "string", pa.string(), lambda t: None if (v := _parsed(t)) is None and (t or "").strip() != "null" else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")))(text)


def _found(value, keys: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield from ((k, v[k]) for k in keys if isinstance(v.get(k), str))
            stack += v.values()
        elif isinstance(v, list):
            stack += v


def json_references(text: Column, keys: tuple[str, ...] = ("block_id", "extraction_id")) -> Column:
    """Every (key, id) that a JSON value names at any depth, distinct and ordered. Exploded, they are joined by equality instead of
    searching each value for each id; text that is no JSON names nothing."""
    kind = pa.list_(pa.struct([("key", pa.string()), ("id", pa.string())]))
    return _over_texts("json_references", "array<struct<key:string,id:string>>", kind, lambda t: [{"key": k, "id": i} for k, i in sorted(set(_found(_parsed(t), keys)))])(text)


def parsed_or_empty(text: Column, schema: str) -> Column:
    """A JSON object as a struct; malformed or missing text gives empty fields."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.lit("{}"), schema))


def source_category(stats: Column, page: Column, is_image: Column) -> Column:
    """native, ocr or unknown: how a page's text was won, from the page states in its extraction's statistics (JSON)."""
    states = parsed_or_empty(stats, "page_ocr_status array<string>")["page_ocr_status"]
    state, out = F.get(states, page - 1), F.lit("unknown")
    for name, category in CATEGORIES.items():
        out = F.when(state == name, category).otherwise(out)
    return F.when(is_image | page.isNull() | (page < 1), "unknown").otherwise(out)


def page_count(content: Column) -> Column:
    """(pages, method) of a PDF's bytes; pages is null where page objects can't be seen, never a guess."""
    text = F.decode(content, "ISO-8859-1")
    pages = F.regexp_count(text, F.lit(PAGE_OBJECT))
    method = F.when(text.rlike(OBJECT_STREAM), "object-streams-unsupported").when(pages == 0, "no-page-objects-found").otherwise("page-object-scan")
    return F.struct(F.when(method == "page-object-scan", pages).alias("pages"), method.alias("method"))


def hashed_vector(text: Column, dimensions: int = 64) -> Column:
    """A unit vector of hashed terms (words, lowered, and pairs of characters): a deterministic stand-in for an embedding."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda k: F.substr(text, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    slots = F.transform(F.array_union(words, pairs), lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.get(F.transform(F.array(F.struct(counts.alias("v"), norm.alias("n"))), lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] > 0, s["n"]).otherwise(1.0))), F.lit(0))


def projected(text: Column, spans: Column, captions: Column) -> Column:
    """(error, text, excluded_characters): text without its excluded spans, each replaced by a line break, and with captions that got lost appended.

    spans: array of (start, end, sha256, action, kind, role, confirmed), offsets in characters. `error` is the first rule that the spans break;
    then text is null.
    """
    cut = lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])
    inside = lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))
    excluded = F.array_sort(F.filter(spans, lambda s: s["action"] == "exclude"))
    kept = F.filter(spans, lambda s: s["action"] == "keep")
    no = lambda f: F.exists(spans, lambda s: ~F.coalesce(f(s), F.lit(False)))
    rules = [
        (no(inside), "invalid character span"),
        (no(lambda s: F.sha2(cut(s), 256) == s["sha256"]), "span hash mismatch"),
        (no(lambda s: s["action"].isin("keep", "exclude")), "invalid span action"),
        (no(lambda s: (s["action"] != "exclude") | ((s["kind"] == "chart") & s["confirmed"])), "only confirmed chart fragments may be excluded"),
        (no(lambda s: (s["action"] != "exclude") | s["role"].isin(*ROLES)), "unknown chart fragment role"),
        (F.exists(F.transform(excluded, lambda s, k: s["start"] < F.get(excluded, k - 1)["end"]), lambda x: F.coalesce(x, F.lit(False))), "overlapping exclusions"),
        (F.exists(excluded, lambda a: F.exists(kept, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))), "exclusion overlaps protected prose or table"),
        (F.exists(captions, lambda x: (x == "") | ~F.contains(text, x)), "caption must be an exact source-text excerpt"),
    ]
    error = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        error = F.when(broken, message).otherwise(error)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("\n")).alias("out"), s["end"].cast("int").alias("at"))
    rest = F.aggregate(excluded, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    whole = F.aggregate(captions, rest, lambda a, x: F.when(F.contains(a, x), a).otherwise(F.concat(a, F.lit("\n"), x)))
    size = F.aggregate(excluded, F.lit(0), lambda a, s: a + (s["end"] - s["start"]).cast("int"))
    return F.struct(error.alias("error"), F.when(error.isNull(), whole).alias("text"), F.when(error.isNull(), size).alias("excluded_characters"))


# The policy of projections, how their text was mapped, their coordinates, and kinds of regions.
POLICY, COORDINATES = "chart-content-v1", "normalized-top-left"
MAPPINGS = ("reviewed-exact-spans", "visually-reviewed-exact-spans", "pdf-character-bbox-exact-whitespace-normalized")
REGIONS = ("chart", "table", "narrative", "navigation", "unknown")
IDENTITY = ("source", "doc_id", "version_id", "extraction_id", "snapshot_sha256")


def manifest_error(manifest: Column, block: Column) -> Column:
    """The first rule of a projection's manifest that is broken, or null: what must hold before its spans are looked at (projected()).

    manifest: policy, review_state, reviewer, the identity, block_id, text_sha256, page, mapping_method, coordinate_system, regions (id, kind, bbox, asset: name and sha256, caption); block: the same identity,
    page and text, or null where there is no such block.
    """
    m, regions = manifest, manifest["regions"]
    some = lambda f: F.coalesce(F.exists(regions, f), F.lit(False))
    ids = F.transform(regions, lambda r: r["id"])
    box = lambda r: r["bbox"]
    at = lambda r, k: F.get(box(r), F.lit(k))
    finite = lambda r: F.forall(box(r), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    inside = lambda r: (at(r, 0) >= 0) & (at(r, 0) < at(r, 2)) & (at(r, 2) <= 1) & (at(r, 1) >= 0) & (at(r, 1) < at(r, 3)) & (at(r, 3) <= 1)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    chart = lambda r: r["kind"] == "chart"
    image = lambda r: r["asset"]["sha256"].rlike("^[0-9a-f]{64}$")
    rules = [
        (no((m["policy"] == POLICY) & (m["review_state"] == "confirmed") & (m["reviewer"] != "")), "projection requires confirmed reviewer and policy"),
        (block.isNull(), "unknown block"),
        *((no(m[k] == block[k]), f"source identity mismatch: {k}") for k in IDENTITY),
        (no(m["text_sha256"] == F.sha2(block["text"], 256)), "stale block text"),
        (no((m["page"] >= 1) & (m["page"] == block["page"])), "physical page mismatch"),
        (no(m["mapping_method"].isin(*MAPPINGS)), "reviewed text mapping method required"),
        (no(m["coordinate_system"] == COORDINATES), "unknown coordinate system"),
        (no(F.size(regions) > 0), "regions required"),
        (some(lambda r: no(r["id"] != "")) | (F.size(F.array_distinct(ids)) < F.size(ids)), "duplicate or missing region id"),
        (some(lambda r: no(r["kind"].isin(*REGIONS))), "invalid region kind"),
        (some(lambda r: no((F.size(box(r)) == 4) & finite(r))), "invalid bbox"),
        (some(lambda r: no(inside(r))), "bbox outside page"),
        (some(lambda r: chart(r) & no(image(r))), "chart image required"),
        (some(lambda r: chart(r) & no(r["asset"]["name"] == F.concat(r["asset"]["sha256"], F.lit(".png")))), "asset must use content-addressed PNG name"),
        (some(lambda r: chart(r) & no((r["caption"] != "") & F.contains(block["text"], r["caption"]))), "caption must be an exact source-text excerpt"),
    ]
    error = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        error = F.when(broken, message).otherwise(error)
    return error


COUNTERS: dict[str, Callable[[Column], Column]] = {"heuristic": estimated_tokens}


def register_token_counter(name: str, counter: Callable[[Column], Column]) -> None:
    COUNTERS[name] = counter


def count_tokens(text: Column, counter: str = "heuristic") -> Column:
    """Tokens by a registered counter, a Column factory."""
    if counter not in COUNTERS:
        raise LookupError(f"token counter {counter!r} is not registered; there are {sorted(COUNTERS)}")
    return COUNTERS[counter](text)
