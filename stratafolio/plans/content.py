"""Queries of projected content, JSON, registries and the pilot pick."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content, dates
from ..operators import projections, spatial
from ..sources.registries import filled_embeddings
from .registry import query

c = F.col


@query("jsn2_canonical_json", """SELECT event_id, '{"a":[' || user_id || ',"' || event_type || '"],"b":{"x":null,"y":"é"}}' AS canonical FROM events""")
def canonical(t):
    raw = F.concat(F.lit('{ "b": {"y": "é", "x": null}, "a": ['), c("user_id").cast("string"), F.lit(', "'), c("event_type"), F.lit('"] }'))
    return t.events.select("event_id", content.canonical_json(raw).alias("canonical"))


@query("jsn3_source_category", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unknown' WHEN page_id % 4 = 0 THEN 'native' WHEN page_id % 4 = 1 THEN 'ocr' ELSE 'unknown' END AS category FROM pages")
def categories(t):
    stats = F.when(c("page_id") % 4 == 3, "not json").otherwise('{"page_ocr_status": ["text_layer", "ocr_applied", "failed"]}')
    return t.pages.select("page_id", content.source_category(stats, (c("page_id") % 4 + 1).cast("int"), c("page_id") % 5 == 0).alias("category"))


@query("byt2_page_count", "SELECT page_id, CASE WHEN page_id % 7 IN (5, 6) THEN NULL ELSE CAST(page_id % 7 + 1 AS INT) END AS pages, CASE page_id % 7 WHEN 5 THEN 'object-streams-unsupported' WHEN 6 THEN 'no-page-objects-found' ELSE 'page-object-scan' END AS method FROM pages")
def page_counts(t):
    k = (c("page_id") % 7).cast("int")
    raw = F.concat(F.lit("%PDF /Type /Pages "), F.when(k == 5, "/Type /ObjStm").when(k == 6, "").otherwise(F.repeat(F.lit("<</Type/Page >> "), k + 1)))
    return t.pages.select("page_id", content.page_count(F.encode(raw, "ISO-8859-1")).alias("p")).select("page_id", "p.pages", "p.method")


_VECTOR = r"""WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') || list_transform(range(1, length(text)), lambda k: substr(text, k, 2)))) AS term FROM benchmark),
n AS (SELECT item_id, CAST('0x' || substr(sha256(term), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS n FROM t GROUP BY 1, 2) SELECT item_id, CAST(slot AS INT) AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM n"""


@query("mth4_hashed_vector", _VECTOR)
def vectors(t):
    v = t.benchmark.select("item_id", F.posexplode(content.hashed_vector(c("text"))).alias("slot", "value"))
    return v.where("value > 0").withColumn("value", F.round("value", 6))


@query("ret7_cache_fill", f"SELECT sha256(text) AS text_sha, item_id % 2 = 0 AS cached, 64 AS dimensions FROM benchmark QUALIFY row_number() OVER (PARTITION BY text ORDER BY item_id) = 1")
def cache_fill(t):
    first = t.benchmark.groupBy("text").agg(F.min("item_id").alias("item_id"))
    cache = first.where("item_id % 2 = 0").select(F.sha2("text", 256).alias("text_sha"), F.lit("mock").alias("provider"), content.hashed_vector(c("text")).alias("vector"))
    full = filled_embeddings(cache, t.benchmark.select("text"), "mock", 64)
    return full.join(cache.select("text_sha", F.lit(True).alias("cached")), "text_sha", "left").select("text_sha", F.coalesce("cached", F.lit(False)).alias("cached"), F.size("vector").alias("dimensions"))


@query("jn18_references", "SELECT DISTINCT l_orderkey AS claim_id, 'b' || l_partkey AS block_id FROM lineitem")
def references(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("b"), "l_partkey").alias("block_id"))).alias("e"))  # the lines of one order
    claims = nested.select(c("l_orderkey").alias("claim_id"), F.to_json(F.struct(F.array(F.struct(F.struct(c("e").alias("evidence")).alias("inner"))).alias("claims"))).alias("body"))
    found = claims.select("claim_id", F.explode(content.json_references(c("body"))).alias("r"))
    return found.join(t.part.select(F.concat(F.lit("b"), "p_partkey").alias("block_id")), c("r.id") == c("block_id"), "left_semi").select("claim_id", c("r.id").alias("block_id"))


@query("jn14_projection_as_of", "SELECT user_id AS block_id, arg_max(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, event_id) AS projection_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def projection_as_of(t):
    events = t.events.select("event_id", c("user_id").alias("block_id"), F.when(c("event_type") != "click", c("event_type")).alias("projection_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))
    out = projections.visible_projection(events, F.lit("2024-01-15T12:00:00"))
    return out.select("block_id", F.coalesce("projection_id", F.lit("")).alias("projection_id"))


@query("aud7_activate", "SELECT o_orderkey AS block_id, CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' WHEN o_orderkey % 5 = 0 THEN 'rolled_back' ELSE 'activated' END AS outcome, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE '' END WHEN o_orderkey % 5 = 0 THEN '' ELSE 'new' END AS projection_id, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS revision FROM orders")
def activate(t):
    k = c("o_orderkey")
    heads = t.orders.where(k % 2 == 0).select(k.alias("block_id"), F.lit(4).alias("revision"), F.lit("old").alias("projection_id"))
    wanted = t.orders.select(k.alias("block_id"), (F.when(k % 2 == 0, 4).otherwise(0) + F.when(k % 3 == 0, 9).otherwise(0)).alias("expected"), F.when(k % 5 != 0, "new").alias("projection_id"))
    return projections.activated(heads, wanted).select("block_id", "outcome", F.coalesce("projection_id", F.lit("")).alias("projection_id"), "revision")


@query("jn24_owned_characters", "WITH r AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) * 0.1::DOUBLE AS x0, (l_linenumber - 1) * 0.1::DOUBLE + 0.1::DOUBLE + l_discount AS x1 FROM lineitem), h AS (SELECT o_orderkey, count(l_linenumber) AS n, min(l_linenumber) AS region FROM (SELECT o_orderkey, (o_custkey % 97) / 100::DOUBLE AS x FROM orders) LEFT JOIN r ON l_orderkey = o_orderkey AND x >= x0 AND x < x1 GROUP BY 1) SELECT o_orderkey, CASE WHEN n = 1 THEN region END AS region, n > 1 AS overlapping FROM h")
def owned_characters(t):
    chars = t.orders.select(c("o_orderkey").alias("page"), F.lit(0).alias("id"), ((c("o_custkey") % 97) / 100).alias("x"), F.lit(0.5).alias("y"))
    left = (c("l_linenumber") - 1) * F.lit(0.1)
    regions = t.lineitem.select(c("l_orderkey").alias("page"), c("l_linenumber").alias("region"), left.alias("x0"), F.lit(0.0).alias("y0"), (left + 0.1 + c("l_discount")).alias("x1"), F.lit(1.0).alias("y1"))
    return spatial.owners(chars, regions, ["page"]).select(c("page").alias("o_orderkey"), "region", "overlapping")


_PILOT = """WITH i AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'native' WHEN 'fr' THEN 'ocr' ELSE 'unknown' END AS category, lang = 'es' AND lang NOT IN ('en', 'fr') AS image, sha256('7:' || doc_id) AS o FROM documents),
f AS (SELECT *, image AND row_number() OVER (PARTITION BY category, image ORDER BY o, doc_id) = 1 AS forced FROM i), a AS (SELECT *, row_number() OVER (PARTITION BY category, source ORDER BY forced DESC, o, doc_id) > 1 AS again FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY forced DESC, again, o, doc_id) AS pick FROM a) SELECT category, doc_id, CAST(pick AS INT) AS pick FROM p WHERE pick <= 10"""


@query("win16_pilot", _PILOT)
def pilot(t):
    items = t.documents.select("doc_id", "source", "lang", F.when(c("lang") == "en", "native").when(c("lang") == "fr", "ocr").otherwise("unknown").alias("category"))
    return projections.pilot_pick(items, "category", ["source"], "doc_id", c("lang") == "es", 7).select("category", "doc_id", "pick")


_PROJECTED = r"""WITH d AS (SELECT doc_id, text, length(text) >= 40 AS fits, substr(text, 1, 10) || chr(10) || substr(text, 21) AS cut, substr(text, 12, 6) AS caption FROM documents)
SELECT doc_id, CASE WHEN NOT fits THEN 'invalid character span' WHEN doc_id % 4 = 1 THEN 'span hash mismatch' WHEN doc_id % 4 = 2 THEN 'only confirmed chart fragments may be excluded' WHEN doc_id % 4 = 3 THEN 'exclusion overlaps protected prose or table' ELSE '' END AS error,
CASE WHEN fits AND doc_id % 4 = 0 THEN md5(CASE WHEN contains(cut, caption) THEN cut ELSE cut || chr(10) || caption END) END AS text, CASE WHEN fits AND doc_id % 4 = 0 THEN 10 END AS excluded FROM d"""


@query("str20_projection_text", _PROJECTED)
def projection_text(t):
    k, text = c("doc_id") % 4, c("text")
    span = lambda start, end, action, kind: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.when(k == 1, "0").otherwise(F.sha2(F.substr(text, start + 1, end - start), 256)).alias("sha256"), F.lit(action).alias("action"), kind.alias("kind"), F.lit("axis").alias("role"), F.lit(True).alias("confirmed"))
    spans = F.array(span(F.when(k == 3, 15).otherwise(30), F.lit(40), "keep", F.lit("narrative")), span(F.lit(10), F.lit(20), "exclude", F.when(k == 2, "table").otherwise("chart")))
    captions = F.when(F.length(text) >= 40, F.array(F.substring(text, 12, 6))).otherwise(F.array().cast("array<string>"))
    d = t.documents.select("doc_id", content.projected(text, spans, captions).alias("p"))
    return d.select("doc_id", F.coalesce("p.error", F.lit("")).alias("error"), F.md5("p.text").alias("text"), c("p.excluded_characters").alias("excluded"))


@query("dt7_relative_window", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def relative_window(t):
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t.events.where(dates.within_hours(written, F.lit("2024-01-20 00:00:00"), 48)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("arr8_page_stats", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: length(x)::VARCHAR), ',') AS chars_per_page, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = ''))::INT AS missing FROM documents")
def page_stats(t):
    from ..sources.documents import page_statistics

    pages = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    d = page_statistics(pages, ["doc_id"])
    return d.select("doc_id", F.array_join(F.transform("chars_per_page", lambda x: x.cast("string")), ",").alias("chars_per_page"), F.size(F.filter("page_ocr_status", lambda s: s == "missing_content")).alias("missing"))


@query("udf3_token_counters", "SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents")
def token_counters(t):
    content.register_token_counter("spaces", lambda x: F.size(F.split(x, " ")).cast("long"))
    return t.documents.select("doc_id", content.count_tokens(c("text"), "spaces").alias("n"))
