"""Queries of scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, metadata, numbers, quality, text
from .registry import query

TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9._%+-]*'), lambda t: lower(t))"
DAMAGE_C = r"(length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')))"


@query("str2_tokenize", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(t[1:20], ' ') AS first_tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokenize(t):
    d = t.documents.select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 20), " ").alias("first_tokens"))


@query("str3_query_terms", f"WITH q AS (SELECT item_id, {TOKENS.format('substr(text, 1, 2000)')} AS t FROM benchmark), p AS (SELECT item_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM q), f AS (SELECT item_id, term, min(pos) AS pos FROM p GROUP BY 1, 2) SELECT item_id, string_agg(term, ' ' ORDER BY pos) AS terms, count(*) AS n_terms FROM f GROUP BY 1")
def query_terms(t):
    q = t.benchmark.select("item_id", text.query_terms(F.col("text")).alias("t"))
    return q.select("item_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n_terms")).where("n_terms > 0")


@query(
    "str4_damage_tags",
    r"""WITH m AS (SELECT doc_id, greatest(1, length(text)) AS n, length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS c0,
    length(text) - length(regexp_replace(text, '[\x7f-\x9f]', '', 'g')) AS c1, len(regexp_extract_all(text, '[\x{a0}-\x{ff}]{6,}')) AS runs,
    regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]{4,}') AS r0, regexp_matches(text, '[\x{a0}-\x{ff}]{18,}') AS r2 FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN c0 / n > 0.02 OR r0 THEN 'control_characters' END, CASE WHEN c1 / n > 0.02 THEN 'c1_or_del_characters' END, CASE WHEN runs >= 3 OR r2 THEN 'cid_style_glyph_runs' END) AS tags FROM m""",
)
def damage(t):
    return t.documents.select("doc_id", F.array_join(quality.damage_tags(F.col("text")), ",").alias("tags"))


@query(
    "str5_analyze_text",
    r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM documents),
    c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM l) GROUP BY 1, 2) GROUP BY 1),
    i AS (SELECT l.doc_id, len(lines) AS n_lines, len(lines) = 0 AS blank, concat_ws(',', CASE WHEN length(text) < 40 THEN 'too_short' END, CASE WHEN length(text) - length(replace(text, chr(65533), '')) > 0.02 * length(text) THEN 'replacement_chars' END, CASE WHEN len(regexp_extract_all(text, '[\x{a0}-\x{ff}]{6,}')) >= 3 OR regexp_matches(text, '[\x{a0}-\x{ff}]{18,}') THEN 'cid_style_glyph_runs' END, CASE WHEN len(lines) >= 8 AND top > 0.6 * len(lines) THEN 'repetitive_lines' END) AS issues FROM l LEFT JOIN c USING (doc_id))
    SELECT doc_id, CASE WHEN blank THEN 'no_text' ELSE issues END AS issues, CASE WHEN blank THEN 'failed' WHEN issues <> '' THEN 'review' ELSE 'ready' END AS status FROM i""",
)
def analyze(t):
    d = t.documents.select("doc_id", "text", quality.stripped_lines(F.col("text")).alias("lines"))
    return d.select("doc_id", quality.assessed(F.col("text"), F.col("lines")).alias("q")).select("doc_id", F.array_join("q.issues", ",").alias("issues"), "q.status")


@query("str6_ocr_routing", "SELECT turn, conv_id, concat_ws(',', CASE WHEN length(text) = 0 THEN 'no_text_layer' WHEN length(trim(text)) < 10 THEN 'very_sparse_text' END) AS reasons FROM conversations")
def ocr_routing(t):
    return t.conversations.select("turn", "conv_id", F.array_join(quality.ocr_reasons(F.length("text"), F.col("text")), ",").alias("reasons"))


@query("str7_worst_status", "SELECT o_orderstatus AS a, o_orderpriority AS b, CASE WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '1%' THEN 'failed' WHEN o_orderstatus = 'P' OR o_orderpriority LIKE '2%' THEN 'review' ELSE 'ready' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def worst(t):
    a = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "odd").otherwise("ready")
    b = F.when(F.col("o_orderpriority").startswith("1"), "failed").when(F.col("o_orderpriority").startswith("2"), "review").otherwise("ready")
    return t.orders.groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), quality.worst_status(a, b).alias("status")).agg(F.count("*").alias("n"))


@query(
    "str8_snippet",
    """WITH m AS (SELECT doc_id, text, position('the' IN lower(text)) - 1 AS a, position('with' IN lower(text)) - 1 AS b FROM documents),
    s AS (SELECT doc_id, text, a, b, least(CASE WHEN a < 0 THEN 1000000000 ELSE a END, CASE WHEN b < 0 THEN 1000000000 ELSE b END) AS first FROM m),
    w AS (SELECT *, least(length(text), greatest(0, first - 20) + 80) AS hi FROM s)
    SELECT doc_id, CASE WHEN first = 1000000000 THEN substr(text, 1, 80) ELSE substr(text, greatest(0, hi - 80) + 1, hi - greatest(0, hi - 80)) END AS snippet, (a >= 0)::INT + (b >= 0)::INT AS n_spans FROM w""",
)
def snippets(t):
    shown, spans = text.snippet(F.col("text"), F.array(F.lit("the"), F.lit("with")))
    return t.documents.select("doc_id", shown.alias("snippet"), F.size(spans).alias("n_spans"))


@query("str9_single_spaced", r"SELECT doc_id, md5(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS digest FROM documents")
def single_spaced(t):
    return t.documents.select("doc_id", F.md5(text.single_spaced(F.col("text"))).alias("digest"))


@query("str12_display_title", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(url) || ' 100%' ELSE trim(url) END AS display FROM pages")
def titles(t):
    """A third can't be decoded whole and stays as it is; another third has its marks decoded, non-ASCII ones too."""
    coded = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(" 100%"))).when(F.col("page_id") % 3 == 1, F.regexp_replace(F.col("url"), "/", "%2F")).otherwise(F.concat(F.lit(" "), "url"))
    return t.pages.select("page_id", text.display_title(coded).alias("display"))


@query(
    "str13_escapes",
    r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html,
    md5('"' || replace(replace(replace(replace(line, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"') AS yaml,
    md5(replace(regexp_replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+.!|<>&~])', '\\\1', 'g'), chr(10), ' ')) AS markdown,
    md5(regexp_replace(line, '([\\`*_{}\[\]()<>#!|$~])', '\\\1', 'g')) AS literal FROM (SELECT doc_id, raw, replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS line FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS raw FROM documents))""",
)
def escapes(t):
    from ..sources.publish import literal

    raw = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    d = t.documents.select("doc_id", raw.alias("raw"))
    return d.select("doc_id", F.md5(text.html_escape(F.col("raw"))).alias("html"), F.md5(text.yaml_scalar(F.col("raw"))).alias("yaml"), F.md5(text.markdown_text(F.col("raw"))).alias("markdown"), F.md5(literal(F.col("raw"))).alias("literal"))


@query(
    "str14_components",
    r"""SELECT page_id, CASE WHEN regexp_full_match(v, '[A-Za-z0-9][A-Za-z0-9._:-]{0,199}') THEN v ELSE CASE WHEN k = '' THEN 'id' ELSE k END || '-' || substr(sha256(v), 1, 12) END AS component, strip_accents(v) AS folded FROM (SELECT *, trim(substr(regexp_replace(v, '[^A-Za-z0-9._\-é]', '_', 'g'), 1, 96), '._') AS k FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'page-' || page_id WHEN 1 THEN '../' || url WHEN 2 THEN 'é ' || url ELSE '..' END AS v FROM pages))""",
)
def components(t):
    k, url = F.col("page_id") % 4, F.col("url")
    v = F.when(k == 0, F.concat(F.lit("page-"), "page_id")).when(k == 1, F.concat(F.lit("../"), url)).when(k == 2, F.concat(F.lit("é "), url)).otherwise("..")
    return t.pages.select("page_id", text.safe_component(v).alias("component"), text.ascii_folded(v).alias("folded"))


@query(
    "str14_names",
    r"""SELECT page_id, substr(CASE WHEN c = '' THEN 'unnamed' ELSE c END, 1, 120) AS filename, CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' THEN url END AS safe, upper(trim(url)) AS symbol,
    CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f KB', n / 1024.0) END AS size FROM (SELECT *, length(html) AS n, trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .') AS c FROM pages)""",
)
def names(t):
    return t.pages.select("page_id", text.safe_filename(F.col("url")).alias("filename"), text.safe_url(F.col("url")).alias("safe"), text.normalized_symbol(F.col("url")).alias("symbol"), text.human_size(F.length("html")).alias("size"))


@query("str15_format_of", "SELECT page_id, CASE WHEN contains(v, 'pdf') THEN 'pdf' WHEN contains(v, 'htm') THEN 'html' WHEN regexp_matches(v, 'png|jpg|jpeg|image') THEN 'img' WHEN contains(v, 'text') OR v = 'txt' THEN 'txt' ELSE 'other' END AS format FROM (SELECT page_id, lower(CASE WHEN page_id % 5 = 0 THEN 'Application/PDF' WHEN page_id % 5 = 1 THEN 'text/plain' WHEN page_id % 5 = 2 THEN 'image/x' ELSE url END) AS v FROM pages)")
def formats(t):
    media = F.when(F.col("page_id") % 5 == 0, "Application/PDF").when(F.col("page_id") % 5 == 1, "text/plain").when(F.col("page_id") % 5 == 2, "image/x").otherwise(F.col("url"))
    return t.pages.select("page_id", text.format_of(media, F.lit("")).alias("format"))


@query("str16_token_estimates", "SELECT doc_id, CAST(round_even(length(text) / 4.0, 0) AS BIGINT) AS estimated, CAST(floor((length(text) + 3) / 4) AS BIGINT) + 8 AS reserved FROM documents")
def estimates(t):
    return t.documents.select("doc_id", text.estimated_tokens(F.col("text")).alias("estimated"), text.reserved_tokens(F.col("text")).alias("reserved"))


@query("str17_citations", r"SELECT doc_id, array_to_string(list_filter(c, lambda n: n >= 1 AND n <= 50), ',') AS valid, array_to_string(c, ',') AS cited FROM (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all('[' || doc_id || '] see [' || (n_chars % 100) || '], [' || (doc_id % 7) || '] and [00012345678901234567890' || doc_id || ']', '\[(\d+)\]', 1), lambda x: CAST(x AS HUGEINT)))) AS c FROM documents)")
def cited(t):
    said = F.concat(F.lit("["), F.col("doc_id"), F.lit("] see ["), F.col("n_chars") % 100, F.lit("], ["), F.col("doc_id") % 7, F.lit("] and [00012345678901234567890"), F.col("doc_id"), F.lit("]"))
    return t.documents.select("doc_id", F.array_join(text.valid_citations(said, F.lit(50)).cast("array<string>"), ",").alias("valid"), F.array_join(text.citations(said).cast("array<string>"), ",").alias("cited"))


@query("str18_numeric_tokens", r"SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?[ \t\n\r\f\v]*(?:%|亿|万|bn|mm)?') AS t FROM documents)")
def numerics(t):
    d = t.documents.select("doc_id", text.numeric_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("numbers"))


@query("str19_links", r"SELECT page_id, array_to_string(regexp_extract_all('see [it](' || url || ') and [[note ' || page_id || '#x]]', '\[[^\]]*\]\(([^)\s]+)\)', 1), ' ') AS links, array_to_string(regexp_extract_all('see [it](' || url || ') and [[note ' || page_id || '#x]]', '\[\[([^\]|#]+)', 1), ' ') AS wikilinks FROM pages")
def linked(t):
    said = F.concat(F.lit("see [it]("), F.col("url"), F.lit(") and [[note "), F.col("page_id"), F.lit("#x]]"))
    return t.pages.select("page_id", F.array_join(text.links(said), " ").alias("links"), F.array_join(text.wikilinks(said), " ").alias("wikilinks"))


@query("str21_prompt", "SELECT conv_id, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def prompts(t):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), F.col("turn"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text")).alias("line"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


@query("dt1_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS said, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS back FROM events")
def utc_text(t):
    d = t.events.select("event_id", dates.utc_text(F.col("ts").cast("timestamp")).alias("said"))
    return d.select("event_id", "said", F.date_format(dates.instant_of(F.col("said")), "yyyy-MM-dd HH:mm:ss").alias("back"))


@query("dt3_iso_day", "SELECT event_id, CAST(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN '2024-02-3' || (event_id % 10) ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS VARCHAR) AS day FROM events")
def iso_days(t):
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("2024-02-3"), F.col("event_id") % 10)).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    return t.events.select("event_id", dates.iso_day(said).cast("string").alias("day"))


@query("dt4_visible_at", "SELECT o_orderkey, strftime(CASE WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN o_orderdate END, '%Y-%m-%d') AS visible FROM orders")
def visible(t):
    at = dates.visible_at(F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz"), "system")
    return t.orders.select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("visible"))


@query("dt5_china_display", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shown, CAST(floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS seconds FROM events")
def china(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", dates.china_display(ts).alias("shown"), dates.seconds_between(F.lit("2024-01-01").cast("timestamp"), ts).alias("seconds"))


@query("dt6_backoff", "SELECT event_id, strftime(ts + (60 * (1 + event_id % 5)) * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS retry_at FROM events")
def backoff(t):
    return t.events.select("event_id", F.date_format(F.col("ts") + F.make_dt_interval(secs=(60 * (1 + F.col("event_id") % 5)).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss").alias("retry_at"))


@query("mth2_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def cosines(t):
    q = [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]
    return t.embeddings.select("vec_id", F.round(numbers.cosine(F.col("embedding"), F.array(*map(F.lit, q))), 6).alias("similarity"))


_BOX = "least(l_discount * 8, 0.8) AS x0, least(l_tax * 8, 0.8) AS y0, least(l_discount * 8, 0.8) + l_quantity / 250 AS x1, least(l_tax * 8, 0.8) + 0.2 AS y1"


@query("mth5_iou", f"WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem), p AS (SELECT *, greatest(0, least(x1, 0.5) - greatest(x0, 0.1)) * greatest(0, least(y1, 0.4) - greatest(y0, 0.05)) AS i FROM b) SELECT l_orderkey, l_linenumber, round(i / ((x1 - x0) * (y1 - y0) + 0.4 * 0.35 - i), 6) AS iou, x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1 AND x0 < x1 AND y0 < y1 AS valid FROM p")
def boxes(t):
    x0, y0 = F.least(F.col("l_discount") * 8, F.lit(0.8)), F.least(F.col("l_tax") * 8, F.lit(0.8))
    a = [x0, y0, x0 + F.col("l_quantity") / 250, y0 + 0.2]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(numbers.iou(a, [F.lit(0.1), F.lit(0.05), F.lit(0.5), F.lit(0.4)]), 6).alias("iou"), numbers.valid_box(a).alias("valid"))


@query("mth6_normalize_number", "SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 6 WHEN 0 THEN v WHEN 1 THEN -v WHEN 2 THEN -v WHEN 3 THEN v END, 4) AS value, l_linenumber % 6 = 3 AS is_percent, CASE l_linenumber % 6 WHEN 1 THEN 'parentheses' WHEN 2 THEN 'minus' END AS negative_style, CASE WHEN l_linenumber % 6 = 0 THEN '$' END AS currency, CASE l_linenumber % 6 WHEN 4 THEN 'not_a_plain_number' WHEN 5 THEN 'ambiguous_decimal_comma' ELSE '' END AS issues FROM (SELECT *, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS v FROM lineitem)")
def cells(t):
    plain, grouped = F.format_string("%.2f", "l_extendedprice"), F.format_number("l_extendedprice", 2)
    k = F.col("l_linenumber") % 6
    raw = F.when(k == 0, F.concat(F.lit("$"), grouped)).when(k == 1, F.concat(F.lit("("), grouped, F.lit(")"))).when(k == 2, F.concat(F.lit("-"), plain)).when(k == 3, F.concat(plain, F.lit("%"))).when(k == 4, F.concat(F.lit("about "), plain)).otherwise("1,5")
    d = t.lineitem.select("l_orderkey", "l_linenumber", numbers.number_of(raw).alias("n"))
    return d.select("l_orderkey", "l_linenumber", F.round("n.value", 4).alias("value"), "n.is_percent", "n.negative_style", "n.currency", F.array_join("n.issues", ",").alias("issues"))


@query(
    "prj3_metadata_flags",
    """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '2023Q4' ELSE strftime(o_orderdate - to_days(CAST(o_orderkey % 900 AS INT)), '%Y-%m-%d') END AS period, strftime(o_orderdate, '%Y-%m-%d') AS published, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'S' END AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'Annual Report' ELSE 'note' END AS kind FROM orders)
    SELECT k AS o_orderkey, concat_ws(',', CASE WHEN period <> '' AND NOT regexp_matches(period, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'period_invalid' END, CASE WHEN abs(date_diff('day', TRY_CAST(period AS DATE), CAST(published AS DATE))) > 400 THEN 'period_suspect' END, CASE WHEN kind = 'Annual Report' AND period = '' THEN 'period_missing' END, CASE WHEN kind = 'Annual Report' AND symbol = '' THEN 'symbol_missing' END) AS flags FROM d""".replace("\\\\d", "\\d"),
)
def flags(t):
    k = F.col("o_orderkey")
    period = F.when(k % 5 == 0, "").when(k % 5 == 1, "2023Q4").otherwise(F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), (k % 900).cast("int")), "yyyy-MM-dd"))
    kind = F.when(k % 2 == 0, "Annual Report").otherwise("note")
    return t.orders.select("o_orderkey", F.array_join(metadata.flags_of(period, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(""), F.when(k % 3 == 0, "").otherwise("S"), kind), ",").alias("flags"))


@query("prj2_evidence_errors", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 4 = 0 THEN 'source missing' END, CASE WHEN length(text) = 0 THEN 'text missing' END, CASE WHEN doc_id % 3 = 0 THEN 'source_sha256 malformed' END, CASE WHEN doc_id % 5 = 0 THEN 'block_type unknown' END) AS errors FROM documents")
def evidence(t):
    k = F.col("doc_id")
    block = F.struct(F.when(k % 4 == 0, "").otherwise(F.col("source")).alias("source"), k.cast("string").alias("doc_id"), F.lit("v1").alias("source_version"), F.lit("e").alias("extraction_id"), F.lit("b").alias("block_id"), F.col("text"), F.when(k % 3 == 0, "xyz").otherwise(F.sha2("text", 256)).alias("source_sha256"), F.when(k % 5 == 0, "odd").otherwise("paragraph").alias("block_type"))
    return t.documents.select("doc_id", block.alias("b")).select("doc_id", F.array_join(metadata.evidence_errors(F.col("b")), ",").alias("errors"))


@query(
    "byt1_byte_range",
    """WITH r AS (SELECT p_partkey, p_size AS s, 40 AS size, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'bytes=' || p_size || '-' WHEN 2 THEN 'bytes=-' || p_size WHEN 3 THEN 'bytes=5-' || p_size ELSE 'lines=1-2' END AS h, p_partkey % 5 AS c FROM part)
    SELECT p_partkey, CASE WHEN c = 0 THEN 'full' WHEN c = 4 OR (c = 1 AND s >= size) OR (c = 3 AND s < 5) THEN 'invalid' ELSE 'range' END AS kind, CASE WHEN c = 1 AND s < size THEN s WHEN c = 2 THEN greatest(0, size - s) WHEN c = 3 AND s >= 5 THEN 5 END::BIGINT AS "start", CASE WHEN (c = 1 AND s < size) OR c = 2 THEN size - 1 WHEN c = 3 AND s >= 5 THEN least(s, size - 1) END::BIGINT AS "end" FROM r""",
)
def ranges(t):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    header = F.when(k == 0, "").when(k == 1, F.concat(F.lit("bytes="), s, F.lit("-"))).when(k == 2, F.concat(F.lit("bytes=-"), s)).when(k == 3, F.concat(F.lit("bytes=5-"), s)).otherwise("lines=1-2")
    return t.part.select("p_partkey", metadata.byte_range(header, F.lit(40).cast("long")).alias("r")).select("p_partkey", "r.*")


@query("arr1_paragraphs", "SELECT conv_id, turn, unnest(range(len(p))) AS ordinal, unnest(p) AS paragraph FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text || chr(10) || chr(10) || role, '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS p FROM conversations)".replace("\\\\", "\\"))
def paragraphs(t):
    said = F.concat("text", F.lit("\n\n"), "role")
    split = F.filter(F.transform(F.split(said, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")), lambda x: x != "")
    return t.conversations.select("conv_id", "turn", F.posexplode(split).alias("ordinal", "paragraph")).select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), "paragraph")


@query("arr5_table_projection", "SELECT l_orderkey, string_agg('line ' || l_linenumber || ' => ' || l_returnflag || ' | ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus) AS projection FROM lineitem GROUP BY 1")
def projection(t):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.array("l_returnflag", "l_linestatus").alias("cells"))))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("line "), r["l_linenumber"], F.lit(" => "), F.array_join(r["cells"], " | "))), "\n").alias("projection"))


@query("arr6_bounded_table", "SELECT conv_id, least(count(*), 3) AS n_rows, string_agg(substr(text, 1, 20), '|' ORDER BY turn) FILTER (r <= 3) AS cells FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1")
def bounded(t):
    rows = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: F.substring(r["text"], 1, 20)), 1, 3)
    return t.conversations.groupBy("conv_id").agg(rows.alias("c")).select("conv_id", F.size("c").cast("long").alias("n_rows"), F.array_join("c", "|").alias("cells"))


@query("arr7_cell_explode", "SELECT l_orderkey, l_linenumber, unnest([0, 1]) AS col, l_linenumber <= 1 AS is_header, unnest([l_quantity, l_extendedprice]) AS value FROM lineitem")
def exploded(t):
    cells = t.lineitem.select("l_orderkey", "l_linenumber", F.posexplode(F.array("l_quantity", "l_extendedprice")).alias("col", "value"))
    return cells.select("l_orderkey", "l_linenumber", "col", (F.col("l_linenumber") <= 1).alias("is_header"), "value")


@query("jsn1_parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parsed(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("win9_damage_runs", r"SELECT doc_id, len(regexp_extract_all(text, '[\x{a0}-\x{ff}]{2,}')) AS runs, coalesce(list_max(list_transform(regexp_extract_all(text, '[\x{a0}-\x{ff}]+'), lambda x: length(x))), 0) AS longest FROM documents")
def runs(t):
    every = F.regexp_extract_all("text", F.lit(r"[\x{a0}-\x{ff}]+"), 0)
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"[\x{a0}-\x{ff}]{2,}")).cast("long").alias("runs"), F.coalesce(F.array_max(F.transform(every, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("win8_numeric_line_runs", "WITH l AS (SELECT conv_id, turn, length(text) % 3 > 0 AS f FROM conversations), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, f ORDER BY turn) AS g FROM l) SELECT conv_id, coalesce(max(n) FILTER (f), 0) AS longest FROM (SELECT conv_id, f, g, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1")
def line_runs(t):
    flags = F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 3 > 0).alias("f")))), lambda x: x["f"])
    longest = F.aggregate("flags", F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best")), lambda a, x: F.struct(F.when(x, a["run"] + 1).otherwise(0).cast("long").alias("run"), F.greatest(a["best"], F.when(x, a["run"] + 1).otherwise(0)).cast("long").alias("best")), lambda a: a["best"])
    return t.conversations.groupBy("conv_id").agg(flags.alias("flags")).select("conv_id", longest.alias("longest"))


@query("aud2_recommended_action", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'missing_source' WHEN l_shipdate < TIMESTAMP '1994-01-01' THEN 'native_reextract' WHEN (l_tax > 0.06 OR l_linenumber > 4) AND l_linenumber >= greatest(1, floor(l_quantity / 2)) AND l_linenumber > 4 THEN 'ocr' WHEN l_tax > 0.06 OR l_linenumber > 4 OR l_linestatus = 'F' THEN 'manual_review' ELSE 'keep' END AS action FROM lineitem")
def actions(t):
    c = F.col
    parser = F.when(c("l_shipdate") < F.lit("1994-01-01").cast("timestamp_ntz"), "stdlib-pdf-degraded").otherwise("pdfium")
    issues = F.when(c("l_tax") > 0.06, F.array(F.lit("control_characters"))).otherwise(F.array(F.lit("too_short")))
    damaged = F.when(c("l_linenumber") > 4, c("l_linenumber")).otherwise(0)
    status = F.when(c("l_linestatus") == "F", "failed").otherwise("ready")
    return t.lineitem.select("l_orderkey", "l_linenumber", quality.recommended_action(parser, status, issues, damaged, c("l_quantity"), F.lit(1), F.lit(1), c("l_returnflag") != "R").alias("action"))


@query("aud6_chart_signals", r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents) SELECT doc_id, 'unclassified' AS kind, 0 AS caption_count, len(list_filter(lines, lambda x: length(x) <= 30 AND regexp_matches(x, '^[0-9 .,%()/:+-]+$'))) AS numeric_lines FROM l")
def charts(t):
    d = t.documents.select("doc_id", "text", quality.stripped_lines(F.col("text")).alias("lines"))
    return d.select("doc_id", quality.chart_signal(F.col("text"), F.col("lines")).alias("s")).select("doc_id", "s.kind", "s.caption_count", F.col("s.numeric_lines").cast("long").alias("numeric_lines"))


@query("str1_normalize")
def normalize(t):
    return t.documents.select("doc_id", F.length(text.normalized(F.col("text"))).alias("n_chars"))


@query("str10_html_text", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages")
def html_text(t):
    from ..sources.documents import html_text as strip

    return t.pages.select("page_id", F.md5(strip(F.col("html"))).alias("digest"))


@query("str22_redact", "SELECT page_id, 'token=*** ' || url AS said FROM pages")
def redact(t):
    return t.pages.select("page_id", text.redacted(F.concat(F.lit("token=abc"), F.col("page_id"), F.lit(" "), F.col("url"))).alias("said"))


@query("str11_decoded", "SELECT doc_id, md5(text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) || '.' ELSE '' END) AS text, CASE WHEN doc_id % 3 = 0 THEN 'utf-8-replaced' ELSE 'utf-8' END AS encoding FROM documents")
def decoded_bytes(t):
    raw = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.lit(b"\xff.")).otherwise(F.lit(b"")))
    d = t.documents.select("doc_id", text.decoded(raw).alias("d"))
    return d.select("doc_id", F.md5("d.text").alias("text"), "d.encoding")


@query("mth7_half_even", "SELECT l_orderkey, l_linenumber, round_even((l_partkey * 7 + l_linenumber) / 32.0::DOUBLE, 4) AS score, round_even(1 / (60 + l_suppkey)::DOUBLE, 6) AS fused FROM lineitem")
def half_even(t):
    """Sums of thirty-seconds end in ties at the fifth place, which both go to the even side."""
    score = (F.col("l_partkey") * 7 + F.col("l_linenumber")) / F.lit(32.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.half_even(score, 4).alias("score"), numbers.half_even(F.lit(1.0) / (F.lit(60) + F.col("l_suppkey")), 6).alias("fused"))


@query("dt2_cutoff", "SELECT event_id, strftime(CASE event_id % 3 WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END - CASE event_id % 3 WHEN 1 THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS cutoff FROM events")
def cutoffs(t):
    k, ts = F.col("event_id") % 3, F.col("ts")
    said = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return t.events.select("event_id", F.date_format(dates.cutoff_of(said), "yyyy-MM-dd HH:mm:ss").alias("cutoff"))
