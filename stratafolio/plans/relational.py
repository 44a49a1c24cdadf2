"""Queries of scans, filters, joins, aggregates, selection and paging.

The driver's tables stand in for the engine's: customers for documents, orders for their versions (o_orderdate: first observed), lineitems for
extractions and artifacts, events for the event log and jobs, conversations for claims (turns: revisions).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metadata, numbers
from ..operators import selection
from .registry import query

c = F.col
CUT = "1997-06-01"
DAY = "%Y-%m-%d"


def ymd(col):
    return F.date_format(col, "yyyy-MM-dd")


@query("src1_archive_scan", "WITH a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS current FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) AS artifacts, CASE WHEN n IS NULL THEN 'missing' WHEN current > 1 THEN 'conflict' ELSE 'ready' END AS state, o_orderstatus = 'F' AND coalesce(current, 0) = 1 AS available FROM orders LEFT JOIN a ON l_orderkey = o_orderkey")
def archive_scan(t):
    """An archive of Parquet files, read as one snapshot."""
    from ..operators.storage import stored
    from ..sources.files import read_archive

    manifest = t.orders.select(c("o_orderkey").cast("string").alias("report_id"), F.when(c("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.lit("a1").alias("current_artifact_id"))
    artifacts = t.lineitem.select(c("l_orderkey").cast("string").alias("report_id"), F.concat(F.lit("a"), "l_linenumber").alias("artifact_id"), F.md5(c("l_partkey").cast("string")).alias("sha256"), c("l_partkey").alias("bytes"), F.lit("pdf").alias("media_type"), F.when(c("l_linestatus") == "F", "ready").otherwise("failed").alias("state"))
    d = read_archive(t.spark, stored(manifest), stored(artifacts))
    return d.select(c("report_id").cast("long").alias("o_orderkey"), F.coalesce(F.size("artifacts"), F.lit(0)).cast("long").alias("artifacts"), c("archive_state").alias("state"), "available")


@query("src2_export_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text, n_chars FROM documents")
def export_scan_lines(t):
    """An export of JSON lines, where a bad line or a repeated document is an error."""
    from ..operators.storage import stored
    from ..sources.files import read_export

    path = stored(t.documents.select(c("doc_id").cast("string").alias("doc_id"), "text", "n_chars"), "json")
    return read_export(t.spark, path, "doc_id string, text string, n_chars long").select("doc_id", F.md5("text").alias("text"), "n_chars")


@query("src2_export_duplicates", "SELECT source, count(*) - count(DISTINCT md5(text)) AS duplicates, count(*) AS rows FROM documents GROUP BY 1")
def export_scan(t):
    return t.documents.groupBy("source").agg((F.count("*") - F.countDistinct(F.md5("text"))).alias("duplicates"), F.count("*").alias("rows"))


@query("src5_catalog_stream", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def catalog_stream(t):
    return t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("snk2_catalog_csv", "SELECT c_custkey || ',' || c_name || ',' || c_mktsegment AS line FROM customer WHERE c_acctbal > 0")
def catalog_csv(t):
    return t.customer.where("c_acctbal > 0").select(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("line"))


@query("snk2_catalog_export", "SELECT c_custkey || ',' || CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN chr(34) || c_name || ', a ' || chr(34) || chr(34) || 'b' || chr(34) || chr(34) || chr(34) ELSE '' END || ',' || c_mktsegment AS line FROM customer")
def catalog_export(t):
    """Ordered files with quoting as a reader of CSV expects it, read back as lines."""
    import uuid

    from ..operators.storage import shared_root
    from ..sources.files import write_csv

    k = c("c_custkey") % 3
    title = F.when(k == 0, c("c_name")).when(k == 1, F.concat("c_name", F.lit(', a "b"')))
    path = f"{shared_root(t.spark)}/stratafolio-csv-{uuid.uuid4().hex}"
    write_csv(t.customer.select("c_custkey", title.alias("title"), "c_mktsegment"), path, ["c_custkey", "title", "c_mktsegment"], ["c_custkey"])
    return t.spark.read.text(path).where("value <> 'c_custkey,title,c_mktsegment'").select(c("value").alias("line"))


@query("snk8_unpublished", "WITH n AS (SELECT conv_id, max(turn) AS revision FROM conversations GROUP BY 1) SELECT conv_id, revision FROM n WHERE NOT EXISTS (SELECT 1 FROM conversations l WHERE l.conv_id = n.conv_id AND l.turn = n.revision AND l.role = 'assistant')")
def unpublished(t):
    from ..operators.reports import unpublished as of

    rows = t.conversations.select(c("conv_id").alias("entity"), c("turn").alias("revision"), "role")
    return of(rows, rows.where("role = 'assistant'")).select(c("entity").alias("conv_id"), "revision")


@query("flt1_search_filter", f"SELECT o_orderkey, strftime(o_orderdate, '{DAY}') AS day FROM orders WHERE o_orderstatus IN ('F', 'O') AND upper(o_orderpriority) IN ('1-URGENT', '2-HIGH') AND strftime(o_orderdate, '{DAY}') BETWEEN '1995-01-01' AND '1996-12-31'")
def search_filter(t):
    day = metadata.effective_date(ymd("o_orderdate"))
    return t.orders.where(c("o_orderstatus").isin("F", "O") & F.upper("o_orderpriority").isin("1-URGENT", "2-HIGH") & day.between("1995-01-01", "1996-12-31")).select("o_orderkey", day.alias("day"))


@query("flt2_allowed_set", f"WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '{CUT}') SELECT l_orderkey, l_linenumber FROM lineitem JOIN v ON l_orderkey = o_orderkey AND r = 1 JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_returnflag <> 'R'")
def allowed_set(t):
    docs = t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    newest = selection.as_of(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", F.lit(CUT).cast("timestamp_ntz"), "o_orderkey")
    allowed = newest.join(docs, "o_custkey", "left_semi")
    return t.lineitem.where("l_returnflag <> 'R'").join(allowed, c("l_orderkey") == c("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("flt3_catalog_search", "SELECT p_partkey, p_name, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 20.0) AS BIGINT) AS page_count FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%' ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20")
def catalog_search(t):
    found = t.part.where(" OR ".join(f"{x} ILIKE '%an%'" for x in ("p_name", "p_brand", "p_type")))
    total = found.count()
    page = found.orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(20)
    return page.select("p_partkey", "p_name", F.lit(total).cast("long").alias("total"), F.lit(-(-total // 20)).cast("long").alias("page_count"))


@query("flt4_directory", "WITH v AS (SELECT o_custkey, count(*) AS version_count, max(o_orderkey) FILTER (o_orderstatus = 'O') AS current_version FROM orders GROUP BY 1) SELECT c_custkey, c_name, coalesce(version_count, 0) AS version_count, current_version FROM customer LEFT JOIN v ON o_custkey = c_custkey ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def directory(t):
    v = t.orders.groupBy("o_custkey").agg(F.count("*").alias("version_count"), F.max(F.when(c("o_orderstatus") == "O", c("o_orderkey"))).alias("current_version"))
    listed = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(100).limit(50)
    return listed.join(v, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("version_count", F.lit(0)).alias("version_count"), "current_version")


@query("flt4_directory_flags", "WITH v AS (SELECT o_custkey, count(*) AS version_count, max(o_orderkey) FILTER (o_orderstatus = 'O') AS current_version_id FROM orders GROUP BY 1) SELECT c_custkey, coalesce(version_count, 0) AS version_count, current_version_id, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE '' END || CASE WHEN c_nationkey = 3 THEN ',third' ELSE '' END AS flags, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS total FROM customer LEFT JOIN v ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' ORDER BY c_name DESC, c_custkey LIMIT 20 OFFSET 30")
def directory_flags(t):
    from ..operators import reports

    docs = t.customer.where("c_mktsegment <> 'BUILDING'").select(c("c_custkey").alias("key"), "c_name", "c_acctbal", "c_nationkey")
    versions = t.orders.select(c("o_custkey").alias("key"), c("o_orderkey").alias("version_id"), (c("o_orderstatus") == "O").alias("is_current"))
    flags = F.concat(F.when(c("c_acctbal") < 0, "negative").otherwise(""), F.when(c("c_nationkey") == 3, ",third").otherwise(""))
    page, total = reports.directory(docs, versions, flags, [F.desc("c_name"), c("key")], 20, 30)
    return page.select(c("key").alias("c_custkey"), "version_count", "current_version_id", "flags", F.lit(total).cast("long").alias("total"))


@query("flt5_document_detail", f"SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '{DAY}') AS observed, max(l_linenumber) AS latest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY ALL")
def detail(t):
    versions = t.orders.where("o_custkey = 7")
    return versions.join(t.lineitem, c("l_orderkey") == c("o_orderkey"), "left").groupBy("o_orderkey", "o_orderstatus", ymd("o_orderdate").alias("observed")).agg(F.max("l_linenumber").alias("latest"))


@query("flt6_version_map", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS versions FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def version_map(t):
    return t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("versions"))


@query("flt7_usable_evidence", r"SELECT doc_id, NOT (len(regexp_extract_all(text, '[\x{a0}-\x{ff}]{6,}')) >= 3 OR regexp_matches(text, '[\x{a0}-\x{ff}]{18,}')) AS usable FROM documents")
def usable(t):
    from ..functions.quality import usable as f

    return t.documents.select("doc_id", f(c("text")).alias("usable"))


@query("flt8_consumer_blocks", "SELECT d.doc_id, md5(CASE WHEN l.quality = 1 THEN upper(d.source) || d.text ELSE d.text END) AS shown FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0")
def consumer(t):
    heads = t.labels.select("doc_id", "quality", "toxic")
    d = t.documents.join(heads, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    return d.select("doc_id", F.md5(F.coalesce(F.when(c("quality") == 1, F.concat(F.upper("source"), "text")), c("text"))).alias("shown"))


@query("flt9_valid_ids", r"SELECT page_id, regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$') AS valid, regexp_replace(url, '^https?://', '') AS path FROM pages")
def valid_ids(t):
    from ..functions.text import safe_relative_path, valid_id

    return t.pages.select("page_id", valid_id(c("url")).alias("valid"), safe_relative_path(F.regexp_replace("url", "^https?://", "")).alias("path"))


@query("flt10_scope", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2)) OR o_orderkey IN (1, 2, 3)")
def scope(t):
    by_doc = t.customer.where("c_nationkey IN (1, 2)").select(c("c_custkey").alias("o_custkey"))
    keys = t.orders.join(by_doc, "o_custkey", "left_semi").select("o_orderkey").unionByName(t.orders.where("o_orderkey IN (1, 2, 3)").select("o_orderkey"))
    return keys.distinct()


@query("flt11_fetch_in_order", "SELECT pos, doc_id, n_chars FROM (SELECT unnest([5, 3, 8, 1]) AS doc_id, unnest([0, 1, 2, 3]) AS pos) JOIN documents USING (doc_id)")
def fetch(t):
    wanted = t.spark.createDataFrame([(d, k) for k, d in enumerate((5, 3, 8, 1))], "doc_id long, pos int")
    return t.documents.select("doc_id", "n_chars").join(F.broadcast(wanted), "doc_id").orderBy("pos").select("pos", "doc_id", "n_chars")


@query("prj1_evidence_blocks", "SELECT doc_id, 'doc/' || doc_id AS block_id, sha256(text) AS source_sha256, length(text) AS end_char FROM documents")
def evidence_blocks(t):
    block = F.struct(F.concat(F.lit("doc/"), "doc_id").alias("block_id"), F.sha2("text", 256).alias("source_sha256"), F.struct(F.lit(0).alias("start_char"), F.length("text").cast("long").alias("end_char")).alias("locator"))
    return t.documents.select("doc_id", block.alias("b")).select("doc_id", "b.block_id", "b.source_sha256", "b.locator.end_char")


@query("prj4_brief", "SELECT c_custkey, c_name, n_name, round(c_acctbal, 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey")
def brief(t):
    return t.customer.join(t.nation, c("n_nationkey") == c("c_nationkey")).select("c_custkey", "c_name", "n_name", F.round("c_acctbal", 2).alias("balance"))


@query("jn1_blocks_extractions", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def jn1(t):
    return t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("jn2_four_way", "SELECT n_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' GROUP BY 1, 2")
def jn2(t):
    lines = t.lineitem.where("l_returnflag = 'N'").select("l_orderkey", "l_partkey", "l_quantity")
    d = lines.join(t.orders, c("o_orderkey") == c("l_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey")).join(t.nation, c("n_nationkey") == c("c_nationkey")).join(t.part, c("p_partkey") == c("l_partkey"))
    return d.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("jn3_left_on_predicate", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A'")
def jn3(t):
    return t.orders.join(t.lineitem, (c("l_orderkey") == c("o_orderkey")) & (c("l_returnflag") == "A"), "left").select("o_orderkey", "l_linenumber")


@query("jn5_without_job", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jn5(t):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), c("l_orderkey") == c("o_orderkey"), "left_anti").select("o_orderkey")


@query("jn6_missing_jobs", "SELECT doc_id, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS same_digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def jn6(t):
    none = t.documents.select("doc_id").join(t.labels.where("toxic = 1"), "doc_id", "left_anti")
    same = t.labels.where("quality = 1").select("doc_id", F.lit(True).alias("has")).distinct()
    return none.join(same, "doc_id", "left").select("doc_id", c("has").isNull().alias("same_digest"))


@query("jn7_unregistered", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = o.o_orderstatus AND p.o_orderpriority = o.o_orderpriority AND p.o_totalprice > 150000)")
def jn7(t):
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return t.orders.select(*keys).join(t.orders.where("o_totalprice > 150000").select(*keys), keys, "left_anti").distinct()


@query("jn8_unlogged", "SELECT conv_id, turn FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
def jn8(t):
    log = t.conversations.select("conv_id", (c("turn") - 1).alias("turn"))
    return t.conversations.join(log, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("jn9_latest_without_outbox", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT DISTINCT user_id, event_id FROM r WHERE r = 1 AND event_type <> 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def jn9(t):
    newest = selection.latest_by(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])
    done = t.events.where("event_type = 'purchase'").select("user_id")
    return newest.where("event_type <> 'click'").join(done, "user_id", "left_semi").select("user_id", "event_id").distinct()


@query("jn10_latest_row", "SELECT l_orderkey, l_linenumber, l_shipmode FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC) AS r FROM lineitem) WHERE r = 1")
def jn10(t):
    return selection.latest_by(t.lineitem.select("l_orderkey", "l_linenumber", c("l_returnflag").alias("l_shipmode")), ["l_orderkey"], ["l_linenumber", "l_shipmode"])


@query("jn11_version_as_of", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '{CUT}') WHERE r = 1")
def jn11(t):
    return selection.as_of(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", F.lit(CUT).cast("timestamp_ntz"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("jn12_event_as_of", "SELECT e.event_id, p.event_id AS purchase FROM events e LEFT JOIN LATERAL (SELECT event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) p ON true WHERE e.event_type = 'click'")
def jn12(t):
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", c("event_id").alias("purchase"), c("ts").alias("bought"))
    return selection.as_of_join(clicks, bought, ["user_id"], "ts", "bought", "purchase").select("event_id", "purchase")


@query("jn13_claim_as_of", "SELECT conv_id, max(turn) AS revision FROM conversations WHERE turn <= 2 GROUP BY 1")
def jn13(t):
    return selection.as_of(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", F.lit(2)).select("conv_id", c("turn").alias("revision"))


@query("jn15_all_evidence_public", f"SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_linenumber) > 0 AND bool_and(l_shipdate <= TIMESTAMP '{CUT}')")
def jn15(t):
    refs = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_shipdate"), c("l_orderkey") == c("o_orderkey"), "left")
    ok = F.bool_and(F.coalesce(c("l_shipdate") <= F.lit(CUT).cast("timestamp_ntz"), F.lit(False)))
    return refs.groupBy("o_orderkey").agg(ok.alias("ok")).where("ok").select("o_orderkey")


@query("jn16_bridge", "SELECT n_name, c_custkey, o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def jn16(t):
    current = t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return current.join(t.customer, c("c_custkey") == c("o_custkey")).join(t.nation, c("n_nationkey") == c("c_nationkey")).select("n_name", "c_custkey", "o_orderkey")


@query("jn17_referencing_claims", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def jn17(t):
    from ..operators.reports import claims_citing

    ref = F.struct(F.struct(c("l_partkey").cast("string").alias("doc_id"), c("l_linenumber").alias("n")).alias("source"))
    claims = t.lineitem.groupBy(c("l_orderkey").alias("claim_id")).agg(F.to_json(F.collect_list(ref)).alias("evidence"))  # the lines of one order
    return claims_citing(claims, t.part.where("p_size = 10").select(c("p_partkey").alias("doc_id"))).select(c("claim_id").alias("l_orderkey")).distinct()


@query("jn19_invalidation_fan_out", "WITH hit AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2, 3)) SELECT 'claim' AS kind, l_orderkey AS id FROM hit UNION SELECT 'summary', o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM hit)")
def jn19(t):
    hit = t.lineitem.where("l_partkey IN (1, 2, 3)").select("l_orderkey").distinct()
    onward = t.orders.join(hit, c("l_orderkey") == c("o_orderkey"), "left_semi").select(F.lit("summary").alias("kind"), c("o_custkey").alias("id"))
    return hit.select(F.lit("claim").alias("kind"), c("l_orderkey").alias("id")).unionByName(onward).distinct()


@query("jn20_box_overlap", "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_discount * 5 AS x0, l_tax * 5 AS y0 FROM lineitem) SELECT a.page, a.id AS a, b.id AS b, round(i / (0.32 - i), 6) AS iou FROM b a JOIN b ON a.page = b.page AND a.id < b.id, LATERAL (SELECT greatest(0, 0.4 - abs(a.x0 - b.x0)) * greatest(0, 0.4 - abs(a.y0 - b.y0)) AS i) WHERE round(i / (0.32 - i), 6) >= 0.5")
def jn20(t):
    from ..operators.spatial import overlapping

    x, y = c("l_discount") * 5, c("l_tax") * 5
    boxes = t.lineitem.select(c("l_orderkey").alias("page"), c("l_linenumber").alias("id"), x.alias("x0"), y.alias("y0"), (x + 0.4).alias("x1"), (y + 0.4).alias("y1"))
    pairs = overlapping(boxes, boxes, ["page"]).where("a < b")
    return pairs.select("page", "a", "b", F.round("iou", 6).alias("iou")).where("iou >= 0.5")


@query("jn23_snapshot_diff", "WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0) SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'absent' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k")
def jn23(t):
    from ..operators.history import snapshot_diff

    base = t.customer.select(c("c_custkey").alias("doc_id"), c("c_mktsegment").alias("v"))
    after = base.where("doc_id % 11 <> 0").withColumn("v", F.when(c("doc_id") % 7 == 0, "CHANGED").otherwise(c("v")))
    return snapshot_diff(base.where("doc_id % 10 <> 0"), after, ["doc_id"], ["v"]).select("doc_id", "change")


@query("jn25_first_failing_reason", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown_customer' WHEN c_acctbal < 0 THEN 'negative_balance' WHEN n.n IS NULL THEN 'no_lines' WHEN o_totalprice > 200000 THEN 'too_large' ELSE 'PASS' END AS reason FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 13 <> 0 LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) n ON l_orderkey = o_orderkey")
def jn25(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    d = t.orders.join(t.customer.where("c_custkey % 13 <> 0"), c("c_custkey") == c("o_custkey"), "left").join(lines, c("l_orderkey") == c("o_orderkey"), "left")
    reason = F.coalesce(F.when(c("c_custkey").isNull(), "unknown_customer"), F.when(c("c_acctbal") < 0, "negative_balance"), F.when(c("n").isNull(), "no_lines"), F.when(c("o_totalprice") > 200000, "too_large"), F.lit("PASS"))
    return d.select("o_orderkey", reason.alias("reason"))


@query("agg1_job_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def agg1(t):
    p = t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["O", "P", "F"]).count().na.fill(0)
    return p.select("o_custkey", c("O").alias("pending"), c("P").alias("running"), c("F").alias("done"))


@query("agg2_catalog_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS available, count(DISTINCT o_custkey) AS documents, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS ready_bytes FROM orders")
def agg2(t):
    return t.orders.agg(F.count("*").alias("total"), F.count_if(c("o_orderstatus") != "P").alias("available"), F.countDistinct("o_custkey").alias("documents"), F.round(F.sum(F.when(c("o_orderstatus") == "F", c("o_totalprice")).otherwise(0)), 2).alias("ready_bytes"))


@query("agg3_source_breakdown", "SELECT source, coalesce(CAST(quality AS VARCHAR), 'unknown') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def agg3(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source", F.coalesce(c("quality").cast("string"), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("agg4_status_market", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, strftime(max(o_orderdate), '{DAY}') AS newest, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def agg4(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), ymd(F.max("o_orderdate")).alias("newest"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("agg5_store_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def agg5(t):
    out = None
    for name in ("documents", "pages", "events"):
        one = getattr(t, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("agg9_usage_totals", "SELECT user_id, count(*) AS requests, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def agg9(t):
    return t.events.where(c("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("user_id").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"))


@query("agg10_budget_totals", "SELECT count(*) FILTER (event_type = 'click') AS reserved, count(*) FILTER (event_type = 'purchase') AS settled, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS tokens, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS other FROM events")
def agg10(t):
    is_click, bought = c("event_type") == "click", c("event_type") == "purchase"
    return t.events.agg(F.count_if(is_click).alias("reserved"), F.count_if(bought).alias("settled"), F.round(F.coalesce(F.sum(F.when(bought, c("value"))), F.lit(0.0)), 2).alias("tokens"), F.count_if(~is_click & ~bought).alias("other"))


@query("agg11_task_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg11(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg12_latest_revision", "SELECT conv_id, max(turn) AS revision, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def agg12(t):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("revision"), F.max_by("role", "turn").alias("role"))


@query("agg13_ops_status", "SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS recent FROM events GROUP BY 1")
def agg13(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(c("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")).alias("recent"))


@query(
    "agg13_operations",
    """SELECT 'jobs' AS part, event_type || '/' || CASE user_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'done' ELSE 'pending' END AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'failed', '48h', count(*) FROM events WHERE user_id % 3 = 0 AND ts BETWEEN TIMESTAMP '2024-01-18 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
    UNION ALL SELECT 'outbox', role || '/' || CASE WHEN turn > 2 THEN 'done' ELSE 'pending' END, count(*) FROM conversations GROUP BY 2 UNION ALL SELECT 'generation', 'gen-1', 1""",
)
def operations(t):
    from ..operators import reports

    k = c("user_id") % 3
    jobs = t.events.select(c("event_type").alias("stage"), F.when(k == 0, "failed").when(k == 1, "done").otherwise("pending").alias("status"), c("ts").cast("timestamp_ntz").alias("updated_at"))
    boxes = t.conversations.select(c("role").alias("box"), F.when(c("turn") > 2, "done").otherwise("pending").alias("status"))
    return reports.operations(jobs, boxes, "gen-1", F.lit("2024-01-20").cast("timestamp_ntz"), 48)


@query(
    "agg14_page_damage",
    r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS o, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), b AS (SELECT doc_id, CASE WHEN o // 3 = 0 THEN 1 ELSE o // 3 END AS page, length(line) AS n, (len(regexp_extract_all(line, '[\x{a0}-\x{ff}]{6,}')) >= 3 OR regexp_matches(line, '[\x{a0}-\x{ff}]{18,}')) AS glyphs, o % 7 = 3 AS marked FROM l)
    SELECT doc_id, page, sum(n)::BIGINT AS chars, concat_ws(',', CASE WHEN bool_or(glyphs) THEN 'cid_style_glyph_runs' END, CASE WHEN bool_or(marked) THEN 'damaged_text_layer' END) AS damage, coalesce(['text_layer', 'ocr_applied'][page], '') AS recorded FROM b GROUP BY 1, 2""".replace("\\\\", "\\"),
)
def page_damage(t):
    from ..operators import reports

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "text"))
    blocks = lines.select("doc_id", F.floor(c("o") / 3).cast("int").alias("page"), "text", F.when(c("o") % 7 == 3, F.array(F.lit("damaged_text_layer"), F.lit("other"))).alias("issues"))
    statuses = t.documents.select("doc_id", F.array(F.lit("text_layer"), F.lit("ocr_applied")).alias("page_ocr_status"))
    out = reports.page_classes(blocks, statuses, "doc_id")
    return out.select("doc_id", c("page").cast("long").alias("page"), "chars", F.array_join("damage", ",").alias("damage"), F.coalesce("recorded_status", F.lit("")).alias("recorded"))


@query("agg14_page_classes", "SELECT l_orderkey, sum(l_quantity) AS chars, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY 1")
def agg14(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("chars"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("tags"))


@query("agg15_inventory", "WITH b AS (SELECT source, doc_id // 4096 AS bucket, count(*) AS n, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (quality IS NULL) AS unknown, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS d FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS documents, CAST(sum(poor) AS BIGINT) AS poor, CAST(sum(unknown) AS BIGINT) AS unknown, sha256(string_agg(d, ',' ORDER BY bucket)) AS manifest FROM b GROUP BY 1")
def agg15(t):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    labelled = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").groupBy("source", F.floor(c("doc_id") / 4096).alias("bucket"))
    buckets = labelled.agg(F.count("*").alias("n"), F.count_if(c("quality") == 0).alias("poor"), F.count_if(c("quality").isNull()).alias("unknown"), F.sha2(F.array_join(ids, ","), 256).alias("d"))
    return buckets.groupBy("source").agg(F.sum("n").alias("documents"), F.sum("poor").alias("poor"), F.sum("unknown").alias("unknown"), digest_of_digests("bucket", "d", ",").alias("manifest"))


def digest_of_digests(bucket: str, digest: str, separator: str):
    """Of buckets of bounded size, so that no row gathers more than a digest a bucket."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(bucket, digest))), lambda x: x[digest]), separator), 256)


@query("agg16_measurement", "SELECT count(*) AS n, count(*) FILTER (n_chars > 1000) AS measured, CAST(sum(n_chars) AS BIGINT) AS tokens, bool_and(n_chars >= 0) AS exact FROM documents")
def agg16(t):
    return t.documents.agg(F.count("*").alias("n"), F.count_if(c("n_chars") > 1000).alias("measured"), F.sum("n_chars").alias("tokens"), F.bool_and(c("n_chars") >= 0).alias("exact"))


@query("agg17_strata", "SELECT source || '|' || lang AS stratum, count(*) AS n FROM documents GROUP BY 1")
def agg17(t):
    return t.documents.groupBy(F.concat_ws("|", "source", "lang").alias("stratum")).agg(F.count("*").alias("n"))


@query("agg18_diagnosis", "SELECT reason, count(*) AS n FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS reason FROM orders) GROUP BY 1")
def agg18(t):
    return t.orders.select(F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("agg19_common_line_share", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY 1, 2) SELECT doc_id, max(n) / sum(n) AS share FROM n GROUP BY 1 HAVING sum(n) >= 8")
def agg19(t):
    from ..functions.quality import most_common_share

    d = t.documents.select("doc_id", F.split("text", "\n").alias("lines")).where(F.size("lines") >= 8)
    return d.select("doc_id", most_common_share(c("lines")).alias("share"))


@query("agg20_dispositions", "SELECT CASE WHEN url LIKE '%.html%' THEN 'page' WHEN url LIKE '%?%' THEN 'query' ELSE 'other' END AS disposition, count(*) AS n FROM pages GROUP BY 1")
def agg20(t):
    kind = F.when(F.contains("url", F.lit(".html")), "page").when(F.contains("url", F.lit("?")), "query").otherwise("other")
    return t.pages.groupBy(kind.alias("disposition")).agg(F.count("*").alias("n"))


@query("agg21_ordered_digest", "WITH b AS (SELECT source, doc_id // 4096 AS bucket, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS d FROM documents GROUP BY 1, 2) SELECT source, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY 1")
def agg21(t):
    lines = F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h"))))
    buckets = t.documents.groupBy("source", F.floor(c("doc_id") / 4096).alias("bucket")).agg(F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x["doc_id"], F.lit(":"), x["h"])), "\n"), 256).alias("d"))
    return buckets.groupBy("source").agg(digest_of_digests("bucket", "d", "\n").alias("digest"))


@query("agg22_changes_since", "SELECT count(*) AS n, max(event_id) AS newest FROM events WHERE event_id > 100")
def agg22(t):
    return t.events.where("event_id > 100").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("win1_selection", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'F') WHERE r = 1")
def win1(t):
    return selection.latest(t.orders.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    "win2_effective_extraction",
    """WITH b AS (SELECT l_orderkey, bool_and(l_tax <= 0.06) AS all_u, bool_or(l_tax <= 0.06) AS any_u, bool_and(l_returnflag <> 'A') AS all_r, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 3) AS pages FROM lineitem GROUP BY 1),
    r AS (SELECT o_custkey AS version, o_orderkey AS extraction_id, CASE WHEN o_orderstatus = 'O' AND all_u AND all_r AND (SELECT count(DISTINCT l_linenumber) FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_linenumber <= 1 + o_orderkey % 3) = 1 + o_orderkey % 3 THEN 0 WHEN o_orderstatus <> 'F' AND any_u THEN 1 END AS tier, max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders LEFT JOIN b ON l_orderkey = o_orderkey)
    SELECT version, extraction_id, tier, extraction_id = newest AS is_newest FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY tier, extraction_id DESC) AS n FROM r WHERE tier IS NOT NULL) WHERE n = 1""",
)
def win2(t):
    status = F.when(c("o_orderstatus") == "O", "ready").when(c("o_orderstatus") == "F", "failed").otherwise("review")
    extractions = t.orders.select(c("o_custkey").alias("version"), c("o_orderkey").alias("extraction_id"), status.alias("status"), (1 + c("o_orderkey") % 3).alias("pages"), F.lit(0).alias("missing_pages"), c("o_orderkey").alias("ingest_seq"))
    blocks = t.lineitem.select(c("l_orderkey").alias("extraction_id"), F.when(c("l_tax") <= 0.06, "clean text").otherwise("\x01\x02\x03\x04\x05").alias("text"), c("l_linenumber").alias("page"), F.when(c("l_returnflag") == "A", "review").otherwise("ready").alias("block_status"))
    return selection.effective_extractions(extractions, blocks)


@query("win3_latest_by_insertion", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def win3(t):
    return selection.latest_by(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("win4_active_generation", "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1")
def win4(t):
    return t.events.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id")


@query("win5_evidence_links", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def win5(t):
    preference = F.when(c("l_returnflag") == "R", 0).when(c("l_returnflag") == "A", 1).otherwise(2)
    picked = t.lineitem.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(preference, "l_linenumber"))).where("r <= 2")
    return picked.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("shown"))


@query("win6_neighbours", "SELECT conv_id, turn, md5(lag(text) OVER w) AS before, md5(lead(text) OVER w) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win6(t):
    d = selection.neighbours(t.conversations, ["conv_id"], "turn", "text")
    return d.select("conv_id", "turn", F.md5("before").alias("before"), F.md5("after").alias("after"))


@query("win7_first_refs", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS refs FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def win7(t):
    return t.lineitem.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("refs"))


@query("win10_sections", "SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS INT) AS section FROM conversations")
def win10(t):
    return selection.sections(t.conversations, ["conv_id"], "turn", 2).select("conv_id", "turn", "section")


@query("win11_numbering", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system'")
def win11(t):
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("n"))


@query("win12_next_revision", "SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY 1")
def win12(t):
    return t.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("next"))


@query("win13_hash_ordered_pick", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 5")
def win13(t):
    return selection.hash_ordered_pick(t.documents.select("lang", "doc_id"), "lang", "doc_id", 5).select("lang", "doc_id")


@query("win14_layered_sample", "WITH l AS (SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'long' WHEN lang <> 'en' THEN 'foreign' ELSE 'plain' END AS layer FROM documents) SELECT layer, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM l) WHERE r <= 3")
def win14(t):
    layer = F.when(c("n_chars") > 5000, "long").when(c("lang") != "en", "foreign").otherwise("plain")
    return selection.hash_ordered_pick(t.documents.select("doc_id", layer.alias("layer")), "layer", "doc_id", 3).select("layer", "doc_id")


@query(
    "win15_stratified_sample",
    """WITH s AS (SELECT concat_ws('|', source, lang) AS stratum, doc_id FROM documents), z AS (SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, stratum) AS place, sum(count(*)) OVER () AS w FROM s GROUP BY 1),
    raw AS (SELECT stratum, place, least(n - 1, greatest(0, round_even(n / w * 30, 0) - 1)) AS extra FROM z WHERE place <= 30),
    quota AS (SELECT stratum, 1 + greatest(0, least(extra, 30 - count(*) OVER () - coalesce(sum(extra) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM raw)
    SELECT stratum, doc_id FROM (SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY sha256(doc_id::VARCHAR)) AS pick FROM s) JOIN quota USING (stratum) WHERE pick <= quota""",
)
def win15(t):
    total = 30
    strata = t.documents.withColumn("stratum", F.concat_ws("|", "source", "lang"))
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("n"))
    largest = [(r.stratum, r.n) for r in sizes.orderBy(F.desc("n"), "stratum").limit(total).collect()]  # at most `total` strata can have a quota
    quotas = selection.stratum_quotas(largest, total, t.documents.count())
    quota = t.spark.createDataFrame(list(quotas.items()), "stratum string, quota int")
    picked = selection.hash_ordered_pick(strata.select("stratum", "doc_id"), "stratum", "doc_id", max(quotas.values(), default=0))
    return picked.join(F.broadcast(quota), "stratum").where("pick <= quota").select("stratum", "doc_id")


@query("win15_seeded_sample")
def win15_seeded(t):
    from ..operators.sampling import seeded_sample

    rows = t.documents.select(F.concat_ws("|", "source", "lang").alias("stratum"), "source", "doc_id")
    return seeded_sample(rows, "stratum", ["source", "doc_id"], 120, 80, 20261001).select("stratum", "doc_id", "split")


@query(
    "win14_layered_pick",
    """WITH d AS (SELECT doc_id, n_chars, source, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), a AS (SELECT 'toxic' AS layer, doc_id FROM d WHERE toxic = 1 ORDER BY source, doc_id LIMIT 4),
    b AS (SELECT 'foreign' AS layer, doc_id FROM d WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY source, doc_id LIMIT 5), e AS (SELECT 'poor' AS layer, doc_id FROM d WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) ORDER BY source, doc_id LIMIT 5),
    f AS (SELECT 'longest' AS layer, doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b UNION ALL SELECT doc_id FROM e) ORDER BY n_chars DESC, doc_id LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f""",
)
def win14_layered(t):
    from ..operators.sampling import layered_sample

    d = t.documents.select("doc_id", "n_chars", "source", "lang").join(t.labels, "doc_id", "left")
    layers = [("toxic", c("toxic") == 1, 4), ("foreign", c("lang") != "en", 8), ("poor", c("quality") == 0, 5), ("longest", F.lit(True), 1, [F.desc("n_chars"), c("doc_id")])]
    return layered_sample(d, layers, ["doc_id"], [c("source"), c("doc_id")], 5).select("layer", "doc_id")


@query("top1_total_order", "SELECT o_orderkey, round(o_totalprice, 2) AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top1(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", F.round("o_totalprice", 2).alias("score"))


@query("top2_cursor_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 40")
def top2(t):
    from ..operators.retrieval import decode_cursor, encode_cursor, page

    cursor = encode_cursor(digest="q", generation="g", offset=40)
    return page(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, decode_cursor(cursor, digest="q", generation="g")["offset"]).select("o_orderkey")


@query("top3_block_page", "SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 5 ORDER BY l_linenumber, l_partkey LIMIT 3 OFFSET 1")
def top3(t):
    return t.lineitem.where("l_orderkey = 5").orderBy("l_linenumber", "l_partkey").offset(1).limit(3).select("l_linenumber", "l_partkey")


@query("top4_event_page", "SELECT event_id, event_type FROM events WHERE event_id > 50 ORDER BY event_id LIMIT 100")
def top4(t):
    return t.events.where("event_id > 50").orderBy("event_id").limit(100).select("event_id", "event_type")


@query("top5_recent", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20")
def top5(t):
    return t.events.orderBy(F.desc("event_id")).limit(20).select("event_id")


@query("top6_package_sort", "SELECT k, row_number() OVER (ORDER BY period DESC NULLS FIRST, k) AS pos FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS period FROM customer) ORDER BY period DESC NULLS FIRST, k LIMIT 40")
def top6(t):
    d = t.customer.select(c("c_custkey").alias("k"), F.when(c("c_custkey") % 9 != 0, c("c_acctbal")).alias("period"))
    first = d.orderBy(F.desc_nulls_first("period"), "k").limit(40)
    return first.select("k", F.row_number().over(Window.orderBy(F.desc_nulls_first("period"), "k")).cast("long").alias("pos"))


@query("top7_queue_head", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 30")
def top7(t):
    return t.events.where("event_type = 'view'").orderBy("event_id").limit(30).select("event_id")


@query("top8_reprocess_slice", "SELECT doc_id FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 15")
def top8(t):
    return t.labels.where("quality = 0").orderBy("doc_id").limit(15).select("doc_id")


@query("set1_absent", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set1(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("set2_batch_divergence", "SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'added', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def set2(t):
    frozen, now = t.documents.where("doc_id % 2 = 0").select("doc_id"), t.labels.select("doc_id")
    return frozen.subtract(now).select(F.lit("missing").alias("side"), "doc_id").unionByName(now.subtract(frozen).select(F.lit("added").alias("side"), "doc_id"))


@query("set3_coverage", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def set3(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id")).agg(F.count("*").alias("n"))


@query("set4_bundle_union", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, quality FROM labels WHERE quality = 1 UNION SELECT doc_id, quality FROM labels WHERE toxic = 0) GROUP BY 1")
def set4(t):
    a, b = t.labels.where("quality = 1").select("doc_id", "quality"), t.labels.where("toxic = 0").select("doc_id", "quality")
    return a.unionByName(b).distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "set4_bundle_conflicts",
    """WITH m AS (SELECT l_suppkey % 3 AS batch, 'block-' || l_partkey || '-' || l_linenumber || '.json' AS name, l_returnflag AS source, l_orderkey AS doc_id, l_linestatus AS version_id, (l_linenumber % 2)::VARCHAR AS extraction_id, l_linenumber AS page, l_partkey || '/' || l_suppkey AS block_id FROM lineitem WHERE l_suppkey % 3 < 2),
    s AS (SELECT 0 AS rule, source || '/' || doc_id AS subject, count(DISTINCT version_id) AS n FROM m GROUP BY 2 UNION ALL SELECT 1, source || '/' || doc_id || '/' || version_id, count(DISTINCT extraction_id) FROM m GROUP BY 2 UNION ALL SELECT 2, source || '/' || doc_id || '/' || version_id || '/' || page, count(*) FROM m GROUP BY 2
    UNION ALL SELECT 3, block_id, count(*) FROM m GROUP BY 2 UNION ALL SELECT 4, name, count(*) FROM m GROUP BY 2 UNION ALL SELECT 5, p_brand, count(DISTINCT sha256(p_type)) FROM part GROUP BY 2) SELECT rule, subject, n FROM s WHERE n > 1""",
)
def set4_conflicts(t):
    from ..operators.batches import bundle_conflicts

    text = lambda *parts: F.concat(*(F.lit(p) if p in ("block-", "-", ".json", "/") else c(p).cast("string") for p in parts))
    m = t.lineitem.where("l_suppkey % 3 < 2").select((c("l_suppkey") % 3).alias("batch"), text("block-", "l_partkey", "-", "l_linenumber", ".json").alias("name"), c("l_returnflag").alias("source"), c("l_orderkey").alias("doc_id"), c("l_linestatus").alias("version_id"), (c("l_linenumber") % 2).cast("string").alias("extraction_id"), F.lit("s").alias("snapshot_sha256"), c("l_linenumber").alias("page"), text("l_partkey", "/", "l_suppkey").alias("block_id"))
    assets = t.part.select((c("p_partkey") % 3).alias("batch"), c("p_brand").alias("name"), F.sha2("p_type", 256).alias("sha256"))
    return bundle_conflicts(m, assets).select("rule", "subject", "n")


@query("set5_issue_union", "SELECT l_orderkey, string_agg(DISTINCT x, ',' ORDER BY x) AS issues FROM (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS x FROM lineitem) GROUP BY 1")
def set5(t):
    issues = F.array_sort(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(issues, ",").alias("issues"))
