"""Queries of reconciliation, history, governance and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, queues, selection
from .registry import query

c = F.col


@query("scd1_snapshot_commit", "WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS version_id, md5(l_partkey || 'x') AS kept, md5(l_partkey || CASE WHEN l_suppkey % 10 = 0 THEN 'y' ELSE 'x' END) AS sha, l_returnflag <> 'R' AS present, l_linestatus = 'O' AS cur FROM lineitem), k AS (SELECT doc_id, count(*) FILTER (cur) AS n FROM o GROUP BY 1) SELECT doc_id, version_id, kept AS sha256, CASE WHEN NOT present THEN 'missing' WHEN sha <> kept THEN 'conflict' ELSE 'ready' END AS state, cur AND n = 1 AS is_current FROM o JOIN k USING (doc_id)")
def scd1(t):
    o = t.lineitem.select(c("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("version_id"), F.md5(F.concat(c("l_partkey"), F.when(c("l_suppkey") % 10 == 0, "y").otherwise("x"))).alias("sha256"), F.lit(None).cast("string").alias("declared"), (c("l_returnflag") != "R").alias("present"), (c("l_linestatus") == "O").alias("current"))
    kept = t.lineitem.select(c("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("version_id"), F.md5(F.concat(c("l_partkey"), F.lit("x"))).alias("sha256")).dropDuplicates(["doc_id", "version_id"])
    return history.reconciled_versions(kept, o)


@query(
    "scd2_change_ledger",
    """WITH d AS (SELECT o_orderkey AS id, o_orderkey % 3 > 0 AS known, CASE WHEN o_orderkey % 4 = 0 THEN 'title' ELSE '' END AS f, o_orderstatus = 'F' AS was, o_totalprice > 150000 AS now FROM orders), v AS (SELECT l_orderkey AS id, count(*) FILTER (l_linenumber > 3) AS n, min(l_linenumber) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS x FROM lineitem GROUP BY 1)
    SELECT id AS doc_id, 'metadata_updated' AS kind, f AS detail FROM d WHERE known AND f <> '' UNION ALL SELECT id, 'new_version', CAST(n AS VARCHAR) FROM d JOIN v USING (id) WHERE n > 0 UNION ALL SELECT id, 'became_unavailable', '' FROM d WHERE known AND was AND NOT now UNION ALL SELECT id, 'recovered', '' FROM d WHERE known AND NOT was AND now UNION ALL SELECT id, 'content_conflict', CAST(x AS VARCHAR) FROM d JOIN v USING (id) WHERE x IS NOT NULL""",
)
def scd2(t):
    k = c("o_orderkey")
    d = t.orders.select(k.alias("doc_id"), (k % 3 > 0).alias("known_before"), F.when(k % 4 == 0, "title").otherwise("").alias("changed_fields"), (c("o_orderstatus") == "F").alias("was_available"), (c("o_totalprice") > 150000).alias("available"), F.lit(None).cast("string").alias("old_current"), F.lit(None).cast("string").alias("new_current"))
    v = t.lineitem.select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("version_id"), (c("l_linenumber") > 3).alias("is_new"), F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "conflict").otherwise("ready").alias("state"), F.lit(None).cast("string").alias("old_state"))
    return history.change_events(d, v)


@query("scd2_metadata_diff", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'title,status' WHEN c_custkey % 5 = 0 THEN 'title' WHEN c_custkey % 2 = 0 THEN 'status' ELSE '' END AS fields FROM customer")
def metadata_diff(t):
    before = t.customer.select("c_custkey", c("c_name").alias("title"), c("c_mktsegment").alias("status"), F.lit("").alias("author"))
    after = t.customer.select("c_custkey", F.when(c("c_custkey") % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(c("c_name")).alias("title"), F.when(c("c_custkey") % 2 == 0, "x").otherwise(c("c_mktsegment")).alias("status"), F.lit(None).cast("string").alias("author"))
    return history.snapshot_diff(before, after, ["c_custkey"], ["title", "status", "author"]).select("c_custkey", "fields")


@query("scd3_document_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS first_seen, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS last_seen FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def scd3(t):
    row = lambda df, v: df.select("c_custkey", F.lit(v).alias("first_seen"), F.lit(v).alias("last_seen"))
    return history.upserted(row(t.customer.where("c_custkey % 3 = 0"), "old"), row(t.customer.where("c_custkey % 2 = 0"), "new"), ["c_custkey"], ["first_seen"])


_PUBLIC = "SELECT l_orderkey, l_linenumber, o_orderdate AS published, o_orderdate + INTERVAL 60 DAY AS filed, l_shipdate AS first, CASE WHEN l_linenumber = 7 THEN l_shipdate END AS own FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query("scd4_public_time", f"SELECT l_orderkey, l_linenumber, strftime(CASE WHEN own IS NOT NULL THEN own WHEN published >= first THEN published WHEN filed >= first THEN filed END, '%Y-%m-%d') AS at, CASE WHEN own IS NOT NULL THEN 'explicit' WHEN published >= first THEN 'published_at' WHEN filed >= first THEN 'filing_date' ELSE 'unknown' END AS basis FROM ({_PUBLIC})")
def scd4(t):
    d = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey"))
    p = history.public_time(F.when(c("l_linenumber") == 7, c("l_shipdate")), F.lit("explicit"), c("o_orderdate"), c("o_orderdate") + F.expr("INTERVAL 60 DAY"), c("l_shipdate"))
    return d.select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", F.date_format("p.at", "yyyy-MM-dd").alias("at"), "p.basis")


@query("scd5_passed_evidence", "SELECT basis, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 > 0 THEN 'published_at' WHEN o_orderdate + INTERVAL 60 DAY >= l_shipdate THEN 'filing_date' ELSE 'unknown' END AS basis FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1")
def scd5(t):
    d = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey"))
    published = F.when(c("o_orderkey") % 4 > 0, c("o_orderdate"))
    p = history.public_time(published, F.lit("published_at"), published, c("o_orderdate") + F.expr("INTERVAL 60 DAY"), c("l_shipdate"))
    return d.select(p.alias("p")).groupBy("p.basis").agg(F.count("*").alias("n"))


@query("aud1_misbound_times", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('R', 'A') AND (l_linenumber = 2 OR o_orderdate < l_shipdate)")
def aud1(t):
    v = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).select("l_orderkey", "l_linenumber", F.when(c("l_linenumber") != 2, c("l_shipdate")).alias("first_observed_at"), c("o_orderdate").alias("public_available_at"), F.when(c("l_returnflag") == "R", "published_at").when(c("l_returnflag") == "A", "filing_date").otherwise("adapter").alias("public_time_basis"))
    return history.misbound_public_times(v).select("l_orderkey", "l_linenumber")


@query("aud3_repair_queue", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus = 'P' ORDER BY o_custkey LIMIT 50")
def aud3(t):
    newest = selection.latest_by(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])
    return newest.where("o_orderstatus = 'P'").orderBy("o_custkey").limit(50).select("o_custkey", "o_orderkey")


@query("aud4_batch_divergence", "SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS added FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) d FULL JOIN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) l USING (doc_id)")
def aud4(t):
    a, b = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("a")), t.labels.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full_outer").agg(F.count_if(c("b").isNull()).alias("missing"), F.count_if(c("a").isNull()).alias("added"))


@query("aud5_governance_plan", "SELECT page_id, CASE WHEN n > 1 THEN 'duplicate' WHEN url LIKE '%utm_%' THEN 'tracked' WHEN url LIKE 'http://%' THEN 'insecure' ELSE 'keep' END AS disposition FROM (SELECT *, count(*) OVER (PARTITION BY regexp_replace(url, '[?#].*$', '')) AS n FROM pages)")
def aud5(t):
    place = F.regexp_replace("url", "[?#].*$", "")
    seen = t.pages.groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    d = t.pages.select("page_id", "url", place.alias("place")).join(seen, "place")
    return d.select("page_id", F.when(c("n") > 1, "duplicate").when(F.contains("url", F.lit("utm_")), "tracked").when(c("url").startswith("http://"), "insecure").otherwise("keep").alias("disposition"))


@query("aud7_projection_pointer", "SELECT conv_id, arg_max(turn, turn) FILTER (role <> 'user') AS head FROM conversations GROUP BY 1 HAVING count(*) FILTER (role <> 'user') > 0")
def aud7(t):
    return t.conversations.where("role <> 'user'").groupBy("conv_id").agg(F.max("turn").alias("head"))


@query("aud8_projected_block", "SELECT d.doc_id, md5(coalesce(p.text, d.text)) AS shown FROM documents d LEFT JOIN (SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0) p ON p.item_id = d.doc_id")
def aud8(t):
    from ..operators.projections import projected_blocks

    blocks = t.documents.select(c("doc_id").alias("block_id"), "text")
    made = t.benchmark.where("item_id % 2 = 0").select(c("item_id").alias("block_id"), c("text").alias("projected_text")).join(blocks, "block_id")
    stored = made.select(F.concat(F.lit("p"), "block_id").alias("projection_id"), "block_id", F.sha2("text", 256).alias("text_sha256"), "projected_text")
    return projected_blocks(blocks, stored, stored.select("block_id", "projection_id")).select(c("block_id").alias("doc_id"), F.md5("text").alias("shown"))


@query("aud10_reconcile", "SELECT CASE WHEN s_suppkey IS NULL THEN 'unknown_supplier' WHEN l_quantity <= 0 THEN 'empty' WHEN l_discount > 0.09 THEN 'discount' ELSE 'PASS' END AS verdict, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1")
def aud10(t):
    d = t.lineitem.join(t.supplier.where("s_acctbal > 0"), c("s_suppkey") == c("l_suppkey"), "left")
    verdict = F.coalesce(F.when(c("s_suppkey").isNull(), "unknown_supplier"), F.when(c("l_quantity") <= 0, "empty"), F.when(c("l_discount") > 0.09, "discount"), F.lit("PASS"))
    return d.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("mem1_claim_states", "SELECT conv_id AS claim_id, max(turn) AS revision, CASE arg_max(role, turn) WHEN 'assistant' THEN 'accepted' WHEN 'system' THEN 'rejected' ELSE 'proposed' END AS status FROM conversations GROUP BY 1")
def mem1(t):
    action = F.when(c("role") == "assistant", "accept").when(c("role") == "system", "reject").otherwise("comment")
    return history.claim_states(t.conversations.select(c("conv_id").alias("claim_id"), c("turn").alias("revision"), action.alias("action")))


@query("mem2_entities", "SELECT p_partkey AS doc_id, 'company' AS entity_type, upper(trim(p_brand)) AS entity_id FROM part UNION SELECT p_partkey, 'topic', 'steel' FROM part WHERE p_type LIKE '%STEEL%' OR p_type LIKE '%IRON%' UNION SELECT p_partkey, 'topic', 'brass' FROM part WHERE p_type LIKE '%BRASS%'")
def mem2(t):
    d = t.part.select(c("p_partkey").alias("doc_id"), c("p_brand").alias("symbol"), c("p_type").alias("title"))
    return history.entities(d, {"steel": ["STEEL", "IRON"], "brass": ["BRASS"]})


@query("ret8_entity_evidence", "WITH d AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders), b AS (SELECT o_custkey, o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM d JOIN lineitem ON l_orderkey = o_orderkey WHERE r <= 2) SELECT o_custkey, o_orderkey, l_linenumber FROM b WHERE k <= 3")
def ret8(t):
    from ..operators.retrieval import top

    docs = top(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], 2, F.desc("o_orderdate"), F.asc("o_orderkey"))
    blocks = docs.select("o_custkey", "o_orderkey").join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), c("l_orderkey") == c("o_orderkey"))
    return top(blocks, ["o_orderkey"], 3, F.asc("l_linenumber"), F.asc("l_partkey")).select("o_custkey", "o_orderkey", "l_linenumber")


@query("ret9_background_package", "WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01'), e AS (SELECT o_custkey, o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (l_linenumber <= 3) AS refs FROM v LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE r = 1 GROUP BY 1, 2) SELECT o_custkey, o_orderkey, coalesce(refs, '') AS refs, sha256(o_orderkey || ':' || coalesce(refs, '')) AS digest FROM e")
def ret9(t):
    cut = F.lit("1997-06-01").cast("timestamp_ntz")
    v = selection.as_of(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", cut, "o_orderkey")
    refs = t.lineitem.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("refs"))
    d = v.join(refs, c("l_orderkey") == c("o_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("refs", F.lit("")).alias("refs"))
    return d.withColumn("digest", F.sha2(F.concat_ws(":", "o_orderkey", "refs"), 256))


@query("ret10_evidence_context", "SELECT doc_id, ordinal, md5(lag(line) OVER w) AS before, md5(lead(line) OVER w) AS after FROM (SELECT doc_id, unnest(range(len(l))) AS ordinal, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)")
def ret10(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    d = selection.neighbours(lines, ["doc_id"], "ordinal", "line")
    return d.select("doc_id", c("ordinal").cast("long").alias("ordinal"), F.md5("before").alias("before"), F.md5("after").alias("after"))


@query("q1_idempotent_register", "SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND f.event_id < 100)")
def q1(t):
    return queues.registered(t.events.where("event_id < 100").select("user_id", "event_type"), t.events.select("user_id", "event_type"), ["user_id", "event_type"])


@query("q2_claim_head", "SELECT event_id AS job_id, value::INT + 1 AS attempts FROM events WHERE event_type = 'view' AND (event_id % 3 = 0 OR (event_id % 3 = 1 AND ts <= TIMESTAMP '2024-01-10')) ORDER BY event_id LIMIT 5")
def q2(t):
    jobs = t.events.where("event_type = 'view'").select(c("event_id").alias("job_id"), F.when(c("event_id") % 3 == 0, "pending").when(c("event_id") % 3 == 1, "running").otherwise("done").alias("status"), F.round("value").cast("int").alias("attempts"), c("ts").alias("lease_until"))
    return queues.claimable(jobs, F.lit("2024-01-10").cast("timestamp_ntz"), 5).select("job_id", "attempts")


@query("q3_finish", "SELECT event_id AS job_id, CASE WHEN event_id % 2 = 0 THEN 'done' WHEN event_id % 5 >= 3 THEN 'failed' ELSE 'pending' END AS status FROM events")
def q3(t):
    jobs = t.events.select(c("event_id").alias("job_id"), (c("event_id") % 2 == 0).alias("ok"), (c("event_id") % 5).alias("attempts"))
    return queues.finished(jobs, 3).select("job_id", "status")


@query("q4_stale_leases", "SELECT event_id AS job_id, CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN 'pending' ELSE 'running' END AS status FROM events WHERE event_type = 'click'")
def q4(t):
    jobs = t.events.where("event_type = 'click'").select(c("event_id").alias("job_id"), F.lit("running").alias("status"), c("ts").alias("lease_until"))
    return queues.recovered(jobs, F.lit("2024-01-10").cast("timestamp_ntz")).select("job_id", "status")


@query("q7_outbox_once", "SELECT user_id, event_type, min(event_id) AS sequence FROM events GROUP BY 1, 2")
def q7(t):
    return queues.once(t.events.select("user_id", "event_type", c("event_id").alias("sequence")), ["user_id", "event_type"], "sequence")


@query("q8_event_ids", "SELECT event_id, 'evt-' || substr(sha256(user_id || chr(0) || event_type || chr(0) || strftime(ts, '%Y-%m-%d')), 1, 32) AS id FROM events")
def q8(t):
    return t.events.select("event_id", queues.identity("evt-", 32, c("user_id"), c("event_type"), F.date_format("ts", "yyyy-MM-dd")).alias("id"))


@query("q10_blocked_refresh", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def q10(t):
    return t.conversations.where("role = 'user'").select("conv_id").distinct().join(t.conversations.where("role = 'system'").select("conv_id"), "conv_id", "left_anti")


@query("q13_scheduler_status", "SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN date_diff('second', ts, TIMESTAMP '2024-01-31') > 20 * 86400 THEN 'stale' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS panel FROM events")
def q13(t):
    age = F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", c("ts").cast("timestamp")))
    return t.events.select("event_id", F.when(c("value").isNull(), "unknown").when(age > 20 * 86400, "stale").when(c("event_type") == "error", "failed").otherwise("ok").alias("panel"))
