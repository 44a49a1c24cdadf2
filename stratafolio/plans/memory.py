"""Queries of claims, corrections, events and background packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory, storage
from .registry import query

c = F.col
CUT = "TIMESTAMP '1996-06-30 00:00:00'"

_ACTION = "CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'revise' WHEN 'purchase' THEN 'supersede' WHEN 'error' THEN 'challenge' ELSE 'praise' END"


@query(
    "mem1_revisions",
    f"""WITH e AS (SELECT event_id, user_id, {_ACTION} AS action FROM events), v AS (SELECT * FROM e WHERE action <> 'praise' AND user_id % 10 > 0), first AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 > 0),
    a AS (SELECT user_id, NULL::BIGINT AS event_id, NULL AS action, 'first ' || user_id AS s FROM first UNION ALL SELECT user_id, event_id, action, CASE WHEN action IN ('revise', 'supersede') AND event_id % 3 > 0 THEN 'said ' || event_id END FROM v),
    r AS (SELECT *, row_number() OVER w AS revision, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS statement FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id NULLS FIRST))
    SELECT user_id AS claim_id, revision, statement, CASE action WHEN 'accept' THEN 'accepted' WHEN 'revise' THEN 'proposed' WHEN 'supersede' THEN 'superseded' WHEN 'challenge' THEN 'challenged' ELSE 'proposed' END AS status, CASE WHEN action IN ('revise', 'supersede') THEN revision - 1 END AS supersedes, '' AS error FROM r
    UNION ALL SELECT user_id, NULL, NULL, NULL, NULL, CASE WHEN action = 'praise' THEN 'unknown action' ELSE 'claim not found' END FROM e WHERE action = 'praise' OR user_id % 10 = 0""",
)
def revisions(t):
    action = F.when(c("event_type") == "click", "accept").when(c("event_type") == "view", "revise").when(c("event_type") == "purchase", "supersede").when(c("event_type") == "error", "challenge").otherwise("praise")
    claims = t.events.where("user_id % 10 > 0").select(c("user_id").alias("claim_id")).distinct().select("claim_id", F.concat(F.lit("first "), "claim_id").alias("statement"), F.lit("[]").alias("evidence"), F.lit("[]").alias("counterevidence"))
    none = F.lit(None).cast("string")
    reviews = t.events.select(c("user_id").alias("claim_id"), c("event_id").alias("sequence"), action.alias("action"), F.lit("r").alias("reviewer"), F.when(c("event_id") % 3 > 0, F.concat(F.lit("said "), "event_id")).otherwise("").alias("new_statement"), none.alias("new_evidence"), none.alias("new_counterevidence"))
    out = memory.reviewed(claims, reviews)
    return out.select("claim_id", c("revision").cast("long").alias("revision"), "statement", "status", c("supersedes_revision").cast("long").alias("supersedes"), F.coalesce("error", F.lit("")).alias("error"))


@query("mem1_proposals", "SELECT DISTINCT 'rev-' || substr(sha256('claim ' || l_suppkey || chr(0) || 'new_source_version' || chr(0) || 'v' || p_size), 1, 24) AS proposal_id, 'claim ' || l_suppkey AS claim_id, 'v' || p_size AS version_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25 AND (l_suppkey + p_partkey) % 4 > 0 AND NOT (l_suppkey % 5 = 0 AND p_size = 30)")
def proposals(t):
    parts = t.part.select("p_partkey", "p_size")
    cited = t.lineitem.select("l_suppkey", "l_partkey").where((c("l_suppkey") + c("l_partkey")) % 4 > 0).distinct()
    ref = F.struct(F.lit("s").alias("source"), c("l_partkey").cast("string").alias("doc_id"))
    claims = cited.groupBy("l_suppkey").agg(F.to_json(F.struct(F.array(F.collect_list(ref)).alias("inner"))).alias("evidence")).select(F.concat(F.lit("claim "), "l_suppkey").alias("claim_id"), F.lit(1).alias("revision"), "evidence")  # the parts of one supplier
    versions = parts.where("p_size > 25").select(F.lit("s").alias("source"), c("p_partkey").alias("doc_id"), F.concat(F.lit("v"), "p_size").alias("version_id"))
    there = t.supplier.where("s_suppkey % 5 = 0").select(memory.identity("rev-", 24, F.concat(F.lit("claim "), "s_suppkey"), F.lit(memory.NEW_VERSION), F.lit("v30")).alias("proposal_id"))
    return memory.proposals(versions, claims, there).select("proposal_id", "claim_id", "version_id")


@query("aud1_repaired_times", "SELECT l_returnflag AS source, l_orderkey AS doc_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS version_id, CASE WHEN bad THEN NULL ELSE dated END AS dated, CASE WHEN bad THEN 'unknown' ELSE basis END AS basis FROM (SELECT *, basis IN ('published_at', 'filing_date') AND (l_linenumber = 2 OR dated < l_shipdate) AND l_partkey % 6 > 0 AS bad FROM (SELECT *, o_orderdate AS dated, CASE l_returnflag WHEN 'R' THEN 'published_at' WHEN 'A' THEN 'filing_date' ELSE 'adapter' END AS basis FROM lineitem JOIN orders ON o_orderkey = l_orderkey))")
def repaired(t):
    d = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey"))
    basis = F.when(c("l_returnflag") == "R", "published_at").when(c("l_returnflag") == "A", "filing_date").otherwise("adapter")
    versions = d.select(c("l_returnflag").alias("source"), c("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("version_id"), F.when(c("l_linenumber") != 2, c("l_shipdate")).alias("first_observed_at"), c("o_orderdate").alias("public_available_at"), basis.alias("public_time_basis"), "l_partkey")
    done = versions.where("l_partkey % 6 = 0").select("source", "doc_id", "version_id", c("public_available_at").alias("old_available_at"))
    fixed, _ = memory.repaired_public_times(versions, done)
    return fixed.select("source", "doc_id", "version_id", c("public_available_at").alias("dated"), c("public_time_basis").alias("basis"))


@query("q8_monotone_events", "WITH l AS (SELECT user_id || event_type || event_id % 10 AS id, min(event_id) AS s FROM events WHERE event_id < 300 GROUP BY 1), n AS (SELECT user_id || event_type || event_id % 10 AS id, min(event_id) AS first FROM events WHERE event_id >= 300 GROUP BY 1) SELECT id AS event_id, row_number() OVER (ORDER BY first, id) + (SELECT max(s) FROM l) AS sequence FROM n WHERE id NOT IN (SELECT id FROM l)")
def monotone(t):
    name = F.concat("user_id", "event_type", (c("event_id") % 10).cast("string"))
    log = t.events.where("event_id < 300").groupBy(name.alias("event_id")).agg(F.min("event_id").alias("sequence"))
    new = t.events.where("event_id >= 300").select(name.alias("id"), c("event_id").alias("at")).withColumnRenamed("id", "event_id")
    return memory.emitted(log, new, ["at"]).select("event_id", "sequence")


@query("q10_blocked_events", "WITH s AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'blocked' ELSE 'done' END AS status FROM conversations), b AS (SELECT conv_id, max(turn) AS revision FROM s WHERE status = 'blocked' GROUP BY 1) SELECT conv_id AS entity_id, revision, 'refresh:topic:' || conv_id || ':' || revision AS event_key FROM b WHERE conv_id % 4 > 0 OR revision > 3")
def blocked(t):
    s = t.conversations.select(F.lit("topic").alias("entity_type"), c("conv_id").alias("entity_id"), c("turn").alias("revision"), F.when((c("conv_id") + c("turn")) % 3 == 0, "blocked").otherwise("done").alias("status"))
    there = s.where("entity_id % 4 = 0 AND revision <= 3").select(F.concat_ws(":", F.lit("refresh"), "entity_type", "entity_id", "revision").alias("event_key"))
    return memory.blocked_refreshes(s, there).select("entity_id", "revision", "event_key")


_VERSIONS = "v AS (SELECT o_custkey AS entity, l_orderkey AS doc_id, l_linenumber || '-' || l_partkey AS version_id, min(l_shipdate) AS seen, CASE WHEN l_partkey % 3 > 0 THEN min(l_shipdate) + INTERVAL 30 DAY END AS public, CASE WHEN l_orderkey % 6 > 0 THEN strftime(min(o_orderdate), '%Y') END AS period FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber, l_partkey)"


def versions_of(t):
    d = storage.dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), "l_orderkey").join(t.orders, c("o_orderkey") == c("l_orderkey"))
    one = d.groupBy("o_custkey", "l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_shipdate").alias("seen"), F.min("o_orderdate").alias("dated"))
    return one.select(c("o_custkey").alias("entity"), F.lit("s").alias("source"), c("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("version_id"), c("seen").alias("first_observed_at"), F.when(c("l_partkey") % 3 > 0, c("seen") + F.expr("INTERVAL 30 DAYS")).alias("public_available_at"), c("seen").alias("synced_at"), (c("l_linenumber") == 1).alias("is_current"), F.when(c("l_orderkey") % 6 > 0, F.date_format("dated", "yyyy")).alias("report_period"))


@query(
    "ret9_package_sources",
    f"""WITH {_VERSIONS}, p AS (SELECT entity, doc_id, any_value(period) AS period, arg_max(version_id, struct_pack(a := public, b := seen, c := version_id)) AS version_id FROM v WHERE public <= {CUT} GROUP BY 1, 2),
    x AS (SELECT DISTINCT doc_id, version_id, seen + INTERVAL 10 DAY <= {CUT} AS one, seen + INTERVAL 100 DAY <= {CUT} AS two FROM v), r AS (SELECT p.*, row_number() OVER (PARTITION BY entity ORDER BY period DESC NULLS FIRST, doc_id) AS rank FROM p)
    SELECT entity, rank, r.doc_id, r.version_id, coalesce(max(CASE WHEN two THEN r.doc_id || '/' || r.version_id || '/2' WHEN one THEN r.doc_id || '/' || r.version_id || '/1' END), '') AS extraction_id, CASE WHEN bool_or(one) THEN CASE WHEN r.doc_id % 9 = 0 THEN '0,2' ELSE '0,1,2' END ELSE '' END AS refs FROM r LEFT JOIN x USING (doc_id, version_id) WHERE rank <= 4 GROUP BY entity, rank, r.doc_id, r.version_id""",
)
def package_sources(t):
    v = versions_of(t)
    docs = v.groupBy("entity", "source", "doc_id").agg(F.max("report_period").alias("report_period"))
    made = v.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    name = F.concat_ws("/", "doc_id", "version_id", "n")
    extractions = made.select("source", "doc_id", "version_id", name.alias("extraction_id"), F.when(c("n") == 1, c("first_observed_at") + F.expr("INTERVAL 10 DAYS")).otherwise(c("first_observed_at") + F.expr("INTERVAL 100 DAYS")).alias("created_at"), c("n").alias("ingest_seq"))
    four = extractions.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(3))))
    blocks = four.select("extraction_id", "ordinal", F.concat_ws("#", "extraction_id", "ordinal").alias("block_id"), F.when((c("ordinal") == 1) & (c("doc_id") % 9 == 0), "\x01\x02\x03\x04\x05").otherwise("a fine text").alias("text"))
    out = memory.background_sources(docs, v, extractions, blocks, F.lit("1996-06-30").cast("timestamp_ntz"), "public", 4)
    return out.select("entity", "rank", "doc_id", "version_id", F.coalesce("extraction_id", F.lit("")).alias("extraction_id"), F.array_join(F.transform("refs", lambda r: r["ordinal"].cast("string")), ",").alias("refs"))


@query(
    "ret9_package_claims",
    f"""WITH {_VERSIONS}, o AS (SELECT o_custkey AS entity, o_orderkey AS claim_id, CASE WHEN o_orderdate + INTERVAL 200 DAY <= {CUT} THEN 2 ELSE 1 END AS revision FROM orders WHERE o_orderdate <= {CUT} AND NOT (o_orderkey % 11 = 0 AND o_orderdate + INTERVAL 200 DAY <= {CUT})),
    e AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey FROM lineitem), bad AS (SELECT claim_id FROM e WHERE l_partkey % 13 = 0), hid AS (SELECT doc_id AS claim_id FROM v GROUP BY 1 HAVING NOT bool_and(coalesce(public <= {CUT}, FALSE)))
    SELECT entity, claim_id::VARCHAR AS claim_id, revision, 'says ' || revision AS statement FROM o WHERE claim_id NOT IN (SELECT claim_id FROM bad) AND claim_id NOT IN (SELECT claim_id FROM hid) AND claim_id IN (SELECT doc_id FROM v)""",
)
def package_claims(t):
    v = versions_of(t)
    ref = F.struct("source", c("doc_id").cast("string").alias("doc_id"), "version_id", F.concat(F.lit("b"), F.split("version_id", "-")[1]).alias("block_id"))
    cited = v.groupBy("doc_id").agg(F.to_json(F.collect_list(ref)).alias("evidence"))  # the versions of one document
    claims = t.orders.select(c("o_orderkey").alias("claim_id"), c("o_custkey").alias("entity"), c("o_orderdate").alias("created_at"))
    both = claims.join(cited, c("doc_id") == c("claim_id"), "left").withColumn("revision", F.explode(F.array(F.lit(1), F.lit(2))))
    at = F.when(c("revision") == 1, c("created_at")).otherwise(c("created_at") + F.expr("INTERVAL 200 DAYS"))
    revisions = both.select("claim_id", "revision", F.concat(F.lit("says "), "revision").alias("statement"), F.lit("proposed").alias("status"), "evidence", F.lit(None).cast("string").alias("counterevidence"), at.alias("created_at"))
    stale = claims.where("claim_id % 11 = 0").select("claim_id", F.lit(2).alias("revision"))
    k = c("p_partkey")
    blocks = t.part.select(F.concat(F.lit("b"), k).alias("block_id"), F.lit("e").alias("extraction_id"), F.lit("s").alias("source"), k.cast("string").alias("doc_id"), F.lit("v").alias("version_id"), F.lit(False).alias("risky"))
    heads = t.part.where(k % 13 == 0).select(F.concat(F.lit("b"), k).alias("block_id"), F.lit("p").alias("projection_id"))
    out = memory.background_claims(claims, revisions, v, blocks, heads, stale, F.lit("1996-06-30").cast("timestamp_ntz"), "public")
    return out.select("entity", "claim_id", "revision", "statement")
