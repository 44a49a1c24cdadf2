"""Queries of ordered folds and of fixpoints: the budget ledger, the projection log, staleness and currency. Their oracles are recursive."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import currency, ledger, projections, queues
from .registry import query

c = F.col

_NUMBERED = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


def numbered(t):
    return t.events.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))


@query(
    "q9_budget_reservations",
    f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT event_id, user_id, k, coalesce(value, 0) <= 500 AS granted, CASE WHEN coalesce(value, 0) <= 500 THEN coalesce(value, 0) ELSE 0 END AS used FROM e WHERE k = 1
UNION ALL SELECT e.event_id, e.user_id, e.k, used + coalesce(value, 0) <= 500, CASE WHEN used + coalesce(value, 0) <= 500 THEN used + coalesce(value, 0) ELSE used END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, granted FROM r""",
)
def budget_reservations(t):
    return queues.within_cap(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 500.0).select("event_id", "granted")


_LEDGER = f"""WITH RECURSIVE {_NUMBERED},
a AS (SELECT event_id, user_id, k, CASE WHEN k % 3 > 0 THEN 'reserve' WHEN event_id % 3 = 0 THEN 'settle' WHEN event_id % 3 = 1 THEN 'fail' ELSE 'release' END AS act, greatest(1, floor(value)::BIGINT) AS est, CASE event_type WHEN 'purchase' THEN 'vision-page' WHEN 'error' THEN 'http-attempt' WHEN 'click' THEN 'chat' ELSE 'other' END AS kind,
  (event_type <> 'view')::INT AS counts, floor(value / 2)::BIGINT AS tokens, 1 + user_id % 2 AS off FROM e),
x AS (SELECT *, lag(est, off) OVER w AS t_est, lag(kind, off) OVER w AS t_kind, lag(counts, off) OVER w AS t_counts FROM a WINDOW w AS (PARTITION BY user_id ORDER BY k)),
r AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, 0::BIGINT AS input, 0::BIGINT AS requests, 0::BIGINT AS pages, FALSE AS g1, FALSE AS g2 FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, k, event_id, outcome, input + CASE outcome WHEN 'reserved' THEN est WHEN 'settled' THEN CASE WHEN tokens > 0 THEN tokens ELSE t_est END - t_est WHEN 'released' THEN -t_est ELSE 0 END,
  requests + CASE outcome WHEN 'reserved' THEN counts WHEN 'settled' THEN CASE WHEN t_kind <> 'other' THEN 1 ELSE t_counts END - t_counts WHEN 'unknown' THEN CASE WHEN t_kind = 'http-attempt' THEN 1 ELSE t_counts END - t_counts WHEN 'released' THEN -t_counts ELSE 0 END,
  pages + CASE WHEN outcome = 'reserved' AND kind = 'vision-page' THEN 1 WHEN outcome = 'released' AND t_kind = 'vision-page' THEN -1 ELSE 0 END, outcome = 'reserved', g1
  FROM (SELECT x.*, input, requests, pages, g1, CASE WHEN act = 'reserve' THEN CASE WHEN input + est > 900 THEN 'budget_exceeded_total_input_tokens' WHEN (kind = 'http-attempt' OR counts = 1) AND requests + 1 > 12 THEN 'budget_exceeded_max_requests' WHEN kind = 'vision-page' AND pages + 1 > 2 THEN 'budget_exceeded_max_pages' ELSE 'reserved' END
    WHEN CASE WHEN off = 1 THEN g1 ELSE g2 END THEN CASE act WHEN 'settle' THEN 'settled' WHEN 'fail' THEN 'unknown' ELSE 'released' END WHEN act = 'settle' THEN 'unknown_reservation' ELSE 'ignored' END AS outcome FROM r JOIN x USING (user_id) WHERE x.k = r.k + 1))
SELECT event_id, outcome, input, requests, pages FROM r WHERE k > 0"""


@query("q9_budget_ledger", _LEDGER)
def budget_ledger(t):
    e = numbered(t)
    before = lambda n: F.lag("event_id", n).over(Window.partitionBy("user_id").orderBy("k"))
    reserve = c("k") % 3 > 0
    target = F.when(reserve, c("event_id")).when(c("user_id") % 2 == 0, before(1)).otherwise(before(2))
    kind = F.when(c("event_type") == "purchase", "vision-page").when(c("event_type") == "error", "http-attempt").when(c("event_type") == "click", "chat").otherwise("other")
    events = e.select(
        c("user_id").cast("string").alias("account"),
        c("event_id").alias("sequence"),
        F.when(reserve, "reserve").when(c("event_id") % 3 == 0, "settle").when(c("event_id") % 3 == 1, "fail").otherwise("release").alias("action"),
        target.cast("string").alias("reservation_id"),
        kind.alias("kind"),
        F.floor("value").alias("est_input"),
        (c("event_type") != "view").alias("counts_request"),
        (c("event_type") == "purchase").alias("as_page"),
        F.floor(c("value") / 2).alias("input_tokens"),
    )
    out = ledger.folded(events, ledger.Caps(input=900, requests=12, pages=2))
    return out.select(c("sequence").alias("event_id"), "outcome", "input", "requests", "pages")


_LOG = f"""WITH RECURSIVE {_NUMBERED}, x AS (SELECT user_id, k, event_id, event_type IN ('error', 'signup') AS back, event_type = 'view' AS careful, 'p' || event_id % 4 AS p, 'p' || (event_id // 4) % 4 AS seen FROM e),
r AS (SELECT user_id, k, event_id, ''::VARCHAR AS outcome, NULL::VARCHAR AS was, p AS head, 1::BIGINT AS revision, MAP {{p: NULL::VARCHAR}} AS before FROM x WHERE k = 1
UNION ALL SELECT user_id, k, event_id, outcome, head, new, revision + (outcome IN ('activated', 'rolled_back'))::INT, CASE WHEN outcome IN ('activated', 'rolled_back') AND new IS NOT NULL THEN map_concat(before, MAP {{new: head}}) ELSE before END
  FROM (SELECT *, CASE outcome WHEN 'activated' THEN p WHEN 'rolled_back' THEN before[head] ELSE head END AS new FROM (SELECT x.*, head, revision, before, CASE WHEN back THEN CASE WHEN head = p THEN 'rolled_back' ELSE 'conflict' END WHEN careful AND coalesce(head, '') <> seen THEN 'conflict' WHEN p = head THEN 'unchanged' ELSE 'activated' END AS outcome FROM r JOIN x USING (user_id) WHERE x.k = r.k + 1)))
SELECT event_id, outcome, coalesce(was, '') AS old_projection_id, coalesce(head, '') AS new_projection_id, revision FROM r WHERE k > 1"""


@query("aud7_projection_log", _LOG)
def projection_log(t):
    e = numbered(t).withColumn("p", F.concat(F.lit("p"), (c("event_id") % 4).cast("string")))
    log = e.where("k = 1").select(c("user_id").alias("block_id"), "event_id", F.lit(None).cast("string").alias("old_projection_id"), c("p").alias("new_projection_id"))
    back = c("event_type").isin("error", "signup")
    seen = F.concat(F.lit("p"), (F.floor(c("event_id") / 4) % 4).cast("string"))
    wanted = e.where("k > 1").select(c("user_id").alias("block_id"), c("event_id").alias("sequence"), F.when(back, "rollback").otherwise("activate").alias("action"), c("p").alias("projection_id"), F.when(back, c("p")).when(c("event_type") == "view", seen).alias("expected"), F.lit(None).cast("long").alias("expected_revision"))
    out = projections.replayed(log, wanted)
    return out.select(c("sequence").alias("event_id"), "outcome", F.coalesce("old_projection_id", F.lit("")).alias("old_projection_id"), F.coalesce("new_projection_id", F.lit("")).alias("new_projection_id"), "revision")


_SHOWN = """WITH v AS (SELECT o_custkey AS doc_id, arg_max(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN '' ELSE 'p' || o_custkey || '-' || o_orderkey % 2 END, o_orderkey) AS p FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1),
s AS (SELECT d.doc_id, text, nullif(p, '') AS p, p LIKE '%-1' AND d.doc_id % 5 = 0 AS changed, p LIKE '%-1' AND d.doc_id % 7 = 0 AS foreign_one FROM documents d LEFT JOIN v USING (doc_id))
SELECT doc_id, CASE WHEN foreign_one THEN 'projection does not belong to this block' WHEN changed THEN 'projection source changed' ELSE '' END AS error, CASE WHEN foreign_one OR changed THEN NULL ELSE coalesce(p, '') END AS projection_id, CASE WHEN foreign_one OR changed THEN NULL WHEN p IS NULL THEN md5(text) ELSE md5(p || ':' || text) END AS shown FROM s"""


@query("aud8_projection_as_of", _SHOWN)
def projection_as_of(t):
    name = lambda k: F.concat(F.lit("p"), c("o_custkey").cast("string"), F.lit("-"), k.cast("string"))
    raw = (c("o_orderstatus") == "F") & (c("o_orderkey") % 3 == 0)
    events = t.orders.select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("block_id"), F.when(~raw, name(c("o_orderkey") % 2)).alias("projection_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    blocks = t.documents.select(c("doc_id").alias("block_id"), "text")
    made = blocks.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("projection_id", F.format_string("p%d-%d", "block_id", "n"))
    odd = c("n") == 1
    stored = made.select("projection_id", F.when(odd & (c("block_id") % 7 == 0), -1).otherwise(c("block_id")).alias("block_id"), F.when(odd & (c("block_id") % 5 == 0), "stale").otherwise(F.sha2("text", 256)).alias("text_sha256"), F.concat_ws(":", "projection_id", "text").alias("projected_text"))
    heads = projections.visible_projection(events, F.lit("1996-06-30T00:00:00"))
    out = projections.projected_blocks(blocks, stored, heads)
    return out.select(c("block_id").alias("doc_id"), F.coalesce("error", F.lit("")).alias("error"), F.when(c("error").isNull(), F.coalesce("projection_id", F.lit(""))).alias("projection_id"), F.md5("text").alias("shown"))


@query(
    "jn19_stale_chain",
    """WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_orderstatus, o_custkey, lag(o_orderkey) OVER w AS previous, lag(o_orderdate) OVER w AS before_at, o_orderdate, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT id, previous AS cites FROM o WHERE o_orderdate - before_at <= INTERVAL 300 DAY UNION SELECT id, l FROM o WHERE id = f AND o_custkey % 10 = 0),
r AS (SELECT edges.id, 1 AS hops FROM edges JOIN o ON o.id = cites WHERE o_orderstatus = 'P' UNION SELECT edges.id, hops + 1 FROM r JOIN edges ON cites = r.id WHERE hops < 60) SELECT id, min(hops) AS hops, CASE WHEN min(hops) = 1 THEN 'chart_content_changed' ELSE 'chart_dependency_changed' END AS reason FROM r GROUP BY 1""",
)
def stale_chain(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = t.orders.select(c("o_orderkey").alias("id"), "o_custkey", "o_orderdate", F.lag("o_orderkey").over(w).alias("previous"), F.lag("o_orderdate").over(w).alias("at"), F.first("o_orderkey").over(whole).alias("f"), F.last("o_orderkey").over(whole).alias("l"))
    near = o.where(F.unix_micros(c("o_orderdate").cast("timestamp")) - F.unix_micros(c("at").cast("timestamp")) <= 300 * 86_400_000_000).select("id", c("previous").alias("cites"))
    cycle = o.where("id = f AND o_custkey % 10 = 0").select("id", c("l").alias("cites"))
    return currency.stale(near.unionByName(cycle), t.orders.where("o_orderstatus = 'P'").select(c("o_orderkey").alias("id")))


@query(
    "aud9_current_evidence",
    """WITH bad AS (SELECT l_orderkey AS id FROM lineitem WHERE (l_partkey % 7 = 0 AND l_linenumber = 3) OR (l_partkey % 7 > 0 AND l_partkey % 11 = 0)
UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0 AND o_custkey % 500 IN (SELECT p_partkey % 500 FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0)
UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 0 AND o_custkey % 40 || '/' || o_custkey % 9 IN (SELECT p_size || '/' || p_partkey % 9 FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0)) SELECT o_orderkey AS object, bad.id IS NULL AS current FROM orders LEFT JOIN bad ON bad.id = o_orderkey""",
)
def current_evidence(t):
    line = F.struct(F.concat(F.lit("b"), "l_partkey").alias("block_id"), F.when((c("l_partkey") % 7 == 0) & (c("l_linenumber") != 3), F.concat(F.lit("h"), "l_partkey")).alias("projection_id"))
    cited = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(line).alias("blocks"))  # the lines of one order
    text = lambda x: x.cast("string")
    coarse = F.array_compact(F.array(
        F.when(c("o_orderkey") % 13 == 0, F.struct(F.concat(F.lit("e"), text(c("o_custkey") % 500)).alias("extraction_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("version_id"))),
        F.when(c("o_orderkey") % 17 == 0, F.struct(F.lit(None).cast("string").alias("extraction_id"), F.lit("s").alias("source"), text(c("o_custkey") % 40).alias("doc_id"), text(c("o_custkey") % 9).alias("version_id"))),
    ))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(c("blocks").alias("evidence")).alias("claim"), coarse.alias("sources"))).alias("parts")))
    objects = t.orders.join(cited, c("l_orderkey") == c("o_orderkey"), "left").select(c("o_orderkey").alias("object"), nested.alias("evidence"))
    k = c("p_partkey")
    blocks = t.part.select(F.concat(F.lit("b"), k).alias("block_id"), F.concat(F.lit("e"), text(k % 500)).alias("extraction_id"), F.lit("s").alias("source"), text(c("p_size")).alias("doc_id"), text(k % 9).alias("version_id"), (k % 11 == 0).alias("risky"))
    heads = t.part.where(k % 7 == 0).select(F.concat(F.lit("b"), k).alias("block_id"), F.concat(F.lit("h"), k).alias("projection_id"))
    return currency.current_evidence(objects, blocks, heads, hold=True).select(c("object").cast("long").alias("object"), "current")
