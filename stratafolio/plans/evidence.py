"""Queries of evidence for entities and around blocks, of prompts, manifests and the analysis index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content, prompts
from ..operators import evidence, index
from ..sources import publish
from .registry import query

c = F.col


def text(x):
    return (c(x) if isinstance(x, str) else x).cast("string")


@query(
    "ret8_entity_evidence_items",
    """WITH d AS (SELECT o_custkey AS entity, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS d FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT * FROM d WHERE d <= 3 AND doc_id % 10 > 0),
    l AS (SELECT l_orderkey AS doc_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_linenumber * 1000000 + l_partkey AS o, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 2),
    b AS (SELECT entity, 0 AS part, d AS a, o AS b, 'document_block' AS kind, doc_id::VARCHAR AS doc_id, id AS what FROM n JOIN l USING (doc_id) WHERE l_partkey % 9 > 0),
    r AS (SELECT entity, 1 AS part, row_number() OVER (PARTITION BY entity ORDER BY doc_id % 7 DESC, 'run' || doc_id) AS a, 0 AS b, 'analysis' AS kind, doc_id::VARCHAR AS doc_id, 'run' || doc_id AS what FROM n WHERE doc_id % 4 > 0 AND doc_id % 6 > 0 QUALIFY a <= 2),
    k AS (SELECT o_custkey AS entity, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS a FROM orders QUALIFY a <= 4), m AS (SELECT entity, 2 AS part, a, 0 AS b, 'claim' AS kind, NULL AS doc_id, o_orderkey::VARCHAR AS what FROM k WHERE o_orderkey % 5 > 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 13 = 0))
    SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY part, a, b) AS n, kind, coalesce(doc_id, '') AS doc_id, what FROM (SELECT * FROM b UNION ALL SELECT * FROM r UNION ALL SELECT * FROM m)""",
)
def entity_evidence(t):
    o, k = t.orders.where("o_orderstatus <> 'P'"), c("o_orderkey")
    source = F.lit("s").alias("source")
    documents = o.select(c("o_custkey").alias("entity"), source, k.alias("doc_id"))
    versions = o.select(source, k.alias("doc_id"), F.lit("v1").alias("version_id"), c("o_orderdate").alias("synced_at"), F.lit(True).alias("is_current"))
    extractions = o.select(source, k.alias("doc_id"), F.lit("v1").alias("version_id"), k.alias("extraction_id"), F.lit(1).alias("ingest_seq"))
    blocks = t.lineitem.select(c("l_orderkey").alias("extraction_id"), "l_linenumber", "l_partkey", "l_suppkey", (c("l_linenumber") * 1_000_000 + c("l_partkey")).alias("ordinal"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("block_id"), F.lit(1).alias("page"), F.when(c("l_partkey") % 9 == 0, "\x01\x02\x03\x04\x05").otherwise("a fine text").alias("text"))
    analyses = o.select(F.concat(F.lit("run"), k).alias("run_id"), source, k.alias("doc_id"), F.lit("v1").alias("version_id"), F.lit("m").alias("model_identity"), F.when(k % 4 > 0, "done").otherwise("failed").alias("status"), F.lit("a draft").alias("draft"), (k % 7).alias("finished_at"))
    cites = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("b"), "l_partkey").alias("block_id")))).alias("evidence"))  # the lines of one order
    claims = t.orders.join(cites, c("l_orderkey") == k, "left").select(c("o_custkey").alias("entity"), k.alias("claim_id"), F.lit(2).alias("revision"), F.lit("says so").alias("statement"), F.lit("accepted").alias("status"), "evidence", F.lit(None).cast("string").alias("counterevidence"), c("o_orderdate").alias("updated_at"))
    stale = o.where(k % 6 == 0).select(F.lit("analysis").alias("kind"), F.concat(F.lit("run"), k).alias("object_id")).unionByName(t.orders.where(k % 5 == 0).select(F.lit("claim").alias("kind"), F.concat(k, F.lit("@2")).alias("object_id")))
    p = F.concat(F.lit("b"), "p_partkey").alias("block_id")
    cited = t.part.select(p, F.lit("e").alias("extraction_id"), source, F.lit("d").alias("doc_id"), F.lit("v").alias("version_id"), F.lit(False).alias("risky"))
    heads = t.part.where("p_partkey % 13 = 0").select(p, F.lit("p").alias("projection_id"))
    out = evidence.entity_evidence(documents, versions, extractions, blocks, analyses, claims, stale, cited, heads, allowed=o.where(k % 10 > 0).select(source, k.alias("doc_id")), docs=3, blocks_a_doc=2, most_analyses=2, most_claims=4, block_order=("l_linenumber", "l_partkey", "l_suppkey"))
    return out.select("entity", "n", "kind", F.coalesce(text("doc_id"), F.lit("")).alias("doc_id"), F.coalesce("block_id", "run_id", "claim_id").alias("what"))


@query(
    "ret10_evidence_view",
    """WITH l AS (SELECT doc_id, o, line, printf('%d-b%04d', doc_id, o) AS id FROM (SELECT doc_id, unnest(range(len(x))) AS o, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE length(trim(line)) > 0),
    s AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'seen ' || substr(line, 1, 30) ELSE line END AS shown, doc_id % 4 = 0 AND o % 3 = 0 AS explicit, doc_id % 4 > 0 AND o % 3 = 0 AND doc_id % 5 = 0 AS wrong FROM l), g AS (SELECT *, lag(id) OVER w AS bi, lead(id) OVER w AS ai, lag(line) OVER w AS bl, lead(line) OVER w AS al, lag(shown) OVER w AS bs, lead(shown) OVER w AS sh FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY o))
    SELECT id AS block_id, CASE WHEN explicit OR wrong THEN 'explicit' ELSE 'current' END AS selection, CASE WHEN wrong THEN 'projection does not belong to this block' ELSE '' END AS error, coalesce(md5(CASE WHEN wrong THEN NULL WHEN explicit THEN shown ELSE line END), '') AS text, coalesce(md5(CASE WHEN wrong THEN NULL ELSE shown END), '') AS shown,
    coalesce(md5(CASE WHEN explicit OR wrong THEN bs ELSE bl END), '') AS before, coalesce(md5(CASE WHEN explicit OR wrong THEN sh ELSE al END), '') AS after FROM g""",
)
def evidence_view(t):
    blocks = index.line_blocks(t.documents)
    lines = blocks.select("block_id", c("doc_id").alias("extraction_id"), "ordinal", "text", F.lit(None).cast("array<array<string>>").alias("table"), F.lit(0).alias("header_rows"))
    name = F.concat(F.lit("p"), "block_id")
    stored = blocks.where("doc_id % 4 = 0").select(name.alias("projection_id"), "block_id", F.sha2("text", 256).alias("text_sha256"), F.concat(F.lit("seen "), F.substring("text", 1, 30)).alias("projected_text"))
    k = c("doc_id")
    asked = F.when((c("ordinal") % 3 == 0) & (k % 4 == 0), name).when((c("ordinal") % 3 == 0) & (k % 5 == 0), "nowhere")
    d = evidence.evidence_context(blocks.select("block_id", asked.alias("projection_id")), lines, stored, stored.select("block_id", "projection_id"))
    return d.select("block_id", "selection", F.coalesce("error", F.lit("")).alias("error"), *(F.coalesce(F.md5(x), F.lit("")).alias(x) for x in ("text", "shown", "before", "after")))


@query(
    "str21_summary_prompt",
    """WITH e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, role, text FROM conversations), l AS (SELECT conv_id, n, CASE role WHEN 'user' THEN '[' || n || '] (claim c' || turn || ' rev1, accepted) ' || text || chr(10) || '    evidence: s/d1/v1' || chr(10) || '    evidence: s/d2/v1' || chr(10) || '    evidence: s/d3/v1' || chr(10) || '    counter: {"n":1}'
    WHEN 'assistant' THEN '[' || n || '] (report s/' || conv_id || '/v1 extraction e block b' || turn || ' page ?) ' || text ELSE '[' || n || '] (analysis s/' || conv_id || '/v1 run r' || turn || ' model m) ' || text END AS line FROM e)
    SELECT conv_id, md5('Summarise.' || chr(10) || chr(10) || 'Entity: topic ' || conv_id || chr(10) || 'Update reason: {}' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS prompt FROM l GROUP BY 1""",
)
def summary_prompt(t):
    user, said = c("role") == "user", c("role") == "assistant"
    none = F.lit(None).cast("string")
    refs = F.array(*(F.struct(F.lit("s").alias("source"), F.lit(d).alias("doc_id"), F.lit("v1").alias("version_id")) for d in ("d1", "d2", "d3", "d4")))
    item = F.struct("turn", F.struct(F.when(user, "claim").when(said, "document_block").otherwise("analysis").alias("kind"), F.concat(F.lit("c"), "turn").alias("claim_id"), F.lit(1).alias("revision"), F.lit("accepted").alias("status"), F.lit("s").alias("source"), text("conv_id").alias("doc_id"), F.lit("v1").alias("version_id"), F.lit("e").alias("extraction_id"), F.concat(F.lit("b"), "turn").alias("block_id"), none.alias("page"), F.concat(F.lit("r"), "turn").alias("run_id"), F.lit("m").alias("model_identity"), "text", refs.alias("refs"), F.array(F.lit('{"n":1}')).alias("counters")).alias("e"))
    gathered = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # the turns of one conversation
    prompt = prompts.summary_prompt(F.lit("Summarise."), F.concat(F.lit("topic "), "conv_id"), F.lit("{}"), F.transform("items", lambda x: x["e"]))
    return gathered.select("conv_id", F.md5(prompt).alias("prompt"))


_ERRORS = ["", "projection requires confirmed reviewer and policy", "unknown block", "source identity mismatch: version_id", "stale block text", "physical page mismatch", "reviewed text mapping method required", "unknown coordinate system", "regions required", "duplicate or missing region id", "invalid region kind", "invalid bbox", "bbox outside page", "chart image required", "asset must use content-addressed PNG name", "caption must be an exact source-text excerpt"]


@query("str20_manifest_errors", "SELECT doc_id, CASE WHEN length(text) = 0 AND doc_id % 16 IN (0) THEN '" + _ERRORS[15] + "' ELSE [" + ", ".join(f"'{e}'" for e in _ERRORS) + "][(doc_id % 16)::INT + 1] END AS error FROM documents WHERE length(text) > 0 OR doc_id % 16 <> 0")
def manifest_errors(t):
    """A manifest for each document, which breaks the rule of its number."""
    k = c("doc_id") % 16
    d = t.documents.where((F.length("text") > 0) | (k != 0))
    when = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    lit = F.lit
    sha = F.concat(F.md5("text"), F.md5("text"))
    region = lambda name, kind, box: F.struct(name.alias("id"), kind.alias("kind"), box.alias("bbox"), F.struct(when(13, lit("no"), sha).alias("sha256"), when(14, lit("x.png"), F.concat(sha, lit(".png"))).alias("name")).alias("asset"), when(15, lit("\u0001never\u0001"), F.substring("text", 1, 5)).alias("caption"))
    box = when(11, F.array(lit(0.1), lit(0.2)), when(12, F.array(lit(0.1), lit(0.2), lit(1.5), lit(0.6)), F.array(lit(0.1), lit(0.2), lit(0.9), lit(0.6))))
    regions = F.array(region(lit("one"), lit("chart"), box), region(when(9, lit("one"), lit("two")), when(10, lit("doodle"), lit("narrative")), F.array(lit(0.0), lit(0.0), lit(1.0), lit(0.2))))
    own = {"source": c("source"), "doc_id": text("doc_id"), "version_id": lit("v1"), "extraction_id": lit("e1"), "snapshot_sha256": lit("x")}
    identity = [when(3, lit("v2"), v).alias(n) if n == "version_id" else v.alias(n) for n, v in own.items()]
    manifest = F.struct(lit(content.POLICY).alias("policy"), when(1, lit("proposed"), lit("confirmed")).alias("review_state"), lit("r").alias("reviewer"), *identity, when(4, lit("old"), F.sha2("text", 256)).alias("text_sha256"), when(5, lit(2), lit(1)).alias("page"), when(6, lit("guess"), lit(content.MAPPINGS[0])).alias("mapping_method"), when(7, lit("pixels"), lit(content.COORDINATES)).alias("coordinate_system"), when(8, F.slice(regions, 1, 0), regions).alias("regions"))
    block = F.when(k != 2, F.struct(*(v.alias(n) for n, v in own.items()), lit(1).alias("page"), c("text").alias("text")))
    return d.select("doc_id", F.coalesce(content.manifest_error(manifest, block), lit("")).alias("error"))


@query(
    "snk7_analysis_index",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS s, o_orderkey % 3 = 0 AS old, o_orderkey % 5 > 0 AS there, '- ' AS d FROM orders), x AS (SELECT *, CASE WHEN old THEN 'stale' WHEN s < 2 AND there THEN ['done', 'partial'][s::INT + 1] WHEN s < 2 THEN 'unpublished' ELSE ['blocked', 'failed', 'running', 'pending', 'pending'][s::INT - 1] END AS state FROM o)
    SELECT o_orderkey AS task_key, state, CASE WHEN state = 'done' THEN '- [No. ' || o_orderkey || '](a' || o_orderkey || '.md) — m (p / t)' WHEN state = 'partial' THEN '- [No. ' || o_orderkey || '](a' || o_orderkey || '.md) — partial' ELSE '- No. ' || o_orderkey || ' — ' || CASE WHEN state = 'failed' THEN 'failed (broke)' ELSE state END || '; [original](u/' || o_orderkey || ')' END AS line FROM x""",
)
def analysis_index(t):
    k = c("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("done", "partial", "blocked", "failed", "running", "pending", "pending"))), (k % 7).cast("int"))
    tasks = t.orders.select(k.alias("task_key"), k.alias("doc_id"), F.concat(F.lit("No. "), k).alias("title"), F.concat(F.lit("u/"), k).alias("url"), status.alias("status"), F.lit("broke").alias("error"), k.alias("run_id"), F.concat(F.lit("a"), k, F.lit(".md")).alias("publish_path"), F.lit("m").alias("model_identity"), F.lit("p").alias("prompt_version"), F.lit("t").alias("template_version"))
    written = tasks.where("task_key % 5 > 0").select(c("publish_path").alias("name"))
    return publish.analysis_index(tasks, written, tasks.where("task_key % 3 = 0").select("run_id"))


_GOVERNED = """CASE WHEN k % 2 = 0 AND k % 14 = 0 THEN 'conflict-human-edit' WHEN k % 11 = 0 OR k % 5 = 0 OR k % 13 = 0 OR k = 1 OR k % 7 = 3 THEN 'keep' WHEN k % 2 > 0 THEN 'unknown-owner' WHEN k % 6 > 0 THEN 'archive-candidate' ELSE 'keep' END"""


def governed(t):
    """Customers as the files of a folder."""
    from ..operators import governance

    k = c("c_custkey")
    name = F.concat(F.lit("f"), k).alias("name")
    files = t.customer.select(name, k.alias("k"), F.md5("c_name").alias("sha256"))
    manifest = files.where("k % 2 = 0").select("name", F.when(c("k") % 6 == 0, "someone").when(c("k") % 4 == 0, "reading-publisher").otherwise("existing-text-export").alias("owner"), F.when(c("k") % 14 == 0, "edited").otherwise(c("sha256")).alias("last_hash"))
    of = lambda condition: files.where(condition).select("name")
    return governance.file_dispositions(files, manifest, of("k % 5 = 0"), of("k % 13 = 0"), of("k % 11 = 0"), of("k % 7 = 3"), ("f1",))


@query("aud5_file_governance", f"SELECT 'f' || k AS name, {_GOVERNED} AS disposition FROM (SELECT c_custkey AS k FROM customer)")
def file_governance(t):
    return governed(t).select("name", "disposition")


@query("agg20_governance_counts", f"SELECT {_GOVERNED} AS disposition, count(*) AS n FROM (SELECT c_custkey AS k FROM customer) GROUP BY 1")
def governance_counts(t):
    from ..operators import governance

    return governance.disposition_counts(governed(t))


@query("aud6_review_queue", r"WITH l AS (SELECT doc_id, o, line, printf('%d-b%04d', doc_id, o) AS id FROM (SELECT doc_id, unnest(range(len(x))) AS o, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE length(trim(line)) > 0) SELECT id AS block_id, CASE WHEN doc_id % 3 = 0 AND NOT regexp_matches(line, '(?i)list of (figures|tables)') THEN 'pending' ELSE 'not_flagged' END AS status FROM l WHERE doc_id % 10 > 0 ORDER BY doc_id, o LIMIT 3000")
def review_queue(t):
    """The lines of every third document are followed by a captioned column of numbers."""
    from ..operators import governance

    lines = index.line_blocks(t.documents)
    column = "\nFigure 2 Axis\n" + "\n".join(map(str, range(30)))
    blocks = lines.select("block_id", (c("doc_id") * 1_000_000 + c("ordinal")).alias("seq"), F.when(c("doc_id") % 3 == 0, F.concat("text", F.lit(column))).otherwise(c("text")).alias("text"))
    return governance.review_queue(blocks, lines.where("doc_id % 10 = 0"), 3000).select("block_id", "status")


@query("jn22_region_reasons")
def region_reasons(t):
    from ..operators.regions import compared
    from .extraction import _readings

    kind = F.get(F.array(*map(F.lit, ("chart", "table", "narrative"))), ((c("region_id") + F.when((c("reading") == 2) & (c("page") % 5 == 0), 1).otherwise(0)) % 3).cast("int"))
    out = compared(_readings(t).withColumn("kind", kind), "page")
    return out.select("page", F.array_join("reasons", ",").alias("reasons"), "charts_agree", "chart_pairs")
