"""Queries of runs over the stores and of publishers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import runs
from ..sources import publish
from .registry import query

c = F.col
TEXT = "string"

_CATALOG = """l AS (SELECT DISTINCT l_returnflag AS source, l_orderkey AS doc_id, l_linenumber || '-' || l_partkey AS version_id, l_linenumber AS n, CASE WHEN l_partkey % 4 > 0 THEN 'ready' ELSE 'missing' END AS state FROM lineitem),
docs AS (SELECT DISTINCT source, doc_id, doc_id % 3 = 0 AS fresh FROM l), vers AS (SELECT source, doc_id, version_id, state, doc_id % 3 = 0 OR n > 3 AS fresh, doc_id % 3 = 0 OR n > 2 AS open FROM l)"""


def _synced(t):
    catalog = t.lineitem.select(c("l_returnflag").alias("source"), c("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("version_id"), F.md5(c("l_partkey").cast(TEXT)).alias("sha256"), F.when(c("l_partkey") % 4 > 0, "ready").otherwise("missing").alias("state"), c("l_linenumber").alias("n"))
    old = catalog.where("doc_id % 3 > 0")
    jobs = old.where("n <= 2").select(*runs.VERSION, F.lit("snapshot").alias("stage"), F.lit("r1").alias("recipe")).distinct()
    return runs.sync_run(catalog.drop("n"), old, old.where("n <= 3"), jobs, "r1")


@query(
    "scd6_sync_report",
    f"WITH {_CATALOG} SELECT d.*, versions, new_versions, jobs_registered FROM (SELECT source, count(*) AS documents, count(*) FILTER (fresh) AS new_documents FROM docs GROUP BY 1) d JOIN (SELECT source, count(*) AS versions, count(*) FILTER (fresh) AS new_versions, count(*) FILTER (open AND state = 'ready') AS jobs_registered FROM vers GROUP BY 1) v USING (source)",
)
def sync_report(t):
    return _synced(t)["report"]


@query(
    "scd6_sync_events",
    f"WITH {_CATALOG} SELECT 'document.discovered' AS kind, 'evt-' || substr(sha256(concat_ws(chr(0), 'document.discovered', source, doc_id)), 1, 32) AS event_id, source, doc_id, NULL::VARCHAR AS version_id FROM docs WHERE fresh UNION ALL SELECT 'version.registered', 'evt-' || substr(sha256(concat_ws(chr(0), 'version.registered', source, doc_id, version_id)), 1, 32), source, doc_id, version_id FROM vers WHERE fresh",
)
def sync_events(t):
    return _synced(t)["events"].select("kind", "event_id", "source", "doc_id", "version_id")


@query(
    "q5_recipe_decisions",
    "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus <> 'F' THEN 'refused' WHEN o_orderkey % 4 = 0 THEN 'reused' ELSE 'run' END AS decision FROM orders",
)
def recipe_decisions(t):
    jobs = t.orders.select(c("o_orderpriority").alias("source"), c("o_orderkey").alias("doc_id"), c("o_custkey").alias("version_id"), c("o_orderstatus").alias("recipe"))
    return runs.recipe_checked(jobs, jobs.where("doc_id % 4 = 0"), "F").select("doc_id", "decision")


@query(
    "q6_task_register",
    """WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber || '-' || l_partkey AS extraction_id, l_partkey % 3 > 0 AS ready, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM lineitem)
SELECT 'task-' || substr(sha256(concat_ws(chr(0), o_orderstatus, o_orderkey, o_custkey, extraction_id, 'm1', 'p1', 't1')), 1, 32) AS task_key, o_orderkey AS doc_id, extraction_id, 'pending' AS status
FROM orders JOIN e ON doc_id = o_orderkey AND r = 1 AND ready WHERE o_totalprice > 100000 AND o_orderkey % 5 > 0 AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey = 7)""",
)
def task_register(t):
    base = t.orders.select(c("o_orderstatus").alias("source"), c("o_orderkey").alias("doc_id"), c("o_custkey").alias("version_id"), (c("o_totalprice") > 100000).alias("is_current"), F.lower("o_orderpriority").alias("symbol"))
    lines = t.lineitem.select(c("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("extraction_id"), F.struct("l_linenumber", "l_partkey").alias("row_id"), F.when(c("l_partkey") % 3 > 0, "ready").otherwise("review").alias("status"))
    extractions = base.select(*runs.VERSION).join(lines, "doc_id")
    known = extractions.where("doc_id % 5 = 0").select(*runs.TASK[:4], F.lit("m1").alias("model_identity"), F.lit("p1").alias("prompt_version"), F.lit("t1").alias("template_version"))
    found = runs.registered_tasks(base, extractions, base, known, "m1", "p1", "t1", {"symbols": ["1-Urgent", "2-high "], "doc_ids": [7]})
    return found.select("task_key", "doc_id", "extraction_id", "status")


@query(
    "q6_task_claim",
    """SELECT event_id::VARCHAR AS task_key, (event_id % 5 + 1)::INT AS attempts, 1705276800 + 900 * (event_id % 5 + 1) AS lease_ends FROM events
WHERE (event_id % 4 = 1 OR (event_id % 4 = 0 AND event_id % 5 < 3)) AND (event_id % 3 > 0 OR ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-15') AND event_id % 2 = 0 ORDER BY ts, task_key LIMIT 50""",
)
def task_claim(t):
    k = c("event_id")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "partial").when(k % 4 == 2, "running").otherwise("done")
    at = c("ts").cast("timestamp")
    tasks = t.events.select(k.cast(TEXT).alias("task_key"), c("event_type").alias("source"), c("user_id").alias("doc_id"), at.alias("created_at"), status.alias("status"), (k % 5).cast("int").alias("attempts"), F.when(k % 3 == 0, at + F.expr("INTERVAL 1 DAY")).alias("lease_until"), F.concat(F.lit("m"), k % 2).alias("model_identity"))
    now = F.timestamp_seconds(F.lit(1705276800))
    return runs.claimed_tasks(tasks, tasks, now, 50, 900, 3, model="m0").select("task_key", "attempts", F.unix_timestamp("lease_until").alias("lease_ends"))


@query("q11_stale_workers", "SELECT user_id AS worker, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) > 864000 * 1000000::BIGINT AS stale FROM events GROUP BY 1")
def stale_workers(t):
    beats = t.events.select(c("user_id").alias("worker"), c("ts").cast("timestamp").alias("at"))
    return runs.stale_workers(beats, F.timestamp_seconds(F.lit(1706659200)), 864000).select("worker", "stale")


@query(
    "udf6_verified_runs",
    """WITH e AS (SELECT doc_id % 50 AS run_id, doc_id, text, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS n FROM documents WHERE trim(text) <> ''),
g AS (SELECT run_id, count(*) AS k, string_agg('[' || n || '] ' || text, chr(10) ORDER BY n) AS said, list(doc_id ORDER BY n) AS ids FROM e WHERE n <= 8 GROUP BY 1),
r AS (SELECT item_id AS run_id, k, ids, length(text || chr(10) || chr(10) || said) % 12 AS x FROM benchmark LEFT JOIN g ON g.run_id = item_id)
SELECT run_id, CASE WHEN k IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN k IS NULL THEN 'no_usable_evidence' END AS error, CASE WHEN k IS NOT NULL THEN array_to_string(CASE WHEN x > 1 AND x <= k THEN [ids[1], ids[x]] ELSE [ids[1]] END, ' ') END AS cited, CASE WHEN k IS NOT NULL THEN CASE WHEN x > k OR x = 0 THEN x::VARCHAR ELSE '' END END AS invalid FROM r""",
)
def verified_runs(t):
    evidence = t.documents.select((c("doc_id") % 50).alias("run_id"), c("doc_id").alias("rank"), c("doc_id").alias("block_id"), "text")
    answer = lambda prompt: F.concat(F.lit("See [1] and ["), F.length(prompt) % 12, F.lit("]."))
    out = runs.verified_runs(t.benchmark.select(c("item_id").alias("run_id"), c("text").alias("query")), evidence, answer, most_tokens=1_000_000_000)
    return out.select("run_id", "status", "error", F.array_join("cited", " ").alias("cited"), F.array_join("invalid", " ").alias("invalid"))


def shout(prompt: str) -> str:
    """A provider that answers with its prompt's first word, and fails on what begins with a vowel."""
    word = prompt.split(" ")[0]
    if word[:1] in "AEIOUaeiou":
        raise ValueError("a vowel")
    return "".join(map(upper_letter, word))


def upper_letter(letter: str) -> str:
    """The one capital of a letter; those that Python writes as several letters keep their own sign, as in SQL."""
    return next((x for x in (letter.upper(), letter.title()) if len(x) == 1), "ẞ" if letter == "ß" else letter)


@query("udf4_completions", "SELECT conv_id, turn, CASE WHEN NOT v THEN upper(w) END AS answer, CASE WHEN v THEN 'ValueError: a vowel' ELSE '' END AS error FROM (SELECT *, w = '' OR substr(w, 1, 1) IN ('A', 'E', 'I', 'O', 'U', 'a', 'e', 'i', 'o', 'u') AS v FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ')[1] AS w FROM conversations))")
def completions(t):
    from ..sources import registries

    registries.PROVIDERS.register("shout", shout)
    out = registries.completed(t.conversations, ["conv_id", "turn"], "text", "shout", egress_allowed=True)
    return out.select("conv_id", "turn", "answer", F.coalesce("error", F.lit("")).alias("error"))


@query(
    "udf5_custom_retriever",
    r"""WITH l AS (SELECT doc_id, o, line, printf('%d-b%04d', doc_id, o) AS id FROM (SELECT doc_id, unnest(range(len(x))) AS o, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE length(trim(line)) > 0),
    h AS (SELECT doc_id % 50 AS run_id, id, line, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY length(line) DESC, id) AS r FROM l), g AS (SELECT *, (len(regexp_extract_all(line, '[\x{a0}-\x{ff}]{6,}')) >= 3 OR regexp_matches(line, '[\x{a0}-\x{ff}]{18,}')) AS bad FROM h WHERE r <= 6)
    SELECT run_id, id AS block_id, row_number() OVER (PARTITION BY run_id ORDER BY r) AS rank FROM g WHERE NOT bad AND run_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 6""",
)
def custom_retriever(t):
    """The longest lines of the documents whose number ends as the query's."""
    from ..operators import index, retrieval, search
    from ..sources import registries

    def longest(queries, blocks, k):
        found = blocks.select("block_id", (F.split("block_id", "-")[0].cast("long") % 50).alias("query_id"), F.length("text").alias("n")).join(queries.select("query_id"), "query_id", "left_semi")
        return retrieval.top(found, ["query_id"], k, F.desc("n"), c("block_id"))

    registries.RETRIEVERS.register("longest", longest)
    queries = t.benchmark.select(c("item_id").alias("query_id"), c("text").alias("query"))
    out = registries.retrieved(queries, index.line_blocks(t.documents).select("block_id", "text"), "longest", 6, search.gate)
    return out.select("run_id", "block_id", c("rank").cast("long").alias("rank"))


@query(
    "snk5_claim_pages",
    """SELECT l.doc_id || '.md' AS name, 'rev' || (quality + 1) || '.v1' AS stable_id, md5('# Claim ' || l.doc_id || chr(10) || chr(10) || '- **status**: ' || CASE WHEN toxic = 1 THEN 'disputed' ELSE 'accepted' END || chr(10) || '- **revision**: ' || (quality + 1) || chr(10) || '- **author**: ' || coalesce(source, '') || chr(10) || chr(10) || '## Statement' || chr(10) || chr(10) || coalesce(lang, '') || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10)
|| '- `' || l.doc_id || '`' || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || '  > ' || replace(substr(text, 1, 160), chr(10), ' ') ELSE '' END || chr(10)) AS content FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
)
def claim_pages(t):
    claims = t.labels.join(t.documents, "doc_id").select(c("doc_id").alias("claim_id"), (c("quality") + 1).alias("revision"), F.when(c("toxic") == 1, "disputed").otherwise("accepted").alias("status"), c("source").alias("author"), c("lang").alias("statement"))
    pages = publish.claim_pages(claims, t.documents.select(c("doc_id").alias("claim_id"), F.lit(0).alias("ordinal"), c("doc_id").alias("block_id"), "text"))
    return pages.select("name", "stable_id", F.md5("content").alias("content"))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '([\\`*_{{}}\[\]()<>#!|$~])', '\\\1', 'g')"


@query(
    "snk6_reading_notes",
    f"""WITH b AS (SELECT conv_id, turn, turn // 2 AS page, lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS before, text FROM conversations),
g AS (SELECT conv_id, string_agg(CASE WHEN page IS DISTINCT FROM before THEN '## ' || page || chr(10) || '[' || page || '](u/' || conv_id || '#page=' || page || ')' || chr(10) || chr(10) ELSE '' END || {_PLAIN.format("text")} || chr(10) || chr(10) || '^' || conv_id || '-' || turn || chr(10), chr(10) ORDER BY turn) AS body FROM b GROUP BY 1)
SELECT 'text-' || sha256(concat_ws(chr(0), 'talk', conv_id, conv_id)) || '-readable.md' AS name, md5('---' || chr(10) || 'generated: true' || chr(10) || 'source: "talk"' || chr(10) || 'doc_id: "' || conv_id || '"' || chr(10) || 'source_version: "1"' || chr(10) || 'extraction_id: "' || conv_id || '"' || chr(10) || 'extraction_status: "ready"' || chr(10) || 'extracted_at: "2024-01-01T00:00:00Z"' || chr(10) || '---' || chr(10) || chr(10) || '# Talk \\#' || conv_id || chr(10) || chr(10) || body) AS content FROM g""",
)
def reading_notes(t):
    blocks = t.conversations.select(c("conv_id").alias("extraction_id"), c("turn").alias("ordinal"), F.concat_ws("-", "conv_id", "turn").alias("block_id"), F.floor(c("turn") / 2).alias("page"), "text")
    k = c("conv_id")
    extractions = t.conversations.select(k.alias("extraction_id")).distinct().select("extraction_id", F.lit("talk").alias("source"), c("extraction_id").alias("doc_id"), F.lit(1).alias("version_id"), F.lit("ready").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.concat(F.lit("Talk #"), c("extraction_id")).alias("title"), F.concat(F.lit("u/"), c("extraction_id")).alias("url"))
    return publish.reading_notes(extractions, blocks).select("name", F.md5("content").alias("content"))


@query(
    "snk6_reading_index",
    """WITH v AS (SELECT source, doc_id, 'text-' || sha256(concat_ws(chr(0), source, doc_id, CASE WHEN doc_id % 7 > 0 THEN doc_id END)) || '-readable.md' AS name FROM documents)
SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'absent' WHEN doc_id % 3 = 0 THEN 'published' ELSE 'pending' END AS state, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN '- No. ' || doc_id || ' — review; [original](u/' || doc_id || ')' WHEN doc_id % 3 = 0 THEN '- [No. ' || doc_id || '](' || name || ') — review' ELSE '- No. ' || doc_id || ' — pending; [original](u/' || doc_id || ')' END AS line FROM v""",
)
def reading_index(t):
    k = c("doc_id")
    v = t.documents.select("source", "doc_id", F.concat(F.lit("No. "), k).alias("title"), F.concat(F.lit("u/"), k).alias("url"), F.when(k % 7 > 0, k).alias("extraction_id"), F.lit("review").alias("status"), F.when(k % 5 > 0, 3).otherwise(0).alias("blocks"))
    written = v.where("doc_id % 3 = 0").select(publish.note_name(c("source"), k, c("extraction_id")).alias("name"))
    return publish.reading_index(v, written)


@query(
    "snk7_analysis_pages",
    """WITH e AS (SELECT l_orderkey, string_agg('- `' || l_partkey || '`' || chr(10) || '  > ' || l_returnflag || ' ' || l_linestatus, chr(10) ORDER BY l_linenumber, '- `' || l_partkey || '`' || chr(10) || '  > ' || l_returnflag || ' ' || l_linestatus) AS refs FROM lineitem GROUP BY 1)
SELECT o_orderkey || '.md' AS name, md5('# ' || o_orderpriority || chr(10) || chr(10) || '- **status**: ' || o_orderstatus || chr(10) || '- **model**: m1' || chr(10) || '- **all citations valid**: ' || CASE WHEN o_orderkey % 4 = 0 THEN 'no' ELSE 'yes' END || chr(10) || '- **invalid citations**: ' || CASE WHEN o_orderkey % 4 = 0 THEN '[9]' ELSE '' END || chr(10) || chr(10) || '## Draft' || chr(10) || chr(10) || 'See [1].' || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || coalesce(refs, '') || chr(10)) AS content FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""",
)
def analysis_pages(t):
    runs_ = t.orders.select(c("o_orderkey").alias("run_id"), c("o_orderpriority").alias("title"), c("o_orderstatus").alias("status"), F.lit("m1").alias("model_identity"), F.lit("See [1].  ").alias("draft"), F.when(c("o_orderkey") % 4 == 0, F.array(F.lit(9))).otherwise(F.array().cast("array<int>")).alias("invalid"))
    cited = t.lineitem.select(c("l_orderkey").alias("run_id"), c("l_linenumber").alias("ordinal"), c("l_partkey").alias("block_id"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"))
    return publish.analysis_pages(runs_, cited).select("name", F.md5("content").alias("content"))


@query("snk11_store_contents", " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS rows FROM {name}" for name in ("orders", "lineitem", "documents", "events")))
def store_contents(t):
    counted = [publish.contents(getattr(t, name)).select(F.lit(name).alias("table"), "rows") for name in ("orders", "lineitem", "documents", "events")]
    return reduce(lambda a, b: a.unionByName(b), counted)


_SECTIONS = """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS o, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM l WHERE length(trim(line)) > 0),
p AS (SELECT doc_id, (n - 1) // 3 AS section, 'lang ' || lang || chr(10) || chr(10) || string_agg('[' || n || '] ' || line, chr(10) ORDER BY n) AS prompt FROM b JOIN documents USING (doc_id) GROUP BY doc_id, lang, section),
d AS (SELECT doc_id, section, 'read ' || md5(prompt) || ' [' || (section * 3 + 1) || ']' AS draft FROM p), w AS (SELECT doc_id, count(*) AS n, 'lang ' || any_value(lang) || chr(10) || chr(10) || string_agg('== section ' || (section + 1) || ' ==' || chr(10) || draft, chr(10) || chr(10) ORDER BY section) AS prompt, any_value(draft) AS single FROM d JOIN documents USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS sections, CASE WHEN n = 1 THEN single ELSE 'read ' || md5(prompt) || ' [1]' END AS draft FROM w"""


@query("q6_section_run", _SECTIONS)
def section_run(t):
    """Every document, a line a block, three blocks a section; the model is a digest of its prompt that names the first evidence number it sees."""
    import uuid

    from ..operators import index, storage, tasks

    first = F.coalesce(F.nullif(F.regexp_extract(c("prompt"), r"(?s)^[^\n]*\n\n\[(\d+)\]", 1), F.lit("")), F.lit("1"))
    answer = lambda prompt: F.concat(F.lit("read "), F.md5(prompt), F.lit(" ["), first, F.lit("]"))
    blocks = index.line_blocks(t.documents).select(c("doc_id").cast("string").alias("task_key"), "ordinal", "block_id", "text")
    wanted = t.documents.select(c("doc_id").cast("string").alias("task_key"), F.concat(F.lit("lang "), "lang").alias("query"))
    run = tasks.SectionRun(t.spark, f"{storage.shared_root(t.spark)}/stratafolio-sections-{uuid.uuid4().hex}")
    out = run.run(wanted, lambda: blocks, answer, size=3, wave=1000)
    return out.where("sections > 0").select(c("task_key").cast("long").alias("doc_id"), "sections", "draft")
