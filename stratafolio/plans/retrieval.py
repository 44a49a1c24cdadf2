"""Queries of the inverted index and of ranking, over the lines of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import index, retrieval, search
from .registry import query

c = F.col
LINES = "lines AS (SELECT doc_id, ordinal, printf('%d-b%04d', doc_id, ordinal) AS block_id, line FROM (SELECT doc_id, unnest(range(len(l))) AS ordinal, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(trim(line)) > 0)"
TERMS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9._%+-]*'), lambda t: lower(t))"
POSTINGS = f"postings AS (SELECT term, block_id, count(*) AS tf FROM (SELECT block_id, unnest({TERMS.format('line')}) AS term FROM lines) GROUP BY 1, 2)"
SCORES = """n AS (SELECT count(*) AS n, avg(length(line)) AS a FROM lines), df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
scores AS (SELECT query_id, p.block_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length(line) / n.a))) AS score FROM q JOIN postings p USING (term) JOIN df USING (term) JOIN lines USING (block_id), n GROUP BY 1, 2)"""
ONE = f"q AS (SELECT DISTINCT 0 AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark WHERE item_id = 0)"


def terms_of(t, where: str):
    return t.benchmark.where(where).select(c("item_id").alias("query_id"), F.explode(text.distinct_terms(c("text"))).alias("term"))


def generation(t):
    """The store of the tables and the generation of their present files, built where there is none."""
    store = index.session_store(t.spark, t.sf_dir)
    state = search.source_state(t.spark, f"{t.sf_dir}/documents.parquet")
    return store, search.current_generation(store, index.line_blocks(t.documents), state)[0]


def sought(t, where: str):
    (store, active), queries = generation(t), terms_of(t, where)
    terms = [r.term for r in queries.select("term").distinct().limit(retrieval.FEW_TERMS_READ + 1).collect()]
    found = store.postings_of(terms, active) if len(terms) <= retrieval.FEW_TERMS_READ else store.postings_with(queries, active)
    return found, store.blocks(active), queries, store.sizes(active)


def searched(t):
    found, blocks, queries, size = sought(t, "item_id = 0")
    return retrieval.bm25(found, blocks, queries, size=size)


def best(t, n: int, visible=None):
    """The first n blocks of each item of the benchmark."""
    found, blocks, queries, size = sought(t, "true")
    hits = retrieval.best(found, blocks, queries, n, 6, visible and visible(blocks), size)
    return hits.select("query_id", "block_id", c("rank").cast("long").alias("rank"), "score")


@query("snk1_postings_sink", f"WITH {LINES}, {POSTINGS} SELECT term, count(*) AS blocks, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY 1")
def postings_rows(t):
    store, active = generation(t)
    return store.postings(active).groupBy("term").agg(F.count("*").alias("blocks"), F.sum("tf").alias("occurrences"))


@query("idx1_selected_blocks", f"WITH {LINES} SELECT block_id, length(line) AS length FROM lines JOIN labels USING (doc_id) WHERE quality = 1")
def selected(t):
    good = t.labels.where("quality = 1").select("doc_id")
    return index.line_blocks(t.documents).join(good, "doc_id").select("block_id", F.length("text").cast("long").alias("length"))


@query("idx2_build_counts", f"WITH {LINES}, {POSTINGS} SELECT (SELECT count(*) FROM lines) AS blocks, (SELECT count(*) FROM postings) AS postings")
def build(t):
    store, active = generation(t)
    return store.blocks(active).agg(F.count("*").alias("blocks"), F.sum("terms").alias("postings"))  # the build has held them against the postings


@query("idx3_postings_lookup", f"WITH {LINES}, {POSTINGS} SELECT term, block_id, tf FROM postings WHERE term IN ('the', 'with', 'und')")
def lookup(t):
    store, active = generation(t)
    return store.postings_of(["the", "with", "und"], active).select("term", "block_id", "tf")


@query("agg6_index_stats", f"WITH {LINES} SELECT count(*) AS blocks, CAST(sum(len(list_distinct({TERMS.format('line')}))) AS BIGINT) AS terms, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines")
def stats(t):
    return index.block_terms(index.line_blocks(t.documents)).agg(F.count("*").alias("blocks"), F.sum("terms").alias("terms"), F.sum("length").alias("chars"))


@query("agg7_term_frequencies", f"WITH {LINES}, {POSTINGS} SELECT block_id, count(*) AS terms, max(tf) AS most FROM postings GROUP BY 1")
def frequencies(t):
    return index.postings(index.line_blocks(t.documents)).groupBy("block_id").agg(F.count("*").alias("terms"), F.max("tf").alias("most"))


@query("agg8_document_frequency", f"WITH {LINES}, {POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY 1 HAVING count(*) > 5")
def document_frequency(t):
    store, active = generation(t)
    return index.term_counts(store.postings(active)).where("df > 5")


@query("ret1_bm25_search", f"WITH {LINES}, {POSTINGS}, {ONE}, {SCORES} SELECT block_id, round(score, 6) AS score FROM scores ORDER BY round(score, 6) DESC, block_id LIMIT 20")
def bm25_search(t):
    scores = searched(t).select("block_id", F.round("score", 6).alias("score"))
    return scores.orderBy(F.desc("score"), "block_id").limit(20)


@query("ret1_bm25_batch", f"WITH {LINES}, {POSTINGS}, q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark), {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, block_id) AS rank FROM scores) SELECT query_id, block_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def bm25_batch(t):
    return best(t, 5)


@query("ret2_stale_terms", f"WITH {LINES}, {POSTINGS}, {ONE} SELECT block_id, count(*) AS matched FROM postings JOIN q USING (term) GROUP BY 1")
def stale(t):
    wanted = terms_of(t, "item_id = 0").agg(F.collect_set("term").alias("wanted"))  # of one query
    blocks = index.line_blocks(t.documents).crossJoin(F.broadcast(wanted))
    matched = F.size(F.array_intersect(text.tokens(c("text")), "wanted"))
    return blocks.select("block_id", matched.cast("long").alias("matched")).where("matched > 0")


@query("ret3_as_of_hits", f"WITH {LINES}, {POSTINGS}, q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark), {SCORES}, r AS (SELECT query_id, block_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, block_id) AS rank FROM scores JOIN lines USING (block_id) JOIN orders ON o_orderkey = doc_id WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00') SELECT query_id, block_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def as_of_hits(t):
    public = t.orders.where("o_orderdate <= TIMESTAMP_NTZ '1996-06-30 00:00:00'").select(c("o_orderkey").alias("doc_id"))
    return best(t, 20, lambda blocks: blocks.join(public, "doc_id", "left_semi"))


_EVERY = f"q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark)"
_NOW = "CASE doc_id % 10 WHEN 0 THEN 'gone' WHEN 5 THEN substr(line, 1, 40) ELSE line END"
_BAD = r"(len(regexp_extract_all({0}, '[\x{{a0}}-\x{{ff}}]{{6,}}')) >= 3 OR regexp_matches({0}, '[\x{{a0}}-\x{{ff}}]{{18,}}'))"


@query(
    "ret2_guarded_search",
    f"""WITH {LINES}, {POSTINGS}, {_EVERY}, {SCORES}, now AS (SELECT block_id, CASE WHEN doc_id % 10 IN (0, 5) THEN 'p' || block_id END AS projection_id, {_NOW} AS shown FROM lines),
    terms AS (SELECT DISTINCT block_id, unnest({TERMS.format('shown')}) AS term FROM now WHERE NOT {_BAD.format('shown')}), matched AS (SELECT query_id, block_id, string_agg(term, ' ' ORDER BY term) AS matched FROM q JOIN postings USING (term) JOIN terms USING (block_id, term) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, block_id) AS rank FROM scores JOIN matched USING (query_id, block_id) JOIN now USING (block_id)) SELECT query_id, rank, block_id, matched, coalesce(projection_id, '') AS projection_id FROM r WHERE rank <= 20""",
)
def guarded_search(t):
    store, active = generation(t)
    blocks = index.line_blocks(t.documents)
    shown = F.when(c("doc_id") % 10 == 0, "gone").otherwise(F.substring("text", 1, 40))
    stored = blocks.where("doc_id % 10 IN (0, 5)").select(F.concat(F.lit("p"), "block_id").alias("projection_id"), "block_id", F.sha2("text", 256).alias("text_sha256"), shown.alias("projected_text"))
    out = search.search(store, active, terms_of(t, "true"), blocks, 20, projections=stored, heads=stored.select("block_id", "projection_id"))
    return out.select("query_id", "rank", "block_id", F.array_join("matched", " ").alias("matched"), F.coalesce("projection_id", F.lit("")).alias("projection_id"))


def _seen_by(mode: str) -> str:
    at = {"system": "o_orderdate", "public": "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 400 DAY END"}[mode]
    return f"SELECT '{mode}' AS mode, query_id, block_id, score FROM scores JOIN lines USING (block_id) JOIN orders ON o_orderkey = doc_id WHERE {at} <= TIMESTAMP '1996-06-30 00:00:00'"


@query("ret3_as_of_versions", f"WITH {LINES}, {POSTINGS}, {_EVERY}, {SCORES}, v AS ({_seen_by('system')} UNION ALL {_seen_by('public')}), k AS (SELECT v.*, {_BAD.format('line')} AS bad FROM v JOIN lines USING (block_id)), r AS (SELECT mode, query_id, block_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(score, 9) DESC, block_id) AS rank FROM k WHERE NOT bad) SELECT mode, query_id, block_id, rank FROM r WHERE rank <= 10")
def as_of_versions(t):
    store, active = generation(t)
    versions = t.orders.select(c("o_orderkey").alias("doc_id"), c("o_orderdate").alias("first_observed_at"), F.when(c("o_orderkey") % 4 > 0, c("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("public_available_at"))
    blocks, out = index.line_blocks(t.documents), None
    for mode in ("system", "public"):
        allowed = search.visible_blocks(store.blocks(active), versions, F.lit("1996-06-30").cast("timestamp_ntz"), mode)
        hits = search.search(store, active, terms_of(t, "true"), blocks, 10, allowed=allowed).select(F.lit(mode).alias("mode"), "query_id", "block_id", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


@query(
    "idx1_effective_blocks",
    rf"""WITH {LINES}, x AS (SELECT doc_id, b.ordinal, b.line, e FROM lines b, (SELECT unnest([1, 2]) AS e)), u AS (SELECT doc_id, e, ordinal, CASE WHEN e = 2 AND doc_id % 3 = 0 THEN '' ELSE line END AS text, CASE WHEN e = 2 AND doc_id % 5 = 0 THEN 'review' ELSE 'ready' END AS state FROM x),
    s AS (SELECT doc_id, e, bool_and(NOT {_BAD.format('text')}) FILTER (text <> '') AS whole, bool_or(NOT {_BAD.format('text')}) FILTER (text <> '') AS any_fit, bool_and(state = 'ready') FILTER (text <> '') AS ready FROM u GROUP BY 1, 2),
    pick AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN whole AND ready THEN 0 ELSE 1 END, e DESC) AS r FROM s WHERE any_fit)
    SELECT doc_id, ordinal, e AS extraction, md5(text) AS text FROM u JOIN pick USING (doc_id, e) WHERE r = 1 AND doc_id % 4 > 0 AND NOT {_BAD.format('text')} AND text <> ''""",
)
def effective_blocks(t):
    lines = index.line_blocks(t.documents)
    both = lines.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2))))
    late = c("e") == 2
    name = F.format_string("%d-e%d", "doc_id", "e")
    blocks = both.select(name.alias("extraction_id"), F.concat(name, F.lit("-"), c("ordinal").cast("string")).alias("block_id"), "ordinal", F.when(late & (c("doc_id") % 3 == 0), "").otherwise(c("text")).alias("text"), F.lit(None).cast("int").alias("page"), F.when(late & (c("doc_id") % 5 == 0), "review").otherwise("ready").alias("block_status"))
    docs = t.documents.select("doc_id").withColumn("e", F.explode(F.array(F.lit(1), F.lit(2))))
    extractions = docs.select(c("doc_id").alias("version"), name.alias("extraction_id"), F.lit("ready").alias("status"), F.lit(0).alias("pages"), F.lit(0).alias("missing_pages"), c("e").cast("long").alias("ingest_seq"))
    versions = t.documents.select(c("doc_id").alias("version"), "doc_id", (c("doc_id") % 4 > 0).alias("is_current"))
    out = search.selected_blocks(versions, extractions, blocks).where("text <> ''")
    return out.select("doc_id", c("ordinal").cast("long").alias("ordinal"), F.regexp_extract("block_id", "-e([12])-", 1).cast("int").alias("extraction"), F.md5("text").alias("text"))


_COS = "cos AS (SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)"


def similar(t):
    q = [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]
    return t.embeddings.select(c("vec_id").alias("id"), F.round(numbers.cosine(c("embedding"), F.array(*map(F.lit, q))), 6).alias("similarity"))


@query("ret4_vector_recall", f"WITH {_COS} SELECT id, similarity FROM cos ORDER BY similarity DESC, id LIMIT 200")
def vector_recall(t):
    return similar(t).orderBy(F.desc("similarity"), "id").limit(200)


@query(
    "ret5_rank_fusion",
    f"""WITH {LINES}, {POSTINGS}, {ONE}, {SCORES}, {_COS}, k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(max(score), 6) DESC, doc_id) AS rank FROM scores JOIN lines USING (block_id) GROUP BY doc_id), v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM cos)
    SELECT id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT * FROM k WHERE rank <= 200 UNION ALL SELECT * FROM v WHERE rank <= 200) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def rank_fusion(t):
    store, active = generation(t)
    by_doc = searched(t).join(store.blocks(active).select("block_id", "doc_id"), "block_id").groupBy(c("doc_id").alias("id")).agg(F.round(F.max("score"), 6).alias("score"))
    head = lambda df, order: retrieval.top(df.orderBy(F.desc(order), "id").limit(200).withColumn("all", F.lit(1)), ["all"], 200, F.desc(order), F.asc("id"))  # noqa: E731  at most 200 rows reach the window
    fused = retrieval.fused(head(by_doc, "score"), head(similar(t), "similarity"))
    return fused.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("ret7_missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(t):
    return t.documents.select("doc_id").join(t.embeddings.select(c("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query(
    "ret4_batch_vectors",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, list_dot_product(a, embedding::DOUBLE[]) / (CASE WHEN list_dot_product(a, a) = 0 THEN 1 ELSE sqrt(list_dot_product(a, a)) END * CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END) AS similarity FROM q, embeddings)
    SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10""",
)
def batch_vectors(t):
    vectors = t.embeddings.select(c("vec_id").alias("id"), "embedding")
    found = retrieval.nearest(vectors, t.embeddings.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "embedding"), 10)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), c("rank").cast("long").alias("rank"))
