"""Publishers: pages of reading notes, analyses and claims, their index, an append-only file sink, backups and their drill."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Field names of a reading note's head, characters that Markdown escapes, marks of files in conflict.
HEAD = (("source", "source"), ("doc_id", "doc_id"), ("source_version", "version_id"), ("extraction_id", "extraction_id"), ("extraction_status", "status"), ("extracted_at", "created_at"))
LITERAL = r"([\\`*_{}\[\]()<>#!|$~])"
CONFLICTS = ("sync-conflict", "conflicted copy")

OUTCOMES = "name string, outcome string, path string, last_hash string"


def literal(text: Column) -> Column:
    """Text that Markdown shows as it is: one kind of line end, no control characters, special characters escaped."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(plain, LITERAL, r"\\$1")


def json_text(text: Column) -> Column:
    """A value as a JSON string."""
    shown = F.to_json(F.array(F.coalesce(text.cast("string"), F.lit(""))))
    return F.substr(shown, F.lit(2), F.length(shown) - 2)


def note_name(*parts: Column) -> Column:
    return F.concat(F.lit("text-"), F.sha2(F.concat_ws("\u0000", *(p.cast("string") for p in parts)), 256), F.lit("-readable.md"))


def _body(blocks: DataFrame, key: str, *lines: Column) -> DataFrame:
    """key, body: the lines of each block in order, joined."""
    part = blocks.select(key, F.struct("ordinal", F.concat_ws("\n", *lines).alias("t")).alias("b"))
    return part.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n").alias("body"))


def reading_notes(extractions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(name, content): one note for each extraction (extraction_id, source, doc_id, version_id, status, created_at, title, url).

    blocks: extraction_id, ordinal, block_id, page, text. A new page number starts a section that links to that page; each block ends with its
    anchor. An extraction without blocks is a note with its head only. One note is one value, so the longest document bounds a row.
    """
    order = Window.partitionBy("extraction_id").orderBy("ordinal")
    before = F.last("page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.withColumn("turned", F.col("page").isNotNull() & ~F.col("page").eqNullSafe(before)).join(extractions.select("extraction_id", "url"), "extraction_id")
    page = F.col("page").cast("string")
    section = F.when(F.col("turned"), F.concat(F.lit("## "), page, F.lit("\n["), page, F.lit("]("), F.col("url"), F.lit("#page="), page, F.lit(")\n")))
    body = _body(placed, "extraction_id", section, literal(F.col("text")), F.lit(""), F.concat(F.lit("^"), F.col("block_id").cast("string")), F.lit(""))
    head = [F.concat(F.lit(f"{name}: "), json_text(F.col(column))) for name, column in HEAD]
    top = F.concat_ws("\n", F.lit("---"), F.lit("generated: true"), *head, F.lit("---"), F.lit(""), F.concat(F.lit("# "), literal(F.coalesce("title", F.lit("")))), F.lit(""), F.lit(""))
    notes = extractions.join(body, "extraction_id", "left")
    return notes.select(note_name(F.col("source"), F.col("doc_id"), F.col("extraction_id")).alias("name"), F.concat(top, F.coalesce("body", F.lit(""))).alias("content"))


def reading_index(versions: DataFrame, written: DataFrame) -> DataFrame:
    """(source, doc_id, state, line) of current versions (source, doc_id, title, url, extraction_id, status, blocks): published where the note
    is among the written names, pending where it isn't yet, absent where there is no text. A line never links to a note that isn't there."""
    v = versions.withColumn("name", note_name(F.col("source"), F.col("doc_id"), F.col("extraction_id")))
    d = v.join(written.select("name").distinct().withColumn("there", F.lit(True)), "name", "left")
    state = F.when(F.col("extraction_id").isNull() | (F.coalesce("blocks", F.lit(0)) == 0), "absent").when(F.col("there"), "published").otherwise("pending")
    title, origin = literal(F.coalesce("title", F.col("doc_id").cast("string"))), F.concat(F.lit("["), F.lit("original"), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"))
    linked = F.concat(F.lit("- ["), title, F.lit("]("), F.col("name"), F.lit(") — "), F.coalesce("status", F.lit("")))
    plain = lambda said: F.concat(F.lit("- "), title, F.lit(" — "), said, F.lit("; "), origin)
    line = F.when(F.col("state") == "published", linked).when(F.col("state") == "pending", plain(F.lit("pending"))).otherwise(plain(F.coalesce("status", F.lit("not extracted"))))
    return d.withColumn("state", state).select("source", "doc_id", "state", line.alias("line"))


def _sheet(title: Column, facts: list[tuple[str, Column]], sections: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit("# "), title), F.lit("")]
    lines += [F.concat(F.lit(f"- **{name}**: "), F.coalesce(value.cast("string"), F.lit(""))) for name, value in facts]
    for name, body in sections:
        lines += [F.lit(""), F.lit(f"## {name}"), F.lit(""), F.coalesce(body, F.lit(""))]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def _references(evidence: DataFrame, key: str, shown: int) -> DataFrame:
    """key, refs: a line for each block cited, its text quoted to `shown` characters."""
    quoted = F.replace(F.substring("text", 1, shown), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("- `"), F.col("block_id").cast("string"), F.lit("`"), F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("\n  > "), quoted)).otherwise(""))
    return _body(evidence, key, line).withColumnRenamed("body", "refs")


def claim_pages(claims: DataFrame, evidence: DataFrame, template: str = "v1", shown: int = 160) -> DataFrame:
    """(name, content, stable_id) of claims (claim_id, revision, status, author, statement) with evidence (claim_id, ordinal, block_id, text)."""
    d = claims.join(_references(evidence, "claim_id", shown), "claim_id", "left")
    content = _sheet(F.concat(F.lit("Claim "), F.col("claim_id").cast("string")), [("status", F.col("status")), ("revision", F.col("revision")), ("author", F.col("author"))], [("Statement", F.col("statement")), ("Evidence", F.col("refs"))])
    stable = F.concat(F.lit("rev"), F.col("revision").cast("string"), F.lit(f".{template}"))
    return d.select(F.concat(F.col("claim_id").cast("string"), F.lit(".md")).alias("name"), content.alias("content"), stable.alias("stable_id"))


def analysis_pages(runs: DataFrame, cited: DataFrame) -> DataFrame:
    """(name, content, stable_id) of runs (run_id, title, status, model_identity, draft, invalid: array of numbers) with cited (run_id, ordinal, block_id, text)."""
    d = runs.join(_references(cited, "run_id", 1_000_000_000), "run_id", "left")
    valid = F.when(F.size(F.coalesce("invalid", F.array().cast("array<int>"))) == 0, "yes").otherwise("no")
    facts = [("status", F.col("status")), ("model", F.col("model_identity")), ("all citations valid", valid), ("invalid citations", F.array_join(F.transform("invalid", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", "))]
    content = _sheet(literal(F.coalesce("title", F.lit(""))), facts, [("Draft", F.rtrim("draft")), ("Evidence", F.col("refs"))])
    return d.select(F.concat(F.col("run_id").cast("string"), F.lit(".md")).alias("name"), content.alias("content"), F.lit(None).cast("string").alias("stable_id"))


def analysis_index(tasks: DataFrame, written: DataFrame, stale: DataFrame) -> DataFrame:
    """(task_key, state, line) of tasks (task_key, doc_id, title, url, status, error, run_id, publish_path, model_identity, prompt_version, template_version), for an index in order of created_at: a page is
    linked only if it is among the written names; an analysis whose evidence has changed (stale: run_id) waits for another; what is done without a page waits to be published."""
    d = tasks.join(written.select(F.col("name").alias("publish_path"), F.lit(True).alias("there")).distinct(), "publish_path", "left").join(stale.select("run_id", F.lit(True).alias("old")).distinct(), "run_id", "left")
    ended = F.col("status").isin("done", "partial")
    state = F.when(F.col("old"), "stale").when(ended & F.col("there"), F.col("status")).when(ended, "unpublished").otherwise(F.coalesce("status", F.lit("pending")))
    title, origin = literal(F.coalesce("title", F.col("doc_id").cast("string"))), F.concat(F.lit("; [original]("), F.coalesce("url", F.lit("")), F.lit(")"))
    linked = F.concat(F.lit("- ["), title, F.lit("]("), F.col("publish_path"), F.lit(") — "))
    by = F.concat("model_identity", F.lit(" ("), "prompt_version", F.lit(" / "), "template_version", F.lit(")"))
    said = F.when(F.col("state") == "failed", F.concat(F.lit("failed ("), F.substring(F.coalesce("error", F.lit("")), 1, 60), F.lit(")"))).otherwise(F.col("state"))
    line = F.when(F.col("state") == "done", F.concat(linked, by)).when(F.col("state") == "partial", F.concat(linked, F.lit("partial"))).otherwise(F.concat(F.lit("- "), title, F.lit(" — "), said, origin))
    return d.withColumn("state", state).select("task_key", "state", line.alias("line"))


def notes_to_write(outbox: DataFrame, notes: DataFrame) -> DataFrame:
    """notes (name, content, extraction_id) that an outbox (extraction_id, status) has pending, each once: what a publisher writes before it marks the entries consumed."""
    due = outbox.where("status = 'pending'").select("extraction_id").distinct()
    return notes.join(due, "extraction_id", "left_semi")


def consumed(outbox: DataFrame, delivered: DataFrame) -> DataFrame:
    """The outbox with its pending entries done where their note (delivered: extraction_id) was written or is there unchanged; the others stay pending, so that a run that was cut writes them again."""
    there = delivered.select("extraction_id", F.lit(True).alias("_done")).distinct()
    status = F.when((F.col("status") == "pending") & F.col("_done"), "consumed").otherwise(F.col("status"))
    return outbox.join(there, "extraction_id", "left").withColumn("status", status).select(*outbox.columns)


def _hash(content: bytes) -> str:
    import hashlib

    return hashlib.sha256(content).hexdigest()


def _put(files, path: str, content: bytes) -> None:
    """The whole content or nothing: written beside and moved, so a task that is run again meets no half file."""
    import uuid

    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(beside) as out:
        out.write(content)
    files.move(beside, path)


def _deliver(rows: pd.DataFrame, root: str, refreshable: bool) -> pd.DataFrame:
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)

    def read(path: str) -> bytes | None:
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as found:
            return found.read()

    out = []
    for r in rows.itertuples(index=False):
        if not r.name or "/" in r.name or "\\" in r.name or r.name.startswith(".") or any(m in r.name.lower() for m in CONFLICTS):
            raise ValueError(f"not a name for a page: {r.name!r}")
        path, content = f"{base}/{r.name}", (r.content or "").encode()
        new, found, known = _hash(content), read(path), r.last_hash if isinstance(r.last_hash, str) else None
        if found is None:
            _put(files, path, content)
            out.append((r.name, "written", path, new))
        elif _hash(found) == new:
            out.append((r.name, "unchanged", path, new))
        elif refreshable and known == _hash(found):
            _put(files, path, content)
            out.append((r.name, "refreshed", path, new))
        else:
            mark = r.stable_id if isinstance(r.stable_id, str) else new[:16]
            beside = f"{base}/{r.name.rsplit('.', 1)[0]}.candidate-{mark}.md"
            there = read(beside) is not None
            if not there:
                _put(files, beside, content)
            out.append((r.name, "unchanged" if there else "preserved_with_candidate", beside, known))
    return pd.DataFrame(out, columns=["name", "outcome", "path", "last_hash"])


def _generations(spark: SparkSession, place: str) -> list[int]:
    """Numbers of the finished generations of a manifest."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [s.getPath() for s in store.listStatus(path)]
    done = lambda p: store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and done(p))


def publish(pages: DataFrame, root: str, manifest: str, refreshable: bool = False) -> DataFrame:
    """Write pages (name, content, stable_id) as files under root, a folder that all executors see; returns (name, outcome, path, last_hash).

    written: there was no file; unchanged: it holds this content, or this revision lies beside it; refreshed: it held what was last written here
    and pages are refreshable; else preserved_with_candidate: somebody's file stays and this one is put beside it. A file with exactly our content
    is ours even if no manifest says so, so a run that was cut off is just run again. `manifest` is a folder of generations, one a call.
    """
    spark = pages.sparkSession
    numbers = _generations(spark, manifest)
    before = spark.read.parquet(f"{manifest}/{numbers[-1]}") if numbers else spark.createDataFrame([], OUTCOMES)
    given = pages.select("name", "content", F.col("stable_id").cast("string") if "stable_id" in pages.columns else F.lit(None).cast("string").alias("stable_id"))
    repeated = given.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("content", "stable_id")).alias("p"))  # one page a name; a repeated one is an error
    one = repeated.select("name", F.when(F.col("n") == 1, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("page named twice: "), F.col("name")))).alias("p")).select("name", "p.*")
    known = one.join(before.select("name", "last_hash"), "name", "left").select("name", "content", "stable_id", "last_hash")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _deliver(part, root, refreshable)

    kept = before.join(one.select("name"), "name", "left_anti").withColumn("outcome", F.lit("kept")).select("name", "outcome", "path", "last_hash")
    place = f"{manifest}/{numbers[-1] + 1 if numbers else 1}"
    known.mapInPandas(run, OUTCOMES).unionByName(kept).write.mode("overwrite").parquet(place)  # what is there under a new number was cut off
    return spark.read.parquet(place).where("outcome <> 'kept'")


def contents(df: DataFrame) -> DataFrame:
    """(rows, digest): how many rows, and a sum of their hashes that no order changes."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def backup(spark: SparkSession, root: str, tables: list[str], out: str) -> DataFrame:
    """Copy the tables of a store and write, last, a report (table, rows, digest) of what was read; without it a backup is not finished."""
    report = None
    for name in tables:
        source = spark.read.parquet(f"{root}/{name}.parquet")
        source.write.parquet(f"{out}/{name}.parquet")
        counted = contents(source).select(F.lit(name).alias("table"), "*")
        report = counted if report is None else report.unionByName(counted)
    report.coalesce(1).write.parquet(f"{out}/_report")
    return spark.read.parquet(f"{out}/_report")


def drill(spark: SparkSession, out: str, blobs: str | None = None) -> DataFrame:
    """(table, problem) of a backup that is read again: other rows than reported, other content, or, in the table `blobs` (sha256, content),
    bytes that no longer have their hash. No row: the backup is whole."""
    from .files import broken_blobs

    problems = spark.createDataFrame([], "table string, problem string")
    for r in spark.read.parquet(f"{out}/_report").collect():  # a row a table
        found = contents(spark.read.parquet(f"{out}/{r['table']}.parquet"))
        problem = F.when(F.col("rows") != r["rows"], "row count differs").when(F.col("digest") != r["digest"], "content differs")
        problems = problems.unionByName(found.select(F.lit(r["table"]).alias("table"), problem.alias("problem")).where("problem IS NOT NULL"))
    if blobs:
        problems = problems.unionByName(broken_blobs(spark.read.parquet(f"{out}/{blobs}.parquet")).select(F.lit(blobs).alias("table"), F.concat(F.lit("broken blob: "), F.col("sha256")).alias("problem")))
    return problems
