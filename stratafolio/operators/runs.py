"""Runs over the stores: the sync run, recipe checks of jobs, analysis tasks, citation-verified runs, worker cycles.

Each is a set-based step from tables to tables; the caller appends the results, so a step that is run again finds its work done.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citations, estimated_tokens, normalized_symbol
from .queues import identity, registered
from .selection import latest

# Kinds of events, states of tasks and runs with their reasons.
DISCOVERED, REGISTERED = "document.discovered", "version.registered"
EXHAUSTED, NO_EVIDENCE, OVER_BUDGET = "max_attempts_exceeded", "no_usable_evidence", "budget_exceeded_per_run_input_tokens"

DOC, VERSION, TASK = ["source", "doc_id"], ["source", "doc_id", "version_id"], ["source", "doc_id", "version_id", "extraction_id", "model_identity", "prompt_version", "template_version"]


def sync_run(catalog: DataFrame, documents: DataFrame, versions: DataFrame, jobs: DataFrame, recipe: str) -> dict[str, DataFrame]:
    """The new documents, versions, events and snapshot jobs of one reconciliation, and a report by source.

    catalog: source, doc_id, version_id (null: a document without versions), sha256, state; documents, versions and jobs hold the keys known
    so far (jobs with stage and recipe). Only ready versions get a job. A second run over what the first one added adds nothing.
    """
    docs = catalog.select(*DOC).distinct()
    seen = catalog.where("version_id IS NOT NULL").groupBy(*VERSION).agg(F.min(F.struct("sha256", "state")).alias("v")).select(*VERSION, "v.*")
    new_docs, new_versions = docs.join(documents.select(*DOC), DOC, "left_anti"), seen.join(versions.select(*VERSION), VERSION, "left_anti")
    wanted = seen.where("state = 'ready'").select(*VERSION, F.lit("snapshot").alias("stage"), F.lit(recipe).alias("recipe"))
    new_jobs = registered(jobs, wanted, [*VERSION, "stage", "recipe"])
    event = lambda kind, *parts: (F.lit(kind).alias("kind"), identity("evt-", 32, F.lit(kind), *parts).alias("event_id"))
    events = new_docs.select(*event(DISCOVERED, *map(F.col, DOC)), *DOC, F.lit(None).cast("string").alias("version_id")).unionByName(
        new_versions.select(*event(REGISTERED, *map(F.col, VERSION)), *DOC, F.col("version_id").cast("string").alias("version_id"))
    )
    counted = {"documents": docs, "versions": seen, "new_documents": new_docs, "new_versions": new_versions, "jobs_registered": new_jobs}
    tagged = [df.groupBy("source").agg(F.count("*").alias("n")).withColumn("what", F.lit(what)) for what, df in counted.items()]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    report = every.groupBy("source").agg(*(F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what) for what in counted))
    return {"documents": new_docs, "versions": new_versions, "events": events, "jobs": new_jobs, "report": report}


def recipe_checked(jobs: DataFrame, extractions: DataFrame, recipe: str) -> DataFrame:
    """jobs with `decision`: refused (frozen under another recipe, so it waits for a runner of that one), reused (this version has an
    extraction of this recipe, so nothing is run) or run."""
    there = extractions.select(*VERSION, "recipe").distinct().withColumn("there", F.lit(True))
    decision = F.when(~F.col("recipe").eqNullSafe(F.lit(recipe)), "refused").when(F.col("there"), "reused").otherwise("run")
    return jobs.join(there, [*VERSION, "recipe"], "left").withColumn("decision", decision).drop("there")


def in_scope(symbol: Column, doc_id: Column, scope: dict | None) -> Column:
    """Whether a document is authorised by scope (symbols, doc_ids): none allows all, an empty one allows nothing."""
    if scope is None:
        return F.lit(True)
    symbols, ids = sorted({s.strip().upper() for s in scope.get("symbols") or []}), sorted({str(d).strip() for d in scope.get("doc_ids") or []})
    return F.coalesce(normalized_symbol(symbol).isin(symbols), F.lit(False)) | F.coalesce(doc_id.cast("string").isin(ids), F.lit(False))


def registered_tasks(versions: DataFrame, extractions: DataFrame, documents: DataFrame, tasks: DataFrame, model: str, prompt: str, template: str, scope: dict | None = None, blocked: str | None = None) -> DataFrame:
    """New analysis tasks: current versions whose newest extraction (by row_id) is ready, in scope, under an identity not yet registered.

    An older ready extraction doesn't count for one that failed later. Blocked tasks wait without a scope.
    """
    newest = latest(extractions, VERSION, F.col("row_id").desc()).where("status = 'ready'").select(*VERSION, "extraction_id")
    found = versions.where("is_current").select(*VERSION).join(newest, VERSION).join(documents.select(*DOC, "symbol"), DOC)
    if blocked is None:
        found = found.where(in_scope(F.col("symbol"), F.col("doc_id"), scope))
    wanted = found.select(*TASK[:4], F.lit(model).alias(TASK[4]), F.lit(prompt).alias(TASK[5]), F.lit(template).alias(TASK[6]))
    return registered(tasks, wanted, TASK).select(
        identity("task-", 32, *map(F.col, TASK)).alias("task_key"), *TASK, F.lit("blocked" if blocked else "pending").alias("status"), F.lit(blocked).cast("string").alias("blocked_reason"), F.lit(0).alias("attempts")
    )


def exhausted_tasks(tasks: DataFrame, most_attempts: int) -> DataFrame:
    """Pending tasks that have used up their attempts, as failed for good."""
    return tasks.where((F.col("status") == "pending") & (F.col("attempts") >= most_attempts)).withColumns({"status": F.lit("failed"), "error": F.lit(EXHAUSTED), "lease_until": F.lit(None).cast("timestamp")})


def claimed_tasks(tasks: DataFrame, documents: DataFrame, now: Column, n: int, lease_seconds: int, most_attempts: int, model: str | None = None, prompt: str | None = None, scope: dict | None = None) -> DataFrame:
    """The n oldest tasks that are pending with attempts left, or partial, free of a lease, of this model and prompt, and in scope: running,
    under a lease that grows with the attempts. Ties of created_at are broken by task_key."""
    free = ((F.col("status") == "partial") | ((F.col("status") == "pending") & (F.col("attempts") < most_attempts))) & (F.col("lease_until").isNull() | (F.col("lease_until") < now))
    open_tasks = tasks.where(free)
    for name, value in (("model_identity", model), ("prompt_version", prompt)):
        if value is not None:
            open_tasks = open_tasks.where(F.col(name) == value)
    if scope is not None:
        open_tasks = open_tasks.join(documents.select(*DOC, "symbol").where(in_scope(F.col("symbol"), F.col("doc_id"), scope)).drop("symbol"), DOC, "left_semi")
    head = open_tasks.orderBy("created_at", "task_key").limit(n)
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    lease = F.timestamp_seconds(F.unix_timestamp(now) + lease_seconds * attempts)
    return head.withColumns({"status": F.lit("running"), "lease_until": lease, "attempts": attempts})


def verified_runs(runs: DataFrame, evidence: DataFrame, answer: Callable[[Column], Column], top_k: int = 8, most_tokens: int = 8000) -> DataFrame:
    """(run_id, status, error, prompt_tokens, draft, cited, invalid) of runs (run_id, query) over evidence (run_id, rank, block_id, text).

    The best `top_k` blocks with text are numbered from 1 and shown to `answer`, a function of the prompt; its [n] are checked against them. cited:
    the blocks it names, invalid: numbers of none. A run without evidence or over the budget fails before anything is asked; a null answer is a
    failed call.
    """
    order = Window.partitionBy("run_id").orderBy("rank", "block_id")
    shown = evidence.where(F.trim("text") != "").withColumn("n", F.row_number().over(order)).where(F.col("n") <= top_k)
    gathered = shown.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("n", "block_id", "text"))).alias("blocks"))  # at most top_k
    said = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("["), b["n"].cast("string"), F.lit("] "), b["text"])), "\n")
    ready = runs.select("run_id", "query").join(gathered, "run_id", "left").withColumn("prompt", F.concat("query", F.lit("\n\n"), said)).withColumn("prompt_tokens", estimated_tokens(F.col("prompt")))
    error = F.when(F.col("blocks").isNull(), NO_EVIDENCE).when(F.col("prompt_tokens") > most_tokens, OVER_BUDGET)
    rated = ready.withColumn("error", error)
    refused = rated.where("error IS NOT NULL").withColumn("draft", F.lit(None).cast("string"))
    asked = rated.where("error IS NULL").withColumn("draft", answer(F.col("prompt"))).withColumn("error", F.when(F.col("draft").isNull(), "provider_call_failed"))
    both = refused.unionByName(asked).withColumn("numbers", citations(F.col("draft")))
    known = lambda n: (n >= 1) & (n <= F.size("blocks"))
    cited = F.transform(F.filter("numbers", known), lambda n: F.element_at(F.col("blocks"), n.cast("int"))["block_id"])
    return both.select("run_id", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", "prompt_tokens", "draft", cited.alias("cited"), F.filter("numbers", lambda n: ~known(n)).alias("invalid"))


def worker_cycle(stages: list[tuple[str, Callable[[], object]]]) -> list[dict]:
    """Run the stages in their order; one that fails is reported and keeps no later one from running."""
    report = []
    for name, stage in stages:
        began, entry = time.time(), {"stage": name, "ok": True, "result": None, "error": None}
        try:
            entry["result"] = stage()
        except Exception as failure:  # the report carries it
            entry |= {"ok": False, "error": f"{type(failure).__name__}: {failure}"}
        report.append(entry | {"seconds": round(time.time() - began, 3)})
    return report


def stale_workers(beats: DataFrame, now: Column, most_seconds: int = 120) -> DataFrame:
    """(worker, last_beat, stale): whether the newest beat of a worker is older than that; null where no beat has an instant."""
    newest = beats.groupBy("worker").agg(F.max("at").alias("last_beat"))
    return newest.withColumn("stale", F.unix_micros(now) - F.unix_micros("last_beat") > most_seconds * 1_000_000)
