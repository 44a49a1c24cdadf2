import os

import pytest
from pyspark.sql import functions as F

from stratafolio.operators import runs
from stratafolio.sources import publish

def test_second_sync_adds_nothing(spark):
    none = "source string, doc_id string, version_id string, stage string, recipe string"
    catalog = spark.createDataFrame([("a", "1", "v1", "s", "ready"), ("a", "1", "v1", "s", "ready"), ("a", "2", None, None, None), ("b", "1", "v1", "s", "conflict")], "source string, doc_id string, version_id string, sha256 string, state string")
    empty = spark.createDataFrame([], none)
    first = runs.sync_run(catalog, empty, empty, empty, "r")
    assert sorted(tuple(r) for r in first["report"].collect()) == [("a", 2, 1, 2, 1, 1), ("b", 1, 1, 1, 1, 0)]
    second = runs.sync_run(catalog, first["documents"], first["versions"], first["jobs"], "r")
    assert sorted(tuple(r) for r in second["report"].collect()) == [("a", 2, 1, 0, 0, 0), ("b", 1, 1, 0, 0, 0)] and second["events"].count() == 0
    assert runs.sync_run(catalog, first["documents"], first["versions"], first["jobs"], "other")["jobs"].count() == 1


def test_scope_and_exhaustion(spark):
    tasks = spark.createDataFrame([("a", "s", "1", "pending", 3, None), ("b", "s", "1", "partial", 9, None), ("c", "s", "2", "pending", 0, None)], "task_key string, source string, doc_id string, status string, attempts int, lease_until timestamp").withColumn("created_at", F.lit(0).cast("timestamp"))
    docs = spark.createDataFrame([("s", "1", " aa "), ("s", "2", None)], "source string, doc_id string, symbol string")
    keys = lambda scope: sorted(r.task_key for r in runs.claimed_tasks(tasks, docs, F.current_timestamp(), 9, 60, 3, scope=scope).collect())
    assert [keys(s) for s in (None, {}, {"symbols": ["Aa"]}, {"doc_ids": ["2"]})] == [["b", "c"], [], ["b"], ["c"]]
    assert [(r.task_key, r.status, r.error) for r in runs.exhausted_tasks(tasks, 3).collect()] == [("a", "failed", "max_attempts_exceeded")]


def test_nothing_is_asked_beyond_the_budget(spark):
    given = spark.createDataFrame([(1, "q"), (2, "q" * 9000), (3, "none"), (4, "mute")], "run_id int, query string")
    evidence = spark.createDataFrame([(k, n, f"{k}{n}", "text" if n else " ") for k in (1, 2, 4) for n in range(3)], "run_id int, rank int, block_id string, text string")
    answer = lambda prompt: F.when(F.length(prompt) > 5000, F.raise_error(F.lit("asked"))).when(prompt.startswith("mute"), F.lit(None)).otherwise(F.lit("by [2], [7] and [1]"))
    got = {r.run_id: (r.status, r.error, r.cited, r.invalid) for r in runs.verified_runs(given, evidence, answer, most_tokens=500).collect()}
    assert got[1] == ("done", None, ["11", "12"], [7])
    assert [got[k][:2] for k in (2, 3, 4)] == [("failed", "budget_exceeded_per_run_input_tokens"), ("failed", "no_usable_evidence"), ("failed", "provider_call_failed")]


def test_cycle_goes_on_after_a_failure():
    report = runs.worker_cycle([("sync", lambda: 1), ("extract", lambda: 1 / 0), ("index", lambda: 3)])
    assert [(r["stage"], r["ok"], r["result"]) for r in report] == [("sync", True, 1), ("extract", False, None), ("index", True, 3)]
    assert report[1]["error"].startswith("ZeroDivisionError")


def test_human_edits_win(spark, tmp_path):
    root, manifest = str(tmp_path / "vault"), str(tmp_path / "manifest")
    os.makedirs(root)
    pages = lambda *rows: spark.createDataFrame(list(rows), "name string, content string, stable_id string")
    outcome = lambda df, **k: {r["name"]: r["outcome"] for r in publish.publish(df, root, manifest, **k).collect()}
    read = lambda name: open(f"{root}/{name}").read()
    first = pages(("a.md", "1", None), ("b.md", "1", "rev1"))
    assert outcome(first) == {"a.md": "written", "b.md": "written"}
    assert outcome(first) == {"a.md": "unchanged", "b.md": "unchanged"}
    assert outcome(pages(("a.md", "2", None)), refreshable=True) == {"a.md": "refreshed"} and read("a.md") == "2"
    open(f"{root}/a.md", "w").write("mine")
    assert outcome(pages(("a.md", "3", None)), refreshable=True) == {"a.md": "preserved_with_candidate"} and read("a.md") == "mine"
    assert outcome(pages(("a.md", "3", None)), refreshable=True) == {"a.md": "unchanged"}
    assert outcome(pages(("b.md", "2", "rev2"))) == {"b.md": "preserved_with_candidate"} and read("b.candidate-rev2.md") == "2" and read("b.md") == "1"
    assert sorted(os.listdir(root))[0].startswith("a.candidate-") and len(os.listdir(root)) == 4
    for bad in (("../x.md", "", None), (".x", "", None), ("n.sync-conflict.md", "", None)):
        with pytest.raises(Exception, match="not a name"):
            outcome(pages(bad))
    with pytest.raises(Exception, match="named twice"):
        outcome(pages(("c.md", "1", None), ("c.md", "2", None)))
    assert outcome(first.where("name = 'none'")) == {}


def test_backup_and_drill(spark, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "copy")
    spark.createDataFrame([("x" * 64, b"a")], "sha256 string, content binary").write.parquet(f"{root}/blobs.parquet")
    spark.range(10).write.parquet(f"{root}/jobs.parquet")
    assert {r["table"]: r["rows"] for r in publish.backup(spark, root, ["blobs", "jobs"], out).collect()} == {"blobs": 1, "jobs": 10}
    assert publish.drill(spark, out).count() == 0
    assert [r.table for r in publish.drill(spark, out, blobs="blobs").collect()] == ["blobs"]
    spark.range(1, 11).write.mode("overwrite").parquet(f"{out}/jobs.parquet")
    assert [tuple(r) for r in publish.drill(spark, out).collect()] == [("jobs", "content differs")]
