import hashlib
import os

import pytest
from pyspark.sql import functions as F

from stratafolio.sources import files, ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (("a.txt", b"same"), ("b.txt", b"same"), ("deep/c.txt", b"other" * 400_000), ("d.bin", b"no"), ("empty.txt", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def outcomes(df):
    return {os.path.basename(r.path): r.outcome for r in df.collect()}


def blobs(folder):
    return {p.name: p.read_bytes() for p in (folder / "store" / "blobs").glob("*/*")}


def test_the_same_bytes_are_stored_once_and_a_rerun_adds_nothing(spark, folder):
    first = ingest.ingest(spark, str(folder / "in"), str(folder / "store"), "*.txt")
    got = outcomes(first)
    assert sorted((got.pop("a.txt"), got.pop("b.txt"))) == ["added", "present"] and got == {"c.txt": "added", "empty.txt": "added"}
    assert all(hashlib.sha256(data).hexdigest() == name for name, data in blobs(folder).items()) and len(blobs(folder)) == 3
    assert set(outcomes(ingest.ingest(spark, str(folder / "in"), str(folder / "store"), "*.txt")).values()) == {"present"}
    assert not list((folder / "store" / "staging").iterdir())
    assert [r.sound for r in ingest.verified(first, str(folder / "store")).collect()] == [True] * 3


def test_uris_and_hashes_of_files(spark, folder):
    spark.dataSource.register(ingest.StableFiles)
    rows = spark.read.format("stable_files").option("path", f"file://{folder}/in").option("chunk", 2).load().collect()
    assert {os.path.basename(r.path): (r.sha256, r.size, r.stable) for r in rows}["a.txt"] == (hashlib.sha256(b"same").hexdigest(), 4, True)
    assert len(rows) == 5 and all(r.path.startswith("file:///") for r in rows)
    assert "added" in set(outcomes(ingest.ingest(spark, f"file://{folder}/in", f"file://{folder}/store")).values())


def test_a_file_that_changes_meanwhile_is_unstable(folder, monkeypatch):
    path = str(folder / "in" / "a.txt")
    states = iter([(4, 1), (4, 2)] * 3)
    monkeypatch.setattr(ingest, "_state", lambda *_: next(states))
    assert ingest.stable_hash(path)[3] is False
    states = iter([(4, 1), (4, 2), (4, 2), (4, 2)])  # quiet at the second attempt
    assert ingest.stable_hash(path) == (hashlib.sha256(b"same").hexdigest(), 4, 2, True)


def staged(spark, folder, job, rows):
    """A committed job whose manifest says rows (path, sha256, size, stable, content)."""
    import json

    place = folder / "store" / "staging" / job
    place.mkdir(parents=True)
    lines = []
    for k, (path, sha, size, stable, content) in enumerate(rows):
        if content is not None:
            (place / f"s{k}").write_bytes(content)
        lines.append(json.dumps({"path": path, "sha256": sha, "size": size, "stable": stable, "staged": str(place / f"s{k}")}))
    (place / "manifest-1.jsonl").write_text("\n".join(lines))
    (place / "committed.json").write_text('["manifest-1.jsonl"]')
    return outcomes(ingest.promote(spark, str(folder / "store"), job))


def test_unstable_missing_and_corrupt_files_fail_closed(spark, folder):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    place = folder / "store" / "blobs" / sha(b"known")[:2]
    place.mkdir(parents=True)
    (place / sha(b"known")).write_bytes(b"damaged store")
    rows = [("u", sha(b"moving"), 6, False, b"moving"), ("m", None, None, False, None), ("k", sha(b"known"), 5, True, b"known"), ("l", sha(b"lost"), 4, True, None), ("t", sha(b"torn"), 4, True, b"to"), ("g", sha(b"good"), 4, True, b"good")]
    assert staged(spark, folder, "j1", rows) == {"u": "unstable", "m": "missing", "k": "corrupt", "l": "lost", "t": "lost", "g": "added"}
    assert (place / sha(b"known")).read_bytes() == b"damaged store" and set(blobs(folder)) == {sha(b"known"), sha(b"good")}
    rows = spark.createDataFrame([(sha(b"known"), 5), (sha(b"good"), 4), (sha(b"absent"), 1)], "sha256 string, size long")
    assert {r.sha256: r.sound for r in ingest.verified(rows, str(folder / "store")).collect()} == {sha(b"known"): False, sha(b"good"): True, sha(b"absent"): None}


def test_a_job_without_commit_is_refused_and_an_abort_leaves_nothing(spark, folder):
    writer = ingest._StagingWriter({"root": str(folder / "store"), "job": "j2"})
    message = writer.write(iter([(str(folder / "in" / "a.txt"),)]))
    with pytest.raises(ValueError, match="not committed"):
        ingest.promote(spark, str(folder / "store"), "j2")
    writer.abort([message])
    assert not (folder / "store" / "staging" / "j2").exists()
    spark.dataSource.register(ingest.BlobStaging)
    broken = spark.range(3).select(F.when(F.col("id") < 2, F.lit(str(folder / "in" / "a.txt"))).otherwise(F.raise_error(F.lit("a bad row")).cast("string")).alias("path")).repartition(3)
    with pytest.raises(Exception, match="a bad row"):
        broken.write.format("blob_staging").option("root", str(folder / "store")).option("job", "j3").mode("append").save()
    assert not (folder / "store" / "staging" / "j3").exists()


def test_archive_export_and_csv(spark, tmp_path):
    manifest = spark.createDataFrame([("r1", "a1", "done"), ("r2", "a2", "done"), ("r3", "a3", "done"), ("r4", None, "failed")], "report_id string, current_artifact_id string, status string")
    artifact = "report_id string, artifact_id string, sha256 string, bytes long, media_type string, state string"
    artifacts = spark.createDataFrame([("r1", "a1", "x", 1, "pdf", "ready"), ("r1", "a0", "y", 1, "pdf", "ready"), ("r2", "a2", "x", 1, "pdf", "ready"), ("r2", "a2", "z", 2, "pdf", "ready"), ("r3", "a3", "x", 1, "pdf", "failed")], artifact)
    manifest.write.parquet(str(tmp_path / "m"))
    artifacts.write.parquet(str(tmp_path / "a"))
    got = {r.report_id: (r.archive_state, r.available) for r in files.read_archive(spark, str(tmp_path / "m"), str(tmp_path / "a")).collect()}
    assert got == {"r1": ("ready", True), "r2": ("conflict", False), "r3": ("missing", False), "r4": ("missing", False)}
    good, twice, bad = tmp_path / "good.jsonl", tmp_path / "twice.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"doc_id": "1", "v": 1}\n{"doc_id": "2"}\n')
    twice.write_text('{"doc_id": "1"}\n{"doc_id": "1"}\n')
    bad.write_text('{"doc_id": "1"}\n{"doc_id": \n')
    assert files.read_export(spark, str(good), "doc_id string, v int").count() == 2
    with pytest.raises(ValueError, match="missing or repeated"):
        files.read_export(spark, str(twice), "doc_id string")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|bad record|corrupt"):
        files.read_export(spark, str(bad), "doc_id string").collect()
    rows = spark.createDataFrame([(2, 'a "quoted", one'), (1, "plain"), (3, None)], "id int, title string")
    files.write_csv(rows, str(tmp_path / "csv"), ["id", "title"], ["id"])
    text = "".join(p.read_text().split("\n", 1)[1] for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == '1,plain\n2,"a ""quoted"", one"\n3,""\n' or text == '1,plain\n2,"a ""quoted"", one"\n3,\n'
