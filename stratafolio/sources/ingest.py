"""Ingest of files into a content-addressed store: Python data sources for files with a stability check and for a staging area with task commit and abort, then a
promotion that can be run again.

Every file is hashed while it is copied, and looked at before and after; one that changed meanwhile is never promoted. Staged copies
belong to a job; the job's commit names its tasks' manifests, an abort removes what they staged. Promotion moves each committed copy to the
place named by its hash unless that is taken, so the same bytes are stored once and a second run adds nothing. Folders are URIs or paths that executors see.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PIECE = 1 << 20
FOUND = "path string, sha256 string, size long, modified timestamp, stable boolean"
OUTCOME = "path string, sha256 string, size long, outcome string"


def _files(path: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _state(files, path: str) -> tuple:
    info = files.get_file_info(path)
    return (info.size, info.mtime_ns) if info.is_file else (None, None)


def stable_hash(path: str, attempts: int = 3, copy_to: str | None = None) -> tuple[str | None, int | None, int | None, bool]:
    """(sha256, size, mtime in ns, stable) of a file, read in pieces, copied on the way where a place is given. Its size and time must be the same before and after, and as many bytes as
    that must have been read; else it is read again, `attempts` times at most, and is then unstable. A file that is not there has no hash."""
    files, place = _files(path)
    for _ in range(max(1, attempts)):
        before, digest, n = _state(files, place), hashlib.sha256(), 0
        if before[0] is None:
            return None, None, None, False
        out = files.open_output_stream(_files(copy_to)[1]) if copy_to else None
        with files.open_input_stream(place) as source:
            while piece := source.read(PIECE):
                digest.update(piece)
                n += len(piece)
                if out:
                    out.write(piece)
        if out:
            out.close()
        if before == _state(files, place) and before[0] == n:
            return digest.hexdigest(), n, before[1], True
    return digest.hexdigest(), n, before[1], False


@dataclass
class Chunk(InputPartition):
    paths: list[str]


class StableFiles(DataSource):
    """Files under a folder with their hashes: options path, glob (*), attempts (3) and chunk, the files a task reads (64)."""

    @classmethod
    def name(cls) -> str:
        return "stable_files"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> DataSourceReader:
        return _StableReader(dict(self.options))


class _StableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        root, n = self.options["path"], int(self.options.get("chunk", 64))
        files, place = _files(root)
        prefix = root[: len(root) - len(place)] if root.endswith(place) else ""
        found = sorted(i.path for i in files.get_file_info(fs.FileSelector(place, recursive=True)) if i.is_file and fnmatch.fnmatch(i.base_name, self.options.get("glob", "*")))
        return [Chunk([prefix + p for p in found[k : k + n]]) for k in range(0, len(found), n)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for path in partition.paths:
            sha, size, modified, stable = stable_hash(path, int(self.options.get("attempts", 3)))
            yield path, sha, size, None if modified is None else pd.Timestamp(modified, tz="UTC").to_pydatetime(), stable


@dataclass
class Staged(WriterCommitMessage):
    manifest: str | None


class BlobStaging(DataSource):
    """A sink for (path): options root, job and attempts. Each task copies its files to the job's staging folder and keeps a manifest of them; the commit names the manifests."""

    @classmethod
    def name(cls) -> str:
        return "blob_staging"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _StagingWriter(dict(self.options))


class _StagingWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.attempts = f"{options['root'].rstrip('/')}/staging/{options['job']}", int(options.get("attempts", 3))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, folder = _files(self.folder)
        files.create_dir(folder, recursive=True)
        staged = []
        for row in rows:
            place = f"{self.folder}/{uuid.uuid4().hex}"
            sha, size, _, stable = stable_hash(row[0], self.attempts, place)
            staged.append({"path": row[0], "sha256": sha, "size": size, "stable": stable, "staged": place})
        if not staged:
            return Staged(None)
        name = f"{folder}/manifest-{uuid.uuid4().hex}.jsonl"
        with files.open_output_stream(name) as out:
            out.write("".join(json.dumps(s) + "\n" for s in staged).encode())
        return Staged(name.rsplit("/", 1)[1])

    def commit(self, messages: list) -> None:
        """The job is committed by one file, which is whole when it is seen."""
        files, folder = _files(self.folder)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/committed.tmp") as out:
            out.write(json.dumps([m.manifest for m in messages if m and m.manifest]).encode())
        files.move(f"{folder}/committed.tmp", f"{folder}/committed.json")

    def abort(self, messages: list) -> None:
        files, folder = _files(self.folder)
        if files.get_file_info(folder).type.name == "Directory":
            files.delete_dir(folder)


def _place(root: str, sha: str) -> str:
    return f"{root.rstrip('/')}/blobs/{sha[:2]}/{sha}"


def _promoted(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    """Move each staged copy to its place by hash; one that is taken is left alone if it has the size."""
    for frame in batches:
        out = []
        for r in frame.itertuples():
            files, staged = _files(r.staged)
            if not r.stable:
                outcome = "unstable" if r.sha256 else "missing"
            else:
                target = _files(_place(root, r.sha256))[1]
                size = _state(files, target)[0]
                if size is not None:
                    outcome = "present" if size == r.size else "corrupt"
                elif _state(files, staged)[0] != r.size:
                    outcome = "lost"
                else:
                    files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    files.move(staged, target)
                    outcome = "added"
            if _state(files, staged)[0] is not None:
                files.delete_file(staged)
            out.append((r.path, r.sha256, None if r.size is None or pd.isna(r.size) else int(r.size), outcome))
        yield pd.DataFrame(out, columns=["path", "sha256", "size", "outcome"])


def promote(spark: SparkSession, root: str, job: str) -> DataFrame:
    """(path, sha256, size, outcome) of a committed job: added, present, unstable, missing, corrupt (the store's blob has another size and is never overwritten) or lost. Equal bytes
    are promoted by one task, so one of them is added and the others are present. Not committed: an error."""
    root = root.rstrip("/")
    files, folder = _files(f"{root}/staging/{job}")
    if not files.get_file_info(f"{folder}/committed.json").is_file:
        raise ValueError(f"job {job} was not committed")
    with files.open_input_stream(f"{folder}/committed.json") as f:
        manifests = json.loads(f.read())
    kind = "path string, sha256 string, size long, stable boolean, staged string"
    rows = spark.read.schema(kind).json([f"{root}/staging/{job}/{m}" for m in manifests]) if manifests else spark.createDataFrame([], kind)
    dealt = rows.repartition("sha256", F.when(F.col("sha256").isNull(), F.xxhash64("path")))
    return dealt.mapInPandas(lambda it: _promoted(it, root), OUTCOME)


def ingest(spark: SparkSession, source: str, root: str, glob: str = "*", attempts: int = 3) -> DataFrame:
    """Copy the files under source into the store under root; the outcomes, as a table under root. A run that was cut is simply run again: what it had promoted is
    present, what it had staged without a commit is never read."""
    for kind in (StableFiles, BlobStaging):
        spark.dataSource.register(kind)
    job, root = uuid.uuid4().hex, root.rstrip("/")
    found = spark.read.format("stable_files").option("path", source).option("glob", glob).option("attempts", attempts).load()
    found.select("path").write.format("blob_staging").option("root", root).option("job", job).option("attempts", attempts).mode("append").save()
    promote(spark, root, job).write.parquet(f"{root}/outcomes/{job}")
    files, folder = _files(f"{root}/staging/{job}")
    files.delete_dir(folder)
    return spark.read.schema(OUTCOME).parquet(f"{root}/outcomes/{job}")


def verified(stored: DataFrame, root: str) -> DataFrame:
    """(sha256, sound) of stored blobs (sha256, size): true if the bytes have their hash and size, false if not, null where the blob is absent."""
    root = root.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples():
                sha, size, _, _ = stable_hash(_place(root, r.sha256))
                out.append((r.sha256, None if sha is None else sha == r.sha256 and size == r.size))
            yield pd.DataFrame(out, columns=["sha256", "sound"]).astype({"sound": object})

    return stored.select("sha256", "size").distinct().mapInPandas(run, "sha256 string, sound boolean")
