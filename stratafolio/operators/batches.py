"""Frozen batches and bundles: members and recipe are written once, by whoever comes first; unions of batches refuse what collides."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import digest_of
from .storage import written

MEMBER = ["source", "doc_id", "version_id"]

# Why a registration is refused.
OTHER_RECIPE, DIVERGED = "recipe_digest_mismatch", "membership_divergence"


class FrozenBatches:
    """Batches under a root: members as Parquet, and a manifest file that names them, their digest and the recipe. The manifest is created only if it isn't there (the file system
    decides), so members and recipe freeze together, and of two writers one loses and is judged against the other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def manifest(self, batch: str) -> dict | None:
        name = f"{batch}.json"
        if not self._files.exists(self._path(name)):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect()))

    def members(self, batch: str) -> DataFrame:
        """The frozen members of a batch."""
        return self.spark.read.parquet(f"{self.root}/{self.manifest(batch)['members']}")

    def register(self, batch: str, items: DataFrame, recipe: str) -> dict:
        """Freeze items (source, doc_id, version_id) and recipe under a batch id, or resume what is frozen: another recipe and new members are refused,
        fewer members resume the whole. Returns refused, reason, members, and added, the new members' number."""
        wanted = items.select(*(F.col(c).cast("string").alias(c) for c in MEMBER)).distinct()
        frozen = self.manifest(batch)
        if frozen is None:
            place = f"members-{uuid.uuid4().hex}"
            wanted.write.parquet(f"{self.root}/{place}")
            stored = self.spark.read.parquet(f"{self.root}/{place}")
            digest = digest_of(stored.select(F.to_json(F.array(*MEMBER)).alias("k"), F.sha2(F.to_json(F.array(*MEMBER)), 256).alias("d")), "k", "d")
            mine = {"batch": batch, "recipe": recipe, "members": place, "count": stored.count(), "digest": digest}
            if self._create(f"{batch}.json", json.dumps(mine, sort_keys=True)):
                return {"refused": False, "reason": None, "members": mine["count"], "added": 0, "frozen_now": True}
            self._files.delete(self._path(place), True)
            frozen = self.manifest(batch)
        if frozen["recipe"] != recipe:
            return {"refused": True, "reason": OTHER_RECIPE, "members": frozen["count"], "added": 0, "frozen_now": False}
        added = wanted.join(self.members(batch), MEMBER, "left_anti").count()
        return {"refused": added > 0, "reason": DIVERGED if added else None, "members": frozen["count"], "added": added, "frozen_now": False}

    def _create(self, name: str, content: str) -> bool:
        """Whether the file was created by this call; it has its whole content from the first moment that it is seen."""
        draft, target = self._path(f".{name}-{uuid.uuid4().hex}"), self._path(name)
        out = self._files.create(draft, True)
        out.write(bytearray(content.encode()))
        out.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf) if draft.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)  # fails where the target is
            return True
        except Exception:
            self._files.delete(draft, False)
            if not self._files.exists(target):
                raise
            return False


# What makes a union of batches refuse, in the order in which it is looked for.
CONFLICTS = ("one source document has conflicting versions across batches", "one source version has conflicting extraction/snapshot provenance across batches", "duplicate physical page across approved batches", "duplicate block identity across approved batches", "manifest filename collision across batches", "asset filename collision with differing bytes")


def bundle_conflicts(manifests: DataFrame, assets: DataFrame) -> DataFrame:
    """(rule, reason, subject, n) of all collisions in a union of batches; none is a bundle.

    manifests: batch, name, source, doc_id, version_id, extraction_id, snapshot_sha256, page, block_id; assets: batch, name, sha256. Assets of one name and the same
    bytes are one asset. Each rule is one grouping; a group keeps counts, never members.
    """
    subject = lambda *parts: F.concat_ws("/", *(F.col(p).cast("string") for p in parts))
    several = lambda df, keys, what: df.groupBy(subject(*keys).alias("subject")).agg(what.alias("n")).where("n > 1")
    rules = [
        several(manifests, ["source", "doc_id"], F.count_distinct(F.coalesce(F.col("version_id").cast("string"), F.lit("")))),
        several(manifests, ["source", "doc_id", "version_id"], F.count_distinct(F.struct("extraction_id", "snapshot_sha256"))),
        several(manifests, ["source", "doc_id", "version_id", "page"], F.count("*")),
        several(manifests, ["block_id"], F.count("*")),
        several(manifests, ["name"], F.count("*")),
        several(assets, ["name"], F.count_distinct("sha256")),
    ]
    out = None
    for k, (found, reason) in enumerate(zip(rules, CONFLICTS)):
        rows = found.select(F.lit(k).alias("rule"), F.lit(reason).alias("reason"), "subject", F.col("n").cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merged_bundle(manifests: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifests and the distinct assets of a union of batches; ValueError with the first rule that it breaks, and then nothing is made."""
    conflicts = written(bundle_conflicts(manifests, assets))
    worst = conflicts.orderBy("rule", "subject").first()
    if worst is not None:
        raise ValueError(f"{worst.reason}: {worst.subject}")
    return manifests, assets.groupBy("name", "sha256").agg(F.min("batch").alias("batch"))
