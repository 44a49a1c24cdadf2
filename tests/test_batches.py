import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stratafolio.operators import batches, sampling, spatial

MEMBERS = "source string, doc_id string, version_id string"


def items(spark, *names):
    return spark.createDataFrame([("s", n, "v1") for n in names], MEMBERS)


def test_members_and_recipe_freeze_together(spark, tmp_path):
    store = batches.FrozenBatches(spark, str(tmp_path / "batches"))
    assert store.register("b1", items(spark, "d1", "d2", "d2"), "r1") == {"refused": False, "reason": None, "members": 2, "added": 0, "frozen_now": True}
    assert store.register("b1", items(spark, "d1", "d2"), "r2")["reason"] == batches.OTHER_RECIPE
    assert store.register("b1", items(spark, "d1", "d2", "d3"), "r1") == {"refused": True, "reason": batches.DIVERGED, "members": 2, "added": 1, "frozen_now": False}
    assert store.register("b1", items(spark, "d1"), "r1")["refused"] is False  # fewer resume the whole
    assert {r.doc_id for r in store.members("b1").collect()} == {"d1", "d2"}
    assert store.register("b2", items(spark, "d3"), "r2")["frozen_now"] and store.manifest("nobody") is None


def test_the_second_writer_loses(spark, tmp_path):
    store = batches.FrozenBatches(spark, str(tmp_path / "batches"))
    store.manifest("b")  # both see that nothing is there
    seen = store.manifest
    store.manifest = lambda batch, first=[2]: None if (first.__setitem__(0, first[0] - 1) or first[0] >= 0) else seen(batch)
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda d: store.register("b", items(spark, d), "r"), ["d1", "d2"]))
    assert sorted(g["frozen_now"] for g in got) == [False, True]
    assert [g["reason"] for g in got if not g["frozen_now"]] == [batches.DIVERGED]
    store.manifest = seen
    assert store.members("b").count() == 1


MANIFEST = "batch int, name string, source string, doc_id string, version_id string, extraction_id string, snapshot_sha256 string, page int, block_id string"
ASSET = "batch int, name string, sha256 string"


def bundle(spark, change=None, assets=((1, "a.png", "a"), (2, "a.png", "a"))):
    rows = [dict(batch=1, name="1.json", source="s", doc_id="d1", version_id="v1", extraction_id="e1", snapshot_sha256="x", page=1, block_id="b1"), dict(batch=2, name="2.json", source="s", doc_id="d1", version_id="v1", extraction_id="e1", snapshot_sha256="x", page=2, block_id="b2")]
    rows[1] |= change or {}
    fields = [f.split()[0] for f in MANIFEST.split(", ")]
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], MANIFEST), spark.createDataFrame(list(assets), ASSET)


def test_bundles_refuse_collisions(spark):
    manifests, assets = batches.merged_bundle(*bundle(spark))
    assert manifests.count() == 2 and [tuple(r) for r in assets.collect()] == [("a.png", "a", 1)]
    for change, rule in (({"version_id": "v2"}, 0), ({"snapshot_sha256": "y"}, 1), ({"page": 1}, 2), ({"block_id": "b1"}, 3), ({"name": "1.json"}, 4)):
        with pytest.raises(ValueError, match=batches.CONFLICTS[rule]):
            batches.merged_bundle(*bundle(spark, change))
    with pytest.raises(ValueError, match="asset filename collision"):
        batches.merged_bundle(*bundle(spark, None, [(1, "a.png", "a"), (2, "a.png", "b")]))


def plain_sample(rows, total, tune, seed):
    """Strata in the order of their names, sampled from sorted rows; marks are shuffled last."""
    strata = {}
    for r in rows:
        strata.setdefault(r[0], []).append(r)
    if len(strata) >= total:
        quota = {k: 1 for k in sorted(strata, key=lambda k: (-len(strata[k]), k))[:total]}
    else:
        quota, left = {k: 1 for k in strata}, total - len(strata)
        for k in sorted(strata, key=lambda k: (-len(strata[k]), k)):
            if left <= 0:
                break
            extra = min(left, max(0, round(len(strata[k]) / len(rows) * total) - 1))
            quota[k] += extra
            left -= extra
    rng, picked = random.Random(seed), []
    for k in sorted(quota):
        picked += rng.sample(sorted(strata[k], key=lambda r: r[1:]), min(quota[k], len(strata[k])))
    picked.sort(key=lambda r: r[1:])
    marks = ["tune"] * min(tune, len(picked)) + ["blind"] * max(0, len(picked) - tune)
    rng.shuffle(marks)
    return sorted((*r, m) for r, m in zip(picked, marks))


@pytest.mark.parametrize("total, tune, seed", [(120, 80, 20261001), (30, 40, 7), (3, 1, 1), (500, 200, 5)])
def test_the_sample_is_the_one_the_generator_draws(spark, sf, total, tune, seed):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat_ws("|", "lang", (F.col("doc_id") % 3).cast("string")).alias("stratum"), "source", "doc_id")
    got = sampling.seeded_sample(docs.repartition(5), "stratum", ["source", "doc_id"], total, tune, seed).select("stratum", "source", "doc_id", "split").collect()
    assert sorted(tuple(r) for r in got) == plain_sample([tuple(r) for r in docs.collect()], total, tune, seed)


def test_numbered_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE", 10)
    rows = [("a" if k % 3 else "b", k * 7919 % 101) for k in range(101)] + [(None, 5)]
    got = {(r.k, r.v): r["rank"] for r in sampling.numbered(spark.createDataFrame(rows, "k string, v int"), "k", ["v"]).collect()}
    for key in ("a", "b", None):
        assert [got[key, v] for v in sorted(v for k, v in rows if k == key)] == list(range(sum(k == key for k, _ in rows)))


def test_no_samples_of_nothing(spark):
    empty = spark.createDataFrame([], "stratum string, source string, doc_id long")
    assert sampling.seeded_sample(empty, "stratum", ["source", "doc_id"], 10, 5, 1).collect() == []


def test_layers_take_no_row_twice(spark):
    rows = spark.createDataFrame([(k, k % 2, k % 3) for k in range(20)] + [(0, 0, 0)], "id int, two int, three int")
    layers = [("even", F.col("two") == 0, 3), ("third", F.col("three") == 0, 4), ("none", F.lit(False), 2), ("last", F.lit(True), 1, [F.desc("id")]), ("rest", F.lit(True), 99)]
    got = [(r.layer, r.id) for r in sampling.layered_sample(rows, layers, ["id"], [F.col("id")], 5).collect()]
    assert got[:8] == [("even", 0), ("even", 2), ("even", 4), ("third", 3), ("third", 6), ("third", 9), ("third", 12), ("last", 19)]
    assert got[8:] == [("rest", k) for k in (1, 5, 7, 8, 10)]


@pytest.mark.parametrize("size", [0.05, 0.25, 3.0])
def test_overlaps_by_the_grid_are_those_of_all_pairs(spark, size):
    rng = random.Random(3)
    boxes = []
    for k in range(120):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        boxes.append((k % 2, k, x, y, x + rng.choice([0.0, 0.1, 0.25, 0.9]), y + rng.choice([0.1, 0.25, 0.5])))
    boxes += [(0, 200, 0.0, 0.0, 0.25, 0.25), (0, 201, 0.25, 0.0, 0.5, 0.25), (0, 202, None, 0.0, 1.0, 1.0), (0, 203, 0.0, 0.0, 0.25, 0.25)]
    frame = spark.createDataFrame(boxes, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.a, r.b): round(r.iou, 9) for r in spatial.overlapping(frame, frame, ["page"], size).collect()}
    assert len(got) == spatial.overlapping(frame, frame, ["page"], size).count()
    want = {}
    for p, a, ax0, ay0, ax1, ay1 in boxes:
        for q, b, bx0, by0, bx1, by1 in boxes:
            if p == q and None not in (ax0, bx0):
                w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
                if w > 0 and h > 0:
                    want[p, a, b] = round(w * h / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h), 9)
    assert got == want


def test_points_and_their_owners(spark):
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.5, 0.5), (1, "b", 0.5, 0.0, 1.0, 0.5), (1, "c", 0.4, 0.4, 0.6, 0.6), (2, "d", 0.0, 0.0, 1.0, 1.0)], "page int, region string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 0, 0.1, 0.1), (1, 1, 0.5, 0.1), (1, 2, 0.45, 0.45), (1, 3, 0.9, 0.5), (2, 0, 0.0, 0.0), (3, 0, 0.5, 0.5), (1, 4, None, 0.1)], "page int, id int, x double, y double")
    got = {(r.page, r.id): (r.region, r.overlapping) for r in spatial.owners(points, boxes, ["page"]).collect()}
    assert got == {(1, 0): ("a", False), (1, 1): ("b", False), (1, 2): (None, True), (1, 3): (None, False), (2, 0): ("d", False), (3, 0): (None, False), (1, 4): (None, False)}
