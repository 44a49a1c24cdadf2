import pytest
from pyspark.sql import functions as F

from stratafolio.operators import tasks
from stratafolio.operators.ledger import Caps
from stratafolio.operators.tasks import SectionRun, halved, sections_of

BLOCK = "task_key string, ordinal int, block_id string, text string"


def frames(spark, sizes):
    wanted = spark.createDataFrame([(k, f"about {k}") for k in sizes], "task_key string, query string")
    rows = [(k, i, f"{k}{i}", f"text {k}{i}") for k, n in sizes.items() for i in range(n)]
    return wanted, spark.createDataFrame(rows, BLOCK)


class Model:
    """Answers with what it was asked first, keeping a file a call."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, prompt):
        import hashlib
        import os
        import uuid
        from collections.abc import Iterator

        import pyarrow as pa

        folder = self.folder
        os.makedirs(folder, exist_ok=True)

        def run(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in prompts:
                out = []
                for p in batch.to_pylist():
                    with open(f"{folder}/{hashlib.sha256(p.encode()).hexdigest()}-{uuid.uuid4().hex}", "w") as f:
                        f.write(p)
                    out.append(f"read {p.splitlines()[2]} [1] [99]")
                yield pa.array(out, pa.string())

        run.__annotations__ = {"prompts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "string")(prompt)

    def calls(self):
        import os

        return [open(f"{self.folder}/{n}").read() for n in sorted(os.listdir(self.folder))]


def test_sections_cover_every_block_with_numbers_of_the_document(spark):
    wanted, blocks = frames(spark, {"a": 5, "b": 2, "c": 0})
    got = {(r.task_key, r.section): ([(b.n, b.block_id) for b in r.blocks], r.prompt) for r in sections_of(wanted, blocks, 2).collect()}
    assert got["a", 1] == ([(3, "a2"), (4, "a3")], "about a\n\n[3] text a2\n[4] text a3")
    assert {k: [n for n, _ in v[0]] for k, v in got.items()} == {("a", 0): [1, 2], ("a", 1): [3, 4], ("a", 2): [5], ("b", 0): [1, 2]}


def test_sections_over_the_cap_are_halved(spark):
    assert halved(0, [40] * 4, None) == [4] and halved(0, [40] * 4, 36) == [2, 2] and halved(0, [40] * 3, 26) == [1, 1, 1] and halved(0, [], 1) == [0]
    wanted, blocks = frames(spark, {"a": 8})
    cap = 24 + 10
    got = sections_of(wanted, blocks, 8, cap).orderBy("section").collect()
    assert [len(r.blocks) for r in got] == [4, 4] and all(r.tokens <= cap and r.error is None for r in got)
    assert [r.first for r in got] == [1, 5]
    assert {r.error for r in sections_of(wanted, blocks, 8, 5).collect()} == {tasks.TOO_LARGE}


def test_a_run_that_was_cut_goes_on_without_asking_twice(spark, tmp_path):
    wanted, blocks = frames(spark, {"a": 7, "b": 3, "c": 1})
    model, run = Model(tmp_path / "calls"), SectionRun(spark, str(tmp_path / "run"))
    run.run(wanted, lambda: blocks, model, size=1, wave=2, most_waves=1)  # cut after one wave
    (tmp_path / "run" / "wave-7").mkdir()  # a wave that was cut in the middle: not committed
    (tmp_path / "run" / "wave-7" / "part-0.parquet").write_bytes(b"broken")
    states = {r.task_key: (r.status, r.sections, r.done) for r in run.states(wanted, lambda: blocks, 1).collect()}
    assert states == {"a": ("partial", 7, 2), "b": ("partial", 3, 2), "c": ("done", 1, 1)}
    out = SectionRun(spark, str(tmp_path / "run")).run(wanted, lambda: blocks, model, size=1, wave=2)
    got = {r.task_key: r for r in out.collect()}
    assert {k: (r.status, r.sections, r.done) for k, r in got.items()} == {"a": ("done", 7, 7), "b": ("done", 3, 3), "c": ("done", 1, 1)}
    calls = model.calls()
    assert len(calls) == len(set(calls)) == 7 + 3 + 1 + 2  # each section once, and two syntheses
    assert got["a"].draft.startswith("read == section 1 ==") and got["c"].draft == "read [1] text c0 [1] [99]"
    assert got["a"].cited == [1] and got["a"].invalid == [99]
    run.run(wanted, lambda: blocks, model, size=1, wave=2)
    assert len(model.calls()) == len(calls)


def test_the_budget_stops_a_task_at_its_beginning_and_a_larger_one_continues_it(spark, tmp_path):
    wanted, blocks = frames(spark, {"a": 4, "b": 2})
    model, run = Model(tmp_path / "calls"), SectionRun(spark, str(tmp_path / "run"))
    each = sections_of(wanted, blocks, 1).first().tokens
    out = run.run(wanted, lambda: blocks, model, size=1, wave=4, caps=Caps(input=3 * each))
    assert {r.task_key: (r.status, r.done) for r in out.collect()} == {"a": ("partial", 3), "b": ("pending", 0)}
    assert sorted(r.section for r in run.outputs().collect()) == [0, 1, 2]
    out = run.run(wanted, lambda: blocks, model, size=1, wave=4, caps=Caps(input=1000))
    assert {r.status for r in out.collect()} == {"done"} and len(model.calls()) == 6 + 2


def test_failed_calls_stay_open_and_no_evidence_fails(spark, tmp_path):
    wanted, blocks = frames(spark, {"a": 2, "z": 0})
    run = SectionRun(spark, str(tmp_path / "run"))
    broken = lambda p: F.when(F.contains(p, F.lit("[2]")), F.lit(None).cast("string")).otherwise(F.lit("fine"))
    got = {r.task_key: (r.status, r.error, r.done) for r in run.run(wanted, lambda: blocks, broken, size=1).collect()}
    assert got == {"a": ("partial", None, 1), "z": ("failed", tasks.NO_EVIDENCE, 0)}
    assert {r.status for r in run.run(wanted.where("task_key = 'a'"), lambda: blocks, lambda p: F.lit("now"), size=1).collect()} == {"done"}


def test_what_changed_while_the_model_was_thinking_is_not_written(spark, tmp_path):
    wanted, blocks = frames(spark, {"a": 2, "b": 1})
    changed = blocks.withColumn("text", F.when(F.col("block_id") == "a1", "other").otherwise(F.col("text")))
    run, seen = SectionRun(spark, str(tmp_path / "run")), []

    def present():
        seen.append(1)
        return blocks if len(seen) == 1 else changed

    run.run(wanted, present, lambda p: F.concat(F.lit("of "), p), size=1, most_waves=1)
    assert sorted((r.task_key, r.section) for r in run.outputs().collect()) == [("a", 0), ("b", 0)]
    out = run.run(wanted, lambda: changed, lambda p: F.concat(F.lit("of "), p), size=1)
    assert {r.status for r in out.collect()} == {"done"} and not run.outputs().where("draft LIKE '%text a1%'").count()
    everything = blocks.withColumn("text", F.lit("new"))
    assert {r.task_key: (r.status, r.error) for r in run.states(wanted, lambda: everything, 1).collect()} == {"a": ("blocked", tasks.CHANGED), "b": ("blocked", tasks.CHANGED)}


def test_texts_are_moved_few_times(spark, tmp_path):
    import hashlib

    from .shuffled import moved

    noise = lambda k: "".join(hashlib.sha512(f"{k}/{j}".encode()).hexdigest() for j in range(32))
    wanted = spark.createDataFrame([(str(k), "q") for k in range(100)], "task_key string, query string")
    blocks = tasks.written(spark.createDataFrame([(str(k), i, f"{k}-{i}", noise(f"{k}-{i}")) for k in range(100) for i in range(12)], BLOCK))
    texts = 100 * 12 * 4096
    with moved(spark) as seen:
        out = SectionRun(spark, str(tmp_path / "run")).run(wanted, lambda: blocks, lambda p: F.md5(p), size=4).collect()
    assert {(r.status, r.done) for r in out} == {("done", 3)}
    assert seen["bytes"] < 4 * texts


@pytest.mark.parametrize("cap", [None, 40])
def test_the_outline_tells_what_the_sections_are(spark, cap):
    rows = [("a", i, f"a{i}", t) for i, t in enumerate(["plain", "漢字 and more", "x" * 60, "", "é\ny"] * 3)]
    wanted, blocks = spark.createDataFrame([("a", None)], "task_key string, query string"), spark.createDataFrame(rows, BLOCK)
    full = {(r.section, r.tokens, r.digest, r.error, r.blocks[-1].n) for r in sections_of(wanted, blocks, 4, cap).collect()}
    assert full == {(r.section, r.tokens, r.digest, r.error, r.last) for r in tasks.outline_of(wanted, blocks, 4, cap).collect()}
