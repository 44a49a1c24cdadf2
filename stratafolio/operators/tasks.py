"""Analysis of documents section by section, resumable: what a section gave is a durable row, so a run that was cut goes on where it stopped.

A task's blocks are numbered through the whole document and cut into sections; a section whose prompt is over the cap of one call is halved. Each wave asks the next sections of each
task within the budget, checks that the blocks are still what they were, and writes what came back. When all sections are there, one more call combines
them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import citations, reserved_tokens
from . import folds
from .ledger import Account, Caps
from .storage import dropped, written

#: The section number of what combines the others.
WHOLE = -1
OUTPUT = "task_key string, section int, draft string, used long, digest string"

# States of tasks and why.
TOO_LARGE, CHANGED, CALL_FAILED, NO_EVIDENCE = "block_exceeds_per_run_cap", "content_changed", "provider_call_failed", "no_usable_evidence_all_blocks_damaged"


def _line(block: Column) -> Column:
    return F.concat(F.lit("["), block["n"].cast("string"), F.lit("] "), block["text"])


def _prompt(query: Column, blocks: Column) -> Column:
    return F.concat(query, F.lit("\n\n"), F.array_join(F.transform(blocks, _line), "\n"))


def halved(head: int, sizes: list[int], cap: int | None) -> list[int]:
    """Lengths of the pieces of a section whose blocks have these sizes (in quarters of a token) under a prompt of `head`: halves, again and again, until each is within the cap or is
    one block."""
    def over(part: list[int]) -> bool:
        return cap is not None and (head + sum(part) + 3) // 4 + 16 > cap

    if len(sizes) <= 1 or not over(sizes):
        return [len(sizes)]
    middle = len(sizes) // 2
    return halved(head, sizes[:middle], cap) + halved(head, sizes[middle:], cap)


def _pieces(cap: int | None) -> Callable[[Column, Column], Column]:
    def run(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for head, sizes in rows:
            yield pa.array([halved(h, s, cap) for h, s in zip(head.to_pylist(), sizes.to_pylist())], pa.list_(pa.int32()))

    run.__annotations__ = {"rows": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return lambda head, sizes: F.arrow_udf(run, "array<int>")(head, sizes)


def _quarters(text: Column) -> Column:
    """Quarters of a token in the budget's measure: four for a Han character, one for any other."""
    han = F.regexp_count(text, F.lit(r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"))
    return (F.length(text) + 3 * han).cast("long")


def _parts(tasks: DataFrame, blocks: DataFrame, size: int, cap: int | None, kept: list[str]) -> DataFrame:
    """task_key, query, section, b: the sections as arrays of their blocks' n, block_id and the columns in `kept`. Blocks are shuffled once, by their task; with a cap they need `quarters`."""
    own = ["block_id", *kept]
    numbered = blocks.select("task_key", *own, F.row_number().over(Window.partitionBy("task_key").orderBy("ordinal", "block_id")).alias("n"))
    chunk = F.floor((F.col("n") - 1) / size)
    chunks = numbered.groupBy("task_key", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", *own))).alias("b"))  # `size` blocks at most
    parts = chunks.join(tasks.select("task_key", F.coalesce("query", F.lit("")).alias("query")), "task_key")
    if cap is not None:
        cut = parts.withColumn("lengths", _pieces(cap)(_quarters(F.concat("query", F.lit("\n\n"))), F.transform("b", _line_quarters)))
        ends = F.aggregate("lengths", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        one = cut.select("task_key", "query", "b", ends.alias("ends")).select("*", F.posexplode(F.slice("ends", 1, F.size("ends") - 1)).alias("k", "start"))
        parts = one.select("task_key", "query", F.slice("b", F.col("start") + 1, F.get("ends", F.col("k") + 1) - F.col("start")).alias("b"))
    section = F.row_number().over(Window.partitionBy("task_key").orderBy(F.get("b", F.lit(0))["n"])) - 1
    return parts.select(F.col("task_key").cast("string").alias("task_key"), "query", section.cast("int").alias("section"), "b")


def _line_quarters(block: Column) -> Column:
    """Quarters of a token of a block's line and the line feed behind it."""
    return block["quarters"] + F.length(block["n"].cast("string")) + 4


def _digest(shas: Column) -> Column:
    """The digest of a section by (block_id, sha) of its blocks."""
    return F.sha2(F.array_join(F.transform(shas, lambda x: F.concat(x["block_id"], F.lit(":"), x["sha"])), "\n"), 256)


def _too_large(tokens: Column, cap: int | None) -> Column:
    return F.when(tokens > cap, TOO_LARGE) if cap is not None else F.lit(None).cast("string")


def sections_of(tasks: DataFrame, blocks: DataFrame, size: int = 8, cap: int | None = None) -> DataFrame:
    """task_key, section, first, blocks (of n, block_id), prompt, tokens, digest, error: the sections of tasks (task_key, query) over their usable blocks (task_key, ordinal, block_id, text).

    Every block is in one section; n numbers the blocks of the document, so [n] means the same in every section. A block that alone is over the cap has an error, and its task fails.
    digest tells whether a section's blocks have changed.
    """
    sized = blocks if cap is None else blocks.withColumn("quarters", _quarters(F.col("text")))
    parts = _parts(tasks, sized, size, cap, ["text"] if cap is None else ["text", "quarters"])
    told = parts.withColumn("prompt", _prompt(F.col("query"), F.col("b")))
    tokens = reserved_tokens(F.col("prompt")) + 8
    digest = _digest(F.transform("b", lambda x: F.struct(x["block_id"].alias("block_id"), F.sha2(x["text"], 256).alias("sha"))))
    shown = F.transform("b", lambda x: F.struct(x["n"].alias("n"), x["block_id"].alias("block_id")))
    return told.select("task_key", "section", F.get("b", F.lit(0))["n"].alias("first"), shown.alias("blocks"), "prompt", tokens.alias("tokens"), digest.alias("digest"), _too_large(tokens, cap).alias("error"))


def outline_of(tasks: DataFrame, blocks: DataFrame, size: int = 8, cap: int | None = None, sized: bool = True) -> DataFrame:
    """task_key, section, last (the number of its last block), tokens (null if not `sized`), digest, error of the same sections. No text is shuffled: each block is its digest and its size."""
    sized = sized or cap is not None
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    short = blocks.select("task_key", "ordinal", "block_id", sha, *([_quarters(F.col("text")).alias("quarters")] if sized else []))
    parts = _parts(tasks, short, size, cap, ["sha", "quarters"] if sized else ["sha"])
    lines = F.aggregate(F.transform("b", _line_quarters), F.lit(0).cast("long"), lambda a, x: a + x)
    tokens = F.floor((_quarters(F.concat("query", F.lit("\n\n"))) + lines + 2) / 4) + 16 if sized else F.lit(None).cast("long")
    digest = _digest(F.transform("b", lambda x: F.struct(x["block_id"].alias("block_id"), F.lower(F.hex(x["sha"])).alias("sha"))))
    return parts.select("task_key", "section", F.get("b", F.size("b") - 1)["n"].alias("last"), tokens.alias("tokens"), digest.alias("digest"), _too_large(tokens, cap).alias("error"))


def affordable(wanted: DataFrame, spent: int, caps: Caps) -> DataFrame:
    """The rows of wanted (task_key, section, tokens) that the budget has room for after `spent`, in the order of task and section; a task whose section is refused has no later one in
    this wave, so that what a task has is always a beginning of it."""
    class State:
        def __init__(self):
            self.account, self.stopped = Account(input=spent), None

    def step(state: State, row: tuple) -> tuple:
        task, section, tokens = row
        fits = task != state.stopped and state.account.apply(caps, "reserve", f"{task}/{section}", "chat", tokens, True, False, None) == "reserved"
        if not fits:
            state.stopped = task
        return (task, section, fits)

    one = wanted.select(F.lit("all").alias("account"), "task_key", "section", "tokens")
    granted = folds.folded(one, ["account"], ["task_key", "section"], "account string, task_key string, section int, granted boolean", State, step)
    return granted.where("granted").select("task_key", "section")


class SectionRun:
    """The durable outputs of a run under a root, a folder a wave. Rows are written by Spark's committer: a wave that was cut left nothing, one that was committed is never asked again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _waves(self) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = [str(s.getPath().getName()) for s in self._files.listStatus(self._path(""))]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("wave-") and self._files.exists(self._path(f"{n}/_SUCCESS")))

    def outputs(self) -> DataFrame:
        waves = self._waves()
        return self.spark.read.schema(OUTPUT).parquet(*(f"{self.root}/wave-{n}" for n in waves)) if waves else self.spark.createDataFrame([], OUTPUT)

    def _ask(self, wanted: DataFrame, answer: Callable[[Column], Column], present: Callable[[], DataFrame]) -> int:
        """One wave of wanted (task_key, section, prompt, tokens, digest): how many drafts were written. What changed while the model was thinking, so that present() lacks it, is not."""
        asked = written(wanted.select("task_key", "section", answer(F.col("prompt")).alias("draft"), F.col("tokens").cast("long").alias("used"), "digest"))
        if asked.isEmpty():
            return 0
        kept = asked.where("draft IS NOT NULL").join(present().select("task_key", "section", "digest"), ["task_key", "section", "digest"], "left_semi")
        number = max(self._waves(), default=-1) + 1
        self._files.delete(self._path(f"wave-{number}"), True)  # residue of a crash
        kept.select(*(f.split()[0] for f in OUTPUT.split(", "))).write.parquet(f"{self.root}/wave-{number}")
        dropped(asked)
        return self.spark.read.schema(OUTPUT).parquet(f"{self.root}/wave-{number}").count()

    def _granted(self, wanted: DataFrame, caps: Caps) -> DataFrame:
        """The rows of wanted (task_key, section, tokens, and more) that the budget still has room for."""
        if caps == Caps():
            return wanted
        spent = self.outputs().agg(F.coalesce(F.sum("used"), F.lit(0))).first()[0]
        return wanted.join(affordable(wanted, spent, caps), ["task_key", "section"])

    def _open(self, outline: DataFrame, cap: int | None) -> DataFrame:
        """The sections (task_key, section, tokens) that have no output, of tasks that can be done."""
        out = outline
        if cap is not None:
            out = out.join(outline.where("error IS NOT NULL").select("task_key").distinct(), "task_key", "left_anti")
        if self._waves():
            out = out.join(self.outputs().select("task_key", "section", "digest"), ["task_key", "section", "digest"], "left_anti")
        return out.select("task_key", "section", "tokens")

    def run(self, tasks: DataFrame, blocks: Callable[[], DataFrame], answer: Callable[[Column], Column], size: int = 8, cap: int | None = None, caps: Caps = Caps(), wave: int = 4, most_waves: int = 1000) -> DataFrame:
        """Ask what is not there yet, `wave` sections of each task at a time, until nothing more can be had, then what combines the sections; states() of all.

        blocks() gives the present usable blocks; it is read again before each write. A null answer is a failed call: its section stays open and may be asked by a later run. A task
        whose blocks changed keeps no outputs of the old ones.

        Texts are shuffled once a wave, by their task; all else goes by the sections' digests.
        """
        outlined = lambda read: written(outline_of(tasks, read, size, cap, caps != Caps()))
        seen: list[DataFrame] = []

        def look() -> DataFrame:
            """The outline of the blocks as they are now."""
            seen.append(outlined(blocks()))
            dropped(*seen[:-1])
            del seen[:-1]
            return seen[-1]

        for _ in range(most_waves):
            read = blocks()
            if not seen:
                seen.append(outlined(read))
            open_ = written(self._open(seen[-1], cap))
            head = open_.withColumn("k", F.row_number().over(Window.partitionBy("task_key").orderBy("section"))).where(F.col("k") <= wave)
            picked = self._granted(head.drop("k"), caps).groupBy("task_key").agg(F.collect_set("section").alias("picked"))  # `wave` numbers at most
            wanted = sections_of(tasks, read, size, cap).join(picked, "task_key").where(F.array_contains("picked", F.col("section")))
            left, got = open_.count(), self._ask(wanted, answer, look)
            dropped(open_)
            if not got or got == left:
                break
        self._combine(tasks, seen[-1] if seen else look(), answer, cap, caps, look)
        return self._states(tasks, seen[-1])

    def _gathered(self, outline: DataFrame) -> DataFrame:
        """A row a task: sections, error, last, any (whether it has outputs at all), d (section, draft, digest of outputs of sections that are as they were when they were asked), wholes (digest and
        draft of what combined them). One shuffle, by task; a document has as many drafts as sections."""
        none = lambda kind: F.lit(None).cast(kind)
        planned = outline.select("task_key", "section", "digest", F.lit(True).alias("planned"), "last", "error", none("string").alias("draft"))
        given = self.outputs().select("task_key", "section", "digest", F.lit(False).alias("planned"), none("int").alias("last"), none("string").alias("error"), "draft")
        one = planned.unionByName(given).repartition("task_key").groupBy("task_key", "section", "digest").agg(*(F.max(c).alias(c) for c in ("planned", "last", "error", "draft")))
        drafted = F.col("draft").isNotNull()
        valid, whole = F.col("planned") & drafted, (F.col("section") == WHOLE) & drafted
        return one.groupBy("task_key").agg(
            F.count_if("planned").alias("sections"),
            F.max("error").alias("error"),
            F.max("last").alias("last"),
            F.bool_or(drafted & (F.col("section") != WHOLE)).alias("any"),
            F.array_sort(F.collect_list(F.when(valid, F.struct("section", "draft", "digest")))).alias("d"),
            F.collect_list(F.when(whole, F.struct("digest", "draft"))).alias("wholes"),
        )

    def _whole(self, tasks: DataFrame, gathered: DataFrame) -> DataFrame:
        """What combines the sections of the tasks that have all of more than one: a row a task, in the form of a section, with `wholes`."""
        query = tasks.select(F.col("task_key").cast("string").alias("task_key"), F.coalesce("query", F.lit("")).alias("query"))
        ready = gathered.where("sections > 1 AND size(d) = sections").join(query, "task_key")
        said = F.array_join(F.transform("d", lambda x: F.concat(F.lit("== section "), (x["section"] + 1).cast("string"), F.lit(" ==\n"), x["draft"])), "\n\n")
        prompt = F.concat("query", F.lit("\n\n"), said)
        return ready.select("task_key", F.lit(WHOLE).cast("int").alias("section"), prompt.alias("prompt"), _whole_digest(F.col("d")).alias("digest"), "wholes").withColumn("tokens", reserved_tokens(F.col("prompt")) + 8)

    def _combine(self, tasks: DataFrame, outline: DataFrame, answer: Callable[[Column], Column], cap: int | None, caps: Caps, look: Callable[[], DataFrame]) -> None:
        open_ = self._whole(tasks, self._gathered(outline)).where(~F.exists("wholes", lambda w: w["digest"] == F.col("digest"))).drop("wholes")
        if cap is not None:
            open_ = open_.where(F.col("tokens") <= cap)
        if caps != Caps():
            open_ = written(open_)
        self._ask(self._granted(open_, caps), answer, lambda: self._whole(tasks, self._gathered(look())))

    def states(self, tasks: DataFrame, blocks: Callable[[], DataFrame], size: int = 8, cap: int | None = None) -> DataFrame:
        """task_key, status, error, sections, done, draft, cited, invalid of the tasks: done (with the final draft and the block numbers that it names), partial, pending (nothing yet), failed, or
        blocked where outputs are only of blocks that have changed."""
        return self._states(tasks, written(outline_of(tasks, blocks(), size, cap, False)))

    def _states(self, tasks: DataFrame, outline: DataFrame) -> DataFrame:
        combined = F.array_max(F.transform(F.filter("wholes", lambda w: w["digest"] == F.col("whole")), lambda w: w["draft"]))
        only = F.when(F.get("d", F.lit(0))["section"] == 0, F.get("d", F.lit(0))["draft"])
        known = self._gathered(outline).withColumn("whole", _whole_digest(F.col("d"))).select("task_key", "sections", "error", "last", "any", F.size("d").cast("long").alias("done"), only.alias("only"), combined.alias("combined"))
        all_ = tasks.select(F.col("task_key").cast("string").alias("task_key")).join(known, "task_key", "left")
        done, n = F.coalesce("done", F.lit(0)), F.coalesce("sections", F.lit(0))
        draft = F.when(n == 1, F.col("only")).when(done == n, F.col("combined"))
        status = F.when((n == 0) | F.col("error").isNotNull(), "failed").when((done == n) & draft.isNotNull(), "done").when(done > 0, "partial").when(F.coalesce("any", F.lit(False)), "blocked").otherwise("pending")
        error = F.when(n == 0, NO_EVIDENCE).when(F.col("error").isNotNull(), F.col("error")).when((done == 0) & F.coalesce("any", F.lit(False)), CHANGED)
        named = citations(draft)
        return all_.select("task_key", status.alias("status"), error.alias("error"), n.alias("sections"), done.alias("done"), F.when(status == "done", draft).alias("draft"), F.filter(named, lambda k: (k >= 1) & (k <= F.col("last"))).alias("cited"), F.filter(named, lambda k: (k < 1) | (k > F.col("last"))).alias("invalid"))


def _whole_digest(drafts: Column) -> Column:
    """The digest of what combines sections, by their digests and drafts in order."""
    return F.sha2(F.array_join(F.transform(drafts, lambda x: F.concat(x["digest"], F.sha2(x["draft"], 256))), "\n"), 256)
