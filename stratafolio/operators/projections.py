"""Projected content over time, ownership of characters by regions, and the pilot pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds


def visible_projection(events: DataFrame, as_of: Column) -> DataFrame:
    """(block_id, projection_id) of the newest event of each block up to an instant, from events (event_id, block_id, projection_id, created_at).
    Instants are compared as timestamps, never as text; a newest event without a projection shows the raw text again (null)."""
    seen = events.where(F.col("created_at").cast("timestamp") <= as_of.cast("timestamp"))
    return seen.groupBy("block_id").agg(F.max(F.struct("event_id", "projection_id")).alias("e")).select("block_id", "e.projection_id")


REQUEST = "block_id string, sequence long, action string, projection_id string, expected string, expected_revision long"
REPLAYED = "block_id string, sequence long, outcome string, old_projection_id string, new_projection_id string, revision long"


class Head:
    """A block's head, its revision (changes so far), and for each projection what the newest change to it replaced."""

    def __init__(self):
        self.head, self.revision, self.before = None, 0, {}

    def move(self, new: str | None) -> None:
        self.before[new] = self.head
        self.head, self.revision = new, self.revision + 1

    def apply(self, action: str, projection: str | None, expected: str | None, revision: int | None) -> str:
        if action == "event":  # of the log, as it happened
            self.before[projection], self.head, self.revision = expected, projection, self.revision + 1
            return "logged"
        if revision is not None and revision != self.revision:
            return "conflict"
        if action == "rollback":
            if self.head is None or self.head != expected:
                return "conflict"
            self.move(self.before.get(self.head))
            return "rolled_back"
        if action != "activate" or projection is None:
            return "invalid"
        if expected is not None and expected != (self.head or ""):
            return "conflict"
        if projection == self.head:
            return "unchanged"
        self.move(projection)
        return "activated"


def replayed(log: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of requests (see REQUEST) against an append-only log (block_id, event_id, old_projection_id, new_projection_id): block_id, sequence,
    outcome, old_projection_id, new_projection_id (the head before and after), revision (the changes so far).

    The log is replayed in the order of event_id, then the requests in the order of sequence, each against what those before it left: a request that
    fails keeps no later one from winning. activate sets the head; `expected` (the head as it was seen, empty for none) and
    `expected_revision`, where given, must hold. rollback needs the head in `expected` and goes to what the newest change to that head replaced, null being the
    raw text. Outcomes: activated, unchanged, rolled_back, conflict, invalid. Rows with activated or rolled_back are the events to append.
    """
    past = log.select(F.col("block_id").cast("string").alias("block_id"), F.lit(0).alias("late"), F.col("event_id").cast("long").alias("sequence"), F.lit("event").alias("action"), F.col("new_projection_id").alias("projection_id"), F.col("old_projection_id").alias("expected"), F.lit(None).cast("long").alias("expected_revision"))
    asked = requests.selectExpr("CAST(block_id AS STRING) AS block_id", "1 AS late", "CAST(sequence AS LONG) AS sequence", "action", "projection_id", "expected", "CAST(expected_revision AS LONG) AS expected_revision")

    def step(state: Head, row: tuple) -> tuple:
        was = state.head
        return (row[1], state.apply(*row[2:]), was, state.head, state.revision)

    out = folds.folded(past.unionByName(asked), ["block_id"], ["late", "sequence", "action", "projection_id"], REPLAYED, Head, step)
    return out.where("outcome <> 'logged'")


def activated(heads: DataFrame, requests: DataFrame) -> DataFrame:
    """(block_id, outcome, projection_id, revision) of requests (block_id, expected, projection_id) against heads (block_id, revision, projection_id).

    The requests of a block are taken in the order of the revision that they expect, so each that expects what it finds is applied (0 where
    there is no head); one without a projection goes back to the raw text.
    """
    class At:
        def __init__(self):
            self.revision, self.head = 0, None

    def step(state: At, row: tuple) -> tuple:
        late, expected, projection = row
        if not late:
            state.revision, state.head = expected, projection
            return ("head", state.head, state.revision)
        if expected != state.revision:
            return ("conflict", state.head, state.revision)
        state.revision, state.head = state.revision + 1, projection
        return ("rolled_back" if projection is None else "activated", state.head, state.revision)

    kind = dict(requests.dtypes)["block_id"]
    both = heads.select("block_id", F.lit(0).alias("late"), F.col("revision").cast("long").alias("expected"), "projection_id").unionByName(requests.select("block_id", F.lit(1).alias("late"), F.col("expected").cast("long").alias("expected"), "projection_id"))
    out = folds.folded(both, ["block_id"], ["late", "expected", "projection_id"], f"block_id {kind}, outcome string, projection_id string, revision long", At, step)
    return out.where("outcome <> 'head'").withColumn("revision", F.col("revision").cast("int"))


def projected(text: Column, chosen: Column, projection: Column, own: Column) -> tuple[Column, Column, Column]:
    """(text, error, projection_id) of a block as its consumers see it: its raw text where no projection is chosen, else what the projection (sha, text) shows. One that isn't the
    block's own, or was made of another text, is an error, and then there is no text."""
    error = F.when(chosen.isNotNull() & ~F.coalesce(own, F.lit(False)), "projection does not belong to this block").when(chosen.isNotNull() & (F.sha2(text, 256) != projection["sha"]), "projection source changed")
    return F.when(error.isNotNull(), None).when(chosen.isNotNull(), projection["text"]).otherwise(text), error, F.when(error.isNull(), chosen)


def projected_blocks(blocks: DataFrame, projections: DataFrame, heads: DataFrame, keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """blocks (block_id, text, and their own columns) as their consumers see them, with projection_id, raw_text_sha256 and error.

    heads (block_id, projection_id) choose the projection of a block, be it the current head, the one visible at an instant
    (visible_projection) or one asked for by its id; a block without one, or with a null, keeps its raw text. projections: projection_id, block_id,
    text_sha256 (of the raw text), projected_text. A projection of another block, an unknown one, and one made of another text are errors, and then
    there is no text. Where a block is asked for in several ways, `keys` name what tells its rows apart on both sides.
    """
    own = heads.select(*keys, F.col("projection_id").alias("_chosen")).where("_chosen IS NOT NULL").join(projections.select(F.col("projection_id").alias("_chosen"), F.struct(F.col("block_id").alias("b"), F.col("text_sha256").alias("sha"), F.col("projected_text").alias("text")).alias("_p")), "_chosen", "left")
    seen = blocks.join(own, list(keys), "left")
    p = F.col("_p")
    text, error, projection = projected(F.col("text"), F.col("_chosen"), p, p["b"] == F.col("block_id"))
    rest = [c for c in blocks.columns if c != "text"]
    return seen.select(*rest, text.alias("text"), projection.alias("projection_id"), F.when(projection.isNotNull(), p["sha"]).alias("raw_text_sha256"), error.alias("error"))


def owned(chars: DataFrame, regions: DataFrame, page: list[str]) -> DataFrame:
    """chars (page.., offset, x, y) with `region`, the one of regions (page.., region, x0, y0, x1, y1) that holds the point, and
    `overlapping` where several do. Boxes are closed at the upper left and open at the lower right; pages are joined by equality."""
    c, r = chars.alias("c"), regions.alias("r")
    same = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in page]
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    on = inside
    for s in same:
        on = s & on
    hit = c.join(r, on, "left").groupBy(*(F.col(f"c.{k}") for k in page), "offset").agg(F.count("region").alias("n"), F.min("region").alias("region"))
    return hit.select(*page, "offset", F.when(F.col("n") == 1, F.col("region")).alias("region"), (F.col("n") > 1).alias("overlapping"))


def pilot_pick(items: DataFrame, category: str, document: list[str], item: str, image: Column, seed: int, per_category: int = 10) -> DataFrame:
    """At most per_category items of each category, in an order by seeded hash: an image first in the category `unknown`, then first items of
    different documents, then further items of the same ones. Adds `pick`."""
    forced = (F.col(category) == "unknown") & image
    drawn = items.withColumn("_order", F.sha2(F.concat_ws(":", F.lit(seed), F.col(item).cast("string")), 256)).withColumn("_image", F.coalesce(forced, F.lit(False)))
    drawn = drawn.withColumn("_forced", F.col("_image") & (F.row_number().over(Window.partitionBy(category, "_image").orderBy("_order", item)) == 1))
    nth = F.row_number().over(Window.partitionBy(category, *document).orderBy(F.desc("_forced"), "_order", item))
    ranked = drawn.withColumn("_again", nth > 1)
    pick = F.row_number().over(Window.partitionBy(category).orderBy(F.desc("_forced"), "_again", "_order", item))
    return ranked.withColumn("pick", pick).where(F.col("pick") <= per_category).drop("_order", "_image", "_forced", "_again")
