"""Ranking: BM25, vectors, reciprocal rank fusion, paging."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


#: Query terms up to which they are broadcast, and up to which only their buckets of an index are read.
FEW_TERMS, FEW_TERMS_READ = 100_000, 500


def bm25(index: DataFrame, blocks: DataFrame, queries: DataFrame, allowed: DataFrame | None = None, size=None, terms: bool = False) -> DataFrame:
    """(query_id, block_id, score) for queries (query_id, term), with the `terms` that a block was found by on request.

    index: term, block_id, tf; blocks: block_id, length. N, the average length and document frequencies are those of the whole
    generation (`size`, if it is known); postings may bring the length themselves; `allowed` (block_id) filters only the rows that are scored. Postings of other terms are dropped before any shuffle of them
    by the semi-join's broadcast of the query terms where those are few.
    """
    few = queries.count() <= FEW_TERMS
    hits = _weighted(index, blocks, queries, allowed, size, few).join(F.broadcast(queries) if few else queries, "term")
    return hits.groupBy("query_id", "block_id").agg(F.sum("weight").alias("score"), *([F.collect_set("term").alias("terms")] if terms else []))


def _weighted(index: DataFrame, blocks: DataFrame, queries: DataFrame, allowed: DataFrame | None, size, few: bool) -> DataFrame:
    """(term, block_id, weight): what each term of the queries adds to a block's score."""
    size = size or blocks.agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()  # one row, kept with a generation
    sought = queries.select("term").distinct()
    wanted = index.join(F.broadcast(sought) if few else sought, "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    scored = wanted if allowed is None else wanted.join(allowed.select("block_id"), "block_id", "left_semi")
    measured = scored if "length" in index.columns else scored.join(blocks.select("block_id", "length"), "block_id")
    weight = numbers.idf(F.lit(size.n), F.col("df")) * numbers.term_weight(F.col("tf"), F.col("length"), F.lit(float(size.avg or 1.0)))
    return measured.join(F.broadcast(df) if few else df, "term").select("term", "block_id", weight.alias("weight"))


#: Scores (blocks times queries) that a task holds at once, and four times the blocks that it holds for all queries.
CELLS = 4_000_000


def best(index: DataFrame, blocks: DataFrame, queries: DataFrame, n: int, places: int, allowed: DataFrame | None = None, size=None, terms: bool = False) -> DataFrame:
    """(query_id, block_id, score, rank), and `terms` on request: the first n blocks of each query by bm25's score, rounded to `places`, and block_id.

    The postings of the queries' terms are dealt by block, once; a task scores its blocks for all queries, some blocks at a time, and hands on its first n of each query, so that what is shuffled
    is the postings and not their pairs with queries. Queries of more than FEW_TERMS terms in all take the plain way, with the same results.
    """
    queries = queries.select("query_id", "term").distinct()
    if queries.count() > FEW_TERMS:
        scores = bm25(index, blocks, queries, allowed, size, terms).withColumn("score", F.round("score", places))
        return top(scores, ["query_id"], n, F.desc("score"), F.asc("block_id"))
    asked = queries.collect()  # FEW_TERMS rows at most
    names, words = sorted({r.query_id for r in asked}), sorted({r.term for r in asked})
    place, number = {q: k for k, q in enumerate(names)}, {w: k for k, w in enumerate(words)}
    of_term: list[list[int]] = [[] for _ in words]
    for r in asked:
        of_term[number[r.term]].append(place[r.query_id])
    ends = np.cumsum([0, *map(len, of_term)])
    columns = np.array([q for x in of_term for q in x], np.int64)
    numbered = index.sparkSession.createDataFrame(list(number.items()), "term string, t int")
    rows = _weighted(index, blocks, queries, allowed, size, True).join(F.broadcast(numbered), "term").select("block_id", "t", "weight")
    held = (len(names), ends, columns, words if terms else None, n, places)
    found = rows.repartition("block_id").sortWithinPartitions("block_id", "t").mapInArrow(lambda it: _scored(it, *held), "q int, block_id string, score double, terms array<string>")
    id_type = queries.schema["query_id"].dataType.simpleString()
    ids = index.sparkSession.createDataFrame([(k, q) for q, k in place.items()], f"q int, query_id {id_type}")
    shown = top(found, ["q"], n, F.desc("score"), F.asc("block_id")).join(F.broadcast(ids), "q")
    return shown.select("query_id", "block_id", "score", *(["terms"] if terms else []), "rank")


def _scored(batches: Iterator[pa.RecordBatch], width: int, ends: np.ndarray, columns: np.ndarray, words: list[str] | None, n: int, places: int) -> Iterator[pa.RecordBatch]:
    """The first n blocks of each of `width` queries among a task's rows (block_id, t, weight), which come in the order of block_id. The queries of term t are columns[ends[t] : ends[t + 1]].

    Held are the blocks that may still be among the first: once n of a query are known, a later block must pass the last of them. Where more than CELLS / 4 are held they go on, and what they must be passed by stays.
    """
    each, scale = np.diff(ends), 10.0**places
    least = np.full(width, -np.inf)  # a further block must pass it
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (query, shown score, block)
    ids: dict[int, str] = {}
    found: dict[int, list[int]] = {}
    terms: list[set[int]] = [set() for _ in range(width)]
    if words is not None:
        for t, q in zip(np.repeat(np.arange(len(each)), each).tolist(), columns.tolist()):
            terms[q].add(t)

    def pruned() -> int:
        query, shown, block = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((block, -shown, query))
        query, shown, block = query[order], shown[order], block[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = rank == n - 1
        least[query[last]] = shown[last]
        kept = rank < n
        held[:] = [(query[kept], shown[kept], block[kept])]
        now = set(block[kept].tolist())
        for x in (ids, found):
            for b in x.keys() - now:
                del x[b]
        return int(kept.sum())

    def out() -> pa.RecordBatch:
        query, shown, block = held[0]
        pairs = list(zip(query.tolist(), block.tolist()))
        said = pa.nulls(len(pairs), pa.list_(pa.string())) if words is None else pa.array([[words[t] for t in found[b] if t in terms[q]] for q, b in pairs], pa.list_(pa.string()))
        data = [pa.array(query, pa.int32()), pa.array([ids[b] for _, b in pairs], pa.string()), pa.array(shown, pa.float64()), said]
        for x in (held, ids, found):
            x.clear()
        return pa.RecordBatch.from_arrays(data, names=["q", "block_id", "score", "terms"])

    seen, count, most = 0, 0, min(100_000, CELLS)
    for names, starts, t, weight in _whole(batches):
        stops = np.append(starts[1:], len(t))
        place, shared = _shared(t, len(starts), width, ends, columns)
        alone = np.cumsum(np.where(place[t] < 0, each[t], 0))
        at = 0
        while at < len(starts):  # as many blocks as make CELLS pairs or scores, one at least
            before = alone[starts[at] - 1] if starts[at] else 0
            to = max(at + 1, min(int(np.searchsorted(alone[stops - 1], before + CELLS, "right")), at + max(1, CELLS // width)))
            part = slice(starts[at], stops[to - 1])
            scores = _scores(np.repeat(np.arange(to - at), stops[at:to] - starts[at:to]), t[part], weight[part], to - at, width, ends, columns, place, shared)
            rows, query = np.nonzero(scores > np.maximum(least - 1 / scale, 0.0))
            shown = np.floor(scores[rows, query] * scale + 0.5) / scale
            more = shown > least[query]
            rows, query, shown = rows[more], query[more], shown[more]
            if len(rows):
                held.append((query, shown, rows + seen + at))
                count += len(rows)
                for r in np.unique(rows).tolist():
                    ids[seen + at + r] = names[starts[at + r]].as_py()
                    if words is not None:
                        found[seen + at + r] = t[starts[at + r] : stops[at + r]].tolist()
            if count > most:
                count = pruned()
                if count > CELLS // 4:
                    yield out()
                    count = 0
                most = max(min(100_000, CELLS), 2 * count)
            at = to
        seen += len(starts)
    if count:
        pruned()
        yield out()


def _shared(t: np.ndarray, rows: int, width: int, ends: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, matrix): the place of each term among those, `width` at most, that make so many pairs of blocks and queries that a product of matrices is cheaper, or -1; and 1 where such a term is of a query."""
    each = np.diff(ends)
    made = np.bincount(t, minlength=len(each)) * each
    chosen = np.flatnonzero(made * 200 > rows * width)
    if len(chosen) > width:
        chosen = np.sort(chosen[np.argsort(-made[chosen], kind="stable")[:width]])
    place = np.full(len(each), -1)
    place[chosen] = np.arange(len(chosen))
    matrix = np.zeros((len(chosen), width))
    for k, term in enumerate(chosen):
        matrix[k, columns[ends[term] : ends[term + 1]]] = 1.0
    return place, matrix


def _scores(own: np.ndarray, t: np.ndarray, weight: np.ndarray, rows: int, width: int, ends: np.ndarray, columns: np.ndarray, place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The sums of weights of `rows` blocks (own: the block of a row) for each query."""
    alone = place[t] < 0
    many = ~alone
    k = len(shared)
    o, t1 = own[alone], t[alone]
    times = ends[t1 + 1] - ends[t1]
    query = columns[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(ends[t1], times)]
    scores = np.bincount(np.repeat(o * width, times) + query, np.repeat(weight[alone], times), rows * width).reshape(-1, width).astype(np.float64, copy=False)  # integers, if there are none
    if k:
        scores += np.bincount(own[many] * k + place[t[many]], weight[many], rows * k).reshape(-1, k) @ shared
    return scores


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (block_id, t, weight) of whole blocks, with the places where blocks start: a block that the next batch goes on with waits for it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0)
        new = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)) + 1
        if rest and rest[-1].column(0)[-1] != names[0]:
            yield _parts(rest)
            rest = []
        if len(new):
            yield _parts([*rest, batch.slice(0, int(new[-1]))])
            rest = [batch.slice(int(new[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield _parts(rest)


def _parts(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    names, t, weight = (pa.concat_arrays([b.column(k) for b in batches]) for k in range(3))
    starts = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)) + 1
    return names, np.concatenate(([0], starts)), t.to_numpy().astype(np.int64), weight.to_numpy()


def top(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, ranked from 1; a limit within tasks precedes the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


#: Vectors and queries that meet as one block.
VECTORS, QUERIES = 4096, 1000
BLOCK = "ids binary, matrix binary"


def _blocked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, embedding) as blocks of unit vectors; a zero vector stays zero."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            e = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)
            length = np.sqrt((e * e).sum(axis=1, keepdims=True))
            unit = e / np.where(length == 0, 1.0, length)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], names=["ids", "matrix"])


def _met(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The best n of a block of vectors for each query of a block."""
    for batch in batches:
        for ids, matrix, query_ids, query_matrix in zip(*(batch.column(c) for c in ("ids", "matrix", "query_ids", "query_matrix"))):
            own, asked = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(query_ids.as_py(), np.int64)
            s = np.frombuffer(query_matrix.as_py(), np.float64).reshape(len(asked), -1) @ np.frombuffer(matrix.as_py(), np.float64).reshape(len(own), -1).T
            order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, order.shape[1])), pa.array(own[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "id", "similarity"])


def nearest(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, similarity, rank): the n most similar vectors (id, embedding) of each query (query_id, embedding).

    A stated set of queries meets all vectors, block against block: queries are dealt to numbered blocks, each block of vectors goes to each of them by a join, and only the best
    n of a pair of blocks go on. Nothing passes the driver but the number of queries. Ties go to the smaller id; a zero vector is similar to nothing.
    """
    blocks = max(1, -(-queries.count() // QUERIES))
    dealt = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").repartition(blocks, "query_id")
    asked = dealt.mapInArrow(lambda it: _blocked(it, QUERIES), BLOCK).select(F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"), F.pmod(F.xxhash64("ids"), F.lit(blocks)).alias("block"))
    held = vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(lambda it: _blocked(it, VECTORS), BLOCK)
    met = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "block")
    found = met.select("ids", "matrix", "query_ids", "query_matrix").mapInArrow(lambda it: _met(it, n), "query_id long, id long, similarity double")
    return top(found, ["query_id"], n, F.desc("similarity"), F.asc("id"))


def fused(*rankings: DataFrame) -> DataFrame:
    """(id, score): reciprocal rank fusion of rankings (id, rank); an id may be in any of them."""
    every = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("id", "rank"))
    return every.groupBy("id").agg(F.sum(numbers.rrf(F.col("rank"))).alias("score"))


def encode_cursor(**state) -> str:
    return base64.urlsafe_b64encode(json.dumps(state, sort_keys=True, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str, **expected) -> dict:
    """The state of a cursor; ValueError if it is malformed or of another query or generation."""
    try:
        state = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as e:
        raise ValueError("malformed cursor") from e
    if any(state.get(k) != v for k, v in expected.items()):
        raise ValueError("stale cursor")
    return state


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0, window: int = 1000) -> DataFrame:
    """A page of a total order within the result window."""
    if not 1 <= size <= window or offset < 0 or offset + size > window:
        raise ValueError("outside the result window")
    return df.orderBy(*order).offset(offset).limit(size)
