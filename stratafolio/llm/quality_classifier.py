"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so has each chosen pair of features over the grid of their coarse bins.
Cyclic boosting goes round the features: each turn fits a shallow tree (at most three leaves) to the gradient of the logistic
loss on one feature's bins and adds a share of it to that table. Then the pairs with the largest first gain are boosted in the same
way by two-by-two splits of the grid. A score is the sum of looked-up values through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import STOP_WORDS

#: Labelled rows at most that the fit sees, the lowest by a hash of id and text; only their features come to the driver.
SAMPLE = 20_000
#: Parts of the hash range by which the sample is cut.
FINE = 1 << 40
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SMOOTH = 32, 8, 60, 20, 6, 0.15, 2.0
FEATURES = ("words", "word_length", "symbols", "upper", "exclamations", "digits", "stop_words", "distinct_words", "repeated_triples", "duplicate_lines", "line_words", "other_bytes")
STOP = frozenset(form.encode() for words in STOP_WORDS.values() for form in words.split())
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>=~^{}[]\\_@")] = True


def features(text: bytes) -> list[float]:
    """Of a whole text in UTF-8."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    low = text.lower()
    words = low.split()
    n = len(words)
    size = max(n, 1)
    chars = max(int(seen[33:].sum()), 1)
    lines = [line for line in low.split(b"\n") if line.strip()]
    twice = sum(c for c in Counter(zip(words, words[1:], words[2:])).values() if c > 1)
    return [
        np.log1p(n),
        sum(map(len, words)) / size,
        seen[SYMBOLS].sum() / size,
        seen[65:91].sum() / chars,
        seen[33] / size,
        seen[48:58].sum() / chars,
        sum(map(STOP.__contains__, words)) / size,
        len(set(words)) / size,
        twice / size,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        np.log1p(n / max(len(lines), 1)),
        seen[128:].sum() / chars,
    ]


VECTOR = "array<float>"


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and `x`, the features of each row's text; null text counts as empty."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([features(t.as_py() or b"") for t in batch], pa.list_(pa.float32()))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.select(*keep, F.arrow_udf(run, VECTOR)(F.col("text").cast("binary")).alias("x"))


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The value of each bin under a tree of at most three leaves on bin sums of gradient and hessian."""
    out = np.zeros(len(g))
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for leaf in leaves:
            a, b = leaf
            if b - a < 2:
                continue
            gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            won = gain(gs[:-1], hs[:-1]) + gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - gain(gs[-1], hs[-1])
            k = int(won.argmax())
            best = max(best, (float(won[k]), leaf, a + k + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into two by two, its gain and the value of each cell."""
    best, values = 0.0, np.zeros(g.shape)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            blocks = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            won = sum(float(gain(g[b].sum(), h[b].sum())) for b in blocks) - float(gain(g.sum(), h.sum()))
            if won > best:
                best, values = won, np.zeros(g.shape)
                for b in blocks:
                    values[b] = -g[b].sum() / (h[b].sum() + SMOOTH)
    return best, values


class Additive:
    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.base, self.edges, self.tables, self.coarse, self.pairs = base, edges, tables, coarse, pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        for (a, b), grid in self.pairs.items():
            total += grid[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    k = len(FEATURES)
    if not len(y):
        return Additive(0.0, [np.zeros(0)] * k, [np.zeros(1)] * k, [np.zeros(0)] * k, {})
    edges, coarse = [edges_of(x[:, f], BINS) for f in range(k)], [edges_of(x[:, f], COARSE) for f in range(k)]
    bins = [np.searchsorted(edges[f], x[:, f], "right") for f in range(k)]
    wide = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = gradients()
            step = RATE * shallow_tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += step
            total += step[bins[f]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(wide[a] * shape[1] + wide[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    first = {p: quadrants(grid(*p, g), grid(*p, h))[0] for p in combinations(range(k), 2)}
    pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in sorted(first, key=first.get, reverse=True)[:PAIRS] if first[p] > 0}
    for _ in range(PAIR_ROUNDS):
        for (a, b), values in pairs.items():
            g, h = gradients()
            step = RATE * quadrants(grid(a, b, g), grid(a, b, h))[1]
            values += step
            total += step[wide[a], wide[b]]
    return Additive(base, edges, tables, coarse, pairs)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """A model from docs (doc_id, text) and labels (doc_id, quality); labels without an id, quality or document teach nothing.

    The sample is drawn from the labels by a cut of their hashes at the share that fits, so that about `sample` ids at most go to the documents' tasks and
    no text is shuffled. Of cuts and of pairs with equal gains, the first is taken. Labels that repeat count once; of documents with one id, that with the least features teaches.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    usable = usable.distinct()
    n = usable.count()
    cut = FINE if n <= sample else int(FINE * (sample - 4 * sample**0.5) / n)
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FINE)) < cut)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_features(rows, "doc_id", "y").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas()  # features, a row a label
    got = got.sort_values(["doc_id", "y"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text): the chance of quality 1, and whether it is at least a half.

    Null texts count as empty and are scored like any other; without any label every score is a half; repeated rows are
    repeated; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or b"") for t in batch.column(1)], np.float32).astype(np.float64).reshape(-1, len(FEATURES))
            s = held.value.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
