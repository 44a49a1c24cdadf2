"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the whole text. Document frequencies are counted over all training documents. The
weights are fitted by follow-the-regularised-leader with elastic-net penalties on a bounded, documented sample of labelled
rows, and a temperature is then calibrated on rows of the sample that the fit did not see. Prediction is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-grams.
BUCKETS = 1 << 15
#: Code points taken at once; blocks overlap by two, so every n-gram of a text counts.
CHARS = 1 << 18
#: Labelled rows at most that the fit sees (a quarter of them calibrate), the lowest by a hash of the id within each label.
SAMPLE = 2000
#: Parts of the hash range, and rows of a label that are looked for beyond its share.
FINE, SPARE = 1 << 40, 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.0005, 4
UND = "und"

# Odd multipliers that spread the n-grams over the buckets.
SPREAD = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def counts(text: str) -> np.ndarray:
    """Occurrences of each n-gram bucket in the whole text, lowered."""
    total = np.zeros(BUCKETS, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), CHARS):
        p = points[at : at + CHARS + 2]
        first = min(CHARS, len(p))
        h = p * SPREAD[0]
        grams = [h[:first]]
        for k in (1, 2):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * SPREAD[k] + p[k:] * SPREAD[0]
            grams.append(h[:first])
        for g in grams:
            total += np.bincount(((g ^ (g >> np.uint32(13))) * SPREAD[1]) >> np.uint32(17), minlength=BUCKETS)
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket indexes and their TF-IDF values: log term frequency, unit length."""
    tf = counts(text)
    at = np.flatnonzero(tf)
    x = (1 + np.log(tf[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            df += counts(text.as_py()) > 0
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "n"])


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, for each bucket, of texts that have it; over all rows, summed map-side first."""
    sums = texts.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in sums:
        df[r.bucket] = r.n
    return int(df[BUCKETS]), df[:BUCKETS]


class FtrlSoftmax:
    """FTRL-proximal for a softmax over classes; L1 keeps weights at zero until their gradient earns them."""

    def __init__(self, classes: int, features: int):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.labels, self.temperature = labels, temperature
        self.idf, self.weights = idf.astype(np.float32), weights.astype(np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UND, 0.0
        at, x = vector(text, self.idf)
        p = softmax((x @ self.weights[at]).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def fit(rows: list[tuple[str, str]], n: int, df: np.ndarray) -> Model:
    """rows: (text, label) in an order that does not depend on the label."""
    labels = sorted({label for _, label in rows})
    idf = np.log((1 + n) / (1 + df)) + 1
    if len(labels) < 2:
        return Model(labels, idf, np.zeros((BUCKETS, max(1, len(labels)))), 1.0)
    seen = [(*vector(text, idf), labels.index(label)) for text, label in rows]
    # the fit takes three of four rows; few rows are used for both
    train, rest = ([s for k, s in enumerate(seen) if k % 4], seen[::4]) if len(seen) >= 8 * len(labels) else (seen, seen)
    model, rng = FtrlSoftmax(len(labels), BUCKETS), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(train)):
            model.learn(*train[k])
    w = model.weights()
    scores = np.array([x @ w[at] for at, x, _ in rest])
    truth = np.array([y for *_, y in rest])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    temperature = min(np.geomspace(0.2, 20, 121), key=loss)
    return Model(labels, idf, w, float(temperature))


def sample_of(training: DataFrame, label: Column, size: int) -> list[tuple[str, str]]:
    """About `size` (text, label) rows at most, shared among the labels (one of each at least), the lowest by a hash of id and text; rows that repeat
    count once, also in the counts of the labels, which say below which hash enough rows lie, so that one more pass finds them."""
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(FINE))
    rows = training.select(F.col("text"), label.alias("label"), order.alias("o"))
    sizes = {r.label: r["count"] for r in rows.select("label", "o").distinct().groupBy("label").count().collect()}
    if not sizes:
        return []
    each = max(1, size // len(sizes))
    cuts = [(k, FINE if n <= each + SPARE else int(FINE * (each + SPARE + 4 * (each + SPARE) ** 0.5) / n)) for k, n in sizes.items()]
    below = training.sparkSession.createDataFrame(cuts, "label string, cut long")
    found = rows.join(F.broadcast(below), "label").where("o < cut").groupBy("label", "o").agg(F.min("text").alias("text"))  # a row a label is broadcast
    out, taken = [], {}
    for r in sorted(found.collect(), key=lambda r: (r.o, r.label)):
        taken[r.label] = taken.get(r.label, 0) + 1
        if taken[r.label] <= each:
            out.append((r.text, r.label))
    return out


def trained(training: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from training (doc_id, text, lang); other columns are ignored. Rows with null text or lang, or without a letter, teach nothing; rows
    that repeat id and text are one row of the sample; null ids are one id; of rows that tie in the sample's hash the least text is taken."""
    usable = training.where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    n, df = document_frequencies(usable.select("text"))
    return fit(sample_of(usable, F.col("lang"), sample), n, df)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text).

    `und` with score 0 where the text is null or has no letter, or where nothing could be learned; repeated rows are repeated;
    an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.predict(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
