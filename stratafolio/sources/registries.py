"""Registries of what a caller may bring along: source adapters, OCR engines, embedding providers, retrievers; and read-only stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import hashed_vector
from .files import read_archive, read_export


class Registry:
    """Named things of one kind; an unknown name is an error that lists the known ones."""

    def __init__(self, kind: str, **known):
        self.kind, self.known = kind, dict(known)

    def register(self, name: str, thing) -> None:
        self.known[name] = thing

    def __getitem__(self, name: str):
        if name not in self.known:
            raise LookupError(f"unknown {self.kind} {name!r}; there are {sorted(self.known)}")
        return self.known[name]


ADAPTERS = Registry("adapter", reports_archive=read_archive, jsonl_export=read_export)
#: Functions of an image's bytes to (text, confidence); they run in the tasks.
ENGINES = Registry("OCR engine")
#: Column factories: text to a vector.
EMBEDDERS = Registry("embedding provider", mock=hashed_vector)
#: Functions of (queries: query_id, query; blocks: block_id, text; k) to hits (query_id, rank, block_id).
RETRIEVERS = Registry("retriever")
#: Functions of a prompt to an answer; they run in the tasks. An error whose `retryable` is true may be tried again.
PROVIDERS = Registry("provider")


READ = "struct<ocr_text:string,confidence:double,failed:boolean>"


def _read_by(engine: Callable[[bytes], tuple[str, float]]) -> Callable[[Column], Column]:
    kind = pa.struct([("ocr_text", pa.string()), ("confidence", pa.float64()), ("failed", pa.bool_())])

    def one(image: bytes | None) -> dict:
        try:
            text, confidence = engine(image or b"")
            return {"ocr_text": text, "confidence": confidence, "failed": False}
        except Exception:  # an engine's error is the page's state
            return {"ocr_text": None, "confidence": None, "failed": True}

    def run(images: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in images:
            yield pa.array([one(x.as_py()) for x in batch], kind)

    run.__annotations__ = {"images": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lambda image: F.arrow_udf(run, READ)(image)


def recognised(images: DataFrame, keys: list[str], image: str, engine: str, fallback: str | None = None, fallback_below: float = 0.0) -> DataFrame:
    """keys, ocr_text, confidence, failed, fallback_text and fallback_confidence of images by registered engines; the fallback is asked only
    where the first found nothing or was less sure than `fallback_below`, and where it fails there is none."""
    read = images.select(*keys, image, _read_by(ENGINES[engine])(F.col(image)).alias("r")).select(*keys, image, "r.*")
    if fallback is None:
        return read.select(*keys, "ocr_text", "confidence", "failed", F.lit(None).cast("string").alias("fallback_text"), F.lit(None).cast("double").alias("fallback_confidence"))
    unsure = ~F.col("failed") & (F.coalesce(~F.col("ocr_text").rlike(r"(?U)\S"), F.lit(True)) | (F.col("confidence") < fallback_below))
    asked = read.where(unsure).withColumn("f", _read_by(ENGINES[fallback])(F.col(image)))
    both = asked.unionByName(read.where(~unsure | unsure.isNull()), allowMissingColumns=True)
    return both.select(*keys, "ocr_text", "confidence", "failed", F.col("f.ocr_text").alias("fallback_text"), F.col("f.confidence").alias("fallback_confidence"))


def image_blocks(images: DataFrame, keys: list[str], image: str, engine: str, least_confidence: float = 0.6) -> DataFrame:
    """keys, text, confidence, status and issue of images as one block each: ready, or review where the engine failed, found nothing or was not sure."""
    read = recognised(images, keys, image, engine)
    blank = F.coalesce(~F.col("ocr_text").rlike(r"(?U)\S"), F.lit(True))
    issue = F.when(F.col("failed"), "ocr_failed").when(blank, "ocr_no_text").when(F.col("confidence") < least_confidence, "ocr_low_confidence")
    return read.select(*keys, F.coalesce("ocr_text", F.lit("")).alias("text"), "confidence", F.when(issue.isNull(), "ready").otherwise("review").alias("status"), issue.alias("issue"))


def build_adapter(spark: SparkSession, config: dict) -> Callable[[], DataFrame]:
    """The reader of a source by its configured type; what else is configured goes to it."""
    adapter = ADAPTERS[config["type"]]
    rest = {k: v for k, v in config.items() if k != "type"}
    return lambda: adapter(spark, **rest)


class ReadOnlyStore:
    """Tables of a folder that are read and never created; one that is missing is refused at once."""

    def __init__(self, spark: SparkSession, root: str, required: tuple[str, ...]):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.root)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            raise FileNotFoundError(f"missing_file: {root}; a read-only view never creates it")
        self.tables = {str(s.getPath().getName()).removesuffix(".parquet") for s in files.listStatus(place)}
        if missing := [t for t in required if t not in self.tables]:
            raise ValueError(f"unsupported_schema: {root} lacks {', '.join(missing)}; a read-only view doesn't add them")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.__dict__.get("tables", ()):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def completed(prompts: DataFrame, keys: list[str], prompt: str, provider: str, egress_allowed: bool = False, attempts: int = 2) -> DataFrame:
    """keys, answer, error and attempts of prompts by a registered provider. Without permission nothing is sent: that is an error before any task runs, since
    a configured provider is no permission. A retryable failure is tried again, `attempts` times in all; what fails in the end is a row with its error."""
    if not egress_allowed:
        raise PermissionError(f"provider {provider!r} has egress_allowed=false; refusing to send")
    ask = PROVIDERS[provider]
    kind = pa.struct([("answer", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])

    def one(text: str | None) -> dict:
        for n in range(1, max(1, attempts) + 1):
            try:
                return {"answer": ask(text or ""), "error": None, "attempts": n}
            except Exception as failure:
                error = f"{type(failure).__name__}: {failure}"
                if not getattr(failure, "retryable", False):
                    break
        return {"answer": None, "error": error, "attempts": n}

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([one(t) for t in batch.to_pylist()], kind)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    answered = F.arrow_udf(run, "struct<answer:string,error:string,attempts:int>")(F.col(prompt))
    return prompts.select(*keys, answered.alias("r")).select(*keys, "r.*")


def retrieved(queries: DataFrame, blocks: DataFrame, retriever: str, k: int, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run_id, rank, block_id, text: what a registered retriever finds for queries (query_id, query) among blocks (block_id, text), best k each, as evidence of runs. Its hits are ids only: texts are
    read anew and pass the gate, so a stale retriever can't show what consumers may not see; ranks are given anew to what is left, ids that aren't there are dropped."""
    from ..operators.retrieval import top

    hits = RETRIEVERS[retriever](queries, blocks, k).select("query_id", F.col("rank").alias("_rank"), "block_id").dropDuplicates(["query_id", "block_id"])
    present = gate(blocks.join(hits.select("block_id").distinct(), "block_id", "left_semi")).select("block_id", "text")
    return top(hits.join(present, "block_id"), ["query_id"], k, F.col("_rank"), F.col("block_id")).select(F.col("query_id").alias("run_id"), "rank", "block_id", "text")


def filled_embeddings(cache: DataFrame, wanted: DataFrame, provider: str, dimensions: int, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """cache (text_sha, provider, vector) with vectors of the wanted texts (text) that the provider has not embedded yet. A vector of another
    length than `dimensions` is an error when it is read."""
    embed = of or EMBEDDERS[provider]
    need = wanted.select(F.sha2("text", 256).alias("text_sha"), "text").dropDuplicates(["text_sha"]).join(cache.where(F.col("provider") == provider), "text_sha", "left_anti")
    checked = F.when(F.size("v") == dimensions, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size("v").cast("string"))))
    fresh = need.select("text_sha", F.lit(provider).alias("provider"), embed(F.col("text")).alias("v")).select("text_sha", "provider", checked.alias("vector"))
    return cache.select("text_sha", "provider", "vector").unionByName(fresh)
