"""The inverted index: blocks, postings, verified generations."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FOLDING, tokens
from .storage import dropped, shared_root, written


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, block_id, text): the non-blank lines of documents."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where(F.length(F.trim("text")) > 0)
    return lines.select("doc_id", "ordinal", F.format_string("%d-b%04d", "doc_id", "ordinal").alias("block_id"), "text")


def postings(blocks: DataFrame, only: list[str] | None = None, lengths: bool = False) -> DataFrame:
    """(term, block_id, tf), and the length of the block on request, of the terms in `only` if given. Terms are counted inside each block, so rows are final before any shuffle."""
    terms = tokens(F.col("text"))
    keep = ["block_id", *(["length"] if lengths else [])]
    sorted_terms = blocks.withColumn("length", F.length("text").cast("long")).select(*keep, F.sort_array(terms if only is None else F.filter(terms, lambda t: t.isin(only))).alias("terms"))
    ends = sorted_terms.select("*", _ends(F.col("terms")).alias("ends"))  # a step of its own, so that lambdas read a column and compute nothing again
    counted = ends.select(*keep, F.explode(_frequencies(F.col("terms"), F.col("ends"))).alias("p"))
    return counted.select(F.col("p.term").alias("term"), "block_id", F.col("p.tf").alias("tf"), *keep[1:])


def _ends(ordered):
    """Places where a run of equal values ends in a sorted array."""
    last = F.transform(ordered, lambda t, i: F.when(~t.eqNullSafe(F.get(ordered, i + 1)), i))
    return F.filter(last, lambda i: i.isNotNull())


def _frequencies(ordered, ends):
    """Runs of a sorted array as (term, tf)."""
    return F.transform(ends, lambda e, k: F.struct(F.get(ordered, e).alias("term"), (e - F.coalesce(F.get(ends, k - 1), F.lit(-1))).cast("long").alias("tf")))


def block_terms(blocks: DataFrame) -> DataFrame:
    """(block_id, terms, length): distinct terms and characters of each block."""
    return blocks.select("block_id", F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("terms"), F.length("text").cast("long").alias("length"))


def term_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


#: Digests that are gathered into one row.
FAN = 1024


def digest_of(rows: DataFrame, key: str, digest: str) -> str:
    """One digest of all rows (key, digest) in no matter what order they come: rows are dealt by their key to groups of about FAN, each group's digests are joined in the
    order of its keys, and so on up, so that no row gathers more than a group."""
    level, n = rows.select(F.col(key).cast("string").alias("k"), F.col(digest).alias("d")), rows.count()
    while n > FAN:
        n = -(-n // FAN)
        level = level.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).cast("string").alias("k2")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda s: s["d"]), "\n"), 256).alias("d")).withColumnRenamed("k2", "k")
    return hashlib.sha256("\n".join(d for _, d in sorted((r.k, r.d) for r in level.collect())).encode()).hexdigest()  # FAN rows at most


def manifest_of(blocks: DataFrame) -> str:
    """Identity of a generation: of policy, folding, and the ordered digests of the blocks, combined per document first."""
    line = F.concat_ws(":", "block_id", F.sha2("text", 256))
    per_doc = blocks.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda s: s["line"]), "\n"), 256).alias("d"))
    per_doc = written(per_doc)
    whole = hashlib.sha256("\0".join(["1", FOLDING, digest_of(per_doc, "doc_id", "d")]).encode()).hexdigest()
    dropped(per_doc)
    return f"gen-{whole[:24]}"


#: Blocks for which the index gets another bucket of terms, buckets at most, and postings for which each bucket gets another file.
BLOCKS_A_BUCKET, MOST_BUCKETS, POSTINGS_A_FILE = 100_000, 64, 500_000


def session_store(spark: SparkSession, name: str) -> IndexStore:
    """The store of this application under a name, in the shared folder; in local mode a temporary folder will do."""
    store = IndexStore(spark, f"{shared_root(spark)}/stratafolio-index-{spark.sparkContext.applicationId}/{hashlib.sha256(name.encode()).hexdigest()[:16]}")
    store.fs.deleteOnExit(store._path(""))
    return store


class IndexStore:
    """Generations under a root: each is a directory of Parquet, written, verified, and then named by one pointer file.

    A generation that fails verification or a crashed write never becomes active; the previous one stays readable.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def pointer(self) -> dict | None:
        """The active generation, and the state of the source that it was made of."""
        if not self.fs.exists(self._path("active.json")):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/active.json").collect()))

    def active(self) -> str | None:
        pointer = self.pointer()
        return pointer and pointer["generation"]

    def build(self, blocks: DataFrame, term_buckets: int | None = None, source: str | None = None) -> tuple[str, bool]:
        """The generation of these blocks, and whether it was built now. It is bound to the state of its source, if one is given.

        Terms are dealt to buckets, and each bucket, by block, to as many files as the postings ask for, so that neither a task nor a very
        frequent term grows with the corpus. Postings carry their block's length, and the sizes of the whole are kept with them.
        """
        generation = manifest_of(blocks)
        pointer = self.pointer() or {}
        if pointer.get("generation") == generation:
            if pointer.get("source") != source:
                self.activate(generation, source)
            return generation, False
        place = f"{self.root}/{generation}"
        self.fs.delete(self._path(generation), True)  # residue of a crash
        blocks.select("doc_id", "block_id", F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("terms"), F.length("text").cast("long").alias("length")).write.parquet(f"{place}/blocks")
        wrote = self.spark.read.parquet(f"{place}/blocks").agg(F.count("*").alias("n"), F.sum("terms").alias("t"), F.avg("length").alias("avg")).first()
        buckets = term_buckets or min(MOST_BUCKETS, max(16, wrote.n // BLOCKS_A_BUCKET))
        files = 1 + (wrote.t or 0) // (buckets * POSTINGS_A_FILE)
        index = postings(blocks, lengths=True).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        dealt = index.repartitionById(buckets * files, (F.col("bucket") * files + F.pmod(F.xxhash64("block_id"), F.lit(files))).cast("int"))  # a file a task, so no task sorts two
        dealt.sortWithinPartitions("bucket", "term", "block_id").write.partitionBy("bucket").parquet(f"{place}/postings")
        self.spark.createDataFrame([(buckets, wrote.n, float(wrote.avg or 0.0))], "buckets int, n long, avg double").coalesce(1).write.parquet(f"{place}/sizes")
        rows = self.spark.read.parquet(f"{place}/postings").count()
        if rows != (wrote.t or 0):
            raise RuntimeError(f"{generation}: {rows} postings, {wrote.t} expected")
        self.activate(generation, source)
        return generation, True

    def activate(self, generation: str, source: str | None = None) -> None:
        draft = self._path(f"active-{uuid.uuid4().hex}.json")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps({"generation": generation, "source": source}).encode()))
        out.close()
        target = self._path("active.json")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(draft, target, options)

    def sizes(self, generation: str):
        """(buckets, n, avg): what the generation was built with, one row."""
        return self.spark.read.parquet(f"{self.root}/{generation}/sizes").first()

    def postings(self, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation}/postings").drop("bucket")

    def postings_of(self, terms: list[str], generation: str) -> DataFrame:
        """Only the buckets and terms of a query are read."""
        term_buckets = self.sizes(generation).buckets
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(term_buckets)).cast("int")).distinct().collect()
        return self.spark.read.parquet(f"{self.root}/{generation}/postings").where(F.col("bucket").isin([r[0] for r in rows]) & F.col("term").isin(terms)).drop("bucket")

    def postings_with(self, terms: DataFrame, generation: str) -> DataFrame:
        """The postings in the buckets of terms (term), of which no more numbers come to the driver than there are buckets; a join must still pick the terms."""
        n = self.sizes(generation).buckets
        wanted = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).distinct().collect()]
        every = self.spark.read.parquet(f"{self.root}/{generation}/postings")
        return (every if len(wanted) == n else every.where(F.col("bucket").isin(wanted))).drop("bucket")

    def blocks(self, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{generation}/blocks")
