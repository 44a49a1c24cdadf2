"""The folder that driver and executors share, and intermediates written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The configured shared folder; in local mode, where driver and executors are one process, a temporary one will do."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir()
    return root.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, so a lost executor costs no recomputation. The files go
    when the application ends, or by dropped()."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stratafolio-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place, files = _place(df.sparkSession, path)
            files.delete(place, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time) of every file under path, in order of the names."""
    place, files = _place(spark, path)
    found, out = files.listFiles(place, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def stored(df: DataFrame, format: str = "parquet", **options) -> str:
    """The place of df's files in the shared folder, in a format of Spark's; they go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stratafolio-files-{uuid.uuid4().hex}"
    df.write.options(**options).format(format).save(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return path


#: Rows of a task in what is dealt().
ROWS_A_TASK = 200_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key, in as many parts as its rows ask for, so that what follows by this key takes more tasks, not larger ones, as the rows grow. Few rows stay as they are."""
    spark = df.sparkSession
    parts = df.count() // ROWS_A_TASK
    if parts <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
