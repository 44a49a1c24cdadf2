"""Ordered folds: what depends on everything before it in the order of a key, for which a window has no function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def folded(rows: DataFrame, keys: list[str], order: list[str], result: str, start: Callable[[], object], step: Callable[[object, tuple], tuple]) -> DataFrame:
    """One result row for each of rows: the keys, then what step(state, row) returns for the row's other columns, in the order of the
    keys' rows. start() gives a key's first state, which step changes.

    Keys are dealt to partitions and streamed through sorted, so that memory holds one key's state and never a key's rows; what
    decides in sequence is one task's work for each key. Null keys are a key.
    """
    spark = rows.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], result).schema)
    n, rest = len(keys), [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in [*keys, *rest])):
                if row[:n] != key:
                    key, state = row[:n], start()
                out.append((*row[:n], *step(state, row[n:])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, result)
