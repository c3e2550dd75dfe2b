"""Character classes and batch helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Unicode White_Space (fixed values), as the inside of a character class.
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A mark-up tag.
TAG = r"<[/!?|A-Za-z][^<>]*>"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Tables that lie in fewer pieces than there are cores are dealt out by key before costly Python; larger ones
    are read as they lie, without a shuffle. df must be a plain scan or projection of one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def by_rows(emit: Callable[[object, object], Iterator[tuple]], schema: pa.Schema, batch_rows: int = 50_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function over (id, value) batches: emit's tuples, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in schema]
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                for row in emit(key, value.as_py()):
                    for c, x in zip(cols, row):
                        c.append(x)
                if len(cols[0]) >= batch_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run
