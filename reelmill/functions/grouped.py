"""Passes by order over many small groups: rows stream sorted by group, with no frame a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def by_group(rows: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """rows (keys first) -> what run gives for each group's rows, tuples in order. A task holds one group and one batch."""
    n = len(keys)
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != now:
                    if held:
                        out += run(held)
                    now, held = row[:n], []
                held.append(row)
            yield batch_of(out)
        if held:
            yield batch_of(run(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)
