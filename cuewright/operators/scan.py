"""Ordered scans: state that passes from row to row of a key, in one pass over sorted partitions and constant memory.

For steps whose result depends on what earlier rows of the key have become, so that no window can say it. Rows of
a key are never gathered: Spark sorts (and spills), Arrow batches pass through, only the state is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..shipping import ship


#: Rows that a task has as Python objects at once.
ROWS = 256


class State(Protocol):
    def feed(self, row: dict) -> Iterable[tuple]: ...

    def close(self) -> Iterable[tuple]: ...


def scan(df: DataFrame, key: list[str], order: list[str], begin: Callable[[], State], schema: str) -> DataFrame:
    """Rows that states give; begin() makes the state of a new key, feed takes its rows in order, close ends it."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, None
        out: list[tuple] = []
        for whole in batches:
            for some in range(0, whole.num_rows, ROWS):
                for row in whole.slice(some, ROWS).to_pylist():
                    here = tuple(row[k] for k in key)
                    if state is None or here != at:
                        out += state.close() if state is not None else ()
                        state, at = begin(), here
                    out += state.feed(row)
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], arrow)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in state.close()], arrow)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
