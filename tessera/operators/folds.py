"""State machines over sorted events, one key after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def sorted_fold(rows: DataFrame, key: str, order: list[str], step: Callable[[Any, tuple], tuple[Any, tuple]], schema: StructType) -> DataFrame:
    """The rows that ``step(state, row) -> (state, outcome)`` gives for each row of a key in ``order``; a key starts with None.

    ``row`` has the columns of ``rows`` in their order. Keys are dealt by hash and sorted in their partition, so a task
    holds one key's state and one batch of rows, however many rows a key has. Null keys are one key.
    """
    columns, at = rows.columns, rows.columns.index(key)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, last, state = False, None, None
        for b in batches:
            told = []
            # Python's own whole numbers and nulls: pandas would turn a long beside a null into a double.
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if not started or row[at] != last:
                    started, last, state = True, row[at], None
                state, outcome = step(state, row)
                told.append(outcome)
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], type=f.type) for i, f in enumerate(target)], schema=target)

    return rows.select(columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
