"""Sequential rules over rows in order: where a new run begins, told row by row with a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .intervals import Keys


def fold_heads(df: DataFrame, group: Keys, order: Keys, columns: Keys, step: Callable[[tuple, tuple], tuple | None], first: Callable[[tuple], tuple] = tuple, out: str = "run") -> DataFrame:
    """df with `out`, the number of the run (from 0 in each group) that each row belongs to, in order.

    first(values of columns) is the state of a row that begins a run; step(state, values) is the new state if the row
    goes on with the run, None if it begins one. Rows stream through sorted partitions with one state, so memory does
    not follow the size of a group; results of a run come from a groupBy after it.
    """
    kinds = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, number = None, None, 0
        for batch in batches:
            numbers = []
            keys = zip(*[batch.column(c).to_pylist() for c in group], strict=True)
            for k, x in zip(keys, zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True):
                new = step(state, x) if k == key else None
                if k != key:
                    key, number = k, 0
                elif new is None:
                    number += 1
                state = first(x) if new is None else new
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, out])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*kinds.fields]).add(out, LongType())
    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
