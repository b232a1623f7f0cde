"""Sequential folds over the ordered rows of a key, streamed: a state and a batch in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold_ordered(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], tuple | None]) -> DataFrame:
    """Runs ``step(state, row)`` over each key's rows in ``order``; what it returns is a row.

    For folds whose next state depends on all earlier decisions, so that no prefix sum
    or jump table exists.  Keys are spread by hash and their rows sorted by Spark; a task
    holds one batch and one state, whose size is the step's concern.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != at:
                    at, state = key, start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
