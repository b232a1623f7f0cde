"""UF3: the operators' results as temporary views for ``spark.sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, name: str, op: Callable[..., DataFrame | tuple], *tables: str | DataFrame, part: int = 0, **params) -> DataFrame:
    """Create view ``name`` over ``op`` applied to views or DataFrames.

    ``part`` picks one result of operators that return several.  The view is lazy: the
    operator's plan is inlined into each query that uses it.

        register(spark, "islands", intervals.merge_spans, "spans", keys=["source_id"])
        spark.sql("SELECT source_id, sum(end_us - start_us) FROM islands GROUP BY 1")
    """
    args = [spark.table(t) if isinstance(t, str) else t for t in tables]
    out = op(*args, **params)
    df = out[part] if isinstance(out, tuple) else out
    df.createOrReplaceTempView(name)
    return df
