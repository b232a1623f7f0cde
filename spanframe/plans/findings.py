"""Checks as rows: every violated rule is a finding, a clean table yields none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["work_id", "rule_id", "entity_id", "source_id", "severity", "blocking", "deterministic", "evidence"]


def finding(
    df: DataFrame,
    rule: str | Column,
    when: Column,
    entity: Column | str,
    *,
    work: Column | str = "work_id",
    source: Column | str | None = None,
    severity: str | Column = "error",
    blocking: bool | Column = True,
    deterministic: bool = True,
    evidence: Column | None = None,
) -> DataFrame:
    def c(x):
        return F.col(x) if isinstance(x, str) else x

    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return df.where(when).select(
        c(work).cast("string").alias("work_id"),
        lit(rule).alias("rule_id"),
        c(entity).cast("string").alias("entity_id"),
        (F.lit(None) if source is None else c(source)).cast("string").alias("source_id"),
        lit(severity).alias("severity"),
        lit(blocking).alias("blocking"),
        F.lit(deterministic).alias("deterministic"),
        F.coalesce(evidence.cast("string") if evidence is not None else F.lit(""), F.lit("")).alias("evidence"),
    )


def checks(df: DataFrame, rules: list[tuple], **common) -> DataFrame:
    """Evaluate many row rules in one pass: ``rules`` holds (rule_id, condition)."""
    fired = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    rows = df.withColumn("__rule", F.explode(fired))
    return finding(rows, F.col("__rule"), F.lit(True), **common)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)


def fail_on_blocking(findings: DataFrame) -> None:
    """Raise when a blocking finding exists (reads at most one row)."""
    first = findings.where("blocking").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['rule_id']}: {first[0]['entity_id']}")
