"""Interval joins as equi joins on time bins.

Spark plans a bare range predicate as a nested-loop join.  Here every span is laid
on bins of fixed width and the join runs on ``(keys, level, bin)``; the exact
predicate is a residual.  A pair is kept only in the bin that holds the later of
the two starts, so no ``distinct`` is needed.

Spans longer than ``FAN`` bins live on a coarser level (width ``FAN`` times larger),
so no span is copied more than ``FAN + 1`` times on a level but the last.  A pair meets on
the coarser of the two levels.  Where skew is measured (``plans.skew``), there are as many
levels as the longest span asks for, so that holds on the last one too, and hot bins are
dealt over salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.clock import floor_div
from spanframe.plans.skew import bucket_counts, hot_rows, measures, salted

BIN_US = 30_000_000
FAN = 64


def _laid(df: DataFrame, start: str, end: str, bin_us: int, levels: int, closed: bool, tag: str) -> DataFrame:
    """One row per (level, bin) the span touches, at its own level and coarser ones."""
    widths = [bin_us * FAN**i for i in range(levels)]
    length = F.col(end) - F.col(start)
    home = F.lit(levels - 1)
    for i in range(levels - 2, -1, -1):
        home = F.when(length <= F.lit(widths[i] * FAN), F.lit(i)).otherwise(home)
    last = F.col(end) if closed else F.greatest(F.col(start), F.col(end) - 1)

    def slots(i):
        w = F.lit(widths[i]).cast("bigint")
        return F.transform(
            F.sequence(floor_div(F.col(start), w), floor_div(last, w)),
            lambda b: F.struct(F.lit(i).alias("level"), b.alias("bin")),
        )

    none = F.array().cast("array<struct<level:int,bin:bigint>>")
    lists = [F.when(F.col(f"__home_{tag}") <= i, slots(i)).otherwise(none) for i in range(levels)]
    laid = df.withColumn(f"__home_{tag}", home)
    return laid.withColumn("__slot", F.explode(F.concat(*lists) if levels > 1 else slots(0))).select(
        "*", F.col("__slot.level").alias("__level"), F.col("__slot.bin").alias("__bin")
    ).drop("__slot")


def _measured(a: DataFrame, b: DataFrame, keys: list[str], spans: list[tuple[str, str]], bin_us: int, levels: int, closed: bool) -> tuple[int, int]:
    """Levels the longest span asks for, and a bound on the rows of one side in a bin, in one job.

    Only if a span does not fit ``levels`` the job runs again with more of them.  A stream
    cannot be counted before it runs; its side is left out.
    """
    sides = [(df, span) for df, span in zip((a, b), spans) if not df.isStreaming]
    while sides:
        cap = bin_us * FAN**levels
        parts = []
        for df, (lo, hi) in sides:
            rows = df.select(*keys, F.col(lo).alias("__lo"), F.least(F.col(hi), F.col(lo) + F.lit(cap).cast("bigint")).alias("__hi"), (F.col(hi) - F.col(lo)).alias("__len"))
            counts = bucket_counts(_laid(rows, "__lo", "__hi", bin_us, levels, closed, "m"), [*keys, "__level", "__bin"], F.max("__len").alias("__len"))
            parts.append(counts.agg(F.max("__len").alias("len"), F.max("__n").alias("n")))
        found = reduce(DataFrame.unionByName, parts).agg(F.max("len").alias("len"), F.max("n").alias("n")).first()
        if (found.len or 0) <= cap:
            return levels, found.n or 0
        while found.len > bin_us * FAN**levels:
            levels += 1
    return levels, 0


def interval_join(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    how: str = "inner",
    a_span: tuple[str, str] = ("start_us", "end_us"),
    b_span: tuple[str, str] = ("b_start_us", "b_end_us"),
    *,
    closed: bool = False,
    bin_us: int = BIN_US,
    levels: int = 2,
    salt: int = 1,
    where: Column | None = None,
    counted: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Pairs of rows with equal keys whose spans overlap.

    Half-open spans that only touch do not overlap; with ``closed=True`` they do.
    ``how`` is ``inner``, ``left_semi`` or ``left_anti`` (row-preserving variants
    need a row id on ``a``; use :func:`overlap_flag`).  Column names other than the
    keys must differ between the sides.  ``salt`` > 1 spreads every bin without measuring: ``a``
    is dealt over ``salt`` slots and ``b`` is copied to each.  ``counted`` are tables with the same
    keys and spans as the sides that cost less to measure.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    (a0, a1), (b0, b1) = a_span, b_span
    on = [*keys, "__level", "__bin"]
    hot = False
    if measures(a.sparkSession):
        levels, most = _measured(*(counted or (a, b)), keys, [a_span, b_span], bin_us, levels, closed)
        hot = most > hot_rows(a.sparkSession) and not (a.isStreaming or b.isStreaming)
    la = _laid(a, a0, a1, bin_us, levels, closed, "a")
    lb = _laid(b, b0, b1, bin_us, levels, closed, "b")
    if salt > 1:
        la = la.withColumn("__salt", F.pmod(F.xxhash64(*a.columns), F.lit(salt)).cast("int"))
        lb = lb.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("__salt")
    elif hot:
        la, lb, on = salted(la, lb, on, [F.col(c) for c in a.columns], [F.col(c) for c in b.columns])
    pairs = la.join(lb, on, "inner")
    width = F.lit(bin_us).cast("bigint")
    for i in range(1, levels):
        width = F.when(F.col("__level") == i, F.lit(bin_us * FAN**i).cast("bigint")).otherwise(width)
    if closed:
        hit = (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))
    else:
        hit = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    hit = hit & (F.col("__level") == F.greatest(F.col("__home_a"), F.col("__home_b")))
    hit = hit & (F.col("__bin") == floor_div(F.greatest(F.col(a0), F.col(b0)), width))
    if where is not None:
        hit = hit & where
    pairs = pairs.where(hit)
    out = [*[F.col(k) for k in keys], *[F.col(c) for c in a.columns if c not in keys]]
    if how == "inner":
        return pairs.select(*out, *[F.col(c) for c in b.columns if c not in keys])
    ids = pairs.select(*a.columns).distinct()
    return a.join(ids, a.columns, how)


def overlap_flag(a: DataFrame, b: DataFrame, keys: list[str], id_cols: list[str], flag: str = "hit", **kw) -> DataFrame:
    """``a`` with a boolean telling whether any row of ``b`` overlaps it."""
    hits = interval_join(a, b, keys, **kw).select(*keys, *id_cols).distinct().withColumn(flag, F.lit(True))
    return a.join(hits, [*keys, *id_cols], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Rename all non-key columns so that two tables can meet in one join."""
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])
