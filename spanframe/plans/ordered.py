"""Ordered scans that do not put a whole key into one task.

A plain window ``partitionBy(key)`` sends every row of a key to one task, which
fails when one key holds a large share of the table.  ``scan`` splits each key into
ordered *blocks*, runs the window inside ``(key, block)`` and adds what the blocks
before (or after) contribute.  Rows are shuffled once by ``(key, block)``; the block
summary (one row per block) is aggregated from that same shuffle, and only its ordered
pass is per key.  Blocks that hold too many rows are cut further (``plans.skew``).  Where
the rows per key are measured and every key fits a task, ``scan`` is the plain window:
one shuffle by the keys, none if the rows already lie by them.

``block`` must be a column that never decreases in the scan order, for example
``pos div 4096`` or ``start_us div 3600000000``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanframe.functions.clock import col, floor_div
from spanframe.plans.skew import crowded, cut_blocks, measures

BLOCK_ROWS = 65_536
BLOCK_US = 6 * 3_600_000_000


def by_rows(pos, rows: int = BLOCK_ROWS) -> Column:
    return floor_div(col(pos).cast("bigint"), F.lit(rows).cast("bigint"))


def by_time(t_us, width_us: int = BLOCK_US) -> Column:
    return floor_div(col(t_us).cast("bigint"), F.lit(width_us).cast("bigint"))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` with all its columns kept: a branch of a plan that must stay equal to its
    sibling, so that both read one shuffle instead of computing their input twice.

    The condition always holds (the first part does); the second makes the optimizer
    leave it where it is.
    """
    low = F.lit(-(2**63)).cast("bigint")
    return df.where((F.xxhash64(*df.columns) >= low) | (F.spark_partition_id() < -1))


def lying(df: DataFrame, keys: list[str]) -> DataFrame:
    """A stored table shuffled once by ``keys``, with all its columns, for all its readers.

    Joins, groups and windows by ``keys`` and more then need no shuffle of their own.  For joins Spark
    must be told to accept that: a setting of the session, which changes plans and no results.  ``stored``
    of the result is the table itself, on which rows are counted without a shuffle.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    out = pinned(df.repartition(*keys))
    out.stored = df
    return out


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    *,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    mins_after: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    within: DataFrame | None = None,
    fits: bool = False,
) -> DataFrame:
    """Add running columns per key in ``order`` (ascending, total).

    sums        inclusive prefix sum (BIGINT)
    maxes       max over all earlier rows, NULL on the first
    mins_after  min over all later rows, NULL on the last
    lags/leads  value of the previous / next row
    within      a table with no fewer rows of any key that costs less to count than ``df``
    fits        the caller has counted: every key fits a task
    """
    sums, maxes, mins_after = sums or {}, maxes or {}, mins_after or {}
    lags, leads = lags or {}, leads or {}
    if keys and measures(df.sparkSession) and (fits or not crowded(df if within is None else within, keys)):
        return _windows(df, keys, order, sums, maxes, mins_after, lags, leads)
    blk = "__block"
    src = cut_blocks(df.withColumn(blk, block), keys, blk, order[0]).repartition(*keys, blk)
    inner = Window.partitionBy(*keys, blk).orderBy(*order)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    # a frame that ends at the last row is quadratic in Spark, so look back in reverse
    reverse = Window.partitionBy(*keys, blk).orderBy(*[F.col(o).desc() for o in order])
    after = reverse.rowsBetween(Window.unboundedPreceding, -1)
    local, summary, carry = [], [], []
    across = Window.partitionBy(*keys).orderBy(blk)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(blk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    rank = F.struct(*[F.col(o) for o in order])
    zero = F.lit(0).cast("bigint")
    for n, e in sums.items():
        local.append(F.sum(e).over(upto).alias(f"__l_{n}"))
        summary.append(F.sum(e).alias(f"__s_{n}"))
        carry.append(F.sum(f"__s_{n}").over(earlier).alias(f"__c_{n}"))
        out[n] = (F.coalesce(F.col(f"__l_{n}"), zero) + F.coalesce(F.col(f"__c_{n}"), zero)).cast("bigint")
    for n, e in maxes.items():
        local.append(F.max(e).over(before).alias(f"__l_{n}"))
        summary.append(F.max(e).alias(f"__s_{n}"))
        carry.append(F.max(f"__s_{n}").over(earlier).alias(f"__c_{n}"))
        out[n] = F.greatest(F.col(f"__l_{n}"), F.col(f"__c_{n}"))
    for n, e in mins_after.items():
        local.append(F.min(e).over(after).alias(f"__l_{n}"))
        summary.append(F.min(e).alias(f"__s_{n}"))
        carry.append(F.min(f"__s_{n}").over(later).alias(f"__c_{n}"))
        out[n] = F.least(F.col(f"__l_{n}"), F.col(f"__c_{n}"))
    for n, e in lags.items():
        boxed = F.struct(e.alias("v"))
        local.append(F.lag(boxed).over(inner).alias(f"__l_{n}"))
        summary.append(F.max_by(boxed, rank).alias(f"__s_{n}"))
        carry.append(F.lag(f"__s_{n}").over(across).alias(f"__c_{n}"))
        out[n] = F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}"))["v"]
    for n, e in leads.items():
        boxed = F.struct(e.alias("v"))
        local.append(F.lead(boxed).over(inner).alias(f"__l_{n}"))
        summary.append(F.min_by(boxed, rank).alias(f"__s_{n}"))
        carry.append(F.lead(f"__s_{n}").over(across).alias(f"__c_{n}"))
        out[n] = F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}"))["v"]
    blocks = pinned(src).groupBy(*keys, blk).agg(*summary)
    # keys with a single block need no carry row; this keeps the join side tiny
    carried = (
        blocks.select(*keys, blk, *carry, F.lag(blk).over(across).alias("__p"), F.lead(blk).over(across).alias("__q"))
        .where(F.col("__p").isNotNull() | F.col("__q").isNotNull())
        .drop("__p", "__q")
    )
    rows = src.select("*", *local).join(carried, [*keys, blk], "left")
    names = [c for c in df.columns if c not in out]
    return rows.select(*[F.col(c) for c in names], *[v.alias(n) for n, v in out.items()])


def _windows(df: DataFrame, keys: list[str], order: list[str], sums: dict, maxes: dict, mins_after: dict, lags: dict, leads: dict) -> DataFrame:
    """The columns of :func:`scan` by windows over whole keys."""
    ahead = Window.partitionBy(*keys).orderBy(*order)
    upto = ahead.rowsBetween(Window.unboundedPreceding, 0)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = {n: F.coalesce(F.sum(e).over(upto), F.lit(0)).cast("bigint") for n, e in sums.items()}
    out |= {n: F.max(e).over(before) for n, e in maxes.items()}
    out |= {n: F.min(e).over(after) for n, e in mins_after.items()}
    out |= {n: F.lag(e).over(ahead) for n, e in lags.items()}
    out |= {n: F.lead(e).over(ahead) for n, e in leads.items()}
    names = [c for c in df.columns if c not in out]
    return df.select(*[F.col(c) for c in names], *[v.alias(n) for n, v in out.items()])


def positions(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "pos", **kw) -> DataFrame:
    """Dense 1-based position per key."""
    return scan(df, keys, order, block, sums={name: F.lit(1).cast("bigint")}, **kw)


def islands(df: DataFrame, keys: list[str], order: list[str], block: Column, starts: Column, name: str = "run") -> DataFrame:
    """Number the runs of rows; ``starts`` is true on the first row of a run."""
    return scan(df, keys, order, block, sums={name: starts.cast("bigint")})


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, split: Column, parts: int = 64, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key by ``order``; a hot key is cut in ``parts`` slices first.

    Each slice keeps its own first ``n`` rows, so at most ``parts * n`` rows of one
    key meet in the final window.  ``split`` is any well-spread column expression.
    """
    slot = F.pmod(F.xxhash64(split), F.lit(parts)).cast("int")
    first = Window.partitionBy(*keys, "__slot").orderBy(*order)
    cut = df.withColumn("__slot", slot).withColumn(name, F.row_number().over(first)).where(F.col(name) <= n)
    last = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(name, F.row_number().over(last).cast("bigint")).where(F.col(name) <= n).drop("__slot")
