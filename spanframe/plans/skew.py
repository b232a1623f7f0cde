"""Measured skew: hot blocks are cut at quantiles, hot bins are dealt over a grid of salts.

A block or bin has a fixed width in time, so one busy hour of one source can hold most of
a table.  :func:`crowded` first counts rows per hash bucket of the key, which shuffles at
most ``BUCKETS`` counts a task; a bucket holds all rows of its keys, so when no bucket has
more than :func:`hot_rows` rows no key has.  Only else are rows counted per block or bin, and
only those above the limit change; what is joined back is one row per hot block, so its
size is the table's row count over that limit.

On a cluster the counts are always taken.  A local session is one process, whose tasks
share one memory, and takes them only with ``spanframe.skew.measure`` set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rounds import cut_lineage

ROWS = 1_000_000
BUCKETS = 16_384
SENT = 2_000_000  # borders and salts that are broadcast; more are joined by key
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def measures(spark: SparkSession) -> bool:
    """Whether plans of this session count their hot blocks and bins."""
    asked = spark.conf.get("spanframe.skew.measure", None)
    return asked == "true" if asked is not None else not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local"


def hot_rows(spark: SparkSession) -> int:
    """Rows of a block or bin from which on it is hot (``spanframe.skew.rows``)."""
    return int(spark.conf.get("spanframe.skew.rows", str(ROWS)))


def bucket_counts(rows: DataFrame, on: list[str], *more: Column) -> DataFrame:
    """Rows per hash bucket of ``on``: a bound on the rows of each key, and ``more`` aggregates."""
    slot = F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int").alias("__slot")
    return rows.groupBy(slot).agg(F.count(F.lit(1)).alias("__n"), *more)


def crowded(rows: DataFrame, on: list[str]) -> bool:
    """Whether a key of ``on`` may have more rows than fit a task; if not, none has."""
    most = bucket_counts(rows, on).agg(F.max("__n").alias("n")).first().n
    return (most or 0) > hot_rows(rows.sparkSession)


def place(borders: str, value: str, steps: int) -> str:
    """SQL for the number of sorted ``borders`` below ``value``, by bisection."""
    mid = "shiftright(s.lo + s.hi, 1)"
    step = f"if(get({borders}, {mid}) < {value}, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid}))"
    start = f"named_struct('lo', cast(0 as int), 'hi', size({borders}))"
    return f"aggregate(sequence(1, {steps}), {start}, (s, i) -> if(s.lo < s.hi, {step}, s)).lo"


def cut_blocks(rows: DataFrame, keys: list[str], block: str, at: str) -> DataFrame:
    """``rows`` with ``block`` refined where it is hot: a struct of the block and a part of it.

    Parts are cut at quantiles of ``at``, the first column of the scan order, so a part
    never decreases along the scan; rows of one value stay together.
    """
    spark = rows.sparkSession
    if not measures(spark) or not isinstance(rows.schema[at].dataType, NUMBERS) or not crowded(rows, [*keys, block]):
        return rows
    limit = hot_rows(spark)
    counts = rows.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    hot = cut_lineage(counts)
    top = hot.agg(F.max("__n").alias("most"), F.sum("__n").alias("all")).first()
    if top.most is None:
        return rows
    fine = -(-top.most // limit) * 2
    quantiles = F.percentile_approx(at, F.array(*[F.lit(i / fine) for i in range(1, fine)]) if fine < 2_000 else F.expr(f"transform(sequence(1, {fine - 1}), i -> i / {fine}.0D)"), max(10_000, 4 * fine))
    found = rows.join(F.broadcast(hot) if top["all"] // limit <= SENT else hot, [*keys, block])
    borders = found.groupBy(*keys, block).agg(quantiles.alias("__q"), F.max("__n").alias("__n"))
    parts = F.ceil(F.col("__n") / limit).cast("int")
    thin = F.expr(f"array_distinct(transform(sequence(1, greatest(__parts - 1, 1)), i -> __q[cast(i as bigint) * {fine} div greatest(__parts, 2) - 1]))")
    borders = cut_lineage(borders.withColumn("__parts", parts * 2).select(*keys, block, thin.alias("__q")))
    told = rows.join(F.broadcast(borders) if 2 * top["all"] // limit <= SENT else borders, [*keys, block], "left")
    part = F.when(F.col("__q").isNull(), 0).otherwise(F.expr(place("__q", at, fine.bit_length() + 1)))
    return told.withColumn(block, F.struct(F.col(block).alias("block"), part.alias("part"))).drop("__q").select(*rows.columns)


def salted(a: DataFrame, b: DataFrame, on: list[str], a_id: list[Column], b_id: list[Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with salts where a key of the join is hot, and the columns to join on.

    A hot key becomes a grid: each side is dealt over its own salts and copied to all of
    the other's, so every pair meets in one cell.
    """
    spark = a.sparkSession
    if not measures(spark):
        return a, b, on
    limit = hot_rows(spark)
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > limit)
    hot = count(a, "__na").join(count(b, "__nb"), on, "full")
    salts = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / limit).cast("int")
    hot = cut_lineage(hot.select(*on, salts("__na").alias("__sa"), salts("__nb").alias("__sb")))
    known = hot.count()
    if known == 0:
        return a, b, on
    side = F.broadcast(hot) if known <= SENT else hot

    def dealt(df: DataFrame, own: str, other: str, ident: list[Column]) -> DataFrame:
        told = df.join(side, on, "left").fillna(1, ["__sa", "__sb"])
        names = {"__sa": "__salt_a", "__sb": "__salt_b"}
        told = told.withColumn(names[own], F.pmod(F.xxhash64(*ident), F.col(own)).cast("int"))
        return told.withColumn(names[other], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("__sa", "__sb")

    return dealt(a, "__sa", "__sb", a_id), dealt(b, "__sb", "__sa", b_id), [*on, "__salt_a", "__salt_b"]
