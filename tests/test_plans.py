"""Ordered scans and interval joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanframe.plans.bins import interval_join
from spanframe.plans.ordered import by_rows, by_time, scan, top_n


def test_scan_equals_plain_window_for_any_block(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(-5, 9)) for k in "ab" for p in rng.sample(range(1, 200), 60)] + [("hot", p, p % 7) for p in range(1, 400)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    w = Window.partitionBy("k").orderBy("p")
    plain = df.select(
        "k", "p", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.min("v").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("n"), F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("z"),
    )
    want = sorted(map(tuple, plain.collect()), key=str)
    for size in (3, 50, 10_000):
        v = F.col("v")
        got = scan(df.repartition(3), ["k"], ["p"], by_rows("p", size), sums={"s": v}, maxes={"m": v}, mins_after={"n": v}, lags={"a": v}, leads={"z": v})
        assert sorted(map(tuple, got.select("k", "p", "s", "m", "n", "a", "z").collect()), key=str) == want


def test_scan_shuffles_its_input_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("p"))
    out = scan(df, ["k"], ["p"], by_rows("p", 100), sums={"s": F.lit(1)})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("levels,salt", [(1, 1), (2, 1), (3, 4)])
def test_interval_join_equals_nested_loop(spark, levels, salt, closed):
    rng = random.Random(7)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.randint(0, 3000)
            out.append((rng.choice("xy"), i, a, a + rng.choice([1, 3, 20, 200, 2500])))
        return out

    a, b = spans(80), spans(80)
    da = spark.createDataFrame(a, "k string, i long, start_us long, end_us long")
    db = spark.createDataFrame(b, "k string, j long, b_start_us long, b_end_us long")
    got = sorted((r.i, r.j) for r in interval_join(da, db, ["k"], closed=closed, bin_us=5, levels=levels, salt=salt).collect())
    if closed:
        want = sorted((i, j) for k, i, s, e in a for q, j, t, f in b if k == q and s <= f and t <= e)
    else:
        want = sorted((i, j) for k, i, s, e in a for q, j, t, f in b if k == q and s < f and t < e)
    assert got == want


def test_top_n_with_slices(spark):
    df = spark.range(500).select(F.lit("h").alias("k"), F.col("id"), (F.col("id") * 37 % 101).alias("v"))
    got = [(r.id, r["rank"]) for r in top_n(df, ["k"], [F.col("v").desc(), F.col("id").asc()], 7, F.col("id"), parts=5).orderBy("rank").collect()]
    want = [i for i in sorted(range(500), key=lambda i: (-(i * 37 % 101), i))[:7]]
    assert [g[0] for g in got] == want and [g[1] for g in got] == list(range(1, 8))


def test_by_time_floors_negative(spark):
    r = spark.range(1).select(by_time(F.lit(-1), 10).alias("a"), by_time(F.lit(-10), 10).alias("b"), by_time(F.lit(9), 10).alias("c")).first()
    assert (r.a, r.b, r.c) == (-1, -1, 0)


def test_front_ranks_read_stored_pairs_only(spark):
    from spanframe.catalog.retrieve import LIMIT, _top

    plan = _top(spark, "/root/testdata/sf0.001", LIMIT)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Scan parquet" not in plan  # texts are split and joined once, not again for the ranks
