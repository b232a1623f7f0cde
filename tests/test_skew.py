"""Measured skew: balanced blocks and bins on one hot hour, equal results."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from spanframe import fixtures as fx
from spanframe.operators import compile as cp
from spanframe.operators import intervals as iv
from spanframe.operators import rules as ru
from spanframe.operators import timeline as tl
from spanframe.plans.bins import FAN, interval_join
from spanframe.plans.ordered import by_time, scan
from spanframe.plans.skew import cut_blocks, salted
from spanframe.sources import sinks as sk

HOUR = 3_600_000_000


@pytest.fixture
def measured(spark):
    spark.conf.set("spanframe.skew.measure", "true")
    spark.conf.set("spanframe.skew.rows", "500")
    yield spark
    spark.conf.unset("spanframe.skew.measure")
    spark.conf.unset("spanframe.skew.rows")


def busy_hour(spark, n=20_000):
    """Nine tenths of all spans lie in one hour of one source, most of them in its first minutes."""
    i = F.col("id")
    late = F.floor((i * 7919) % 1_000 * HOUR / 100)
    start = F.when(i % 10 < 9, 100 * HOUR + (F.pow((i * 104729) % n / n, 3) * HOUR).cast("long")).otherwise(late)
    return spark.range(n).select(
        F.when(i % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), i % 7)).alias("source_id"), i.alias("span_id"), start.alias("start_us"),
        (start + 1 + (i * 31) % 9 * 400_000).alias("end_us"),
    )


def test_hot_blocks_are_cut_into_even_ones(measured):
    rows = busy_hour(measured).withColumn("b", by_time("start_us"))
    cut = cut_blocks(rows, ["source_id"], "b", "start_us")
    sizes = [r["count"] for r in cut.groupBy("source_id", "b").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 500
    w = Window.partitionBy("source_id").orderBy("start_us")
    falls = cut.select(F.col("b") < F.lag("b").over(w)).toDF("falls").where("falls").count()
    assert falls == 0
    one = measured.range(3000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), F.lit(0).cast("long").alias("b"))
    assert cut_blocks(one, ["k"], "b", "t").select("b").distinct().count() == 1  # equal values stay together


def test_scans_and_merges_are_equal_when_measured(spark, measured):
    rows = busy_hour(spark).cache()
    w = Window.partitionBy("source_id").orderBy("start_us", "span_id")
    plain = rows.select("span_id", F.row_number().over(w).cast("long").alias("n"), F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    got = scan(rows, ["source_id"], ["start_us", "span_id"], by_time("start_us"), sums={"n": F.lit(1).cast("long")}, maxes={"m": F.col("end_us")})
    assert got.select("span_id", "n", "m").exceptAll(plain).isEmpty() and got.count() == 20_000
    merged = iv.merge_spans(rows, ["source_id"])
    spark.conf.set("spanframe.skew.measure", "false")
    want = iv.merge_spans(rows, ["source_id"])
    assert merged.exceptAll(want).isEmpty() and merged.count() == want.count()


def test_hot_bins_are_dealt_over_a_grid(measured):
    rows = busy_hour(measured).where("source_id = 'hot'").select("source_id", "span_id", (F.col("start_us") - 100 * HOUR).alias("t"))
    a, b = rows.withColumn("bin", F.expr("t div 600000000")), rows.where("span_id % 4 = 1").withColumn("bin", F.expr("t div 600000000")).withColumnRenamed("span_id", "other").drop("t")
    sa, sb, on = salted(a, b, ["source_id", "bin"], [F.col("span_id")], [F.col("other")])
    assert on[-2:] == ["__salt_a", "__salt_b"]
    for side in (sa, sb):
        assert max(r["count"] for r in side.groupBy(*on).count().collect()) <= 2 * 500
    assert sa.join(sb, on).count() == a.join(b, ["source_id", "bin"]).count()


def test_interval_joins_are_equal_when_measured(spark, measured):
    rng = random.Random(2)
    rows = [(("hot" if rng.random() < 0.9 else "x"), i, t, t + rng.choice([1, 40, 900, 200_000])) for i in range(700) for t in [rng.choice([rng.randint(0, 300), rng.randint(0, 90_000)])]]
    spark.conf.set("spanframe.skew.rows", "60")
    a = spark.createDataFrame(rows, "k string, i long, start_us long, end_us long")
    b = spark.createDataFrame(rows[::3], "k string, j long, b_start_us long, b_end_us long")
    got = sorted((r.i, r.j) for r in interval_join(a, b, ["k"], bin_us=5).collect())
    assert 200_000 > 5 * FAN**2  # the longest spans ask for a third level
    assert got == sorted((i, j) for k, i, s, e in rows for q, j, t, f in rows[::3] if k == q and s < f and t < e)


def test_small_keys_are_scanned_by_one_shuffle(spark):
    rows = spark.range(4_000).select((F.col("id") % 900).alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 13).alias("v"))
    every = dict(sums={"s": F.col("v")}, maxes={"m": F.col("v")}, mins_after={"n": F.col("v")}, lags={"p": F.col("v")}, leads={"q": F.col("v")})
    want = scan(rows, ["k"], ["t"], F.col("t"), **every)
    spark.conf.set("spanframe.skew.measure", "true")
    try:
        got = scan(rows, ["k"], ["t"], F.col("t"), **every)
        again = scan(got, ["k"], ["t"], F.col("t"), sums={"u": F.col("s")})
    finally:
        spark.conf.unset("spanframe.skew.measure")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == 4_000
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_spans_of_a_stream_join_where_skew_is_measured(spark, tmp_path):
    rows = spark.range(20).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") * 10).alias("start_us"), (F.col("id") * 10 + 15).alias("end_us"))
    rows.write.parquet(str(tmp_path / "in"))
    b = spark.createDataFrame([("k", 1, 12, 300_000)], "k string, j long, b_start_us long, b_end_us long")
    spark.conf.set("spanframe.skew.measure", "true")
    try:
        live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        pairs = interval_join(live, b, ["k"], bin_us=5)
        q = pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spanframe.skew.measure")
    assert spark.read.schema(pairs.schema).parquet(str(tmp_path / "out")).count() == 20


def test_clips_are_placed_by_one_shuffle(spark):
    spark.conf.set("spanframe.skew.measure", "true")
    try:
        placed = tl.place_clips(fx.clips(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spanframe.skew.measure")
    want = tl.place_clips(fx.clips(spark, "/root/testdata/sf0.001"))
    assert placed.exceptAll(want.select(*placed.columns)).isEmpty() and placed.count() == want.count()
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["chapter_findings", "step_map", "rule_dialogue_boundary"])
def test_shared_tables_are_made_once(spark, name):
    # what several paths of a plan read is stored: none goes back to the lines
    assert not [f for f in entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["replay_cover", "original_cues", "hook_eligibility"])
def test_played_ranges_and_highlights_are_made_once(spark, name):
    assert not [f for f in entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_source_ranges_read_stored_uses(spark):
    d = "/root/testdata/sf0.001"
    found = ru.rule_source_ranges(fx.segments(spark, d), fx.visuals(spark, d), fx.sources(spark, d))
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def unread(df):
    """``df``, which fails when a job reads it."""
    return df.where(F.raise_error(F.concat(F.lit("read"), df.columns[0])).cast("boolean"))


def test_rows_are_counted_on_the_cheap_table(measured):
    one = measured.range(3)
    seg = one.select(F.lit("w").alias("work_id"), F.col("id").cast("string").alias("segment_id"), F.col("id").alias("ord"), F.lit("voiceover").alias("mode"), F.lit(5).alias("voice_us"))
    vis = unread(one.select(F.lit("w").alias("work_id"), F.col("id").cast("string").alias("segment_id"), F.lit(0).alias("start_us"), F.lit(9).alias("end_us")))
    tl.nominal_timeline(seg, vis)
    ru.rule_long_runs(seg, vis)
    track = one.select(F.lit("w").alias("work_id"), F.lit("v").alias("track_id"))
    cols = ["kind", "instance_id", "resource_id", "start_us", "duration_us", "target_start_us"]
    sk.interchange_items(unread(track.select("*", *[F.lit(1).alias(c) for c in cols])), track)
    sec = unread(seg.select("work_id", F.col("segment_id").alias("section_id"), "ord", F.lit(0).alias("start_us"), F.lit(9).alias("end_us")))
    shots = seg.select("work_id", F.col("segment_id").alias("section_id"), "ord", F.lit("a").alias("angle_id"), F.lit(0).alias("start_us"), F.lit(9).alias("end_us"))
    place = one.select(F.lit("a").alias("source_id"), F.lit(0).alias("offset_us"), F.lit(9).alias("duration_us"))
    cp.compile_multicam(sec, shots, place, sec.select("work_id", "section_id", F.lit("a").alias("source_id"), F.lit(1).alias("gain_db")), 25, 1)


def test_reuse_shuffles_its_uses_once(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        uses = spark.range(500).select((F.col("id") % 5).alias("k"), F.col("id").alias("ord"), (F.col("id") * 7 % 400 * 1_000_000).alias("start_us")).withColumn("end_us", F.col("start_us") + 9_000_000)
        again = iv.find_reuse(uses, ["k"])
        assert again.columns[:2] == ["k", "ord"] and again.collect()
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["step_findings", "chapter_findings", "event_findings", "layer_hits", "dependency_checks", "evidence_findings"])
def test_compiled_plans_shuffle_stored_tables_once(spark, name):
    assert_no_shuffle_of_joins(spark, name)


def assert_no_shuffle_of_joins(spark, name):
    """Rows lie by work from the one shuffle of each stored table: no join, group or window adds one."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spanframe.skew.measure", "true")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spanframe.skew.measure")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_dependencies_bind_from_both_sides(spark):
    mapped = spark.createDataFrame([("w", f"o{i}", f"u{i}", 10 * i, 10 * i + 9) for i in (1, 2, 3)], "work_id string, occurrence_id string, unit_id string, out_start_us long, out_end_us long")
    need = spark.createDataFrame([("w", "u2", "u1", "prerequisite"), ("w", "u3", "u1", "context")], "work_id string, unit_id string, dep_unit_id string, relation string")
    deps = spark.createDataFrame([("w", "o2", "u1", "o1"), ("w", "o1", "u9", "o1"), (None, "o7", "u7", "o7")], "work_id string, occurrence_id string, dep_unit_id string, dep_occurrence_id string")
    got = sorted((r.entity_id, r.rule_id) for r in cp.check_dependencies(mapped, need, deps).collect())
    assert got == [(x, "DEPENDENCY_BINDING_MISMATCH") for x in ("o1>u9", "o3>u1", "o7>u7")]


@pytest.mark.parametrize("name", ["affected_items", "frozen_checks"])
def test_revisions_shuffle_stored_clips_once(spark, name):
    assert_no_shuffle_of_joins(spark, name)


@pytest.mark.parametrize("name", ["rule_hook", "boundary_adoption"])
def test_cuts_shuffle_stored_visuals_once(spark, name):
    assert_no_shuffle_of_joins(spark, name)
