"""Exact clocks: golden rows."""

from fractions import Fraction

from pyspark.sql import functions as F

from spanframe.functions.clock import half_even, half_up, wide
from spanframe.operators import timeline as tl

CLIP = "work_id string, ord long, clip_id string, source_id string, start_us long, end_us long, speed_num long, speed_den long, gain_db long, fps_num long, fps_den long"


def test_rounding_rules(spark):
    pairs = [(n, d) for d in (1, 2, 3, 10, 7) for n in range(-25, 26)] + [(10**30 + 5, 10), (10**30 + 15, 10), (-(10**24) - 1, 2)]
    df = spark.createDataFrame([(str(n), d) for n, d in pairs], "n string, d long").withColumn("n", F.col("n").cast("decimal(38,0)")).where("abs(n) < 1e28")
    for r in df.select("n", "d", half_even("n", "d").alias("e"), half_up("n", "d").alias("u")).where("abs(n) < 1e9").collect():
        x = Fraction(int(r.n), r.d)
        assert r.e == round(x)
        assert r.u == (int(x + Fraction(1, 2)) if x >= 0 else -int(-x + Fraction(1, 2)))


def test_wide_survives_bigint_overflow(spark):
    r = spark.range(1).select(half_even(wide(F.lit(3 * 10**12), 10**9, 7), wide(10**9, 10**6)).alias("x")).first()
    assert r.x == round(Fraction(3 * 10**12 * 10**9 * 7, 10**15))


def test_three_clips_of_350_ms(spark):
    c = spark.createDataFrame([("w", i, f"c{i}", "s", 1_000_000 * i, 1_000_000 * i + 350_000, 1, 1, 0, 30, 1) for i in (1, 2, 3)], CLIP)
    rows = tl.place_clips(c).orderBy("ord").collect()
    assert [r.frames for r in rows] == [10, 10, 10]  # 10.5 frames is a tie and goes to even
    c = c.withColumn("end_us", F.col("end_us") + 1)
    rows = tl.place_clips(c).orderBy("ord").collect()
    assert [r.frames for r in rows] == [11, 11, 11] and rows[-1].out_end_us == 1_100_000


def test_cue_maps_through_two_clips(spark):
    c = spark.createDataFrame([("w", 1, "a", "s", 0, 2_000_000, 1, 1, 0, 25, 1), ("w", 2, "b", "s", 1_000_000, 3_000_000, 2, 1, 0, 25, 1)], CLIP)
    q = spark.createDataFrame([("s", "q", "hi", 1_500_000, 2_500_000)], "source_id string, cue_id string, text string, start_us long, end_us long")
    got, bad = tl.map_cues(q, tl.place_clips(c), "clip")
    assert sorted((r.clip_id, r.start_us, r.end_us, r.partial) for r in got.collect()) == [("a", 1_500_000, 2_000_000, True), ("b", 2_250_000, 2_750_000, False)]
    kept, bad = tl.map_cues(q, tl.place_clips(c), "reject-partial")
    assert [r.clip_id for r in kept.collect()] == ["b"] and [r.rule_id for r in bad.collect()] == ["PARTIAL_CUE"]


def _board(spark, dur):
    seg = spark.createDataFrame([("w", i, f"s{i}", "voiceover", dur, dur) for i in range(1, 21)], "work_id string, ord long, segment_id string, mode string, voice_us long, planned_us long")
    vis = spark.createDataFrame([("w", f"s{i}", 1, "x", 0, 5_000_000) for i in range(1, 21)], "work_id string, segment_id string, ord long, source_id string, start_us long, end_us long")
    fact = seg.select("work_id", "segment_id", F.lit(3).cast("long").alias("frame_count"), F.lit(4800).cast("long").alias("sample_count"), F.lit(4900).cast("long").alias("decoded_sample_count"), F.lit(100).cast("long").alias("padding"), F.lit(0).cast("long").alias("encoder_delay"), F.lit(30).cast("long").alias("fps_num"), F.lit(1).cast("long").alias("fps_den"), F.lit(48000).alias("sample_rate"))
    return tl.realized_timeline(seg, vis, fact, 30, 1)


def test_twenty_segments_land_on_frame_sixty(spark):
    clock, bad = _board(spark, 101_000)
    assert clock.agg(F.max("end_frame")).first()[0] == 60 and bad.count() == 0
    _, bad = _board(spark, 110_000)
    assert {r.rule_id for r in bad.collect()} == {"REALIZED_CUMULATIVE_DRIFT"}


def test_voice_fits_within_speed_bounds(spark):
    s = spark.createDataFrame([("a", 5_250_000, 5_000_000, [(1_050_000, 525_000)]), ("b", 9_000_000, 5_000_000, [(7, 7)])], "segment_id string, raw_us long, planned_us long, words array<struct<start_us:long,dur_us:long>>")
    a, b = tl.fit_voice(s).orderBy("segment_id").collect()
    assert (a.speed_num / a.speed_den, a.audio_us, a.words[0].start_us, a.words[0].dur_us) == (1.05, 5_000_000, 1_000_000, 500_000)
    assert (b.fitted, b.audio_us, b.words[0].start_us) == (False, 9_000_000, 7)


def test_budget_spends_visuals_in_order(spark):
    seg = spark.createDataFrame([("w", "v", "voiceover", 3_000_000, 0), ("w", "o", "original", None, 0)], "work_id string, segment_id string, mode string, voice_us long, planned_us long")
    vis = spark.createDataFrame([("w", s, i, "x", 0, 2_000_000) for s in "vo" for i in (1, 2, 3)], "work_id string, segment_id string, ord long, source_id string, start_us long, end_us long")
    got = sorted((r.segment_id, r.ord, r.used_us, r.local_us) for r in tl.consume_visuals(seg, vis).collect())
    assert got == [("o", 1, 2_000_000, 0), ("o", 2, 2_000_000, 2_000_000), ("o", 3, 2_000_000, 4_000_000), ("v", 1, 2_000_000, 0), ("v", 2, 1_000_000, 2_000_000)]
