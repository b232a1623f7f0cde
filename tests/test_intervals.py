"""Interval operators against a small model, and order and partition independence."""

import random

from pyspark.sql import functions as F

from spanframe.operators import intervals as iv

SPAN = "source_id string, span_id long, start_us long, end_us long"


def spans(seed, n=120, far=2000):
    rng = random.Random(seed)
    return [(rng.choice("ab"), i, s, s + rng.choice([1, 5, 40, 300])) for i in range(n) for s in [rng.randint(0, far)]]


def merged(rows, tol=0):
    out = {}
    for k, _, s, e in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        runs = out.setdefault(k, [])
        if runs and s <= runs[-1][1] + tol:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return sorted((k, a, b) for k, v in out.items() for a, b in v)


def test_merge_spans_any_block_and_order(spark):
    for tol in (0, 3):
        rows = spans(3, 60, 6000)
        want = merged(rows, tol)
        for block in (7, 100, 10**6):
            df = spark.createDataFrame(sorted(rows, key=lambda r: -r[1]), SPAN).repartition(5)
            got = iv.merge_spans(df, ["source_id"], tol, block).select("source_id", "start_us", "end_us").collect()
            assert sorted(map(tuple, got)) == want


def test_coverage_of_two_units_leaves_the_middle_open(spark):
    t = spark.createDataFrame([("s", "p", 10, 22), ("s", "q", 50, 60)], "source_id string, target_id string, start_us long, end_us long")
    u = spark.createDataFrame([("s", 0, 16), ("s", 18, 32)], "source_id string, start_us long, end_us long")
    cov, gaps = iv.coverage(u, t, ["source_id"], bin_us=4)
    assert sorted((r.target_id, r.start_us, r.end_us) for r in cov.collect()) == [("p", 10, 16), ("p", 18, 22)]
    assert sorted((r.target_id, r.start_us, r.end_us) for r in gaps.collect()) == [("p", 16, 18), ("q", 50, 60)]


def test_nearest_snap_ties_go_to_the_first_cue(spark):
    s = spark.createDataFrame([("a", 1, 100, 200), ("z", 2, 5, 9)], SPAN)
    c = spark.createDataFrame([("a", 1, 90, 150), ("a", 2, 110, 190), ("a", 3, 120, 210)], "source_id string, ord long, start_us long, end_us long")
    rows = {r.span_id: r for r in iv.snap_nearest(s, c, ["source_id"], max_us=10).collect()}
    assert (rows[1].snap_start_us, rows[1].snap_end_us, rows[1].entry_safe, rows[1].exit_safe) == (90, 190, True, True)
    assert (rows[2].snap_start_us, rows[2].entry_safe) == (5, False)


def test_nearest_equals_min_abs(spark):
    rng = random.Random(5)
    cues = sorted((rng.randint(0, 900), i) for i in range(60))
    pts = [("a", i, rng.randint(-20, 950), 0) for i in range(80)]
    c = spark.createDataFrame([("a", o, t) for o, (t, _) in enumerate(cues)], "source_id string, ord long, t long")
    p = spark.createDataFrame(pts, SPAN)
    got = {r.span_id: r.hit for r in iv.nearest(p, c, ["source_id"], "span_id", "start_us", "t", "ord", "hit").collect()}
    for _, i, t, _ in pts:
        assert got[i] == min((x for x, _ in cues), key=lambda x: abs(x - t))


def test_playback_run_bridges_one_tick_only_on_the_grid(spark):
    ddl = "source_id string, pts long, duration long, tb_num int, tb_den int, fps_num int, fps_den int"
    # 33-tick frames at 30 fps in milliseconds: 0, 33, 67, 100 leave holes of one tick
    good = [("a", p, 33) for p in (0, 33, 67, 100, 133, 167)]
    odd = [("b", 0, 33), ("b", 33, 20), ("b", 54, 33)]
    f = spark.createDataFrame([(*r, 1, 1000, 30, 1) for r in good + odd], ddl)
    runs = sorted((r.source_id, r.start_pts, r.end_pts) for r in iv.playback_runs(f, ["source_id"]).collect())
    assert runs == [("a", 0, 200), ("b", 0, 53), ("b", 54, 87)]
    strict = sorted((r.source_id, r.start_pts, r.end_pts) for r in iv.frame_runs(f, ["source_id"]).collect())
    assert strict == [("a", 0, 66), ("a", 67, 166), ("a", 167, 200), ("b", 0, 53), ("b", 54, 87)]


def test_a_long_clip_off_the_grid_settles(spark):
    ddl = "source_id string, pts long, duration long, tb_num int, tb_den int, fps_num int, fps_den int"
    f = spark.createDataFrame([("a", 34 * i, 33, 1, 1000, 30, 1) for i in range(1000)], ddl)
    runs = sorted((r.start_pts, r.n_frames) for r in iv.playback_runs(f, ["source_id"]).collect())
    assert sum(n for _, n in runs) == 1000 and runs[:2] == [(0, 2), (68, 2)] and len(runs) == 500


def test_sample_runs_follow_the_sample_count(spark):
    ddl = "source_id string, pts long, samples long, rate int, tb_num int, tb_den int"
    # 1024 samples at 44.1 kHz in milliseconds: starts 0, 23, 46, 70 are the rounded counts
    rows = [("a", p, 1024, 44100, 1, 1000) for p in (0, 23, 46, 70)] + [("b", p, 1024, 44100, 1, 1000) for p in (0, 24, 48)]
    runs = sorted((r.source_id, r.start_pts, r.n_blocks) for r in iv.sample_runs(spark.createDataFrame(rows, ddl), ["source_id"]).collect())
    assert runs == [("a", 0, 4), ("b", 0, 1), ("b", 24, 1), ("b", 48, 1)]


def test_chains_drop_forks_and_cycles(spark):
    n = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (7, 8), (8, 7)], "src long, dst long")
    done, bad = iv.chains(n, e)
    assert sorted(map(tuple, done.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0)]
    assert sorted(map(tuple, bad.collect())) == [(4, 5), (4, 6)]


def test_reuse_counts_earlier_uses(spark):
    u = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 5, 15), ("s", 3, 9, 20), ("s", 4, 30, 40)], "source_id string, ord long, start_us long, end_us long")
    got = sorted((r.ord, r.n_earlier, r.first_earlier, r.overlap_us) for r in iv.find_reuse(u, ["source_id"], min_us=0, bin_us=3).collect())
    assert got == [(2, 1, 1, 5), (3, 2, 1, 6)]


def test_active_partition_lists_in_order(spark):
    c = spark.createDataFrame([("s", 2, "b", "B", "two", 5, 15), ("s", 1, "a", "A", "one", 0, 10), ("s", 3, "c", "A", "three", 8, 9)], "source_id string, ord long, cue_id string, speaker string, text string, start_us long, end_us long")
    rows = iv.partition_active(c, ["source_id"], bin_us=4).orderBy("start_us").collect()
    assert [(r.start_us, r.end_us, list(r.cue_ids), r.same_speaker_overlap) for r in rows] == [
        (0, 5, ["a"], False), (5, 8, ["a", "b"], False), (8, 9, ["a", "b", "c"], True), (9, 10, ["a", "b"], False), (10, 15, ["b"], False),
    ]
    assert rows[1].text == "A: one\nB: two"


def test_spans_of_a_hot_source_keep_all_rows(spark):
    hot = spark.range(3000).select(F.lit("h").alias("source_id"), F.col("id").alias("span_id"), (F.col("id") * 10).alias("start_us"), (F.col("id") * 10 + 4).alias("end_us"))
    assert iv.merge_spans(hot, ["source_id"], 0, 500).count() == 3000
    assert iv.merge_spans(hot, ["source_id"], 6, 500).count() == 1
