"""Playback and sample runs against a row-by-row pass, with blocks of a few rows."""

import random

import numpy as np
import pytest

from spanframe.operators.signals import correlate
from spanframe.operators import intervals as iv
from spanframe.operators.signals import correlate
from spanframe.plans.runs import Block, apply, compose

FRAMES = "source_id string, pts long, duration long, tb_num int, tb_den int, fps_num int, fps_den int"
SAMPLES = "source_id string, pts long, samples long, rate int, tb_num int, tb_den int"


def nearest(x, unit):
    q, r = divmod(x, unit)
    return q + (2 * r > unit or 2 * r == unit and q % 2 == 1)


def playback(rows):
    """(start, end, count) of the runs of one key, in time order."""
    out, reach = [], None
    for _, pts, duration, tn, td, fn, fd in sorted(rows, key=lambda r: (r[1], r[2])):
        tick, nom = tn * fn, fd * td
        s, e = pts * tick, (pts + duration) * tick
        long = nearest(e - s, nom)
        good = long >= 1 and abs(e - s - long * nom) <= tick
        hole = None if reach is None else s - reach
        grid = hole is None or abs(s - anchor - nearest(s - anchor, nom) * nom) <= tick
        if hole is None or hole > tick or hole > 0 and not (good and 2 * hole < nom and grid and clean):
            anchor, clean, grid = s, True, True
            out.append([pts, pts + duration, 0])
        clean = clean and grid and good
        reach = e if reach is None else max(e, reach)
        out[-1] = [out[-1][0], max(out[-1][1], pts + duration), out[-1][2] + 1]
    return out


def audio(rows):
    out, reach = [], None
    for _, pts, samples, rate, tn, td in sorted(rows, key=lambda r: (r[1] * r[4] * r[3], r[1] * r[4] * r[3] + r[2] * r[5])):
        tick, s = tn * rate, pts * tn * rate
        hole = None if reach is None else s - reach
        if hole is None or hole > tick or hole > 0 and pts != nearest(anchor + had * td, tick):
            anchor, had = s, 0
            out.append([pts, 0, 0])
        had += samples
        reach = s + samples * td if reach is None else max(s + samples * td, reach)
        out[-1] = [out[-1][0], out[-1][1] + samples, out[-1][2] + 1]
    return out


def some_frames(rng, key, n):
    tb, fps = rng.choice([((1, 1000), (30, 1)), ((1, 1000), (30000, 1001)), ((1, 90000), (30000, 1001)), ((1, 100), (25, 1)), ((1, 60), (30, 1))])
    per = tb[1] * fps[1] / (tb[0] * fps[0])
    rows, t = [], rng.uniform(-50, 50)
    for _ in range(n):
        pts, length = round(t), max(1, int(per))
        if rng.random() < 0.03:
            length = rng.choice([0, 1, int(per / 2) + 1, int(2 * per)])
        rows.append((key, pts, length, *tb, *fps))
        t += per + (rng.choice([0.4 * per, 3 * per, 1, -1]) if rng.random() < 0.05 else 0)
    return rows


def some_blocks(rng, key, n):
    rate, t, rows = rng.choice([44_100, 48_000, 8_000]), 0.0, []
    for _ in range(n):
        samples = rng.choice([1024, 1024, 1024, 960, 0])
        rows.append((key, round(t * 1000) + rng.choice([0] * 30 + [1, -1]), samples, rate, 1, 1000))
        t += samples / rate + (rng.choice([0.001, 0.5]) if rng.random() < 0.03 else 0)
    return rows


@pytest.mark.parametrize("size", [5, 1000])
def test_playback_runs_equal_a_pass(spark, size):
    rng = random.Random(size)
    parts = {k: some_frames(rng, k, n) for k, n in [("hot", 700), ("b", 60), ("c", 1), ("d", 90)]}
    parts["calm"] = [("calm", round(k * 1000 / 30), 33, 1, 1000, 30, 1) for k in range(400)]
    df = spark.createDataFrame([r for p in parts.values() for r in p], FRAMES).repartition(4)
    got = iv.playback_runs(df, ["source_id"], size).collect()
    for k, rows in parts.items():
        assert sorted([r.start_pts, r.end_pts, r.n_frames] for r in got if r.source_id == k) == sorted(playback(rows)), k
    assert iv.playback_runs(df.limit(0), ["source_id"]).count() == 0


@pytest.mark.parametrize("size", [4, 1000])
def test_sample_runs_equal_a_pass(spark, size):
    rng = random.Random(size)
    parts = {k: some_blocks(rng, k, n) for k, n in [("hot", 600), ("b", 50), ("c", 1)]}
    df = spark.createDataFrame([r for p in parts.values() for r in p], SAMPLES).repartition(4)
    got = iv.sample_runs(df, ["source_id"], size).collect()
    for k, rows in parts.items():
        assert sorted([r.start_pts, r.samples, r.n_blocks] for r in got if r.source_id == k) == sorted(audio(rows)), k


def test_composed_blocks_equal_one_block():
    rng = random.Random(9)
    for _ in range(300):
        n, mod = rng.randint(2, 14), rng.choice([0, 10])
        rows = []
        for i in range(n):
            lo = rng.choice([None, rng.randint(0, 9)])
            rows.append((rng.choice([0, 0, 1, 1, 2]), rng.randint(0, 9), rng.random() < 0.8, lo, None if lo is None else lo + rng.choice([-1, 0, 2, 5, 9]), mod, i))
        make = lambda part: Block(*map(list, zip(*part, strict=True)))
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 3))))
        parts = [make(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        whole, f = make(rows), None
        for p in parts:
            f = p.function() if f is None else compose(f, p.function())
        for state in [[x, c, -1] for x in range(10) for c in (True, False)]:
            want = make(rows).walk(list(state), 0, [])
            assert apply(f, list(state)) == want == apply(whole.function(), list(state))


def test_correlation_stays_in_the_row_of_its_pair(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), rng.normal(size=20 + i % 3).tolist(), rng.normal(size=7).tolist()) for i in range(25)] + [("flat", [1.0] * 9, [2.0] * 3), ("short", [1.0], [1.0, 2.0])]
    got = correlate(spark.createDataFrame(rows, "pair_id string, x array<double>, y array<double>"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    found = {r.pair_id: r for r in got.collect()}
    assert "short" not in found and found["flat"].uninformative
    for key, x, y in rows[:25]:
        corr = np.array([np.corrcoef(x[k : k + 7], y)[0, 1] for k in range(len(x) - 6)])
        best = int(np.abs(corr).argmax())
        far = max(abs(c) for k, c in enumerate(corr) if abs(k - best) > 1)
        r = found[key]
        assert (r.best_lag, r.at_edge) == (best, best in (0, len(corr) - 1))
        assert abs(r.correlation - corr[best]) < 2e-6 and abs(r.peak_margin - (abs(corr[best]) - far)) < 2e-6
