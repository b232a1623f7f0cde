"""Interval algebra over ``(key, start_us, end_us)`` rows.

Spans are half-open.  Ordered passes go through :func:`spanframe.plans.ordered.scan`
and pair tests through time bins, so no key is collected into one task.  The two run
splitters label blocks of a key side by side (:mod:`spanframe.plans.runs`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanframe.functions.clock import floor_div, overlap_us, wide
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join, prefixed
from spanframe.plans.ordered import BLOCK_US, by_time, pinned, positions, scan
from spanframe.plans.rounds import cut_lineage
from spanframe.plans.runs import ROWS, label_runs
from spanframe.plans.skew import cut_blocks

MERGE_BLOCK_US = 12 * 3_600_000_000


def check_spans(spans: DataFrame, sources: DataFrame, tol_us: int = 0, work: str = "source_id", entity: str = "span_id") -> DataFrame:
    """IV1: ``0 <= start < end <= duration + tol`` or a finding; unknown sources too."""
    known = sources.select("source_id", F.col("duration_us").alias("__dur"))
    rows = spans.join(known, "source_id", "left")
    return fd.checks(
        rows,
        [
            ("UNKNOWN_SOURCE", F.col("__dur").isNull()),
            ("SPAN_NEGATIVE", F.col("start_us") < 0),
            ("SPAN_EMPTY", F.col("end_us") <= F.col("start_us")),
            ("SPAN_PAST_END", F.col("end_us") > F.col("__dur") + tol_us),
        ],
        work=work, entity=entity, source="source_id",
    )


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", bin_us: int = BIN_US, salt: int = 1) -> DataFrame:
    """IV2/IV3: overlapping pairs of ``a`` and ``b`` with the overlap length.

    Columns of ``b`` come back with the prefix ``b_``.
    """
    out = interval_join(a, prefixed(b, "b_", keys), keys, how, bin_us=bin_us, salt=salt)
    if how != "inner":
        return out
    return out.withColumn("overlap_us", overlap_us("start_us", "end_us", "b_start_us", "b_end_us"))


def clip_to(a: DataFrame, b: DataFrame, keys: list[str], bin_us: int = BIN_US) -> DataFrame:
    """IV4: the parts of ``a`` inside each overlapping row of ``b``."""
    out = interval_join(a, prefixed(b, "b_", keys), keys, bin_us=bin_us)
    return out.withColumn("clip_start_us", F.greatest("start_us", "b_start_us")).withColumn(
        "clip_end_us", F.least("end_us", "b_end_us")
    )


def merge_spans(spans: DataFrame, keys: list[str], tol_us: int = 0, block_us: int = MERGE_BLOCK_US) -> DataFrame:
    """IV5: union of spans per key; spans at most ``tol_us`` apart join.

    1. equal starts are combined map-side;
    2. islands are found inside ``(key, block)``;
    3. an ordered pass over one row per block tells each block how far earlier
       blocks reach and where the island that reaches into it began;
    4. islands cut by block borders are put together by one aggregation.
    """
    starts = spans.groupBy(*keys, "start_us").agg(F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n_spans"))
    starts = cut_blocks(starts.withColumn("__b", by_time("start_us", block_us)), keys, "__b", "start_us")
    w = Window.partitionBy(*keys, "__b").orderBy("start_us")
    prev = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = prev.isNull() | (F.col("start_us") > prev + tol_us)
    starts = starts.withColumn("__new", fresh.cast("int"))
    starts = starts.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = starts.groupBy(*keys, "__b", "__g").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_spans").alias("n_spans")
    )
    blocks = pinned(local).groupBy(*keys, "__b").agg(F.max("start_us").alias("__last"), F.max("end_us").alias("__end"))
    wb = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__reach", F.max("__end").over(wb))
    own = F.when(F.col("__reach").isNull() | (F.col("__last") > F.col("__reach") + tol_us), F.col("__last"))
    blocks = blocks.withColumn("__own", own).withColumn("__from", F.max("__own").over(wb))
    carried = blocks.where(F.col("__reach").isNotNull()).select(*keys, "__b", "__reach", "__from")
    rows = local.join(carried, [*keys, "__b"], "left")
    first = F.when(
        F.col("__reach").isNull() | (F.col("start_us") > F.col("__reach") + tol_us), F.col("start_us")
    ).otherwise(F.col("__from"))
    return (
        rows.withColumn("__first", first)
        .groupBy(*keys, "__first")
        .agg(F.max("end_us").alias("end_us"), F.sum("n_spans").alias("n_spans"))
        .select(*keys, F.col("__first").alias("start_us"), "end_us", "n_spans")
    )


def gaps_between(islands: DataFrame, keys: list[str], block_us: int = MERGE_BLOCK_US) -> DataFrame:
    """Holes between consecutive islands of a key (no head or tail)."""
    rows = scan(islands, keys, ["start_us"], by_time("start_us", block_us), lags={"__prev": F.col("end_us")})
    return rows.where("__prev is not null").select(
        *keys, F.col("__prev").alias("start_us"), F.col("start_us").alias("end_us")
    )


def coverage(spans: DataFrame, targets: DataFrame, keys: list[str], target_id: str = "target_id", bin_us: int = BIN_US) -> tuple[DataFrame, DataFrame]:
    """IV6: (covered parts, gaps) of each target; nothing is bridged.

    A target is ``(keys, target_id, start_us, end_us)``; gaps include head and tail
    and the whole target when nothing covers it.
    """
    t = targets.select(*keys, target_id, "start_us", "end_us")
    pairs = clip_to(t, spans.select(*keys, "start_us", "end_us"), keys, bin_us)
    ident = [*keys, target_id]
    parts = pairs.select(*ident, F.col("clip_start_us").alias("start_us"), F.col("clip_end_us").alias("end_us"))
    covered = merge_spans(parts, ident).select(*ident, "start_us", "end_us")
    return covered, _holes(covered, t, ident)


def _holes(covered: DataFrame, targets: DataFrame, ident: list[str]) -> DataFrame:
    """Target minus its covered parts: a closing marker per target, then one scan."""
    marks = targets.select(*ident, F.col("end_us").alias("start_us"), "end_us", F.lit(1).alias("__mark"))
    rows = covered.withColumn("__mark", F.lit(0)).unionByName(marks)
    rows = scan(rows, ident, ["start_us", "__mark"], by_time("start_us"), lags={"__prev": F.col("end_us")})
    begin = targets.select(*ident, F.col("start_us").alias("__t0"))
    first = rows.join(begin, ident).withColumn("__from", F.coalesce("__prev", "__t0"))
    return first.where(F.col("__from") < F.col("start_us")).select(
        *ident, F.col("__from").alias("start_us"), F.col("start_us").alias("end_us")
    )


def contained(targets: DataFrame, spans: DataFrame, keys: list[str], target_id: str = "target_id", flag: str = "contained", bin_us: int = BIN_US) -> DataFrame:
    """IV7: is the target inside one merged span?"""
    runs = prefixed(merge_spans(spans, keys).select(*keys, "start_us", "end_us"), "b_", keys)
    inside = (F.col("b_start_us") <= F.col("start_us")) & (F.col("end_us") <= F.col("b_end_us"))
    hit = interval_join(targets, runs, keys, bin_us=bin_us, where=inside).select(*keys, target_id).distinct().withColumn(flag, F.lit(True))
    return targets.join(hit, [*keys, target_id], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def crosses_barrier(targets: DataFrame, barriers: DataFrame, runs: DataFrame, keys: list[str], target_id: str = "target_id", bin_us: int = BIN_US) -> DataFrame:
    """IV8: findings for targets that meet a barrier or more than one covering run.

    A zero-width barrier counts only strictly inside the target.
    """
    b = barriers.select(*keys, F.col("start_us").alias("b_lo"), F.col("end_us").alias("b_hi"))
    b = b.withColumn("b_start_us", F.col("b_lo")).withColumn("b_end_us", F.greatest(F.col("b_hi"), F.col("b_lo") + 1))
    inside = (F.col("b_lo") < F.col("b_hi")) | (F.col("start_us") < F.col("b_lo"))
    crossed = interval_join(targets, b, keys, bin_us=bin_us, where=inside).select(*keys, target_id).distinct()
    hits = interval_join(targets, prefixed(runs.select(*keys, "start_us", "end_us"), "b_", keys), keys, bin_us=bin_us)
    several = hits.groupBy(*keys, target_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, target_id)
    out = crossed.withColumn("reason", F.lit("BARRIER")).unionByName(several.withColumn("reason", F.lit("SEVERAL_RUNS")))
    return out


def find_reuse(uses: DataFrame, keys: list[str], order: str = "ord", min_us: int = 0, bin_us: int = BIN_US) -> DataFrame:
    """IV9: uses that overlap an earlier use by more than ``min_us``.

    One row per later use: how many earlier uses it meets, the first of them and the
    largest overlap.  Pairs are aggregated map-side and never shuffled.
    """
    rows = uses.select(*keys, order, "start_us", "end_us")
    a, b = prefixed(rows, "a_", keys), prefixed(rows, "b_", keys)  # both renamed: Spark then knows them for one shuffle
    overlap = overlap_us("a_start_us", "a_end_us", "b_start_us", "b_end_us")
    cond = (F.col(f"b_{order}") < F.col(f"a_{order}")) & (overlap > min_us)
    pairs = interval_join(a, b, keys, a_span=("a_start_us", "a_end_us"), bin_us=bin_us, where=cond)
    return pairs.groupBy(*keys, F.col(f"a_{order}").alias(order)).agg(
        F.count(F.lit(1)).alias("n_earlier"),
        F.min(f"b_{order}").alias("first_earlier"),
        F.max(overlap).alias("overlap_us"),
    )


def check_lane(spans: DataFrame, keys: list[str], order: list[str], block=None) -> DataFrame:
    """IV10: rows of an ordered lane that start before the lane's previous row ends."""
    block = by_time("start_us") if block is None else block
    rows = scan(spans, keys, order, block, lags={"prev_end_us": F.col("end_us")})
    return rows.where(F.col("start_us") < F.col("prev_end_us"))


def partition_active(cues: DataFrame, keys: list[str], order_col: str = "ord", bin_us: int = BIN_US) -> DataFrame:
    """IV11: cut time at every cue bound and list the active cues of each piece.

    Cue lists follow ``order_col``; a piece is flagged when one speaker has two cues.
    """
    bounds = cues.select(*keys, F.col("start_us").alias("t")).unionByName(cues.select(*keys, F.col("end_us").alias("t"))).distinct()
    pieces = scan(bounds, keys, ["t"], by_time("t"), leads={"end_us": F.col("t")})
    pieces = pieces.where("end_us is not null").select(*keys, F.col("t").alias("start_us"), "end_us")
    c = cues.select(*keys, order_col, "cue_id", "speaker", "text", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    pairs = interval_join(pieces, c, keys, bin_us=bin_us)
    entry = F.struct(F.col(order_col).alias("o"), F.col("cue_id").alias("c"), F.concat(F.col("speaker"), F.lit(": "), F.col("text")).alias("t"))
    rows = pairs.groupBy(*keys, "start_us", "end_us").agg(
        F.array_sort(F.collect_list(entry)).alias("__l"),
        F.count(F.lit(1)).alias("n_active"),
        F.size(F.collect_set("speaker")).cast("bigint").alias("n_speakers"),
    )
    return rows.select(
        *keys, "start_us", "end_us",
        F.transform("__l", lambda x: x["c"]).alias("cue_ids"),
        F.array_join(F.transform("__l", lambda x: x["t"]), "\n").alias("text"),
        "n_active",
        (F.col("n_speakers") < F.col("n_active")).alias("same_speaker_overlap"),
    )


def nearest(points: DataFrame, bounds: DataFrame, keys: list[str], point_id: str, t: str, bound: str, order: str, name: str) -> DataFrame:
    """Closest bound of each point; equal distances go to the lower ``order``.

    One ordered scan over points and distinct bounds together, no pairs.
    """
    b = bounds.groupBy(*keys, F.col(bound).alias("__t")).agg(F.min(order).alias("__o"))
    b = b.select(*keys, "__t", F.lit(0).alias("__k"), F.lit(None).cast(points.schema[point_id].dataType).alias("__id"), "__o")
    p = points.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__k"), F.col(point_id).alias("__id"), F.lit(None).cast("bigint").alias("__o"))
    both = b.unionByName(p)
    at = F.when(F.col("__k") == 0, F.struct(F.col("__t").alias("t"), F.col("__o").alias("o")))
    both = scan(both, keys, ["__t", "__k", "__id"], by_time("__t"), maxes={"__lo": at}, mins_after={"__hi": at})
    d_lo = F.col("__t") - F.col("__lo.t")
    d_hi = F.col("__hi.t") - F.col("__t")
    low = F.col("__hi").isNull() | (d_lo < d_hi) | ((d_lo == d_hi) & (F.col("__lo.o") <= F.col("__hi.o")))
    pick = F.when(F.col("__lo").isNotNull() & low, F.col("__lo.t")).otherwise(F.col("__hi.t"))
    return both.where("__k = 1").select(*keys, F.col("__id").alias(point_id), pick.alias(name))


def snap_nearest(spans: DataFrame, cues: DataFrame, keys: list[str], max_us: int = 1_200_000, span_id: str = "span_id", order: str = "ord") -> DataFrame:
    """IV12: snap span ends to the closest cue start and cue end within ``max_us``."""
    lo = nearest(spans, cues, keys, span_id, "start_us", "start_us", order, "entry")
    hi = nearest(spans, cues, keys, span_id, "end_us", "end_us", order, "exit")
    rows = spans.join(lo, [*keys, span_id]).join(hi, [*keys, span_id])
    a = F.coalesce(F.abs(F.col("entry") - F.col("start_us")) <= max_us, F.lit(False))
    b = F.coalesce(F.abs(F.col("exit") - F.col("end_us")) <= max_us, F.lit(False))
    return rows.select(
        *spans.columns,
        F.when(a, F.col("entry")).otherwise(F.col("start_us")).alias("snap_start_us"),
        F.when(b, F.col("exit")).otherwise(F.col("end_us")).alias("snap_end_us"),
        a.alias("entry_safe"),
        b.alias("exit_safe"),
    )


def cut_points(points: DataFrame, cues: DataFrame, keys: list[str], guard_us: int = 20_000, bin_us: int = BIN_US) -> DataFrame:
    """IV13: pairs (point, cue) where the cue strictly contains the point with a guard."""
    c = cues.withColumn("b_start_us", F.col("start_us") + guard_us + 1).withColumn("b_end_us", F.col("end_us") - guard_us)
    c = c.where("b_end_us > b_start_us").select(*keys, "cue_id", "b_start_us", "b_end_us", F.col("start_us").alias("cue_start_us"), F.col("end_us").alias("cue_end_us"))
    p = points.withColumn("start_us", F.col("t_us")).withColumn("end_us", F.col("t_us") + 1)
    return interval_join(p, c, keys, bin_us=bin_us).drop("start_us", "end_us", "b_start_us", "b_end_us")


def frame_runs(frames: DataFrame, keys: list[str], block: int = 65_536) -> DataFrame:
    """IV14: decoded frame rows to observed runs, in ticks; gaps stay gaps."""
    spans = frames.select(*keys, F.col("pts").alias("start_us"), (F.col("pts") + F.col("duration")).alias("end_us"))
    runs = merge_spans(spans, keys, 0, block * 1000)
    return runs.select(*keys, F.col("start_us").alias("start_pts"), F.col("end_us").alias("end_pts"), F.col("n_spans").alias("n_frames"))


def check_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """IV14 findings: repeated time stamps, missing or non-positive durations, and, with a
    column ``pkt_duration``, two duration fields that disagree."""
    twice = frames.groupBy(*keys, "pts").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    a = fd.finding(twice, "SOURCE_TIME_DISCONTINUOUS", F.lit(True), F.concat_ws("@", *keys, "pts"), work=keys[0])
    b = fd.finding(
        frames, "FRAME_DURATION_UNVERIFIED", F.col("duration").isNull() | (F.col("duration") <= 0), F.concat_ws("@", *keys, "pts"), work=keys[0]
    )
    if "pkt_duration" not in frames.columns:
        return a.unionByName(b)
    both = F.col("duration").isNotNull() & F.col("pkt_duration").isNotNull() & (F.col("duration") != F.col("pkt_duration"))
    return a.unionByName(b).unionByName(fd.finding(frames, "FRAME_DURATION_CONFLICT", both, F.concat_ws("@", *keys, "pts"), work=keys[0]))


def _nearest(x, unit):
    """Number of ``unit`` in ``x``, rounded, ties to the even number."""
    q = floor_div(x, unit)
    r = x - q * unit
    return q + F.when((2 * r > unit) | ((2 * r == unit) & (q % 2 != 0)), 1).otherwise(0)


def _placed(rows: DataFrame, keys: list[str], block, **sums) -> DataFrame:
    """Rows with their place ``__pos``, the hole ``__hole`` before them (NULL on the first) and running sums."""
    r = scan(rows, keys, ["__s", "__e"], block, sums={"__pos": F.lit(1).cast("bigint"), **sums}, maxes={"__reach": F.col("__e")})
    return r.withColumn("__hole", F.col("__s") - F.col("__reach"))


def playback_runs(frames: DataFrame, keys: list[str], block_rows: int = ROWS) -> DataFrame:
    """IV15: runs for playback; a hole of at most one tick is bridged while every
    start and length of the run lies on the local frame grid (within one tick).

    ``frames`` has ``pts, duration`` in ticks, ``tb_num/tb_den`` (seconds per tick) and
    the nominal rate ``fps_num/fps_den``, the same for all frames of a key.
    """
    # unit: 1 / (tb_den * fps_num) second -> tick and nominal frame are integers
    tick = (F.col("tb_num") * F.col("fps_num")).cast("bigint")
    nominal = (F.col("fps_den") * F.col("tb_den")).cast("bigint")
    r = frames.select(*keys, "pts", "duration", tick.alias("__tick"), nominal.alias("__mod"), (F.col("pts") * tick).alias("__s"), ((F.col("pts") + F.col("duration")) * tick).alias("__e"))
    r = _placed(r, keys, floor_div("__s", F.col("__mod") * ROWS))
    length, tick, nom, hole = F.col("__e") - F.col("__s"), F.col("__tick"), F.col("__mod"), F.col("__hole")
    long = _nearest(length, nom)
    clean = (long >= 1) & (F.abs(length - long * nom) <= tick)
    phase = F.pmod("__s", nom)
    kind = F.when(hole.isNull() | (hole > tick) | (hole > 0) & (2 * hole >= nom), 2).when(hole > 0, 1).otherwise(0)
    r = r.select(
        *keys, "pts", "duration", "__pos", "__mod", kind.alias("__kind"), phase.alias("__number"), clean.alias("__clean"),
        F.when(clean, phase - tick).otherwise(1).alias("__lo"), F.when(clean, phase + tick).otherwise(0).alias("__hi"),
    )
    return label_runs(r, keys, ["pts", "duration"], block_rows).groupBy(*keys, "__run").agg(
        F.min("pts").alias("start_pts"), F.max(F.col("pts") + F.col("duration")).alias("end_pts"), F.count(F.lit(1)).alias("n_frames")
    ).drop("__run")


def sample_runs(blocks: DataFrame, keys: list[str], block_rows: int = ROWS) -> DataFrame:
    """IV16: audio blocks to runs; one tick is bridged when the time stamp equals the
    run's start plus its accumulated sample count.

    ``blocks`` has ``pts`` in ticks, ``samples``, and the key's ``rate``, ``tb_num/tb_den``.
    """
    # unit: 1 / (tb_den * rate) second
    tick = (F.col("tb_num") * F.col("rate")).cast("bigint")
    r = blocks.select(
        *keys, "pts", F.col("samples").cast("bigint").alias("samples"), tick.alias("__tick"), F.col("tb_den").cast("bigint").alias("__den"), F.col("rate").cast("bigint").alias("__rate"),
        (F.col("pts") * tick).alias("__s"), (F.col("pts") * tick + F.col("samples") * F.col("tb_den")).alias("__e"),
    )
    r = _placed(r, keys, floor_div("__s", F.col("__den") * F.col("__rate") * 1200), __upto=F.col("samples"))
    hole, tick = F.col("__hole"), F.col("__tick")
    before = (F.col("__upto") - F.col("samples")) * F.col("__den")  # a run keeps start - before; then its due time is that + before
    kind = F.when(hole.isNull() | (hole > tick), 2).when(hole > 0, 1).otherwise(0)
    # due rounds to pts: twice the distance is at most one tick, or less if pts is odd
    odd = F.when(F.col("pts") % 2 == 0, 0).otherwise(1)
    low, high = 2 * F.col("__s") - tick + odd, 2 * F.col("__s") + tick - odd
    soft = kind == 1
    r = r.select(
        *keys, "pts", "samples", "__e", "__pos", kind.alias("__kind"), (F.col("__s") - before).alias("__number"), F.lit(True).alias("__clean"), F.lit(0).cast("bigint").alias("__mod"),
        F.when(soft, -floor_div(-low, F.lit(2)) - before).alias("__lo"), F.when(soft, floor_div(high, F.lit(2)) - before).alias("__hi"),
    )
    return label_runs(r, keys, ["pts", "samples", "__e"], block_rows).groupBy(*keys, "__run").agg(
        F.min("pts").alias("start_pts"), F.sum("samples").alias("samples"), F.max("__e").alias("end_units"), F.count(F.lit(1)).alias("n_blocks")
    ).drop("__run")


def stitch_windows(windows: DataFrame, keys: list[str], agree: list[str]) -> tuple[DataFrame, DataFrame]:
    """IV17: union of observed spans over overlapping windows, and findings where the
    windows of a key disagree in ``agree``.  Holes at seams survive."""
    merged = merge_spans(windows, keys)
    kinds = windows.select(*keys, *agree).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    bad = fd.finding(kinds, "SOURCE_CLOCK_WINDOW_SELECTOR_CHANGED", F.col("n") > 1, F.concat_ws("/", *keys), work=keys[0], evidence=F.col("n"))
    return merged, bad


def reconcile(obs: DataFrame, key: list[str], identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """IV18: one row per key whose observations agree, and the distinct contradictory
    observations of the other keys (each keeps its own extent)."""
    seen = obs.groupBy(*key, *identity).agg(F.count(F.lit(1)).alias("n_obs"))
    kinds = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("__kinds"))
    both = seen.join(kinds, key)
    return both.where("__kinds = 1").drop("__kinds"), both.where("__kinds > 1").drop("__kinds")


def chains(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IV19: maximal chains over ``edges(src, dst)`` between ``nodes(id)``.

    Edges that share a source or a target with another edge are dropped and returned
    second.  Chain heads are found by pointer doubling, so the number of rounds is
    the logarithm of the longest chain.  Nodes on a cycle are not in any chain.
    """
    ids = nodes.select("id").distinct()
    e = edges.select("src", "dst").distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    many_out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    many_in = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    e = e.join(many_out, "src").join(many_in, "dst")
    bad = e.where("n_out > 1 or n_in > 1").select("src", "dst")
    good = e.where("n_out = 1 and n_in = 1").select("src", "dst")
    # up: nearest known ancestor and its distance; NULL marks a head
    state = ids.join(good.select(F.col("dst").alias("id"), F.col("src").alias("up")), "id", "left").withColumn(
        "dist", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint")
    ).withColumn("head", F.when(F.col("up").isNull(), F.col("id")))
    state = cut_lineage(state)
    while open_rows := state.where("head is null").count():
        anc = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"), F.col("head").alias("h2"))
        todo = state.where("head is null").drop("head")
        step = todo.join(anc, "up").select(
            "id", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("h2").alias("head")
        )
        state = cut_lineage(state.where("head is not null").unionByName(step))
        if state.where("head is null").count() == open_rows:
            break  # no progress: only cycles are left
    done = state.where("head is not null").select(F.col("head").alias("chain_id"), "id", F.col("dist").alias("pos"))
    return done, bad


def review_cover(ranges: DataFrame, works: DataFrame, tol_us: int = 50_000) -> DataFrame:
    """IV20: do the checked ranges of a work reach its end without a hole?"""
    r = ranges.join(works.select("work_id", "duration_us"), "work_id")
    r = scan(r, ["work_id"], ["start_us", "end_us", "range_id"], by_time("start_us"), maxes={"__reach": F.col("end_us")})
    hole = F.col("start_us") > F.coalesce("__reach", F.lit(0)) + tol_us
    wrong = (F.col("start_us") < 0) | (F.col("end_us") <= F.col("start_us")) | (F.col("end_us") > F.col("duration_us") + tol_us)
    g = r.groupBy("work_id").agg(F.bool_or(hole | wrong).alias("__bad"), F.max("end_us").alias("reach_us"))
    out = works.select("work_id", "duration_us").join(g, "work_id", "left")
    ok = F.coalesce(~F.col("__bad") & (F.col("reach_us") >= F.col("duration_us") - tol_us), F.lit(False))
    return out.select("work_id", "reach_us", ok.alias("checked"))


def check_constant_rate(frames: DataFrame, keys: list[str], fps_num: int, fps_den: int, tol_us: int = 10, block_us: int = BLOCK_US) -> DataFrame:
    """IV21: frames whose time is not within ``tol_us`` of index / fps."""
    r = positions(frames, keys, ["t_us"], by_time("t_us", block_us), "pos")
    off = F.abs(wide("t_us", fps_num) - wide(F.col("pos") - 1, 1_000_000, fps_den))
    return r.where(off >= F.lit(tol_us * fps_num)).select(*keys, "t_us", (F.col("pos") - 1).alias("index"))


def timed_rows_to_spans(rows: DataFrame, keys: list[str], block_us: int = MERGE_BLOCK_US) -> DataFrame:
    """IV22: own duration, else up to the next row; a last row without one covers nothing."""
    r = scan(rows, keys, ["t_us"], by_time("t_us", block_us), leads={"__next": F.col("t_us")})
    end = F.when(F.col("dur_us") > 0, F.col("t_us") + F.col("dur_us")).otherwise(F.col("__next"))
    spans = r.select(*keys, F.col("t_us").alias("start_us"), end.alias("end_us")).where("end_us > start_us")
    return merge_spans(spans, keys, 0, block_us)


def chains_from(jump: DataFrame, keys: list[str], at: str, to: str, first: int) -> DataFrame:
    """All positions reached from ``first`` by following ``at -> to`` (always forward).

    Reached sets double each round: with jumps of length 2^k from every position,
    the set {first} grows to all heads in a logarithmic number of rounds.
    """
    hop = jump.where(F.col(to).isNotNull()).select(*keys, F.col(at).alias("a"), F.col(to).alias("b"))
    hop = cut_lineage(hop)
    got = jump.where(F.col(at) == first).select(*keys, F.col(at).alias("a"))
    got = cut_lineage(got)
    size = got.count()
    while True:
        more = got.join(hop, [*keys, "a"]).select(*keys, F.col("b").alias("a"))
        got = cut_lineage(got.unionByName(more).distinct())
        new = got.count()
        if new == size:
            break
        size = new
        nxt = hop.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
        hop = cut_lineage(hop.join(nxt, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b")))
    return got.select(*keys, F.col("a").alias(at))
