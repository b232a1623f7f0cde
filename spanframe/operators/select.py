"""Highlight candidates: building, scoring, de-duplication and constrained selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import fixed
from spanframe.functions import text as tx
from spanframe.functions.clock import half_even, wide
from spanframe.operators.intervals import snap_nearest
from spanframe.operators.text import normalized_types
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.ordered import by_rows, scan, top_n


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def scene_score(scores: Column, key: str, default) -> Column:
    """RS11: first alias present in the score map, clamped to 0..1."""
    names = fixed.SCORE_ALIASES.get(key, [key])
    found = F.coalesce(*[F.try_element_at(scores, F.lit(n)) for n in names])
    default = default if isinstance(default, Column) else F.lit(float(default))
    return F.when(found.isNotNull(), clamp01(found)).otherwise(default)


def fallback_hints(units: DataFrame, analysis: DataFrame) -> DataFrame:
    """RS13: hints from score thresholds for units the analysis gave none."""
    j = units.select("unit_id", "motion").join(analysis.select("unit_id", "scores"), "unit_id")
    made = []
    for kind, field, limit, must in fixed.FALLBACK_HINTS:
        cond = scene_score(F.col("scores"), field, 0.0) >= limit
        if kind == "action":
            cond = cond | (F.col("motion") >= fixed.FALLBACK_MOTION)
        made.append(F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(must).alias("must_hear"))))
    return j.select("unit_id", F.posexplode(F.array_compact(F.array(*made))).alias("hint_no", "h")).select(
        "unit_id", "hint_no", F.array("h.kind").alias("types"), "h.must_hear"
    )


def candidates(units: DataFrame, analysis: DataFrame, hints: DataFrame, cues: DataFrame, events: DataFrame, bin_us: int = BIN_US) -> DataFrame:
    """RS12: candidate spans from hints, with scores, quote, events and risks.

    Offsets relative to the unit are repaired, times clamped into the unit, short spans
    widened to 2.4 s, and dialogue spans snapped to cue bounds within 1.2 s.
    ``hints``: unit_id, hint_no, start_hint_us, end_hint_us, types, must_hear;
    ``events``: event_id, source_id, start_us, end_us, confidence, sensitive.
    """
    u = units.select("source_id", "unit_id", F.col("start_us").alias("u0"), F.col("end_us").alias("u1"), "motion", "speech")
    j = hints.join(u, "unit_id").join(analysis.select("unit_id", "scores", "confidence"), "unit_id")
    dur = F.col("u1") - F.col("u0")
    s, e = F.col("start_hint_us"), F.col("end_hint_us")
    s = F.when(s.isNull(), F.col("u0")).when((s < F.col("u0")) & (s >= 0) & (s <= dur), F.col("u0") + s).otherwise(s)
    e = F.when(e.isNull(), F.col("u1")).when((e <= dur) & (e < F.col("u0")), F.col("u0") + e).otherwise(e)
    j = j.withColumn("s", F.greatest(F.col("u0"), F.least(s, F.col("u1") - 50_000)))
    j = j.withColumn("e", F.greatest(F.col("s") + 50_000, F.least(e, F.col("u1"))))
    mid = half_even(wide(1, F.col("s") + F.col("e")), F.lit(2))
    short = F.col("e") - F.col("s") < 1_500_000
    j = j.withColumn("start_us", F.when(short, F.greatest(F.col("u0"), mid - 1_200_000)).otherwise(F.col("s")))
    j = j.withColumn("end_us", F.when(short, F.least(F.col("u1"), mid + 1_200_000)).otherwise(F.col("e"))).drop("s", "e", "start_hint_us", "end_hint_us")
    j = j.withColumn("highlight_id", F.concat_ws("#", "unit_id", "hint_no")).withColumn("types", normalized_types(F.col("types")))
    snap = snap_nearest(j.select("source_id", "highlight_id", "start_us", "end_us"), cues, ["source_id"], span_id="highlight_id")
    j = j.drop("start_us", "end_us").join(snap, ["source_id", "highlight_id"])
    talk = F.array_contains("types", "dialogue")
    a = F.when(talk & F.col("entry_safe"), F.greatest(F.col("u0"), F.col("snap_start_us"))).otherwise(F.col("start_us"))
    b = F.when(talk & F.col("exit_safe"), F.least(F.col("u1"), F.col("snap_end_us"))).otherwise(F.col("end_us"))
    j = j.withColumn("__a", F.when(b <= a, F.col("u0")).otherwise(a)).withColumn("__b", F.when(b <= a, F.col("u1")).otherwise(b))
    j = j.drop("start_us", "end_us").withColumnsRenamed({"__a": "start_us", "__b": "end_us"})
    span = j.select("source_id", "highlight_id", "start_us", "end_us")
    ev = events.select("source_id", "event_id", "confidence", "sensitive", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    ev = interval_join(span, ev, ["source_id"], bin_us=bin_us).groupBy("highlight_id").agg(
        F.array_sort(F.collect_set("event_id")).alias("event_ids"), F.max("confidence").alias("__sig"), F.bool_or("sensitive").alias("__sens")
    )
    cu = cues.select("source_id", F.struct(F.col("ord").alias("o"), F.col("text").alias("t")).alias("__c"), F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    cu = interval_join(span, cu, ["source_id"], bin_us=bin_us).groupBy("highlight_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("__c")), lambda x: x["t"]), " ").alias("quote")
    )
    j = j.join(ev, "highlight_id", "left").join(cu, "highlight_id", "left")
    sig = F.coalesce("__sig", F.lit(0.35))
    m, sp, sc = F.col("motion").cast("double"), F.col("speech").cast("double"), F.col("scores")
    parts = {
        "story_significance": sig, "immediate_intensity": scene_score(sc, "immediate_intensity", m), "performance_value": scene_score(sc, "performance_value", 0.2),
        "dialogue_value": scene_score(sc, "dialogue_value", sp), "visual_value": scene_score(sc, "visual_value", m), "action_value": scene_score(sc, "action_value", m),
        "emotion_value": scene_score(sc, "emotion_value", 0.25), "reveal_value": scene_score(sc, "reveal_value", 0.1), "suspense_value": scene_score(sc, "suspense_value", 0.1),
        "comedy_value": scene_score(sc, "comedy_value", 0.0), "relationship_shift": scene_score(sc, "relationship_shift", 0.2),
        "state_change_strength": scene_score(sc, "state_change_strength", 0.3), "context_independence": F.lit(0.5), "genre_fit": F.lit(0.5), "novelty": F.lit(0.5),
    }
    both = F.col("entry_safe") & F.col("exit_safe")
    return j.select(
        "highlight_id", "source_id", "unit_id", "start_us", "end_us", "types",
        (F.col("must_hear") | F.arrays_overlap("types", F.array(*[F.lit(t) for t in fixed.MUST_HEAR_TYPES]))).alias("must_hear"),
        F.coalesce("event_ids", F.array().cast("array<string>")).alias("event_ids"), F.coalesce("quote", F.lit("")).alias("quote"),
        F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]).alias("scores"),
        F.create_map(
            F.lit("spoiler"), F.when(F.col("__sens"), 0.85).otherwise(0.0), F.lit("context_dependency"), F.lit(0.5), F.lit("redundancy"), F.lit(0.0),
            F.lit("unsafe_boundary"), F.when(both | ~talk, 0.0).otherwise(0.65),
        ).alias("risks"),
        F.least(F.col("confidence"), F.greatest(F.lit(0.3), sig)).alias("confidence"),
    )


def genre_weights(profile: str) -> dict[str, float]:
    """RS14: base weights times the profile's multipliers, renormalised."""
    mult = fixed.GENRE_MULTIPLIERS.get(profile, {})
    raw = {k: w * mult.get(k, 1.0) for k, w in fixed.BASE_WEIGHTS.items()}
    total = sum(raw.values()) or 1.0
    return {k: w / total for k, w in raw.items()}


def weight_table(spark) -> DataFrame:
    """RS14 for every profile (a fixed table of 5 x 15 rows plus the plain weights)."""
    rows = [(p, k, w) for p in [*fixed.GENRE_MULTIPLIERS, "general"] for k, w in genre_weights(p).items()]
    return spark.createDataFrame(rows, "profile string, field string, weight double")


def weighted(scores: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k in sorted(weights):
        out = out + F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * weights[k]
    return out


def final_score(cand: DataFrame, weights: dict[str, float], scorer: Callable = weighted) -> DataFrame:
    """RS15: (weighted scores - risk penalty) * (0.65 + 0.35 * confidence), clamped.

    ``scorer`` (UF1) maps the score column and the weights to the positive part.
    """
    penalty = F.lit(0.0)
    for k, w in fixed.RISK_WEIGHTS.items():
        penalty = penalty + F.coalesce(F.try_element_at(F.col("risks"), F.lit(k)), F.lit(0.0)) * w
    value = (scorer(F.col("scores"), weights) - penalty) * (0.65 + 0.35 * F.col("confidence"))
    return cand.withColumn("final_score", clamp01(value))


def pool_cut(cand: DataFrame, pool_size: int = 80, score: str = "score") -> DataFrame:
    """The best ``pool_size`` candidates per work (the feature's own limit)."""
    order = [F.col(score).desc(), F.col("ord").asc()]
    return top_n(cand, ["work_id"], order, pool_size, F.col("highlight_id"), name="pool_rank")


def dedup_overlaps(pool: DataFrame, ratio_pct: int = 65, score: str = "score") -> DataFrame:
    """RS16: in score order, a candidate that covers ``ratio`` of the shorter span of a
    kept one of the same source is absorbed by the first such one.

    ``pool`` is a pool-cut table, so the fold runs over at most ``pool_size`` rows of a
    work.  Adds ``absorbed_by`` (NULL for survivors) and ``all_types`` on survivors.
    """
    item = F.struct(
        (-F.col(score)).alias("k"), F.col("ord").alias("o"), F.col("highlight_id").alias("id"), F.col("source_id").alias("src"), F.col("start_us").alias("s"), F.col("end_us").alias("e")
    )
    rows = pool.groupBy("work_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    kept_t, gone_t = "array<struct<id:string,src:string,s:bigint,e:bigint>>", "array<struct<id:string,into:string>>"

    def near(k, x):
        both = F.least(k["e"], x["e"]) - F.greatest(k["s"], x["s"])
        base = F.greatest(F.lit(1).cast("bigint"), F.least(k["e"] - k["s"], x["e"] - x["s"]))
        return (k["src"] == x["src"]) & (F.greatest(both, F.lit(0)) * 100 >= base * ratio_pct)

    def step(acc, x):
        hit = F.filter(acc["kept"], lambda k: near(k, x))
        me = F.struct(x["id"].alias("id"), x["src"].alias("src"), x["s"].alias("s"), x["e"].alias("e"))
        return F.when(
            F.size(hit) > 0,
            F.struct(acc["kept"].alias("kept"), F.array_append(acc["gone"], F.struct(x["id"].alias("id"), hit[0]["id"].alias("into"))).alias("gone")),
        ).otherwise(F.struct(F.array_append(acc["kept"], me).alias("kept"), acc["gone"].alias("gone")))

    start = F.struct(F.array().cast(kept_t).alias("kept"), F.array().cast(gone_t).alias("gone"))
    gone = rows.select("work_id", F.explode(F.aggregate("c", start, step, lambda a: a["gone"])).alias("g")).select("work_id", F.col("g.id").alias("highlight_id"), F.col("g.into").alias("absorbed_by"))
    out = pool.join(gone, ["work_id", "highlight_id"], "left")
    owner = F.coalesce("absorbed_by", "highlight_id")
    t = out.select("work_id", owner.alias("highlight_id"), F.struct((F.col("absorbed_by").isNotNull()).alias("b"), (-F.col(score)).alias("k"), F.col("ord").alias("o"), F.col("types").alias("t")).alias("x"))
    t = t.groupBy("work_id", "highlight_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]))).alias("all_types"))
    return out.join(t, ["work_id", "highlight_id"], "left")


def select_diverse(kept: DataFrame, final_size: int = 24, min_conf: int = 62, max_red: int = 35, type_pct: int = 45, char_pct: int = 65, score: str = "score") -> DataFrame:
    """RS17: pick in score order under running type and character shares.

    Confidence and redundancy are in percent.  Shares count from the fifth pick on.
    The fold runs over one work's pool; after ``final_size`` picks the rest is left
    without a reason.  Adds ``selected`` and ``rejection``.
    """
    item = F.struct(
        (-F.col(score)).alias("k"), F.col("ord").alias("o"), F.col("highlight_id").alias("id"), F.col("types")[0].alias("t"),
        F.when(F.size("characters") > 0, F.get("characters", F.lit(0))).alias("c"), F.col("confidence").alias("conf"), F.col("redundancy").alias("red"),
    )
    rows = kept.groupBy("work_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    empty = F.array().cast("array<string>")

    def step(acc, x):
        nxt = F.size(acc["t"]) + 1
        same_t = F.size(F.filter(acc["t"], lambda v: v == x["t"])) + 1
        same_c = F.size(F.filter(acc["c"], lambda v: v == x["c"])) + 1
        reason = (
            F.when(nxt > final_size, "NOT_REACHED")
            .when(x["conf"] < min_conf, "LOW_CONFIDENCE")
            .when(x["red"] > max_red, "REDUNDANT")
            .when((nxt > 4) & (same_t * 100 > nxt * type_pct), "TYPE_SHARE")
            .when(x["c"].isNotNull() & (nxt > 4) & (same_c * 100 > nxt * char_pct), "CHARACTER_SHARE")
            .otherwise("")
        )
        ok = reason == ""
        return F.struct(
            F.when(ok, F.array_append(acc["t"], x["t"])).otherwise(acc["t"]).alias("t"),
            F.when(ok, F.array_append(acc["c"], F.coalesce(x["c"], F.lit("")))).otherwise(acc["c"]).alias("c"),
            F.array_append(acc["r"], reason).alias("r"),
        )

    start = F.struct(empty.alias("t"), empty.alias("c"), empty.alias("r"))
    marks = F.aggregate("c", start, step, lambda a: a["r"])
    pairs = rows.select("work_id", F.explode(F.arrays_zip(F.col("c"), marks.alias("r"))).alias("z"))
    pairs = pairs.select("work_id", F.col("z.c.id").alias("highlight_id"), F.col("z.r").alias("rejection"))
    return kept.join(pairs, ["work_id", "highlight_id"]).withColumn("selected", F.col("rejection") == "")


def ledger(cand: DataFrame, pool_size: int = 80, **limits) -> DataFrame:
    """RS18: every candidate with its fate; order by selected first, then score."""
    pool = pool_cut(cand, pool_size)
    d = dedup_overlaps(pool)
    s = select_diverse(d.where("absorbed_by is null").drop("absorbed_by", "all_types"), **limits)
    fate = d.select("work_id", "highlight_id", "absorbed_by").join(s.select("work_id", "highlight_id", "selected", "rejection"), ["work_id", "highlight_id"], "left")
    out = cand.join(fate.withColumn("__in", F.lit(True)), ["work_id", "highlight_id"], "left")
    why = F.when(F.col("__in").isNull(), "POOL_BUDGET_EXHAUSTED").when(F.col("absorbed_by").isNotNull(), "OVERLAPS_KEPT").otherwise(F.col("rejection"))
    return out.withColumn("rejection", why).withColumn("selected", F.coalesce("selected", F.lit(False))).drop("__in")


def hook_eligibility(highlights: DataFrame, events: DataFrame, spans: DataFrame, knowledge: DataFrame, allow_spoilers: bool = False, bin_us: int = BIN_US, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """RS19: may a highlight open the work?  Every linked later event must permit it.

    ``highlights``: work_id, highlight_id, source_id, start_us, end_us, event_ids.
    ``events``: work_id, event_id, reveal_order.  ``knowledge``: work_id, event_id, allow_prepose.
    ``counted``: tables with no fewer highlights and spans that cost less to measure.
    """
    keys = ["work_id", "highlight_id"]
    h = highlights.select(*keys, "source_id", "start_us", "end_us", "event_ids")
    named = h.select(*keys, F.explode("event_ids").alias("event_id"))
    s = lambda t: t.select("work_id", "event_id", "source_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    found = interval_join(h.where(F.size("event_ids") == 0), s(spans), ["work_id", "source_id"], bin_us=bin_us, counted=(counted[0], s(counted[1])) if counted else None)
    found = found.select(*keys, "event_id").distinct()
    first = events.groupBy("work_id").agg(F.min("reveal_order").alias("__first"))
    links = named.unionByName(found).join(events, ["work_id", "event_id"], "left").join(first, "work_id", "left").join(knowledge, ["work_id", "event_id"], "left")
    late = F.col("reveal_order") > F.col("__first")
    g = links.groupBy(*keys).agg(
        F.bool_or(F.col("reveal_order").isNull()).alias("__unknown"), F.bool_or(late).alias("__late"),
        F.array_sort(F.collect_set(F.when(late & ~F.coalesce("allow_prepose", F.lit(False)), F.col("event_id")))).alias("denied"),
    )
    out = highlights.select(*keys).join(g, keys, "left")
    reason = (
        F.when(F.coalesce("__unknown", F.lit(True)), "NO_VALID_EVENT_LINK")
        .when(F.lit(allow_spoilers), "EXPLICIT_SPOILER_OVERRIDE")
        .when(~F.col("__late"), "EARLIEST_REVEAL")
        .when(F.size("denied") > 0, "PREPOSE_DENIED")
        .otherwise("ALL_ALLOWED")
    )
    out = out.withColumn("reason", reason)
    ok = F.col("reason").isin("EXPLICIT_SPOILER_OVERRIDE", "EARLIEST_REVEAL", "ALL_ALLOWED")
    return out.select(*keys, ok.alias("eligible"), "reason", F.coalesce("denied", F.array().cast("array<string>")).alias("denied"))


def target_duration(works: DataFrame) -> DataFrame:
    """RS20: target length from source length, events, characters and reveals.

    ``works``: work_id, duration_mode, source_sec, n_events, n_characters, n_reveals.
    """
    r = fixed.DURATION_RANGES
    cx = F.col("n_events") + F.col("n_characters") * 1.5 + F.col("n_reveals") * 2.5
    src = F.col("source_sec")
    want = F.greatest(src * F.when(src > 5400, 0.10).otherwise(0.13), 150 + cx * 9)
    auto = F.when((cx < 28) & (src < 2400), "short").when((cx < 58) & (src < 5400), "standard").otherwise("deep")
    is_auto = ~F.col("duration_mode").isin("highlight", "short", "standard", "deep", "series")
    mode = F.when(is_auto, auto).otherwise(F.col("duration_mode"))
    table = F.create_map(*[x for k, (a, b) in r.items() for x in (F.lit(k), F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")))])
    box = F.element_at(table, F.when(mode == "series", "deep").otherwise(mode))
    value = (
        F.when(is_auto, F.round(F.greatest(box["lo"], F.least(box["hi"], want)), 1))
        .when(mode == "series", box["hi"])
        .otherwise((box["lo"] + box["hi"]) / 2)
    )
    return works.select("work_id", mode.alias("mode"), value.alias("target_sec"))


def normalize_segments(segments: DataFrame, visuals: DataFrame, pool: DataFrame, highlights: DataFrame, min_cps: float = 4.2, max_cps: float = 5.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RS24: segments, their visuals and findings after normalisation.

    Voice visuals take the highlight of their pool unit; an original segment bound to a
    highlight takes its range and length; voice length follows the text.
    """
    keys = ["work_id", "segment_id"]
    p = pool.select("unit_id", F.col("highlight_id").alias("__ph"), F.col("source_id").alias("__ps"), F.col("start_us").alias("__p0"), F.col("end_us").alias("__p1"))
    mode = segments.select(*keys, "mode", "highlight_id")
    v = visuals.join(mode.withColumnRenamed("highlight_id", "__sh"), keys).join(p, "unit_id", "left")
    voiced = F.col("mode") == "voiceover"
    bad_v = fd.checks(
        v,
        [
            ("VISUAL_UNIT_UNKNOWN", voiced & F.col("__ps").isNull()),
            ("VISUAL_SOURCE_MISMATCH", voiced & (F.col("__ps") != F.col("source_id"))),
            ("VISUAL_LEAVES_UNIT", voiced & ((F.col("start_us") < F.col("__p0") - 1000) | (F.col("end_us") > F.col("__p1") + 1000))),
        ],
        entity=F.concat_ws("/", "segment_id", "ord"), source="source_id",
    )
    v = v.withColumn("highlight_id", F.when(voiced, F.col("__ph")))
    only = v.where("highlight_id is not null").groupBy(*keys).agg(F.count_distinct("highlight_id").alias("__n"), F.min("highlight_id").alias("__h"))
    s = segments.join(only, keys, "left").withColumn("highlight_id", F.coalesce("highlight_id", F.when(F.col("__n") == 1, F.col("__h")))).drop("__n", "__h")
    h = highlights.select("work_id", "highlight_id", F.col("source_id").alias("h_source"), F.col("start_us").alias("h0"), F.col("end_us").alias("h1"), F.col("quote").alias("h_quote"))
    s = s.join(h, ["work_id", "highlight_id"], "left")
    bound = (F.col("mode") == "original") & F.col("h_source").isNotNull()
    total = visuals.groupBy(*keys).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("__vis"), F.count(F.lit(1)).alias("__nv"))
    s = s.join(total, keys, "left").na.fill(0, ["__vis", "__nv"])
    units = tx.text_units("text")
    ideal = F.when(units > 0, units * 2_000_000 / (min_cps + max_cps)).otherwise(F.lit(1_000_000.0))
    low = F.greatest(F.lit(1_000_000.0), F.when(units > 0, units * 1_000_000 / max_cps).otherwise(F.lit(1_000_000.0)))
    high = F.greatest(F.lit(1_000_000.0), F.col("__vis").cast("double"))
    voice_len = F.least(high, F.greatest(low, F.greatest(F.col("planned_us").cast("double"), ideal)))
    planned = F.when(bound, F.col("h1") - F.col("h0")).when(F.col("mode") == "original", F.col("planned_us")).otherwise(F.round(voice_len).cast("bigint"))
    text = F.when(bound & (F.coalesce("text_raw", F.lit("")) == ""), F.col("h_quote")).otherwise(F.coalesce(F.when(bound, F.col("text_raw")), F.col("text")))
    missing = fd.finding(s, "SEGMENT_WITHOUT_VISUAL", (F.col("__nv") == 0) & ~bound, F.col("segment_id"))
    seg = s.select(*keys, "ord", "mode", "highlight_id", planned.alias("planned_us"), text.alias("text"))
    own = s.where(bound).select(*keys, F.lit(1).cast("bigint").alias("ord"), F.col("h_source").alias("source_id"), F.col("h0").alias("start_us"), F.col("h1").alias("end_us"), F.concat(F.lit("highlight:"), "highlight_id").alias("unit_id"), "highlight_id")
    rest = v.join(s.where(bound).select(*keys), keys, "left_anti").select(*keys, "ord", "source_id", "start_us", "end_us", "unit_id", "highlight_id")
    return seg, own.unionByName(rest), bad_v.unionByName(missing)


def apply_boundary_delta(segments: DataFrame, beats: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RS25: lengths of original segments, beats and plan after highlights moved.

    ``moved(work_id, highlight_id, old_len_us, new_len_us)``.  Returns the affected
    segments with their delta and the beats with adjusted targets (invalid ones flagged).
    """
    s = segments.where("mode = 'original'").join(moved, ["work_id", "highlight_id"])
    s = s.withColumn("delta_us", F.col("new_len_us") - F.col("planned_us"))
    d = s.groupBy("work_id", "beat_id").agg(F.sum("delta_us").alias("delta_us"))
    b = beats.join(d, ["work_id", "beat_id"], "left").na.fill(0, ["delta_us"])
    b = b.withColumn("target_us", F.col("target_us") + F.col("delta_us")).withColumn("target_original_us", F.col("target_original_us") + F.col("delta_us"))
    return s.select("work_id", "segment_id", "beat_id", "delta_us"), b.withColumn("invalid", (F.col("target_us") <= 0) | (F.col("target_original_us") < 0))
