"""Evidence retrieval: lexical scores, exclusions, ranks, pools and their coverage."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanframe.functions import text as tx
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.ordered import by_rows, positions, scan, top_n
from spanframe.plans.rounds import cut_lineage
from spanframe.plans.skew import SENT


def build_requests(beats: DataFrame, events: DataFrame, spans: DataFrame, characters: DataFrame) -> DataFrame:
    """RS1: one request per beat: query text, allowed sources, knowledge allowed so far.

    ``beats``: work_id, beat_id, ord, change, event_ids, character_ids (arrays).
    ``events``: work_id, event_id, text.  ``characters``: work_id, character_id, names
    (array), temporary.  ``known_upto`` of the result is the beat order up to which
    events may be known; see :func:`allowed_events` for the set itself.
    """
    keys = ["work_id", "beat_id"]
    e = beats.select(*keys, F.posexplode("event_ids").alias("p", "event_id")).join(events, ["work_id", "event_id"])
    texts = e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]).alias("events"))
    src = e.join(spans.select("work_id", "event_id", "source_id"), ["work_id", "event_id"]).select(*keys, "source_id").distinct()
    src = src.groupBy(*keys).agg(F.array_sort(F.collect_list("source_id")).alias("sources"))
    c = beats.select(*keys, F.posexplode("character_ids").alias("p", "character_id")).join(characters.where("not temporary"), ["work_id", "character_id"])
    names = c.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "names"))), lambda x: x["names"])).alias("aliases"))
    none = F.array().cast("array<string>")
    r = beats.join(texts, keys, "left").join(src, keys, "left").join(names, keys, "left")
    r = r.select("work_id", "beat_id", "ord", "change", F.coalesce("events", none).alias("events"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("sources", none).alias("sources"))
    full = F.array_join(F.concat(F.array("change"), "events", "aliases"), " ")
    clean = F.array_join(F.concat("aliases", F.filter("events", lambda x: ~tx.asserts_hidden_state(x))), " ")
    return r.select("work_id", "beat_id", "ord", "sources", F.when(tx.asserts_hidden_state(full), clean).otherwise(full).alias("query"), F.col("ord").alias("known_upto"))


def allowed_events(beats: DataFrame) -> DataFrame:
    """First beat order at which an event may be known (the running union of RS1)."""
    return beats.select("work_id", F.col("ord"), F.explode("event_ids").alias("event_id")).groupBy("work_id", "event_id").agg(F.min("ord").alias("known_from"))


def asked(terms: DataFrame, query_terms: DataFrame) -> DataFrame:
    """The rows of ``terms`` that some query asks for; no other term adds to a score."""
    words = cut_lineage(query_terms.select("term").distinct())
    return terms.join(F.broadcast(words) if words.count() <= SENT else words, "term", "left_semi").select(*terms.columns)


def doc_freq(terms: DataFrame, units: DataFrame) -> DataFrame:
    """RS2: in how many units each term occurs, with the number of units."""
    n = units.agg(F.count(F.lit(1)).alias("n_units")).withColumn("__one", F.lit(1))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("__one", F.lit(1))
    return df.join(F.broadcast(n), "__one").drop("__one")  # n is one row


def idf(df, n):
    return F.log(1 + n / df)


def score(query_terms: DataFrame, terms: DataFrame, freq: DataFrame, scorer: Callable = idf, match: list[str] | None = None) -> DataFrame:
    """RS3: summed weight of shared terms per (beat, unit), rounded to 8 places.

    ``match`` may add join columns, such as the source a beat is bound to, so that
    only allowed pairs are formed.  Every pair with a shared term is a row: for a ranking
    up to some place use :func:`top_ranked`.  ``scorer`` maps (df, n_units) columns to a
    weight (UF1).
    """
    on = ["term", *(match or [])]
    q = query_terms.join(freq, "term").withColumn("w", scorer(F.col("df"), F.col("n_units")))
    pairs = terms.join(q, on)
    out = pairs.groupBy("beat_id", "unit_id").agg(F.sum("w").alias("__s"), F.count(F.lit(1)).alias("n_terms"), F.array_sort(F.collect_list("term")).alias("matched"))
    return out.select("beat_id", "unit_id", F.round("__s", 8).alias("score"), "n_terms", "matched")


def direct_pairs(spans: DataFrame, units: DataFrame, bin_us: int = BIN_US) -> DataFrame:
    """(beat, unit) pairs where the unit overlaps a source range of the beat."""
    s = spans.select("beat_id", "source_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    return interval_join(units.select("source_id", "unit_id", "start_us", "end_us"), s, ["source_id"], bin_us=bin_us).select("beat_id", "unit_id").distinct()


def exclusions(scores: DataFrame, direct: DataFrame, units: DataFrame, sources: DataFrame, reveals: DataFrame, allowed: DataFrame, explore: bool = True) -> DataFrame:
    """RS4: verdict of each candidate pair in the fixed order source, knowledge, evidence.

    Pairs that share no term and no range are not listed: they all lack evidence.
    ``sources(beat_id, source_id)``; ``reveals(unit_id, event_id)``;
    ``allowed(beat_id, event_id)``.
    """
    c = scores.select("beat_id", "unit_id", "score").join(direct.withColumn("direct", F.lit(True)), ["beat_id", "unit_id"], "full")
    c = c.select("beat_id", "unit_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("direct", F.lit(False)).alias("direct"))
    c = c.join(units.select("unit_id", "source_id"), "unit_id")
    c = c.join(sources.select("beat_id", "source_id", F.lit(True).alias("__ok")), ["beat_id", "source_id"], "left")
    bound = sources.select("beat_id").distinct().withColumn("__bound", F.lit(True))
    c = c.join(bound, "beat_id", "left")
    r = c.select("beat_id", "unit_id").join(reveals, "unit_id").join(allowed.select("beat_id", "event_id"), ["beat_id", "event_id"], "left_anti")
    c = c.join(r.select("beat_id", "unit_id").distinct().withColumn("__early", F.lit(True)), ["beat_id", "unit_id"], "left")
    weak = ~F.col("direct") & ((F.col("score") <= 0) | F.lit(not explore))
    reason = (
        F.when(F.col("__bound").isNotNull() & F.col("__ok").isNull(), "source_constraint")
        .when(F.col("__early").isNotNull(), "knowledge_constraint")
        .when(weak, "no_query_evidence")
    )
    return c.select("beat_id", "unit_id", "score", "direct", reason.alias("reason"))


def exclusion_counts(cand: DataFrame, units: DataFrame, sources: DataFrame, reveals: DataFrame, allowed: DataFrame) -> DataFrame:
    """RS4 in numbers: of all units, how many each bound beat excludes for which reason.

    ``cand`` is the result of :func:`exclusions`.  Pairs that share nothing are counted,
    not formed: units outside a beat's sources from the sizes of sources, early ones from
    the sizes of classes of units that reveal the same events, and those without evidence
    as the rest.
    """
    bound = sources.select("beat_id", "source_id").distinct()
    total = units.count()
    sizes = units.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    inside = bound.join(sizes, "source_id", "left").groupBy("beat_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_inside"))
    shown = reveals.groupBy("unit_id").agg(F.array_sort(F.collect_set("event_id")).alias("events"))
    classes = units.select("unit_id", "source_id").join(shown, "unit_id").groupBy("source_id", "events").agg(F.count(F.lit(1)).alias("k"))
    known = allowed.groupBy("beat_id").agg(F.collect_set("event_id").alias("known"))
    late = bound.join(classes, "source_id").join(known, "beat_id", "left")
    unknown = F.size(F.array_except("events", F.coalesce("known", F.expr("cast(array() as array<string>)")))) > 0
    late = late.where(unknown).groupBy("beat_id").agg(F.sum("k").alias("n_late"))
    ranked = cand.where("reason is null").groupBy("beat_id").agg(F.count(F.lit(1)).alias("n_ranked"))
    c = inside.join(late, "beat_id", "left").join(ranked, "beat_id", "left").na.fill(0, ["n_late", "n_ranked"])
    return c.select(
        "beat_id", (F.lit(total) - F.col("n_inside")).cast("bigint").alias("source_constraint"), F.col("n_late").cast("bigint").alias("knowledge_constraint"),
        (F.col("n_inside") - F.col("n_late") - F.col("n_ranked")).cast("bigint").alias("no_query_evidence"), F.col("n_ranked").cast("bigint").alias("n_ranked"),
    )


def rank(cand: DataFrame) -> DataFrame:
    """RS5: the units of each beat by score, direct evidence first, id; nothing is cut.

    Ranks are positions: equal scores share a block however many there are, so a beat's
    rows spread over tasks.
    """
    kept = cand.where("reason is null").drop("reason")
    # a total order as one column, so that the ordered scan can cut blocks by it
    ranked = positions(kept.withColumn("__neg", -F.col("score")).withColumn("__late", ~F.col("direct")), ["beat_id"], ["__neg", "__late", "unit_id"], F.floor(F.col("__neg") * 4).cast("bigint"), "rank")
    return ranked.drop("__neg", "__late")


def pair_scores(pairs: DataFrame, weights: DataFrame, terms: DataFrame) -> DataFrame:
    """The scores of given (beat, unit) pairs, each computed in its row from the unit's terms.

    ``weights(beat_id, term, w)``: one map per beat; only the terms of units in ``pairs`` are gathered.
    """
    by_beat = weights.groupBy("beat_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("__w"))
    held = terms.join(pairs.select("unit_id").distinct(), "unit_id", "left_semi").groupBy("unit_id").agg(F.array_sort(F.collect_set("term")).alias("__terms"))
    rows = pairs.select("beat_id", "unit_id").join(by_beat, "beat_id").join(held, "unit_id", "left")
    shared = F.filter(F.coalesce("__terms", F.expr("cast(array() as array<string>)")), lambda t: F.map_contains_key("__w", t))
    total = F.aggregate(shared, F.lit(0.0), lambda a, t: a + F.element_at("__w", t))
    return rows.select("beat_id", "unit_id", F.round(total, 8).alias("score"), F.size(shared).cast("bigint").alias("n_terms"))


def top_ranked(
    query_terms: DataFrame, terms: DataFrame, freq: DataFrame, direct: DataFrame, units: DataFrame, sources: DataFrame, reveals: DataFrame, allowed: DataFrame,
    k: int, scorer: Callable = idf, match: list[str] | None = None,
) -> DataFrame:
    """RS3 to RS5 up to a place: the ranking of each beat, exact for its first ``k`` ranks.

    Rare terms are looked up first.  The k-th best score among some units that hold them is
    a threshold; terms whose weights together stay below it cannot lift a unit over it, so only
    units with one of the other, rarer terms are scored, in their rows.  Common terms are
    never expanded to pairs unless a beat has no others.  Besides the first ``k`` without
    direct evidence all direct pairs are returned, so a pool finds its front rows here.
    ``terms`` is read in every step: pass a table, not a plan that splits texts anew.
    """
    on = ["term", *(match or [])]
    direct = cut_lineage(direct)
    q = cut_lineage(query_terms.select("beat_id", *on).distinct().join(freq, "term").withColumn("w", scorer(F.col("df"), F.col("n_units"))))
    weights = q.select("beat_id", "term", "df", "w").distinct()
    rarest = Window.partitionBy("beat_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = weights.withColumn("__before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("__before") < 4 * k).select("beat_id", "term")
    some = terms.join(q.join(first, ["beat_id", "term"]).select("beat_id", *on), on).select("beat_id", "term", "unit_id")
    some = top_n(some, ["beat_id", "term"], [F.col("unit_id")], 4 * k, F.col("unit_id")).select("beat_id", "unit_id").distinct()
    tried = exclusions(pair_scores(some, weights, terms), direct, units, sources, reveals, allowed).where("reason is null AND NOT direct")
    best = top_n(tried, ["beat_id"], [F.col("score").desc(), F.col("unit_id")], k, F.col("unit_id"))
    least = cut_lineage(best.groupBy("beat_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("beat_id", "least"))
    # terms by rising weight: together below the threshold they need a rarer one beside them
    rising = Window.partitionBy("beat_id").orderBy("w", F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = weights.withColumn("__sum", F.sum(F.greatest("w", F.lit(0.0))).over(rising)).join(least, "beat_id", "left")
    needed = needed.where(F.col("least").isNull() | (F.col("__sum") >= F.col("least") - 1e-6)).select("beat_id", "term")
    found = terms.join(q.join(needed, ["beat_id", "term"]).select("beat_id", *on), on).select("beat_id", "unit_id")
    pairs = cut_lineage(found.unionByName(direct.select("beat_id", "unit_id")).distinct())
    kept = exclusions(pair_scores(pairs, weights, terms), direct, units, sources, reveals, allowed).where("reason is null")
    others = top_n(kept.where("NOT direct"), ["beat_id"], [F.col("score").desc(), F.col("unit_id")], k, F.col("unit_id"), name="__k").drop("__k")
    return rank(cut_lineage(kept.where("direct").unionByName(others)))


STATE = ["work_id", "queue", "picks", "room", "free", "done"]  # of a pool between rounds


def front_rows(ranked: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Of each beat the first ``limit`` direct rows and the first ``limit`` others.

    A round robin that takes at most ``limit`` units in all passes over fewer than
    ``limit`` taken ones in a queue, so it never looks behind these rows.
    """
    parts = [top_n(ranked.where(F.col("direct") == d), keys, [F.col("rank")], limit, F.col("unit_id"), name="__k").drop("__k") for d in (True, False)]
    return parts[0].unionByName(parts[1])


def pick_pool(ranked: DataFrame, limit: int = 160, explore: float = 0.15, budget: int | None = None, size_fn: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """RS6: round-robin over the beats of a work, in the order of their SHA-256.

    No unit twice, at most ``limit * explore`` picks without direct evidence, total
    ``size_fn`` (UF2, of a table of rows) within ``budget``.  A work's group holds each beat's front rows: the
    first that still fit.  With a budget, small rows may stand far behind; when a beat has
    used up its front, the work goes on in another round with the first rows that fit what
    is then left.
    """
    rows = ranked.select("work_id", "beat_id", "unit_id", "direct", "rank")
    if size_fn is None:
        rows = rows.withColumn("size", F.lit(0).cast("bigint"))
    else:
        rows = rows.mapInPandas(lambda parts: (p.assign(size=size_fn(p).astype("int64")) for p in parts), "work_id string, beat_id string, unit_id string, direct boolean, rank bigint, size bigint")
    rows = cut_lineage(rows)
    direct_units = rows.where("direct").select("work_id", "unit_id").distinct().withColumn("__any", F.lit(True))
    none = 2**62

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = right.iloc[0]
        queue, picks, room, free = json.loads(state["queue"]), json.loads(state["picks"]), int(state["room"]), int(state["free"])
        taken = {p[1] for p in picks}
        fronts = {b: list(g.sort_values("rank").itertuples(index=False)) for b, g in left.groupby("beat_id")}
        ends = {  # the last rank of a front that was cut off: what comes next may stand behind it
            (b, bool(d)): int(g["rank"].max()) for (b, d), g in left.groupby(["beat_id", "direct"]) if len(g) >= limit
        }
        while queue and len(picks) < limit:
            beat = queue[0]
            fits = lambda r: r.unit_id not in taken and (r.direct or free > 0) and r.size <= room
            r = next(filter(fits, fronts.get(beat, ())), None)
            seen = min(ends.get((beat, d), none) for d in ((True, False) if free > 0 else (True,)))
            if (none - 1 if r is None else r.rank) > seen:
                break  # an earlier row may fit behind a front
            queue.pop(0)
            if r is None:
                continue  # this beat has nothing more to offer
            queue.append(beat)
            taken.add(r.unit_id)
            picks.append([beat, r.unit_id, bool(r.direct)])
            free -= not r.direct
            room -= int(r.size)
        done = not queue or len(picks) >= limit
        return pd.DataFrame([[state["of_work"], json.dumps(queue), json.dumps(picks), room, free, done]], columns=STATE)

    beats = rows.select("work_id", "beat_id").distinct().groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct(F.sha2("beat_id", 256).alias("s"), F.col("beat_id").alias("b")))).alias("q"))
    state = beats.select(
        "work_id", F.to_json(F.transform("q", lambda x: x["b"])).alias("queue"), F.lit("[]").alias("picks"), F.lit(none if budget is None else budget).cast("bigint").alias("room"),
        F.lit(int(limit * explore)).cast("bigint").alias("free"), F.lit(False).alias("done"),
    )
    ended = None
    while True:
        taken = F.transform(F.from_json("picks", "array<array<string>>"), lambda p: p[1])
        open_ = state.select("work_id", "room", "free", taken.alias("taken"))
        fit = rows.join(open_, "work_id").where((F.col("size") <= F.col("room")) & (F.col("direct") | (F.col("free") > 0)) & ~F.array_contains("taken", F.col("unit_id")))
        front = front_rows(fit.drop("room", "free", "taken"), limit, ["work_id", "beat_id"])
        after = cut_lineage(front.groupBy("work_id").cogroup(state.withColumnRenamed("work_id", "of_work").groupBy("of_work")).applyInPandas(step, "work_id string, queue string, picks string, room bigint, free bigint, done boolean"))
        ended = after.where("done") if ended is None else ended.unionByName(after.where("done"))
        state = after.where("NOT done")
        if state.isEmpty():
            break
    picks = ended.select("work_id", F.posexplode(F.from_json("picks", "array<array<string>>")).alias("n", "p"))
    out = picks.select("work_id", F.col("p")[0].alias("beat_id"), F.col("p")[1].alias("unit_id"), (F.col("n") + 1).alias("pick"), (F.col("p")[2] == "true").alias("direct"))
    role = F.when(F.coalesce("__any", F.lit(False)), "direct_evidence").otherwise("context")
    return out.join(direct_units, ["work_id", "unit_id"], "left").select("work_id", "beat_id", "unit_id", "pick", "direct", role.alias("role"))


def pool_coverage(beats: DataFrame, ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """RS7: what the pool offers each beat, by the uncut ranking; beats without direct units stay unknown."""
    sel = ranked.join(pool.select("work_id", "unit_id"), ["work_id", "unit_id"], "left_semi")
    g = sel.groupBy("work_id", "beat_id").agg(F.count(F.lit(1)).alias("n_selected"), F.count_if("direct").alias("n_direct"))
    out = beats.select("work_id", "beat_id").join(g, ["work_id", "beat_id"], "left").na.fill(0, ["n_selected", "n_direct"])
    return out.withColumn("status", F.when(F.col("n_direct") > 0, "candidate_evidence").otherwise("unknown")).withColumn(
        "reason", F.when(F.col("n_selected") > 0, "").otherwise("no_evidence_or_budget_exhausted")
    )


def support_recall(gold: DataFrame, sets: DataFrame) -> DataFrame:
    """RS8: does a set hold all ids of at least one alternative of a beat?

    ``gold(beat_id, alt, unit_id)``; ``sets(set_name, beat_id, unit_id)`` where a NULL
    beat_id means the set serves every beat.  Missing gold yields no row.
    """
    need = gold.select("beat_id", "alt", "unit_id").distinct()
    size = need.groupBy("beat_id", "alt").agg(F.count(F.lit(1)).alias("need"))
    own = need.join(sets.where("beat_id is not null").select("set_name", "beat_id", "unit_id").distinct(), ["beat_id", "unit_id"])
    shared = need.join(sets.where("beat_id is null").select("set_name", "unit_id").distinct(), "unit_id")
    cols = ["set_name", "beat_id", "alt"]
    have = own.select(*cols).unionByName(shared.select(*cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("have"))
    hit = have.join(size, ["beat_id", "alt"]).groupBy("set_name", "beat_id").agg(F.max(F.col("have") == F.col("need")).alias("recalled"))
    names = sets.select("set_name").distinct().agg(F.array_sort(F.collect_list("set_name")).alias("n")).withColumn("__one", F.lit(1))  # a handful of names
    grid = need.select("beat_id", F.lit(1).alias("__one")).distinct().join(F.broadcast(names), "__one").select("beat_id", F.explode("n").alias("set_name"))
    return grid.join(hit, ["set_name", "beat_id"], "left").select("set_name", "beat_id", F.coalesce("recalled", F.lit(False)).alias("recalled"))


def sample_evenly(df: DataFrame, k, keys: list[str], order: list[str], block, pos: str = "pos") -> DataFrame:
    """RS9: ``k`` evenly spaced rows per key: positions ``i*(n-1) div (k-1)``.

    ``k`` is a number or a column of ``df`` that is constant per key.
    """
    r = positions(df, keys, order, block, pos)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    r = r.join(n, keys)
    k = F.lit(k).cast("bigint") if isinstance(k, int) else k.cast("bigint")
    p, steps = F.col(pos) - 1, F.greatest(k - 1, F.lit(1))
    span = F.greatest(F.col("__n") - 1, F.lit(1))
    i = F.call_function("div", p * steps + span - 1, span)
    even = F.call_function("div", i * span, steps) == p
    keep = F.when(k <= 0, False).when(F.col("__n") <= k, True).when(k == 1, p == 0).otherwise(even & (i < k))
    return r.where(keep).drop("__n")


def baseline_pool(units: DataFrame, beats: DataFrame, spans: DataFrame, work_sources: DataFrame, limit: int = 160, bin_us: int = BIN_US) -> DataFrame:
    """RS10: a quota per beat from its own ranges, then an even fill up to ``limit``.

    ``units`` are ordered by (source_id, start_us, unit_id) inside a work.
    """
    order = ["source_id", "start_us", "unit_id"]
    block = F.struct("source_id", F.floor(F.col("start_us") / 3_600_000_000).cast("bigint"))
    mine = units.join(work_sources, "source_id").select("work_id", *order, "end_us")
    s = spans.select("work_id", "beat_id", "source_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    rel = interval_join(mine, s, ["work_id", "source_id"], bin_us=bin_us).select("work_id", "beat_id", *order).distinct()
    n_beats = beats.groupBy("work_id").agg(F.count(F.lit(1)).alias("__nb"))
    rel = rel.join(n_beats, "work_id").withColumn("__k", F.greatest(F.lit(1), F.call_function("div", F.lit(limit), F.greatest("__nb", F.lit(1)))))
    quota = sample_evenly(rel, F.col("__k"), ["work_id", "beat_id"], order, block)
    first = quota.join(beats.select("work_id", "beat_id", F.col("ord").alias("__bo")), ["work_id", "beat_id"])
    first = first.groupBy("work_id", *order).agg(F.min(F.struct("__bo", "pos")).alias("__at"))
    # at most limit + beats rows per work reach this window
    chosen = top_n(first, ["work_id"], [F.col("__at").asc(), *[F.col(o).asc() for o in order]], limit, F.col("unit_id"), name="pick")
    n = chosen.groupBy("work_id").agg(F.count(F.lit(1)).alias("__c"))
    rest = mine.join(chosen.select("work_id", "unit_id"), ["work_id", "unit_id"], "left_anti").join(n, "work_id", "left")
    rest = rest.withColumn("__k", F.lit(limit) - F.coalesce("__c", F.lit(0)))
    fill = sample_evenly(rest, F.col("__k"), ["work_id"], order, block)
    out = ["work_id", "unit_id", "source_id", "start_us"]
    return chosen.select(*out, F.lit("beat").alias("origin"), F.col("pick").alias("pos")).unionByName(fill.select(*out, F.lit("fill").alias("origin"), "pos"))


def batches(df: DataFrame, n: int, keys: list[str], order: list[str], block) -> DataFrame:
    """RS22: fixed-size batches in order."""
    r = positions(df, keys, order, block, "__p")
    return r.withColumn("batch", F.call_function("div", F.col("__p") - 1, F.lit(n))).drop("__p")


def scene_payload(units: DataFrame, analysis: DataFrame) -> DataFrame:
    """RS23: analysis rows with their unit; rows without a unit are dropped."""
    return analysis.join(units, "unit_id")


def fill_analysis(units: DataFrame, analysis: DataFrame) -> DataFrame:
    """RS21: every unit has a row; missing ones get defaults from the unit's signals."""
    j = units.select("unit_id", "text", "motion", "speech").join(analysis, "unit_id", "left")
    got = F.col("confidence").isNotNull()
    zero = [F.lit(x) for k in ("drama", "performance", "emotion", "reveal", "suspense", "comedy", "state_change") for x in (k, 0.0)]
    dflt = F.create_map(*zero, F.lit("dialogue"), F.col("speech").cast("double"), F.lit("action"), F.col("motion").cast("double"), F.lit("visual"), F.col("motion").cast("double"))
    facts = F.when(F.coalesce("text", F.lit("")) != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    return j.select(
        "unit_id", F.coalesce("scores", dflt).alias("scores"), F.coalesce("facts", facts).alias("facts"), F.coalesce("confidence", F.lit(0.15)).alias("confidence"), (~got).alias("filled")
    )
