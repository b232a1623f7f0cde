"""Document versions, diffs, ledgers and lineage for many works at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.fingerprint import canonical, framed, row_digest
from spanframe.functions import text as tx
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.budgets import ROWS, settle
from spanframe.plans.folds import fold_ordered
from spanframe.plans.ordered import by_rows, by_time, positions, scan
from spanframe.plans.rounds import cut_lineage
from spanframe.plans.skew import crowded, measures


def fingerprint(df: DataFrame, cols: list[str], name: str = "digest") -> DataFrame:
    """VR1: SHA-256 of the chosen columns in name order."""
    return df.withColumn(name, row_digest(cols))


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """VR2: added, removed and changed keys with both digests."""
    x = a.select(*keys, row_digest(cols).alias("before"))
    y = b.select(*keys, row_digest(cols).alias("after"))
    j = x.join(y, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return j.withColumn("kind", kind)


def check_scope(diff: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """VR3: changed keys outside the declared scope."""
    return fd.finding(diff.join(scope.select(*keys).distinct(), keys, "left_anti"), "OUTSIDE_SCOPE", F.lit(True), F.concat_ws("/", *keys[1:]), work=keys[0], evidence=F.col("kind"))


def check_frozen(a: DataFrame, b: DataFrame, scope: DataFrame, positions: DataFrame, durations: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """VR4: frozen clips keep order and membership; frozen positions and lengths stay.

    ``a``/``b``: work_id, clip_id, ord, out_start_frame, out_end_frame.  ``scope``: clips
    that may change.  ``positions``: frozen (work_id, clip_id).  ``durations``: frozen
    work_ids.  ``counted``: a table with no fewer rows of any work than both that costs less to count.
    """
    key = ["work_id", "clip_id"]

    def frozen_rank(t):
        f = t.join(scope.select(*key), key, "left_anti")
        return scan(f, ["work_id"], ["ord"], by_rows("ord"), sums={"r": F.lit(1).cast("bigint")}, within=counted).select(*key, "r")

    j = frozen_rank(a).withColumnRenamed("r", "ra").join(frozen_rank(b).withColumnRenamed("r", "rb"), key, "full")
    one = fd.finding(j, "FROZEN_CLIP_ORDER_OR_MEMBERSHIP_CHANGED", ~F.col("ra").eqNullSafe(F.col("rb")), F.col("clip_id"))
    p = positions.join(a.select(*key, F.struct("out_start_frame", "out_end_frame").alias("pa")), key, "left").join(b.select(*key, F.struct("out_start_frame", "out_end_frame").alias("pb")), key, "left")
    two = fd.finding(p, "FROZEN_POSITION_CHANGED", F.col("pa").isNull() | ~F.col("pa").eqNullSafe(F.col("pb")), F.col("clip_id"))
    end = lambda t, n: t.groupBy("work_id").agg(F.max("out_end_frame").alias(n))
    d = durations.join(end(a, "ea"), "work_id", "left").join(end(b, "eb"), "work_id", "left")
    three = fd.finding(d, "WORK_DURATION_FROZEN", ~F.col("ea").eqNullSafe(F.col("eb")), F.col("work_id"))
    return fd.union([one, two, three])


def source_parts(items: DataFrame, timeline: DataFrame, bin_us: int = BIN_US, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Source ranges under output spans, numbered per item in output order.

    ``counted``: items and timeline with no fewer rows and no shorter spans that cost less to measure.
    """
    def sides(items, timeline):
        t = timeline.select("work_id", "source_id", F.col("start_us").alias("c0"), "eff_source_end_us", "speed_num", "speed_den", F.col("out_start_us").alias("b_start_us"), F.col("out_end_us").alias("b_end_us"))
        return items.select("work_id", "item_id", "start_us", "end_us"), t

    p = interval_join(*sides(items, timeline), ["work_id"], bin_us=bin_us, counted=sides(*counted) if counted else None)

    def back(x):
        return F.col("c0") + F.call_function("div", (x - F.col("b_start_us")) * F.col("speed_num"), F.col("speed_den"))

    lo = back(F.greatest("start_us", "b_start_us"))
    hi = F.least(F.col("eff_source_end_us"), back(F.least("end_us", "b_end_us")))
    p = p.select("work_id", "item_id", "b_start_us", "source_id", lo.alias("lo"), hi.alias("hi"))
    # an item has no more parts than its work has clips
    fits = counted is not None and measures(p.sparkSession) and not crowded(counted[1], ["work_id"])
    return positions(p, ["work_id", "item_id"], ["b_start_us", "source_id", "lo"], by_time("b_start_us"), "pos", fits=fits).drop("b_start_us")


def affected(items_a: DataFrame, timeline_a: DataFrame, items_b: DataFrame, timeline_b: DataFrame, counted: list[DataFrame] | None = None) -> DataFrame:
    """VR5: captions, tracks or layers of both revisions whose source cover changed.

    The ordered parts are compared one by one, so an item over a whole long work is
    never gathered.  ``counted``: the four tables in a form that costs less to measure.
    """
    key = ["work_id", "item_id"]
    cheap = (tuple(counted[:2]), tuple(counted[2:])) if counted else (None, None)
    part = lambda n: F.struct("source_id", "lo", "hi").alias(n)
    a = source_parts(items_a, timeline_a, counted=cheap[0]).select(*key, "pos", part("a"))
    b = source_parts(items_b, timeline_b, counted=cheap[1]).select(*key, "pos", part("b"))
    moved = a.join(b, [*key, "pos"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*key).repartition("work_id").distinct()  # by work, as items may lie
    return moved.join(items_a.select(*key), key, "left_semi").join(items_b.select(*key), key, "left_semi")


def invalidations(changes: DataFrame) -> DataFrame:
    """VR6: what must be redone, by the kinds of change of a work.

    ``changes``: work_id and booleans media, style, mapping, protected.
    """
    base = (
        F.when(F.col("media"), F.array(*[F.lit(x) for x in ("render", "technical-qc", "content-review", "visual-review", "listening-review")]))
        .when(F.col("style"), F.array(F.lit("content-review"), F.lit("style-review")))
        .when(F.col("mapping"), F.array(F.lit("evidence-map"), F.lit("content-review")))
        .otherwise(F.array().cast("array<string>"))
    )
    extra = F.col("protected") & (F.col("media") | F.col("style") | F.col("mapping") | F.col("other"))
    return changes.select("work_id", F.explode(F.array_distinct(F.when(extra, F.array_append(base, F.lit("evidence-map"))).otherwise(base))).alias("artifact"))


PATCH_FIELDS = ["start_us", "end_us", "gain_db", "speed_num", "speed_den"]


def patch_clips(clips: DataFrame, changes: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VR7: apply allowed clip changes; report changed clips and refused ones.

    ``changes``: work_id, clip_id and any of PATCH_FIELDS (NULL keeps the value).
    """
    key = ["work_id", "clip_id"]
    fields = [f for f in PATCH_FIELDS if f in changes.columns]
    ok = changes.join(allowed.select(*key), key, "left_semi").select(*key, *[F.col(f).alias(f"__{f}") for f in fields])
    j = clips.join(ok, key, "left")
    new = {f: F.coalesce(f"__{f}", f) for f in fields}
    diff = F.lit(False)
    for f in fields:
        diff = diff | F.coalesce(F.col(f"__{f}") != F.col(f), F.lit(False))
    out = j.select(*[new[c].alias(c) if c in new else F.col(c) for c in clips.columns], diff.alias("changed"))
    refused = changes.join(allowed.select(*key), key, "left_anti")
    bad = fd.finding(refused, "FROZEN_CLIP", F.lit(True), F.col("clip_id"))
    unknown = allowed.join(clips.select(*key), key, "left_anti")
    return out, bad.unionByName(fd.finding(unknown, "ALLOWED_CLIP_UNKNOWN", F.lit(True), F.col("clip_id")))


def three_way(base: DataFrame, current: DataFrame, host: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """VR8: per key and field: converged, host_only, current_only or conflict; and rows
    for keys that are new or missing on a side (field ``presence``)."""
    def side(t, p):
        return t.select(*keys, F.lit(True).alias(f"__{p}"), *[F.col(f).cast("string").alias(f"{p}_{f}") for f in fields])

    j = side(base, "b").join(side(current, "c"), keys, "full").join(side(host, "h"), keys, "full")
    inb, inc, inh = (F.col(f"__{p}").isNotNull() for p in "bch")

    def row(f):
        b, c, h = (F.col(f"{p}_{f}") for p in "bch")
        kind = F.when(c.eqNullSafe(h), "converged").when(c.eqNullSafe(b), "host_only").when(h.eqNullSafe(b), "current_only").otherwise("conflict")
        moved = inb & inc & inh & ~(b.eqNullSafe(c) & c.eqNullSafe(h))
        return F.when(moved, F.struct(F.lit(f).alias("field"), kind.alias("kind"), b.alias("base"), c.alias("current"), h.alias("host")))

    text = lambda x: x.cast("string")
    lost = F.when(~inb, "unconfirmed_new").when(inc & ~inh, "host_only").when(~inc & inh, "current_only")
    gone = F.when((~inb) | (inc != inh), F.struct(F.lit("presence").alias("field"), lost.alias("kind"), text(inb).alias("base"), text(inc).alias("current"), text(inh).alias("host")))
    return j.select(*keys, F.explode(F.array_compact(F.array(*[row(f) for f in fields], gone))).alias("x")).select(*keys, "x.*")


def proposals(changes: DataFrame, keys: list[str], protected: DataFrame, timing: list[str], blocked_works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VR9: host-only changes that may be proposed, and why the others are blocked.

    Entities with a conflict, a lost or new identity, two-sided timing edits or a
    protection are blocked whole; a blocked work blocks everything in it.
    """
    w = keys[0]
    is_t = F.col("field").isin(timing)
    e = changes.groupBy(*keys).agg(
        F.bool_or(F.col("kind") == "conflict").alias("conflict"), F.bool_or(F.col("field") == "presence").alias("presence"),
        F.bool_or(is_t & (F.col("current") != F.col("base"))).alias("ct"), F.bool_or(is_t & (F.col("host") != F.col("base"))).alias("ht"),
        F.bool_or(is_t & (F.col("current") != F.col("host"))).alias("dt"), F.bool_or(~F.col("host").eqNullSafe(F.col("base"))).alias("hosted"),
    )
    e = e.join(protected.select(*keys).distinct().withColumn("prot", F.lit(True)), keys, "left").join(blocked_works.select(w).distinct().withColumn("glob", F.lit(True)), w, "left")
    why = F.array_compact(
        F.array(
            F.when(F.col("presence"), "IDENTITY_UNCONFIRMED"), F.when(F.col("conflict"), "SAME_FIELD_CHANGED_BOTH"),
            F.when(F.col("ct") & F.col("ht") & F.col("dt"), "CROSS_FIELD_TIMING_DEPENDENCY"), F.when(F.col("hosted") & F.coalesce("prot", F.lit(False)), "PROTECTED_ENTITY"), F.when(F.coalesce("glob", F.lit(False)), "GLOBAL_BLOCK"),
        )
    )
    e = e.withColumn("why", F.array_join(why, ","))
    ok = changes.where("kind = 'host_only' and field <> 'presence'").join(e.where("why = ''").select(*keys), keys, "left_semi")
    return ok, e.where("why <> ''").select(*keys, "why")


def adopt_fields(base: DataFrame, latest: DataFrame, donor: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """VR10: field adoption with an explicit resolution where both sides moved.

    All tables: keys, field, value; ``choices``: keys, field, resolution (donor, latest or
    NULL).
    """
    on = [*keys, "field"]
    v = lambda t, n: t.select(*on, F.col("value").alias(n))
    j = choices.join(v(base, "b"), on).join(v(latest, "l"), on).join(v(donor, "d"), on)
    conflict = ~F.col("l").eqNullSafe(F.col("b")) & ~F.col("l").eqNullSafe(F.col("d"))
    action = F.when(conflict & F.col("resolution").isNull(), "unresolved").otherwise(F.coalesce("resolution", F.lit("donor")))
    j = j.withColumn("conflict", conflict).withColumn("action", action)
    return j.select(*on, "conflict", "action", F.when(F.col("action") == "donor", F.col("d")).when(F.col("action") == "latest", F.col("l")).alias("value"))


def make_patch(base: DataFrame, target: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """VR11: operations that turn ``base`` into ``target`` with before-hash conditions."""
    j = base.select(*keys, F.col(col).alias("b")).join(target.select(*keys, F.col(col).alias("t")), keys, "full").where(~F.col("b").eqNullSafe(F.col("t")))
    return j.select(*keys, F.col("b").isNotNull().alias("before_exists"), F.sha2("b", 256).alias("before_sha"), F.col("t").isNotNull().alias("after_exists"), F.col("t").alias("value"))


def rebase_patch(patch: DataFrame, latest: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """VR11: operations whose target was edited meanwhile (empty = the patch applies)."""
    j = patch.join(latest.select(*keys, F.col(col).alias("now")), keys, "left")
    bad = (F.col("now").isNotNull() != F.col("before_exists")) | (F.col("before_exists") & (F.sha2("now", 256) != F.col("before_sha")))
    return j.where(bad).select(*keys)


def preview_patch(latest: DataFrame, patch: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """VR11: ``latest`` with the patch applied."""
    kept = latest.select(*keys, col).join(patch.select(*keys), keys, "left_anti")
    return kept.unionByName(patch.where("after_exists").select(*keys, F.col("value").alias(col)))


def token(work, seq, digest):
    """Chained version token of a revision."""
    return F.sha2(framed(work, seq, digest), 256)


def check_log(rev: DataFrame) -> DataFrame:
    """VR12: revision sequence without holes, right parents, digests and tokens.

    ``rev``: work_id, seq, parent, digest, version, doc.
    """
    r = scan(rev, ["work_id"], ["seq"], by_rows("seq"), lags={"__p": F.col("seq")})
    prev = F.coalesce("__p", F.lit(0))
    return fd.checks(
        r,
        [
            ("REVISION_SEQUENCE_BROKEN", F.col("seq") != prev + 1), ("REVISION_PARENT_MISMATCH", F.col("parent") != prev),
            ("DOCUMENT_HASH_MISMATCH", F.sha2("doc", 256) != F.col("digest")), ("VERSION_HASH_MISMATCH", token(F.col("work_id"), F.col("seq"), F.col("digest")) != F.col("version")),
        ],
        entity=F.concat_ws("@", "work_id", "seq"),
    )


def head(rev: DataFrame) -> DataFrame:
    """VR12: latest revision per work."""
    cols = [c for c in rev.columns if c != "work_id"]
    return rev.groupBy("work_id").agg(F.max_by(F.struct(*cols), "seq").alias("h")).select("work_id", "h.*")


def restore(rev: DataFrame, targets: DataFrame) -> DataFrame:
    """VR12: new rows that bring back an earlier document; history stays.

    ``targets``: work_id, target_seq.
    """
    h = head(rev).select("work_id", F.col("seq").alias("__h"))
    old = rev.select("work_id", F.col("seq").alias("target_seq"), "doc", "digest")
    j = targets.join(old, ["work_id", "target_seq"]).join(h, "work_id")
    return j.select(
        "work_id", (F.col("__h") + 1).alias("seq"), F.col("__h").alias("parent"), "digest", token(F.col("work_id"), F.col("__h") + 1, F.col("digest")).alias("version"), "doc",
        F.lit("restore").alias("action"), "target_seq",
    )


def current_delivery(events: DataFrame, heads: DataFrame) -> DataFrame:
    """VR13: selected delivery or the reason for falling back to a render.

    ``events``: work_id, event_id, action, version, digest.  ``heads``: work_id, version,
    digest.
    """
    last = events.groupBy("work_id").agg(F.max_by(F.struct("event_id", "action", "version", "digest"), "event_id").alias("e")).select("work_id", "e.event_id", "e.action", F.col("e.version").alias("ev"), F.col("e.digest").alias("ed"))
    j = heads.join(last, "work_id", "left")
    none = F.col("event_id").isNull() | (F.col("action") == "clear")
    stale = (F.col("ev") != F.col("version")) | (F.col("ed") != F.col("digest"))
    reason = F.when(none, "NO_CURRENT_SELECTION").when(stale, "SELECTION_STALE_WORK_HEAD").otherwise("")
    return j.select("work_id", "event_id", F.when(reason == "", "STRICT_MEDIA_TECHNICAL_CANDIDATE").otherwise("RENDER_FALLBACK").alias("mode"), reason.alias("reason"))


def batch_state(jobs: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VR14: state of each batch, and attempt-index findings.

    ``jobs``: batch_id, job_id, status, attempt, current.  ``attempts``: batch_id, job_id,
    number.
    """
    done = F.col("status") == "RENDERED"
    g = jobs.groupBy("batch_id").agg(F.bool_and(done).alias("all"), F.bool_or(done).alias("any"), F.bool_and("current").alias("cur"), F.count(F.lit(1)).alias("n_jobs"))
    state = F.when(F.col("all") & F.col("cur"), "RENDERED").when(F.col("all"), "RENDERED_HISTORICAL").when(F.col("any"), "PARTIAL").otherwise("PENDING_OR_FAILED")
    key = ["batch_id", "job_id"]
    a = attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("u"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    j = jobs.join(a, key, "left").na.fill(0, ["n", "u", "lo", "hi"])
    index = (F.col("n") != F.col("attempt")) | (F.col("u") != F.col("n")) | ((F.col("n") > 0) & ((F.col("lo") != 1) | (F.col("hi") != F.col("n"))))
    bad = index | (F.col("status").isin("RUNNING", "RENDERED", "INVALID_OUTPUT") & (F.col("attempt") <= 0))
    return g.select("batch_id", "n_jobs", state.alias("state")), fd.finding(j, "BATCH_ATTEMPT_INDEX_MISMATCH", bad, F.col("job_id"), work="batch_id")


def billing(events: DataFrame, opening: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """VR16: idempotent billing events with the delta against the task's last amount.

    ``events``: task_id, event_key, seq, amount_micros, body_sha.  A key repeated with the
    same body counts once; with another body or amount the later row is a conflict.
    ``opening``: task_id, actual_micros, what a task has cost before its first event (no row or NULL:
    nothing); the first event's delta is against it, and is no correction.
    """
    first = events.groupBy("event_key").agg(F.min_by(F.struct("task_id", "seq", "amount_micros", "body_sha"), "seq").alias("f")).select("event_key", "f.*")
    j = events.join(first.select("event_key", F.col("seq").alias("s1"), F.col("task_id").alias("t1"), F.col("amount_micros").alias("a1"), F.col("body_sha").alias("b1")), "event_key")
    clash = (F.col("seq") != F.col("s1")) & ((F.col("task_id") != F.col("t1")) | (F.col("amount_micros") != F.col("a1")) | (F.col("body_sha") != F.col("b1")))
    bad = fd.finding(j, "BILLING_EVENT_KEY_CONFLICT", clash, F.concat_ws("@", "event_key", "seq"), work="task_id")
    r = scan(first, ["task_id"], ["seq"], by_rows("seq"), lags={"__p": F.col("amount_micros")})
    before = F.lit(0).cast("bigint")
    if opening is not None:
        r = r.join(opening.select("task_id", F.col("actual_micros").cast("bigint").alias("__open")), "task_id", "left")
        before = F.coalesce("__open", before)
    return r.select("task_id", "event_key", "seq", "amount_micros", (F.col("amount_micros") - F.coalesce("__p", before)).alias("delta_micros"), F.col("__p").isNotNull().alias("correction")), bad


def budget_fold(requests: DataFrame, budgets: DataFrame, block_rows: int = ROWS) -> DataFrame:
    """VR15: reserve requests in order; one that exceeds the rest of the budget is
    refused and does not count.

    Blocks of a budget's requests are settled side by side (:mod:`spanframe.plans.budgets`).
    ``requests``: budget_key, request_id, seq, amount (negative or NULL: refused).
    ``budgets``: budget_key, limit.
    """
    amount = F.coalesce(F.col("amount").cast("bigint"), F.lit(-1))
    limits = budgets.select("budget_key", F.col("limit").cast("bigint").alias("limit"))
    rows = requests.select("budget_key", "request_id", "seq", amount.alias("amount")).join(limits, "budget_key")
    done = settle(rows, "budget_key", ["seq", "request_id"], block_rows)
    return done.select("budget_key", "request_id", "seq", "accepted", F.when(F.col("accepted"), F.col("limit") - F.col("left")).alias("reserved"))


def budget_ledger(entries: DataFrame, budgets: DataFrame) -> DataFrame:
    """VR15: reservations, settlements and releases of tasks against a budget, in order.

    ``entries``: budget_key, task_id, seq, kind, amount.  ``reserve`` holds an amount if it
    fits beside what is reserved and spent; ``settle`` turns the task's reservation into
    an actual cost, which may be smaller or larger and is paid either way; ``release``
    gives the reservation back; ``correct`` moves what the task has cost by a signed
    amount.  ``budgets``: budget_key, limit, opening (already spent, NULL is 0).

    A budget's rest may rise again, so its entries are one streamed fold; its state is the
    amounts of tasks that have later entries, however many tasks came before.

    Returns each entry with ``accepted``, ``reserved`` and ``spent`` after it.  A settlement or
    release of a task that holds nothing, a second reservation of one that does, and a
    correction of one that has not been settled are refused and change nothing.
    """
    b = budgets.select("budget_key", F.col("limit").cast("bigint").alias("limit"), F.coalesce(F.col("opening").cast("bigint"), F.lit(0)).alias("opening"))
    rows = entries.select("budget_key", "task_id", "seq", "kind", F.coalesce(F.col("amount").cast("bigint"), F.lit(0)).alias("amount"))
    rows = scan(rows, ["budget_key", "task_id"], ["seq"], by_rows("seq"), lags={"__before": F.col("seq")}, leads={"__next": F.col("seq")}).join(b, "budget_key")

    def step(books: dict, r: dict) -> tuple:
        held, paid, task, amount = books["held"], books["paid"], r["task_id"], r["amount"]
        if books["spent"] is None:
            books["spent"] = r["opening"]
        ok = False
        if r["kind"] == "reserve":
            ok = task not in held and amount >= 0 and books["reserved"] + books["spent"] + amount <= r["limit"]
            if ok:
                held[task] = amount
                books["reserved"] += amount
        elif r["kind"] in ("settle", "release"):
            ok = task in held and amount >= 0
            if ok:
                books["reserved"] -= held.pop(task)
                if r["kind"] == "settle":
                    books["spent"] += amount
                    paid.add(task)
        elif r["kind"] == "correct":
            ok = task in paid
            books["spent"] += amount if ok else 0
        if r["__next"] is None and r["__before"] != r["seq"]:  # the task's last entry, alone at its seq
            held.pop(task, None)
            paid.discard(task)
        return r["budget_key"], task, r["seq"], r["kind"], ok, books["reserved"], books["spent"]

    kinds = dict(rows.dtypes)
    schema = f"budget_key {kinds['budget_key']}, task_id {kinds['task_id']}, seq {kinds['seq']}, kind string, accepted boolean, reserved bigint, spent bigint"
    return fold_ordered(rows, ["budget_key"], ["seq", "task_id"], schema, lambda: {"held": {}, "paid": set(), "reserved": 0, "spent": None}, step)


def adoption_gate(tasks: DataFrame, reviews: DataFrame, heads: DataFrame) -> DataFrame:
    """VR17: may a generated result be adopted?  First failing reason, else READY.

    ``tasks``: task_id, work_id, state, cancelled, hard_cap, cost, max_cost,
    work_version, result_sha.  ``reviews``: task_id, seq, decision, result_sha.
    ``heads``: work_id, version.
    """
    r = reviews.groupBy("task_id").agg(F.max_by(F.struct("decision", "result_sha"), "seq").alias("r"))
    j = tasks.join(r, "task_id", "left").join(heads.select("work_id", F.col("version").alias("__v")), "work_id", "left")
    reason = (
        F.when((F.col("state") != "VERIFIED") | F.col("cancelled"), "TASK_RESULT_NOT_ADOPTABLE")
        .when(F.col("hard_cap") & (F.col("cost") > F.col("max_cost")), "PROVIDER_HARD_COST_CAP_VIOLATION")
        .when(~F.col("__v").eqNullSafe(F.col("work_version")), "WORK_HEAD_CHANGED")
        .when(F.col("r").isNull() | (F.col("r.decision") != "ACCEPT"), "EXPLICIT_ACCEPTED_REVIEW_REQUIRED")
        .when(F.col("r.result_sha") != F.col("result_sha"), "ACCEPTED_REVIEW_HASH_CHANGED")
        .otherwise("READY")
    )
    return j.select("task_id", reason.alias("reason"))


def intents(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VR18: outcome of each send intent, and the used count per grant.

    ``log``: intent, seq, payload_sha, status (RESERVED, SUCCEEDED, NOT_SUBMITTED), grant_id.
    """
    g = log.groupBy("intent").agg(
        F.count_distinct("payload_sha").alias("n_payloads"), F.max_by("status", "seq").alias("last"), F.count_if(F.col("status") == "RESERVED").alias("n_attempts")
    )
    state = (
        F.when(F.col("n_payloads") > 1, "PAYLOAD_CHANGED").when(F.col("last") == "SUCCEEDED", "REPLAY").when(F.col("last") == "NOT_SUBMITTED", "SENDABLE").otherwise("OUTCOME_UNKNOWN")
    )
    used = log.where("status = 'RESERVED'").groupBy("grant_id").agg(F.count(F.lit(1)).alias("used"))
    return g.select("intent", "n_attempts", state.alias("state")), used


def recompute_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """VR19: node actions from keys; equal keys are only reuse candidates.

    Tables: work_id, node_id, node_key, ready (new side).
    """
    j = old.select("work_id", "node_id", F.col("node_key").alias("k0")).join(new.select("work_id", "node_id", F.col("node_key").alias("k1"), "ready"), ["work_id", "node_id"], "full")
    action = F.when(F.col("k1").isNull(), "REMOVED").when(F.col("k0").isNull(), "NEW").when(F.col("k0") != F.col("k1"), "CHANGED").when(F.col("ready"), "REUSE_CANDIDATE").otherwise("REBUILD")
    return j.select("work_id", "node_id", action.alias("action"))


def reach(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """VR20/GR3: everything reachable over ``edges(keys, src, dst)`` from ``seeds(keys, id)``.

    A frontier loop: the edges are written once, partitioned by their source; each round
    joins only the newly found nodes and ends the loop when it finds none.  The rounds
    follow the depth of the graph.
    """
    on = [*keys, "id"]
    e = cut_lineage(edges.select(*keys, F.col("src").alias("id"), "dst").distinct())
    seen = cut_lineage(seeds.select(*on).distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while True:
        depth += 1
        nxt = front.join(e, on).select(*keys, F.col("dst").alias("id")).distinct().join(seen.select(*on), on, "left_anti")
        front = cut_lineage(nxt.withColumn("depth", F.lit(depth)))
        if not front.head(1):
            return seen
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = cut_lineage(seen)


def lineage(variants: DataFrame) -> DataFrame:
    """VR21: root and depth of each variant by pointer doubling.

    ``variants``: variant_id, parent_id (NULL at a root).  A parent that is not listed is
    its own root.  After as many doublings as the longest possible chain needs, a row
    that still moves is on a cycle or below one: its root_id and depth are NULL and its
    finding is LINEAGE_CYCLE.
    """
    v = variants.select(F.col("variant_id").alias("id"), F.col("parent_id").alias("up"))
    v = v.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint")).withColumn("up", F.coalesce("up", "id"))
    v = cut_lineage(v)
    moving = F.lit(False)
    for _ in range(v.count().bit_length() + 1):
        p = v.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        n = v.join(p, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.coalesce("d2", F.lit(0)) > 0).alias("__m"))
        n = cut_lineage(n)
        v, moving = n.drop("__m"), F.col("__m")
        if not n.where("__m").head(1):
            break
    else:
        v = n
    bad = moving if "__m" in v.columns else F.lit(False)
    return v.select(
        F.col("id").alias("variant_id"), F.when(~bad, F.col("up")).alias("root_id"), F.when(~bad, F.col("depth")).alias("depth"),
        F.when(bad, F.lit("LINEAGE_CYCLE")).alias("finding"),
    )


CONFIRMED = ["recorded-consensus", "process-decision", "explicit-action"]


def check_records(records: DataFrame, requires: DataFrame, evidence: DataFrame, citations: DataFrame, views: DataFrame) -> DataFrame:
    """VR22: meeting records: evidence, confirmation, action fields, context and views.

    ``records``: record_id, meeting_date, status, confirmation, owner.  ``requires``:
    record_id, ref_id.  ``evidence``: record_id, citation_id.  ``citations``: citation_id,
    meeting_date.  ``views``: view_id, record_id.
    """
    e = evidence.join(citations.select("citation_id", F.col("meeting_date").alias("cd")), "citation_id", "left").join(records.select("record_id", F.col("meeting_date").alias("rd")), "record_id")
    q = requires.join(records.select("record_id", F.col("meeting_date").alias("rd")), "record_id").join(records.select(F.col("record_id").alias("ref_id"), F.col("meeting_date").alias("pd")), "ref_id", "left")
    need = views.join(requires, "record_id").select("view_id", F.col("ref_id").alias("record_id"))
    one = F.lit("records")
    return fd.union([
        fd.finding(records.join(evidence.select("record_id"), "record_id", "left_anti"), "EVIDENCE_REQUIRED", F.lit(True), F.col("record_id"), work=one),
        fd.checks(e, [("CITATION_UNKNOWN", F.col("cd").isNull()), ("EVIDENCE_DATE_MISMATCH", F.col("cd") != F.col("rd"))], work=one, entity=F.concat_ws("/", "record_id", "citation_id")),
        fd.checks(
            records,
            [("CONFIRMATION_REQUIRED", F.col("status").isin(CONFIRMED) & (F.coalesce("confirmation", F.lit("")) == "")), ("ACTION_FIELD_ON_NON_ACTION", F.col("owner").isNotNull() & (F.col("status") != "explicit-action"))],
            work=one, entity="record_id",
        ),
        fd.checks(q, [("CONTEXT_UNKNOWN_OR_SELF", F.col("pd").isNull() | (F.col("ref_id") == F.col("record_id"))), ("FUTURE_CONTEXT", F.col("pd") > F.col("rd"))], work=one, entity=F.concat_ws(">", "record_id", "ref_id")),
        fd.finding(need.join(views, ["view_id", "record_id"], "left_anti").distinct(), "VIEW_CONTEXT_OMITTED", F.lit(True), F.concat_ws("/", "view_id", "record_id"), work=one),
    ])


def check_chapters(chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """VR23: chapter ranges valid and bound to the current document digest."""
    j = chapters.join(docs.select("work_id", F.col("digest").alias("__d")), "work_id", "left")
    n = chapters.groupBy("work_id", "chapter_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    a = fd.checks(j, [("CHAPTER_RANGE", (F.col("start_us") < 0) | (F.col("start_us") >= F.col("end_us"))), ("STALE_EVIDENCE_MAP", ~F.col("__d").eqNullSafe(F.col("digest")))], entity="chapter_id")
    return a.unionByName(fd.finding(n, "CHAPTER_ID_DUPLICATE", F.lit(True), F.col("chapter_id")))


def narration_plan(segments: DataFrame, visuals: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VR24: voice text edits with old text and picture cover; findings for the rest."""
    key = ["work_id", "segment_id"]
    s = segments.select(*key, "mode", F.col("text").alias("old_text"), F.col("voice_us").alias("old_us"))
    j = edits.select(*key, F.col("text").alias("new_text")).join(s, key, "left")
    c = visuals.groupBy(*key).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("cover_us"))
    bad = fd.checks(
        j,
        [
            ("NARRATION_TARGET_UNKNOWN", F.col("mode").isNull()), ("NARRATION_NONEMPTY_TEXT_REQUIRED", tx.strip("new_text") == ""),
            ("NARRATION_VOICEOVER_TARGET_REQUIRED", F.col("mode") != "voiceover"), ("NARRATION_TEXT_UNCHANGED", F.col("new_text") == F.col("old_text")),
        ],
        entity="segment_id",
    )
    ok = j.where("mode = 'voiceover' and new_text <> old_text and trim(new_text) <> ''").join(c, key, "left").na.fill(0, ["cover_us"])
    return ok.select(*key, "old_text", "new_text", "old_us", "cover_us"), bad


def stable_ids(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VR25: instance ids across edits: kept when the segment's visuals are equal, made
    from a hash for new segments, ambiguous otherwise.

    Tables: work_id, segment_id, ord, visual_sha, and instance_id on the old side,
    explicit_id on the new side.
    """
    key = ["work_id", "segment_id"]
    at = [*key, "ord"]
    before, after = old.select(*at, F.col("visual_sha").alias("v0")), new.select(*at, F.col("visual_sha").alias("v1"))
    moved = before.join(after, at, "full").where(~F.col("v0").eqNullSafe(F.col("v1"))).select(*key).distinct().withColumn("__moved", F.lit(True))
    known = old.select(*key).distinct().withColumn("__known", F.lit(True))
    n = new.join(known, key, "left").join(moved, key, "left").join(old.select(*at, "instance_id"), at, "left")
    fresh = F.sha2(framed(F.col("work_id"), F.col("segment_id"), F.col("ord")), 256)
    pick = F.coalesce("explicit_id", F.when(F.col("__known").isNull(), fresh).when(F.col("__moved").isNull(), F.col("instance_id")))
    n = n.withColumn("instance", pick)
    dup = n.where("instance is not null").groupBy("work_id", "instance").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bad = fd.finding(n, "LEGACY_VISUAL_IDENTITY_AMBIGUOUS", F.col("instance").isNull(), F.concat_ws("/", "segment_id", "ord"))
    bad = bad.unionByName(fd.finding(dup, "INSTANCE_ID_DUPLICATE", F.lit(True), F.col("instance")))
    return n.select(*key, "ord", F.col("instance").alias("instance_id")), bad


def task_history(events: DataFrame) -> DataFrame:
    """VR26: transitions of each task with the time spent before each.

    ``events``: task_id, seq, t_us, old_state, new_state.
    """
    e = scan(events, ["task_id"], ["seq"], by_rows("seq"), lags={"__t": F.col("t_us"), "__s": F.col("new_state")}, leads={"__n": F.col("seq")})
    return e.select(
        "task_id", "seq", "old_state", "new_state", (F.col("t_us") - F.col("__t")).alias("in_state_us"), F.coalesce(F.col("__s") != F.col("old_state"), F.lit(False)).alias("broken"), F.col("__n").isNull().alias("is_current")
    )


def derive_scope(clip_diff: DataFrame, source_diff: DataFrame, clips_a: DataFrame, clips_b: DataFrame, reordered: DataFrame) -> DataFrame:
    """VR27: clips that a change touches: changed ones, users of changed sources, and all
    clips of works whose order changed."""
    key = ["work_id", "clip_id"]
    both = clips_a.select(*key, "source_id").unionByName(clips_b.select(*key, "source_id"))
    a = clip_diff.select(*key)
    b = both.join(source_diff.select("work_id", "source_id"), ["work_id", "source_id"]).select(*key)
    c = both.join(reordered.select("work_id"), "work_id", "left_semi").select(*key)
    return a.unionByName(b).unionByName(c).distinct()


def check_relocation(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """VR28: path-only moves: same bytes, another path, nothing else different.

    ``cols`` are the non-path columns besides ``sha256``.
    """
    o = old.select(*keys, F.col("path").alias("p0"), F.col("sha256").alias("s0"), F.sha2(canonical(cols), 256).alias("d0"))
    n = new.select(*keys, F.col("path").alias("p1"), F.col("sha256").alias("s1"), F.sha2(canonical(cols), 256).alias("d1"))
    j = o.join(n, keys, "full")
    state = (
        F.when(F.col("p0").isNull() | F.col("p1").isNull(), "KEY_UNKNOWN").when(F.col("s0") != F.col("s1"), "SHA256_CHANGED").when(F.col("d0") != F.col("d1"), "NONPATH_CHANGE")
        .when(F.col("p0") == F.col("p1"), "PATH_UNCHANGED").otherwise("RELOCATED")
    )
    return j.select(*keys, state.alias("state"))


def check_receipts(receipts: DataFrame, registry: DataFrame) -> DataFrame:
    """VR29: recorded hashes and sizes against the content registry."""
    j = receipts.join(registry.select("path", F.col("sha256").alias("r_sha"), F.col("bytes").alias("r_bytes")), "path", "left")
    return fd.checks(
        j, [("ARTIFACT_MISSING", F.col("r_sha").isNull()), ("ARTIFACT_CHANGED", F.col("r_sha") != F.col("sha256")), ("ARTIFACT_SIZE_MISMATCH", F.col("r_bytes") != F.col("bytes"))],
        work="receipt_id", entity="path",
    )
