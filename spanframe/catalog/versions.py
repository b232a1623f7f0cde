"""Queries of versions, diffs, ledgers and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.catalog.timeline import PLACED, placed
from spanframe.operators import timeline as tl
from spanframe.operators import versions as vr

TWO = ["entity_id", "rule_id"]


def cand(spark, d, c=None):
    """A second revision of the clips: some moved, sped up, dropped or added."""
    c = fx.clips(spark, d) if c is None else c
    b = c.where("ord % 9 <> 8").withColumn("end_us", F.when(F.col("gain_db") == -3, F.col("end_us") + 400_000).otherwise(F.col("end_us")))
    return b.withColumn("source_id", F.when((F.col("ord") == 2) & (F.col("gain_db") == -7), "x").otherwise(F.col("source_id")))


CAND = """cand AS (SELECT * REPLACE (CASE WHEN gain_db = -3 THEN end_us + 400000 ELSE end_us END AS end_us, CASE WHEN ord = 2 AND gain_db = -7 THEN 'x' ELSE source_id END AS source_id) FROM clips WHERE ord % 9 <> 8)"""


def frame(*values):
    """SQL for the framed form of values: ``length:text``, NULL as ``~``."""
    return " || ".join(f"coalesce(length(({v})::VARCHAR) || ':' || ({v}), '~')" for v in values)


CANON = "sha256(" + " || ".join(f"'{c}=' || {frame(c)}" for c in ("end_us", "source_id", "start_us")) + ")"
COLS = ["start_us", "end_us", "source_id"]

query("fingerprint_clips", sql(f"SELECT clip_id, {CANON} AS digest FROM clips", "clips"))(lambda s, d: vr.fingerprint(fx.clips(s, d), COLS).select("clip_id", "digest"))
DIFF = CAND + f""", df AS (SELECT coalesce(a.work_id, b.work_id) AS work_id, coalesce(a.clip_id, b.clip_id) AS clip_id, a.d AS before, b.d AS after, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS kind
 FROM (SELECT work_id, clip_id, {CANON} AS d FROM clips) a FULL JOIN (SELECT work_id, clip_id, {CANON} AS d FROM cand) b ON a.clip_id = b.clip_id WHERE a.d IS DISTINCT FROM b.d)"""


def _diff(spark, d):
    return vr.keyed_diff(fx.clips(spark, d), cand(spark, d), ["work_id", "clip_id"], COLS)


query("keyed_diff", sql(DIFF + " SELECT * FROM df", "clips"))(_diff)
query("scope_check", sql(DIFF + " SELECT clip_id AS entity_id, 'OUTSIDE_SCOPE' AS rule_id FROM df WHERE clip_id NOT IN (SELECT clip_id FROM clips WHERE ord < 4)", "clips"))(
    lambda s, d: vr.check_scope(_diff(s, d), fx.clips(s, d).where("ord < 4"), ["work_id", "clip_id"]).select(*TWO)
)
TWO_LINES = PLACED + ", " + CAND + ", " + PLACED.replace("FROM clips)", "FROM cand)").replace("fr AS", "fr2 AS", 1).replace("fe AS", "fe2 AS").replace("FROM fr)", "FROM fr2)").replace("timeline AS", "timeline2 AS").replace("FROM fe)", "FROM fe2)")


@query(
    "frozen_checks",
    sql(
        TWO_LINES
        + """, fa AS (SELECT work_id, clip_id, row_number() OVER (PARTITION BY work_id ORDER BY ord) AS r FROM clips WHERE ord <> 8), fb AS (SELECT work_id, clip_id, row_number() OVER (PARTITION BY work_id ORDER BY ord) AS r FROM cand WHERE ord <> 8),
     ea AS (SELECT work_id, max(out_end_frame) AS e FROM timeline GROUP BY 1), eb AS (SELECT work_id, max(out_end_frame) AS e FROM timeline2 GROUP BY 1)
     SELECT coalesce(fa.clip_id, fb.clip_id) AS entity_id, 'FROZEN_CLIP_ORDER_OR_MEMBERSHIP_CHANGED' AS rule_id FROM fa FULL JOIN fb USING (work_id, clip_id) WHERE fa.r IS DISTINCT FROM fb.r
     UNION ALL SELECT a.clip_id, 'FROZEN_POSITION_CHANGED' FROM timeline a LEFT JOIN timeline2 b ON a.clip_id = b.clip_id WHERE a.ord = 3 AND (b.clip_id IS NULL OR a.out_start_frame <> b.out_start_frame OR a.out_end_frame <> b.out_end_frame)
     UNION ALL SELECT ea.work_id, 'WORK_DURATION_FROZEN' FROM ea LEFT JOIN eb USING (work_id) WHERE ea.e IS DISTINCT FROM eb.e AND CAST(ea.work_id AS BIGINT) % 3 = 0""",
        "clips",
    ),
)
def frozen_checks(spark, d):
    a = placed(spark, d)
    b = tl.place_clips(cand(spark, d, a), counted=a.stored)
    c = a.select("work_id", "ord", "clip_id")
    dur = c.where(F.col("work_id").cast("bigint") % 3 == 0).select("work_id").distinct()
    return vr.check_frozen(a, b, c.where("ord = 8").select("work_id", "clip_id"), c.where("ord = 3").select("work_id", "clip_id"), dur, counted=a.stored).select(*TWO)


COVER = """, it AS (SELECT work_id, clip_id AS item_id, out_start_us AS a, out_start_us + 2000000 AS b FROM timeline),
 ca AS (SELECT it.work_id, item_id, string_agg(source_id || ':' || (start_us + (greatest(a, out_start_us) - out_start_us)*speed_num // speed_den) || ':' || least(eff_source_end_us, start_us + (least(b, out_end_us) - out_start_us)*speed_num // speed_den), '|' ORDER BY out_start_us) AS c FROM it JOIN timeline t ON t.work_id = it.work_id AND t.out_start_us < b AND a < t.out_end_us GROUP BY 1, 2),
 cb AS (SELECT it.work_id, item_id, string_agg(source_id || ':' || (start_us + (greatest(a, out_start_us) - out_start_us)*speed_num // speed_den) || ':' || least(eff_source_end_us, start_us + (least(b, out_end_us) - out_start_us)*speed_num // speed_den), '|' ORDER BY out_start_us) AS c FROM it JOIN timeline2 t ON t.work_id = it.work_id AND t.out_start_us < b AND a < t.out_end_us GROUP BY 1, 2)
 SELECT it.work_id, it.item_id FROM it LEFT JOIN ca ON ca.work_id = it.work_id AND ca.item_id = it.item_id LEFT JOIN cb ON cb.work_id = it.work_id AND cb.item_id = it.item_id WHERE coalesce(ca.c, '') <> coalesce(cb.c, '')"""


@query("affected_items", sql(TWO_LINES + COVER, "clips"))
def affected_items(spark, d):
    a = placed(spark, d)
    b = tl.place_clips(cand(spark, d, a), counted=a.stored)
    items = lambda t: t.select("work_id", F.col("clip_id").alias("item_id"), F.col("out_start_us").alias("start_us"), (F.col("out_start_us") + 2_000_000).alias("end_us"))
    # the second revision's spans by their length alone: to measure them needs no placing
    length = F.expr("(end_us - start_us) * speed_den div speed_num")
    near = cand(spark, d, a.stored).withColumn("out_end_us", F.col("out_start_us") + length + 1_000_000)
    return vr.affected(items(a), a, items(a), b, counted=[items(a.stored), a.stored, items(a.stored), near])


@query(
    "invalidations",
    """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS w, c_custkey % 4 AS k, c_nationkey % 2 = 0 AS p FROM customer), b AS (SELECT w, unnest(CASE k WHEN 0 THEN ['render', 'technical-qc', 'content-review', 'visual-review', 'listening-review'] WHEN 1 THEN ['content-review', 'style-review'] WHEN 2 THEN ['evidence-map', 'content-review'] ELSE [] END) AS artifact FROM c)
     SELECT w AS work_id, artifact FROM b UNION SELECT w, 'evidence-map' FROM c WHERE p AND k < 3""",
)
def invalidations(spark, d):
    k = F.col("c_custkey") % 4
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("work_id"), (k == 0).alias("media"), (k == 1).alias("style"), (k == 2).alias("mapping"), F.lit(False).alias("other"), (F.col("c_nationkey") % 2 == 0).alias("protected"))
    return vr.invalidations(c)


PATCH = """ch AS (SELECT work_id, clip_id, CASE WHEN ord % 2 = 0 THEN start_us + 100000 END AS s, CASE WHEN gain_db < -5 THEN -1 END AS g FROM clips WHERE ord % 3 = 1), al AS (SELECT clip_id FROM clips WHERE ord <> 4)"""


def _patched(spark, d):
    c = fx.clips(spark, d)
    ch = c.where("ord % 3 = 1").select("work_id", "clip_id", F.when(F.col("ord") % 2 == 0, F.col("start_us") + 100_000).alias("start_us"), F.when(F.col("gain_db") < -5, -1).cast("bigint").alias("gain_db"))
    return vr.patch_clips(c, ch, c.where("ord <> 4").select("work_id", "clip_id"))


query("patched_clips", sql(PATCH + " SELECT c.clip_id, coalesce(s, start_us) AS start_us, coalesce(g, gain_db) AS gain_db, coalesce(s <> start_us, false) OR coalesce(g <> gain_db, false) AS changed FROM clips c LEFT JOIN (SELECT * FROM ch WHERE clip_id IN (SELECT clip_id FROM al)) x ON x.clip_id = c.clip_id", "clips"))(
    lambda s, d: _patched(s, d)[0].select("clip_id", "start_us", "gain_db", "changed")
)
query("patch_refusals", sql(PATCH + " SELECT clip_id AS entity_id, 'FROZEN_CLIP' AS rule_id FROM ch WHERE clip_id NOT IN (SELECT clip_id FROM al)", "clips"))(lambda s, d: _patched(s, d)[1].select(*TWO))


def _three(spark, d):
    b = fx.clips(spark, d).select("work_id", "clip_id", "source_id", "start_us", "gain_db", "ord")
    m = F.col("gain_db")
    c = b.where("ord <> 7").withColumn("start_us", F.when(m.isin(-1, -2), F.col("start_us") + 10).otherwise(F.col("start_us"))).withColumn("gain_db", F.when(F.col("ord") == 3, F.lit(-99)).otherwise(m))
    h = b.where("ord <> 8").withColumn("start_us", F.when(m.isin(-1, -4), F.col("start_us") + 10).when(m == -2, F.col("start_us") + 20).otherwise(F.col("start_us"))).withColumn("clip_id", F.when(F.col("ord") == 9, F.concat("clip_id", F.lit("n"))).otherwise(F.col("clip_id")))
    return vr.three_way(b, c, h, ["work_id", "clip_id"], ["source_id", "start_us", "gain_db"])


THREE = """b AS (SELECT work_id, clip_id, source_id, start_us, gain_db, ord FROM clips), c AS (SELECT work_id, clip_id, source_id, CASE WHEN gain_db IN (-1, -2) THEN start_us + 10 ELSE start_us END AS start_us, CASE WHEN ord = 3 THEN -99 ELSE gain_db END AS gain_db FROM b WHERE ord <> 7),
 h AS (SELECT work_id, CASE WHEN ord = 9 THEN clip_id || 'n' ELSE clip_id END AS clip_id, source_id, CASE WHEN gain_db IN (-1, -4) THEN start_us + 10 WHEN gain_db = -2 THEN start_us + 20 ELSE start_us END AS start_us, gain_db FROM b WHERE ord <> 8),
 j AS (SELECT coalesce(b.work_id, c.work_id, h.work_id) AS work_id, coalesce(b.clip_id, c.clip_id, h.clip_id) AS clip_id, b.clip_id AS ib, c.clip_id AS ic, h.clip_id AS ih, b.start_us AS bs, c.start_us AS cs, h.start_us AS hs, b.gain_db AS bg, c.gain_db AS cg, h.gain_db AS hg FROM b FULL JOIN c ON b.clip_id = c.clip_id FULL JOIN h ON h.clip_id = coalesce(b.clip_id, c.clip_id)),
 f AS (SELECT work_id, clip_id, 'start_us' AS field, bs AS x, cs AS y, hs AS z FROM j WHERE ib IS NOT NULL AND ic IS NOT NULL AND ih IS NOT NULL UNION ALL SELECT work_id, clip_id, 'gain_db', bg, cg, hg FROM j WHERE ib IS NOT NULL AND ic IS NOT NULL AND ih IS NOT NULL),
 tw AS (SELECT work_id, clip_id, field, CASE WHEN y = z THEN 'converged' WHEN y = x THEN 'host_only' WHEN z = x THEN 'current_only' ELSE 'conflict' END AS kind, x, y, z FROM f WHERE NOT (x = y AND y = z)),
 pr AS (SELECT work_id, clip_id, CASE WHEN ib IS NULL THEN 'unconfirmed_new' WHEN ic IS NOT NULL THEN 'host_only' ELSE 'current_only' END AS kind FROM j WHERE ib IS NULL OR (ic IS NULL) <> (ih IS NULL))"""

query("three_way_clips", sql(THREE + " SELECT work_id, clip_id, field, kind FROM tw UNION ALL SELECT work_id, clip_id, 'presence', kind FROM pr", "clips"))(lambda s, d: _three(s, d).select("work_id", "clip_id", "field", "kind"))


@query(
    "three_way_proposals",
    sql(
        THREE + """ SELECT work_id, clip_id, field FROM tw WHERE kind = 'host_only' AND clip_id NOT IN (SELECT clip_id FROM pr) AND clip_id NOT IN (SELECT clip_id FROM tw WHERE kind = 'conflict') AND clip_id NOT IN (SELECT clip_id FROM clips WHERE ord = 1) AND CAST(work_id AS BIGINT) % 10 <> 0
     AND clip_id NOT IN (SELECT clip_id FROM tw GROUP BY clip_id HAVING bool_or(field = 'start_us' AND y <> x) AND bool_or(field = 'start_us' AND z <> x) AND bool_or(field = 'start_us' AND y <> z))""",
        "clips",
    ),
)
def three_way_proposals(spark, d):
    c = fx.clips(spark, d)
    bw = c.where(F.col("work_id").cast("bigint") % 10 == 0).select("work_id").distinct()
    return vr.proposals(_three(spark, d), ["work_id", "clip_id"], c.where("ord = 1").select("work_id", "clip_id"), ["start_us"], bw)[0].select("work_id", "clip_id", "field")


@query(
    "adopted_fields",
    """WITH v AS (SELECT o_orderkey AS k, o_orderpriority AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'L' ELSE o_orderpriority END AS l, CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE o_orderpriority END AS dn, CASE WHEN o_orderkey % 5 = 0 THEN 'latest' WHEN o_orderkey % 7 = 0 THEN 'donor' END AS r FROM orders),
     a AS (SELECT *, l <> b AND l <> dn AS c FROM v), x AS (SELECT *, CASE WHEN c AND r IS NULL THEN 'unresolved' ELSE coalesce(r, 'donor') END AS action FROM a) SELECT k AS o_orderkey, c AS conflict, action, CASE action WHEN 'donor' THEN dn WHEN 'latest' THEN l END AS value FROM x""",
)
def adopted_fields(spark, d):
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    t = lambda v: o.select("o_orderkey", F.lit("priority").alias("field"), v.alias("value"))
    p = F.col("o_orderpriority")
    ch = o.select("o_orderkey", F.lit("priority").alias("field"), F.when(k % 5 == 0, "latest").when(k % 7 == 0, "donor").alias("resolution"))
    return vr.adopt_fields(t(p), t(F.when(k % 3 == 0, "L").otherwise(p)), t(F.when(k % 2 == 0, "D").otherwise(p)), ch, ["o_orderkey"]).drop("field")


def _kv(spark, d, v, where="true"):
    return fx.table(spark, d, "orders").where(where).select("o_orderkey", v.alias("value"))


def _patch_parts(spark, d):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    base = _kv(spark, d, p, "o_orderkey % 11 <> 0")
    target = _kv(spark, d, F.when(k % 4 == 0, "T").otherwise(p), "o_orderkey % 13 <> 0")
    latest = _kv(spark, d, F.when(k % 12 == 0, "edited").otherwise(p), "o_orderkey % 11 <> 0 and o_orderkey % 29 <> 0")
    return vr.make_patch(base, target, ["o_orderkey"]), latest


PATCHES = """b AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 11 <> 0), t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'T' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 13 <> 0),
 l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 12 = 0 THEN 'edited' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 29 <> 0),
 p AS (SELECT coalesce(b.k, t.k) AS k, b.v AS bv, t.v AS tv FROM b FULL JOIN t ON b.k = t.k WHERE b.v IS DISTINCT FROM t.v)"""
query("patch_conflicts", f"WITH {PATCHES} SELECT p.k AS o_orderkey FROM p LEFT JOIN l ON l.k = p.k WHERE (l.v IS NULL) <> (bv IS NULL) OR l.v <> bv")(lambda s, d: vr.rebase_patch(*_patch_parts(s, d), ["o_orderkey"]))
query("patch_preview", f"WITH {PATCHES} SELECT k AS o_orderkey, v AS value FROM l WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT k, tv FROM p WHERE tv IS NOT NULL")(
    lambda s, d: (lambda x: vr.preview_patch(x[1], x[0], ["o_orderkey"]))(_patch_parts(s, d))
)


def rev(spark, d):
    r = fx.revisions(spark, d)
    seq, doc = F.col("seq"), F.col("doc")
    dg = F.when(doc.cast("bigint") % 17 == 3, F.lit("bad")).otherwise(F.sha2(doc, 256))
    r = r.where(doc.cast("bigint") % 23 != 5).select("work_id", "seq", F.when(doc.cast("bigint") % 19 == 1, 0).otherwise(F.col("parent")).alias("parent"), dg.alias("digest"), "doc")
    return r.withColumn("version", F.when(doc.cast("bigint") % 31 == 2, "v").otherwise(vr.token(F.col("work_id"), seq, F.col("digest"))))


REV = """rv AS (SELECT work_id, seq, CASE WHEN CAST(doc AS BIGINT) % 19 = 1 THEN 0 ELSE parent END AS parent, doc, CAST(doc AS BIGINT) AS i, CASE WHEN CAST(doc AS BIGINT) % 17 = 3 THEN 'bad' ELSE sha256(doc) END AS digest FROM revisions WHERE CAST(doc AS BIGINT) % 23 <> 5),
 rl AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY work_id ORDER BY seq), 0) AS p FROM rv)"""


@query(
    "revision_chain",
    sql(
        REV + """ SELECT work_id || '@' || seq AS entity_id, 'REVISION_SEQUENCE_BROKEN' AS rule_id FROM rl WHERE seq <> p + 1 UNION ALL SELECT work_id || '@' || seq, 'REVISION_PARENT_MISMATCH' FROM rl WHERE parent <> p
     UNION ALL SELECT work_id || '@' || seq, 'DOCUMENT_HASH_MISMATCH' FROM rl WHERE digest = 'bad' UNION ALL SELECT work_id || '@' || seq, 'VERSION_HASH_MISMATCH' FROM rl WHERE i % 31 = 2""",
        "revisions",
    ),
)
def revision_chain(spark, d):
    return vr.check_log(rev(spark, d)).select(*TWO)


query("revision_head", sql(REV + " SELECT work_id, max(seq) AS seq, arg_max(doc, seq) AS doc FROM rv GROUP BY 1", "revisions"))(lambda s, d: vr.head(rev(s, d)).select("work_id", "seq", "doc"))


@query(
    "revision_restore",
    sql(REV + """, h AS (SELECT work_id, max(seq) AS h FROM rv GROUP BY 1) SELECT rv.work_id, h + 1 AS seq, h AS parent, doc, sha256(""" + frame("rv.work_id", "h + 1", "digest") + """) AS version FROM rv JOIN h USING (work_id) WHERE rv.seq = 2""", "revisions"),
)
def revision_restore(spark, d):
    r = rev(spark, d)
    t = r.select("work_id").distinct().withColumn("target_seq", F.lit(2).cast("bigint"))
    return vr.restore(r, t).select("work_id", "seq", "parent", "doc", "version")


@query(
    "current_delivery",
    sql(
        REV + """, h AS (SELECT work_id, arg_max(doc, seq) AS v, arg_max(digest, seq) AS d FROM rv GROUP BY 1), e AS (SELECT work_id, seq, doc AS v, digest AS d, CASE WHEN i % 5 = 0 THEN 'clear' ELSE 'select' END AS a FROM rv WHERE i % 3 <> 0), l AS (SELECT work_id, max(seq) AS eid, arg_max(a, seq) AS a, arg_max(v, seq) AS v, arg_max(d, seq) AS d FROM e GROUP BY 1)
     SELECT h.work_id, eid AS event_id, CASE WHEN eid IS NULL OR a = 'clear' THEN 'NO_CURRENT_SELECTION' WHEN l.v <> h.v OR l.d <> h.d THEN 'SELECTION_STALE_WORK_HEAD' ELSE '' END AS reason FROM h LEFT JOIN l USING (work_id)""",
        "revisions",
    ),
)
def current_delivery(spark, d):
    r = rev(spark, d).withColumn("version", F.col("doc"))
    i = F.col("doc").cast("bigint")
    e = r.where(i % 3 != 0).select("work_id", F.col("seq").alias("event_id"), F.when(i % 5 == 0, "clear").otherwise("select").alias("action"), "version", "digest")
    return vr.current_delivery(e, vr.head(r)).select("work_id", "event_id", "reason")


def _batch(spark, d):
    o, i = fx.table(spark, d, "orders"), F.col("o_orderkey")
    n = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    st = F.when(F.col("o_orderstatus") == "F", "RENDERED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
    j = o.join(n, i == F.col("l_orderkey"), "left").na.fill(0, ["n"])
    jobs = j.select(F.col("o_custkey").cast("string").alias("batch_id"), i.cast("string").alias("job_id"), st.alias("status"), (F.col("n") + F.when(i % 10 == 1, 1).otherwise(0)).alias("attempt"), (i % 4 != 0).alias("current"))
    at = fx.lines(spark, d).select(F.col("l_orderkey").alias("k"), F.col("ord").alias("number")).join(o.select(i.alias("k"), "o_custkey"), "k").select(F.col("o_custkey").cast("string").alias("batch_id"), F.col("k").cast("string").alias("job_id"), "number")
    return vr.batch_state(jobs, at)


query(
    "batch_state",
    """SELECT CAST(o_custkey AS VARCHAR) AS batch_id, count(*) AS n_jobs, CASE WHEN bool_and(o_orderstatus = 'F') AND bool_and(o_orderkey % 4 <> 0) THEN 'RENDERED' WHEN bool_and(o_orderstatus = 'F') THEN 'RENDERED_HISTORICAL' WHEN bool_or(o_orderstatus = 'F') THEN 'PARTIAL' ELSE 'PENDING_OR_FAILED' END AS state FROM orders GROUP BY 1""",
)(lambda s, d: _batch(s, d)[0])
query(
    "batch_attempts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS entity_id FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 10 = 1 OR (o_orderstatus = 'F' AND n IS NULL)""",
)(lambda s, d: _batch(s, d)[1].select("entity_id"))

BILL = """f AS (SELECT event_key, arg_min(task_id, seq) AS task_id, min(seq) AS seq, arg_min(amount_micros, seq) AS amount_micros, arg_min(body_sha, seq) AS body_sha FROM ledger GROUP BY 1)"""


@query("billing_delta", sql(BILL + " SELECT task_id, event_key, seq, amount_micros, amount_micros - coalesce(lag(amount_micros) OVER (PARTITION BY task_id ORDER BY seq), 0) AS delta_micros, lag(seq) OVER (PARTITION BY task_id ORDER BY seq) IS NOT NULL AS correction FROM f", "ledger"))
def billing_delta(spark, d):
    return vr.billing(fx.ledger(spark, d))[0]


@query(
    "billing_opening",
    sql(BILL + """, o AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 1000 END AS actual FROM orders WHERE o_orderkey % 3 = 0)
     SELECT f.task_id, event_key, seq, amount_micros, amount_micros - coalesce(lag(amount_micros) OVER (PARTITION BY f.task_id ORDER BY seq), actual, 0) AS delta_micros, lag(seq) OVER (PARTITION BY f.task_id ORDER BY seq) IS NOT NULL AS correction FROM f LEFT JOIN o ON o.task_id = f.task_id""", "ledger"),
)
def billing_opening(spark, d):
    """Deltas of tasks some of which have cost something before."""
    o = fx.table(spark, d, "orders").where("o_orderkey % 3 = 0")
    return vr.billing(fx.ledger(spark, d), o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") * 1000).alias("actual_micros")))[0]


@query("billing_conflicts", sql(BILL + " SELECT l.event_key || '@' || l.seq AS entity_id FROM ledger l JOIN f USING (event_key) WHERE l.seq <> f.seq AND (l.amount_micros <> f.amount_micros OR l.body_sha <> f.body_sha OR l.task_id <> f.task_id)", "ledger"))
def billing_conflicts(spark, d):
    return vr.billing(fx.ledger(spark, d))[1].select("entity_id")


@query(
    "budget_fold",
    sql(
        """r AS (SELECT work_id AS b, segment_id AS id, ord AS seq, planned_us AS amt FROM segments), w(b, seq, used, id, ok) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), false FROM r
     UNION ALL SELECT w.b, r.seq, CASE WHEN used + amt <= 60000000 THEN used + amt ELSE used END, r.id, used + amt <= 60000000 FROM w JOIN r ON r.b = w.b AND r.seq = w.seq + 1)
     SELECT b AS budget_key, id AS request_id, seq, ok AS accepted, CASE WHEN ok THEN used END AS reserved FROM w WHERE id IS NOT NULL""",
        "segments",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def budget_fold(spark, d):
    s = fx.segments(spark, d)
    r = s.select(F.col("work_id").alias("budget_key"), F.col("segment_id").alias("request_id"), F.col("ord").alias("seq"), F.col("planned_us").alias("amount"))
    return vr.budget_fold(r, s.select(F.col("work_id").alias("budget_key")).distinct().withColumn("limit", F.lit(60_000_000).cast("bigint")))


BOOK = "(p.reserved + p.spent + x.amount <= 60000000 AND coalesce(p.held[x.task_id], -1) < 0 AND x.amount >= 0)"
HAS = "(coalesce(p.held[x.task_id], -1) >= 0 AND x.amount >= 0)"
PAID = "list_contains(p.paid, x.task_id)"
OK = f"CASE x.kind WHEN 'reserve' THEN {BOOK} WHEN 'correct' THEN {PAID} ELSE {HAS} END"


@query(
    "budget_ledger",
    sql(
        f"""e0 AS (SELECT work_id AS b, segment_id AS task_id, ord * 8 + k AS seq, CASE WHEN k IN (0, 5) THEN 'reserve' WHEN k = 6 THEN 'correct' WHEN ord % 3 = 1 THEN 'release' ELSE 'settle' END AS kind,
       CASE WHEN k IN (0, 5) THEN planned_us WHEN k = 6 THEN -500000 ELSE planned_us * 11 // 10 END AS amount FROM segments, (VALUES (0), (3), (5), (6)) v(k) WHERE k < 5 OR ord % 2 = 0),
     e AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY seq) AS n FROM e0),
     p(b, n, task_id, seq, kind, accepted, reserved, spent, held, paid) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), false, CAST(0 AS BIGINT), CAST(5000000 AS BIGINT), CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)), CAST([] AS VARCHAR[]) FROM e
     UNION ALL SELECT x.b, x.n, x.task_id, x.seq, x.kind, {OK},
       p.reserved + CASE WHEN NOT {OK} THEN 0 WHEN x.kind = 'reserve' THEN x.amount WHEN x.kind = 'correct' THEN 0 ELSE -p.held[x.task_id] END,
       p.spent + CASE WHEN {OK} AND x.kind IN ('settle', 'correct') THEN x.amount ELSE 0 END,
       CASE WHEN NOT {OK} OR x.kind = 'correct' THEN p.held WHEN x.kind = 'reserve' THEN map_concat(p.held, MAP {{x.task_id: CAST(x.amount AS BIGINT)}}) ELSE map_concat(p.held, MAP {{x.task_id: CAST(-1 AS BIGINT)}}) END,
       CASE WHEN {OK} AND x.kind = 'settle' THEN list_append(p.paid, x.task_id) ELSE p.paid END
     FROM p JOIN e x ON x.b = p.b AND x.n = p.n + 1)
     SELECT b AS budget_key, task_id, seq, kind, accepted, reserved, spent FROM p WHERE n > 0""",
        "segments",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def budget_ledger(spark, d):
    s = fx.segments(spark, d)
    k = s.select("work_id", "segment_id", "ord", "planned_us", F.explode(F.array(*[F.lit(v) for v in (0, 3, 5, 6)])).alias("k")).where("k < 5 or ord % 2 = 0")
    kind = F.when(F.col("k").isin(0, 5), "reserve").when(F.col("k") == 6, "correct").when(F.col("ord") % 3 == 1, "release").otherwise("settle")
    amount = F.when(F.col("k").isin(0, 5), F.col("planned_us")).when(F.col("k") == 6, -500_000).otherwise(F.expr("div(planned_us * 11, 10)"))
    entries = k.select(F.col("work_id").alias("budget_key"), F.col("segment_id").alias("task_id"), (F.col("ord") * 8 + F.col("k")).alias("seq"), kind.alias("kind"), amount.alias("amount"))
    budgets = s.select(F.col("work_id").alias("budget_key")).distinct().select("*", F.lit(60_000_000).alias("limit"), F.lit(5_000_000).alias("opening"))
    return vr.budget_ledger(entries, budgets)


@query(
    "adoption_gate",
    """WITH t AS (SELECT o_orderkey AS i, o_orderstatus AS s, o_orderkey % 6 = 0 AS cn, o_orderkey % 4 = 1 AS hc, o_orderkey % 9 AS cost, o_custkey FROM orders), r AS (SELECT l_orderkey AS i, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax)) AS d, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax)) % 3 AS h FROM lineitem GROUP BY 1)
     SELECT CAST(t.i AS VARCHAR) AS task_id, CASE WHEN s <> 'O' OR cn THEN 'TASK_RESULT_NOT_ADOPTABLE' WHEN hc AND cost > 5 THEN 'PROVIDER_HARD_COST_CAP_VIOLATION' WHEN t.i % 8 = 7 THEN 'WORK_HEAD_CHANGED' WHEN d IS NULL OR d <> 'A' THEN 'EXPLICIT_ACCEPTED_REVIEW_REQUIRED' WHEN h <> 0 THEN 'ACCEPTED_REVIEW_HASH_CHANGED' ELSE 'READY' END AS reason FROM t LEFT JOIN r USING (i)""",
)
def adoption_gate(spark, d):
    o, i = fx.table(spark, d, "orders"), F.col("o_orderkey")
    t = o.select(i.cast("string").alias("task_id"), F.col("o_custkey").cast("string").alias("work_id"), F.when(F.col("o_orderstatus") == "O", "VERIFIED").otherwise("FAILED").alias("state"), (i % 6 == 0).alias("cancelled"), (i % 4 == 1).alias("hard_cap"), (i % 9).alias("cost"), F.lit(5).alias("max_cost"),
                 F.when(i % 8 == 7, "old").otherwise("v").alias("work_version"), F.lit("0").alias("result_sha"))
    r = fx.lines(spark, d).select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("ord").alias("seq"), F.when(F.col("l_returnflag") == "A", "ACCEPT").otherwise("REVISE").alias("decision"), (F.col("l_partkey") % 3).cast("string").alias("result_sha"))
    h = o.select(F.col("o_custkey").cast("string").alias("work_id"), F.lit("v").alias("version")).distinct()
    return vr.adoption_gate(t, r, h)


INT = """i AS (SELECT CAST(l_orderkey AS VARCHAR) AS intent, ord AS seq, l_suppkey % 2 AS p, CASE l_returnflag WHEN 'A' THEN 'SUCCEEDED' WHEN 'N' THEN 'RESERVED' ELSE 'NOT_SUBMITTED' END AS st, l_partkey % 20 AS g FROM lines)"""


def _intents(spark, d):
    st = F.when(F.col("l_returnflag") == "A", "SUCCEEDED").when(F.col("l_returnflag") == "N", "RESERVED").otherwise("NOT_SUBMITTED")
    return vr.intents(fx.lines(spark, d).select(F.col("l_orderkey").cast("string").alias("intent"), F.col("ord").alias("seq"), (F.col("l_suppkey") % 2).alias("payload_sha"), st.alias("status"), (F.col("l_partkey") % 20).alias("grant_id")))


query("send_intents", sql(INT + " SELECT intent, count(CASE WHEN st = 'RESERVED' THEN 1 END) AS n_attempts, CASE WHEN count(DISTINCT p) > 1 THEN 'PAYLOAD_CHANGED' WHEN arg_max(st, seq) = 'SUCCEEDED' THEN 'REPLAY' WHEN arg_max(st, seq) = 'NOT_SUBMITTED' THEN 'SENDABLE' ELSE 'OUTCOME_UNKNOWN' END AS state FROM i GROUP BY 1", "lines"))(lambda s, d: _intents(s, d)[0])
query("grant_usage", sql(INT + " SELECT g AS grant_id, count(*) AS used FROM i WHERE st = 'RESERVED' GROUP BY 1", "lines"))(lambda s, d: _intents(s, d)[1])


@query(
    "recompute_plan",
    sql(DIFF.split(", df AS")[0] + f""" SELECT coalesce(a.clip_id, b.clip_id) AS node_id, CASE WHEN b.d IS NULL THEN 'REMOVED' WHEN a.d IS NULL THEN 'NEW' WHEN a.d <> b.d THEN 'CHANGED' WHEN b.ord % 5 <> 0 THEN 'REUSE_CANDIDATE' ELSE 'REBUILD' END AS action
     FROM (SELECT clip_id, {CANON} AS d FROM clips WHERE ord <> 5) a FULL JOIN (SELECT clip_id, ord, {CANON} AS d FROM cand) b ON a.clip_id = b.clip_id""", "clips"),
)
def recompute_plan(spark, d):
    k = lambda t: vr.fingerprint(t, COLS, "node_key").withColumnRenamed("clip_id", "node_id")
    return vr.recompute_plan(k(fx.clips(spark, d).where("ord <> 5")), k(cand(spark, d)).withColumn("ready", F.col("ord") % 5 != 0)).select("node_id", "action")


DAG = """e AS (SELECT CAST(o_custkey AS VARCHAR) AS w, o_orderkey % 13 AS s, o_orderkey % 13 + 1 + o_orderkey % 3 AS t FROM orders)"""


@query(
    "dirty_stages",
    f"""WITH RECURSIVE {DAG}, r(w, id) AS (SELECT DISTINCT w, CAST(2 AS BIGINT) FROM e UNION SELECT r.w, e.t FROM r JOIN e ON e.w = r.w AND e.s = r.id) SELECT w AS work_id, id FROM r""",
)
def dirty_stages(spark, d):
    o = fx.table(spark, d, "orders")
    w = F.col("o_custkey").cast("string").alias("work_id")
    e = o.select(w, (F.col("o_orderkey") % 13).alias("src"), (F.col("o_orderkey") % 13 + 1 + F.col("o_orderkey") % 3).alias("dst"))
    return vr.reach(e, o.select(w).distinct().withColumn("id", F.lit(2).cast("bigint")), ["work_id"]).drop("depth")


@query(
    "variant_lineage",
    """WITH RECURSIVE v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey - 1 - o_custkey % 3 END AS up FROM orders), u AS (SELECT id, CASE WHEN up >= 0 THEN up END AS up FROM v), r(id, root, d) AS (SELECT id, id, 0 FROM u WHERE up IS NULL UNION ALL SELECT u.id, root, d + 1 FROM u JOIN r ON u.up = r.id)
     SELECT id AS variant_id, root AS root_id, CAST(d AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS finding FROM r""",
)
def variant_lineage(spark, d):
    i = F.col("o_orderkey")
    up = F.when(i % 50 != 0, i - 1 - F.col("o_custkey") % 3)
    return vr.lineage(fx.table(spark, d, "orders").select(i.alias("variant_id"), F.when(up >= 0, up).alias("parent_id")))


@query(
    "meeting_records",
    """WITH r AS (SELECT o_orderkey AS i, CAST(o_orderdate AS DATE) AS dt, ['recorded-consensus', 'open-question', 'explicit-action'][1 + o_orderkey % 3] AS st, CASE WHEN o_orderkey % 5 <> 0 THEN 'yes' END AS cf, CASE WHEN o_orderkey % 4 = 0 THEN 'Ann' END AS ow, o_custkey % 40 AS v FROM orders),
     ev AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS c FROM lineitem), ci AS (SELECT p_partkey AS c, DATE '1995-01-01' + CAST(p_partkey % 900 AS INTEGER) AS dt FROM part WHERE p_size > 2), rq AS (SELECT i, i + 1 AS ref FROM r WHERE i % 6 = 0)
     SELECT CAST(i AS VARCHAR) AS entity_id, 'EVIDENCE_REQUIRED' AS rule_id FROM r WHERE i NOT IN (SELECT i FROM ev) UNION ALL SELECT ev.i || '/' || ev.c, 'CITATION_UNKNOWN' FROM ev JOIN r USING (i) LEFT JOIN ci USING (c) WHERE ci.dt IS NULL UNION ALL SELECT ev.i || '/' || ev.c, 'EVIDENCE_DATE_MISMATCH' FROM ev JOIN r USING (i) JOIN ci USING (c) WHERE ci.dt <> r.dt
     UNION ALL SELECT CAST(i AS VARCHAR), 'CONFIRMATION_REQUIRED' FROM r WHERE st IN ('recorded-consensus', 'explicit-action') AND cf IS NULL UNION ALL SELECT CAST(i AS VARCHAR), 'ACTION_FIELD_ON_NON_ACTION' FROM r WHERE ow IS NOT NULL AND st <> 'explicit-action'
     UNION ALL SELECT rq.i || '>' || ref, 'CONTEXT_UNKNOWN_OR_SELF' FROM rq WHERE ref NOT IN (SELECT i FROM r) UNION ALL SELECT rq.i || '>' || ref, 'FUTURE_CONTEXT' FROM rq JOIN r a ON a.i = rq.i JOIN r b ON b.i = rq.ref WHERE b.dt > a.dt
     UNION ALL SELECT DISTINCT r.v || '/' || ref, 'VIEW_CONTEXT_OMITTED' FROM rq JOIN r USING (i) WHERE (r.v, ref) NOT IN (SELECT v, i FROM r)""",
)
def meeting_records(spark, d):
    o, i = fx.table(spark, d, "orders"), F.col("o_orderkey")
    rid = i.cast("string").alias("record_id")
    r = o.select(rid, F.col("o_orderdate").cast("date").alias("meeting_date"), F.element_at(F.array(*[F.lit(x) for x in ("recorded-consensus", "open-question", "explicit-action")]), (i % 3 + 1).cast("int")).alias("status"), F.when(i % 5 != 0, "yes").alias("confirmation"), F.when(i % 4 == 0, "Ann").alias("owner"))
    q = o.where("o_orderkey % 6 = 0").select(rid, (i + 1).cast("string").alias("ref_id"))
    e = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("record_id"), F.col("l_partkey").cast("string").alias("citation_id")).distinct()
    c = fx.table(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").cast("string").alias("citation_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")).alias("meeting_date"))
    return vr.check_records(r, q, e, c, o.select((F.col("o_custkey") % 40).alias("view_id"), rid)).select(*TWO)


@query(
    "chapter_bindings",
    sql(
        """c AS (SELECT work_id, 'k' || (ord % 6) AS ch, start_us - CASE WHEN ord = 1 THEN 30000000 ELSE 0 END AS a, end_us - CASE WHEN gain_db = -9 THEN 99000000 ELSE 0 END AS b, CASE WHEN ord % 4 = 2 THEN 'old' ELSE work_id END AS dg FROM clips)
     SELECT ch AS entity_id, work_id, 'CHAPTER_RANGE' AS rule_id FROM c WHERE a < 0 OR a >= b UNION ALL SELECT ch, work_id, 'STALE_EVIDENCE_MAP' FROM c WHERE dg = 'old' UNION ALL SELECT ch, work_id, 'CHAPTER_ID_DUPLICATE' FROM c GROUP BY 1, 2 HAVING count(*) > 1""",
        "clips",
    ),
)
def chapter_bindings(spark, d):
    c = fx.clips(spark, d)
    ch = c.select("work_id", F.concat(F.lit("k"), F.col("ord") % 6).alias("chapter_id"), (F.col("start_us") - F.when(F.col("ord") == 1, 30_000_000).otherwise(0)).alias("start_us"), (F.col("end_us") - F.when(F.col("gain_db") == -9, 99_000_000).otherwise(0)).alias("end_us"), F.when(F.col("ord") % 4 == 2, "old").otherwise(F.col("work_id")).alias("digest"))
    return vr.check_chapters(ch, c.select("work_id", F.col("work_id").alias("digest")).distinct()).select("work_id", *TWO)


NARR = """ed AS (SELECT work_id, CASE WHEN ord % 8 = 7 THEN segment_id || 'x' ELSE segment_id END AS segment_id, CASE ord % 4 WHEN 0 THEN text WHEN 1 THEN '' ELSE 'new ' || text END AS nt FROM segments WHERE ord % 3 <> 0), j AS (SELECT ed.*, s.mode, s.text, s.voice_us FROM ed LEFT JOIN segments s USING (segment_id)),
 cv AS (SELECT segment_id, CAST(sum(end_us - start_us) AS BIGINT) AS c FROM visuals GROUP BY 1)"""


def _narration(spark, d):
    s = fx.segments(spark, d)
    m = F.col("ord") % 4
    e = s.where("ord % 3 <> 0").select("work_id", F.when(F.col("ord") % 8 == 7, F.concat("segment_id", F.lit("x"))).otherwise(F.col("segment_id")).alias("segment_id"), F.when(m == 0, F.col("text")).when(m == 1, "").otherwise(F.concat(F.lit("new "), "text")).alias("text"))
    return vr.narration_plan(s, fx.visuals(spark, d), e)


query("narration_plan", sql(NARR + " SELECT segment_id, text AS old_text, nt AS new_text, voice_us AS old_us, coalesce(c, 0) AS cover_us FROM j LEFT JOIN cv USING (segment_id) WHERE mode = 'voiceover' AND nt <> text AND nt <> ''", "segments", "visuals"))(lambda s, d: _narration(s, d)[0].drop("work_id"))
query("narration_findings", sql(NARR + " SELECT segment_id AS entity_id, 'NARRATION_TARGET_UNKNOWN' AS rule_id FROM j WHERE mode IS NULL UNION ALL SELECT segment_id, 'NARRATION_NONEMPTY_TEXT_REQUIRED' FROM j WHERE nt = '' UNION ALL SELECT segment_id, 'NARRATION_VOICEOVER_TARGET_REQUIRED' FROM j WHERE mode <> 'voiceover' UNION ALL SELECT segment_id, 'NARRATION_TEXT_UNCHANGED' FROM j WHERE nt = text", "segments", "visuals"))(lambda s, d: _narration(s, d)[1].select(*TWO))


@query(
    "stable_ids",
    sql(
        """o AS (SELECT segment_id, ord, unit_id AS v, 'i' || segment_id || '-' || ord AS inst FROM visuals WHERE CAST(segment_id AS BIGINT) % 5 <> 0), n AS (SELECT work_id, segment_id, ord, CASE WHEN CAST(segment_id AS BIGINT) % 7 = 0 AND ord = 1 THEN 'zz' ELSE unit_id END AS v, CASE WHEN CAST(segment_id AS BIGINT) % 14 = 0 THEN 'x' || segment_id || ord END AS ex FROM visuals),
     oa AS (SELECT segment_id, string_agg(v, '|' ORDER BY ord, v) AS a FROM o GROUP BY 1), na AS (SELECT segment_id, string_agg(v, '|' ORDER BY ord, v) AS a FROM n GROUP BY 1)
     SELECT n.segment_id, n.ord, coalesce(ex, CASE WHEN oa.a = na.a THEN o.inst WHEN oa.a IS NULL THEN sha256(""" + frame("n.work_id", "n.segment_id", "n.ord") + """) END) AS instance_id FROM n JOIN na USING (segment_id) LEFT JOIN oa USING (segment_id) LEFT JOIN o ON o.segment_id = n.segment_id AND o.ord = n.ord""",
        "visuals",
    ),
)
def stable_ids(spark, d):
    v, i = fx.visuals(spark, d), F.col("segment_id").cast("bigint")
    o = v.where(i % 5 != 0).select("work_id", "segment_id", "ord", F.col("unit_id").alias("visual_sha"), F.concat(F.lit("i"), "segment_id", F.lit("-"), "ord").alias("instance_id"))
    n = v.select("work_id", "segment_id", "ord", F.when((i % 7 == 0) & (F.col("ord") == 1), "zz").otherwise(F.col("unit_id")).alias("visual_sha"), F.when(i % 14 == 0, F.concat(F.lit("x"), "segment_id", "ord")).alias("explicit_id"))
    return vr.stable_ids(o, n)[0].drop("work_id")


@query(
    "task_history",
    sql(
        """e AS (SELECT l_orderkey AS t, ord AS seq, epoch_us(l_shipdate) AS u, l_returnflag AS a, l_linestatus AS b FROM lines) SELECT CAST(t AS VARCHAR) AS task_id, seq, u - lag(u) OVER w AS in_state_us, coalesce(lag(b) OVER w <> a, false) AS broken, lead(seq) OVER w IS NULL AS is_current FROM e WINDOW w AS (PARTITION BY t ORDER BY seq)""",
        "lines",
    ),
)
def task_history(spark, d):
    e = fx.lines(spark, d).select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("ord").alias("seq"), fx.micros("l_shipdate").alias("t_us"), F.col("l_returnflag").alias("old_state"), F.col("l_linestatus").alias("new_state"))
    return vr.task_history(e).select("task_id", "seq", "in_state_us", "broken", "is_current")


@query(
    "derived_scope",
    sql(
        DIFF + """, bt AS (SELECT work_id, clip_id, source_id FROM clips UNION ALL SELECT work_id, clip_id, source_id FROM cand), sd AS (SELECT DISTINCT work_id, source_id FROM clips WHERE ord = 1 AND gain_db = 0), ro AS (SELECT DISTINCT work_id FROM clips WHERE CAST(work_id AS BIGINT) % 12 = 0)
     SELECT work_id, clip_id FROM df UNION SELECT bt.work_id, clip_id FROM bt JOIN sd USING (work_id, source_id) UNION SELECT bt.work_id, clip_id FROM bt JOIN ro USING (work_id)""",
        "clips",
    ),
)
def derived_scope(spark, d):
    c = fx.clips(spark, d)
    sd = c.where("ord = 1 and gain_db = 0").select("work_id", "source_id").distinct()
    ro = c.where(F.col("work_id").cast("bigint") % 12 == 0).select("work_id").distinct()
    return vr.derive_scope(_diff(spark, d), sd, c, cand(spark, d), ro)


@query(
    "relocations",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'KEY_UNKNOWN' WHEN c_custkey % 7 = 0 THEN 'SHA256_CHANGED' WHEN c_custkey % 5 = 1 THEN 'NONPATH_CHANGE' WHEN c_custkey % 3 = 0 THEN 'PATH_UNCHANGED' ELSE 'RELOCATED' END AS state FROM customer""",
)
def relocations(spark, d):
    c, i = fx.table(spark, d, "customer"), F.col("c_custkey")
    o = c.select("c_custkey", F.concat(F.lit("/a/"), i).alias("path"), F.col("c_name").alias("sha256"), "c_mktsegment")
    n = o.where("c_custkey % 10 <> 0").withColumn("path", F.when(i % 3 == 0, F.col("path")).otherwise(F.concat(F.lit("/b/"), i))).withColumn("sha256", F.when(i % 7 == 0, "x").otherwise(F.col("sha256"))).withColumn("c_mktsegment", F.when(i % 5 == 1, "y").otherwise(F.col("c_mktsegment")))
    return vr.check_relocation(o, n, ["c_custkey"], ["c_mktsegment"])


@query(
    "receipt_checks",
    """SELECT '/p/' || l_partkey AS entity_id, CAST(l_orderkey AS VARCHAR) AS receipt_id, r AS rule_id FROM (SELECT l_partkey, l_orderkey, unnest([CASE WHEN p_partkey IS NULL THEN 'ARTIFACT_MISSING' END, CASE WHEN p_size % 2 <> l_suppkey % 2 THEN 'ARTIFACT_CHANGED' END, CASE WHEN p_size <> l_linenumber THEN 'ARTIFACT_SIZE_MISMATCH' END]) AS r
     FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 9 <> 0) ON p_partkey = l_partkey) WHERE r IS NOT NULL""",
)
def receipt_checks(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("receipt_id"), F.concat(F.lit("/p/"), "l_partkey").alias("path"), (F.col("l_suppkey") % 2).alias("sha256"), F.col("l_linenumber").alias("bytes"))
    reg = fx.table(spark, d, "part").where("p_partkey % 9 <> 0").select(F.concat(F.lit("/p/"), "p_partkey").alias("path"), (F.col("p_size") % 2).alias("sha256"), F.col("p_size").alias("bytes"))
    return vr.check_receipts(li, reg).select("entity_id", F.col("work_id").alias("receipt_id"), "rule_id")
