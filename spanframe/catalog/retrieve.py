"""Queries of the retrieval and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.functions import text as tf
from spanframe.operators import retrieve as rs
from spanframe.operators import select as sel
from spanframe.operators import text as tx
from spanframe.plans.ordered import lying
from spanframe.plans.rounds import cut_lineage, written

LIMIT = 20
TERMS = """t AS (SELECT DISTINCT unit_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM units),
 df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
 q AS (SELECT DISTINCT beat_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM beats),
 bs AS (SELECT DISTINCT beat_id, source_id FROM beat_spans),
 sc AS (SELECT q.beat_id, t.unit_id, round(sum(ln(1 + (SELECT count(*) FROM units) / df.df)), 8) AS score, count(*) AS n_terms
  FROM q JOIN df USING (term) JOIN t USING (term) JOIN units u USING (unit_id) JOIN bs ON bs.beat_id = q.beat_id AND bs.source_id = u.source_id GROUP BY 1, 2),
 di AS (SELECT DISTINCT b.beat_id, u.unit_id FROM beat_spans b JOIN units u ON u.source_id = b.source_id AND u.start_us < b.end_us AND b.start_us < u.end_us)"""


def _parts(spark, d, stored=False):
    u = fx.units(spark, d)
    src = fx.beat_spans(spark, d).select("beat_id", "source_id").distinct()
    q = fx.beats(spark, d).select("beat_id", F.explode(tf.terms("text")).alias("term")).join(src, "beat_id")
    t = rs.asked(tx.terms(u), q).join(u.select("unit_id", "source_id"), "unit_id")
    if stored:
        t = written(t, "terms")
    f = rs.doc_freq(t, u)
    return u, t, f, src, q


query("doc_freq", sql(TERMS + " SELECT term, df, (SELECT count(*) FROM units) AS n_units FROM df", "units", "beats", "beat_spans"))(
    lambda s, d: rs.doc_freq(tx.terms(fx.units(s, d)), fx.units(s, d))
)


@query("term_scores", sql(TERMS + " SELECT beat_id, unit_id, round(score, 6) AS score, n_terms FROM sc", "units", "beats", "beat_spans"))
def term_scores(spark, d):
    u, t, f, src, q = _parts(spark, d)
    return rs.score(q, t, f, match=["source_id"]).select("beat_id", "unit_id", F.round("score", 6).alias("score"), "n_terms")


CAND = TERMS + """, c AS (SELECT coalesce(sc.beat_id, di.beat_id) AS beat_id, coalesce(sc.unit_id, di.unit_id) AS unit_id, coalesce(score, 0) AS score, di.unit_id IS NOT NULL AS direct
  FROM sc FULL JOIN di ON sc.beat_id = di.beat_id AND sc.unit_id = di.unit_id),
 x AS (SELECT c.*, CASE WHEN bs.source_id IS NULL THEN 'source_constraint' WHEN CAST(c.unit_id AS BIGINT) % 7 = 0 AND CAST(c.unit_id AS BIGINT) % 11 > CAST(c.beat_id AS BIGINT) % 11 THEN 'knowledge_constraint'
  WHEN NOT direct AND score <= 0 THEN 'no_query_evidence' END AS reason FROM c JOIN units u USING (unit_id) LEFT JOIN bs ON bs.beat_id = c.beat_id AND bs.source_id = u.source_id)"""


def _knowledge(spark, d):
    i = F.col("unit_id").cast("bigint")
    reveals = fx.units(spark, d).where(i % 7 == 0).select("unit_id", (i % 11).cast("string").alias("event_id"))
    allowed = fx.beats(spark, d).select("beat_id", F.explode(F.sequence(F.lit(0), (F.col("beat_id").cast("bigint") % 11).cast("int"))).alias("e")).select("beat_id", F.col("e").cast("string").alias("event_id"))
    return reveals, allowed


def _candidates(spark, d):
    u, t, f, src, q = _parts(spark, d)
    sc = rs.score(q, t, f, match=["source_id"])
    return rs.exclusions(sc, rs.direct_pairs(fx.beat_spans(spark, d), u), u, src, *_knowledge(spark, d))


@query(
    "exclusion_counts",
    sql(
        CAND + """, g AS (SELECT b.beat_id, u.unit_id, CASE WHEN bs.source_id IS NULL THEN 'source' WHEN CAST(u.unit_id AS BIGINT) % 7 = 0 AND CAST(u.unit_id AS BIGINT) % 11 > CAST(b.beat_id AS BIGINT) % 11 THEN 'knowledge' WHEN coalesce(c.direct, false) OR coalesce(c.score, 0) > 0 THEN 'ranked' ELSE 'evidence' END AS r
       FROM (SELECT DISTINCT beat_id FROM bs) b CROSS JOIN units u LEFT JOIN bs ON bs.beat_id = b.beat_id AND bs.source_id = u.source_id LEFT JOIN c ON c.beat_id = b.beat_id AND c.unit_id = u.unit_id)
     SELECT beat_id, count(*) FILTER (WHERE r = 'source') AS source_constraint, count(*) FILTER (WHERE r = 'knowledge') AS knowledge_constraint, count(*) FILTER (WHERE r = 'evidence') AS no_query_evidence, count(*) FILTER (WHERE r = 'ranked') AS n_ranked FROM g GROUP BY 1""",
        "units", "beats", "beat_spans",
    ),
)
def exclusion_counts(spark, d):
    src = fx.beat_spans(spark, d).select("beat_id", "source_id").distinct()
    return rs.exclusion_counts(_candidates(spark, d), fx.units(spark, d), src, *_knowledge(spark, d))


@query("exclusion_reasons", sql(CAND + " SELECT beat_id, unit_id, direct, coalesce(reason, '') AS reason FROM x", "units", "beats", "beat_spans"))
def exclusion_reasons(spark, d):
    return _candidates(spark, d).select("beat_id", "unit_id", "direct", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "term_idf_rank",
    sql(
        CAND + """, r AS (SELECT *, row_number() OVER (PARTITION BY beat_id ORDER BY score DESC, direct DESC, unit_id) AS rank FROM x WHERE reason IS NULL)
     SELECT beat_id, unit_id, round(score, 6) AS score, direct, rank FROM r""",
        "units", "beats", "beat_spans",
    ),
)
def term_idf_rank(spark, d):
    return rs.rank(_candidates(spark, d)).withColumn("score", F.round("score", 6)).select("beat_id", "unit_id", "score", "direct", "rank")


def _top(spark, d, k):
    u, t, f, src, q = _parts(spark, d, stored=True)
    return rs.top_ranked(q, t, f, rs.direct_pairs(fx.beat_spans(spark, d), u), u, src, *_knowledge(spark, d), k, match=["source_id"])


@query(
    "term_top_rank",
    sql(
        CAND + f""", r AS (SELECT *, row_number() OVER (PARTITION BY beat_id ORDER BY score DESC, direct DESC, unit_id) AS rank FROM x WHERE reason IS NULL)
     SELECT beat_id, unit_id, round(score, 6) AS score, direct, rank FROM r WHERE rank <= {LIMIT}""",
        "units", "beats", "beat_spans",
    ),
)
def term_top_rank(spark, d):
    """The first ranks of each beat, by pruned retrieval."""
    return _top(spark, d, LIMIT).where(F.col("rank") <= LIMIT).withColumn("score", F.round("score", 6)).select("beat_id", "unit_id", "score", "direct", "rank")


def _front(spark, d):
    """What a pool of ``LIMIT`` units may look at: each beat's direct units and first others."""
    return _top(spark, d, LIMIT).join(fx.beats(spark, d).select("work_id", "beat_id"), "beat_id")


def _in_pool(spark, d, pool):
    """The admissible (beat, unit) pairs of units in a pool; no others are scored."""
    only = pool.select("unit_id").distinct()
    u, t, f, src, q = _parts(spark, d)
    u, t = u.join(only, "unit_id", "left_semi"), t.join(only, "unit_id", "left_semi")
    sc = rs.score(q, t, f, match=["source_id"])
    kept = rs.exclusions(sc, rs.direct_pairs(fx.beat_spans(spark, d), u), u, src, *_knowledge(spark, d)).where("reason is null")
    return kept.join(fx.beats(spark, d).select("work_id", "beat_id"), "beat_id")


POOL = CAND + f""", rk AS (SELECT b.work_id, x.beat_id, x.unit_id, direct, row_number() OVER (PARTITION BY x.beat_id ORDER BY score DESC, direct DESC, x.unit_id) AS rank FROM x JOIN (SELECT DISTINCT work_id, beat_id FROM beats) b ON b.beat_id = x.beat_id WHERE reason IS NULL),
 st(work_id, n, queue, taken, explored, beat_id, unit_id, direct) AS (
   SELECT work_id, 0, list(beat_id ORDER BY sha256(beat_id), beat_id), CAST([] AS VARCHAR[]), 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN) FROM (SELECT DISTINCT work_id, beat_id FROM rk) GROUP BY 1
   UNION ALL SELECT s.work_id, s.n + CASE WHEN y.v IS NULL THEN 0 ELSE 1 END, CASE WHEN y.v IS NULL THEN s.queue[2:] ELSE list_append(s.queue[2:], s.queue[1]) END,
     CASE WHEN y.v IS NULL THEN s.taken ELSE list_append(s.taken, y.v.u) END, s.explored + CASE WHEN y.v.d THEN 0 WHEN y.v IS NULL THEN 0 ELSE 1 END, s.queue[1], y.v.u, y.v.d
   FROM st s, LATERAL (SELECT min_by({{'u': unit_id, 'd': direct}}, rank) AS v FROM rk WHERE rk.work_id = s.work_id AND rk.beat_id = s.queue[1] AND NOT list_contains(s.taken, rk.unit_id) AND (rk.direct OR s.explored < {LIMIT // 2})) y
   WHERE len(s.queue) > 0 AND s.n < {LIMIT}),
 pool AS (SELECT s.work_id, s.beat_id, s.unit_id, CAST(n AS INT) AS pick, s.direct, CASE WHEN (s.work_id, s.unit_id) IN (SELECT work_id, unit_id FROM rk WHERE direct) THEN 'direct_evidence' ELSE 'context' END AS role FROM st s WHERE s.unit_id IS NOT NULL)"""


def recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("retrieval_pool", recursive(sql(POOL + " SELECT * FROM pool", "units", "beats", "beat_spans")))
def retrieval_pool(spark, d):
    return rs.pick_pool(_front(spark, d), LIMIT, 0.5)


SIZE = "(100 + CAST({0} AS BIGINT) % 13 * 37)"  # bytes of a unit, by its id


@query(
    "retrieval_pool_bytes",
    recursive(
        sql(
            POOL.replace("taken, explored,", "taken, explored, room,", 1).replace("CAST([] AS VARCHAR[]), 0,", "CAST([] AS VARCHAR[]), 0, CAST(2200 AS BIGINT),", 1)
            .replace("s.queue[1], y.v.u, y.v.d\n", "s.room - CASE WHEN y.v IS NULL THEN 0 ELSE " + SIZE.format("y.v.u") + " END, s.queue[1], y.v.u, y.v.d\n", 1)
            .replace("AND (rk.direct OR", "AND " + SIZE.format("rk.unit_id") + " <= s.room AND (rk.direct OR", 1)
            + " SELECT * FROM pool",
            "units", "beats", "beat_spans",
        )
    ),
)
def retrieval_pool_bytes(spark, d):
    """Pools with a size function of the caller's own and a budget that fills before the limit."""
    ranked = rs.rank(_candidates(spark, d)).join(fx.beats(spark, d).select("work_id", "beat_id"), "beat_id")
    return rs.pick_pool(ranked, LIMIT, 0.5, budget=2200, size_fn=lambda rows: 100 + rows["unit_id"].astype("int64") % 13 * 37)


@query(
    "pool_coverage",
    recursive(
        sql(
            POOL + """, k AS (SELECT rk.work_id, rk.beat_id, count(*) AS a, count(*) FILTER (WHERE rk.direct) AS b FROM rk WHERE (rk.work_id, rk.unit_id) IN (SELECT work_id, unit_id FROM pool) GROUP BY 1, 2)
     SELECT b.work_id, b.beat_id, coalesce(a, 0) AS n_selected, coalesce(k.b, 0) AS n_direct, CASE WHEN k.b > 0 THEN 'candidate_evidence' ELSE 'unknown' END AS status, CASE WHEN a > 0 THEN '' ELSE 'no_evidence_or_budget_exhausted' END AS reason
     FROM beats b LEFT JOIN k ON k.work_id = b.work_id AND k.beat_id = b.beat_id""",
            "units", "beats", "beat_spans",
        )
    ),
)
def pool_coverage(spark, d):
    pool = cut_lineage(rs.pick_pool(_front(spark, d), LIMIT, 0.5))
    return rs.pool_coverage(fx.beats(spark, d), _in_pool(spark, d, pool), pool)


@query(
    "retrieval_requests",
    """WITH b AS (SELECT item_id, text || ' e' || (item_id % 7) || CASE WHEN item_id % 4 = 0 THEN ' intends to go' ELSE '' END || ' Ann Annie' AS full_q, CASE WHEN item_id % 4 = 0 THEN 'Ann Annie' ELSE 'Ann Annie e' || (item_id % 7) END AS clean_q FROM benchmark)
     SELECT CAST(item_id // 10 AS VARCHAR) AS work_id, CAST(item_id AS VARCHAR) AS beat_id, CASE WHEN regexp_matches(full_q, '(?i)believ|secretly knew|intends? to') THEN clean_q ELSE full_q END AS query, 'src' || (item_id % 20) AS sources FROM b""",
)
def retrieval_requests(spark, d):
    i = F.col("item_id")
    w = F.floor(i / 10).cast("string").alias("work_id")
    t = fx.table(spark, d, "benchmark")
    ev = i.cast("string")
    beats = t.select(w, i.cast("string").alias("beat_id"), i.alias("ord"), F.col("text").alias("change"), F.array(ev).alias("event_ids"), F.array(F.lit("c1"), F.lit("c2")).alias("character_ids"))
    events = t.select(w, ev.alias("event_id"), F.concat(F.lit("e"), i % 7, F.when(i % 4 == 0, " intends to go").otherwise("")).alias("text"))
    spans = fx.beat_spans(spark, d).select("work_id", F.col("beat_id").alias("event_id"), "source_id")
    chars = t.select(w).distinct().select("work_id", F.explode(F.array(F.struct(F.lit("c1").alias("character_id"), F.array(F.lit("Ann"), F.lit("Annie")).alias("names"), F.lit(False).alias("temporary")), F.struct(F.lit("c2").alias("character_id"), F.array(F.lit("Temp")).alias("names"), F.lit(True).alias("temporary")))).alias("c")).select("work_id", "c.*")
    r = rs.build_requests(beats, events, spans, chars)
    return r.select("work_id", "beat_id", "query", F.array_join("sources", ",").alias("sources"))


@query(
    "known_events",
    """WITH b AS (SELECT item_id // 10 AS w, item_id % 13 AS e, item_id AS o FROM benchmark UNION ALL SELECT item_id // 10, item_id % 7, item_id FROM benchmark)
     SELECT CAST(w AS VARCHAR) AS work_id, CAST(e AS VARCHAR) AS event_id, min(o) AS known_from FROM b GROUP BY 1, 2""",
)
def known_events(spark, d):
    i = F.col("item_id")
    b = fx.table(spark, d, "benchmark").select(F.floor(i / 10).cast("string").alias("work_id"), i.alias("ord"), F.array((i % 13).cast("string"), (i % 7).cast("string")).alias("event_ids"))
    return rs.allowed_events(b)


@query("weighted_scores", sql(TERMS.replace("ln(1 + (SELECT count(*) FROM units) / df.df)", "1.0::DOUBLE / df.df") + " SELECT beat_id, unit_id, round(score, 6) AS score, n_terms FROM sc", "units", "beats", "beat_spans"))
def weighted_scores(spark, d):
    """Scores with a weight of the caller's own."""
    u, t, f, src, q = _parts(spark, d)
    return rs.score(q, t, f, scorer=lambda df, n: 1 / df, match=["source_id"]).select("beat_id", "unit_id", F.round("score", 6).alias("score"), "n_terms")


@query(
    "support_recall",
    """WITH g AS (SELECT o_custkey % 500 AS beat, o_orderkey % 3 AS alt, o_orderkey % 40 AS u FROM orders),
     s AS (SELECT 'own' AS set_name, o_custkey % 500 AS beat, o_orderkey % 40 AS u FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'shared', NULL, l_orderkey % 40 FROM lineitem WHERE l_orderkey % 40 < 30),
     need AS (SELECT DISTINCT beat, alt, u FROM g), n AS (SELECT beat, alt, count(*) AS need FROM need GROUP BY 1, 2),
     h AS (SELECT s.set_name, need.beat, alt, count(DISTINCT need.u) AS have FROM need JOIN s ON s.u = need.u AND (s.beat IS NULL OR s.beat = need.beat) GROUP BY 1, 2, 3),
     r AS (SELECT set_name, h.beat, bool_or(have = need) AS ok FROM h JOIN n ON n.beat = h.beat AND n.alt = h.alt GROUP BY 1, 2)
     SELECT k.set_name, CAST(b.beat AS VARCHAR) AS beat_id, coalesce(ok, false) AS recalled FROM (SELECT DISTINCT beat FROM g) b CROSS JOIN (SELECT DISTINCT set_name FROM s) k LEFT JOIN r ON r.beat = b.beat AND r.set_name = k.set_name""",
)
def support_recall(spark, d):
    o = fx.table(spark, d, "orders")
    b, u = (F.col("o_custkey") % 500).cast("string"), (F.col("o_orderkey") % 40).cast("string")
    gold = o.select(b.alias("beat_id"), (F.col("o_orderkey") % 3).alias("alt"), u.alias("unit_id"))
    own = o.where("o_orderkey % 5 <> 0").select(F.lit("own").alias("set_name"), b.alias("beat_id"), u.alias("unit_id"))
    shared = fx.table(spark, d, "lineitem").where("l_orderkey % 40 < 30").select(F.lit("shared").alias("set_name"), F.lit(None).cast("string").alias("beat_id"), (F.col("l_orderkey") % 40).cast("string").alias("unit_id"))
    return rs.support_recall(gold, own.unionByName(shared))


EVEN = """n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_us, unit_id) - 1 AS p, count(*) OVER (PARTITION BY source_id) AS n FROM units),
 i AS (SELECT *, (p*6 + greatest(n - 1, 1) - 1) // greatest(n - 1, 1) AS i FROM n)"""


@query("even_sample", sql(EVEN + " SELECT source_id, unit_id, p + 1 AS pos FROM i WHERE n <= 7 OR ((i*(n - 1)) // 6 = p AND i < 7)", "units"))
def even_sample(spark, d):
    return rs.sample_evenly(fx.units(spark, d), 7, ["source_id"], ["start_us", "unit_id"], F.floor(F.col("start_us") / 3_600_000_000)).select("source_id", "unit_id", "pos")


@query(
    "baseline_pool",
    sql(
        """ws AS (SELECT DISTINCT work_id, source_id FROM beat_spans), mine AS (SELECT work_id, u.* FROM units u JOIN ws USING (source_id)),
     nb AS (SELECT work_id, count(*) AS nb FROM beats GROUP BY 1),
     rel AS (SELECT DISTINCT m.work_id, b.beat_id, m.source_id, m.start_us, m.unit_id FROM mine m JOIN beat_spans b ON b.work_id = m.work_id AND b.source_id = m.source_id AND b.start_us < m.end_us AND m.start_us < b.end_us),
     r2 AS (SELECT rel.*, greatest(1, 40 // nb) AS k, row_number() OVER (PARTITION BY rel.work_id, beat_id ORDER BY source_id, start_us, unit_id) - 1 AS p, count(*) OVER (PARTITION BY rel.work_id, beat_id) AS n FROM rel JOIN nb USING (work_id)),
     q AS (SELECT * FROM (SELECT *, (p*greatest(k-1,1) + greatest(n-1,1) - 1) // greatest(n-1,1) AS i FROM r2) WHERE n <= k OR (k = 1 AND p = 0) OR (k > 1 AND (i*greatest(n-1,1)) // greatest(k-1,1) = p AND i < k)),
     f AS (SELECT q.work_id, source_id, start_us, unit_id, min((b.ord, p)) AS o FROM q JOIN beats b ON b.work_id = q.work_id AND b.beat_id = q.beat_id GROUP BY ALL),
     c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY o, source_id, start_us, unit_id) AS pick FROM f) WHERE pick <= 40),
     nc AS (SELECT work_id, count(*) AS c FROM c GROUP BY 1),
     rest AS (SELECT m.work_id, m.source_id, m.start_us, m.unit_id, 40 - coalesce(nc.c, 0) AS k, row_number() OVER (PARTITION BY m.work_id ORDER BY m.source_id, m.start_us, m.unit_id) - 1 AS p, count(*) OVER (PARTITION BY m.work_id) AS n
      FROM mine m LEFT JOIN nc USING (work_id) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.work_id = m.work_id AND c.unit_id = m.unit_id)),
     e AS (SELECT * FROM (SELECT *, (p*greatest(k-1,1) + greatest(n-1,1) - 1) // greatest(n-1,1) AS i FROM rest) WHERE k > 0 AND (n <= k OR (k = 1 AND p = 0) OR (k > 1 AND (i*greatest(n-1,1)) // greatest(k-1,1) = p AND i < k)))
     SELECT work_id, unit_id, source_id, start_us, 'beat' AS origin, pick AS pos FROM c UNION ALL SELECT work_id, unit_id, source_id, start_us, 'fill', p + 1 FROM e""",
        "units", "beats", "beat_spans",
    ),
)
def baseline_pool(spark, d):
    bs = fx.beat_spans(spark, d)
    return rs.baseline_pool(fx.units(spark, d), fx.beats(spark, d), bs, bs.select("work_id", "source_id").distinct(), 40)


@query("unit_batches", sql("SELECT source_id, unit_id, (row_number() OVER (PARTITION BY source_id ORDER BY start_us, unit_id) - 1) // 32 AS batch FROM units", "units"))
def unit_batches(spark, d):
    return rs.batches(fx.units(spark, d), 32, ["source_id"], ["start_us", "unit_id"], F.floor(F.col("start_us") / 3_600_000_000)).select("source_id", "unit_id", "batch")


def analysis(spark, d):
    """Analysis rows for labelled documents only; the others have none."""
    i = F.col("doc_id")
    pick = F.create_map(F.lit("action"), ((i * 41) % 100) / 100, F.lit("dialogue"), ((i * 43) % 100) / 100, F.lit("reveal"), ((i * 47) % 120) / 100)
    return fx.table(spark, d, "labels").select(i.cast("string").alias("unit_id"), pick.alias("scores"), F.array(F.lit("fact")).alias("facts"), (0.4 + (i % 5) / 10).alias("confidence"))


@query(
    "fill_analysis",
    """SELECT CAST(d.doc_id AS VARCHAR) AS unit_id, l.doc_id IS NULL AS filled, round(CASE WHEN l.doc_id IS NULL THEN 0.15 ELSE 0.4 + (d.doc_id % 5) / 10 END, 6) AS confidence,
     round(CASE WHEN l.doc_id IS NULL THEN (d.doc_id*37) % 100 ELSE ((d.doc_id*41) % 100) / 100 END, 6) AS action FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def fill_analysis(spark, d):
    return rs.fill_analysis(fx.units(spark, d), analysis(spark, d)).select("unit_id", "filled", F.round("confidence", 6).alias("confidence"), F.round(F.col("scores")["action"], 6).alias("action"))


@query("scene_payload", sql("SELECT unit_id, source_id, start_us, end_us FROM units WHERE CAST(unit_id AS BIGINT) IN (SELECT doc_id FROM labels)", "units"))
def scene_payload(spark, d):
    return rs.scene_payload(fx.units(spark, d), analysis(spark, d)).select("unit_id", "source_id", "start_us", "end_us")


@query(
    "scene_scores",
    """SELECT CAST(doc_id AS VARCHAR) AS unit_id, round(least(1, ((doc_id*47) % 120) / 100), 6) AS reveal_value, round(((doc_id*41) % 100) / 100, 6) AS action_value, CAST(0.2 AS DOUBLE) AS performance_value FROM labels""",
)
def scene_scores(spark, d):
    a, s = analysis(spark, d), F.col("scores")
    return a.select("unit_id", F.round(sel.scene_score(s, "reveal_value", 0.1), 6).alias("reveal_value"), F.round(sel.scene_score(s, "action_value", 0.0), 6).alias("action_value"), sel.scene_score(s, "performance_value", 0.2).alias("performance_value"))


@query(
    "fallback_hints",
    """WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN (doc_id*37) % 100 / 100 >= 0.45 OR ((doc_id*41) % 100) / 100 >= 0.6 THEN 'action' END AS a,
     CASE WHEN ((doc_id*43) % 100) / 100 >= 0.62 THEN 'dialogue' END AS b, CASE WHEN least(1, ((doc_id*47) % 120) / 100) >= 0.6 THEN 'reveal' END AS c FROM labels)
     SELECT unit_id, unnest(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS type FROM h""",
)
def fallback_hints(spark, d):
    u = fx.units(spark, d).withColumn("motion", F.col("motion") / 100)
    return sel.fallback_hints(u, analysis(spark, d)).select("unit_id", F.col("types")[0].alias("type"))


def _built(spark, d):
    u = fx.units(spark, d).withColumn("motion", F.col("motion") / 100).withColumn("speech", F.col("speech") / 100)
    i = F.col("unit_id").cast("bigint")
    a = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.create_map(F.lit("action"), (F.col("doc_id") % 7) / 7).alias("scores"), F.lit(0.7).alias("confidence"))
    h = u.select("unit_id", F.lit(0).alias("hint_no"), F.when(i % 3 == 0, i % 3_000_000).when(i % 3 == 1, F.col("start_us") + 500_000).cast("bigint").alias("start_hint_us"),
                 F.when(i % 3 == 1, F.col("start_us") + 1_200_000).cast("bigint").alias("end_hint_us"), F.array(F.when(i % 2 == 0, "line").otherwise("fight")).alias("types"), F.lit(False).alias("must_hear"))
    cu = u.select("source_id", i.alias("ord"), (F.col("start_us") + 300_000).alias("start_us"), (F.col("start_us") + 2_500_000).alias("end_us"), F.concat("lang", "unit_id").alias("text"))
    ev = fx.beat_spans(spark, d).select(F.col("beat_id").alias("event_id"), "source_id", "start_us", "end_us", (F.col("beat_id").cast("int") % 10 / 10).alias("confidence"), (F.col("beat_id").cast("int") % 2 == 0).alias("sensitive"))
    return sel.candidates(u, a, h, cu, ev)


BUILT = """h AS (SELECT *, CAST(unit_id AS BIGINT) AS i FROM units), r AS (SELECT *, CASE i % 3 WHEN 0 THEN i % 3000000 WHEN 1 THEN start_us + 500000 END AS sh, CASE i % 3 WHEN 1 THEN start_us + 1200000 END AS eh FROM h),
 f AS (SELECT *, CASE WHEN sh IS NULL THEN start_us WHEN sh < start_us AND sh >= 0 AND sh <= end_us - start_us THEN start_us + sh ELSE sh END AS s0, coalesce(eh, end_us) AS e0 FROM r),
 g AS (SELECT *, greatest(start_us, least(s0, end_us - 50000)) AS s1 FROM f), k AS (SELECT *, greatest(s1 + 50000, least(e0, end_us)) AS e1 FROM g),
 m AS (SELECT unit_id, source_id, i, start_us AS u0, end_us AS u1, CASE WHEN e1 - s1 < 1500000 THEN greatest(start_us, (s1 + e1) // 2 + CASE WHEN (s1 + e1) % 2 = 1 AND ((s1 + e1) // 2) % 2 = 1 THEN 1 ELSE 0 END - 1200000) ELSE s1 END AS s2,
   CASE WHEN e1 - s1 < 1500000 THEN least(end_us, (s1 + e1) // 2 + CASE WHEN (s1 + e1) % 2 = 1 AND ((s1 + e1) // 2) % 2 = 1 THEN 1 ELSE 0 END + 1200000) ELSE e1 END AS e2 FROM k),
 cq AS (SELECT source_id, CAST(unit_id AS BIGINT) AS ord, start_us + 300000 AS a, start_us + 2500000 AS b FROM units),
 n AS (SELECT m.unit_id, arg_min(a, (abs(a - s2), ord)) AS na, arg_min(b, (abs(b - e2), ord)) AS nb FROM m JOIN cq USING (source_id) GROUP BY 1),
 o AS (SELECT m.*, CASE WHEN i % 2 = 0 AND abs(na - s2) <= 1200000 THEN greatest(u0, na) ELSE s2 END AS s3, CASE WHEN i % 2 = 0 AND abs(nb - e2) <= 1200000 THEN least(u1, nb) ELSE e2 END AS e3 FROM m JOIN n USING (unit_id)),
 p AS (SELECT unit_id || '#0' AS highlight_id, source_id, CASE WHEN e3 <= s3 THEN u0 ELSE s3 END AS start_us, CASE WHEN e3 <= s3 THEN u1 ELSE e3 END AS end_us, i FROM o)"""


@query(
    "candidate_build",
    sql(
        BUILT + """ SELECT highlight_id, p.start_us, p.end_us, CASE WHEN i % 2 = 0 THEN 'dialogue' ELSE 'action' END AS type, count(b.beat_id) AS n_events,
     round(coalesce(max(CAST(b.beat_id AS INTEGER) % 10 / 10), 0.35), 6) AS significance, round(least(0.7, greatest(0.3, coalesce(max(CAST(b.beat_id AS INTEGER) % 10 / 10), 0.35))), 6) AS confidence,
     CAST(CASE WHEN bool_or(CAST(b.beat_id AS INTEGER) % 2 = 0) THEN 0.85 ELSE 0 END AS DOUBLE) AS spoiler FROM p LEFT JOIN beat_spans b ON b.source_id = p.source_id AND b.start_us < p.end_us AND p.start_us < b.end_us GROUP BY ALL""",
        "units", "beat_spans",
    ),
)
def candidate_build(spark, d):
    c = _built(spark, d)
    return c.select("highlight_id", "start_us", "end_us", F.col("types")[0].alias("type"), F.size("event_ids").cast("bigint").alias("n_events"), F.round(F.col("scores")["story_significance"], 6).alias("significance"),
                    F.round("confidence", 6).alias("confidence"), F.col("risks")["spoiler"].alias("spoiler"))


@query(
    "final_score",
    """WITH s AS (SELECT doc_id, ((doc_id*41) % 100) / 100 AS a, ((doc_id*43) % 100) / 100 AS b, (doc_id % 10) / 10 AS c, (doc_id % 4) / 4 AS r FROM documents)
     SELECT CAST(doc_id AS VARCHAR) AS highlight_id, round(greatest(0, least(1, ((a*0.07*1.7 + b*0.07*0.7 + a*0.07*1.35)/(1 + 0.07*0.7 + 0.07*0.35 + 0.10*0.25 - 0.07*0.3) - r*0.1)*(0.65 + 0.35*c))), 6) AS final_score FROM s""",
)
def final_score(spark, d):
    i = F.col("doc_id")
    c = fx.table(spark, d, "documents").select(
        i.cast("string").alias("highlight_id"), F.create_map(F.lit("action_value"), (i * 41) % 100 / 100, F.lit("dialogue_value"), (i * 43) % 100 / 100, F.lit("visual_value"), (i * 41) % 100 / 100).alias("scores"),
        F.create_map(F.lit("redundancy"), (i % 4) / 4).alias("risks"), ((i % 10) / 10).alias("confidence"),
    )
    return sel.final_score(c, sel.genre_weights("action")).select("highlight_id", F.round("final_score", 6).alias("final_score"))


POOL = """r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, ord) AS rn FROM candidates), pool AS (SELECT * FROM r WHERE rn <= 80)"""
DEDUP = (
    POOL
    + """, d(work_id, n, kept, gone) AS (SELECT DISTINCT work_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(id VARCHAR, src VARCHAR, s BIGINT, e BIGINT)[]), CAST([] AS STRUCT(id VARCHAR, "into" VARCHAR)[]) FROM pool
  UNION ALL SELECT d.work_id, d.n + 1,
   CASE WHEN len(list_filter(kept, lambda k: k.src = p.source_id AND greatest(0, least(k.e, p.end_us) - greatest(k.s, p.start_us))*100 >= 65*greatest(1, least(k.e - k.s, p.end_us - p.start_us)))) > 0 THEN kept
    ELSE list_append(kept, {'id': p.highlight_id, 'src': p.source_id, 's': p.start_us, 'e': p.end_us}) END,
   CASE WHEN len(list_filter(kept, lambda k: k.src = p.source_id AND greatest(0, least(k.e, p.end_us) - greatest(k.s, p.start_us))*100 >= 65*greatest(1, least(k.e - k.s, p.end_us - p.start_us)))) > 0
    THEN list_append(gone, {'id': p.highlight_id, 'into': list_filter(kept, lambda k: k.src = p.source_id AND greatest(0, least(k.e, p.end_us) - greatest(k.s, p.start_us))*100 >= 65*greatest(1, least(k.e - k.s, p.end_us - p.start_us)))[1].id}) ELSE gone END
   FROM d JOIN pool p ON p.work_id = d.work_id AND p.rn = d.n + 1),
  fin AS (SELECT work_id, gone FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY n DESC) AS q FROM d) WHERE q = 1),
  ab AS (SELECT work_id, g.id AS highlight_id, g."into" AS absorbed_by FROM (SELECT work_id, unnest(gone) AS g FROM fin)),
  dd AS (SELECT p.*, ab.absorbed_by FROM pool p LEFT JOIN ab USING (work_id, highlight_id))"""
)


def rec(body: str) -> str:
    return sql(body, "candidates").replace("WITH ", "WITH RECURSIVE ", 1)


def _cands(spark, d):
    c = fx.candidates(spark, d)
    return c.withColumn("types", F.array("type")).withColumn("characters", F.when(F.col("ord") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("character")))


@query("overlap_dedup", rec(DEDUP + " SELECT work_id, highlight_id, coalesce(absorbed_by, '') AS absorbed_by FROM dd"))
def overlap_dedup(spark, d):
    return sel.dedup_overlaps(sel.pool_cut(_cands(spark, d))).select("work_id", "highlight_id", F.coalesce("absorbed_by", F.lit("")).alias("absorbed_by"))


@query(
    "absorbed_types",
    rec(DEDUP + """, t AS (SELECT work_id, coalesce(absorbed_by, highlight_id) AS h, absorbed_by IS NOT NULL AS b, score, ord, type FROM dd),
   o AS (SELECT work_id, h, type, min((b, -score, ord)) AS k FROM t GROUP BY 1, 2, 3) SELECT work_id, h AS highlight_id, string_agg(type, ',' ORDER BY k) AS types FROM o GROUP BY 1, 2"""),
)
def absorbed_types(spark, d):
    o = sel.dedup_overlaps(sel.pool_cut(_cands(spark, d))).where("absorbed_by is null")
    return o.select("work_id", "highlight_id", F.array_join("all_types", ",").alias("types"))


DIVERSE = (
    DEDUP
    + """, kk AS (SELECT *, CASE WHEN ord % 9 = 0 THEN NULL ELSE character END AS ch, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, ord) AS kn FROM dd WHERE absorbed_by IS NULL),
  v(work_id, n, ts, cs, id, why) AS (SELECT DISTINCT work_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM kk
   UNION ALL SELECT work_id, kn, CASE WHEN why = '' THEN list_append(ts, type) ELSE ts END, CASE WHEN why = '' THEN list_append(cs, coalesce(ch, '')) ELSE cs END, highlight_id, why FROM (
    SELECT v.work_id, kk.kn, v.ts, v.cs, kk.type, kk.ch, kk.highlight_id, CASE WHEN len(ts) + 1 > 24 THEN 'NOT_REACHED' WHEN confidence < 62 THEN 'LOW_CONFIDENCE' WHEN redundancy > 35 THEN 'REDUNDANT'
     WHEN len(ts) + 1 > 4 AND (len(list_filter(ts, lambda x: x = kk.type)) + 1)*100 > (len(ts) + 1)*45 THEN 'TYPE_SHARE'
     WHEN kk.ch IS NOT NULL AND len(ts) + 1 > 4 AND (len(list_filter(cs, lambda x: x = kk.ch)) + 1)*100 > (len(ts) + 1)*65 THEN 'CHARACTER_SHARE' ELSE '' END AS why
    FROM v JOIN kk ON kk.work_id = v.work_id AND kk.kn = v.n + 1))"""
)


@query("diverse_pool", rec(DIVERSE + " SELECT work_id, id AS highlight_id, why AS rejection, why = '' AS selected FROM v WHERE id IS NOT NULL"))
def diverse_pool(spark, d):
    k = sel.dedup_overlaps(sel.pool_cut(_cands(spark, d))).where("absorbed_by is null").drop("absorbed_by", "all_types")
    return sel.select_diverse(k).select("work_id", "highlight_id", "rejection", "selected")


@query(
    "candidate_ledger",
    rec(
        DIVERSE
        + """ SELECT c.work_id, c.highlight_id, coalesce(v.why = '', false) AS selected, CASE WHEN p.highlight_id IS NULL THEN 'POOL_BUDGET_EXHAUSTED' WHEN dd.absorbed_by IS NOT NULL THEN 'OVERLAPS_KEPT' ELSE v.why END AS rejection
     FROM candidates c LEFT JOIN pool p ON p.work_id = c.work_id AND p.highlight_id = c.highlight_id LEFT JOIN dd ON dd.work_id = c.work_id AND dd.highlight_id = c.highlight_id LEFT JOIN v ON v.work_id = c.work_id AND v.id = c.highlight_id"""
    ),
)
def candidate_ledger(spark, d):
    return sel.ledger(_cands(spark, d)).select("work_id", "highlight_id", "selected", "rejection")


def stored_cut(spark, d):
    """Segments and visuals as stored tables whose readers share one shuffle by work each."""
    s, v = written(fx.segments(spark, d), "segments"), written(fx.visuals(spark, d), "visuals")
    return lying(s.drop("beat_id", "text"), ["work_id"]), lying(v.drop("unit_id"), ["work_id"])


def _highlights(s, visuals):
    v = visuals.where("ord = 1").join(s.select("segment_id", F.col("ord").alias("so")), "segment_id")
    return v.select("work_id", F.concat(F.lit("h"), "segment_id").alias("highlight_id"), "source_id", "start_us", "end_us", F.when(F.col("so") % 2 == 0, F.array("segment_id")).otherwise(F.array().cast("array<string>")).alias("event_ids"))


def _story(spark, d):
    """Highlights, events, their spans and what is known; the first and the third are stored, because they are read several times."""
    s, v = fx.segments(spark, d), fx.visuals(spark, d)
    return written(_highlights(s, v), "highlights"), _events(s), written(_spans(v), "event_spans"), _known(s)


def _events(s):
    return s.select("work_id", F.col("segment_id").alias("event_id"), F.col("ord").alias("reveal_order"))


def _spans(v):
    return v.select("work_id", F.col("segment_id").alias("event_id"), "source_id", "start_us", "end_us")


def _known(s):
    return s.where("ord % 3 <> 0").select("work_id", F.col("segment_id").alias("event_id"), F.col("allow_reuse").alias("allow_prepose"))


@query(
    "hook_eligibility",
    sql(
        """h AS (SELECT v.work_id, 'h' || v.segment_id AS hid, v.segment_id AS sid, v.source_id, v.start_us, v.end_us, s.ord AS so FROM visuals v JOIN segments s ON s.segment_id = v.segment_id WHERE v.ord = 1),
     l AS (SELECT work_id, hid, sid AS event_id FROM h WHERE so % 2 = 0 UNION SELECT h.work_id, hid, v.segment_id FROM h JOIN visuals v ON v.work_id = h.work_id AND v.source_id = h.source_id AND v.start_us < h.end_us AND h.start_us < v.end_us WHERE so % 2 = 1),
     f AS (SELECT work_id, min(ord) AS first FROM segments GROUP BY 1),
     g AS (SELECT l.work_id, hid, bool_or(e.ord > first) AS late, count(CASE WHEN e.ord > first AND NOT (e.ord % 3 <> 0 AND e.allow_reuse) THEN 1 END) AS denied FROM l JOIN segments e ON e.segment_id = l.event_id JOIN f ON f.work_id = l.work_id GROUP BY 1, 2)
     SELECT work_id, hid AS highlight_id, NOT late OR denied = 0 AS eligible, CASE WHEN NOT late THEN 'EARLIEST_REVEAL' WHEN denied > 0 THEN 'PREPOSE_DENIED' ELSE 'ALL_ALLOWED' END AS reason, denied AS n_denied FROM g""",
        "segments", "visuals",
    ),
)
def hook_eligibility(spark, d):
    return sel.hook_eligibility(*_story(spark, d)).select("work_id", "highlight_id", "eligible", "reason", F.size("denied").cast("bigint").alias("n_denied"))


@query(
    "target_duration",
    """WITH w AS (SELECT CAST(c_custkey AS VARCHAR) AS work_id, ['auto', 'auto', 'highlight', 'series', 'auto'][1 + c_custkey % 5] AS m, (c_nationkey + 1)*400 AS s, count(o_orderkey) AS e, c_custkey % 8 AS ch, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
     x AS (SELECT *, e + ch*1.5 + r*2.5 AS cx FROM w), y AS (SELECT *, greatest(s*CASE WHEN s > 5400 THEN 0.10 ELSE 0.13 END, 150 + cx*9) AS t, CASE WHEN m <> 'auto' THEN m WHEN cx < 28 AND s < 2400 THEN 'short' WHEN cx < 58 AND s < 5400 THEN 'standard' ELSE 'deep' END AS md FROM x)
     SELECT work_id, md AS mode, CAST(CASE WHEN m = 'highlight' THEN 60 WHEN m = 'series' THEN 1200 WHEN md = 'short' THEN round(greatest(180, least(360, t)), 1) WHEN md = 'standard' THEN round(greatest(360, least(600, t)), 1) ELSE round(greatest(600, least(1200, t)), 1) END AS DOUBLE) AS target_sec FROM y""",
)
def target_duration(spark, d):
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("o_orderstatus") == "F").alias("n_reveals"))
    c = fx.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["n_events", "n_reveals"])
    mode = F.element_at(F.array(*[F.lit(x) for x in ("auto", "auto", "highlight", "series", "auto")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    w = c.select(F.col("c_custkey").cast("string").alias("work_id"), mode.alias("duration_mode"), ((F.col("c_nationkey") + 1) * 400).alias("source_sec"), "n_events", (F.col("c_custkey") % 8).alias("n_characters"), "n_reveals")
    return sel.target_duration(w)


def _board(spark, d):
    s = fx.segments(spark, d).withColumn("highlight_id", F.when(F.col("mode") == "original", F.concat(F.lit("h"), "segment_id"))).withColumn("text_raw", F.lit(None).cast("string"))
    h = _highlights(fx.segments(spark, d), fx.visuals(spark, d)).withColumn("quote", F.lit("quoted words"))
    v = fx.visuals(spark, d)
    p = v.where("ord % 4 <> 0").groupBy("unit_id").agg(F.min("source_id").alias("source_id"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).withColumn("highlight_id", F.lit(None).cast("string"))
    return sel.normalize_segments(s, v, p, h)


@query(
    "normalized_board",
    sql(
        """t AS (SELECT segment_id, CAST(sum(end_us - start_us) AS BIGINT) AS vis, arg_min(end_us - start_us, ord) AS h_len FROM visuals GROUP BY 1),
     u AS (SELECT s.*, coalesce(vis, 0) AS vis, h_len, len(regexp_extract_all(text, '[A-Za-z0-9]+')) + len(regexp_extract_all(text, '[,.!?;:]')) // 3 AS un FROM segments s LEFT JOIN t USING (segment_id))
     SELECT segment_id, CASE WHEN mode = 'original' AND h_len IS NOT NULL THEN h_len WHEN mode = 'original' THEN planned_us
      ELSE CAST(round(least(greatest(1000000.0, vis), greatest(greatest(1000000.0, un*1000000/5.2), greatest(planned_us, un*2000000/9.4)))) AS BIGINT) END AS planned_us,
      CASE WHEN mode = 'original' AND h_len IS NOT NULL THEN 'quoted words' ELSE text END AS text FROM u""",
        "segments", "visuals",
    ),
)
def normalized_board(spark, d):
    return _board(spark, d)[0].select("segment_id", "planned_us", "text")


@query(
    "board_findings",
    sql(
        """p AS (SELECT unit_id, min(source_id) AS ps, min(start_us) AS p0, max(end_us) AS p1 FROM visuals WHERE ord % 4 <> 0 GROUP BY 1),
     v AS (SELECT v.*, s.mode, ps, p0, p1 FROM visuals v JOIN segments s ON s.segment_id = v.segment_id LEFT JOIN p USING (unit_id))
     SELECT segment_id || '/' || ord AS entity_id, 'VISUAL_UNIT_UNKNOWN' AS rule_id FROM v WHERE mode = 'voiceover' AND ps IS NULL UNION ALL SELECT segment_id || '/' || ord, 'VISUAL_SOURCE_MISMATCH' FROM v WHERE mode = 'voiceover' AND ps <> source_id
     UNION ALL SELECT segment_id || '/' || ord, 'VISUAL_LEAVES_UNIT' FROM v WHERE mode = 'voiceover' AND (start_us < p0 - 1000 OR end_us > p1 + 1000)
     UNION ALL SELECT segment_id, 'SEGMENT_WITHOUT_VISUAL' FROM segments WHERE segment_id NOT IN (SELECT segment_id FROM visuals)""",
        "segments", "visuals",
    ),
)
def board_findings(spark, d):
    return _board(spark, d)[2].select("entity_id", "rule_id")


@query(
    "boundary_delta",
    sql(
        """m AS (SELECT work_id, 'h' || segment_id AS h, planned_us + (ord % 5 - 2)*1000000 AS n FROM segments WHERE ord % 2 = 0), s AS (SELECT s.work_id, s.beat_id, n - planned_us AS dl FROM segments s JOIN m ON m.work_id = s.work_id AND m.h = 'h' || s.segment_id WHERE mode = 'original'),
     d AS (SELECT work_id, beat_id, sum(dl) AS dl FROM s GROUP BY 1, 2), b AS (SELECT work_id, beat_id, sum(planned_us) AS t, sum(CASE WHEN mode = 'original' THEN planned_us ELSE 0 END) AS o FROM segments GROUP BY 1, 2)
     SELECT b.work_id, b.beat_id, CAST(t + coalesce(dl, 0) AS BIGINT) AS target_us, CAST(o + coalesce(dl, 0) AS BIGINT) AS target_original_us, t + coalesce(dl, 0) <= 0 OR o + coalesce(dl, 0) < 0 AS invalid FROM b LEFT JOIN d USING (work_id, beat_id)""",
        "segments",
    ),
)
def boundary_delta(spark, d):
    s = fx.segments(spark, d).withColumn("highlight_id", F.concat(F.lit("h"), "segment_id"))
    m = s.where("ord % 2 = 0").select("work_id", "highlight_id", F.col("planned_us").alias("old_len_us"), (F.col("planned_us") + (F.col("ord") % 5 - 2) * 1_000_000).alias("new_len_us"))
    b = s.groupBy("work_id", "beat_id").agg(F.sum("planned_us").alias("target_us"), F.sum(F.when(F.col("mode") == "original", F.col("planned_us")).otherwise(0)).alias("target_original_us"))
    return sel.apply_boundary_delta(s, b, m)[1].select("work_id", "beat_id", "target_us", "target_original_us", "invalid")
