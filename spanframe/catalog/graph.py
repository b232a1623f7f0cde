"""Queries of the graph and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.operators import evaluate as ev
from spanframe.operators import graph as gr

LINKS = r"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)\s(?:src|href|poster|data)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)) AS r FROM pages),
 l AS (SELECT DISTINCT page_id, trim(r, '"''') AS ref FROM h), links AS (SELECT * FROM l WHERE ref <> '' AND NOT starts_with(ref, '#') AND NOT starts_with(ref, 'data:'))"""


def links(spark, d):
    return gr.extract_links(fx.table(spark, d, "pages"))


query("page_links", f"WITH {LINKS} SELECT page_id, ref FROM links")(lambda s, d: links(s, d).where("kind = 'attribute'").select("page_id", "ref").distinct())


def _scripted(spark, d):
    """Pages with a script of their own: literal and computed loads, by page."""
    lines = ["fetch('/api/", F.col("page_id"), "', {a: 1}); import( \"./m", F.col("page_id") % 9, ".js\" ); new URL('img/", F.col("page_id") % 5, ".png', base);",
             F.when(F.col("page_id") % 3 == 0, "fetch(root + name, opts); import(pick());").otherwise(""), F.when(F.col("page_id") % 4 == 0, "new URL(`x${i}`)").otherwise("")]
    script = F.concat(F.lit("<script>"), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in lines], F.lit("</script>"))
    return fx.table(spark, d, "pages").select("page_id", F.concat("html", script).alias("html"))


query(
    "call_links",
    """SELECT page_id, unnest(['/api/' || page_id, './m' || page_id % 9 || '.js', 'img/' || page_id % 5 || '.png']) AS ref FROM pages""",
)(lambda s, d: gr.extract_links(_scripted(s, d)).where("kind = 'call'").select("page_id", "ref"))
query(
    "dynamic_links",
    r"""WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'fetch(root + name, opts); import(pick());' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN 'new URL(`x${i}`)' ELSE '' END AS js FROM pages),
     e AS (SELECT page_id, unnest(list_concat(regexp_extract_all(js, '\b(?:fetch|import)\s*\(\s*([^)]*)\)', 1), regexp_extract_all(js, '\bnew\s+URL\s*\(\s*([^,)]*)', 1))) AS x FROM s)
     SELECT DISTINCT CAST(page_id AS VARCHAR) AS entity_id, trim(split_part(x, ',', 1)) AS evidence FROM e""",
)(lambda s, d: gr.dynamic_links(_scripted(s, d)).select("entity_id", "evidence"))


def _declared(spark, d):
    m = F.pmod(F.col("page_id") + F.length("ref"), F.lit(5))
    l0 = links(spark, d).select("page_id", "ref").distinct()
    return l0.where(m != 4).select("page_id", "ref", F.when(m == 0, "external").when(m == 1, "bundle").when(m == 2, "forbidden").otherwise("maybe").alias("decision"), F.when(F.length("ref") % 2 == 0, "why").alias("reason"))


DECL = LINKS + """, dc AS (SELECT page_id, ref, ['external', 'bundle', 'forbidden', 'maybe'][1 + (page_id + length(ref)) % 5] AS dec, CASE WHEN length(ref) % 2 = 0 THEN 'why' END AS why FROM links WHERE (page_id + length(ref)) % 5 <> 4)"""


@query(
    "link_findings",
    f"WITH {DECL}" + """, j AS (SELECT links.page_id, links.ref, dec, why FROM links LEFT JOIN dc ON dc.page_id = links.page_id AND dc.ref = links.ref)
     SELECT page_id, ref AS entity_id, 'RESOURCE_EDGE_SET_MISMATCH' AS rule_id FROM j WHERE dec IS NULL UNION ALL SELECT page_id, ref, 'RESOURCE_DECISION_REQUIRED' FROM j WHERE dec = 'maybe' UNION ALL SELECT page_id, ref, 'RESOURCE_REASON_REQUIRED' FROM j WHERE dec IN ('external', 'forbidden') AND why IS NULL
     UNION ALL SELECT page_id, ref, 'REMOTE_RESOURCE_MUST_BE_EXTERNAL' FROM j WHERE regexp_matches(ref, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') AND dec <> 'external'""",
)
def link_findings(spark, d):
    return gr.classify_links(links(spark, d), _declared(spark, d))[1].select(F.col("work_id").cast("bigint").alias("page_id"), "entity_id", "rule_id")


EDGES = LINKS + """, e AS (SELECT page_id AS s, (page_id*7 + length(ref)*3) % (SELECT count(*) FROM pages) AS t FROM links)"""


def edges(spark, d):
    """Page graph derived from the links: every reference points at a page."""
    p = fx.table(spark, d, "pages")
    n = p.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    e = links(spark, d).where("kind = 'attribute'").select("page_id", "ref").distinct().withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    return e.select(F.col("page_id").alias("src"), ((F.col("page_id") * 7 + F.length("ref") * 3) % F.col("n")).alias("dst"))


@query(
    "link_closure",
    f"WITH RECURSIVE {EDGES}, r(id) AS (SELECT page_id FROM pages WHERE page_id % 40 = 0 UNION SELECT e.t FROM r JOIN e ON e.s = r.id) SELECT id FROM r",
)
def link_closure(spark, d):
    return gr.closure(edges(spark, d), fx.table(spark, d, "pages").where("page_id % 40 = 0").select(F.col("page_id").alias("id"))).select("id")


@query(
    "reference_integrity",
    f"WITH {EDGES}" + """, g AS (SELECT s, t, count(*) AS n FROM e GROUP BY 1, 2) SELECT s || '>' || t AS entity_id, 'UNKNOWN_TARGET' AS rule_id FROM g WHERE t % 11 = 0 UNION ALL SELECT s || '>' || t, 'SELF_REFERENCE' FROM g WHERE s = t UNION ALL SELECT s || '>' || t, 'DUPLICATE_REFERENCE' FROM g WHERE n > 1""",
)
def reference_integrity(spark, d):
    nodes = fx.table(spark, d, "pages").where("page_id % 11 <> 0").select(F.col("page_id").alias("id"))
    return gr.check_refs(edges(spark, d), nodes).select("entity_id", "rule_id")


LONG = """j AS (SELECT r.*, s.scope_declared, s.routing_correct, s.execution_accepted, s.production_usable FROM roster r LEFT JOIN scores s USING (case_id)),
 m AS (SELECT family, stratum, package, 'scope_coverage' AS metric, scope_declared AS ok FROM j UNION ALL SELECT family, stratum, package, 'routing_mode', routing_correct FROM j UNION ALL SELECT family, stratum, package, 'execution', execution_accepted FROM j WHERE in_scope UNION ALL SELECT family, stratum, package, 'production_usability', production_usable FROM j WHERE full_production)"""
AGG = "count(CASE WHEN ok THEN 1 END) AS numerator, count(*) AS denominator, count(CASE WHEN ok IS NULL THEN 1 END) AS unreviewed"
BY = LONG + f""", rb AS (SELECT metric, 'family' AS "grouping", family AS member, {AGG} FROM m GROUP BY 1, 2, 3 UNION ALL SELECT metric, 'package', package, {AGG} FROM m GROUP BY 1, 2, 3 UNION ALL SELECT metric, 'stratum', stratum, {AGG} FROM m GROUP BY 1, 2, 3)"""

query("frozen_rates", sql(LONG + f" SELECT metric, {AGG} FROM m GROUP BY 1", "roster", "scores"))(lambda s, d: ev.frozen_rates(fx.roster(s, d), fx.scores(s, d)))
query("rates_by_group", sql(BY + " SELECT * FROM rb", "roster", "scores"))(lambda s, d: ev.rates_by(fx.roster(s, d), fx.scores(s, d)))
query("allocation", sql("SELECT stratum, package, count(*) AS n_cases FROM roster GROUP BY 1, 2", "roster"))(lambda s, d: ev.allocation(fx.roster(s, d)))
query("macro_mean", sql(BY + """ SELECT metric, count(*) AS n_families, round(avg(numerator*100/denominator), 6) AS mean_percent FROM rb WHERE "grouping" = 'family' GROUP BY 1""", "roster", "scores"))(
    lambda s, d: ev.macro_mean(ev.rates_by(fx.roster(s, d), fx.scores(s, d)))
)
query(
    "evaluation_targets",
    sql(
        LONG + f""", f AS (SELECT metric, {AGG} FROM m GROUP BY 1) SELECT metric, numerator, denominator, numerator*100 >= denominator*CASE metric WHEN 'production_usability' THEN 85 ELSE 90 END AS met FROM f
     UNION ALL SELECT 'critical', count(CASE WHEN critical_pass THEN 1 END), count(*), count(CASE WHEN critical_pass THEN 1 END) = count(*) FROM roster LEFT JOIN scores USING (case_id) WHERE critical""",
        "roster", "scores",
    ),
)(lambda s, d: ev.thresholds(ev.frozen_rates(fx.roster(s, d), fx.scores(s, d)), fx.roster(s, d), fx.scores(s, d)))


@query(
    "result_checks",
    sql(
        """r AS (SELECT case_id, CAST(case_id AS BIGINT) AS i, CASE WHEN CAST(case_id AS BIGINT) % 12 = 1 THEN 'other' ELSE 'r' || case_id END AS run, ['SUCCEEDED', 'FAILED', 'EXPECTED_REFUSAL', 'NOT_RUN'][1 + CAST(case_id AS BIGINT) % 4] AS st FROM roster WHERE CAST(case_id AS BIGINT) % 15 <> 2),
     s AS (SELECT *, CAST(case_id AS BIGINT) AS i FROM scores), j AS (SELECT s.*, r.run, r.st, r.i AS ri FROM s LEFT JOIN r ON r.i = s.i)
     SELECT case_id AS entity_id, 'SCORE_BOUND_TO_MISSING_OR_DIFFERENT_RUN' AS rule_id FROM j WHERE run IS NULL OR run <> run_id UNION ALL SELECT case_id, 'NAMED_REVIEWER_REQUIRED' FROM j WHERE i % 10 = 0
     UNION ALL SELECT case_id, 'UNEXECUTED_CASE_CANNOT_EARN_PASSES' FROM j WHERE st = 'NOT_RUN' AND (scope_declared OR routing_correct OR execution_accepted OR production_usable OR critical_pass)
     UNION ALL SELECT case_id, 'FAILED_RUN_CANNOT_COUNT' FROM j WHERE st = 'FAILED' AND (execution_accepted OR production_usable) UNION ALL SELECT case_id, 'REFUSAL_IS_NOT_USABLE' FROM j WHERE st = 'EXPECTED_REFUSAL' AND production_usable""",
        "roster", "scores",
    ),
)
def result_checks(spark, d):
    i = F.col("case_id").cast("bigint")
    st = F.element_at(F.array(*[F.lit(x) for x in ("SUCCEEDED", "FAILED", "EXPECTED_REFUSAL", "NOT_RUN")]), (i % 4 + 1).cast("int"))
    r = fx.roster(spark, d).where(i % 15 != 2).select("case_id", F.when(i % 12 == 1, "other").otherwise(F.concat(F.lit("r"), "case_id")).alias("run_id"), st.alias("status"))
    s = fx.scores(spark, d).withColumn("reviewer", F.when(i % 10 == 0, "").otherwise("Kim"))
    return ev.check_results(r, s, fx.roster(spark, d)).select("entity_id", "rule_id")
