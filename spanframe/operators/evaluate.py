"""Evaluation roll-ups with frozen denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import fixed
from spanframe.functions import text as tx
from spanframe.plans import findings as fd

# metric -> (eligibility column or None, score column)
METRICS = {
    "scope_coverage": (None, "scope_declared"),
    "routing_mode": (None, "routing_correct"),
    "execution": ("in_scope", "execution_accepted"),
    "production_usability": ("full_production", "production_usable"),
}


def _long(roster: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per eligible case and metric; cases without a score stay in."""
    cols = sorted({s for _, s in METRICS.values()})
    j = roster.join(scores.select("case_id", *cols), "case_id", "left")
    rows = F.array_compact(
        F.array(*[F.when(F.lit(True) if need is None else F.col(need), F.struct(F.lit(m).alias("metric"), F.col(s).alias("ok"))) for m, (need, s) in METRICS.items()])
    )
    return j.select("case_id", "family", "stratum", "package", F.explode(rows).alias("x")).select("case_id", "family", "stratum", "package", "x.metric", "x.ok")


def _rate(df):
    return df.agg(F.count_if(F.col("ok")).alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.count_if(F.col("ok").isNull()).alias("unreviewed"))


def frozen_rates(roster: DataFrame, scores: DataFrame) -> DataFrame:
    """EV1: passes over all eligible cases of the roster."""
    return _rate(_long(roster, scores).groupBy("metric"))


def rates_by(roster: DataFrame, scores: DataFrame) -> DataFrame:
    """EV2: the same by family, package and stratum in one pass of grouping sets."""
    r = _long(roster, scores)
    g = r.groupingSets([["metric", "family"], ["metric", "package"], ["metric", "stratum"]], "metric", "family", "package", "stratum")
    g = g.agg(
        F.count_if(F.col("ok")).alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.count_if(F.col("ok").isNull()).alias("unreviewed"),
        F.grouping("family").alias("gf"), F.grouping("package").alias("gp"),
    )
    kind = F.when(F.col("gf") == 0, "family").when(F.col("gp") == 0, "package").otherwise("stratum")
    return g.select("metric", kind.alias("grouping"), F.coalesce("family", "package", "stratum").alias("member"), "numerator", "denominator", "unreviewed")


def allocation(roster: DataFrame) -> DataFrame:
    """EV2: cases per stratum and package."""
    return roster.groupBy("stratum", "package").agg(F.count(F.lit(1)).alias("n_cases"))


def macro_mean(rates: DataFrame) -> DataFrame:
    """EV3: mean family rate per metric over families with a denominator."""
    f = rates.where("grouping = 'family' and denominator > 0").withColumn("pct", F.col("numerator") * 100 / F.col("denominator"))
    return f.groupBy("metric").agg(F.count(F.lit(1)).alias("n_families"), F.round(F.avg("pct"), 6).alias("mean_percent"))


def check_results(runs: DataFrame, scores: DataFrame, roster: DataFrame) -> DataFrame:
    """EV4: scores must be bound to their run and fit its status.

    ``runs``: case_id, run_id, status.  ``scores``: case_id, run_id, reviewer and checks.
    """
    one = F.lit("evaluation")
    r = runs.select("case_id", F.col("run_id").alias("__run"), "status")
    j = scores.join(r, "case_id", "left")
    marks = [s for _, s in METRICS.values()] + ["critical_pass"]
    any_pass = F.lit(False)
    for m in marks:
        any_pass = any_pass | F.coalesce(F.col(m), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    a = fd.checks(
        j,
        [
            ("SCORE_BOUND_TO_MISSING_OR_DIFFERENT_RUN", F.col("__run").isNull() | (F.col("__run") != F.col("run_id"))), ("NAMED_REVIEWER_REQUIRED", tx.strip("reviewer") == ""),
            ("UNEXECUTED_CASE_CANNOT_EARN_PASSES", F.col("status").isin("NOT_RUN", "DEPENDENCY_MISSING") & any_pass),
            ("FAILED_RUN_CANNOT_COUNT", (F.col("status") == "FAILED") & (yes("execution_accepted") | yes("production_usable"))),
            ("REFUSAL_IS_NOT_USABLE", (F.col("status") == "EXPECTED_REFUSAL") & yes("production_usable")),
        ],
        work=one, entity="case_id",
    )
    lost = runs.select("case_id").unionByName(scores.select("case_id")).distinct().join(roster.select("case_id"), "case_id", "left_anti")
    return a.unionByName(fd.finding(lost, "UNKNOWN_CASE", F.lit(True), F.col("case_id"), work=one))


def thresholds(rates: DataFrame, roster: DataFrame, scores: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """EV5: metric targets by exact integer comparison, and critical cases."""
    targets = targets or fixed.EVALUATION_TARGETS
    t = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))])
    want = F.element_at(t, F.col("metric"))
    met = (F.col("denominator") > 0) & (F.col("numerator") * 100 >= F.col("denominator") * want)
    a = rates.select("metric", "numerator", "denominator", met.alias("met"))
    c = roster.where("critical").join(scores.select("case_id", "critical_pass"), "case_id", "left")
    c = c.agg(F.count_if("critical_pass").alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    c = c.select(F.lit("critical").alias("metric"), "numerator", "denominator", ((F.col("denominator") > 0) & (F.col("numerator") == F.col("denominator"))).alias("met"))
    return a.unionByName(c)
