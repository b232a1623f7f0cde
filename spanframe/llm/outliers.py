"""Quality rules: minimum-covariance-determinant outliers per language and source, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

BLANKS = " \t\n\x0b\x0c\r"
BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
FEATURES = ["log_words", "word_length", "symbol_rate", "repeat_rate", "line_repeat_rate"]
REPEATED = 6  # words that one repeated three-word window covers
PARAMETER_ROWS = 20_000  # groups whose parameters are broadcast; beyond, the join is salted
SALTS = 64


def text_statistics(units: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of ``text``; null counts as empty.

    Repeated three-word windows are found inside the row: window hashes with their
    position in the low bits are sorted, and neighbours of equal hash are compared word
    by word.
    """
    w, m = "__words", "__windows"
    text = F.coalesce(F.col("text"), F.lit(""))
    step = units.withColumn("__text", text).withColumn(w, F.expr(rf"filter(split(__text, '{BLANK}+'), x -> x != '')".replace("\\", "\\\\")))
    step = step.withColumn("n_words", F.size(w).cast("long")).withColumn(m, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))
    step = step.withColumn("__bits", F.ceil(F.log2(F.col(m) + 1)).cast("int"))
    codes = F.expr(f"transform(if({m} > 0, sequence(0, {m} - 1), cast(array() as array<int>)), i -> shiftleft(xxhash64({w}[i], {w}[i+1], {w}[i+2]), __bits) | cast(i as bigint))")
    step = step.withColumn("__sorted", F.sort_array(codes)).withColumn("__mask", F.expr("shiftleft(1L, __bits) - 1L"))
    same = (f"shiftrightunsigned(__sorted[{{0}}], __bits) = shiftrightunsigned(__sorted[{{1}}], __bits) AND "
            + " AND ".join(f"{w}[cast(__sorted[{{0}}] & __mask as int) + {k}] = {w}[cast(__sorted[{{1}}] & __mask as int) + {k}]" for k in range(3)))
    twice = F.expr(f"""sort_array(transform(filter(if({m} > 1, sequence(0, {m} - 1), cast(array() as array<int>)),
        j -> (j > 0 AND {same.format("j", "j-1")}) OR (j < {m} - 1 AND {same.format("j", "j+1")})), j -> cast(__sorted[j] & __mask as int)))""")
    step = step.withColumn("__twice", twice)
    covered = F.expr("aggregate(__twice, named_struct('n', 0L, 'upto', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.upto), 'upto', p + 3), a -> a.n)")
    lines = F.expr(rf"filter(split(__text, '\n'), x -> x rlike '[^\x20\x09-\x0D]')".replace("\\", "\\\\"))
    step = step.withColumn("n_repeat_words", covered).withColumn("__lines", lines)
    return step.withColumns({
        "word_chars": F.length(F.translate("__text", BLANKS, "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__text", w, m, "__bits", "__sorted", "__mask", "__twice", "__lines")


def features() -> dict[str, Column]:
    """The transformed statistics: logs and square roots, which even out counts and rates."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "log_words": F.log(words + 1.0), "word_length": F.col("word_chars") / words,
        "symbol_rate": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "repeat_rate": F.sqrt(F.col("n_repeat_words") / words), "line_repeat_rate": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    }


def noise() -> list[Column]:
    """Counting noise of each statistic: the variance that single events, here or not by chance, give it.

    That of log(k) is 1/k, that of k/n is k/n^2, that of sqrt(k/n) is m/4n for events of size m. A group's least
    variance is the mean over its rows, so that a statistic that is constant in the core
    does not reject its first exception, whatever the lengths of texts.
    """
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return [1 / words, chars / (words * words), 1 / (4 * chars), REPEATED / (4 * words), 1 / (4 * lines)]


def chi_square(x: float, odd: int) -> float:
    """The distribution function of chi-square with an odd number of degrees of freedom."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, odd - 1, 2):
        total -= term
        term *= x / (k + 2)
    return total


def chi_quantile(share: float, odd: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(100):
        lo, hi = ((lo + hi) / 2, hi) if chi_square((lo + hi) / 2, odd) < share else (lo, (lo + hi) / 2)
    return hi


def consistency(core: float) -> float:
    """What the covariance of the ``core`` share of normal rows nearest the mean is multiplied by to be that of all."""
    p = len(FEATURES)
    return core / chi_square(chi_quantile(core, p), p + 2) if core < 1 else 1.0


def attach(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """Joins the parameters of each row's group, ``__group``.

    Few parameter rows are broadcast; more are repeated under ``SALTS`` salts, so that
    the rows of a large group spread over as many tasks.
    """
    if parameters.count() <= PARAMETER_ROWS:
        return rows.join(F.broadcast(parameters), "__group", "left")
    salted = parameters.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")).join(salted, ["__group", "__salt"], "left").drop("__salt")


def estimate(rows: DataFrame, factor: float) -> DataFrame:
    """Per group the mean and the Cholesky factor of ``factor`` times the covariance of its rows, plus counting noise."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.groupBy("__group").agg(
        *[F.avg(f).alias(f"mean{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.avg(v).alias(f"noise{i}") for i, v in enumerate(noise())],
    )
    for i in range(p):  # Cholesky, row by row
        for j in range(i + 1):
            rest = factor * F.col(f"c{i}_{j}") + (F.col(f"noise{i}") if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            sums = sums.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    return sums.select("__group", *[f"mean{i}" for i in range(p)], *[f"l{i}_{j}" for i, j in pairs])


def distances(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance ``d2`` by forward substitution."""
    out = attach(rows, parameters)
    p = len(FEATURES)
    for i in range(p):
        rest = F.col(FEATURES[i]) - F.col(f"mean{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", total).drop(*[c for c in parameters.columns if c != "__group"], *[f"z{i}" for i in range(p)])


def screen_units(units: DataFrame, core: float = 0.75, steps: int = 3, tail: float = 0.001, least_group: int = 50,
                 least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Rejects scene-unit texts whose statistics are outliers among those of their language and source.

    units(unit_id, text, lang, source_id). The statistics of each text are transformed
    (``FEATURES``). In each (lang, source_id) the covariance is estimated by
    concentration steps: from medians and quartile ranges on, the share ``core`` of rows
    with the least distance gives the next mean and covariance, ``steps`` times; the
    covariance is made consistent for normal rows (``consistency``) and counting noise is
    added. A unit with a squared Mahalanobis distance beyond the chi-square quantile that a
    share ``tail`` of normal rows exceeds is an outlier. Groups of fewer than
    ``least_group`` rows are pooled by language; a pool that small rejects nothing.

    Returns per unit row: unit_id, lang, source_id, n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words, distance (null where no estimate is made), failed (fewer
    than ``least_words`` words, or over ``repeat_percent`` percent repeated ones), outlier,
    kept (neither).

    Null text counts as empty and fails; null lang or source_id is a group of its own.
    Repeated rows give repeated rows, an empty table an empty one; other columns are
    ignored. Only sums and quantile sketches of groups are shuffled.
    """
    given = units.select("unit_id", "lang", "source_id", "text")
    counted = written(text_statistics(given).drop("text").withColumns(features()), "statistics")
    groups = counted.groupBy("lang", "source_id").agg(F.count("*").alias("__n"))
    name = lambda *parts: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in parts])
    big = groups.where(F.col("__n") >= least_group).select(name("lang", "source_id").alias("__own")).distinct()
    lone = counted.withColumn("__own", name("lang", "source_id"))
    if big.count() <= PARAMETER_ROWS:
        marked = lone.join(F.broadcast(big.withColumn("__big", F.lit(True))), "__own", "left")
    else:
        salted = big.withColumn("__big", F.lit(True)).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = lone.withColumn("__salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")).join(salted, ["__own", "__salt"], "left").drop("__salt")
    rows = written(marked.withColumn("__group", F.when(F.col("__big"), F.col("__own")).otherwise(name("lang"))).drop("__own", "__big"), "groups")

    quartiles = rows.groupBy("__group").agg(F.count("*").alias("__rows"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f) for f in FEATURES],
                                            *[F.avg(v).alias(f"noise{i}") for i, v in enumerate(noise())])
    discard(counted)
    p = len(FEATURES)
    start = quartiles.where(F.col("__rows") >= least_group).select(
        "__group", *[F.col(f)[1].alias(f"mean{i}") for i, f in enumerate(FEATURES)],
        *[(F.greatest((F.col(FEATURES[i])[2] - F.col(FEATURES[i])[0]) / 1.349, F.sqrt(f"noise{i}")) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in range(p) for j in range(i + 1)],
    )
    parameters = written(start, "parameters")
    for _ in range(steps):
        near = distances(rows, parameters)
        limit = near.where("d2 IS NOT NULL").groupBy("__group").agg(F.percentile_approx("d2", core, 2000).alias("limit"))
        inner = near.where("d2 IS NOT NULL")
        joined = inner.join(F.broadcast(limit), "__group") if limit.count() <= PARAMETER_ROWS else inner.join(limit, "__group")
        last, parameters = parameters, written(estimate(joined.where("d2 <= limit"), consistency(core)), "parameters")
        discard(last)
    out = distances(rows, parameters).withColumn("distance", F.col("d2")).withColumn(
        "failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")),
    ).withColumn("outlier", F.coalesce(F.col("distance") > chi_quantile(1 - tail, len(FEATURES)), F.lit(False)))
    return out.select(
        "unit_id", "lang", "source_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "distance", "failed", "outlier", (~F.col("failed") & ~F.col("outlier")).alias("kept"),
    )
