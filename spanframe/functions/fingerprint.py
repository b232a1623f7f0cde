"""Row fingerprints: SHA-256 over a canonical text form of chosen columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions.clock import col


def framed(*values) -> Column:
    """Values one after the other, each as ``length:text``; NULL is ``~``.

    The length tells where a value ends, so no two lists of values have one form.
    """
    text = [col(v).cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in text])


def canonical(cols) -> Column:
    """``name=`` and the framed value of each column, in name order."""
    return F.concat(*[F.concat(F.lit(f"{c}="), framed(F.col(c))) for c in sorted(cols)])


def sha(c) -> Column:
    return F.sha2(col(c).cast("string"), 256)


def row_digest(cols) -> Column:
    return F.sha2(canonical(cols), 256)
