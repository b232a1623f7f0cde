"""Exact time arithmetic on integer columns.

Times are BIGINT microseconds, rates are BIGINT fractions.  Products are widened
to DECIMAL(38,0) before the one division, so no intermediate value is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
WIDE = "decimal(38,0)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _factor(f) -> Column:
    return F.lit(f).cast("bigint") if isinstance(f, int) else col(f)


def wide(*factors) -> Column:
    """Product of integer factors as DECIMAL(38,0).

    The product is taken in BIGINT and only recomputed in DECIMAL where that overflows.
    """
    exact, quick = None, None
    for f in factors:
        c = _factor(f)
        exact = c.cast(WIDE) if exact is None else (exact * c.cast(WIDE)).cast(WIDE)
        quick = c if quick is None else F.try_multiply(quick, c)
    return exact if len(factors) == 1 else F.coalesce(quick.cast(WIDE), exact)


def idiv(n, d) -> Column:
    """Integer quotient (exact when d divides n), BIGINT."""
    return F.call_function("div", col(n), col(d))


def floor_div(n, d) -> Column:
    """Floor division, also for negative numerators; BIGINT."""
    n, d = col(n), col(d)
    return idiv(n - F.pmod(n, d), d)


def half_even(n, d) -> Column:
    """Nearest integer to n/d, ties to even; d > 0.

    The half-up quotient, less one where it is odd and the division is an exact tie.
    """
    n, d = wide(n), wide(d)

    def nearest(n, d, t):
        a, b = (n + n + d).cast(t), (d + d).cast(t)
        m = F.pmod(a, b)
        q = idiv((a - m).cast(t), b)
        return q - ((m == 0) & (F.pmod(q, F.lit(2)) == 1)).cast("bigint")

    # almost every value fits BIGINT, where the arithmetic is several times cheaper
    small, limit = [x.try_cast("bigint") for x in (n, d)], F.lit(2**60).cast("bigint")
    fits = (small[0] < limit) & (small[0] > -limit) & (small[1] < limit)
    return F.when(fits, nearest(*small, "bigint")).otherwise(nearest(n, d, WIDE))


def half_up(n, d) -> Column:
    """Nearest integer to n/d, ties away from zero; d > 0."""
    n, d = wide(n), wide(d)
    a = F.abs(n)
    q = idiv((a + a + d).cast(WIDE), (d + d).cast(WIDE))
    return F.when(n < 0, -q).otherwise(q).cast("bigint")


def overlap_us(a_start, a_end, b_start, b_end) -> Column:
    """Length of the intersection of two spans, 0 when they only touch."""
    return F.greatest(
        F.lit(0).cast("bigint"),
        F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)),
    )


def span_frames(start, end, fps_num, fps_den, speed_num=1, speed_den=1) -> Column:
    """Output frames of a source span: half-even((end-start) * fps / speed)."""
    return half_even(
        wide(col(end) - col(start), fps_num, speed_den), wide(US, fps_den, speed_num)
    )


def frames_to_us(frames, fps_num, fps_den) -> Column:
    """Frame boundary on the microsecond grid (half-even)."""
    return half_even(wide(frames, US, fps_den), col(fps_num))


def clock_text(ms) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    ms = col(ms)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        idiv(ms, F.lit(3_600_000)),
        F.pmod(idiv(ms, F.lit(60_000)), F.lit(60)),
        F.pmod(idiv(ms, F.lit(1000)), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )


def us_to_ms(us, rule: str = "even") -> Column:
    """Microseconds to milliseconds; ``rule`` is ``even`` or ``up``."""
    return (half_even if rule == "even" else half_up)(us, F.lit(1000))
