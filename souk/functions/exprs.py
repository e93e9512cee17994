"""Column helpers shared by the cleaning layer and the marts.

All helpers return built-in Spark expressions (no Python UDF), so they stay
inside whole-stage codegen. They encode the few semantics that are easy to
get silently wrong:

* text dates become ``TIMESTAMP_NTZ``: the source text carries no zone, so
  durations never shift with the session time zone or daylight saving;
* a bad or empty date gives NULL instead of an error under ANSI mode;
* delay in days is elapsed time truncated toward zero (23 h late is 0,
  25 h early is -1), not a calendar-day difference;
* on-time compares exact instants, independently of the delay;
* money is summed exactly in whole millionths, so totals and averages do
  not depend on how rows are split across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400

# Money is summed in whole millionths of a unit, so sums are exact and do not
# depend on partitioning or task order. An amount beyond 9.2e12 units raises
# (64 bits); the sums are decimals and hold any number of such amounts.
UNITS = 1_000_000.0
# Fixed-point type for exact sums of doubles (coordinates, rounded means):
# 14 decimals, 24 integer digits.
FIXED_TYPE = "decimal(38,14)"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c: Column | str) -> Column:
    """Text date -> TIMESTAMP_NTZ; unparsable or empty text -> NULL."""
    return col_(c).try_cast("timestamp_ntz")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from ``start`` to ``end`` (negative if end is earlier),
    truncated toward zero.

    The difference of two ``TIMESTAMP_NTZ`` values is a day-time interval
    computed without any time zone; casting it to bigint gives its seconds.
    (``timestampdiff`` would go through the session zone first.)
    """
    return (col_(end) - col_(start)).cast("long")


def delay_days(has_delivery: Column | str, delivered_ts: Column | str,
               estimated_ts: Column | str) -> Column:
    """Days late (+) or early (-), truncated toward zero; NULL when not delivered.

    ``has_delivery`` is the NULL test on the raw delivery text; an
    unparsable date on either side also gives NULL (the difference is NULL).
    """
    secs = seconds_between(estimated_ts, delivered_ts)
    # Casting a double to int truncates toward zero: -1.04 -> -1, 0.96 -> 0.
    return F.when(col_(has_delivery), (secs / F.lit(SECONDS_PER_DAY)).cast("int"))


def duration_days(has_delivery: Column | str, delivered_ts: Column | str,
                  purchased_ts: Column | str) -> Column:
    """Fractional days from purchase to delivery; NULL when not delivered."""
    secs = seconds_between(purchased_ts, delivered_ts)
    return F.when(col_(has_delivery), secs.cast("double") / F.lit(float(SECONDS_PER_DAY)))


def on_time_flag(has_delivery: Column | str, delivered_ts: Column | str,
                 estimated_ts: Column | str) -> Column:
    """1 if delivered at or before the estimate, 0 otherwise, NULL if not delivered.

    An unknown comparison (estimate missing, or delivered text that does not
    parse) falls to 0, as a searched CASE's ELSE arm does.
    """
    return (F.when(~col_(has_delivery), F.lit(None).cast("int"))
            .when(col_(delivered_ts) <= col_(estimated_ts), F.lit(1))
            .otherwise(F.lit(0)))


def has_text(c: Column | str) -> Column:
    """1 if the text is present and not only spaces (TRIM strips spaces only)."""
    c = col_(c)
    return F.when(c.isNotNull() & (F.trim(c) != F.lit("")), F.lit(1)).otherwise(F.lit(0))


def money_units(c: Column | str) -> Column:
    """A money amount in whole millionths (nearest), ready for an exact sum."""
    return F.rint(col_(c) * F.lit(UNITS)).cast("long").cast("decimal(19,0)")


def from_units(total: Column) -> Column:
    """Millionths -> currency units as a double."""
    return total.cast("double") / F.lit(UNITS)


def money_sum(c: Column | str) -> Column:
    """Exact total of a money column, returned as double."""
    return from_units(F.sum(money_units(c)))


def money_mean(c: Column | str) -> Column:
    """Mean of a money column over its non-NULL values, from an exact sum."""
    return from_units(F.sum(money_units(c))) / F.nullif(F.count(col_(c)), F.lit(0))


def rounded_fraction(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` of whole numbers, rounded half away from zero, as a double.

    The fraction is never formed in floating point: whole decimals are divided
    once, and the whole number of units of the last digit becomes a double at the
    end. ``2 * 10^digits * num`` must fit 38 digits; a zero ``den`` gives NULL.
    """
    unit = 10 ** digits
    num, den = num.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    over, under = F.abs(num) * F.lit(2 * unit) + F.abs(den), F.nullif(F.abs(den) * F.lit(2), F.lit(0))
    size = (over - over % under) / under   # whole, and ``div`` would wrap beyond 64 bits
    return size.cast("double") * (F.signum(num) * F.signum(den)) / F.lit(float(unit))


def rounded_mean(total_units: Column, n: Column, digits: int = 2) -> Column:
    """Mean of ``n`` money amounts that add up to ``total_units`` millionths."""
    return rounded_fraction(total_units, n.cast("decimal(20,0)") * F.lit(int(UNITS)), digits)


def fixed_sums(c: Column | str, fixed_type: str = FIXED_TYPE) -> tuple[Column, Column, Column]:
    """Aggregates of a double column: exact fixed-point sum of what fits the
    type, sum of what does not (Infinity, NaN, 1e24 and more), non-NULL count."""
    c = col_(c)
    fits = F.abs(c) < F.lit(1e24)
    return (F.sum(F.when(fits, c).cast(fixed_type)), F.sum(F.when(~fits, c)), F.count(c))


def fixed_mean(exact: Column, beyond: Column, n: Column) -> Column:
    """Mean from ``fixed_sums``; values that do not fit decide it alone."""
    return F.coalesce(beyond, exact.cast("double")) / F.nullif(n, F.lit(0))


def exact_mean(c: Column | str, fixed_type: str = FIXED_TYPE) -> Column:
    """Mean of a double column from an exact fixed-point sum.

    Unlike ``avg(double)`` the result does not depend on the order in which
    partial sums are combined, so reruns on a different cluster agree.
    """
    return fixed_mean(*fixed_sums(c, fixed_type))


def mean_days_from_seconds(secs: Column | str) -> Column:
    """Mean of a duration in days, computed from an exact sum of seconds."""
    return (F.sum(col_(secs)).cast("double") / F.nullif(F.count(col_(secs)), F.lit(0))
            / F.lit(float(SECONDS_PER_DAY)))


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double (never a decimal)."""
    return F.lit(100.0) * part.cast("double") / F.nullif(whole, F.lit(0))


Bucket = tuple[int | None, int | None, str]


def bucket_order(c: Column | str, buckets: Sequence[Bucket]) -> Column:
    """1-based index of the first bucket whose inclusive range holds the value.

    ``buckets`` is a list of ``(low, high, label)``; ``None`` leaves a side
    open. The last entry is the ELSE arm and catches everything else,
    NULL included, exactly like a searched CASE.
    """
    c = col_(c)
    expr = None
    for i, (lo, hi, _label) in enumerate(buckets[:-1], start=1):
        if lo is None and hi is None:
            raise ValueError("only the last bucket may be open on both sides")
        if lo is None:
            cond = c <= F.lit(hi)
        elif hi is None:
            cond = c >= F.lit(lo)
        elif lo == hi:
            cond = c == F.lit(lo)
        else:
            cond = c.between(lo, hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    last = F.lit(len(buckets))
    return last if expr is None else expr.otherwise(last)


def bucket_label(order: Column | str, buckets: Sequence[Bucket]) -> Column:
    """Label of the bucket index produced by :func:`bucket_order`."""
    order = col_(order)
    expr = None
    for i, (_lo, _hi, label) in enumerate(buckets, start=1):
        cond = order == F.lit(i)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr
