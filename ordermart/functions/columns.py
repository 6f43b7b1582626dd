"""Column expressions with the reference's numeric and calendar semantics.

Everything here returns a ``Column`` built from built-in functions, so it
stays inside whole-stage codegen; nothing is a Python UDF.

Semantics that are easy to get wrong (see SURVEY §1.4):

* whole days between two timestamps **floor** (−12 h is −1 day), unlike
  ``datediff`` (calendar days) or ``timestampdiff(DAY)`` (truncation);
* averages are rounded half away from zero, percentages once, from exact
  counts; both come as ``double``;
* Pearson correlation is null, not an error, on constant input;
* day of week is 0 = Sunday .. 6 = Saturday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

MICROS_PER_DAY = 86_400_000_000

# Fixed values (labels of the reference's delay classification).
DELAYED = "Delayed"
ON_TIME = "On Time"
BUCKET_LABELS = (
    "On Time",
    "1-3 Days Late",
    "4-7 Days Late",
    "8-14 Days Late",
    "15+ Days Late",
)


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wall_micros(ts: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zone-less wall-clock timestamp.

    Built from date and time-of-day parts, which are zone-free for
    ``timestamp_ntz``; ``timestamp_diff`` / ``unix_micros`` would first cast
    to a zoned timestamp in the session zone, so a DST change could move a
    difference by an hour.
    """
    t = _col(ts)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.date_part(F.lit("SECOND"), t)  # decimal(8,6): seconds with fraction
    return (
        days * F.lit(MICROS_PER_DAY)
        + (F.hour(t) * 3600 + F.minute(t) * 60).cast("bigint") * F.lit(1_000_000)
        + (seconds * 1_000_000).cast("bigint")
    )


def whole_days(end: ColumnOrName, start: ColumnOrName) -> Column:
    """floor((end - start) / 1 day) as bigint; null if either side is null."""
    micros = wall_micros(end) - wall_micros(start)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def dp(x: ColumnOrName, nd: int = 2) -> Column:
    """Round half away from zero to ``nd`` places, on the decimal that the
    number is printed as. Beyond 1e25 a double has no such places: unchanged."""
    x = _col(x).cast("double")
    near = F.abs(x) < F.lit(1e25)
    return F.when(near, F.round(F.when(near, x).cast("decimal(38,12)"), nd).cast("double")).otherwise(x)


def pct(num: ColumnOrName, den: ColumnOrName, nd: int = 2) -> Column:
    """``round(num * 100 / den, nd)`` of two counts; null when den = 0. One
    rounding, in whole numbers: floor((2 num 100 10^nd + den) / (2 den))."""
    n, d = _col(num).cast("decimal(19,0)"), F.nullif(_col(den).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    scale = 10**nd
    twice = F.abs(n) * F.lit(200 * scale).cast("decimal(9,0)") + d
    shares = twice - twice % (2 * d)  # a whole multiple of the divisor: no digits are lost below
    return (F.signum(n.cast("double")) * (shares / (2 * d)).cast("double")) / F.lit(float(scale))


def safe_corr(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Pearson correlation that is null on constant input or a single row.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode when a variance is zero,
    and a CASE guard around it does not help because aggregates are computed
    first; the covariance form divides by ``nullif(…, 0)`` instead.
    """
    x, y = _col(x).cast("double"), _col(y).cast("double")
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(den, F.lit(0.0))


def is_late(delay: ColumnOrName) -> Column:
    """A delivery is late when its delay in whole days is positive."""
    return _col(delay) > 0


def status_label(delay: ColumnOrName) -> Column:
    """'Delayed' when late, otherwise 'On Time' (null delay is 'On Time')."""
    return F.when(is_late(delay), F.lit(DELAYED)).otherwise(F.lit(ON_TIME))


def severity_bucket(delay: ColumnOrName) -> Column:
    """Five ordered buckets; first match wins, anything else is '15+'.

    Bounds are inclusive integers, so a fractional 3.5 falls through to the
    last bucket exactly as the reference's BETWEEN chain does.
    """
    d = _col(delay)
    return (
        F.when(d <= 0, F.lit(BUCKET_LABELS[0]))
        .when(d.between(1, 3), F.lit(BUCKET_LABELS[1]))
        .when(d.between(4, 7), F.lit(BUCKET_LABELS[2]))
        .when(d.between(8, 14), F.lit(BUCKET_LABELS[3]))
        .otherwise(F.lit(BUCKET_LABELS[4]))
    )


def day_of_week(ts: ColumnOrName) -> Column:
    """0 = Sunday .. 6 = Saturday, as bigint (PostgreSQL ``EXTRACT(DOW)``)."""
    return (F.dayofweek(_col(ts)) - 1).cast("bigint")


DATE_UNITS = ("year", "quarter", "month", "week")


def trunc_ts(unit: str, ts: ColumnOrName) -> Column:
    """``date_trunc`` for zone-less timestamps, returning ``timestamp_ntz``.

    Weeks start on Monday. Day and coarser units truncate the date part
    (zone-free); finer units fall back to ``date_trunc``, which goes through
    the session zone (keep the session in UTC for those).
    """
    u = unit.lower()
    if u == "day":
        return F.to_date(_col(ts)).cast("timestamp_ntz")
    if u in DATE_UNITS:
        return F.trunc(F.to_date(_col(ts)), u).cast("timestamp_ntz")
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")
