"""Column expressions (survey §2.9, X-keys, and the KPI formulas M01–M03).

Every function takes and returns ``Column`` objects built from ``pyspark.sql.functions``:
they stay inside whole-stage codegen, run on executors and never call back into Python.
Each has a table-level key (``operators/expressions.py``) that checks it against DuckDB.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------------
# Null-equivalent strings used when cleaning exports (exact match, no trim).
NULL_EQUIVALENTS = ["Unknown", "unknown", "N/A", "n/a", "NA", "none", "None", "", " "]
# The wider set used by the quality checks (matched after trimming).
NULLISH = ["", " ", "N/A", "n/a", "NA", "none", "None", "Unknown", "unknown", "NULL", "null"]
# Format patterns of the quality checks.
HMS_PATTERN = r"^\d+:\d{2}:\d{2}$"
MONTH_LABEL_PATTERN = r"^[A-Za-z]{3},\s*\d{4}$"
# Loose boolean words (detail mart) and strict words (incremental ingest).
TRUE_WORDS = ["yes", "true", "1"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------------
# Rounding: half-up through the same double formula DuckDB runs (floor(x*10^d+0.5)/10^d)
# ---------------------------------------------------------------------------------
def round_half_up(c, d: int) -> Column:
    k = float(10**d)
    return (F.floor(_c(c) * F.lit(k) + F.lit(0.5)) / F.lit(k)).cast("double")


def round_sql(expr: str, d: int) -> str:
    k = float(10**d)
    return f"CAST(floor(({expr}) * {k} + 0.5) / {k} AS DOUBLE)"


# ---------------------------------------------------------------------------------
# Durations
# ---------------------------------------------------------------------------------
def _hms_parts(c):
    parts = F.split(F.trim(_c(c)), ":")
    n = F.size(parts)

    def part(i):
        return F.try_element_at(parts, F.lit(i)).try_cast("double")

    return parts, n, part


def hms_to_minutes(c) -> Column:
    """X01: 'h:mm:ss' or 'mm:ss' → minutes (4 dp); null, blank or malformed → 0.0."""
    _, n, part = _hms_parts(c)
    three = part(1) * 60 + part(2) + part(3) / 60
    two = part(1) + part(2) / 60
    v = F.when(n == 3, three).when(n == 2, two)
    return F.coalesce(round_half_up(v, 4), F.lit(0.0))


def hms_to_seconds(c) -> Column:
    """Three parts only → integer seconds; anything else → 0."""
    parts = F.split(F.trim(_c(c)), ":")
    h, m, s = (F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3))
    v = F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)
    return F.coalesce(v, F.lit(0)).cast("bigint")


def hms_to_hours(c) -> Column:
    """Three or two parts → hours (unrounded double); malformed → 0.0."""
    _, n, part = _hms_parts(c)
    v = F.when(n == 3, part(1) + part(2) / 60 + part(3) / 3600).when(n == 2, part(1) / 60 + part(2) / 3600)
    return F.coalesce(v, F.lit(0.0))


def secs_to_hours(c, d: int = 2) -> Column:
    """Seconds → hours rounded to ``d`` dp."""
    return round_half_up(_c(c) / F.lit(3600.0), d)


def secs_to_minutes(c) -> Column:
    return (_c(c) / F.lit(60.0)).cast("double")


def format_duration(c) -> Column:
    """Seconds → 'Hh Mm' (or 'Mm' under an hour)."""
    secs = _c(c).cast("bigint")
    h = F.floor(secs / 3600).cast("bigint")
    m = F.floor(F.pmod(secs, F.lit(3600)) / 60).cast("bigint")
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def format_hours(c) -> Column:
    """X05 variant: seconds → 'x.xh'."""
    return F.concat(F.format_number(_c(c) / F.lit(3600.0), 1), F.lit("h"))


# ---------------------------------------------------------------------------------
# Month labels and dates
# ---------------------------------------------------------------------------------
def month_label(ts) -> Column:
    return F.date_format(_c(ts), "MMM, yyyy")


def parse_month_label(c) -> Column:
    """X06/X22: 'Apr, 2025' → first day of that month (null when malformed)."""
    return F.try_to_timestamp(F.trim(_c(c)), F.lit("MMM, yyyy")).cast("date")


def month_number(c) -> Column:
    return F.coalesce(F.month(parse_month_label(c)), F.lit(0))


def year_of_label(c) -> Column:
    return F.coalesce(F.year(parse_month_label(c)), F.lit(0))


def sort_key_yyyymm(c) -> Column:
    """year*100+month, 0 when the label is malformed."""
    return year_of_label(c) * 100 + month_number(c)


def month_label_display(c) -> Column:
    """Drop the comma ('Apr, 2025' → 'Apr 2025')."""
    return F.regexp_replace(_c(c), ",", "")


def quarter_of_month(m) -> Column:
    """(m − 1) // 3 + 1."""
    return (F.floor((_c(m) - 1) / 3) + 1).cast("int")


def date_bucket(ts, granularity: str, week_start: str = "monday") -> Column:
    """Day / week-start / month key as 'yyyy-MM-dd' text.

    Spark weeks start on Monday; ``week_start='sunday'`` shifts by one day.
    """
    t = _c(ts)
    if granularity == "day":
        d = F.to_date(t)
    elif granularity == "week":
        if week_start == "sunday":
            d = F.date_sub(F.date_trunc("week", F.date_add(F.to_date(t), 1)).cast("date"), 1)
        else:
            d = F.date_trunc("week", t).cast("date")
    elif granularity == "month":
        d = F.date_trunc("month", t).cast("date")
    else:
        raise ValueError(granularity)
    return F.date_format(d, "yyyy-MM-dd")


def now_iso_utc() -> Column:
    """Current time as ISO-8601 text with a 'Z' suffix (session time zone is UTC)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# ---------------------------------------------------------------------------------
# Booleans and null-equivalents
# ---------------------------------------------------------------------------------
def bool_from_text_loose(c) -> Column:
    """X11: trimmed lower text in {yes,true,1} → true, anything else (null included) → false."""
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin(TRUE_WORDS), F.lit(False))


def bool_from_text_strict(c) -> Column:
    """Upper YES → true, NO → false, else null."""
    u = F.upper(_c(c))
    return F.when(u == "YES", True).when(u == "NO", False)


def is_nullish(c) -> Column:
    """Null, or trimmed text in the null-equivalent set (each row counted once)."""
    return _c(c).isNull() | F.trim(_c(c).cast("string")).isin(NULLISH)


def null_equivalent_to_null(c) -> Column:
    """Exact null-equivalent strings → null."""
    return F.when(~_c(c).isin(NULL_EQUIVALENTS), _c(c))


def status_label(c) -> Column:
    """Boolean → 'Published' / 'Not Published', null → 'Unknown'."""
    return F.when(_c(c), "Published").when(~_c(c), "Not Published").otherwise("Unknown")


# ---------------------------------------------------------------------------------
# Ratios and KPI arithmetic
# ---------------------------------------------------------------------------------
def safe_ratio_pct(a, b) -> Column:
    """X14 unrounded: a*100/b, null when b is 0 or null."""
    return (_c(a).cast("double") * F.lit(100.0)) / F.nullif(_c(b).cast("double"), F.lit(0.0))


def safe_ratio(a, b) -> Column:
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def safe_ratio_floor(a, b, floor: float = 1.0) -> Column:
    """A / greatest(b, floor)."""
    return _c(a).cast("double") / F.greatest(_c(b).cast("double"), F.lit(float(floor)))


def publish_rate(published, created) -> Column:
    """M01."""
    return safe_ratio_pct(published, created)


def multiplication_ratio(created, uploaded) -> Column:
    """M02."""
    return safe_ratio(created, uploaded)


def unpublished_gap(created, published) -> Column:
    """M03."""
    return (_c(created) - _c(published)).cast("bigint")


def clip_floor_zero(c) -> Column:
    """max(0, c)."""
    return F.greatest(_c(c), F.lit(0))


def growth_pct(cur, prev, zero_rule: str = "null") -> Column:
    """(cur − prev)/prev·100; when prev = 0 → null | 0 | (100 if cur>0 else 0)."""
    g = (_c(cur).cast("double") - _c(prev).cast("double")) * F.lit(100.0) / F.nullif(_c(prev).cast("double"), F.lit(0.0))
    if zero_rule == "null":
        return g
    if zero_rule == "zero":
        return F.when(_c(prev) == 0, F.lit(0.0)).otherwise(g)
    if zero_rule == "hundred":
        return F.when(_c(prev) == 0, F.when(_c(cur) > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(g)
    raise ValueError(zero_rule)


def composite_score(rate, waste, mult) -> Column:
    """0.4·rate + 0.3·(100 − waste) + 0.3·min(mult·20, 100)."""
    return (
        F.lit(0.4) * _c(rate)
        + F.lit(0.3) * (F.lit(100.0) - _c(waste))
        + F.lit(0.3) * F.least(_c(mult) * F.lit(20.0), F.lit(100.0))
    )


def percent_of_total(n, total, d: int = 1) -> Column:
    """n/total·100 rounded to d dp; 0 when total is 0."""
    return F.when(_c(total) == 0, F.lit(0.0)).otherwise(round_half_up(_c(n) * F.lit(100.0) / _c(total), d))


def severity(c, high: float, medium: float, higher_is_worse: bool = True) -> Column:
    """Threshold → high / medium / info."""
    v = _c(c)
    if higher_is_worse:
        return F.when(v > high, "high").when(v > medium, "medium").otherwise("info")
    return F.when(v < high, "high").when(v < medium, "medium").otherwise("info")


def horizontal_sum(cols) -> Column:
    """Sum of several columns within one row (nulls count as 0)."""
    return reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def like_prefix(c, prefix: str) -> Column:
    """X20."""
    return _c(c).like(prefix + "%")


def contains_ci(c, term: str) -> Column:
    """Case-insensitive literal substring, null → false."""
    return F.coalesce(F.lower(_c(c)).contains(term.lower()), F.lit(False))


def ieq(c, value: str) -> Column:
    """case-insensitive equality."""
    return F.lower(_c(c)) == F.lit(value.lower())


# ---------------------------------------------------------------------------------
# One-row aggregates attached to every row (scalar subqueries, not joins)
# ---------------------------------------------------------------------------------
def with_scalars(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Append the columns of one-row aggregates (totals, maxima, statistics) to every row of
    ``df``. Each aggregate is a scalar subquery: it runs once and its values are inlined as
    constants into ``df``'s plan — no join, no pairing of rows. A frame with more than one row
    fails the query (Spark's scalar-subquery check), so the one-row bound is enforced."""
    cols = []
    for o in one_row:
        s = o.select(F.struct(*[F.col(f"`{c}`") for c in o.columns]).alias("_s")).scalar()
        cols += [s[c].alias(c) for c in o.columns]
    return df.select("*", *cols)
