"""Column functions: parsing, labelling, grading and naming. All stay inside Catalyst."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapework import schemas as S


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def inf_to_null(value: Column) -> Column:
    return F.when(finite(value), value)


def numeric_or_zero(value: Column) -> Column:
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))


# Other ways in which times are written, month before day where both are numbers.
TIME_FORMATS = ("yyyyMMdd HHmmss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy",
                "MMM d yyyy HH:mm:ss", "MMM d yyyy HH:mm", "MMM d yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z",
                "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy")


#: What each part of such a format looks like.
_LOOKS = {"yyyy": r"\d{4}", "MMM": "[A-Za-z]{3,}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "M": r"\d{1,2}",
          "d": r"\d{1,2}", "Z": r"[+-]\d{4}", "z": "[A-Za-z].*"}


def _shape(form: str) -> str:
    """Pattern of the texts that a format could read."""
    return "^" + re.sub("yyyy|MMM|MM|dd|HH|mm|ss|M|d|Z|z", lambda m: _LOOKS[m[0]], form) + "$"


def parse_timestamp(text: Column) -> Column:
    """Tolerant UTC parse: a trailing Z, an offset, or no zone (UTC); then other common ways to write
    a time (month names, slashes, mail headers, digits only). A time without a day and junk give NULL.
    A format is tried only on texts of its shape, because a failed attempt costs far more than a pattern.
    """
    cleaned = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    spelled = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *(?=[0-9])", ""), ", *| +", " ")

    def other(value: Column) -> Column:
        out = F.lit(None).cast("timestamp")
        for form in reversed(TIME_FORMATS):
            out = F.when(value.rlike(_shape(form)), F.try_to_timestamp(value, F.lit(form))).otherwise(out)
        return out

    # In a function of an array of one, the text is spelled once and not in every branch's code.
    others = F.transform(F.array(spelled), other)[0]
    return (F.when(cleaned.rlike(r"^\d{8}$"), F.try_to_timestamp(cleaned, F.lit("yyyyMMdd")))
            .when(cleaned.rlike(r"^T?\d{1,2}:\d{2}"), F.lit(None).cast("timestamp"))
            .otherwise(F.coalesce(cleaned.try_cast("timestamp"), others)))


def epoch_millis(text: Column) -> Column:
    """Milliseconds of a chart time: date-only is UTC midnight, a missing zone means UTC."""
    value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(
        F.when(text.contains("T"), text).otherwise(F.regexp_replace(text, "^([^ ]*) ", "$1T")))
    timed = value.rlike(r"T\d{2}:\d{2}")
    zoned = value.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    return F.unix_millis(parse_timestamp(F.when(timed & ~zoned, F.concat(value, F.lit("Z"))).otherwise(value)))


def same_ticker(left: Column, right: Column) -> Column:
    return F.upper(F.trim(left)) == F.upper(F.trim(right))


def topic_name(prefix: Column, ticker: Column) -> Column:
    return F.concat_ws("_", prefix, F.lower(F.replace(ticker, F.lit("="), F.lit(""))))


def topic_partition(key: Column, partitions: int = 16) -> Column:
    return (F.crc32(key.cast("binary")) % partitions).cast("int")


def direction_label(prediction: Column, band: float = 0.0001) -> Column:
    return F.when(prediction > band, "UP").when(prediction < -band, "DOWN").otherwise("SIDEWAYS")


def confidence(log_return: Column) -> Column:
    return F.greatest(F.lit(10.0), F.least(F.lit(95.0), F.abs(log_return) * 10000))


def grade_model(ic: Column, dir_acc: Column, sharpe: Column) -> Column:
    """Five grades; every limit is strict and a missing value fails it."""
    # Fixed values: (grade, ic, directional accuracy, sharpe).
    limits = (("Exceptional", 0.04, 0.53, 1.5), ("Strong", 0.03, 0.52, 1.0),
              ("Acceptable", 0.02, 0.51, 0.5), ("Marginal", 0.01, 0.50, 0.0))
    grade = F
    for name, i, d, s in limits:
        grade = grade.when((ic > i) & (dir_acc > d) & (sharpe > s), name)
    return grade.otherwise("Weak")


def grade_regression(r2: Column, mape: Column) -> Column:
    # Fixed values: (grade, R2 above, MAPE below).
    limits = (("Excellent", 0.7, 5.0), ("Good", 0.5, 10.0), ("Moderate", 0.3, 15.0))
    grade = F
    for name, r, m in limits:
        grade = grade.when((r2 > r) & (mape < m), name)
    return grade.otherwise("Poor")


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed mapping (NULL when absent), as a literal map."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def display_name(ticker: Column, names: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(ticker, names or S.DISPLAY_NAMES), ticker)


def interval_type(interval: Column) -> Column:
    ends = lambda s: interval.endswith(s)
    return (F.when(ends("m"), "minute").when(ends("h"), "hour").when(ends("d"), "day")
            .when(ends("wk"), "week").when(ends("mo"), "month").otherwise("unknown"))


def intervals_compatible(left: Column, right: Column) -> Column:
    """Same candle type; an unknown or missing interval passes."""
    a, b = F.coalesce(interval_type(left), F.lit("unknown")), F.coalesce(interval_type(right), F.lit("unknown"))
    return (a == "unknown") | (b == "unknown") | (a == b)


def partition_key(period: Column, interval: Column) -> Column:
    return F.concat_ws("_", period, interval)


def partition_interval(key: Column) -> Column:
    """Interval part of ``period_interval``; NULL without a separator."""
    return F.when(key.contains("_"), F.regexp_replace(key, "^[^_]*_", ""))


def fetch_period(period: Column) -> Column:
    return F.coalesce(lookup(period, {k: v[0] for k, v in S.PERIOD_CONFIG.items()}), period)


def fetch_interval(period: Column, interval: Column) -> Column:
    default = lookup(period, {k: v[1] for k, v in S.PERIOD_CONFIG.items()})
    return F.coalesce(F.nullif(interval, F.lit("")), default, F.lit("1d"))


def max_points(period: Column, interval: Column) -> Column:
    """Points kept for a chart of this period and interval."""
    p, i = F.lower(F.coalesce(period, F.lit(""))), F.lower(F.coalesce(interval, F.lit("")))
    minutes = lookup(p, S.PERIOD_MINUTES)
    step = F.regexp_extract(i, r"^(\d+)", 1).try_cast("int")
    step = F.when(step > 0, step).otherwise(1)
    capped = lambda n: F.least(F.lit(S.MAX_POINTS), F.ceil(minutes / n).cast("int"))
    return (
        F.when(i.endswith("m"), F.when(minutes.isNotNull(), capped(step)).otherwise(S.DEFAULT_POINTS))
        .when(i == "tick", S.DEFAULT_POINTS)
        .when(i.endswith("h"), F.when(minutes.isNotNull(), capped(60)).otherwise(S.DEFAULT_POINTS))
        .otherwise(F.coalesce(lookup(p, S.DAILY_POINTS), F.lit(S.DEFAULT_POINTS)))
    )


def ticker_matches(text: str, symbol: Column, name: Column) -> Column:
    needle = F.lit(text.lower())
    return F.contains(F.lower(symbol), needle) | F.contains(F.lower(name), needle)
