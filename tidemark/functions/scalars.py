"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import CLIP, UNKNOWN_GROUP


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def logit(score: Column) -> Column:
    """Log-odds of a score clipped away from 0 and 1."""
    p = F.least(F.greatest(score, F.lit(CLIP)), F.lit(1.0 - CLIP))
    return F.ln(p / (F.lit(1.0) - p))


def inverse_logit(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def recorded(value: Column) -> Column:
    """Trimmed text, or null for null, blank and ``?``."""
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (text != "?"), text)


def group_label(value: Column) -> Column:
    return F.coalesce(recorded(value), F.lit(UNKNOWN_GROUP))


def attempts_band(value: Column) -> Column:
    """0, 1, or "2 or more"; negative counts are an error."""
    text = recorded(value)
    number = text.cast("int")
    return (
        F.when(text.isNull(), F.lit(UNKNOWN_GROUP))
        .when(number < 0, F.raise_error(F.lit("negative attempt count")).cast("string"))
        .when(number <= 1, number.cast("string"))
        .otherwise(F.lit("2 or more"))
    )


def bound_text(value: Column) -> Column:
    """Up to six significant digits without trailing zeros."""
    magnitude = F.when(
        F.abs(value) >= 1, F.floor(F.log10(F.abs(value))) + 1
    ).otherwise(F.lit(1))
    digits = F.greatest(F.lit(6) - magnitude, F.lit(0)).cast("int")
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    rounded = F.round(value * scale) / scale
    plain = F.format_string("%.6f", rounded)
    return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "\\.$", "")


def credit_band(value: Column, bounds: Column) -> Column:
    """Text band of ``value`` against an ascending, distinct array of bounds."""
    text = recorded(value)
    number = text.cast("double")
    above = F.filter(bounds, lambda b: b >= number)
    below = F.filter(bounds, lambda b: b < number)
    lower = F.try_element_at(below, F.lit(-1))
    upper = F.try_element_at(above, F.lit(1))
    return (
        F.when(text.isNull(), F.lit(UNKNOWN_GROUP))
        .when(bounds.isNull() | (F.size(bounds) == 0), F.lit("All recorded credits"))
        .when(upper.isNull(), F.concat(F.lit("credits > "), bound_text(lower)))
        .when(lower.isNull(), F.concat(F.lit("credits <= "), bound_text(upper)))
        .otherwise(
            F.concat(bound_text(lower), F.lit(" < credits <= "), bound_text(upper))
        )
    )


def binary_target(value: Column) -> Column:
    """1/0 from ``true``/``1``/``false``/``0`` text; anything else is an error."""
    text = F.lower(F.trim(value.cast("string")))
    return (
        F.when(text.isin("true", "1"), F.lit(1))
        .when(text.isin("false", "0"), F.lit(0))
        .otherwise(
            F.raise_error(F.concat(F.lit("invalid target: "), F.coalesce(text, F.lit("null")))).cast("int")
        )
    )


def flag_text(value: Column) -> Column:
    """Boolean from text; only 1/true/yes are true."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def optional_int(value: Column) -> Column:
    """Integer from text such as ``17.0``; blank and None markers become null."""
    text = F.trim(value.cast("string"))
    return F.when(~text.isin("", "None", "null"), text.cast("double").cast("long"))


def decision(score: Column, threshold: Column | float) -> Column:
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= cut).cast("int")


def fixed_rule(gap: Column, change: Column, active_days: Column) -> Column:
    """Warn on a gap of 7+ days, or a drop of 50 %+ with at most 2 active days."""
    return F.coalesce((gap >= 7), F.lit(False)).cast("int").bitwiseOR(
        F.coalesce((change <= -50) & (active_days <= 2), F.lit(False)).cast("int")
    )


def holdout_id(*parts: str) -> Column:
    return F.concat_ws("_", *[F.col(p) for p in parts])


def hash_int(*parts: Column) -> Column:
    """Non-negative 60-bit integer from md5, equal in every SQL engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_bucket(*parts: Column) -> Column:
    """Three leading hex digits of md5: at most 4,096 even buckets."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.substring(F.md5(text), 1, 3)


def reason_list(*reasons: Column) -> Column:
    """Ordered, de-duplicated reasons joined by ``|``; null when there are none."""
    found = F.array_distinct(F.array_compact(F.array(*reasons)))
    return F.when(F.size(found) > 0, F.array_join(found, "|"))
