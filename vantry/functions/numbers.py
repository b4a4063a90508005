"""Numeric parsing, banding and robust statistics expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import drop_na_words

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PERCENT = r"^([0-9]+(?:\.[0-9]+)?)\s*/\s*100$"


def number(t: Column) -> Column:
    """Plain decimal text (already trimmed) to double, else NULL."""
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def port(t: Column, low: int = 1) -> Column:
    """Whole number in ``low``..65535, else NULL (``443.0`` counts as whole)."""
    n = number(t)  # tested before the cast, as a failing cast costs an exception a row
    return F.when((n == F.floor(n)) & n.between(low, 65535), n.cast("int"))


def status_of(raw: Column, parsed: Column) -> Column:
    """``missing`` / ``valid`` / ``invalid`` for a raw value and its parse."""
    return F.when(raw.isNull(), "missing").when(parsed.isNotNull(), "valid").otherwise("invalid")


def port_status(t: Column, low: int = 1) -> Column:
    return status_of(t, port(t, low))


def byte_size(t: Column, allow_negative: bool = False) -> Column:
    """``2048``, ``20.5 KB``, ``1 GB`` (already trimmed) to bytes, binary multiples."""
    value = number(t)
    plain = value if allow_negative else F.when(value >= 0, value)
    pattern = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(B|KB|MB|GB)$"
    amount = F.regexp_extract(t, pattern, 1).try_cast("double")
    factors = F.create_map(*[F.lit(x) for name, size in fv.BYTE_UNITS.items() for x in (name, float(size))])
    # only a text that ends like a unit is matched against the pattern
    sized = F.when(F.lower(F.right(t, F.lit(1))) == "b", amount * F.try_element_at(factors, F.upper(F.regexp_extract(t, pattern, 2))))
    return F.coalesce(plain, sized)


def with_risk(df: DataFrame, raw: str) -> DataFrame:
    """Add the parse of a messy risk score as ``risk_*`` columns.

    Adds risk_raw, risk_numeric, risk_valid, risk_label, risk_flag and
    risk_imputed. ``risk_numeric`` is NULL when the text has no usable number; a
    word such as ``High`` keeps its label without becoming a number. The steps
    are separate projections so that no expression is expanded twice.
    """
    t, value = F.col("_t"), F.col("_value")
    band = F.when(value >= 71, "High").when(value >= 31, "Medium").otherwise("Low")
    percent = t.rlike(_PERCENT)
    in_range, word, missing = F.col("_in_range"), F.col("_word"), F.col("_missing")
    return (
        df.withColumn("_t", drop_na_words(F.col(raw)))
        .withColumns({
            "_value": F.when(percent, F.regexp_extract(t, _PERCENT, 1).try_cast("double")).otherwise(number(t)),
            "_missing": t.isNull() | (t == "Missing"),
            "_word": F.lower(t).isin("high", "medium", "low"),
        })
        .withColumn("_in_range", F.coalesce(value.between(0, 100), F.lit(False)))
        .withColumns({
            "risk_raw": F.when(missing, "Missing").otherwise(t),
            "risk_numeric": F.when(in_range, value),
            "risk_valid": F.coalesce(in_range | word, F.lit(False)),
            "risk_label": F.when(missing, "Missing").when(in_range, band).when(value.isNotNull(), "Invalid")
            .when(word, F.initcap(t)).otherwise("Unmapped"),
            "risk_flag": F.when(missing, "MISSING").when(in_range & percent, "PARSED_PERCENTAGE")
            .when(in_range, "VALID_NUMERIC").when(value.isNotNull(), "OUT_OF_RANGE")
            .when(word, "CATEGORICAL_PRESERVED").otherwise("UNMAPPED_CATEGORICAL"),
            "risk_imputed": ~in_range,
        })
        .drop("_t", "_value", "_missing", "_word", "_in_range")
    )


def risk_category(t: Column) -> Column:
    """Profiling class of a raw risk score (already trimmed)."""
    return (
        F.when(t.isNull(), "missing")
        .when(t.rlike(_NUMBER), "numeric")
        .when(t.rlike(_PERCENT), "numeric_fraction")
        .when(F.lower(t).isin("high", "medium", "low"), "categorical_risk")
        .otherwise("invalid")
    )


def round_half_up(c: Column, digits: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n`` in doubles.

    Decimal ties may differ in the last digit from banker-style rounding; the
    rule is the same on every engine, which plain ``round`` is not.
    """
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (the built-in bounds skip NULLs)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def floor0(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def bands(c: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """First label whose upper edge exceeds the value."""
    out = None
    for edge, label in edges:
        out = F.when(c < edge, label) if out is None else out.when(c < edge, label)
    return out.otherwise(last)


def deviation_status(z: Column) -> Column:
    return bands(z, [(1.5, "NORMAL"), (2.5, "UNUSUAL"), (4.0, "ELEVATED")], "OUTLIER")


def risk_level(score: Column) -> Column:
    return bands(score, [(30.0, "LOW"), (60.0, "MODERATE"), (80.0, "HIGH")], "CRITICAL")


def confidence_level(score: Column) -> Column:
    return bands(score, [(0.2, "UNTRUSTED"), (0.5, "LOW"), (0.8, "MEDIUM")], "HIGH")


def pattern_rarity(n: Column) -> Column:
    return F.when(n > 50, "COMMON").when(n >= 10, "UNUSUAL").otherwise("RARE")


def signal_multiplier(n: Column) -> Column:
    out = F.lit(1.0)
    for count, factor in fv.SIGNAL_MULTIPLIERS.items():
        if factor != 1.0:
            out = F.when(n == count, F.lit(factor)).otherwise(out)
    return out


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    """(value - median) / (1.4826 * MAD), clipped to +-20.

    With no dispersion the raw difference is used, clipped to +-10; a missing
    value or median gives 0.
    """
    scale = mad * F.lit(fv.MAD_SCALE)
    diff = value - median
    z = F.when(scale < 1e-6, clip(diff, -10, 10)).otherwise(clip(diff / scale, -20, 20))
    return F.coalesce(z, F.lit(0.0))


def count_true(*conds: Column) -> Column:
    total = F.lit(0)
    for cond in conds:
        total = total + F.when(cond, 1).otherwise(0)
    return total
