"""Scalar rules as Column expressions.

Nothing here is a Python row function: every rule is a Catalyst expression, so
it runs inside whole-stage code generation next to the scan.  Small fixed
lookups (four risk levels, three soil states) are literal maps, which cost no
join at all.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    """A MAP literal built from a (small, fixed) Python dict."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


# --- P1-P4: coercion and missing values ---------------------------------------

def to_number(c) -> Column:
    """Text or number -> DOUBLE; unparsable -> null; NaN -> null (missing)."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def parse_date(c, pattern: str = fixed.DATE_PATTERN) -> Column:
    """Text -> DATE by pattern; anything unparsable -> null."""
    return F.try_to_date(col(c).cast("string"), pattern)


def sentinel_to_null(c, sentinel: float = fixed.RAIN_SENTINEL) -> Column:
    """The sentinel value means missing."""
    return F.nullif(col(c), F.lit(float(sentinel)))


def finite_or_null(c) -> Column:
    """+inf / -inf -> null."""
    x = col(c)
    return F.when(F.abs(x) == F.lit(math.inf), F.lit(None).cast("double")).otherwise(x)


def is_infinite(c) -> Column:
    return F.coalesce(F.abs(col(c)) == F.lit(math.inf), F.lit(False))


def out_of_bounds(bounds: dict, present: list[str]) -> Column:
    """P5: true when any present, non-null value lies outside its closed range."""
    tests = []
    for name, (low, high) in bounds.items():
        if name not in present:
            continue
        x = F.col(name)
        if low is not None:
            tests.append(F.coalesce(x < F.lit(float(low)), F.lit(False)))
        if high is not None:
            tests.append(F.coalesce(x > F.lit(float(high)), F.lit(False)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# --- P9-P12: calendar and feature expressions -----------------------------------

def monsoon_flag(date_col) -> Column:
    """P10: 1 when the month is in the monsoon season."""
    return F.month(col(date_col)).isin(*fixed.MONSOON_MONTHS).cast("int")


def rain_soil_interaction(rain, soil) -> Column:
    """Rain x soil with missing as 0."""
    return F.coalesce(col(rain), F.lit(0.0)) * F.coalesce(col(soil), F.lit(0.0))


def seasonal_rain(flag, rain) -> Column:
    """Rain inside the season, 0 outside."""
    return F.when(col(flag) == 1, F.coalesce(col(rain), F.lit(0.0))).otherwise(F.lit(0.0))


# --- F1-F4: risk bands, confidence, safety override ------------------------------

def risk_band(p, closed_upper: bool = True) -> Column:
    """F1 (closed upper edges, scoring) / F2 (half-open edges, leaderboard)."""
    p = col(p)
    if closed_upper:
        return (F.when(p < fixed.LOW_THRESHOLD, "Low")
                .when(p <= fixed.MEDIUM_THRESHOLD, "Medium")
                .when(p <= fixed.HIGH_THRESHOLD, "High")
                .otherwise("Critical"))
    return (F.when(p < fixed.LOW_THRESHOLD, "Low")
            .when(p < fixed.MEDIUM_THRESHOLD, "Medium")
            .when(p < fixed.HIGH_THRESHOLD, "High")
            .otherwise("Critical"))


def confidence_pct(p) -> Column:
    """F3 (scoring): max(p, 1 - p) * 100, unrounded."""
    p = col(p)
    return F.greatest(p, F.lit(1.0) - p) * F.lit(100.0)


def probability_pct(p) -> Column:
    """F3 (leaderboard): p * 100 rounded half-to-even to one decimal."""
    return F.bround(col(p) * F.lit(100.0), 1)


def risk_rank(level) -> Column:
    return literal_map(fixed.RISK_ORDER)[col(level)]


def guardrail(level, rain, soil, water) -> Column:
    """first matching rule forces a level; the result is never below ``level``."""
    rain, soil, water, level = col(rain), col(soil), col(water), col(level)
    forced = (F.when((rain >= 450) & (soil == "Saturated") & (water == "Yes"), F.lit("Critical"))
              .when((rain >= 350) & ((soil == "Saturated") | (water == "Yes")), F.lit("High"))
              .when((rain >= 300) & soil.isin("Moist", "Saturated") & (water == "Yes"), F.lit("High"))
              .otherwise(level))
    return F.when(F.coalesce(risk_rank(forced) > risk_rank(level), F.lit(False)), forced).otherwise(level)


# --- F5: report validation ---------------------------------------------------------

def report_is_valid(rain, report_date, district, soil, water, district_known) -> Column:
    """every field present, rain inside [0, 500], known district / soil / water."""
    rain = col(rain)
    present = (rain.isNotNull() & col(report_date).isNotNull()
               & F.coalesce(col(district) != "", F.lit(False))
               & F.coalesce(col(soil) != "", F.lit(False))
               & F.coalesce(col(water) != "", F.lit(False)))
    in_range = (rain >= fixed.RAIN_MIN_MM) & (rain <= fixed.RAIN_MAX_MM)
    known = (col(district_known)
             & col(soil).isin(*fixed.SOIL_CONDITION_TO_VALUE.keys())
             & col(water).isin(*fixed.VISIBLE_WATER_OPTIONS))
    return F.coalesce(present & in_range & known, F.lit(False))


def validation_message(ok) -> Column:
    return F.when(col(ok), F.lit("")).otherwise(F.lit(fixed.INSUFFICIENT_DATA_MESSAGE))


# --- F6: people at risk ----------------------------------------------------------------

def people_at_risk(level, confidence, population, divisor, exposure_factor, max_share) -> Column:
    """base x severity x (0.6 + 0.4 conf/100) x exposure, capped, floored, to hundreds.

    ``population`` null means the district has no region / no regional figure: 0.
    Rounding is half-to-even like the reference (``bround``).
    """
    level = col(level)
    base = col(population) / F.greatest(col(divisor), F.lit(1)).cast("double")
    raw = (base * literal_map(fixed.SEVERITY_RATE)[level]
           * (F.lit(0.6) + F.lit(0.4) * (col(confidence) / F.lit(100.0)))
           * col(exposure_factor))
    cap = base * F.least(literal_map(fixed.MAX_CAP_RATE)[level], col(max_share))
    bounded = F.greatest(literal_map(fixed.MINIMUM_PEOPLE)[level].cast("double"), F.least(raw, cap))
    return F.when(col(population).isNull(), F.lit(0).cast("long")) \
        .otherwise(F.bround(bounded, -2).cast("long"))


# the characters with the Unicode property White_Space
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# --- F8-F14: text and date helpers ---------------------------------------------------------

def normalize_risk(c) -> Column:
    """F8: trim; exact level kept; otherwise case-insensitive match; else null."""
    t = F.trim(col(c).cast("string"))
    canon = F.initcap(F.lower(t))
    return (F.when(t.isin(*fixed.RISK_LEVELS), t)
            .when(F.lower(t).isin(*[x.lower() for x in fixed.RISK_LEVELS]), canon))


def unicode_trim(c) -> Column:
    """strip leading / trailing Unicode white space; null -> ''."""
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(WHITE_SPACE))


def display_name(c) -> Column:
    """trimmed key with underscores shown as blanks."""
    return F.regexp_replace(unicode_trim(c), "_", " ")


def mdy(c) -> Column:
    """DATE -> unpadded month/day/year text."""
    return F.date_format(col(c), "M/d/yyyy")


def blend(new, old, alpha: float) -> Column:
    """alpha * new + (1 - alpha) * old, or new when old is missing."""
    return F.coalesce(F.lit(alpha) * col(new) + F.lit(1.0 - alpha) * col(old), col(new))


def strip_feature_prefix(c) -> Column:
    """Drop a known prefix and everything after the first comma."""
    pattern = "^(" + "|".join(fixed.FEATURE_PREFIXES) + ")"
    return F.split(F.regexp_replace(col(c), pattern, ""), ",").getItem(0)
