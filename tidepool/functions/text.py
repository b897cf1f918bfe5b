"""Text forms of values, written as Spark Column expressions.

Everything here is a pure ``Column -> Column`` builder so it stays inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number syntaxes accepted by the source system's parsers.
# Integers: optional sign, decimal digits. Floats: decimal with optional
# fraction and exponent, plus inf / infinity / nan in any case.
INT_TEXT_RE = r"^[+-]?[0-9]+$"
FLOAT_TEXT_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_FLOAT_RE = r"^(?i)[+-]?(inf|infinity|nan)$"

FLOATING_TYPES = ("double", "float")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip_fraction_zeros(t: Column) -> Column:
    return F.regexp_replace(t, r"\.?0+$", "")


def _from_exponent(t: Column) -> Column:
    """Plain digits of a JVM double text with exponent (``-1.25E40``, ``1.0E-30``)."""
    sign = F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    power = F.substring_index(t, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(t, "E", 1), r"[-.]", ""), r"0+$", "")
    big = F.rpad(digits, power + 1, "0")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.concat(sign, F.when(power >= 0, big).otherwise(small))


def plain_number(x: Column) -> Column:
    """Shortest digits of a double without exponent (the source system's float text).

    ``1e7`` -> ``10000000``, ``100.0`` -> ``100``, ``1.5e-7`` ->
    ``0.00000015``, ``2.5`` stays; NaN -> ``NaN``, infinities -> ``+Inf`` /
    ``-Inf``. Built from casts by magnitude band -- integral values through
    ``bigint``, ``[1e-3, 1e7)`` through the JVM text (never an exponent
    there), larger and smaller values through a decimal cast (which keeps
    the shortest digits and prints plainly) -- so no regex runs except one
    trailing-zero strip; beyond ``[1e-20, 1e38)``, where decimals end, the JVM's
    exponent text is written out.
    """
    ax = F.abs(x)
    integral = F.rint(x) == x
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("NaN"))
        .when(x == F.lit(float("inf")), F.lit("+Inf"))
        .when(x == F.lit(float("-inf")), F.lit("-Inf"))
        .when(x == F.lit(0.0), F.lit("0"))
        .when((ax >= 1e-3) & (ax < 1e7), F.when(integral, x.cast("bigint").cast("string")).otherwise(x.cast("string")))
        .when((ax >= 1e7) & (ax < 1e18), _strip_fraction_zeros(x.try_cast("decimal(38,10)").cast("string")))
        .when((ax >= 1e18) & (ax < 1e38), x.try_cast("decimal(38,0)").cast("string"))
        .when((ax >= 1e-20) & (ax < 1e-3), _strip_fraction_zeros(x.try_cast("decimal(38,37)").cast("string")))
        .otherwise(_from_exponent(x.cast("string")))
    )


def to_text(c) -> Column:
    """Value as text with the source system's rules, null stays null.

    Floating values print with shortest digits and no exponent (integral
    ones without ``.0``); booleans as ``true`` / ``false``; timestamps as
    RFC 3339 UTC. The branch is picked from the column type at plan time
    (``typeof`` is constant-folded by Catalyst).
    """
    c = col_of(c)
    t = F.typeof(c)
    return (
        # every branch must type-check for any input type, so the float branch goes through text
        F.when(t.isin(*FLOATING_TYPES), plain_number(c.cast("string").cast("double")))
        .when(t.isin("timestamp", "timestamp_ntz"), F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        .otherwise(c.cast("string"))
    )


def trim_unicode(s: Column) -> Column:
    """Strip leading and trailing Unicode white space (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def is_int_text(s: Column) -> Column:
    return s.rlike(INT_TEXT_RE)


def is_float_text(s: Column) -> Column:
    return s.rlike(FLOAT_TEXT_RE) | s.rlike(SPECIAL_FLOAT_RE)


def parse_float_text(s: Column) -> Column:
    """Double from text accepted by the source parser, else null."""
    lo = F.lower(s)
    value = s.try_cast("double")
    return (
        F.when(s.rlike(FLOAT_TEXT_RE), F.when(F.abs(value) < F.lit(float("inf")), value))  # out of range is an error
        .when(lo.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
        .when(lo.isin("-inf", "-infinity"), F.lit(float("-inf")))
        .when(lo.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
    )


def parse_int_text(s: Column) -> Column:
    """Long from integer text, null when not integer text or out of range."""
    return F.when(s.rlike(INT_TEXT_RE), s.try_cast("bigint"))
