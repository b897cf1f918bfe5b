"""Functions of the record-mapping expression language (FN-1..26).

Users compose these Column builders (or call the SQL functions installed by
:func:`register_sql_functions` inside ``F.expr`` / ``spark.sql``) instead of a
string expression parser. Type-dependent rules are resolved with ``typeof``,
which Catalyst folds to a constant, so each call compiles to one branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import col_of, parse_float_text, to_text, trim_unicode
from .timefmt import EXPRESSION_LAYOUTS, parse_time, rfc3339, translate_date_format

_USER_FUNCS: dict[str, Callable[..., Column]] = {}


def _fail(msg: str, c: Column) -> Column:
    return F.raise_error(F.concat(F.lit(msg), F.coalesce(c.cast("string"), F.lit("null"))))


# ----------------------------------------------------------- conversions

def to_string(c) -> Column:
    """FN-13: null -> empty text, integral floats without ``.0``."""
    return F.coalesce(to_text(col_of(c)), F.lit(""))


def to_float(c, on_error: str = "raise") -> Column:
    """FN-15: null -> 0, boolean -> 0/1, text parsed (no trimming)."""
    c = col_of(c)
    t = F.typeof(c)
    s = c.cast("string")
    parsed = parse_float_text(s)
    text_branch = parsed if on_error == "null" else F.when(parsed.isNull(), _fail("to_float: cannot parse ", c)).otherwise(parsed)
    return (
        F.when(c.isNull(), F.lit(0.0))
        .when(t == "boolean", F.when(c.cast("boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(t.isin("string", "varchar", "char"), text_branch)
        .otherwise(c.cast("double"))
    )


def to_int(c, on_error: str = "raise") -> Column:
    """FN-14: floats truncate; text must be integer text (``"12.7"`` fails); null -> 0.

    Returns a long (the source system returns a float64 holding the integer).
    """
    c = col_of(c)
    t = F.typeof(c)
    s = c.cast("string")
    parsed = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
    text_branch = parsed if on_error == "null" else F.when(parsed.isNull(), _fail("to_int: cannot parse ", c)).otherwise(parsed)
    return (
        F.when(c.isNull(), F.lit(0).cast("bigint"))
        .when(t == "boolean", F.when(c.cast("boolean"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        .when(t.isin("string", "varchar", "char"), text_branch)
        .when(t.isin("tinyint", "smallint", "int", "bigint"), s.try_cast("bigint"))  # exact beyond 2**53
        .otherwise(c.cast("double").try_cast("bigint"))
    )


def to_bool(c) -> Column:
    """FN-16: text is true unless empty, ``false`` or ``0``; numbers true when non-zero; null false."""
    c = col_of(c)
    t = F.typeof(c)
    s = c.cast("string")
    return (
        F.when(c.isNull(), F.lit(False))
        .when(t == "boolean", c.cast("boolean"))
        .when(t.isin("string", "varchar", "char"), ~s.isin("", "false", "0"))
        .when(t.isin("tinyint", "smallint", "int", "bigint", "float", "double") | t.startswith("decimal"),
              c.cast("double") != F.lit(0.0))
        .otherwise(F.lit(True))
    )


# ------------------------------------------------------------- arithmetic

def add(a, b, as_text: bool = False) -> Column:
    """FN-2: ``+``. Text when either operand is text (``as_text=True``), else numeric with null = 0."""
    a, b = col_of(a), col_of(b)
    if as_text:
        return F.concat(to_string(a), to_string(b))
    return to_float(a) + to_float(b)


def sub(a, b) -> Column:
    """FN-3: binary minus, operands parsed as numbers, null = 0."""
    return to_float(a) - to_float(b)


def mul(a, b) -> Column:
    """FN-3: product, operands parsed as numbers, null = 0."""
    return to_float(a) * to_float(b)


def neg(a) -> Column:
    """FN-3: unary minus."""
    return -to_float(a)


def div(a, b, safe: bool = False) -> Column:
    """FN-4: quotient; a zero divisor fails (``safe=True`` gives null instead)."""
    num, den = to_float(a), to_float(b)
    if safe:
        return F.try_divide(num, den)
    return F.when(den == F.lit(0.0), F.raise_error(F.lit("division by zero"))).otherwise(num / den)


# ---------------------------------------------------------------- strings

def concat(*cols) -> Column:
    """FN-5: concatenation, null counts as empty text."""
    return F.concat(*[to_string(c) for c in cols]) if cols else F.lit("")


def upper(c) -> Column:
    """FN-6."""
    return F.upper(to_string(c))


def lower(c) -> Column:
    """FN-7."""
    return F.lower(to_string(c))


def trim(c) -> Column:
    """FN-8: all Unicode white space, both ends."""
    return trim_unicode(to_string(c))


def split(c, sep: str) -> Column:
    """FN-9: split on a literal separator."""
    import re

    return F.split(to_string(c), re.escape(sep) if sep else "", -1)


def join(arr, sep: str) -> Column:
    """FN-10: join array elements as text, null elements as empty text."""
    return F.array_join(F.transform(col_of(arr), lambda x: to_string(x)), sep)


def coalesce(*cols) -> Column:
    """FN-11: first value that is neither null nor empty text."""
    outs = []
    for c in cols:
        c = col_of(c)
        outs.append(F.when(c.cast("string") == F.lit(""), F.lit(None)).otherwise(c))
    return F.coalesce(*outs)


def if_null(a, b) -> Column:
    """FN-12: ``b`` only when ``a`` is null (empty text is kept)."""
    return F.ifnull(col_of(a), col_of(b))


def substring(c, start, length=None) -> Column:
    """FN-20: zero-based by code point; negative start -> 0; past the end -> empty."""
    s = to_string(c)
    st = F.greatest(col_of(start) if not isinstance(start, int) else F.lit(start), F.lit(0))
    if length is None:
        return F.substr(s, st + 1)
    ln = col_of(length) if not isinstance(length, int) else F.lit(length)
    return F.substr(s, st + 1, F.greatest(ln, F.lit(0)))


def replace(c, old: str, new: str) -> Column:
    """FN-21: replace every literal occurrence."""
    return F.replace(to_string(c), F.lit(old), F.lit(new))


def regex_match(c, pattern: str) -> Column:
    """FN-22: unanchored regex search (Java regex dialect)."""
    return to_string(c).rlike(pattern)


# ------------------------------------------------------------------ dates

def now() -> Column:
    """FN-17: current time as RFC 3339 UTC text."""
    return rfc3339(F.current_timestamp())


def format_date(c, fmt: str, on_error: str = "raise") -> Column:
    """FN-18: parse with the ten expression layouts, format with YYYY/YY/MM/DD/HH/mm/ss/SSS tokens.

    The written clock time is kept (no shift to UTC), as the source formats
    in the parsed zone.
    """
    s = to_string(c)
    ts = parse_time(s, EXPRESSION_LAYOUTS, epoch_seconds=False, wall_clock=True)
    out = F.date_format(ts, translate_date_format(fmt))
    if on_error == "null":
        return out
    return F.when(ts.isNull(), _fail("format_date: cannot parse ", s)).otherwise(out)


def parse_date(c, on_error: str = "raise") -> Column:
    """FN-19: parse with the ten expression layouts, RFC 3339 UTC text out."""
    s = to_string(c)
    ts = parse_time(s, EXPRESSION_LAYOUTS, epoch_seconds=False)
    if on_error == "null":
        return rfc3339(ts)
    return F.when(ts.isNull(), _fail("parse_date: cannot parse ", s)).otherwise(rfc3339(ts))


def format_duration(ms) -> Column:
    """FN-24: ``5s`` / ``2m 05s`` / ``1h 23m 05s`` from elapsed milliseconds."""
    total = F.floor(col_of(ms) / 1000).cast("bigint")
    h = F.floor(total / 3600).cast("bigint")
    m = F.floor((total % 3600) / 60).cast("bigint")
    s = total % 60
    return (
        F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s))
        .when(m > 0, F.format_string("%dm %02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def elapsed_ms(start, end=None) -> Column:
    """FN-25: milliseconds between two timestamps; open end = now; null start = 0."""
    st = col_of(start).cast("timestamp")
    en = F.current_timestamp() if end is None else F.coalesce(col_of(end).cast("timestamp"), F.current_timestamp())
    return F.when(st.isNull(), F.lit(0).cast("bigint")).otherwise(F.unix_millis(en) - F.unix_millis(st))


def format_count(n) -> Column:
    """FN-26: thousands grouping (``1,234,567``)."""
    return F.format_number(col_of(n), 0)


# -------------------------------------------------------------- registry

def register_function(name: str, fn: Callable[..., Column]) -> None:
    """FN-23: add or override a named function (a Column builder)."""
    _USER_FUNCS[name] = fn


def call(name: str, *args) -> Column:
    """Call a named function: user-registered first, then built-ins."""
    if name in _USER_FUNCS:
        return _USER_FUNCS[name](*args)
    if name in BUILTINS:
        return BUILTINS[name](*args)
    raise KeyError(f"unknown function {name!r}")


BUILTINS: dict[str, Callable[..., Column]] = {
    "concat": concat, "upper": upper, "lower": lower, "trim": trim, "split": split, "join": join,
    "coalesce": coalesce, "if_null": if_null, "to_string": to_string, "to_int": to_int,
    "to_float": to_float, "to_bool": to_bool, "now": now, "format_date": format_date,
    "parse_date": parse_date, "substring": substring, "replace": replace, "regex_match": regex_match,
}


# SQL bodies of the installed SQL functions (inlined by Catalyst).
SQL_FUNCTIONS = {
    "tp_upper": ("x STRING", "STRING", "upper(coalesce(x, ''))"),
    "tp_lower": ("x STRING", "STRING", "lower(coalesce(x, ''))"),
    "tp_trim": ("x STRING", "STRING", r"regexp_replace(coalesce(x, ''), '(?U)^\\s+|\\s+$', '')"),
    "tp_if_null": ("a STRING, b STRING", "STRING", "ifnull(a, b)"),
    "tp_coalesce": ("a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''))"),
    "tp_substring": ("s STRING, st INT, len INT", "STRING", "substr(coalesce(s, ''), greatest(st, 0) + 1, greatest(len, 0))"),
    "tp_replace": ("s STRING, o STRING, n STRING", "STRING", "replace(coalesce(s, ''), o, n)"),
    "tp_regex_match": ("s STRING, p STRING", "BOOLEAN", "coalesce(s, '') rlike p"),
    "tp_to_bool": ("s STRING", "BOOLEAN", "coalesce(s NOT IN ('', 'false', '0'), false)"),
    "tp_format_duration": ("ms BIGINT", "STRING",
                           "CASE WHEN floor(ms / 1000) >= 3600 THEN format_string('%dh %02dm %02ds', "
                           "floor(floor(ms / 1000) / 3600), floor((floor(ms / 1000) % 3600) / 60), floor(ms / 1000) % 60) "
                           "WHEN floor(ms / 1000) >= 60 THEN format_string('%dm %02ds', floor(floor(ms / 1000) / 60), "
                           "floor(ms / 1000) % 60) ELSE format_string('%ds', floor(ms / 1000)) END"),
    "tp_normalize_name": ("x STRING", "STRING", r"lower(regexp_replace(x, '[_\\-. ]', ''))"),
    "tp_name_similarity": ("a STRING, b STRING", "DOUBLE",
                           r"CASE WHEN lower(regexp_replace(a, '[_\\-. ]', '')) = lower(regexp_replace(b, '[_\\-. ]', '')) THEN 1.0D "
                           r"WHEN lower(regexp_replace(a, '[_\\-. ]', '')) = '' OR lower(regexp_replace(b, '[_\\-. ]', '')) = '' THEN 0.0D "
                           r"ELSE 1.0D - levenshtein(lower(regexp_replace(a, '[_\\-. ]', '')), lower(regexp_replace(b, '[_\\-. ]', ''))) "
                           r"/ greatest(octet_length(lower(regexp_replace(a, '[_\\-. ]', ''))), octet_length(lower(regexp_replace(b, '[_\\-. ]', '')))) END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Install the SQL functions as temporary SQL UDFs so ``F.expr`` / SQL text can use them."""
    names = []
    for name, (params, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names

