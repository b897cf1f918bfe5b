"""Type coercion (COE-1..23) as Column expressions.

Two families, kept apart on purpose:

* **strict** (:func:`coerce`, :func:`coerce_strict`): the converter matrix of
  the transform worker. Same type or null passes; an unknown pair is an error;
  a value that does not convert raises (``on_error="raise"``) or becomes null
  (``on_error="null"``, for dead-letter routing).
* **lenient** (:func:`coerce_lenient`): the workflow activity rules. A value
  that does not convert keeps its old value when the column type allows it,
  and an error text is added to an array column; the row survives.

Differences from the source system, on purpose: integers stay exact 64-bit
(no float64 round trip), time values are UTC instants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import (
    col_of,
    parse_float_text,
    parse_int_text,
    plain_number,
    to_text,
    trim_unicode,
)
from .timefmt import LENIENT_LAYOUTS, STRICT_LAYOUTS, parse_time, rfc3339

# Type-name synonyms of the strict coercer.
TYPE_SYNONYMS = {
    "string": "string", "str": "string", "text": "string", "varchar": "string",
    "int": "int", "int32": "int", "int64": "int", "integer": "int", "bigint": "int",
    "float": "float", "float32": "float", "float64": "float", "double": "float", "decimal": "float", "number": "float",
    "bool": "bool", "boolean": "bool",
    "time": "time", "timestamp": "time", "datetime": "time", "date": "time",
}

# Boolean spellings. Exact-case forms of the strict parser,
# then the case-insensitive extras of the strict coercer.
BOOL_TRUE_EXACT = ("1", "t", "T", "TRUE", "true", "True")
BOOL_FALSE_EXACT = ("0", "f", "F", "FALSE", "false", "False")
BOOL_TRUE_EXTRA = ("yes", "y", "1", "on")
BOOL_FALSE_EXTRA = ("no", "n", "0", "off")

SPARK_TYPE_OF_KIND = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "time": "timestamp"}

_CUSTOM: dict[str, Callable[[Column], Column]] = {}


def normalize_type(name: str) -> str:
    t = (name or "").strip().lower()
    return TYPE_SYNONYMS.get(t, t)


def kind_of(dtype: T.DataType) -> str:
    """Coercion family of a Spark type (the value-inferred source type)."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "string"


def register_converter(frm: str, to: str, fn: Callable[[Column], Column]) -> None:
    """COE-16: add or override a converter for ``from->to`` (a Column function)."""
    _CUSTOM[f"{normalize_type(frm)}->{normalize_type(to)}"] = fn


def clear_converters() -> None:
    _CUSTOM.clear()


def parse_bool_exact(s: Column) -> Column:
    return F.when(s.isin(*BOOL_TRUE_EXACT), F.lit(True)).when(s.isin(*BOOL_FALSE_EXACT), F.lit(False))


def _builtin(frm: str, to: str) -> Callable[[Column], Column] | None:
    def s2i(c):
        t = trim_unicode(c)
        return F.coalesce(parse_int_text(t), parse_float_text(t).try_cast("bigint"))

    def s2b(c):
        t = trim_unicode(c)
        lo = F.lower(t)
        return F.coalesce(
            parse_bool_exact(t),
            F.when(lo.isin(*BOOL_TRUE_EXTRA), F.lit(True)).when(lo.isin(*BOOL_FALSE_EXTRA), F.lit(False)),
        )

    table = {
        "string->int": s2i,
        "int->string": lambda c: c.cast("string"),
        "string->float": lambda c: parse_float_text(trim_unicode(c)),
        "float->string": lambda c: plain_number(c.cast("double")),
        "string->bool": s2b,
        "bool->string": lambda c: c.cast("string"),
        "string->time": lambda c: parse_time(trim_unicode(c), STRICT_LAYOUTS, epoch_seconds=True),
        "time->string": lambda c: rfc3339(c.cast("timestamp")),
        "int->float": lambda c: c.cast("double"),
        "float->int": lambda c: c.try_cast("bigint"),
        "int->bool": lambda c: c != F.lit(0),
        "bool->int": lambda c: c.cast("bigint"),
        "float->bool": lambda c: c != F.lit(0.0),
        "bool->float": lambda c: c.cast("double"),
    }
    return table.get(f"{frm}->{to}")


def coerce(c, frm: str, to: str, on_error: str = "raise") -> Column:
    """COE-1..15 strict converter: ``frm`` / ``to`` accept any synonym.

    ``on_error``: ``"raise"`` fails the job on the first value that does not
    convert (the reference fails the whole batch), ``"null"`` yields null.
    """
    c = col_of(c)
    f, t = normalize_type(frm), normalize_type(to)
    if f == t:
        return c
    fn = _CUSTOM.get(f"{f}->{t}") or _builtin(f, t)
    if fn is None:
        raise ValueError(f"no converter registered for {f} -> {t}")
    out = fn(c)
    if on_error == "null":
        return out  # every converter maps null to null
    msg = F.concat(F.lit(f"cannot convert value to {t}: "), c.cast("string"))
    # ``out`` is written once and evaluated first, so it is computed once per row
    return F.coalesce(out, F.when(c.isNotNull(), F.raise_error(msg)))


def coerce_columns(df: DataFrame, spec: dict[str, str], on_error: str = "raise") -> DataFrame:
    """COE-23: strict coercion of several columns in one projection; source type from the schema."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for name in df.columns:
        if name in spec:
            cols.append(coerce(F.col(name), kind_of(types[name]), spec[name], on_error).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


coerce_strict = coerce_columns


# ---------------------------------------------------------------- lenient

def lenient_value(c: Column, source: T.DataType, target: str) -> tuple[Column, Column]:
    """COE-17..21: (converted value, failed flag) for one field.

    ``target`` uses the workflow names (string, int64, float64, bool,
    timestamp and their aliases); an unknown target leaves the value as is.
    """
    k = kind_of(source)
    tgt = (target or "").strip().lower()
    fail = F.lit(False)
    if tgt == "string":
        return to_text(c), fail
    if tgt in ("int64", "int", "integer"):
        if k == "float":
            v = c.try_cast("bigint")
        elif k == "int":
            v = c.cast("bigint")
        elif k == "bool":
            v = c.cast("bigint")
        elif k == "string":
            v = F.coalesce(parse_int_text(c), parse_float_text(c).try_cast("bigint"))
        else:
            return c, F.lit(True)
        return v, c.isNotNull() & v.isNull()
    if tgt in ("float64", "float", "double", "number"):
        if k in ("float", "int", "bool"):
            v = c.cast("double")
        elif k == "string":
            v = parse_float_text(c)
        else:
            return c, F.lit(True)
        return v, c.isNotNull() & v.isNull()
    if tgt in ("bool", "boolean"):
        if k == "bool":
            v = c
        elif k in ("float", "int"):
            v = c != F.lit(0)
        elif k == "string":
            v = parse_bool_exact(c)
        else:
            return c, F.lit(True)
        return v, c.isNotNull() & v.isNull()
    if tgt in ("timestamp", "datetime"):
        if k == "string":
            ts = parse_time(c, LENIENT_LAYOUTS, epoch_seconds=False)
            return F.coalesce(rfc3339(ts), c), fail  # unparseable text passes unchanged
        if k in ("float", "int"):
            return rfc3339(F.timestamp_seconds(c.try_cast("bigint"))), fail
        if k == "time":
            return rfc3339(c.cast("timestamp")), fail
        return c.cast("string"), fail
    return c, fail


def coerce_lenient(df: DataFrame, spec: dict[str, str], error_col: str = "_coerce_errors") -> DataFrame:
    """COE-22: coerce fields, keep failing values, collect error texts.

    A field that is absent or null is skipped. When the target type differs
    from the column type a failing value cannot stay in the column (Spark
    columns have one type); it becomes null and its text is in the error.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols, errs = [], []
    for name in df.columns:
        if name not in spec:
            cols.append(F.col(name))
            continue
        v, failed = lenient_value(F.col(name), types[name], spec[name])
        # every failing conversion changes the column type (text -> number /
        # boolean, float -> long overflow) and yields null, so the old value
        # lives on in the error text; ``v`` is projected as is
        cols.append(v.alias(name))
        errs.append(F.when(failed, F.concat(F.lit(f"field {name}: cannot coerce "), to_text(F.col(name)),
                                            F.lit(f" to {spec[name]}"))))
    err = F.array_compact(F.array(*errs)) if errs else F.array().cast("array<string>")
    return df.select(*cols, err.alias(error_col))

