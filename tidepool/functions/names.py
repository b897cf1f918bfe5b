"""Name normalisation and similarity for field and record matching (FUZ-1..3, FUZ-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, trim_unicode

# Type compatibility of (source JSON type, destination JSON type);
# equal types score 1.0, unlisted pairs 0.0. Asymmetric on purpose.
TYPE_COMPAT = {
    ("string", "number"): 0.3,
    ("number", "string"): 0.5,
    ("string", "integer"): 0.3,
    ("integer", "string"): 0.5,
    ("integer", "number"): 0.9,
    ("number", "integer"): 0.7,
    ("boolean", "string"): 0.4,
    ("string", "boolean"): 0.3,
    ("boolean", "integer"): 0.3,
    ("integer", "boolean"): 0.3,
}


def normalize_name(c) -> Column:
    """FUZ-1: lower case, drop ``_ - .`` and spaces."""
    return F.lower(F.regexp_replace(col_of(c), r"[_\-. ]", ""))


def normalize_field_name(c) -> Column:
    """Normalisation of the three-pass matcher: lower case, drop ``-`` and ``_``, trim."""
    return trim_unicode(F.lower(F.regexp_replace(col_of(c), r"[-_]", "")))


def name_similarity(a, b) -> Column:
    """FUZ-2: 1 - edit distance / longer byte length of the normalised names; equal -> 1; one empty -> 0."""
    na, nb = normalize_name(a), normalize_name(b)
    return (
        F.when(na == nb, F.lit(1.0))
        .when((na == F.lit("")) | (nb == F.lit("")), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(na, nb) / F.greatest(F.octet_length(na), F.octet_length(nb)))
    )


def similarity_of_normalized(na, nb, la=None, lb=None) -> Column:
    """FUZ-2 on names already normalised (``la`` / ``lb``: their byte lengths, optional)."""
    na, nb = col_of(na), col_of(nb)
    la = F.octet_length(na) if la is None else col_of(la)
    lb = F.octet_length(nb) if lb is None else col_of(lb)
    return (
        F.when(na == nb, F.lit(1.0))
        .when((la == 0) | (lb == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(na, nb) / F.greatest(la, lb))
    )


def type_compat(a, b) -> Column:
    """FUZ-3: compatibility score of two JSON schema type names."""
    a, b = col_of(a), col_of(b)
    expr = F.when(a == b, F.lit(1.0))
    for (s, d), score in TYPE_COMPAT.items():
        expr = expr.when((a == F.lit(s)) & (b == F.lit(d)), F.lit(score))
    return expr.otherwise(F.lit(0.0))


def suggested_transform(src_type, dst_type) -> Column:
    """FUZ-6: conversion suggested when the two types differ (null when equal or unknown)."""
    s, d = col_of(src_type), col_of(dst_type)
    differ = (s != d) & (s != F.lit("")) & (d != F.lit(""))
    return F.when(
        differ,
        F.when(d == F.lit("string"), F.lit("to_string"))
        .when(d.isin("integer", "number") & (s == F.lit("string")), F.lit("to_float"))
        .when(d == F.lit("integer"), F.lit("to_int"))
        .when(d == F.lit("number"), F.lit("to_float"))
        .when(d == F.lit("boolean"), F.lit("to_bool")),
    )
