"""Saved API pages: unpack results, parent -> child expansion, termination audit
(SRC-19, SRC-22, SRC-23).

Live HTTP paging is not built; pages enter as rows (one JSON body per page,
fetched by whatever lands them in storage) and everything after that is Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _schema_for_path(path: str, element_ddl: str) -> str:
    ddl = f"array<{element_ddl}>"
    for seg in reversed(path.split(".")):
        ddl = f"struct<`{seg}`: {ddl}>"
    return ddl


def explode_results(pages: DataFrame, json_col: str, path: str, element_ddl: str, keep: list[str] | None = None) -> DataFrame:
    """SRC-19: one row per element of the array at dotted ``path`` of each page body.

    A missing or non-array path gives no rows for that page (``explode`` of
    null). Elements are typed by ``element_ddl`` (e.g. ``"id BIGINT, name STRING"``).
    """
    parsed = F.from_json(F.col(json_col), _schema_for_path(path, f"struct<{element_ddl}>"))
    arr = parsed
    for seg in path.split("."):
        arr = arr.getField(seg)
    cols = [F.col(c) for c in (keep or [])]
    return pages.select(*cols, F.explode(arr).alias("_el")).select(*[c for c in (keep or [])], "_el.*")


def expand_children(parents: DataFrame, parent_id: str, children_col: str, keep: list[str] | None = None) -> DataFrame:
    """SRC-22: children of each parent row with ``_parent_id``; parents without an id are skipped."""
    p = parents.filter(F.col(parent_id).isNotNull())
    cols = [F.col(c) for c in (keep or [])]
    return p.select(*cols, F.col(parent_id).alias("_parent_id"), F.explode(children_col).alias("_child")).select(
        *(keep or []), "_parent_id", "_child.*")


def page_audit(pages: DataFrame, stream: str, page_no: str, n_records: str, cursor: str | None = None,
               has_more: str | None = None, page_size: int | None = None) -> DataFrame:
    """SRC-23: why paging stopped (or continued) after each saved page.

    Reasons, first that applies: ``has_more_false``, ``empty_cursor`` (cursor
    paging), ``short_page`` (offset paging: fewer rows than the page size),
    ``end_of_stream`` (the last saved page of its stream with none of the
    above), else ``continue``. The last page per stream comes from a
    ``max`` aggregate joined back on the stream (map-side combined, so a
    stream with a third of all pages does not land in one window task).
    """
    last = pages.groupBy(stream).agg(F.max(page_no).alias("_last_page"))
    reason = F.when(F.lit(False), F.lit(None))
    if has_more:
        reason = reason.when(F.col(has_more) == F.lit(False), F.lit("has_more_false"))
    if cursor:
        reason = reason.when(F.coalesce(F.col(cursor), F.lit("")) == "", F.lit("empty_cursor"))
    if page_size is not None:
        reason = reason.when(F.col(n_records) < F.lit(page_size), F.lit("short_page"))
    reason = reason.when(F.col(page_no) == F.col("_last_page"), F.lit("end_of_stream")).otherwise(F.lit("continue"))
    return pages.join(last, stream, "inner").withColumn("stop_reason", reason).drop("_last_page")


def pack_pages(df: DataFrame, key: str, page_size: int = 100, cols: list[str] | None = None) -> DataFrame:
    """Group rows into API-style pages of about ``page_size`` records per key.

    Output: ``key, page_no, records`` (array of structs). The number of
    pages of a key is ``ceil(rows / page_size)`` from a per-key count, and
    rows are spread over them by a hash of the row, so even a key holding a
    third of all rows is split into bounded pages instead of one giant
    array. (Inverse of :func:`explode_results` / :func:`expand_children`.)
    """
    cols = cols or [c for c in df.columns if c != key]
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    pages = F.greatest(F.ceil(F.col("_n") / F.lit(page_size)), F.lit(1))
    tagged = df.join(counts, key, "inner").withColumn(
        "page_no", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), pages).cast("int"))
    return tagged.groupBy(key, "page_no").agg(F.collect_list(F.struct(*cols)).alias("records"))
