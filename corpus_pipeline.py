"""Corpus preparation: the training-data operators as one job over ``documents``.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. ``run`` applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm.common import cut, prepare, read_table
from tidepool.llm.stages import decontaminate, keep_quality, near_dedup, pack, redact

STAGES = [
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", redact),
    ("pack", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
