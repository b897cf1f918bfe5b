"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and works on all of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, prepare, read_table, spare, text_of


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier doesn't reject; the model is fitted on labelled rows of ``docs``.

    A null text is scored as an empty one, a null doc_id has no label but a score; repeated rows score
    alike and go or stay together; a score equal to the threshold stays; without
    labels nothing is rejected; an empty table gives no rows."""
    from .quality import fit, with_scores

    prepare(spark)
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return with_scores(docs, model, name=spare(docs, "_score"), least=model.threshold).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five
    words, similarity 0.8. Rows that repeat an id and its text become one; a null doc_id is
    the smallest. Null and empty texts are near nothing and stay; an empty table gives no rows."""
    from .minhash import near_duplicates

    prepare(spark)
    # one plain key, so that both steps below are dealt by it; a null id is the least long here
    name = spare(docs, "_place")
    place = lambda i, tag: F.struct(F.coalesce(F.col(i).cast("long"), F.lit(NULL_ID)).alias("i"), tag.alias("t")).alias(name)
    kept = near_duplicates(docs, shingle=5, percent=80).where("kept").select(place("doc_id", F.col("text_hash")))
    return docs.select("*", place("doc_id", F.xxhash64(text_of()))).join(kept, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or a passage of one. Rows with a null or empty text
    stay; repeated rows are decided alike; without benchmark rows all stay; an empty table gives no rows; columns
    may have any names."""
    from .decontam import PASSAGE, without_leaks

    prepare(spark)
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"), passage=PASSAGE)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[KIND]`` in place of personal data; n_chars follows the text. A null
    text stays null (n_chars 0); repeated rows stay and are redacted alike; of overlapping spans the first names the
    kind; an empty table gives no rows."""
    from .pii import redact_documents

    prepare(spark)
    return redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents: one row per piece with its sequence and place. A null
    or empty text is the end id alone, a null doc_id stays null, repeated rows are packed each; an empty table gives no rows."""
    from .packing import pack_documents

    prepare(spark)
    return pack_documents(docs, default_tokenizer())
