"""The corpus pipeline: identify the language, drop near-duplicates, redact personal data, mix the sources, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents, with further columns of any names as they are given. An empty table gives
an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, language, mixing, pii, simhash
from millrace.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: those in no language, and with them null texts and texts without a letter.

    Documents with null ids, and repeated ones, are judged like all others. Without any label all texts with a letter stay.
    """
    ship(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document of least id stays, null ids last, ties by a hash of the text.

    Rows alike in id and text count as one; unlike texts with the same id, or none, all stay.
    """
    ship(spark)
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind; all rows stay, null texts as nulls. n_chars follows the text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the sources' schedule, every row once; a null source is one of its own."""
    ship(spark)
    return mixing.in_order(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes, a row for each; a null text counts as empty."""
    ship(spark)
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode_bytes),
]

#: The trained language model and the link components have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the results between them are written to the shared checkpoint folder."""
    from millrace.llm.common import durable, table

    docs, before = table(spark, sf_dir, "documents"), None
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = before = durable(docs, instead_of=before)  # what a stage has read is deleted
    return docs
