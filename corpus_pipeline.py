"""A corpus pipeline: language ID, exact and near de-duplication, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import common, exact_dedup, language_id, packing, secrets, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: "und" (null, or without a letter) and posteriors under one half go.

    Learns from rows with a language whose id's crc32 is not 2 modulo 4.  Rows are judged one by one,
    so repeated and null ids and repeated rows stay as they are.  Where no row has a language, nothing
    can be learned and every row stays.  An empty table gives no rows; extra columns are left off.
    """
    docs = docs.select(*COLUMNS)
    held = language_id.crc_bucket("doc_id", 4) == 2
    langs, probs = language_id.fit(docs.where(~held), "text", "lang", "doc_id", 8_000, 2, None)
    if not langs:
        return docs
    found = language_id.predict(docs, langs, probs, lang_name="__lang", score_name="__score")
    return found.where("__lang <> 'und' and __score >= 0.5").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text that is the same after white-space runs became one space; null counts as empty.

    The smallest id stays, a null id sorting last; of rows that share id and text one stays.  A row goes
    only for its own text, whatever other rows its id has.  An empty table gives no rows; extra columns
    are left off.
    """
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of texts linked by SimHash fingerprints (3-word shingles, three bits at most),
    or whose sets of 5-word shingles have a Jaccard of 0.8 or more.

    The smallest id stays, a null id sorting last; each row stands for itself, so repeated ids link
    nothing.  Null, empty and blank texts have fingerprint zero and are one group.  An empty table gives
    no rows; extra columns are left off.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in the place of each secret; no document goes, n_chars follows the text.

    A null text stays null, and its n_chars is null.  Rows are treated one by one, so repeated and null
    ids need no care; an empty table gives no rows; extra columns are left off.
    """
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2,048 tokens, as op4_packing gives them.

    A null or empty text is a piece of one token; repeated and null ids are packed row by row; an empty
    table gives no rows.
    """
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The language model and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    A stage's table is deleted once the next stage's is written; the last one written stays, since the
    result reads it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.drop_folder(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
