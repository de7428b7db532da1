"""A corpus pipeline of five of the subpackage's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. A stage begins by deleting the working tables of the stage before it in the same
thread, whose result has been written by then.

Stages work on any documents table, with nulls, empty texts and repeated rows; an empty table stays empty.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import bpe, language, mixing, ngram_join, shared, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Long documents of known languages score about 1, but scores shrink with a text's n-gram count. A text is like none of the
#: languages learned only if its score is below this and also too few of its n-grams occur in them, which doesn't depend on length.
LEAST_SCORE = 0.2
#: Share of a text's n-grams that a landmark has: 0.9 or more in short clean texts, about 0.3 (hash collisions) in other scripts.
LEAST_KNOWN = 0.5

_working = threading.local()


def _stage(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.delete(spark, getattr(_working, "tables", []))
        with shared.collected() as _working.tables:
            return function(docs)

    run.__doc__ = function.__doc__
    return run


@_stage
def identify_language(docs: DataFrame) -> DataFrame:
    """Rejects texts without letters and texts like none of the languages; fills in a language that is null."""
    learn = ~F.coalesce(shared.crc_of_id() % 4 == 2, F.lit(False))
    model = language.fit(docs, "doc_id", "text", "lang", learn, language.SIZES, language.PER_LANGUAGE, language.LANDMARKS, language.RIDGE)
    found = language.predict(docs.withColumn("id", F.col("doc_id")), "id", "text", model, keep=COLUMNS, id_name="id")
    accepted = found.where((F.col("lang_pred") != language.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | (F.col("known") >= LEAST_KNOWN)))
    return accepted.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@_stage
def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (of those that share it, one); of repeated rows one stays."""
    return ngram_join.representatives(docs, keep=COLUMNS).select(*COLUMNS)


@_stage
def cut_repeated_substrings(docs: DataFrame) -> DataFrame:
    """Removes byte strings that start earlier; documents of which nothing is left go. A character that a cut splits becomes U+FFFD."""
    found = suffix_dedup.dedup(docs, keep=("lang", "source"), keep_text=True)
    left = found.where("n_removed < n_bytes or n_bytes = 0").withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per draw: every document at least once, those of small sources up to mixing.MAX_REPEATS times."""
    return mixing.mix(docs, keep=("text", "lang", "n_chars")).select(*COLUMNS)


@_stage
def encode_and_decode(docs: DataFrame) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256`` of each draw."""
    return bpe.digests(bpe.decode(bpe.encode(docs)), keep_ids=True)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated substrings", cut_repeated_substrings),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_and_decode),
]

#: Nystroem regression, chosen paths and the vocabulary's merges aren't SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; results between them are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        if number:
            shared.delete(spark, [f"{folder}/{number - 1}"])
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
