"""Corpus pipeline over ``documents``: toxicity, language ID, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``docs``.

Defined cases, beside those of the operators: documents with null text have no toxic word, are rejected by
language ID (no letter), as are texts of digits and signs alone and texts without a trigram of the training rows; documents with null id go through all stages;
of repeated rows, near-dedup keeps one; of a group it keeps the smallest id (a null id before all others).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm import bpe, decontaminate, langid, simhash, toxicity
from tabwise.llm.common import ship_package, written
from tabwise.sources.tables import read_table

ORACLE_SQL = None  # learned models, fingerprints and alignments; checked against brute force in tests/llm


def _crc_of_id(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 9 does not predict toxic; it learns as ``op9_toxicity`` does."""
    ship_package(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    learn = docs.where(_crc_of_id(5) != 0).select("doc_id", "text").join(labels, "doc_id")
    return toxicity.reject(docs, toxicity.fit(learn))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 6 finds a language (not ``und``, a letter and a known trigram); it learns as ``op6_language_id`` does."""
    ship_package(spark)
    names = tuple(_free(docs, x) for x in ("_lang_pred", "_score", "_ambiguous"))
    model = langid.fit(docs.where(_crc_of_id(3) != 1))
    found = langid.identify(docs, model, keep=docs.columns, names=names, reject=True)
    return found.where(F.col(names[0]) != langid.UNKNOWN).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of operator 5 (3-word shingles, 3 bits).

    Rows are told apart by a number that is written with them once: a scan may be cut otherwise when it runs again.
    """
    ship_package(spark)
    row = _free(docs, "_row")
    placed = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = placed.select(F.struct(F.col("doc_id"), F.col(row).alias("row")).alias("key"), "text")
    found = simhash.near_duplicates(keyed, words=3, most_bits=3, key="key")
    dropped = written(found.where("key <> component").select(F.col("key.row").alias(row)), "near-copies")
    return placed.join(dropped, row, "left_anti").select(docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 2 finds no test item."""
    ship_package(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), short=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs``, the ids of operator 4 (packed little-endian uint32), their number, and whether they decode to the text."""
    ship_package(spark)
    n, ids, back = (_free(docs, x) for x in ("n_tokens", "token_ids", "round_trip"))
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                 keep=docs.columns, decode=True, ids=ids, count=n, decoded=back)
    return coded.withColumn(back, F.col(back) == F.coalesce(F.col("text"), F.lit("")).cast("binary"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaked),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
