"""A training corpus from raw documents: five stages, each one operator of ``proofline.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns the columns of
``documents``; the last returns the encoded corpus. Between stages the rows are written as Parquet and read
again, so that a lost executor costs the running stage only.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import bpe, language, lines, mixing, simhash
from proofline.llm.common import ensure_checkpoint_dir, fresh, held_out

#: A document whose nearest language is no nearer than this is in none of them.
LEAST_LIKENESS = 0.05
RANKS = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the rows that op3 learns from; texts without letters or like no language go.

    A null or empty text goes too; null lang, source and doc_id don't matter to a prediction, repeated rows stay or go together,
    and of languages that are equally near the first by name is taken. Other columns stay, whatever their names; without
    any row to learn from every row goes.
    """
    prototypes = language.learn_prototypes(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    lang, likeness = fresh(docs, "lang_pred"), fresh(docs, "score")
    told = language.predict_language(docs, prototypes, lang_pred=lang, score=likeness)
    return told.where((F.col(lang) != language.UNDETERMINED) & (F.col(likeness) >= LEAST_LIKENESS)).drop(lang, likeness)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is a site; texts lose their site's boilerplate lines, documents stay.

    A null source is a site; a null text stays null, one that loses all lines becomes empty, and n_chars is counted anew. Repeated
    rows and other columns stay.
    """
    cleaned = lines.drop_boilerplate(docs, n_lines=fresh(docs, "n_lines"), n_dropped=fresh(docs, "n_dropped")).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: within two bits, or alike by five words at 0.8 or more.

    It is the one with the smallest doc_id; a group without any id keeps one of its rows, and of repeated rows one stays. Null and
    empty texts are one group. Other columns stay.
    """
    return simhash.keep_one(docs, by_shingles=True).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As often as the mix takes them, in training order.

    Texts without words are taken by no mix, so they go, null ones too. A null source is a source; null and repeated ids are
    kept and tie by a hash of the text. Other columns are copied with their rows.
    """
    return mixing.in_training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and decoded, which is the text's bytes again.

    A null or empty text has no ids; rows are independent, so repeated ones give repeated rows. Other columns are left out.
    """
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern), ranks)
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL cannot express the first, third and last stage; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the tables between them are left in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
