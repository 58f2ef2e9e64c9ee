"""From raw documents to pieces: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir), returns a DataFrame that is written as Parquet, and is handed the table
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm.common import fresh, small, stage, table
from tideline.llm.decontaminate import uncontaminated
from tideline.llm.langid import UNKNOWN, identify, train
from tideline.llm.near_dups import near_duplicates
from tideline.llm.pieces import encode_pieces
from tideline.llm.secrets import redact_secrets

LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or in no language to at least LEAST_SCORE, go."""
    names = (fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score"))
    told = identify(docs, train(docs), keep=tuple(docs.columns), names=names)
    return told.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup, five words and 0.8: of each group one row of least doc_id stays, of equal rows one.

    A row is known by its doc_id and a digest of its text, so that rows of one doc_id and unlike texts are judged each
    by its own. Rows without doc_id belong to no group and stay. What goes is few beside what stays: keys that go are
    taken out of docs by an anti join, broadcast as long as it is small, and only rows that are repeated word for word
    are grouped.
    """
    mark = fresh([*docs.columns, "doc_id", "n_shingles", "component_id", "kept", "component_tag", "n"], "mark")
    named = docs.withColumn(mark, F.xxhash64(F.col("text").isNull(), "text"))
    key = ["doc_id", mark]
    found = stage(near_duplicates(named.where(F.col("doc_id").isNotNull()), width=5, percent=80, keep=(mark,)).groupBy(*key, "n_shingles", "kept", "component_tag").count(), "found")
    firsts = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id", "component_tag").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high")
    beaten = found.where("kept").join(firsts, ["doc_id", "component_tag"]).where(F.col(mark) != F.col("low"))
    gone = stage(found.where(~F.col("kept")).select(*key).unionByName(beaten.select(*key)), "gone")
    repeated = stage(found.where("count > 1").select(*key).join(gone, key, "left_anti"), "repeated")
    once = named.join(small(gone), key, "left_anti").join(small(repeated), key, "left_anti")
    one_each = named.join(small(repeated), key, "left_semi").dropDuplicates(key)
    return once.unionByName(one_each).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows that hold a test item go, with and without doc_id."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every document stays, its secrets are replaced by a mark."""
    return redact_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: pieces, scores and round trip of each document."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), n=4)


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("secret_scans", redacted),
    ("sentencepiece", encoded),
]

#: Learned languages, sketches and lattices can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
