"""From documents to packed training sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. Each stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelake.llm.common import load, written
from bytelake.llm.decontam import decontaminate
from bytelake.llm.line_dedup import dedup_lines
from bytelake.llm.near_dedup import keep_one
from bytelake.llm.packing import pack
from bytelake.llm.queries import vocabulary
from bytelake.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts clean. It learns from the labels of two thirds of the documents.

    Null and empty texts have no offending token and stay, unless training knows no clean text. Null ids stay. Rows that repeat an id go if one of them is rejected. Ties: a score at the threshold is rejected.
    An empty table stays empty; without labels nothing is rejected. All columns pass through, whatever they are called.
    """
    return reject_toxic(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three of them share, but for one copy of each; n_chars is that of the new text. No document goes.

    Null texts come back as empty ones, empty texts stay. Of documents that share a line, the largest id keeps it; rows that repeat this id all do. Null ids count for nothing and lose shared lines. An empty table stays empty.
    All columns pass through, whatever they are called; n_chars only if documents have it.
    """
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near duplicates.

    Empty texts are copies of each other (null counts as empty), so one of them stays. Rows that repeat an id stay or go with it: of ids with several texts, all go if one text's class has a smaller id. Null ids stay.
    An empty table stays empty. All columns pass through, whatever they are called.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts, and texts or items of fewer tokens than the shortest seed, match nothing and stay. Rows that repeat an id go if one of them holds an item. Null ids stay: they cannot be named. Empty tables on
    either side change nothing. All columns pass through, whatever they are called.
    """
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, in sequences of at most 4096.

    Null and empty texts are the end id alone; null ids stay null; rows that repeat an id are packed each; an empty table gives no pieces. Other columns are ignored.
    """
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the toxicity model nor consistent sampling; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
