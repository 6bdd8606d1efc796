"""The corpus pipeline: stages over ``documents``, each on what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and reread as the next one's input. All but the last return
the columns of documents, whatever further columns there are, and all give an
empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm import decontaminate, hyperminhash, pieces, suffixes, toxicity
from inkvane.llm.common import Workspace
from inkvane.llm.queries import table, vocabulary

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, does not reject.

    Null and empty texts are not toxic and stay; rows are decided one by one,
    repeated rows alike; without labels of both classes all stay.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (Jaccard of 0.8 or more): the one with the smallest id.

    Rows that repeat an id are one document, and stay or go together. Texts
    without words, and rows with a null id, are in no group and stay.
    """
    ws = Workspace(spark, "pipeline")
    gone = ws.save(hyperminhash.near_duplicates(docs, percent=80).filter("not kept").select(F.col("doc_id").alias("_k")).distinct(), "copies")
    return docs.join(gone, docs["doc_id"] == gone["_k"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first, in order of (id, hash of the text, place).

    Rows equal in id and text are cut alike; null and short texts and rows with a
    null id stay as they are; documents of which nothing is left go.
    """
    return suffixes.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited.

    Null and empty texts and rows with a null id stay; of rows that share an id
    only those whose text leaks go; all texts of a repeated item count.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of the texts that are left, row by row; null and empty texts have none."""
    return pieces.sentence_pieces(spark, docs, vocabulary(PIECES))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("decontamination", drop_leaks), ("sentencepiece", to_pieces)]

#: SQL can express neither the fitted model nor alignments and best paths; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
