"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Cases, for every stage: a null text is an empty one, which is neither toxic nor cut nor contaminated and stays null; rows without id
take part and are told apart by their texts; an empty table gives an empty one; whatever further columns there are come out as
they went in, whatever their names, of every stage but the last, whose columns are those of packing.pack().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, packing, simhash, suffix, toxicity
from quire.llm.base import table, written

#: No SQL: fingerprints, suffix arrays, a trained model and packing cannot be expressed in it; the tests use brute force.
ORACLE_SQL = None

#: Scores from here on are toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that a model of the labels that are not held out scores below TOXIC.

    The model learns from the base table's documents; scores are put beside each row in one scan, without a join.
    """
    model = toxicity.train_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of linked fingerprints one document: that of the least id, null ids last."""
    return simhash.survivors(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; documents of which no word remains go, if they had one.

    A cut may fall inside a character; what remains of it goes too.
    """
    return suffix.cut_texts(docs, drop_emptied=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
