"""The corpus pipeline: STAGES over documents, each written before the next.

Every stage takes nulls in any column, repeated rows and ids, empty and very long
texts and tables without rows, and returns the columns of documents (the last
one its own), whatever other columns its input has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import jaccard, mixing, pii, sentencepieces, session, toxicity
from attestor.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on the labels, rejects go.

    Null and empty texts score as an empty sentence does; repeated rows stay or
    go alike; without labels of both kinds every score is their share.
    """
    docs = docs.select(*COLUMNS)
    machine = toxicity.learn(docs, session.read(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of the n-gram Jaccard join its least document stays.

    Texts without words are no copies of one another; rows that share an id
    stay or go together, rows without one stay.
    """
    session.prepare(spark)
    gone = jaccard.linked(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays")
    return docs.select(*COLUMNS).join(gone.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the text.

    Null texts stay null, with 0 characters; each row has its own result.
    """
    session.prepare(spark)
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as it is taken.

    Documents without words are taken 0 times; null sources are one source;
    repeated rows (of one id, source and size) are taken alike.
    """
    session.prepare(spark)
    copies = mixing.take(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    rows = docs.select(*COLUMNS, mixing.word_count().alias("size"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("d.source").eqNullSafe(F.col("c.source"))) & (F.col("d.size") == F.col("c.size"))
    taken = rows.alias("d").join(copies.alias("c"), same).select("d.*", "c.copies")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of its text with begin and end, their number, and the
    source bytes' start and end of each.  Null texts are empty ones."""
    session.prepare(spark)
    encoded = sentencepieces.encode(docs, vocabulary())
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "starts", "ends")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Neither the trained stages nor the draws of the mix can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are stored in the shared
    checkpoint folder before the next one reads them."""
    docs = session.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = session.stored(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
