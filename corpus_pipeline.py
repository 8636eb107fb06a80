"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import mixing, sentencepiece, simhash, substring, toxicity
from emberlog.llm.shared import cut, discard, n_words, table


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its texts are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, doesn't hold to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).where("NOT toxic").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest doc_id (nulls last), of equal ones the first by all columns.

    Rows belong to components by their texts: rows without a doc_id, or with that of another row, stay if no near copy does.
    """
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another one keeps, and one row of equal texts of 50 words or more."""
    return _measured(substring.without_passages(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last one of a source ends where its budget does."""
    mixed = mixing.mix(cut(docs.withColumn("__size", n_words("text"))), size="__size")
    return _measured(mixing.repeat_taken(mixed).select(*docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of the text, with whether they decode to it."""
    pieces = sentencepiece.Pieces.load()
    back = sentencepiece.decode(sentencepiece.encode(docs.select("doc_id", "source", "text"), pieces), pieces)
    return back.select("doc_id", "source", F.size("pieces").alias("n_pieces"), "pieces", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Models, components and verified passages are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; what a stage has read is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = cut(stage(spark, docs, sf_dir))
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
