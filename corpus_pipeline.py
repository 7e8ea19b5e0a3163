"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All stages but the last return the columns of
``documents``; a document that the mixing stage repeats is repeated with its doc_id.

Defined results: rows whose text is null or has no letter go in the first stage, whatever their other columns hold; a null
doc_id, lang or source is a value like another; where no row names a language, all texts with a letter stay. Of repeated
rows and of ties one stays (the longest, then the smallest doc_id, null last, then the first row). A source of a single row is mixed like any other.
An empty table gives no pieces. Extra columns are carried up to the packing stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import delete, scratch
from plumbline.llm.exact_dedup import keep_exact
from plumbline.llm.language import keep_identified, training_rows
from plumbline.llm.mixing import mix
from plumbline.llm.packing import pack
from plumbline.llm.simhash import keep_near


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the machines do not identify go: those without a letter, and those with a score below ``language.SURE``."""
    return keep_identified(docs, training_rows(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays."""
    return keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more, chained) stays, the one with the smallest doc_id."""
    return keep_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of the output; the order is global and random."""
    return mix(docs).select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their ids."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: Fingerprints, learned machines and byte-pair ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``. Tables between them stand in the checkpoint folder; one
    goes when the next is written, the last stays for the result to read."""
    folder = scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs
