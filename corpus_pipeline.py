"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing; each stage written and reread.

Clean documents stay through the filtering stages. Mixing repeats and leaves out documents as its targets ask, so the
last two stages may see a doc_id several times. The last stage returns the packed pieces of all that is left. Extra columns
are carried as far as mixing, whatever their names; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import line_dedup, mixing, near_dedup, packing, toxicity
from riskspark.llm.common import scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not reject; the model is fitted on the labels of this stage's own input.

    Null and empty texts have no hit and stay, unless the labels alone make all texts toxic; repeated rows are judged alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # a row's own names clash with nothing
    return toxicity.judged(rows, model).where("predicted = 0").select("_row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that at least ten of them share; n_chars follows the text.

    No row goes: a text whose lines all go is empty, a null text stays null. Each repeated row counts as a document.
    """
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    The least doc_id stays, nulls last. Null and empty texts are linked with nothing; of rows equal in doc_id and text one stays.
    """
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is one of its own; rows without words stay as they are; ties go by a seeded hash of doc_id.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null or empty text is a piece of the end id alone."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Trained scores, sketches and tokens have no SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, folder)
    return docs
