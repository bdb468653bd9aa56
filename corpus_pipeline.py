"""A corpus made ready for training: five stages over `documents`, each one an operator of chartline.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result
as Parquet and reads it again. The stages: documents whose language is rejected go; lines that are boilerplate
on their own site are cut (near copies count as one page there; documents that lose all their lines go); one document of each group of near
duplicates stays; documents that hold benchmark passages go; the rest is encoded, and decoded again.

What is kept has the columns of `documents`; n_chars follows the text. The last stage adds the ids, the
number of tokens and the decoded text. Null texts are rejected by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartline.llm import decontaminate, jaccard_join, language_id, line_dedup, piece_codec
from chartline.llm.flat import durable, forget
from chartline.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or whose two best are too close to tell, go."""
    docs = docs.select(*COLUMNS)
    fitted = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, fitted, out="_language")
    return found.where(~F.col("_language.rejected")).select(*COLUMNS)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines are cut from the texts; a document of nothing else goes."""
    docs = docs.select(*COLUMNS)
    # Near copies are one page to the count, else what a group shares would be cut before one of it can be kept.
    groups = jaccard_join.join(docs.select("doc_id", "text")).select("mark", "group").distinct()
    cut = line_dedup.drop_boilerplate(docs, groups=groups)
    kept = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"(?U)\S"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.find_leaks(docs.select(*COLUMNS), items, out="_leak")
    return found.where(F.col("_leak.n_hit") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text that they decode to."""
    coded = piece_codec.recode(docs.select(*COLUMNS), piece_model())
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_site_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

# Compression, MinHash and byte-pair merges are nothing that SQL can express; a test compares kept ids and texts with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared checkpoint folder and read again, the last one stays."""
    durable(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:  # what the stage read is not needed any more
            forget(spark, f"{folder}/{number - 1}")
    return docs
