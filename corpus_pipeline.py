"""A training-data pipeline over ``documents``: identify languages, drop near-duplicates, mask secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
``documents``; the last returns one row per mixed document with its token ids and their spans of source bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import language_id, mixing, secrets, sentencepieces, simhash
from lodestrata.llm.common import save, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the documents' own labels; texts without a language, of several in even parts, or of unsure words go."""
    return language_id.keep_identified(docs.select(*COLUMNS), language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mask in the text; the document stays and n_chars follows."""
    masked = secrets.redact(docs.select(*COLUMNS), secrets.fit(docs))
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit(secrets.MASK)), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.apply_mix(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, each piece's span of source bytes, and whether decoding gives the text back. A document that the mix repeats is
    coded once: its repeats follow one another."""
    coded = sentencepieces.encode(docs, sentencepieces.default_model(), carry=("text",))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Label models, cube sampling and segmentation aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; between them the documents are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"pipeline-{name}")
    return docs
