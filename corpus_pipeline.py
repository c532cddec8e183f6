"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

All stages: an empty table gives an empty one; repeated rows are rows of their own; columns beside those of documents
are dropped, whatever their names; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotgrain.llm import bpe, jaccard_join, language_id, line_dedup, mixing
from dotgrain.llm.common import BATCH_BYTES, remainder, stage

#: Documents in a language that was learned stay if the network is at least so sure.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts, too) and those whose language isn't recognised. A null lang
    or source stays null; rows with a null doc_id are among those learned from."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    net = language_id.train(docs.where(remainder("doc_id", 4) != 2).select("text", "lang"))
    said = language_id.identify(docs.select(*COLUMNS), net)
    return said.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text. A null text stays null, with a null n_chars; of rows alike in doc_id
    all keep a line that this id keeps."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each class of near-duplicates: the one of least doc_id, a null id last. Null texts and texts
    without words stay."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it doesn't take go, as
    do texts without words. A null source is a source of its own. Copies stay next to each other."""
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.n_words())
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.where("copies > 0").withColumn("__copy", copies).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text: none for a null or empty text. Copies that lie together are encoded once."""
    path, pattern = bpe.default_vocabulary()
    coded = bpe.encode(docs.select(*COLUMNS), path, pattern, decoded="__decoded")
    same = F.col("__decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None  # learned languages, random rounding and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
