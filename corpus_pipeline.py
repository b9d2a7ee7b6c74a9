"""A corpus pipeline of five stages, each by one operator of wayrisk.llm.

Every stage takes the documents that the one before kept and returns the
columns of documents, but for the last, which returns the packed pieces. An
empty table gives no rows in any stage; further columns of documents, of any
name and type, are kept with their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.llm import jaccard_join, line_dedup, mixing, packing, quality
from wayrisk.llm.queries import SOURCE_WEIGHTS
from wayrisk.llm.shared import all_columns, free_name, shared_table

LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is at least LEAST_QUALITY; null, empty and blank texts score 0 and go, ties stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name("score", docs)
    return quality.score(docs, model, name=name).where(F.col(name) >= LEAST_QUALITY).select(*all_columns(docs))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars follows the text."""
    lines, dropped = free_name("n_lines", docs), free_name("n_dropped", docs)
    clean = line_dedup.drop_boilerplate(docs, counts=(lines, dropped))
    chars = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", chars).select(*all_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (of rows that share it, the least row).

    Rows without an id and texts without words stay.
    """
    return jaccard_join.without_near_copies(docs, n=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it; rows that share an id are taken alike, texts without words never."""
    mix = mixing.plan(docs, F.array("source"), mixing.n_words(F.col("text")), lambda sizes: mixing.targets(sizes, SOURCE_WEIGHTS), present=F.col("text").rlike(mixing.WORD))
    rows = docs.select("doc_id", "source", "text", F.struct(*all_columns(docs)).alias("row"))
    return mixing.taken(rows, mix).select("row", F.explode("copies")).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages (a learned score, tokens), so tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
