"""From raw documents to packed training sequences.

Each stage takes all that the stage before kept, calls one operator of
``confluo.llm`` and returns what it keeps, with the columns of ``documents``;
the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import language_id
from confluo.llm.decontaminate import decontaminate
from confluo.llm.line_dedup import dedup_lines
from confluo.llm.minhash_dedup import near_duplicates
from confluo.llm.packing import pack_documents
from confluo.llm.queries import tokenizer_path

#: A document below this share of letters in its language, times the certainty of that, is a jumble and goes.
MIN_LANGUAGE_SCORE = 0.2


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' columns, with the length of the text as it is now."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select(*[F.col(f"`{c}`") for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels each document with its language; those without a letter or without a clear language go."""
    model = language_id.fit(docs)
    found = docs.withColumn("__found", language_id.labels(model, F.col("text"), spans=False))
    kept = found.where((F.col("__found.lang") != language_id.UNDETERMINED) & (F.col("__found.score") >= MIN_LANGUAGE_SCORE))
    return _as_documents(kept.withColumn("lang", F.col("__found.lang")), docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of lines; a document of which no line is left goes."""
    out = dedup_lines(docs)
    return _as_documents(out.where("n_removed = 0 or n_removed < n_lines"), docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near duplicates (one row of repeated ones, null ids last)."""
    found = near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    gone = found.where("not leads").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    once = docs.dropDuplicates(["doc_id", "text"])
    same = once["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(once["text"], F.lit(""))) == gone["gone_text"])
    return _as_documents(once.join(gone, same, "left_anti"), docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; a document that mostly consists of them goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as_documents(decontaminate(docs, items, window=10, max_coverage=0.5), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("benchmark", remove_benchmark),
    ("packing", pack),
]

#: The stages have trained models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again."""
    from confluo.plans.scratch import Scratch

    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
