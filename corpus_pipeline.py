"""A training corpus from raw documents: stages, each working on all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession, functions as F

from cuegrid.llm import dart, language, packing, recompress, secrets
from cuegrid.session import shared_folder

#: Columns that every stage but the last returns.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its main language has a smaller share of it than this.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language: those without letters go, and those that no language has half of.
    The model learns from what is labelled among these documents."""
    seen = language.predict(docs.select(*DOCUMENT), language.train(docs), shares=False)
    return seen.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*DOCUMENT)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of near duplicates, that with the smallest doc_id; repeated rows are
    one. A doc_id with unlike texts keeps a row of each. A null doc_id is in no class and stays."""
    first = dart.text_classes(docs).groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(first, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.unionByName(keyed.where(F.col("doc_id").isNull())).select(*DOCUMENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a smaller doc_id has; a text that loses nothing stays
    as it is, one that loses every word goes."""
    seen = recompress.dedup(docs)
    cut = F.col("n_removed") > 0
    return seen.where(~cut | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by its kind in angle brackets."""
    return secrets.redact(docs).select(*DOCUMENT)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the kept texts with their sequences."""
    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("minhash_near_dedup", minhash_near_dedup), ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Labelling words and cutting texts into tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written as Parquet into the folder that
    ``spark.checkpoint.dir`` names and read again, so that a lost executor costs one stage. The
    folders ``pipeline-*`` and ``scratch-*`` there may go once the returned rows are stored. Columns
    of documents other than those of `DOCUMENT` are left behind by the first stage."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
