"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import decontaminate, dedup, packing, pii, quality
from tremorlake.llm.runtime import remove_folder, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labelled ones of `documents`."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(table(spark, sf_dir, "documents"), labels, "quality", quality.fold("doc_id") != 0)
    scored = quality.score_quality(docs, model, threshold=0.3)
    return scored.where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return dedup.drop_near_duplicates(docs, spec=dedup.NearDuplicates(shingle=5, percent=80))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, by piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good_quality),
    ("near-duplicates", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Classifier, MinHash, alignment and packing cannot be told in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each returns is written in the shared folder and read by the next.

    The folder of a stage goes when that of the next one is written, the last one when the driver ends.

    Documents with a null or empty text have no words to judge, to copy or to leak: the classifier scores them by its bias, and
    where it keeps them they stay one piece each of the end id alone. Null ids are carried through all stages. Of rows
    that repeat an id all stay or go together with their document; very long texts are taken whole by every stage; of equal
    documents the one of the least id stays. Without labels every document counts as good; without a benchmark none leaks;
    without documents there are no rows. Further columns, whatever their names, are carried to the packing.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    remove_folder(spark, folder, at_exit=True)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
