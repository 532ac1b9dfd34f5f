"""The corpus pipeline: quality, near-duplicates, personal data, mixture, packing.

Every stage takes what the one before it kept and calls one operator of ``hourgrid.llm``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourgrid.llm import mixing, neardup, packing, pii, quality
from hourgrid.llm.queries import training_labels
from hourgrid.llm.scratch import Scratch, bound_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.  The model learns from the labelled rows of ``docs``."""
    bound_batches(spark)
    labels = training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, quality.fit_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of near-duplicates: one with the smallest doc_id, and of several such rows
    that with the smallest hash of all its columns.

    Texts that are linked with no other stay, whatever other texts their doc_id stands over; one row of those with
    the same words.  So does one row of each doc_id with texts without words, and every row without doc_id.
    """
    bound_batches(spark)
    marked, scratch = neardup.marked(docs).where("doc_id IS NOT NULL"), Scratch(spark, "near-duplicate-ids")
    known = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    known = scratch.save(known.where("n > 1 OR NOT kept"), "ids")
    repeated = known.where("n > 1 AND kept").select("doc_id")
    if repeated.isEmpty():
        return docs.join(known.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    classes = marked.where("kept").join(repeated, "doc_id", "left_semi").select("doc_id", F.col("node").alias("__node"), F.col("comp").alias("__comp")).distinct()
    several = neardup.with_class(docs.join(repeated, "doc_id", "left_semi").select(docs.columns))
    several = several.select("doc_id", "__node", F.struct(docs.columns).alias("__row")).join(classes, ["doc_id", "__node"])
    once = several.groupBy("doc_id", "__comp").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
    return docs.join(known.select("doc_id"), "doc_id", "left_anti").select(docs.columns).unionByName(once)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text; n_chars follows the text."""
    bound_batches(spark)
    return pii.redact(docs, pii.fit_field(pii.labelled_examples())).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the mixture's budgets, once for each epoch."""
    bound_batches(spark)
    return mixing.mix(docs, marks=False)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", sequence_packing),
]

#: The stages hold trained models, 64-bit hashes and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each stage's rows are written and read again, as the stages are run one by one."""
    scratch = Scratch(spark, "pipeline")
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{i}")
            if held:
                scratch.drop(held)
            held = f"stage-{i}"
    return docs
