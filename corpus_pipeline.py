"""The training-data pipeline: each stage calls one operator of ``echolens.llm`` on all that the
stage before has kept, and is written as Parquet and read again.

toxicity drops texts that score 0.7 or more; near_duplicates keeps the smallest id of each component;
decontamination drops contaminated texts and those that hold a whole window of a benchmark item; secrets
masks findings in the texts and sets n_chars anew; packing returns the pieces.

Edge cases: null and empty texts are clean, link with nothing, hold no secret and are packed as the end
id alone; repeated rows and null ids are treated row by row; an empty table gives empty tables; further
columns are kept by all stages but the last, whatever their names (but ``__rid``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import decontamination, ngram_join, queries, secrets, toxicity
from echolens.llm.common import materialise


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_uncontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs, secrets.fit(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]

#: Classifiers, tokens and components of all documents are not SQL; a test holds each stage's decisions
#: against its operator's results and a brute force of the near duplicates and the passages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
