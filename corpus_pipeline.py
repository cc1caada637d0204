"""The corpus pipeline: documents through five operators, each stage written and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last returns the mix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import checkpoint_dir
from papyra.llm.decontaminate import decontaminate
from papyra.llm.line_dedup import dedup_lines, one_of_each
from papyra.llm.mixing import cyclic_weights, mix
from papyra.llm.near_duplicates import keep_one
from papyra.llm.toxicity import REJECT, fit, learnable, score_toxicity


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], kept, **replaced) -> DataFrame:
    """The rows that `judge` (which adds columns) keeps, with the columns of docs; columns of docs that have the
    name of an added one are set aside meanwhile."""
    own = {c: f"_own_{n}" for n, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = judge(docs.withColumnsRenamed(own)).where(kept)
    return out.select([replaced.get(c, F.col(own.get(c, c))).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is REJECT or more."""
    labels = learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = fit(docs, labels)
    return _judged(docs, lambda d: score_toxicity(d, model), F.col("toxicity") < REJECT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten different texts or more: copies of a document count once, so that near_duplicates gets
    them whole. Documents stay, with an empty text if nothing is left."""
    text = F.col("kept_text")
    return _judged(docs, lambda d: dedup_lines(d, counted=one_of_each(d)), F.lit(True), text=text, n_chars=F.length(text).cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _judged(docs, lambda d: decontaminate(d, items), F.col("n_hit") == 0)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left, and the words that it takes from it."""
    return mix(docs, cyclic_weights(docs)).withColumn("taken", F.col("copies") * F.col("size"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the classifier; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents. What each stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
