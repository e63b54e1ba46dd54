"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets all that the one before it kept. run() writes what a stage
returns to the shared folder and rereads it as the next stage's documents;
what a stage was given goes once what it returns is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import curriculum, lines, near, packing, toxicity
from tessera.llm.common import materialize, release, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, doesn't reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = toxicity.judge(docs, model, names=("__severity", "__grade", "__toxic"))
    return judged.where("not __toxic").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share (but for the last that holds them)."""
    kept = lines.dedup_lines(docs, names=("__kept", "__lines_all", "__dropped"))
    less = F.col("__dropped") > 0
    changed = kept.withColumn("n_chars", F.when(less, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars")))
    return changed.withColumn("text", F.when(less, F.col("__kept")).otherwise(F.col("text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more."""
    return near.deduplicated(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in training order; those it takes twice are there twice."""
    return curriculum.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
#: Regression and sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
