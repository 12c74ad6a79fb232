"""From raw documents to packed sequences: quality, lines, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmodel.llm import line_dedup, near_dedup, packing, quality
from starmodel.sources.shared import keep, scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; all others, repeated rows among
    them, stay as they are. Null and empty texts are scored like any other."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good(docs, model, 0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents have go; `n_chars` counts what is left. A
    null text becomes empty; all rows stay, repeated ones too."""
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    new = {"text": F.col("_kept")} | ({"n_chars": F.length("_kept").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are alike by 0.8:
    that with the smallest id. Null, empty and blank texts are one group;
    repeated rows become one."""
    return near_dedup.first_of_each(docs, size=5, similarity=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in as few sequences of 1024 as can be. An empty text
    is a piece of the end id; an empty table gives no piece."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("quality", quality_filter),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack_sequences),
]

#: Learning and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch(spark):  # what a stage has written on its way goes when its result is written
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
