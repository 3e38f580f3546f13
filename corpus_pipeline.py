"""A corpus pipeline of the llm operators: toxicity, near duplicates, repeated passages, benchmark decontamination, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridelta.llm.byte_bpe import stage_byte_bpe
from veridelta.llm.common import stored
from veridelta.llm.decontamination import stage_decontamination
from veridelta.llm.ngram_join import stage_ngram_join
from veridelta.llm.passages import stage_repeated_passages
from veridelta.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("n-gram Jaccard join", stage_ngram_join),
    ("substring dedup", stage_repeated_passages),
    ("benchmark decontamination", stage_decontamination),
    ("byte-level BPE", stage_byte_bpe),
]
#: Several stages can't be said in SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), "snappy")
    return docs
