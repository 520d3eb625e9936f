"""A training corpus from raw documents, in five stages.

toxicity: documents that the factorization machine rejects go. near_duplicates: one document of each
group of similar ones stays. decontamination: documents that hold a benchmark item go. mixing: sources
are taken by target weights, whole epochs and a seeded prefix. sharding: each document gets its shard
and slot. Every stage is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillscope.llm.common import kept, table
from tillscope.llm.decontaminate import stage_decontaminate
from tillscope.llm.jaccard import stage_near_duplicates
from tillscope.llm.mixing import stage_mix
from tillscope.llm.sharding import stage_shard
from tillscope.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("sharding", stage_shard),
]

#: The trained machine and the hash draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder. Empty tables give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
