"""Corpus pipeline: quality rules, near-duplicate removal, repeated-passage removal, mixing, packing."""

from __future__ import annotations

from cytospark.llm import mixing, neardup, packing, quality, repeats

#: (name, function(spark, docs, sf_dir)); each works on all its predecessor kept.
STAGES = [
    ("quality_rules", quality.keep),
    ("near_dedup", neardup.keep),
    ("substring_dedup", repeats.clean),
    ("source_mixing", mixing.take),
    ("best_fit_packing", packing.sequences),
]

#: Learning and local search are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
