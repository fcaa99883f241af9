"""Corpus pipeline over ``documents``: the stages of STAGES, in their order.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet under the shared checkpoint folder and the next stage
reads it back.
"""

from __future__ import annotations

from lensmap.llm import jaccard_join, line_rules, mixing, templates, token_ids
from lensmap.session import materialize


def quality(spark, docs, sf_dir):
    """Quality rules (6): rejected documents and over-frequent lines go."""
    return line_rules.keep_quality(docs)


def near_duplicates(spark, docs, sf_dir):
    """N-gram Jaccard join (7; five words, 0.8): one document of each group stays."""
    return jaccard_join.drop_near_duplicates(docs, k=5, num=80, den=100)


def decontaminate(spark, docs, sf_dir):
    """Benchmark decontamination (8): documents with a benchmark item go."""
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """Mixing sources to target weights (9): documents are repeated or thinned out."""
    return mixing.mix_sources(docs)


def token_output(spark, docs, sf_dir):
    """Token-ID output (2): Elias-Fano shards, read back."""
    return token_ids.token_files(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate),
          ("mixing sources", mix), ("token ids", token_output)]
ORACLE_SQL = None  # SQL has no byte-pair encoding; tests/llm compares with a brute-force version


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
