"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, PII masking, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again for the next.

Defined results, for every stage: an empty table gives an empty result (empty ``labels`` or ``benchmark``: base rules
alone, nothing taken out); very long texts are treated whole; all columns of documents stay, also extra ones
whose names the operators use, but for the last stage. Row by row:

* quality_rules: null and empty texts go (too few words); a null lang is a stratum of its own; repeated rows are judged each;
* near_dedup: null, empty and blank texts are groups of one and stay; of a tie the smallest doc_id stays; rows
  that share a doc_id stay or go together; rows without doc_id stay;
* decontaminate: null and empty texts stay; repeated rows are judged each;
* mask_pii: null stays null; overlapping spans are masked together, under the kind that starts first;
* bpe: null text has no tokens; repeated rows give rows each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logscope.llm import decontam, neardup, pii, quality
from logscope.llm.common import table
from logscope.llm.queries import bpe_digest
from logscope.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned cutoffs."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return neardup.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the decoded text's digest."""
    return bpe_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_pii", mask_pii),
    ("bpe", encode),
]

# Stages use learned cutoffs, sketches, alignments and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
