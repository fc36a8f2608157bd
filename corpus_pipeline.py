"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, in order.
run() writes each stage as Parquet in the shared folder and reads it again for the next, after which it is deleted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.llm import bpe, decontaminate, linededup, quality, simhash
from stayflow.llm.common import BLANKS, free_name
from stayflow.sources.store import release, scratch, written


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """docs with another text and, where there is an n_chars, its length; `columns` in order."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; boilerplate lines of the others go."""
    out = free_name(docs, "quality")
    found = quality.rules(docs, out=out).where(F.col(f"{out}.kept"))
    return _with_text(found, docs.columns, F.col(f"{out}.text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and with them documents of which no word is left."""
    out = free_name(docs, "lines")
    found = linededup.remove_repeats(docs, out=out)
    left = (F.col(f"{out}.n_removed") == 0) | (F.btrim("text", F.lit(BLANKS)) != "")
    return _with_text(found.where(left), docs.columns, F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each document."""
    found = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_text=False)
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: SQL has no byte-pair encoding and no XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # what a stage has written for itself goes with it
            kept = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(kept)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
