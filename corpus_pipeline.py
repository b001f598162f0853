"""Corpus pipeline: quality rules, line dedup, near-dedup, source mix, tokens. Each stage works on all rows that the one
before kept, written as Parquet to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm import bpe, line_dedup, mixing, near_copies, quality
from reelmill.llm._shared import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in several documents stay in the first of them only; n_chars follows the text."""
    done = line_dedup.line_dedup(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more. Ball hashing of
    SimHash fingerprints proposes pairs, bands those beyond its radius; the exact similarity decides."""
    return near_copies.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row, with its decoded text's digest. Blocks are small, as the executors have run four
    stages before."""
    return bpe.report(docs, bpe.Params(block_chars=2_000_000))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_shared_lines),
    ("near dedup", near_dedup),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL has no zstandard and no tokenizer; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, in order."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
