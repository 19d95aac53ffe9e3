"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

1. quality rules: documents that break a rule go.
2. line dedup: lines that stand on many sources go; one copy of each stays, with its first document.
3. SimHash near-dedup: of each group of near copies the document with the least id stays.
4. benchmark decontamination: documents that hold a window of a benchmark item go.
5. byte-level BPE: the texts that are left as token ids, decoded again as a check.

Each stage takes all documents that the one before kept, and all but the last return the columns of
``documents``; ``n_chars`` follows the text.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import bpe
from tradewind.llm.columns import read
from tradewind.llm.decontaminate import mark_contaminated
from tradewind.llm.line_dedup import remove_boilerplate
from tradewind.llm.quality import quality_filter
from tradewind.llm.simhash import drop_near_duplicates
from tradewind.operators.storage import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = mark_contaminated(docs, read(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern), path, pattern)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# SQL has no SimHash and no BPE; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
