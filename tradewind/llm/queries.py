"""The queries of this subpackage: each applies its operator to a whole table of the folder given."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fm_index, suffix_levels, toxicity
from .columns import read
from .decontaminate import mark_contaminated
from .licenses import scan_licenses
from .line_dedup import remove_boilerplate
from .oracle import ORACLE
from .ppm import score_texts
from .quality import COUNTS, apply_rules
from .simhash import near_duplicates
from .spelling import dropped_letter, spelling_variants
from .topk import top_k
from .whitening import whiten

__all__ = ["ORACLE", "QUERIES"]


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    scored = score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = remove_boilerplate(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, docs, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    digests = ids.select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )
    decoded = bpe.decode(digests, path, pattern)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_levels.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = F.size("starts").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    marked = mark_contaminated(docs.select("doc_id", "text"), items)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = scan_licenses(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", "license", "cosine", "is_license_file", "inherited_from")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), edit=dropped_letter)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ppm,
        op2_line_dedup,
        op3_fm_index,
        op4_simhash,
        op5_toxicity,
        op6_quality_rules,
        op7_bpe,
        op8_suffix_levels,
        op9_decontaminate,
        op10_licenses,
        op11_spelling,
        op12_top_k,
        op13_whitening,
    )
}
