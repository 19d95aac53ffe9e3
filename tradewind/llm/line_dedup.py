"""Removal of lines that stand on many sites.

Each line is counted by the sites it stands on. A HyperLogLog sketch per line hash is merged by the
aggregation, so a line that a third of all documents hold costs one sketch per task. A sketch far
from the threshold decides by itself; lines within ``band`` of it get an exact distinct count. With
``lg_k`` = 12 the standard error is 1.6 %, so a band of 25 % is some fifteen standard errors wide.

The first document (smallest id) that holds a boilerplate line keeps its first copy of it, so that
text which is on many sites because whole documents were copied stays in the corpus once. With
``keep_first=False`` no copy stays.

Defined results: lines are parted by ``\\n`` and compared without white space at their ends, by a
128-bit hash. Lines without a word are never counted or removed. NULL text stays NULL, with no
lines. A NULL site is no site. Rows with the same id count as one document; a NULL id is an id.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .columns import field, packed, trimmed_lines, unpacked

MIN_SITES = 10
BAND = 0.25
LG_K = 12


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _line_rows(docs: DataFrame) -> DataFrame:
    """Each different line of a document: id, site, h."""
    hashes = F.transform(F.array_distinct(F.array_remove(trimmed_lines(F.col("text")), "")), _hash)
    return docs.select("id", "site", F.explode(hashes).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """h and first (the smallest id that holds it) of each line on ``min_sites`` sites or more."""
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("id").alias("first"))
    spread = sketched.select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    wide = materialise(spread.where(F.col("sites") >= min_sites * (1 - band)), "wide-lines")
    near = wide.where(F.col("sites") <= min_sites * (1 + band))
    exact = (
        lines.join(near.select("h"), "h", "left_semi")
        .groupBy("h")
        .agg(F.countDistinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    far = wide.where(F.col("sites") > min_sites * (1 + band))
    return far.select("h", "first").unionByName(near.join(exact.select("h"), "h", "left_semi").select("h", "first"))


def remove_boilerplate(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    keep_first: bool = True,
) -> DataFrame:
    """``docs`` with ``text`` less its boilerplate lines, and new columns n_lines and n_removed."""
    lines = _line_rows(docs.select(F.col(id).alias("id"), F.col(site).alias("site"), F.col(text).alias("text")))
    spread = materialise(boilerplate(lines, min_sites), "boilerplate")
    found = (
        lines.select("id", "h")
        .join(spread, "h")
        .groupBy("id")
        .agg(
            F.collect_set("h").alias("_wide"),
            F.collect_set(F.when(F.col("id").eqNullSafe(F.col("first")), F.col("h"))).alias("_own"),
        )
        .select(F.col("id").alias("_id"), "_wide", "_own" if keep_first else F.array().alias("_own"))
    )
    joined = packed(docs).join(found, field(id).eqNullSafe(F.col("_id")), "left")
    hashes = F.when(F.col("_wide").isNotNull(), F.transform(trimmed_lines(field(text)), _hash))

    def stays(_, i):
        h = F.get("_hashes", i)
        first = F.array_contains("_own", h) & (F.array_position("_hashes", h) == i + 1)
        return ~F.array_contains("_wide", h) | first

    split = F.split(field(text), "\n")
    parts = joined.withColumns({"_hashes": hashes, "_split": split}).withColumn(
        "_kept", F.when(F.col("_wide").isNull(), F.col("_split")).otherwise(F.filter("_split", stays))
    )
    n_lines, n_kept = (F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)) for c in ("_split", "_kept"))
    outputs = {
        text: F.array_join("_kept", "\n"),
        "n_lines": n_lines.cast("long"),
        "n_removed": (n_lines - n_kept).cast("long"),
    }
    return unpacked(parts, docs.columns, outputs)
