"""Reports on tables: cleaning audit, row counts, differences."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def audit(table: str, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: table, raw, cleaned, dropped. Both counts are taken by executors from the frames given.

    Observed metrics would save a pass, but tasks that run again after a loss would count twice.
    """
    counts = raw.agg(F.count("*").alias("raw"), F.lit(0).cast("bigint").alias("cleaned")).unionByName(
        cleaned.agg(F.lit(0).cast("bigint").alias("raw"), F.count("*").alias("cleaned"))
    )
    return counts.agg(F.sum("raw").alias("raw"), F.sum("cleaned").alias("cleaned")).select(
        F.lit(table).alias("table"), "raw", "cleaned", (F.col("raw") - F.col("cleaned")).alias("dropped")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n for each table, vertex label or edge type."""
    return union_all([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of NULLs in each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


# ── differences ─────────────────────────────────────────────────────────────────────────────────


def compared(expected: DataFrame, result: DataFrame) -> DataFrame:
    """One row: n_rows expected, and n_diff rows that one side holds more often; both from one aggregation."""
    columns = result.columns
    signed = (
        expected.select(*columns, F.lit(1).alias("_sign"), F.lit(1).alias("_expected"))
        .unionByName(result.select(*columns, F.lit(-1).alias("_sign"), F.lit(0).alias("_expected")))
        .groupBy(*columns)
        .agg(F.sum("_sign").alias("copies"), F.sum("_expected").alias("rows"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return signed.agg(total("rows").alias("n_rows"), total(F.abs("copies")).alias("n_diff"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the two frames do not hold equally often, with ``copies`` = left less right.

    One aggregation with map-side sums, where exceptAll both ways would shuffle both frames twice.
    """
    columns = left.columns
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.select(*columns).withColumn("_sign", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("_sign").alias("copies")).filter(F.col("copies") != 0)
