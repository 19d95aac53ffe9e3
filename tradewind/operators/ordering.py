"""Stated row orders, top-k per group and one row per key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nulls_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, which must be total.

    Spark turns the filter on row_number into a group limit that runs before the shuffle, so a map
    task sends at most ``k`` rows per group and a hot group never reaches one task whole.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def keep_one(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the first in ``order``, by default in the order of all other columns."""
    if order is None:
        order = nulls_last(*[c for c in df.columns if c not in keys])
    return top_per_group(df, keys, order or nulls_last(*keys), 1)
