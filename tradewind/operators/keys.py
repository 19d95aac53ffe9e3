"""Dense numbering of rows over a total order, without ever sorting all rows in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import salted_join
from .storage import materialise

# monotonically_increasing_id() holds the partition number above the row number, which has 33 bits.
_ROW_BITS = 33


def dense_keys(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1..n in ``order``, which must tell all different rows apart.

    Rows are range-partitioned and sorted, and each row is written together with its place inside
    its partition. The key is that place plus the sizes of all earlier partitions. The written table
    makes this safe: partitions are cut at sampled bounds that a second run need not repeat.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()),
        name,
    )
    partition = F.shiftright("_place", _ROW_BITS).cast("int")
    sizes = placed.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_size"))
    # One row per range partition, so as many as spark.sql.shuffle.partitions says, in one small task.
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # Stored as one array by partition number, NULL for empty ones, which is looked up without a join, and only where the key is wanted.
    held = starts.agg(F.map_from_entries(F.collect_list(F.struct("_partition", "_offset"))).alias("_held"), F.max("_partition").alias("_last"))
    by_number = F.transform(F.sequence(F.lit(0), "_last"), lambda p: F.element_at("_held", p))
    offsets = materialise(held.select(by_number.alias("_offsets")), "offsets")
    key = offsets.scalar()[partition] + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    return placed.select(key.alias(name), *df.columns)


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str, nullable: list[str] = ()) -> DataFrame:
    """Add ``name``: 1..n inside each group, in ``order``, also for groups too large for one task.

    A row's rank is its key over (group, order) less the first key of its group. ``nullable`` names
    the group columns that may be NULL.
    """
    keyed = dense_keys(df, [*[F.col(g).asc_nulls_last() for g in group], *order], "_key")
    firsts = keyed.groupBy(*group).agg(F.min("_key").alias("_first"))
    return salted_join(keyed, firsts, group, "inner", ["_key"], nullable).select(
        *df.columns, (F.col("_key") - F.col("_first") + 1).alias(name)
    )
