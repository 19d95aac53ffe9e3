"""Embed child rows as arrays in their owner's document."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed(items: DataFrame, owner: str, item: Column, name: str, key: Column, parts: int = 1) -> DataFrame:
    """One row per (owner, part) with the sorted array ``name`` of the owner's items.

    The layout is the caller's choice and the same for every owner, whatever its size: part is the
    item's number ``key`` modulo ``parts``. Readers always meet (owner, part). Set ``parts`` so that
    the largest owner's items over it fit a document; an owner has no more parts than items.
    """
    part = F.pmod(key, F.lit(parts)).cast("int").alias("part")
    return items.select(owner, part, item.alias("_item")).groupBy(owner, "part").agg(F.sort_array(F.collect_list("_item")).alias(name))
