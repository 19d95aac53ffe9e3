"""Equi-joins with NULL keys that match, and joins whose left side may hold very many rows of one key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str, nullable: list[str]) -> DataFrame:
    """Equi-join in which NULLs in the ``nullable`` key columns are equal. The keys of ``left`` are kept.

    Other keys are compared plainly, which lets the join use a partitioning that is already there.
    """
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        mine, other = left[c], renamed[f"_r_{c}"]
        condition &= mine.eqNullSafe(other) if c in nullable else mine == other
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str, spread_by: list[str], nullable: list[str] = (), salts: int = SALTS
) -> DataFrame:
    """Equi-join (inner, left or left_semi) that spreads each key of ``left`` over ``salts`` partitions.

    A left row's salt is a hash of ``spread_by``, the same whenever its task runs again. Right rows
    are repeated for each salt, so ``right`` must be narrow, with one or few rows per key.

    For joins on a key that ``right`` is already grouped by: there Spark would not shuffle it again,
    and adaptive execution splits a hot partition only if both sides come from a shuffle made for
    the join. With the salt both do, so what is still hot after salting is split further.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return null_safe_join(spread, copies, [*on, "_salt"], how, nullable).drop("_salt")
