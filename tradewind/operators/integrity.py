"""Rows whose foreign key has a parent."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def keep_known(
    child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str] | None = None, allow_null: bool = False
) -> DataFrame:
    """Rows of ``child`` whose ``keys`` occur in ``parent``; with ``allow_null`` also those with a NULL key.

    A semi-join would shuffle every wide child row by its key, hot keys included. Here only distinct
    key values are shuffled, to find those without a parent, and their rows are dropped by an
    anti-join. The orphans are a written table: Spark knows its bytes and broadcasts it if it is
    small, as it is in sane data, and otherwise shuffles and splits hot keys by itself.
    """
    found = materialise(orphans(child, keys, parent, parent_keys), "orphans")
    kept = child if allow_null else child.dropna(subset=keys)
    # NULL never equals an orphan, so rows with a NULL key pass the anti-join.
    return kept.join(found, keys, "left_anti")


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str] | None = None) -> DataFrame:
    """The distinct key values of ``child``, without NULLs, that ``parent`` lacks."""
    values = parent.select(*[F.col(p).alias(k) for p, k in zip(parent_keys or keys, keys)])
    return child.select(*keys).dropna().distinct().join(values, keys, "left_anti")


# ── several parents in turn ─────────────────────────────────────────────────────────────────────

FAILED = "_failed"


@dataclass(frozen=True)
class Parent:
    """A foreign key: the child's columns, the parent and its columns, and whether a NULL key passes."""

    keys: list[str]
    table: DataFrame
    columns: list[str] | None = None
    allow_null: bool = False


def first_failing(child: DataFrame, parents: list[Parent]) -> DataFrame:
    """All rows of ``child``, with ``_failed``: the number, from 1, of the first parent that lacks the row's key, or 0.

    Stored, the rows that pass and the count of those that each key rejects come out of one table.
    As in ``keep_known``, only distinct values and orphans are shuffled by key; the marks are joined
    to the rows by what Spark chooses from the written orphans' size.
    """
    marked, failed = child, F.lit(0)
    for number, parent in reversed(list(enumerate(parents, 1))):
        found = materialise(orphans(child, parent.keys, parent.table, parent.columns), "orphans")
        mark = f"_orphan_{number}"
        marked = marked.join(found.withColumn(mark, F.lit(True)), parent.keys, "left")
        bad = F.col(mark).isNotNull()
        if not parent.allow_null:
            bad |= reduce(lambda a, b: a | b, [F.col(k).isNull() for k in parent.keys])
        failed = F.when(bad, number).otherwise(failed)
    return marked.select(*child.columns, failed.alias(FAILED))


def passed(marked: DataFrame) -> DataFrame:
    return marked.where(F.col(FAILED) == 0).drop(FAILED)


def failures(table: str, marked: DataFrame, parents: list[Parent], counted: str = "*") -> DataFrame:
    """table, key, n_rows (that the keys before it kept) and dropped, a row for each parent. Reads one column of a stored table.

    ``counted`` names a column without NULLs, such as a row number, by which the rows are counted.
    """
    counts = marked.groupBy(FAILED).agg(F.count(counted).alias("_n"))
    rows = []
    for number, parent in enumerate(parents, 1):
        reached = F.sum(F.when((F.col(FAILED) == 0) | (F.col(FAILED) >= number), F.col("_n")))
        dropped = F.sum(F.when(F.col(FAILED) == number, F.col("_n")))
        rows.append((F.lit("+".join(parent.keys)), reached, dropped))
    sums = counts.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"_{i}_{kind}") for i, r in enumerate(rows) for kind, c in enumerate(r[1:])])
    listed = [F.struct(F.lit(table).alias("table"), r[0].alias("key"), F.col(f"_{i}_0").alias("n_rows"), F.col(f"_{i}_1").alias("dropped")) for i, r in enumerate(rows)]
    return sums.select(F.inline(F.array(*listed)))
