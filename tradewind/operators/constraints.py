"""Constraints of a set of tables, checked in one scan of each table and one shuffle of all keys.

A row contributes its keys: as an owner to each key that its table declares, as a reference to the
key of each parent, and as an offender for each rule that it breaks. Keys of all tables meet in one
grouping, where a reference without an owner is an orphan and a second owner a duplicate. What tasks
send is summed per key before the shuffle, so a hot key is one row per task.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import union_all


@dataclass(frozen=True)
class Unique:
    """No two rows of a table have the same key. A key with a NULL is never a duplicate, as in SQL."""

    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    """The key of each child row has a parent. A key with a NULL passes, as in SQL."""

    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    """A condition on each row. NULL passes, as in SQL."""

    name: str
    table: str
    condition: Column


def not_null(table: str, columns: list[str]) -> list[Check]:
    return [Check(f"{table}.{c} not null", table, F.col(c).isNotNull()) for c in columns]


Constraint = Unique | ForeignKey | Check

_RULES = -1  # the domain of broken rules; others are keys
_OWNER = -1


def _given(columns: tuple[str, ...]) -> Column:
    given = F.lit(True)
    for c in columns:
        given &= F.col(c).isNotNull()
    return given


def _key(df: DataFrame, columns: tuple[str, ...], types: list[str]) -> Column:
    """The key as text. Values are brought to the owner's types first, so that equal ones have the same text."""
    own = dict(df.dtypes)
    cast = [c if own[c] == t else F.coalesce(F.col(c).try_cast(t).cast("string"), F.col(c).cast("string")) for c, t in zip(columns, types, strict=True)]
    return F.array(*[F.col(c).cast("string") if isinstance(c, str) else c for c in cast])


def _entry(domain: int, key: Column, slot: int, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(domain).alias("domain"), key.alias("key"), F.lit(slot).alias("slot")))


def violations(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """constraint, n_bad: rows beyond the first of a key, rows without a parent, rows that break a rule."""
    domains: dict[tuple[str, tuple[str, ...]], int] = {}
    slots: dict[int, int] = {}  # references to each domain so far
    names, entries = [], {}

    def domain(table: str, columns: tuple[str, ...]) -> int:
        if (table, columns) not in domains:
            domains[table, columns] = number = len(domains)
            key = _key(tables[table], columns, [dict(tables[table].dtypes)[c] for c in columns])
            entries.setdefault(table, []).append(_entry(number, key, _OWNER, _given(columns)))
        return domains[table, columns]

    for i, c in enumerate(constraints):
        if isinstance(c, Unique):
            names.append((c.name, domain(c.table, c.columns), None, None))
        elif isinstance(c, ForeignKey):
            number = domain(c.parent, c.parent_columns)
            slot = slots[number] = slots.get(number, -1) + 1
            key = _key(tables[c.child], c.columns, [dict(tables[c.parent].dtypes)[p] for p in c.parent_columns])
            entries.setdefault(c.child, []).append(_entry(number, key, slot, _given(c.columns)))
            names.append((c.name, number, slot, None))
        else:
            entries.setdefault(c.table, []).append(_entry(_RULES, F.array(F.lit(str(i))), _OWNER, ~F.coalesce(c.condition, F.lit(True))))
            names.append((c.name, _RULES, None, str(i)))

    rows = union_all([tables[t].select(F.inline(F.array_compact(F.array(*found)))) for t, found in entries.items()])
    wide = range(max(slots.values(), default=-1) + 1)
    references = [F.count_if(F.col("slot") == s).alias(f"_{s}") for s in wide]
    keys = rows.groupBy("domain", "key").agg(F.count_if(F.col("slot") == _OWNER).alias("owners"), *references)
    orphans = [F.sum(F.when(F.col("owners") == 0, F.col(f"_{s}")).otherwise(0)).alias(f"_{s}") for s in wide]
    rule = F.when(F.col("domain") == _RULES, F.get("key", 0)).alias("rule")
    totals = keys.groupBy("domain", rule).agg(
        F.sum("owners").alias("broken"), F.sum(F.greatest(F.col("owners") - 1, F.lit(0))).alias("repeated"), *orphans
    )
    # A row for each key and broken rule: no more than there are constraints.
    wanted = [
        F.struct(F.lit(n).alias("constraint"), F.lit(d).alias("domain"), F.lit(s).cast("int").alias("slot"), F.lit(r).cast("string").alias("rule"))
        for n, d, s, r in names
    ]
    listed = rows.sparkSession.range(1).select(F.inline(F.array(*wanted))).alias("w")
    same = (F.col("w.domain") == F.col("t.domain")) & F.col("w.rule").eqNullSafe(F.col("t.rule"))
    count = F.when(F.col("w.rule").isNotNull(), F.col("broken")).when(F.col("slot").isNull(), F.col("repeated"))
    for s in wide:
        count = count.when(F.col("slot") == s, F.col(f"_{s}"))
    found = listed.join(totals.alias("t"), same, "left")
    return found.select("constraint", F.coalesce(count, F.lit(0)).cast("bigint").alias("n_bad"))
