"""Change sets as pure functions of tables: old rows and changes in, new rows out.

Each rewrites at most the partitions its caller overwrites; keys are matched by hash or sort-merge joins and windows that
partition by the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def keep_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in `order` (which should end in a unique column)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in `order`; `order` must be plain columns."""
    return keep_first(rows, keys, *[c.desc() for c in order])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` rows (unique by key) replace those of `old`; the rest stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Insert rows of `new` that `old` lacks; for the others take over `columns` only."""
    both = old.withColumn("__o", F.lit(True)).alias("o").join(new.withColumn("__n", F.lit(True)).alias("n"), keys, "full_outer")
    pick = lambda c: F.when(F.col("__o").isNull() | (F.col("__n").isNotNull() & F.lit(c in columns)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Add rows of `new` whose key `old` lacks; of equal new keys the first in `order`."""
    return old.unionByName(keep_first(new, keys, *order).join(old.select(*keys), keys, "left_anti"))


def partial_unique(old: DataFrame, new: DataFrame, keys_of: dict[str, list[str]], kind: str, *order: Column) -> DataFrame:
    """`new` with `accepted`: rows of each kind are unique by that kind's own key, against `old` and among themselves."""
    parts = []
    for value, keys in keys_of.items():
        own = new.where(F.col(kind) == value)
        taken = old.where(F.col(kind) == value).select(*keys).distinct().withColumn("__taken", F.lit(True))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        parts.append(own.withColumn("__n", rank).join(taken, keys, "left").withColumn("accepted", F.col("__taken").isNull() & (F.col("__n") == 1)).select(*new.columns, "accepted"))
    return reduce(DataFrame.unionByName, parts)


def _inside(scope: dict) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in scope.items() if v is not None], F.lit(True))


def delete_scope(rows: DataFrame, **scope) -> DataFrame:
    """Rows outside the scope: equality on each given column that isn't None."""
    return rows.where(~_inside(scope))


def delete_scope_counts(rows: DataFrame, by: str, **scope) -> DataFrame:
    """For each value of `by` the rows that delete_scope keeps and drops; a value whose rows all go has kept 0."""
    inside = _inside(scope)
    return rows.groupBy(by).agg(F.count_if(~inside).alias("kept"), F.count_if(inside).alias("dropped"))


def change_status(rows: DataFrame, status: Column, now: Column, terminal: tuple[str, ...], stamp: str, notes: Column | None = None) -> DataFrame:
    """Set a new status where one is given; terminal states stamp `now`; other states keep the stamp; notes fill only if given."""
    out = rows.withColumn(stamp, F.when(status.isin(*terminal), now).otherwise(F.col(stamp))).withColumn("status", F.coalesce(status, F.col("status")))
    return out if notes is None else out.withColumn("triage_notes", F.coalesce(notes, F.col("triage_notes")))


def where_given(rows: DataFrame, **equal) -> DataFrame:
    """Conjunction of the filters that are given; each reaches the scan as a pushed predicate."""
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == kv[1]), equal.items(), rows)


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page of an ordered result; negative limits and offsets count as 0."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(max(limit, 0))


def insert_rows(old: DataFrame, new: DataFrame, **defaults) -> DataFrame:
    """Append rows; a column that is null or absent in `new` gets its default."""
    for name, value in defaults.items():
        new = new.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in new.columns else F.lit(value))
    return old.unionByName(new, allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, **scope) -> DataFrame:
    """All rows of the scope anew: what `old` has outside it, and those of `new` (which must lie inside; others are left out)."""
    return delete_scope(old, **scope).unionByName(new.where(_inside(scope)))


def migrate(old: DataFrame, column: str, value, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an older layout with a new column of one value; rows whose parent is gone are left behind."""
    return old.join(parents.select(*keys), keys, "left_semi").withColumn(column, F.lit(value))


#: Default and most rows of each kind of list.
LIMITS = {"search": (20, 100), "list": (100, 1000), "feedback": (50, 200), "annotations": (50, 200)}


def clamp(kind: str, limit: int | None = None) -> int:
    """Rows that a list of this kind gives: its default where none is asked for, its most where more are; never below 0."""
    default, most = LIMITS[kind]
    return max(0, min(default if limit is None else limit, most))


def clamped(kind: str, limit: Column) -> Column:
    """clamp() for limits in a column; null asks for the default."""
    default, most = LIMITS[kind]
    return F.greatest(F.lit(0), F.least(F.coalesce(limit, F.lit(default)), F.lit(most)))


def outcome(rows: DataFrame, failed: Column) -> DataFrame:
    """completed, errors and succeeded of a run's items."""
    return rows.agg(F.count(F.lit(1)).alias("completed"), F.count_if(failed).alias("errors")).select("completed", "errors", (F.col("completed") - F.col("errors")).alias("succeeded"))


def require_resolved(rows: DataFrame, unresolved: Column, most: float = 0.2) -> DataFrame:
    """The rows, if at most this part of them is unresolved; otherwise ValueError."""
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if(unresolved)).first()
    if n and bad / n > most:
        raise ValueError(f"{bad} of {n} rows are unresolved")
    return rows


def without_fields(rows: DataFrame, *names: str) -> DataFrame:
    """The rows without the named fields, in nested structures as well."""

    def bare(value: Column, kind) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[bare(value[f.name], f.dataType).alias(f.name) for f in kind if f.name not in names])
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: bare(x, kind.elementType))
        return value

    return rows.select(*[bare(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema if f.name not in names])
