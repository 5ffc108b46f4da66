"""How a table changed: rows inserted, deleted and updated."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.model import check_schemas_equal, types
from kinweave.runtime import materialize


def fields_of(df: DataFrame, column: str) -> list[str]:
    return [f.name for f in df.schema[column].dataType.fields]


def is_changed(df: DataFrame, column: str) -> Column:
    """The values before and after differ (null equals null), or one of them isn't there."""
    if set(fields_of(df, column)) != {"before", "after"}:
        return F.lit(True)
    return ~F.col(column)["before"].eqNullSafe(F.col(column)["after"])


def value_change(before: Column, after: Column) -> Column:
    """remained_null, became_null, became_nonnull, unchanged or changed."""
    return F.when(before.isNull() & after.isNull(), "remained_null").when(after.isNull(), "became_null").when(before.isNull(), "became_nonnull").when(before == after, "unchanged").otherwise("changed")


def schema_change(df: DataFrame, column: str) -> str:
    """added, removed, unchanged or type_changed."""
    kinds = {f.name: f.dataType for f in df.schema[column].dataType.fields}
    if "before" not in kinds or "after" not in kinds:
        return "added" if "after" in kinds else "removed"
    return "unchanged" if kinds["before"] == kinds["after"] else "type_changed"


@dataclass(frozen=True)
class Updates:
    """Rows that changed: each column is a struct of its value before and after; of new and dropped columns only one of both.

    schema: "exactly" (all columns have both, of one type), "names" (all have both) or "lax".
    """

    df: DataFrame
    schema: str = "exactly"

    def __post_init__(self) -> None:
        if self.schema not in ("exactly", "names", "lax"):
            raise ValueError(f"schema is 'exactly', 'names' or 'lax', not {self.schema!r}")
        for c in self.df.columns:
            kind = schema_change(self.df, c)
            if self.schema != "lax" and (kind in ("added", "removed") or (self.schema == "exactly" and kind == "type_changed")):
                raise ValueError(f"the column {c} was {kind}")

    @classmethod
    def from_tables(cls, before: DataFrame, after: DataFrame, join_on: str | list[str], schema: str = "exactly") -> Updates:
        """Rows of equal keys side by side, changed or not; the columns of `before` come first."""
        keys = [join_on] if isinstance(join_on, str) else list(join_on)
        a, b = before.toDF(*[f"b__{c}" for c in before.columns]), after.toDF(*[f"a__{c}" for c in after.columns])
        met = a.join(b, reduce(lambda x, y: x & y, [F.col(f"b__{k}") == F.col(f"a__{k}") for k in keys]))
        columns = [*before.columns, *[c for c in after.columns if c not in before.columns]]

        def both(c: str) -> Column:
            parts = [F.col(f"b__{c}").alias("before")] if c in before.columns else []
            return F.struct(*parts, *([F.col(f"a__{c}").alias("after")] if c in after.columns else [])).alias(c)

        return cls(met.select(*map(both, columns)), schema)

    @classmethod
    def from_before_after(cls, df: DataFrame, before: str, after: str, schema: str = "exactly") -> Updates:
        """From two struct columns of a table."""
        x, y = fields_of(df, before), fields_of(df, after)

        def both(c: str) -> Column:
            parts = [F.col(before)[c].alias("before")] if c in x else []
            return F.struct(*parts, *([F.col(after)[c].alias("after")] if c in y else [])).alias(c)

        return cls(df.select(*map(both, [*x, *[c for c in y if c not in x]])), schema)

    def _side(self, side: str) -> DataFrame:
        return self.df.select(*[F.col(c)[side].alias(c) for c in self.df.columns if side in fields_of(self.df, c)])

    def before(self) -> DataFrame:
        return self._side("before")

    def after(self) -> DataFrame:
        return self._side("after")

    def before_values(self) -> dict[str, Column]:
        return {c: F.col(c)["before"] for c in self.df.columns if "before" in fields_of(self.df, c)}

    def after_values(self) -> dict[str, Column]:
        return {c: F.col(c)["after"] for c in self.df.columns if "after" in fields_of(self.df, c)}

    def any_changed(self) -> Column:
        return reduce(lambda a, b: a | b, [is_changed(self.df, c) for c in self.df.columns], F.lit(False))

    def changed(self) -> Updates:
        return Updates(self.df.where(self.any_changed()), self.schema)

    def filter(self, keep: Column) -> Updates:
        return Updates(self.df.where(keep), self.schema)

    def value_change_counts(self) -> DataFrame:
        """Columns column, change and n."""
        each = [F.struct(F.lit(c).alias("column"), value_change(F.col(c)["before"], F.col(c)["after"]).alias("change")) for c in self.df.columns if set(fields_of(self.df, c)) == {"before", "after"}]
        return self.df.select(F.explode(F.array(*each)).alias("x")).groupBy("x.column", "x.change").agg(F.count("*").alias("n"))

    def apply_to(self, df: DataFrame, defaults: dict[str, Any] | None = None) -> DataFrame:
        """df with the rows before replaced by those after; a column that is added needs a default for the other rows."""
        before, after = self.before(), self.after()
        rest = df.exceptAll(before.select(*df.columns))
        kept = [c for c in df.columns if c in after.columns]
        out = rest.select(*kept)
        for c in after.columns:
            if c not in df.columns:
                if defaults is None or c not in defaults:
                    raise ValueError(f"no default for the new column {c}")
                out = out.withColumn(c, F.lit(defaults[c]).cast(after.schema[c].dataType))
        return out.unionByName(after)

    def cache(self) -> Updates:
        return Updates(materialize(self.df), self.schema)


@dataclass(frozen=True)
class Diff:
    """A table before and after, with the insertions, deletions and updates between them. Each row has one or no counterpart."""

    before: DataFrame
    after: DataFrame
    insertions: DataFrame
    deletions: DataFrame
    updates: Updates

    @classmethod
    def from_before_after(cls, before: DataFrame, after: DataFrame, join_on: str | list[str] | bool) -> Diff:
        """Rows of equal keys are updated if a value changed; with join_on=False all rows are deleted and inserted."""
        check_schemas_equal(before, after)
        after = after.select(*before.columns)
        if join_on is False:
            none = Updates.from_tables(before.limit(0), after.limit(0), before.columns[:1])
            return cls(before, after, after, before, none)
        keys = [join_on] if isinstance(join_on, str) else list(join_on)
        inserted, deleted = after.join(before.select(*keys), keys, "left_anti"), before.join(after.select(*keys), keys, "left_anti")
        return cls(before, after, inserted.select(*before.columns), deleted.select(*before.columns), Updates.from_tables(before, after, keys).changed())

    @classmethod
    def from_deltas(cls, before: DataFrame, insertions: DataFrame | None = None, deletions: DataFrame | None = None, updates: Updates | None = None) -> Diff:
        none = before.limit(0)
        deletions = none if deletions is None else deletions.select(*before.columns)
        insertions = none if insertions is None else insertions.select(*before.columns)
        updates = Updates.from_tables(none, none, before.columns[:1]) if updates is None else updates
        after = updates.apply_to(before.exceptAll(deletions)).select(*before.columns).unionByName(insertions)
        return cls(before, after, insertions, deletions, updates)

    def unchanged(self) -> DataFrame:
        """Different rows of before that were neither deleted nor updated."""
        return self.before.subtract(self.deletions).subtract(self.updates.before().select(*self.before.columns))

    def stats(self) -> DataFrame:
        """One row: n_before, n_after, n_insertions, n_deletions, n_updates and n_unchanged, in one job."""
        parts = {"n_before": self.before, "n_after": self.after, "n_insertions": self.insertions, "n_deletions": self.deletions, "n_updates": self.updates.df}
        one = None
        for n, t in parts.items():
            row = t.agg(F.count("*").alias("n")).select(F.lit(n).alias("k"), "n")
            one = row if one is None else one.unionByName(row)
        wide = one.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in parts])
        return wide.withColumn("n_unchanged", F.col("n_before") - F.col("n_deletions") - F.col("n_updates"))

    def cache(self) -> Diff:
        return Diff(*[materialize(t) for t in (self.before, self.after, self.insertions, self.deletions)], self.updates.cache())

    def write(self, path: str, overwrite: bool = False) -> None:
        """Parquet tables before, insertions, deletions and updates; the table after follows from them."""
        mode = "overwrite" if overwrite else "errorifexists"
        for n, t in (("before", self.before), ("insertions", self.insertions), ("deletions", self.deletions), ("updates", self.updates.df)):
            t.write.mode(mode).parquet(f"{path}/{n}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Diff:
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("before", "insertions", "deletions", "updates")}
        return cls.from_deltas(t["before"], t["insertions"], t["deletions"], Updates(t["updates"], "lax"))


__all__ = ["Diff", "Updates", "is_changed", "schema_change", "types", "value_change"]
