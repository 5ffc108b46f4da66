"""Tables of records and of links between them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.resolve import bind, resolve
from kinweave.runtime import materialize


def types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def check_schemas_equal(a: DataFrame, b: DataFrame) -> None:
    """Raise a ValueError that names the differences, if names or types differ (order and nullability don't matter)."""
    x, y = types(a), types(b)
    if x != y:
        raise ValueError(f"only left: {sorted(set(x) - set(y))}; only right: {sorted(set(y) - set(x))}; other types: {[(k, x[k], y[k]) for k in x if k in y and x[k] != y[k]]}")


def check_links(left: DataFrame, right: DataFrame, links: DataFrame) -> None:
    """The columns record_id, record_id_l and record_id_r are there, and their types fit."""
    for t, need in ((left, ["record_id"]), (right, ["record_id"]), (links, ["record_id_l", "record_id_r"])):
        missing = [c for c in need if c not in t.columns]
        if missing:
            raise ValueError(f"the columns {missing} are missing among {t.columns}")
    for t, c in ((left, "record_id_l"), (right, "record_id_r")):
        if types(t)["record_id"] != types(links)[c]:
            raise ValueError(f"{c} is {types(links)[c]}, but record_id is {types(t)['record_id']}")


def n_total(counts: DataFrame) -> int:
    """Sum of the column n, 0 for an empty table."""
    return int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


@dataclass(frozen=True)
class Links:
    """Pairs of records: record_id_l, record_id_r and columns that describe the pair, with the tables they refer to."""

    df: DataFrame
    left: DataFrame
    right: DataFrame

    def _with(self, side: str, columns: tuple[Any, ...], named: dict[str, Any]) -> Links:
        table = self.left if side == "l" else self.right
        chosen = [resolve(table, c).alias(c if isinstance(c, str) else f"value{i}") for i, c in enumerate(columns)]
        if not columns and not named:
            chosen = [F.col(c).alias(f"{c}_{side}") for c in table.columns if c != "record_id"]
        chosen += [resolve(table, v).alias(k) for k, v in named.items()]
        extra = table.select(F.col("record_id").alias(f"record_id_{side}"), *chosen)
        taken = (set(extra.columns) & set(self.df.columns)) - {f"record_id_{side}"}
        if taken:
            raise ValueError(f"the columns {sorted(taken)} are there already")
        return replace(self, df=self.df.join(extra, f"record_id_{side}", "left"))

    def with_left(self, *columns: Any, **named: Any) -> Links:
        """With columns of the left records; without arguments all of them, as {name}_l."""
        return self._with("l", columns, named)

    def with_right(self, *columns: Any, **named: Any) -> Links:
        return self._with("r", columns, named)

    def with_both(self) -> Links:
        """With all columns of both sides, as {name}_l and {name}_r, but for those that are there."""
        out = self
        for side, t in (("l", self.left), ("r", self.right)):
            new = {f"{c}_{side}": c for c in t.columns if c != "record_id" and f"{c}_{side}" not in self.df.columns}
            if new:
                out = out._with(side, (), new)
        return out

    def swapped(self) -> Links:
        """The same links seen from the right table."""
        turn = lambda c: c[:-2] + {"_l": "_r", "_r": "_l"}[c[-2:]] if c.endswith(("_l", "_r")) else c
        return Links(self.df.toDF(*map(turn, self.df.columns)), self.right, self.left)

    def cache(self) -> Links:
        return replace(self, df=materialize(self.df))


def filter_links(links: DataFrame, keep: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Links for which the condition holds; it may use window functions."""
    c = keep(links) if callable(keep) and not isinstance(keep, Column) else keep
    return links.withColumn("__keep", c).where("__keep").drop("__keep")


@dataclass(frozen=True)
class Linked:
    """A table of records that links join to other records."""

    df: DataFrame
    other: DataFrame
    links: DataFrame

    def with_n_links(self, name: str = "n_links") -> DataFrame:
        """With the number of different links of each record, 0 without any."""
        n = self.links.select("record_id_l", "record_id_r").distinct().groupBy("record_id_l").agg(F.count("*").alias(name))
        out = self.df.join(n.withColumnRenamed("record_id_l", "record_id"), "record_id", "left")
        return out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))

    def link_counts(self) -> DataFrame:
        """Columns n_links and n_records: how many records have how many links."""
        n = self.links.select("record_id_l", "record_id_r").distinct().groupBy("record_id_l").agg(F.count("*").alias("n_links"))
        known = self.df.select(F.col("record_id").alias("record_id_l")).distinct()
        each = known.join(n, "record_id_l", "left").select(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        return each.groupBy("n_links").agg(F.count("*").alias("n_records"))

    def with_linked_values(self, *columns: str, **values: Any) -> DataFrame:
        """With values of the linked records: aggregates as they are, other values collected in an array; null for records without links.

        Without arguments, `linked` has an array of structs of all columns.
        """
        if not columns and not values:
            values = {"linked": F.collect_list(F.struct(*[F.col(c) for c in self.other.columns]))}
        values = {**{c: F.col(c) for c in columns}, **values}
        taken = set(values) & set(self.df.columns)
        if taken:
            raise ValueError(f"the columns {sorted(taken)} are there already")
        met = self.links.select("record_id_l", "record_id_r").distinct().join(self.other.withColumnRenamed("record_id", "record_id_r").withColumn("record_id", F.col("record_id_r")), "record_id_r")
        groups = met.groupBy("record_id_l")

        def aggregated(v: Any) -> Column:
            c = resolve(self.other, v) if not isinstance(v, (Column, str)) else F.col(v) if isinstance(v, str) else v
            try:
                groups.agg(c.alias("x")).schema  # noqa: B018  is it an aggregate?
                return c
            except AnalysisException as e:
                if "AGGREGAT" not in str(e) and "GROUP" not in str(e):
                    raise
                return F.collect_list(c)

        each = groups.agg(*[aggregated(v).alias(k) for k, v in values.items()])
        return self.df.join(each.withColumnRenamed("record_id_l", "record_id"), "record_id", "left")


@dataclass(frozen=True)
class Linkage:
    """A left and a right table of records, and the links between them."""

    left: DataFrame
    right: DataFrame
    links: DataFrame

    def __post_init__(self) -> None:
        check_links(self.left, self.right, self.links)

    def copy(self, **changed: DataFrame) -> Linkage:
        return replace(self, **changed)

    def left_linked(self) -> Linked:
        return Linked(self.left, self.right, self.links)

    def right_linked(self) -> Linked:
        turned = self.links.select(F.col("record_id_r").alias("record_id_l"), F.col("record_id_l").alias("record_id_r"))
        return Linked(self.right, self.left, turned)

    def pairs(self) -> Links:
        return Links(self.links, self.left, self.right)

    def filter(self, keep: Column | Callable[[DataFrame], Column]) -> Linkage:
        return replace(self, links=filter_links(self.links, keep))

    def cache(self) -> Linkage:
        return Linkage(*[materialize(t) for t in (self.left, self.right, self.links)])

    def link_counts_chart_data(self) -> DataFrame:
        """Columns side, n_links and n_records: what a chart of the links of either side shows."""
        left = self.left_linked().link_counts().withColumn("side", F.lit("left"))
        return left.unionByName(self.right_linked().link_counts().withColumn("side", F.lit("right")))

    @classmethod
    def from_join_condition(cls, left: DataFrame, right: DataFrame, on: Any) -> Linkage:
        """The linkage of all pairs that meet a condition (see operators.joins.condition)."""
        from kinweave.operators.joins import or_join

        links = or_join(left, right, {"on": on}, on_slow="ignore").select("record_id_l", "record_id_r")
        return cls(left, right, links)

    def write(self, path: str, overwrite: bool = False) -> None:
        """Three Parquet tables, left, right and links, in a folder."""
        for n in ("left", "right", "links"):
            getattr(self, n).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/{n}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Linkage:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("left", "right", "links")])


class Datasets(Mapping[str, DataFrame]):
    """Named tables of records whose ids have one type."""

    def __init__(self, tables: Mapping[str, DataFrame] | list[DataFrame]):
        if not isinstance(tables, Mapping):
            names = ["left", "right"] if len(tables) == 2 else [f"dataset_{i}" for i in range(len(tables))]
            tables = dict(zip(names, tables, strict=True))
        kinds = {types(t).get("record_id") for t in tables.values()}
        if None in kinds or len(kinds) > 1:
            raise ValueError(f"all tables need a record_id of one type, not {kinds}")
        self._tables = dict(tables)

    def __getitem__(self, key: str | int) -> DataFrame:
        return list(self._tables.values())[key] if isinstance(key, int) else self._tables[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def map(self, f: Callable[[str, DataFrame], DataFrame]) -> Datasets:
        return Datasets({n: f(n, t) for n, t in self._tables.items()})

    def filter(self, f: Callable[[DataFrame], Column]) -> Datasets:
        return Datasets({n: t.where(f(t)) for n, t in self._tables.items()})

    def cache(self) -> Datasets:
        return Datasets({n: materialize(t) for n, t in self._tables.items()})

    @property
    def shared_schema(self) -> dict[str, str]:
        """Columns that all tables have with one type."""
        kinds = [types(t) for t in self._tables.values()]
        return {c: k for c, k in kinds[0].items() if all(t.get(c) == k for t in kinds)}

    def unioned(self) -> DataFrame:
        """All rows, with the shared columns and the table's name as `dataset`."""
        out = None
        for n, t in self._tables.items():
            part = t.select(F.lit(n).alias("dataset"), *self.shared_schema)
            out = part if out is None else out.unionByName(part)
        return out

    def all_record_ids(self) -> DataFrame:
        return self.unioned().select("record_id").distinct()


class UnionTable:
    """Tables with the same columns as one: what is done to it is done to each branch; table() unites them, repeated rows included."""

    def __init__(self, tables: Iterable[DataFrame]):
        self.tables = list(tables)
        if not self.tables or any(set(types(t)) != set(types(self.tables[0])) for t in self.tables):
            raise ValueError("a union needs tables, all with the same columns")

    def _each(self, f: Callable[[DataFrame], DataFrame]) -> UnionTable:
        return UnionTable(map(f, self.tables))

    def filter(self, f: Callable[[DataFrame], Column]) -> UnionTable:
        return self._each(lambda t: t.where(f(t)))

    def select(self, *columns: str | Column) -> UnionTable:
        return self._each(lambda t: t.select(*columns))

    def mutate(self, **columns: Column | Callable[[DataFrame], Column]) -> UnionTable:
        return self._each(lambda t: t.withColumns({n: c if isinstance(c, Column) else c(t) for n, c in columns.items()}))

    def rename(self, **new: str) -> UnionTable:
        return self._each(lambda t: t.withColumnsRenamed({old: n for n, old in new.items()}))

    def drop(self, *names: str) -> UnionTable:
        return self._each(lambda t: t.drop(*names))

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)


def warn_many(n: int, most: int = 100_000_000) -> None:
    if n > most:
        warnings.warn(f"{n} pairs are many", stacklevel=3)


__all__ = ["Datasets", "Linkage", "Linked", "Links", "UnionTable", "bind", "check_links", "check_schemas_equal", "filter_links", "n_total", "types", "warn_many"]
