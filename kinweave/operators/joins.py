"""Joins by conditions of many forms, and joins that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.resolve import is_binary, is_unary, resolve, unique_name
from kinweave.plans.joins import check_join_algorithm
from kinweave.runtime import numbered

HOW = ("inner", "left", "right", "outer", "semi", "anti", "asof", "any_inner", "any_left", "cross", "positional")


class Deferred:
    """An expression over two tables that aren't known yet: `left.a == right["b"]`. Attributes, calls, items and operators are taken down and done when the tables come."""

    def __init__(self, make: Callable[[DataFrame, DataFrame], Any]):
        self._make = make

    def __getattr__(self, name: str) -> Deferred:
        if name.startswith("_"):
            raise AttributeError(name)
        return Deferred(lambda a, b: getattr(self._make(a, b), name))

    def __getitem__(self, key: Any) -> Deferred:
        return Deferred(lambda a, b: self._make(a, b)[key])

    def __call__(self, *args: Any, **more: Any) -> Deferred:
        return Deferred(lambda a, b: self._make(a, b)(*[_known(x, a, b) for x in args], **{k: _known(x, a, b) for k, x in more.items()}))

    def resolved(self, a: DataFrame, b: DataFrame) -> Any:
        return self._make(a, b)

    __hash__ = object.__hash__


def _known(x: Any, a: DataFrame, b: DataFrame) -> Any:
    return x.resolved(a, b) if isinstance(x, Deferred) else x


def _operator(name: str) -> Callable[..., Deferred]:
    return lambda self, *args: Deferred(lambda a, b: getattr(self.resolved(a, b), name)(*[_known(x, a, b) for x in args]))


for _name in "add radd sub rsub mul rmul truediv rtruediv mod eq ne lt le gt ge and rand or ror invert neg".split():
    setattr(Deferred, f"__{_name}__", _operator(f"__{_name}__"))

#: Stand for the tables of a join that is yet to come.
left, right = Deferred(lambda a, b: a), Deferred(lambda a, b: b)


def deferred(f: Callable[..., Column]) -> Callable[..., Deferred]:
    """A function of columns that takes deferred ones too: deferred(F.levenshtein)(left.x, right.x) < 2."""
    return lambda *args, **more: Deferred(lambda a, b: f(*[_known(x, a, b) for x in args], **more))


def condition(spec: Any, left: DataFrame, right: DataFrame) -> Column | bool:
    """The join condition that spec stands for.

    A bool; a column over both tables; an expression of the placeholders `left` and `right`; a name of both; a function of one table (applied to both) or of two; a 2-tuple (left key, right
    key); any other iterable: all of its members hold.
    """
    if isinstance(spec, Deferred):
        return condition(spec.resolved(left, right), left, right)
    if isinstance(spec, (bool, Column)):
        return spec
    if hasattr(spec, "join_condition"):
        return condition(spec.join_condition(left, right), left, right)
    if isinstance(spec, str):
        return left[spec] == right[spec]
    if is_unary(spec):
        return resolve(left, spec) == resolve(right, spec)
    if is_binary(spec):
        return condition(spec(left, right), left, right)
    if isinstance(spec, tuple) and len(spec) == 2:
        return resolve(left, spec[0]) == resolve(right, spec[1])
    parts = [condition(s, left, right) for s in spec]
    if any(p is False for p in parts):
        return False
    columns = [p for p in parts if p is not True]
    return reduce(lambda a, b: a & b, columns) if columns else True


def _renamed(left: DataFrame, right: DataFrame, lname: str, rname: str, rename_all: bool, drop: set[str] = frozenset()) -> tuple[list[str], list[str]]:
    both = set(left.columns) & set(right.columns) - drop
    new = lambda t, c: t.format(name=c) if t and (rename_all or c in both) else c
    names = [new(lname, c) for c in left.columns], [new(rname, c) for c in right.columns if c not in drop]
    twice = {c for c in names[0] if c in names[1]}
    if twice:
        raise ValueError(f"both sides give the columns {sorted(twice)}")
    return names


def join(left: DataFrame, right: DataFrame, on: Any, how: str = "inner", lname: str = "", rname: str = "{name}_right", rename_all: bool = False, on_slow: str = "ignore", by: tuple[str, str] | None = None) -> DataFrame:
    """Join with names by template: `lname` and `rname` rename the columns that both have, or all with rename_all.

    how: those of Spark; "any_inner" and "any_left" keep one match a left row; "asof" joins the row of `right` that agrees in the
    names `on` and has the latest by[1] not after the left row's by[0]; "positional" joins rows of equal rank in the order of `on`.
    """
    if how not in HOW:
        raise ValueError(f"how is one of {HOW}, not {how!r}")
    if left is right or left.sameSemantics(right):
        left, right = left.alias("l"), right.select("*").toDF(*right.columns)
        right = right.select([F.col(c).alias(c) for c in right.columns])
    if how == "asof":
        return asof(left, right, [on] if isinstance(on, str) else list(on), by, rname)
    if how == "positional":
        return positional(left, right, on, rname)
    a, b = left.toDF(*[f"l__{c}" for c in left.columns]), right.toDF(*[f"r__{c}" for c in right.columns])
    c = condition(on, _View(a, "l__", left.columns), _View(b, "r__", right.columns)) if how != "cross" else True
    kind = {"semi": "left_semi", "anti": "left_anti", "any_inner": "inner", "any_left": "left"}.get(how, how)
    if how.startswith("any_"):
        a = a.withColumn("__row", F.monotonically_increasing_id())
    out = a.crossJoin(b) if c is True and kind in ("inner", "cross") else a.join(b, F.lit(c) if isinstance(c, bool) else c, "inner" if kind == "cross" else kind)
    if on_slow != "ignore":
        check_join_algorithm(out, on_slow)
    if how in ("semi", "anti"):
        return out.toDF(*left.columns)
    if how.startswith("any_"):
        out = out.dropDuplicates(["__row"]).drop("__row")
    shared = {on} if isinstance(on, str) and kind == "inner" and not rename_all else set()
    names = _renamed(left, right, lname, rname, rename_all, shared)
    out = out.drop(*[f"r__{c}" for c in shared])
    return out.toDF(*names[0], *names[1])


class _View:
    """A table under its old column names."""

    def __init__(self, df: DataFrame, prefix: str, columns: list[str]):
        self._df, self._prefix, self.columns = df, prefix, columns

    def __getitem__(self, name: str) -> Column:
        return self._df[self._prefix + name]

    def __getattr__(self, name: str) -> Column:
        return self[name]


def or_join(left: DataFrame, right: DataFrame, conditions: dict[str, Any], dedupe: tuple[str, str] | None = None, on_slow: str = "error") -> DataFrame:
    """Columns of both (with _l and _r) for pairs that meet any of the conditions, each once, with `rule`, the first that holds.

    Each condition is a join of its own, which Spark can run on equal keys; a later one leaves out the pairs of earlier ones. `dedupe`
    names a column of either side of which the left one is to be smaller.
    """
    a, b = left.toDF(*[f"{c}_l" for c in left.columns]), right.toDF(*[f"{c}_r" for c in right.columns])
    views = _Suffixed(a, "_l"), _Suffixed(b, "_r")
    out, before = None, []
    for name, spec in conditions.items():
        c = condition(spec, *views)
        if c is False:
            continue
        whole = F.lit(True) if c is True else c
        keep = reduce(lambda x, y: x & y, [~F.coalesce(p, F.lit(False)) for p in before], whole)
        if dedupe:
            keep = keep & (a[f"{dedupe[0]}_l"] < b[f"{dedupe[1]}_r"])
        part = a.join(b, keep)
        check_join_algorithm(part, on_slow)
        part = part.withColumn("rule", F.lit(name))
        out = part if out is None else out.unionByName(part)
        before.append(whole)
    return a.join(b, F.lit(False)).withColumn("rule", F.lit("")) if out is None else out


class _Suffixed(_View):
    def __init__(self, df: DataFrame, suffix: str):
        self._df, self._suffix = df, suffix

    def __getitem__(self, name: str) -> Column:
        return self._df[name + self._suffix]


def join_lookup(left: DataFrame, lookup: DataFrame, on: str | list[str], defaults: dict[str, Any] | None = None, rename: str = "{name}", on_collision: str = "error") -> DataFrame:
    """left with the lookup's other columns; rows without a match get the defaults (a null that was looked up stays null)."""
    keys = [on] if isinstance(on, str) else list(on)
    names = {c: rename.format(name=c) for c in lookup.columns if c not in keys}
    taken = [n for n in names.values() if n in left.columns]
    if taken and on_collision == "error":
        raise ValueError(f"the columns {taken} are there already")
    if on_collision in ("warn", "ignore"):
        if taken and on_collision == "warn":
            import warnings

            warnings.warn(f"the columns {taken} are replaced", stacklevel=2)
        left = left.drop(*taken)
    mark = unique_name([*left.columns, *lookup.columns], "__found")
    out = left.join(lookup.select(*keys, *[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias(mark)), keys, "left")
    for c, v in (defaults or {}).items():
        n = names[c]
        out = out.withColumn(n, F.when(F.col(mark).isNull(), F.lit(v)).otherwise(F.col(n)))
    return out.select(*left.columns, *names.values())


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows of left and right with low <= value <= high, and equal in `keys`.

    A range lies in at most two bins of the least width, among `width`, twice that, four times that and so on, that is as long as it; values look in
    their bin of each width that occurs (at most 64). So neither long nor short ranges meet all rows. Columns of both sides differ,
    but for the keys. Null values and bounds match nothing; with how="left", left rows without a range stay.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    keys = list(keys or [])
    row = unique_name([*left.columns, *right.columns], "__row")
    source = left.withColumn(row, F.monotonically_increasing_id()) if how == "left" else left
    length = (F.col(high) - F.col(low)).cast("double")
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(width)) / width)), F.lit(0)), F.lit(63)).cast("int")
    size = lambda lv: F.lit(float(width)) * F.pow(F.lit(2.0), lv)
    ranged = right.where(F.col(low) <= F.col(high)).withColumn("__level", level)
    first, last = F.floor(F.col(low) / size(F.col("__level"))), F.floor(F.col(high) / size(F.col("__level")))
    binned = ranged.withColumn("__bin", F.explode(F.sequence(first, last)))
    levels = F.broadcast(ranged.select("__level").distinct())
    placed = source.where(F.col(value).isNotNull()).crossJoin(levels).withColumn("__bin", F.floor(F.col(value) / size(F.col("__level"))))
    fits = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    out = placed.join(binned, [*keys, "__level", "__bin"]).where(fits).drop("__level", "__bin")
    if how == "inner":
        return out
    none = source.join(out.select(row), row, "left_anti")
    return out.unionByName(none, allowMissingColumns=True).drop(row)


def asof(left: DataFrame, right: DataFrame, keys: list[str], by: tuple[str, str], rname: str = "{name}_right", strict: bool = False) -> DataFrame:
    """Each left row with the right row of the same keys whose by[1] is the latest not after (or before, if strict) its by[0].

    Both sides are sorted together by key and time once, and the last right row is carried forward: one shuffle, no join of ranges. Of right
    rows of the same time, the greatest counts. Left rows with a null key or time, or without such a right row, get nulls.
    """
    others = [c for c in right.columns if c not in keys]
    names = {c: rname.format(name=c) if c in left.columns else c for c in others}
    a = left.select(*[F.col(c) for c in keys], F.col(by[0]).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*others).alias("r")).schema["r"].dataType).alias("__r"))
    known = right.where(F.col(by[1]).isNotNull())
    b = known.select(*[F.col(c) for c in keys], F.col(by[1]).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*others).alias("__r"))
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys], F.col("__t").isNotNull())
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    last = F.when(whole, F.col("__last"))
    return both.select("__l.*", *[last[c].alias(n) for c, n in names.items()])


def positional(left: DataFrame, right: DataFrame, order: str | list[str], rname: str = "{name}_right") -> DataFrame:
    """The nth row of left beside the nth of right, in the order of the columns `order`, as long as both have one.

    Ranks come from a distributed sort: counts by partition, then ranks within it.
    """
    order = [order] if isinstance(order, str) else list(order)
    names = [rname.format(name=c) if c in left.columns else c for c in right.columns]

    a, b = numbered(left, order, "__n"), numbered(right, order, "__n")
    return a.join(b.select(*[F.col(c).alias(n) for c, n in zip(right.columns, names, strict=True)], "__n"), "__n").drop("__n")
