"""Functions of arrays. Nulls in an array are ignored unless said otherwise; a null array gives null."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import col


def _some(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def array_min(a: Column) -> Column:
    return F.array_min(a)


def array_max(a: Column) -> Column:
    return F.array_max(a)


def array_sum(a: Column, kind: str = "double") -> Column:
    """Sum as the type `kind`; null if there is nothing to add."""
    some = _some(a)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind)))


def array_mean(a: Column) -> Column:
    some = _some(a)
    return F.when(F.size(some) > 0, array_sum(a) / F.size(some))


def array_median(a: Column) -> Column:
    """The middle value, or the mean of the two in the middle."""
    some = F.array_sort(_some(a))
    n = F.size(some)
    lower, upper = (F.get(some, ((n + k) / 2).cast("int")).cast("double") for k in (-1, 0))
    return F.when(n > 0, (lower + upper) / 2)


def array_any(a: Column) -> Column:
    some = _some(a)
    return F.when(F.size(some) > 0, F.exists(some, lambda x: x))


def array_all(a: Column) -> Column:
    some = _some(a)
    return F.when(F.size(some) > 0, F.forall(some, lambda x: x))


def array_combinations(left: Column, right: Column) -> Column:
    """All pairs of elements, nulls included, as structs (l, r)."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias("l"), y.alias("r")))))


def array_combinations_first_n(left: Column, right: Column, n: int) -> list[tuple[Column, Column]]:
    """Pairs of the first n elements of either array, as columns that are null beyond an array's end."""
    if n < 0:
        raise ValueError("n must not be negative")
    return [(F.get(left, F.lit(i)), F.get(right, F.lit(j))) for i in range(n) for j in range(n)]


def array_filter_isin_other(df: DataFrame, array: str, other: DataFrame, other_column: str, result: str = "{name}_filtered") -> DataFrame:
    """df with the elements of `array` that occur in `other`, in their order; nulls and empty arrays stay as they are.

    Only distinct elements of both sides are shuffled beside the rows of df, so that `other` may be large.
    """
    name = result.format(name=array)
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    each = keyed.select("__row", F.posexplode(array).alias("__pos", "__x")).where(F.col("__x").isNotNull())
    kept = each.join(other.select(F.col(other_column).alias("__x")).where(F.col("__x").isNotNull()).distinct(), "__x", "left_semi")
    back = kept.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda s: s["__x"]).alias("__kept"))
    empty = F.when(F.col(array).isNotNull(), F.slice(F.col(array), 1, 0))
    return keyed.join(back, "__row", "left").withColumn(name, F.coalesce("__kept", empty)).drop("__row", "__kept")


def array_shuffle(a: Column, seed: int | None = None) -> Column:
    return F.shuffle(a) if seed is None else F.shuffle(a, seed)


def array_choice(a: Column, n: int, seed: int | None = None) -> Column:
    """n elements drawn without replacement, or all if there are fewer."""
    return F.slice(array_shuffle(a, seed), 1, n)


def array_sort(a: Column, key: Callable[[Column], Column] | Iterable[Callable[[Column], Column]] | None = None) -> Column:
    """Elements in the order of one or more keys (nulls first), equal ones in their old order; without a key as array_sort of Spark."""
    if key is None:
        return F.array_sort(a)
    keys = [key] if callable(key) else list(key)
    placed = F.transform(a, lambda x, i: F.struct(*[k(x).alias(f"k{j}") for j, k in enumerate(keys)], i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(placed), lambda s: s["x"])


def list_select(a: Column, indexes: Column) -> Column:
    """Elements at the indexes, which count from 0; null where there is none."""
    return F.transform(indexes, lambda i: F.get(a, i.cast("int")))


def list_grade_up(a: Column) -> Column:
    """Indexes, from 0, that put the array in order."""
    return F.transform(F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def array_union_all(*arrays: str | Column) -> Column:
    """Elements of all arrays, null arrays counting as empty."""
    return F.flatten(F.array(*[F.coalesce(col(a), F.slice(col(a), 1, 0)) for a in arrays]))
