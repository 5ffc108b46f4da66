"""Functions of struct columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mutate(s: Column, **fields: Column) -> Column:
    return reduce(lambda c, kv: c.withField(*kv), fields.items(), s)


def drop(s: Column, *fields: str) -> Column:
    return s.dropFields(*fields)


def select(s: Column, *fields: str) -> Column:
    return F.when(s.isNotNull(), F.struct(*[s[f].alias(f) for f in fields]))


def rename(s: Column, fields: list[str], **new: str) -> Column:
    """The struct of `fields` with new names, given as new=old."""
    old = {v: k for k, v in new.items()}
    return F.when(s.isNotNull(), F.struct(*[s[f].alias(old.get(f, f)) for f in fields]))


def unpack(df: DataFrame, *structs: str) -> DataFrame:
    """df with the fields of the structs in their place."""
    return df.select(*[f"{c}.*" if c in structs else c for c in df.columns])


def equal(a: Column, b: Column, fields: list[str]) -> Column:
    """All of the fields are equal; null if a field is null and no other differs."""
    return reduce(lambda x, y: x & y, [a[f] == b[f] for f in fields], F.lit(True))


def isnull(s: Column, fields: list[str], how: str = "any") -> Column:
    """The struct, or any or all of its fields, are null."""
    nulls = [s[f].isNull() for f in fields]
    if how not in ("any", "all"):
        raise ValueError(f"how is 'any' or 'all', not {how!r}")
    return s.isNull() | reduce((lambda x, y: x | y) if how == "any" else (lambda x, y: x & y), nulls)
