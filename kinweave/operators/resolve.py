"""What may stand for a column: a name, a column, a literal, or a function of the table."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Spec = Any


def arity(f: Callable) -> int:
    """How many positional arguments without a default a function takes."""
    kinds = (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD)
    return sum(p.kind in kinds and p.default is p.empty for p in inspect.signature(f).parameters.values())


def is_unary(f: object) -> bool:
    return callable(f) and not isinstance(f, Column) and arity(f) == 1


def is_binary(f: object) -> bool:
    return callable(f) and not isinstance(f, Column) and arity(f) == 2


def resolve(df: DataFrame, spec: Spec) -> Column:
    """The one column that spec stands for in df."""
    if isinstance(spec, str):
        return df[spec]
    if isinstance(spec, Column):
        return spec
    if callable(spec):
        return resolve(df, spec(df))
    return F.lit(spec)


def ensure_val(value: object, kind: str | None = None) -> Column:
    """A column as it is, anything else as a literal; cast to `kind` if given."""
    c = value if isinstance(value, Column) else F.lit(value)
    return c if kind is None else c.cast(kind)


def name_of(spec: Spec, place: int = 0) -> str:
    return spec if isinstance(spec, str) else f"key{place}"


def bind(df: DataFrame, *specs: Spec) -> list[Column]:
    """Columns for all specs; a function may give several."""
    out: list[Column] = []
    for s in specs:
        got = s(df) if callable(s) and not isinstance(s, Column) else s
        out += [resolve(df, x) for x in got] if isinstance(got, (list, tuple)) else [resolve(df, got)]
    return out


def bind_one(df: DataFrame, spec: Spec) -> Column:
    found = bind(df, spec)
    if len(found) != 1:
        raise ValueError(f"expected one column, got {len(found)}")
    return found[0]


def pair(spec: Spec) -> tuple[Spec, Spec]:
    """A key for both sides, or one for each if spec is a 2-tuple."""
    if isinstance(spec, tuple):
        if len(spec) != 2:
            raise ValueError(f"a pair of keys has two members, not {len(spec)}")
        return spec
    return spec, spec


def pairs(specs: Spec) -> list[tuple[Spec, Spec]]:
    """Keys of which all must agree. A list or tuple at the top lists keys; a 2-tuple within it is (left key, right key)."""
    return [pair(s) for s in (specs if isinstance(specs, (list, tuple)) else [specs])]


def promote_list(x: Any) -> list:
    return list(x) if isinstance(x, Iterable) and not isinstance(x, (str, bytes)) else [x]


def cases(*when: tuple[Column | bool, Any], otherwise: Any = None) -> Column:
    """The value of the first condition that holds, else `otherwise`."""
    out = None
    for c, v in when:
        c = F.lit(c) if isinstance(c, bool) else c
        out = F.when(c, v) if out is None else out.when(c, v)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def unique_name(taken: Iterable[str], stem: str = "__c") -> str:
    taken, i = set(taken), 0
    while f"{stem}{i}" in taken:
        i += 1
    return f"{stem}{i}"
