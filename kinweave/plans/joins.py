"""What a join will cost, by the physical plan that Spark chose for it."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sized

from pyspark.sql import DataFrame

from kinweave.errors import SlowJoinError, SlowJoinWarning

#: Spark's join operators, and those that compare all rows with all.
ALGORITHMS = ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
SLOW = frozenset(("BroadcastNestedLoopJoin", "CartesianProduct"))


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def join_algorithm(df: DataFrame) -> str | None:
    """The operator of the outermost join, or None if nothing is joined."""
    m = re.search("|".join(ALGORITHMS), df._jdf.queryExecution().executedPlan().toString())
    return m[0] if m else None


def check_join_algorithm(df: DataFrame, on_slow: str = "error") -> str | None:
    """Raise, warn of or ignore a join that compares all rows with all; the operator's name."""
    if on_slow not in ("error", "warn", "ignore"):
        raise ValueError(f"on_slow is 'error', 'warn' or 'ignore', not {on_slow!r}")
    if on_slow == "ignore":
        return None
    found = join_algorithm(df)
    if found in SLOW:
        said = f"the join would run as {found}, comparing every left row with every right row"
        if on_slow == "error":
            raise SlowJoinError(said)
        warnings.warn(said, SlowJoinWarning, stacklevel=2)
    return found


def n_naive_comparisons(left: DataFrame | Sized | int, right: DataFrame | Sized | int | None = None) -> int:
    """Pairs that comparing all with all would give: within one table, or between two."""

    def n(x: DataFrame | Sized | int) -> int:
        return x if isinstance(x, int) else x.count() if isinstance(x, DataFrame) else len(x)

    a = n(left)
    return a * (a - 1) // 2 if right is None else a * n(right)
