"""Edit distances and keys under which close spellings meet."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) that turn a into b, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    older: list[int] = []
    old = list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        new = [x]
        for y in range(1, len(b) + 1):
            d = min(old[y] + 1, new[y - 1] + 1, old[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, older[y - 2] + 1)
            new.append(d)
        if min(new) > most and (x < 2 or min(old) > most):
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def deletions(s: str) -> set[str]:
    """The string and what is left after deleting one character: strings one edit apart share one of them."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def close_keys(w: str, most: Callable[[int], int] = lambda n: 2, longest: int = 12) -> set[str]:
    """Keys of which any two strings within most(n) edits share one, n being the length of the shorter; most(n) is three at most.

    With one edit, and where the strings are short, those are what is left after as many deletions. Of the others' beginnings and ends, of
    half their length but at most `longest`, one has at most one edit, so that they share what is left of it after one deletion.
    """
    out = set()
    for n in range(max(len(w) - 3, 1), len(w) + 1):
        k = most(n)
        if len(w) - n > k:
            continue
        if k < 2 or n < (7 if k == 2 else 9):
            # k letters less in the longer string are 0 to k less in the shorter
            out |= {"".join(x) for d in range(0 if n == len(w) else k, min(k, len(w)) + 1) for x in combinations(w, len(w) - d)}
        else:
            h = min((n + 1) // 2 if k == 2 else (n - 1) // 2, longest)  # a swap of neighbours touches one of the two
            out |= {a + part[:i] + part[i + 1 :] for a, part in (("<", w[:h]), (">", w[-h:])) for i in range(h)}
    return out


def close_pairs(few: DataFrame, many: DataFrame, text: str, same: list[str], most: int = 2, more: bool = True) -> DataFrame:
    """Pairs of different texts within `most` edits that agree in the columns `same`: those, {text}, n, other, other_n and edits.

    Texts meet under the keys of close_keys(), which finds all; what meets is measured. With `more`, only others with at least as large an n are looked at. Both tables
    have the column n and a row for each text.
    """

    @F.pandas_udf("array<string>")
    def close(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(close_keys(t, lambda n: most)))

    def keys(df: DataFrame, n: str) -> DataFrame:
        every = F.transform("close", lambda k: F.xxhash64(k, *[F.col(c) for c in same]))
        df = df.where(F.length(text) > 0).withColumn("close", close(text))
        return df.select(*same, F.col(text).alias(n), F.col("n").alias(f"{n}_n"), F.explode(every).alias("key"))

    # Spark takes a table of keys to be as large as that of the texts, and would send one of many times that size through the driver
    met = keys(few, "a").join(keys(many, "other").hint("merge"), ["key", *same]).where(F.col("a") != F.col("other"))
    if more:
        met = met.where(F.col("other_n") >= F.col("a_n"))
    met = met.where((F.abs(F.length("a") - F.length("other")) <= most) & (F.levenshtein("a", "other", 2 * most) >= 0))
    met = met.select(*same, "a", "a_n", "other", "other_n").distinct()

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, most) for x, y in zip(a, b, strict=True)], dtype="int32")

    found = met.withColumn("edits", edits("a", "other")).where(F.col("edits") <= most)
    return found.select(*same, F.col("a").alias(text), F.col("a_n").alias("n"), "other", "other_n", "edits")
