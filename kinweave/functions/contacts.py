"""E-mail addresses and phone numbers."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.arrays import array_combinations
from kinweave.functions.similarity import damerau_levenshtein


def _nullif(s: Column) -> Column:
    return F.when(s != "", s)


def clean_email(s: Column, normalize: bool = False) -> Column:
    """The first address in the string, in lower case; null without one. Normalized, without dots and underscores."""
    e = _nullif(F.regexp_extract(F.lower(s), r"(\S+@\S+)", 1))
    return F.translate(e, "._", "") if normalize else e


def parsed_email(s: Column) -> Column:
    """Struct full, user, domain; missing parts are null."""
    at = F.split(s, "@")
    return F.when(s.isNotNull(), F.struct(_nullif(s).alias("full"), _nullif(F.get(at, F.lit(0))).alias("user"), _nullif(F.get(at, F.lit(1))).alias("domain")))


class EmailLevel(IntEnum):
    FULL_EXACT = 0
    FULL_NEAR = 1
    USER_EXACT = 2
    USER_NEAR = 3
    ELSE = 4


def email_level(a: Column, b: Column) -> Column:
    """Agreement of two parsed addresses: equal, one edit apart, equal users, users one edit apart, or else."""
    near = lambda f: damerau_levenshtein(a[f], b[f]) <= 1
    out = F.when(a["full"] == b["full"], 0).when(near("full"), 1).when(a["user"] == b["user"], 2).when(near("user"), 3)
    return out.otherwise(4).cast("int")


def clean_phone_number(s: Column, default_area_code: str | None = None) -> Column:
    """Ten digits, or null if there are fewer or they are made up (0000, 9999 or 12345 within them). Seven digits take the area code."""
    if default_area_code is not None and len(default_area_code) != 3:
        raise ValueError("an area code has three characters")
    d = F.regexp_replace(s, r"\D", "")
    if default_area_code:
        d = F.regexp_replace(d, r"^(\d{7})$", f"{default_area_code}$1")
    n = _nullif(F.regexp_extract(d, r"1?(\d{10})", 1))
    return F.when(~n.rlike("0000|9999|12345"), n)


def clean_phone_numbers(a: Column, default_area_code: str | None = None) -> Column:
    """Different clean numbers of an array."""
    return F.array_distinct(F.filter(F.transform(a, lambda s: clean_phone_number(s, default_area_code)), lambda s: s.isNotNull()))


class PhoneLevel(IntEnum):
    EXACT = 0
    NEAR = 1
    ELSE = 2


def phone_level(a: Column, b: Column) -> Column:
    return F.when(a == b, 0).when(damerau_levenshtein(a, b) <= 1, 1).otherwise(2).cast("int")


def best_level(pairs: DataFrame, left: str, right: str, level, otherwise: int, result: str, ids: tuple[str, str] = ("record_id_l", "record_id_r")) -> DataFrame:
    """pairs with the least level over all combinations of two arrays' elements, `otherwise` without any.

    Combinations are rows for the while, as a UDF can't run within an array function; (ids) are unique.
    """
    each = pairs.select(*ids, F.explode(array_combinations(F.col(left), F.col(right))).alias("x"))
    best = each.groupBy(*ids).agg(F.min(level(F.col("x.l"), F.col("x.r"))).alias(result))
    return pairs.join(best, list(ids), "left").withColumn(result, F.coalesce(result, F.lit(otherwise)).cast("int"))


class EmailsDimension:
    """Prepares, links and compares arrays of e-mail addresses."""

    def __init__(self, column: str = "emails"):
        self.column, self.parsed, self.compared = column, f"{column}_parsed", f"{column}_compared"

    def prepare(self, df: DataFrame) -> DataFrame:
        clean = F.array_distinct(F.filter(F.transform(self.column, lambda s: clean_email(s, True)), lambda s: s.isNotNull()))
        return df.withColumn(self.parsed, F.transform(clean, parsed_email))

    def block(self, left: DataFrame, right: DataFrame, task: str | None = None):
        from kinweave.operators.linkers import UnnestLinker

        return UnnestLinker(lambda df: F.transform(df[self.parsed], lambda e: e["full"]), task)(left, right)

    def compare(self, pairs: DataFrame) -> DataFrame:
        return best_level(pairs, f"{self.parsed}_l", f"{self.parsed}_r", email_level, int(EmailLevel.ELSE), self.compared)


class PhonesDimension:
    def __init__(self, column: str = "phones", default_area_code: str | None = None):
        self.column, self.cleaned, self.compared, self.area = column, f"{column}_cleaned", f"{column}_compared", default_area_code

    def prepare(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.cleaned, clean_phone_numbers(F.col(self.column), self.area))

    def compare(self, pairs: DataFrame) -> DataFrame:
        return best_level(pairs, f"{self.cleaned}_l", f"{self.cleaned}_r", phone_level, int(PhoneLevel.ELSE), self.compared)
