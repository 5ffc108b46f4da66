"""Names of persons, as structs with the fields prefix, given, middle, surname, suffix and nickname."""

from __future__ import annotations

from enum import IntEnum
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.nicknames import NICKNAMES
from kinweave.functions.similarity import damerau_levenshtein
from kinweave.functions.text import strip_accents, tokenize

PARTS = ("prefix", "given", "middle", "surname", "suffix", "nickname")


def normalize_name_field(s: Column) -> Column:
    """Upper case without accents, with one space for each run of other characters than letters and digits."""
    return F.btrim(F.regexp_replace(strip_accents(F.upper(s)), "[^A-Z0-9]+", " "))


def normalize_name(name: Column) -> Column:
    return F.when(name.isNotNull(), F.struct(*[normalize_name_field(name[p]).alias(p) for p in PARTS]))


def name_tokens(name: Column) -> Column:
    """Different words of all parts."""
    words = [F.coalesce(tokenize(name[p]), F.array().cast("array<string>")) for p in PARTS]
    return F.when(name.isNotNull(), F.array_distinct(F.filter(F.flatten(F.array(*words)), lambda w: w != "")))


def _table(table: dict[str, str] | None) -> Column:
    both: dict[str, set[str]] = {}
    for formal, nicks in (NICKNAMES if table is None else table).items():
        for n in nicks.split():
            both.setdefault(n, set()).add(formal)
    return F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, sorted(v)))) for k, v in sorted(both.items())))


def is_nickname_for(nickname: Column, name: Column, table: dict[str, str] | None = None) -> Column:
    """The nickname is one of the name's, whatever the case; a name is one of its own."""
    a, b = F.lower(F.btrim(nickname)), F.lower(F.btrim(name))
    formal = F.coalesce(F.try_element_at(_table(table), a), F.array().cast("array<string>"))
    return (a == b) | F.array_contains(formal, b)


def are_aliases(a: Column, b: Column, table: dict[str, str] | None = None) -> Column:
    """One is the other's nickname, or they are equal."""
    return is_nickname_for(a, b, table) | is_nickname_for(b, a, table)


def initials_equal(a: Column, b: Column) -> Column:
    """The first letters agree and one of the names is that letter alone."""
    return (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ((F.length(a) == 1) | (F.length(b) == 1))


def contained(a: Column, b: Column, least: int = 3) -> Column:
    """The shorter one, of at least so many letters, is part of the other."""
    return (F.contains(a, b) & (F.length(b) >= least)) | (F.contains(b, a) & (F.length(a) >= least))


def equal_forgiving_typo(a: Column, b: Column) -> Column:
    d = damerau_levenshtein(a, b)
    return (d <= 1) | ((d <= 2) & (F.length(a) > 5)) | contained(a, b)


class NameLevel(IntEnum):
    NULL = 0
    EXACT = 1
    GIVEN_SURNAME = 2
    NICKNAMES = 3
    INITIALS = 4
    TYPO = 5
    ELSE = 6


def name_level(a: Column, b: Column, table: dict[str, str] | None = None) -> Column:
    """The first that holds: NULL, EXACT, GIVEN_SURNAME, NICKNAMES, TYPO, INITIALS, else ELSE. For normalized names."""
    missing = a.isNull() | b.isNull() | a["given"].isNull() | a["surname"].isNull() | b["given"].isNull() | b["surname"].isNull()
    surname = a["surname"] == b["surname"]
    exact = F.lit(True)
    for p in PARTS:
        exact = exact & (a[p] == b[p])
    lv = lambda x: F.lit(int(x)).cast("int")
    out = F.when(missing, lv(NameLevel.NULL)).when(exact, lv(NameLevel.EXACT)).when(surname & (a["given"] == b["given"]), lv(NameLevel.GIVEN_SURNAME))
    out = out.when(surname & are_aliases(a["given"], b["given"], table), lv(NameLevel.NICKNAMES))
    out = out.when(surname & equal_forgiving_typo(a["given"], b["given"]), lv(NameLevel.TYPO))
    return out.when(surname & initials_equal(a["given"], b["given"]), lv(NameLevel.INITIALS)).otherwise(lv(NameLevel.ELSE))


class NameDimension:
    """Prepares and compares a struct column of names."""

    def __init__(self, column: str = "name"):
        self.column = column
        self.normed, self.tokens, self.compared = f"{column}_normed", f"{column}_tokens", f"{column}_compared"

    def prepare(self, df: DataFrame) -> DataFrame:
        out = df.withColumn(self.normed, normalize_name(F.col(self.column)))
        return out.withColumn(self.tokens, name_tokens(F.col(self.normed)))

    def compare(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn(self.compared, name_level(F.col(f"{self.normed}_l"), F.col(f"{self.normed}_r")))
