"""Names and birth dates of persons: their parts, and how likely one is a variant of another."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Container, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from kinweave.functions.nicknames import formal_names
from kinweave.llm.edits import close_keys, deletions, within

#: Titles, suffixes and entries that stand for nothing.
TITLES = frozenset("mr mrs ms miss dr prof rev sir dame mx".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md esq".split())
NOTHING = frozenset(("", "n/a", "na", "none", "null", "unknown", "unk", "-", "--", "?", "x", "xx", "xxx", "nil", "test", "tbd", "."))
_LOOKALIKE = str.maketrans("0153", "olse")


def fold(s: str | None) -> str:
    """Lower case and without accents; "" for entries that stand for nothing."""
    if s is None:
        return ""
    s = " ".join(s.casefold().split())
    if s in NOTHING:
        return ""
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.replace("ø", "o").replace("æ", "ae").replace("ß", "ss"))
        s = "".join(c for c in s if not unicodedata.combining(c))
    return s


def tokens(s: str) -> list[str]:
    """Words of a folded name, with digits that look like letters set right and spelled-out umlauts contracted; hyphens part words."""
    out = []
    for w in re.findall(r"[a-z0-9]+", s.replace("'", "")):
        if re.search("[a-z]", w) and re.search("[0-9]", w):
            w = w.translate(_LOOKALIKE)
        if len(w) >= 6:
            w = re.sub("[aou]e", lambda m: m[0][0], w)
        if not w.isdigit():
            out.append(w)
    return out


_FORMAL = {tokens(n)[0]: frozenset(tokens(f)[0] for f in formals) for n, formals in formal_names().items()}


@dataclass(frozen=True)
class Person:
    given: tuple[str, ...]
    surname: tuple[str, ...]
    year: int | None
    month: int | None
    day: int | None
    nick: tuple[str, ...] = field(default=())


def person(given: list[str | None], surname: list[str | None], year: object, month: object, day: object, known: Container[str] = frozenset(), nick: str | None = None) -> Person:
    """The parts of a name that may stand in wrong fields.

    A comma in the surname parts surname and given name. If the surname's only word is among the `known` given names and the given
    name isn't, they change places.
    """
    g = [t for x in given for t in tokens(fold(x))]
    folded = [fold(x) for x in surname]
    s: list[str] = []
    for x in folded:
        x = re.sub(r",\s*(" + "|".join(SUFFIXES) + r")\b\.?", " ", x)
        if "," in x and not any(w not in TITLES for w in g):
            first, _, rest = x.partition(",")
            s += tokens(first)
            g += tokens(rest)
        else:
            s += tokens(x)
    gf = [fold(x) for x in given]
    if not s:
        for x in gf:
            x = re.sub(r",\s*(" + "|".join(SUFFIXES) + r")\b\.?", " ", x)
            if "," in x:
                first, _, rest = x.partition(",")
                s, g = tokens(first), tokens(rest)
    drop = TITLES | SUFFIXES
    g = [w for w in g if w not in drop]
    s = [w for w in s if w not in drop]
    if not g and len(s) > 1 and s[0] in known:
        g, s = s[:1], s[1:]
    if not s and len(g) > 1:
        g, s = (g[1:], g[:1]) if g[-1] in known and g[0] not in known else (g[:-1], g[-1:])
    if g and s and len(s) == 1 and (s[0] in known or len(s[0]) == 1 or s[0] in _FORMAL) and not (g[0] in known or len(g[0]) == 1 or g[0] in _FORMAL):
        g, s = s, g
    num = lambda v, lo, hi: int(v) if v is not None and v == v and lo <= int(v) <= hi else None
    y = num(year, 0, 9999)
    return Person(tuple(g), tuple(s), None if y is None else y % 100, num(month, 1, 12), num(day, 1, 31), tuple(tokens(fold(nick))))


def most_edits(n: int) -> int:
    """Edits between variants of a word of n letters: one up to 5 letters, two up to 9, then three."""
    return 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 9 else 3


def word_edits(a: str, b: str) -> int:
    """Edits between words, 9 if more than the length of the shorter allows."""
    n = min(len(a), len(b))
    most = most_edits(n)
    d = within(a, b, most)
    return d if d <= most and n > 2 else 0 if a == b else 9


def surname_keys(p: Person) -> set[str]:
    """Keys of which any two persons share one whose surnames can be variants, see surname_score()."""
    return {k for w in {*(x for x in p.surname if len(x) > 2), "".join(p.surname)} for k in close_keys(w, most_edits)}


def stands_for(w: str) -> set[str]:
    """Names that w may be a nickname of, as it is or misspelt; given_score() takes no other pair for nicknames."""
    return {f for k in deletions(w) for f in _FORMAL.get(k, ())}


def given_score(a: Person, b: Person, known: Container[str] = frozenset()) -> float:
    """Log likelihood that the given names are one name's variants: equal, nickname, typo, initial, missing or another name."""
    if not a.given or not b.given:
        if a.given or b.given:
            x, y = (a, b) if a.given else (b, a)
            if y.nick:
                return 2.0 if any(x.given[0] in _FORMAL.get(n, ()) or x.given[0] == n for n in y.nick) else -6.0
        return 0.0

    def one(x: str, y: str) -> float:
        if x == y:
            return 3.0 if len(x) > 1 else 1.0
        if len(x) == 1 or len(y) == 1:
            return 1.0 if x[0] == y[0] else -6.0
        fx, fy = _FORMAL.get(x, frozenset()), _FORMAL.get(y, frozenset())
        if x in fy or y in fx or fx & fy:
            return 2.5
        # the typo of a known name is seldom another known one
        most = 1 if min(len(x), len(y)) <= 5 else 2
        if not (x in known and y in known) and (d := within(x, y, most)) <= most:
            return 2.3 if d == 1 else 1.5
        if min(len(x), len(y)) >= 6 and within(x, y, 1) <= 1 and not (x in known and y in known):
            return 1.8
        for n, f in ((x, y), (y, x)):  # a misspelt nickname
            if n not in known and len(n) >= 4 and any(f in _FORMAL[k] for k in deletions(n) if k in _FORMAL):
                return 1.2
        if len(x) >= 3 and len(y) >= 3 and (x.startswith(y) or y.startswith(x)) and not (x in known and y in known):
            return 1.0
        return -6.0

    best = one(a.given[0], b.given[0])
    if best < 0:
        # a middle name used as the first, or a first name that is missing
        other = [one(x, y) - 1.5 for i, x in enumerate(a.given) for j, y in enumerate(b.given) if i + j and len(x) > 1 and len(y) > 1]
        best = max([best, *(x for x in other if x > 0)])
    elif len(a.given) > 1 and len(b.given) > 1:
        second = one(a.given[1], b.given[1])
        best += 0.7 if second > 0 else -1.5
    return best


def surname_score(a: Person, b: Person) -> float | None:
    """Log likelihood that the surnames are one name's variants, None if they can't be: few edits, or one of two names is common to both."""
    if not a.surname or not b.surname:
        return None
    x, y = "".join(a.surname), "".join(b.surname)
    d = word_edits(x, y)
    if d < 9:
        return (6.0, 4.5, 3.0, 1.5)[d]
    if len(a.surname) > 1 or len(b.surname) > 1:
        # a double name of which one part is missing, or whose parts changed places
        few, many = sorted((a.surname, b.surname), key=len)
        found = [min((word_edits(u, v) for v in many if len(u) > 3), default=9) for u in few]
        good = [k for k in found if k < 9]
        if len(good) == len(few):
            return 5.0 - 1.2 * sum(good) if len(few) > 1 else 4.0 - 1.2 * good[0]
        if good and len(few) > 1:
            return 2.0 - 1.2 * min(good)
    return None


def date_score(a: Person, b: Person) -> float:
    """Log likelihood ratio of the birth dates: parts agree, are missing, differ by a slip, or differ."""

    def part(x: int | None, y: int | None, same: float, slip: float, other: float) -> float:
        if x is None or y is None:
            return 0.0
        if x == y:
            return same
        close = abs(x - y) == 1 or f"{x:02d}" == f"{y:02d}"[::-1] or x // 10 == y // 10 or x % 10 == y % 10
        return slip if close else other

    out = part(a.year, b.year, 3.5, -1.5, -3.5)
    if None not in (a.month, a.day, b.month, b.day) and (a.month, a.day) == (b.day, b.month) and a.month != a.day:
        return out + 3.5
    return out + part(a.month, b.month, 2.2, -1.5, -2.7) + part(a.day, b.day, 3.0, -1.5, -2.7)


def likelihood(a: Person, b: Person, known: Container[str] = frozenset()) -> float:
    """Sum of the scores of surname, given name and date; -inf if the surnames can't be one."""
    s = surname_score(a, b)
    if s is None:
        return float("-inf")
    return s + given_score(a, b, known) + date_score(a, b)


class Words:
    """A set of words as a bitmap of a fixed size, whatever their number; each word sets three bits. Up to 100,000 words, one in 100,000 others is taken for one of them."""

    BITS = 2**24

    def __init__(self, bitmap: bytes | None = None):
        self.bitmap = bitmap or bytes(self.BITS // 8)

    @classmethod
    def at(cls, w: str) -> list[int]:
        h = xxhash.xxh3_64_intdigest(w)
        return [(h >> s) % cls.BITS for s in (0, 20, 40)]

    def __contains__(self, w: str) -> bool:
        return all(self.bitmap[k >> 3] >> (k & 7) & 1 for k in self.at(w))

    @classmethod
    def of(cls, words: DataFrame, word: str, more: Callable[[str], Iterable[str]] = lambda w: ()) -> Words:
        """The words of a column, and what `more` gives for each of them. Tasks send bitmaps, no words."""

        def mark(batches):
            bits = np.zeros(cls.BITS, bool)
            for pdf in batches:
                bits[[k for w in pdf[word].dropna() for x in (w, *more(w)) for k in cls.at(x)]] = True
            yield pd.DataFrame({"bitmap": [np.packbits(bits, bitorder="little").tobytes()]})

        parts = words.select(word).coalesce(8).mapInPandas(mark, "bitmap binary").collect()
        return cls(np.bitwise_or.reduce([np.frombuffer(r["bitmap"], np.uint8) for r in parts]).tobytes() if parts else None)


def _near(w: str) -> list[str]:
    """What tells a word that another is it with a letter less, or with another letter in its place."""
    return [f"-{w[:i]}{w[i + 1 :]}" for i in range(len(w))] + [f"{i}.{w[:i]}{w[i + 1 :]}" for i in range(len(w))]


class Givens:
    """Known given names. A name of five letters or more is also known if it is a known one's typo: a letter more, less or another, or two that changed places."""

    #: Words of which it is remembered whether they are known.
    KEPT = 200_000

    def __init__(self, names: Words):
        self.names = names
        self._seen: dict[str, bool] = {}

    @classmethod
    def of(cls, words: DataFrame, word: str) -> Givens:
        return cls(Words.of(words, word, lambda w: _near(w) if len(w) >= 5 else ()))

    def __contains__(self, w: str) -> bool:
        known = self._seen.get(w)
        if known is None:
            if len(self._seen) > self.KEPT:
                self._seen.clear()
            known = self._seen[w] = self._known(w)
        return known

    def _known(self, w: str) -> bool:
        if w in self.names:
            return True
        if len(w) < 5:
            return False
        fewer = {w[:i] + w[i + 1 :] for i in range(len(w))}
        swapped = (w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1))
        other = (f"{i}.{w[:i]}{w[i + 1 :]}" for i in range(len(w)))
        return f"-{w}" in self.names or any(x in self.names for xs in (fewer, swapped, other) for x in xs)
