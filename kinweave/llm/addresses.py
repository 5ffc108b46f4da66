"""Address records that denote the same house or post office box, however they are written."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.edits import close_pairs
from kinweave.runtime import lookup, materialize, once, spread

#: Street types and how people write them.
TYPES = {
    "street": "street str st strt",
    "avenue": "avenue ave av aven avn",
    "road": "road rd",
    "lane": "lane ln la",
    "drive": "drive dr drv",
    "court": "court ct crt",
    "boulevard": "boulevard blvd boul boulv",
    "place": "place pl plc",
    "terrace": "terrace ter terr",
    "parkway": "parkway pkwy pky parkwy",
    "highway": "highway hwy hiway highwy",
    "square": "square sq sqr",
    "circle": "circle cir circ",
    "crescent": "crescent cres crsnt",
    "trail": "trail trl",
    "way": "way wy",
    "alley": "alley aly ally",
    "row": "row",
    "walk": "walk wlk",
    "close": "close cl",
    "plaza": "plaza plz",
    "quay": "quay",
}
#: Directions of streets.
DIRECTIONS = {"north": "north no n", "south": "south so s", "east": "east e", "west": "west w", "northeast": "northeast ne", "northwest": "northwest nw", "southeast": "southeast se", "southwest": "southwest sw"}
#: First words of towns.
TOWN_WORDS = {"fort": "fort ft", "saint": "saint st", "mount": "mount mt", "port": "port pt", "new": "new n nw", "north": "north no", "south": "south s so", "east": "east e", "west": "west w", "lake": "lake lk", "point": "point pnt"}
#: What stands before the number of a part of a house, and before a house number.
UNIT = "apartment|apt|suite|ste|unit|floor|flr|fl|room|rm|flat|building|bldg"
NUMBER = "no|nr|num|number"
#: Ordinals in words.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()

#: Post office boxes in full and abbreviated.
BOX = r"p\s*o\s*b(?:ox)?|po\s*box|post\s*office\s*box|postbox|pob|box"


def _written(table: dict[str, str]) -> dict[str, str]:
    return {w: k for k, ws in table.items() for w in ws.split()}


@dataclass(frozen=True)
class Locale:
    """The dictionaries of a language: full words with the ways to write them, and patterns of what stands before numbers.

    With `attached`, a street's type may be the end of its name's last word. `order` gives the ordinals in words, from the first on.
    """

    types: dict[str, str]
    directions: dict[str, str]
    town_words: dict[str, str]
    order: tuple[str, ...] = ()
    unit: str = UNIT
    number: str = NUMBER
    box: str = BOX
    attached: bool = False

    @cached_property
    def type_of(self) -> dict[str, str]:
        return _written(self.types)

    @cached_property
    def direction_of(self) -> dict[str, str]:
        return _written(self.directions)

    @cached_property
    def town_word_of(self) -> dict[str, str]:
        return _written(self.town_words)

    @cached_property
    def ordinal_of(self) -> dict[str, str]:
        return {w: str(i + 1) for i, w in enumerate(self.order)}

    @cached_property
    def patterns(self) -> dict[str, re.Pattern]:
        part = r"(?:\d+\s?[a-z]?|[a-z])"
        return {
            "box": re.compile(rf"^(?:{self.box})\s*#?\s*(?:no\s+|nr\s+)?(\d+)\b\s*"),
            "unit": re.compile(rf"(?:^|\s)(?:{self.unit})\s+#?\s*{part}(?=\s|$)"),
            "only": re.compile(rf"^(?:(?:{self.unit})\s*#?\s*{part}|#\s*\d+\s?[a-z]?)$"),
            "first": re.compile(rf"^(?:(?:{self.number})\s+)?#?\s*(\d+)[\s-]?([a-z])?(?=\s|$)\s*"),
            "final": re.compile(rf"(?:^|\s)(?:(?:{self.number})\s+)?#?\s*(\d+)[\s-]?([a-z])?$"),
        }

    def split(self, w: str) -> tuple[str, str]:
        """A word's beginning and the type that it ends in, "" without one."""
        ends = [k for k in self.type_of if len(k) > 2 and len(w) - len(k) >= 3 and w.endswith(k)] if self.attached else []
        k = max(ends, key=len, default="")
        return (w[: len(w) - len(k)], self.type_of[k]) if k else (w, "")


ENGLISH = Locale(TYPES, DIRECTIONS, TOWN_WORDS, tuple(ORDINALS))
#: German street types, directions, first words of towns, and what stands before numbers.
GERMAN = Locale(
    {"strasse": "strasse str", "weg": "weg wg", "platz": "platz pl", "gasse": "gasse g", "allee": "allee al", "ring": "ring", "damm": "damm", "ufer": "ufer", "chaussee": "chaussee ch"},
    {"nord": "nord n", "sued": "sued sud s", "ost": "ost o", "west": "west w"},
    {"sankt": "sankt st", "bad": "bad", "neu": "neu", "alt": "alt"},
    unit="wohnung|whg|etage|stock|og|zimmer|haus|apartment|apt",
    number="nr|nummer|hausnummer",
    box="postfach|pf",
    attached=True,
)
_UNIT_SIGN = re.compile(r"(?:^|\s)#\s*\d+\s?[a-z]?(?=\s|$)")
_TAIL = re.compile(r"^(?P<city>.*?)[\s,]*(?:\b(?P<state>[a-z]{2}))?[\s,]*(?P<zip>\d{5}(?:-\d{4})?|\d{4})?$")


def plain(s: str | None) -> str:
    """Lower case, without accents and stray white space; only letters, digits, commas, # and - stay."""
    if not s:
        return ""
    s = s.casefold()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s.replace("ø", "o").replace("æ", "ae").replace("ß", "ss")) if not unicodedata.combining(c))
    s = re.sub(r"\b([a-z])\.\s?(?=[a-z]\b\.?)", r"\1", s)  # p.o. becomes po
    return " ".join(re.sub(r"[^a-z0-9,#-]", " ", s).split())


def _city(s: str, locale: Locale = ENGLISH) -> str:
    """A town's name with its first word in full."""
    words = re.sub(r"[^a-z ]", "", s.replace("-", " ")).split()
    if len(words) > 1 and words[0] in locale.town_word_of:
        words[0] = locale.town_word_of[words[0]]
    return " ".join(words)


def _zip(s: str) -> str:
    digits = re.sub(r"[^0-9-]", "", s).split("-")[0]
    return digits.zfill(5) if len(digits) in (4, 5) else ""


_LOOKALIKE = str.maketrans("015", "ols")


def _street(s: str, locale: Locale = ENGLISH) -> tuple[str, str, str]:
    """Direction, name and type of a street, "" if missing. What stands before the name's last word is part of the name."""
    words = s.replace(",", " ").replace("#", " ").replace("-", "").split()
    directions, types, ordinals = locale.direction_of, locale.type_of, locale.ordinal_of
    direction = kind = ""
    if len(words) > 1 and words[-1] in directions and words[0] not in directions:
        direction = directions[words.pop()]
    elif len(words) > 1 and words[0] in directions:
        direction = directions[words.pop(0)]
    if len(words) > 1 and words[-1] in types:
        kind = types[words.pop()]
        if not direction and len(words) > 1 and words[-1] in directions:
            direction = directions[words.pop()]
    elif len(words) > 1 and words[0] in types and words[0] not in ("st", "la"):
        kind = types[words.pop(0)]
    if not direction and len(words) > 1 and words[0] in directions:
        direction = directions[words.pop(0)]
    if not kind and words:
        words[-1], kind = locale.split(words[-1])
    named = []
    for w in words:
        if w in ordinals:
            w = ordinals[w]
        elif m := re.fullmatch(r"(\d+)(?:st|nd|rd|th)", w):
            w = m[1]
        elif re.search("[a-z]", w) and re.search(r"\d", w):
            w = w.translate(_LOOKALIKE)
        named.append(w)
    return direction, " ".join(named), kind


def parse(street1: str | None, street2: str | None, city: str | None, state: str | None, postal: str | None, locale: Locale = ENGLISH) -> tuple[str, str, str, str, str, str, str, str]:
    """(kind, number, direction, name, type, city, state, zip) with "" for what is missing; kind is "house", "box" or ""."""
    is_ = locale.patterns
    city_of = lambda x: _city(x, locale)
    lines = [plain(street1).strip(" ,"), plain(street2).strip(" ,")]
    city_text, state_text, zip_text = plain(city).strip(" ,"), plain(state).strip(" ,"), plain(postal)
    place, region, code = city_of(city_text), state_text if re.fullmatch("[a-z]{2}", state_text) else "", _zip(zip_text)
    if city_text and (re.search(r"\d", city_text) or "," in city_text):
        t = re.sub(r"^(\d{4,5}(?:-\d{4})?)[\s,]+", lambda m: "", city_text)
        if t != city_text:
            code = code or _zip(city_text.split()[0].strip(","))
        m = re.match(r"^(?P<city>.*?),?\s*(?:,\s*(?P<state>[a-z]{2}))?\s*(?P<zip>\d{4,5}(?:-\d{4})?)?$", t)
        if m:
            place, region, code = city_of(m["city"]), region or m["state"] or "", code or _zip(m["zip"] or "")
    if state_text and not region:
        m = _TAIL.match(state_text)
        if m and m["state"] and not m["city"]:
            region, code = m["state"], code or _zip(m["zip"] or "")
    line = lines[0]
    parts = [p.strip() for p in line.split(",") if p.strip()]
    # the town within the street's line: "..., town, ST 12345"
    if len(parts) > 1 and not place:
        end = parts[-1]
        if m := re.fullmatch(r"([a-z]{2})(?:\s+(\d{4,5}(?:-\d{4})?))?", end):
            region, code = region or m[1], code or _zip(m[2] or "")
            parts.pop()
            if len(parts) > 1:
                place = city_of(parts.pop())
        elif m := re.fullmatch(r"([a-z .-]+?)\s+([a-z]{2})\s+(\d{4,5}(?:-\d{4})?)", end):
            place, region, code = city_of(m[1]), region or m[2], code or _zip(m[3])
            parts.pop()
    text = " ".join(parts)
    if not text or is_["only"].match(text):
        text = lines[1].replace(",", " ")
    text = " ".join(text.replace(" - ", " ").split())
    if m := is_["box"].match(text):
        return "box", m[1].lstrip("0"), "", "", "", place, region, code
    if lines[1] and (m := is_["box"].match(lines[1])) and not re.search(r"\d", text):
        return "box", m[1].lstrip("0"), "", "", "", place, region, code
    text = " ".join(is_["unit"].sub(" ", f" {text} ").split())
    number = ""
    if m := is_["first"].match(text):
        rest = text[m.end() :]
        # a single letter is a direction rather than the number's letter if the street has none and it may be one
        letter = m[2] or ""
        if letter and letter in "nsew" and text[m.end(1) : m.end(1) + 1] == " " and rest.strip() and not re.match(r"(?:north|south|east|west|no|so)\b", rest):
            rest, letter = f"{letter} {rest}", ""
        if rest.strip() and not re.fullmatch(r"(?:st|nd|rd|th)\b.*", rest):
            number, text = m[1].lstrip("0") + letter, rest
    if number or re.search(r"\d[a-z]?\s+#\s*\d+\s?[a-z]?$", text):
        text = " ".join(_UNIT_SIGN.sub(" ", f" {text} ").split())
    if not number and (m := is_["final"].search(text)):
        number, text = m[1].lstrip("0") + (m[2] or ""), text[: m.start()].strip()
    if not number:
        return "", "", "", "", "", place, region, code
    direction, name, kind = _street(text, locale)
    return "house" if name else "", number, direction, name, kind, place, region, code


COLUMNS = ("street1", "street2", "city", "state", "postal_code")
_PARSED = "kind string, number string, direction string, name string, type string, city string, state string, zip string"


def parsed(addresses: DataFrame, id: str = "record_id", locale: Locale = ENGLISH) -> DataFrame:
    """Column id and the parts that parse() finds, a row a record. If deliveries differ, the least one counts; a null id is no record."""
    kind = addresses.schema[id].dataType.simpleString()
    rows = spread(materialize(once(addresses.select(F.col(id).alias("id"), *COLUMNS), "id", *COLUMNS)))

    def run(batches):
        names = [c.split()[0] for c in _PARSED.split(", ")]
        for pdf in batches:
            values = pdf[list(COLUMNS)].astype(object).where(pdf[list(COLUMNS)].notna(), None)
            out = pd.DataFrame([parse(*r, locale) for r in values.itertuples(index=False)], columns=names, dtype=object)
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    return rows.mapInPandas(run, f"id {kind}, {_PARSED}")


def _towns(p: DataFrame) -> DataFrame:
    """Columns city, state, zip and town for each combination that occurs. A town is known by the postal code and the name that go together most.

    In this order: the name is a town's in that state; the code is a town's and the name missing or within two edits of its name;
    the name is within two edits of a single nearest town's name in the state; the code is a town's. Else the combination is its own town.
    """
    combos = p.groupBy("city", "state", "zip").agg(F.count("*").alias("n"))
    full = combos.where((F.col("city") != "") & (F.col("zip") != "") & (F.col("state") != ""))
    pairs = full.groupBy("city", "zip").agg(F.sum("n").alias("n"), F.max_by("state", "n").alias("state"))
    by_zip = pairs.groupBy("zip").agg(F.max(F.struct("n", "city", "state")).alias("top")).select("zip", "top.city", "top.state", "top.n")
    by_city = pairs.groupBy("city", "state").agg(F.max(F.struct("n", "zip")).alias("top")).select("city", "state", F.col("top.zip").alias("zip"))
    towns = materialize(by_zip.where(F.col("n") >= 2).join(by_city, ["city", "state", "zip"], "left_semi").select("zip", "city", "state", "n"))
    named = towns.groupBy("city").agg(F.count("*").alias("k"), F.max("zip").alias("only")).where(F.col("k") == 1).select("city", "only")
    c = combos.join(towns.select("zip", F.col("city").alias("city1")), "zip", "left")
    c = c.join(towns.select("city", "state", F.col("zip").alias("zip2")), ["city", "state"], "left").join(named, "city", "left")
    c = c.withColumn("zip2", F.coalesce("zip2", F.when(F.col("state") == "", F.col("only")))).drop("only")
    odd = c.where(F.col("zip2").isNull() & (F.col("city") != "")).select("city", "state", F.lit(1).alias("n")).distinct()
    close = close_pairs(odd, towns.select("city", "state", "n"), "city", ["state"], more=False)
    best = close.groupBy("city", "state").agg(F.min(F.struct("edits", (-F.col("other_n")).alias("m"), "other")).alias("best")).select("city", "state", F.col("best.other").alias("other"))
    best = best.join(towns.select("state", F.col("city").alias("other"), F.col("zip").alias("zip3")), ["state", "other"])
    c = c.join(best, ["city", "state"], "left")
    fits = F.col("city1").isNotNull() & ((F.col("city") == "") | (F.levenshtein("city", "city1") <= 3))
    own = F.concat_ws("|", "city", "state", "zip")
    town = F.coalesce("zip2", F.when(fits, F.col("zip")), "zip3", F.when(F.col("city1").isNotNull(), F.col("zip")), own)
    return c.groupBy("city", "state", "zip").agg(F.min(town).alias("town"))


def _first_words(houses: DataFrame) -> list[str]:
    """First words of names of several words, each in a thousandth of such records: at most a thousand. None is another one's misspelling."""
    first = houses.where(F.contains("name", F.lit(" "))).groupBy(F.split("name", " ")[0].alias("word")).agg(F.count("*").alias("n"))
    total = first.agg(F.sum("n").alias("n_all"))
    found = first.crossJoin(F.broadcast(total)).where((F.col("n") * 1000 >= F.col("n_all")) & (F.col("n") >= 3))
    return sorted(r["word"] for r in found.select("word").collect())


def _one_word(first: list[str]) -> Column:
    """The names in `name` and `other` don't begin with two different ones of these words."""
    a, b = F.split("name", " ")[0], F.split("other", " ")[0]
    return (a == b) | ~(a.isin(first) & b.isin(first)) if first else F.lit(True)


def _spellings(houses: DataFrame, first: list[str]) -> DataFrame:
    """Columns town, name and street for names that are another street's misspelling: rare beside one within two edits in their town."""
    names = materialize(houses.groupBy("town", "name").agg(F.count("*").alias("n")).where(F.col("name").rlike("[a-z]")))
    rare = names.where(F.length("name") >= 4)
    close = close_pairs(rare, names.where(F.col("n") >= 2), "name", ["town"])
    ok = F.when(F.col("edits") == 1, F.col("other_n") >= 2 * F.col("n")).otherwise((F.col("other_n") >= 3 * F.col("n")) & (F.length("name") >= 6))
    best = close.where(ok & _one_word(first)).groupBy("town", "name").agg(F.min(F.struct("edits", (-F.col("other_n")).alias("m"), "other")).alias("best"))
    step = materialize(best.select("town", "name", F.col("best.other").alias("street")))
    again = step.select("town", F.col("name").alias("street"), F.col("street").alias("further"))
    return step.join(again, ["town", "street"], "left").select("town", "name", F.coalesce("further", "street").alias("street"))


def _lone(houses: DataFrame, first: list[str]) -> DataFrame:
    """Columns town, number, name and street: names in few records join a close name of the same house number, the more frequent or first one."""
    few = houses.groupBy("town", "name").agg(F.count("*").alias("n_name"))
    forms = houses.groupBy("town", "number", "name").agg(F.count("*").alias("n")).join(few, ["town", "name"])
    forms = materialize(forms.where(F.col("name").rlike("[a-z]") & (F.length("name") >= 5)).select("town", "number", "name", F.col("n_name").alias("n")))
    close = close_pairs(forms.where(F.col("n") <= 2), forms, "name", ["town", "number"])
    before = (F.col("other_n") > F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.col("other") < F.col("name")))
    best = close.where(before & _one_word(first) & (F.col("edits") <= F.when(F.length("name") >= 6, 2).otherwise(1)))
    best = best.groupBy("town", "number", "name").agg(F.min(F.struct("edits", (-F.col("other_n")).alias("m"), "other")).alias("best"))
    step = materialize(best.select("town", "number", "name", F.col("best.other").alias("street")))
    again = step.select("town", "number", F.col("name").alias("street"), F.col("street").alias("further"))
    return step.join(again, ["town", "number", "street"], "left").select("town", "number", "name", F.coalesce("further", "street").alias("street"))


def _completed(houses: DataFrame) -> DataFrame:
    """town, number, street, direction and type of each form, and full_direction and full_type with what is missing filled in.

    A missing type is any type; a missing direction is any direction where the street is rarely written without one (in a quarter of its
    records at most), and else says that there is none. The forms of the same house number that fit are looked at first, then
    those of the same street; what is missing is taken from them if they agree, and stays missing otherwise.
    """
    street = ["town", "street"]
    kinds = houses.groupBy(*street, "direction", "type").agg(F.count("*").alias("n"))
    told = kinds.groupBy(*street).agg(F.sum(F.when(F.col("direction") == "", F.col("n")).otherwise(0)).alias("without"), F.sum("n").alias("n_all"), F.collect_set(F.when((F.col("type") != "") & (F.col("n") >= 2), F.struct("direction", "type"))).alias("street_forms"))
    by_type = kinds.where(F.col("type") != "").groupBy(*street, "type").agg(F.sum(F.when(F.col("direction") == "", F.col("n")).otherwise(0)).alias("t_without"), F.sum("n").alias("t_all"))
    forms = houses.groupBy("town", "number", "street", "direction", "type").agg(F.count("*").alias("n"))
    at = forms.groupBy("town", "number", "street").agg(F.collect_set(F.when(F.col("type") != "", F.struct("direction", "type"))).alias("house_forms"))
    f = forms.join(told, street).join(by_type, [*street, "type"], "left").join(at, ["town", "number", "street"])
    few = lambda without, everything: F.col(without) * 4 <= F.col(everything) - F.col(without)
    open_direction = (F.col("direction") == "") & F.when(F.col("type") == "", few("without", "n_all")).otherwise(few("t_without", "t_all"))
    f = f.withColumn("open", open_direction)
    todo = F.col("open") | (F.col("type") == "")
    fit = lambda x: (F.col("open") | (x["direction"] == F.col("direction"))) & ((F.col("type") == "") | (x["type"] == F.col("type")))
    full = lambda x: ~F.col("open") | (x["direction"] != "")
    house = F.array_distinct(F.filter("house_forms", lambda x: fit(x) & full(x)))
    known = F.array_distinct(F.filter("street_forms", lambda x: fit(x) & full(x)))
    pick = F.when(F.size(house) == 1, house[0]).when((F.size(house) == 0) & (F.size(known) == 1), known[0])
    f = f.withColumn("pick", F.when(todo, pick))
    return f.select("town", "number", "street", "direction", "type", F.coalesce("pick.direction", "direction").alias("full_direction"), F.coalesce("pick.type", "type").alias("full_type"))


def locations(addresses: DataFrame, id: str = "record_id", locale: Locale = ENGLISH) -> DataFrame:
    """Columns {id} and location for each record whose address has a house number and street, or a post office box.

    Lines are parsed (number, direction, name, type; units and floors are left out), abbreviations written in full, the town found by name
    and postal code, misspelt streets set right by the town's frequent ones, and a missing type or direction
    taken from the records that fit, if these agree. The dictionaries are those of `locale`. Equal parts are one location. Records with neither, or without an id, have no row;
    empty tables give none. Further columns don't matter.
    """
    p = materialize(parsed(addresses, id, locale))
    towns = materialize(_towns(p))
    key = F.concat_ws("\u0001", "city", "state", "zip")
    p = lookup(p.where(F.col("kind") != "").withColumn("place", key), towns.select(key.alias("place"), "town"), "place")
    p = materialize(p.select("id", "kind", "town", "number", "direction", "name", "type"))
    boxes = p.where(F.col("kind") == "box").select("id", F.concat_ws("|", F.lit("box"), "town", "number").alias("location"))
    houses = p.where(F.col("kind") == "house")
    first = _first_words(houses)
    houses = houses.join(_spellings(houses, first), ["town", "name"], "left").withColumn("name", F.coalesce("street", "name")).drop("street")
    houses = materialize(houses)
    houses = houses.join(_lone(houses, first), ["town", "number", "name"], "left").withColumn("street", F.coalesce("street", "name")).drop("name")
    houses = materialize(houses)
    done = houses.join(_completed(houses), ["town", "number", "street", "direction", "type"])
    found = done.select("id", F.concat_ws("|", F.lit("house"), "town", "number", "street", "full_direction", "full_type").alias("location"))
    return boxes.unionByName(found).withColumnRenamed("id", id)


def same_location(addresses: DataFrame, id: str = "record_id", locale: Locale = ENGLISH) -> DataFrame:
    """Columns {id}_l and {id}_r, smaller id first: all pairs of records of one location. See locations()."""
    from kinweave.llm.groups import pairs_of_groups

    return pairs_of_groups(locations(addresses, id, locale), id, "location")
