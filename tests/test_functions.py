import math

import pytest
from pyspark.sql import functions as F

from kinweave.functions import arrays, contacts, names, sets, structs, text, vectors
from kinweave.functions.similarity import damerau, jaro, jaro_winkler, metaphone_codes
from kinweave.functions.streets import TYPES, AddressesDimension, canonical_type, geocode, norm_field, parse_street, street_type, tagged


def one(table, rows, schema, f):
    return [r[0] for r in table([(x,) for x in rows], f"x {schema}").select(f(F.col("x"))).collect()]


def test_ngrams(table):
    assert [sorted(x) if x is not None else None for x in one(table, ["wxyz", "", "q", None, "up\tto"], "string", lambda x: text.ngrams(x, 2))] == [["wx", "xy", "yz"], [], [], None, ["\tt", "p\t", "to", "up"]]
    with pytest.raises(ValueError):
        text.ngrams(F.col("x"), 0)


def test_tokenize_and_whitespace(table):
    assert one(table, ["  oak \t elm yew ", "\n", "", None], "string", text.tokenize) == [["oak", "elm", "yew"], [], [], None]
    assert one(table, ["\n fig  \t tree ", None], "string", text.norm_whitespace) == ["fig tree", None]


def test_accents(table):
    given = ["Frédéric", "ñandú", "Łódź", "ÅNGSTRÖM", "œuf", None]
    assert one(table, given, "string", text.strip_accents) == ["Frederic", "nandu", "Łodz", "ANGSTROM", "œuf", None]
    assert one(table, given, "string", text.strip_accents_everywhere) == ["Frederic", "nandu", "Łodz", "ANGSTROM", "œuf", None]


def test_similarities(table):
    df = table([("willow", "willow"), ("reed", "road"), ("oak", "elm"), ("", ""), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(text.levenshtein_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 0.5, 0.0] and math.isnan(got[3]) and got[4] is None
    got = [r[0] for r in df.select(text.jaro_winkler_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[3] == 0.0 and got[4] is None
    assert damerau("grove", "gorve") == 1 and damerau("ridge", "bridges") == 2 and damerau("", "elm") == 3
    assert abs(jaro("ridge", "bridge") - 17 / 18) < 1e-9 and abs(jaro("reed", "road") - 2 / 3) < 1e-9
    assert abs(jaro_winkler("ridge", "ridges") - (17 / 18 + 0.4 / 18)) < 1e-9 and jaro("a", "") == 0


def test_sounds():
    assert metaphone_codes("Smith") == ("SM0", "XMT")
    assert metaphone_codes("knight") == ("NT", "NT")
    assert metaphone_codes("Thomas") == ("TMS", "TMS")
    assert metaphone_codes("") == ("", "")


def test_regex_struct(table):
    got = one(table, ["ab12", "zz", None], "string", lambda x: text.re_extract_struct(x, r"(?P<w>[a-z]+)(?P<n>\d+)?q?", False))
    assert [tuple(r) if r else None for r in got] == [("ab", "12"), ("zz", ""), None]
    with pytest.raises(ValueError):
        text.re_extract_struct(F.col("x"), "a")


@pytest.mark.parametrize("f, want", [(arrays.array_min, [1, None, None, None]), (arrays.array_max, [3, None, None, None]), (arrays.array_sum, [6, None, None, None]), (arrays.array_mean, [2, None, None, None]), (arrays.array_median, [2, None, None, None])])
def test_array_statistics(table, f, want):
    assert one(table, [[1, 2, 3, None], [None, None], [], None], "array<int>", f) == want


def test_array_bools(table):
    given = [[True, None], [False, None], [None], [], None, [True, False]]
    assert one(table, given, "array<boolean>", arrays.array_any) == [True, False, None, None, None, True]
    assert one(table, given, "array<boolean>", arrays.array_all) == [True, False, None, None, None, False]


def test_array_filter_isin_other(table):
    given = [[1, 2, 3], [1, 2, 2], [2, None, 2], [1], [], None]
    df = table([(i, x) for i, x in enumerate(given)], "i int, a array<int>")
    got = arrays.array_filter_isin_other(df, "a", table([(2,), (2,), (None,)], "o int"), "o").orderBy("i").collect()
    assert [r["a_filtered"] for r in got] == [[2], [2, 2], [2, 2], [], [], None]


def test_array_order(table):
    assert one(table, [[3, 1, 2]], "array<int>", lambda x: arrays.array_sort(x, lambda v: -v)) == [[3, 2, 1]]
    assert one(table, [[3, 1, 2]], "array<int>", arrays.list_grade_up) == [[1, 2, 0]]
    assert one(table, [[3, 1, 2]], "array<int>", lambda x: arrays.list_select(x, F.array(F.lit(2), F.lit(9)))) == [[2, None]]
    assert [sorted(x) for x in one(table, [[3, 1, 2]], "array<int>", lambda x: arrays.array_choice(x, 5, 1))] == [[1, 2, 3]]
    assert len(arrays.array_combinations_first_n(F.col("a"), F.col("b"), 2)) == 4
    with pytest.raises(ValueError):
        arrays.array_combinations_first_n(F.col("a"), F.col("b"), -1)


def test_sets(table):
    df = table([([], []), ([1], [1, 2]), ([1, 2, 3, 4], [3, 4, 5, 6, 7, 8]), (None, [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(sets.jaccard(F.col("a"), F.col("b"))).collect()] == [0, 0.5, 0.25, None]
    assert one(table, [["x", "y", "x", None], [], None, [None]], "array<string>", sets.array_value_counts) == [{"x": 2, "y": 1}, {}, None, {}]
    lines = ["red oak hill", "white oak mill", "red elm", "tall white pine"]
    docs = table([(s.split(),) for s in lines], "t array<string>")
    assert dict(map(tuple, sets.document_counts(docs, "t").collect())) == {"red": 2, "oak": 2, "hill": 1, "white": 2, "mill": 1, "elm": 1, "tall": 1, "pine": 1}
    assert {r[0] for r in sets.rare_terms(docs, "t", max_records_n=1).collect()} == {"hill", "mill", "elm", "tall", "pine"}
    with pytest.raises(ValueError):
        sets.rare_terms(docs, "t")


def test_tfidf(table):
    df = table([(1, ["a", "a", "b"]), (2, ["b"]), (3, []), (4, None)], "id int, t array<string>")
    got = {r["id"]: r["t_tfidf"] for r in sets.add_tfidf(df, "t", normalize=False).collect()}
    assert abs(got[1]["a"] - 2 * math.log(3)) < 1e-9 and abs(got[2]["b"] - math.log(1.5)) < 1e-9 and got[3] == {} and got[4] is None


def test_vectors(table):
    df = table([([1.0, 2.0], [4.0, 5.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.dot(F.col("a"), F.col("b"))).collect()] == [14.0, None, 0.0]
    assert one(table, [[-3.0, 4.0], [], None], "array<double>", vectors.norm) == [5.0, None, None]
    assert one(table, [[-3.0, 4.0]], "array<double>", lambda x: vectors.norm(x, "l1")) == [7.0]
    m = table([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "a map<string, int>, b map<string, int>")
    assert m.select(vectors.dot(F.col("a"), F.col("b"), True)).first()[0] == 6.0
    assert m.select(vectors.mul(F.col("a"), F.col("b"), True)).first()[0] == {"b": 6.0}
    assert m.select(vectors.cosine_similarity(F.col("a"), F.col("b"), True)).first()[0] == 1.0
    with pytest.raises(Exception, match="lengths"):
        table([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.dot(F.col("a"), F.col("b"))).collect()


def test_structs(table):
    df = table([({"a": 1, "b": None},)], "s struct<a: int, b: int>")
    got = df.select(structs.isnull(F.col("s"), ["a", "b"]), structs.isnull(F.col("s"), ["a", "b"], "all"), structs.mutate(F.col("s"), b=F.lit(5))["b"], structs.rename(F.col("s"), ["a", "b"], z="a")["z"]).first()
    assert tuple(got) == (True, False, 5, 1)
    assert structs.unpack(df, "s").columns == ["a", "b"]


@pytest.mark.parametrize("typed, want", [("\tGreta.Lind@Post.example ", "greta.lind@post.example"), ("write to otto@farm.example today", "otto@farm.example"), ("  \n", None), ("", None), ("@ @", None), ("otto@", None), ("@farm.example", None), (None, None)])
def test_email(table, typed, want):
    assert one(table, [typed], "string", contacts.clean_email) == [want]


def test_email_levels(table):
    def level(a, b):
        p = lambda c: contacts.parsed_email(contacts.clean_email(F.col(c), True))
        return table([(a, b)], "a string, b string").select(contacts.email_level(p("a"), p("b"))).first()[0]

    g = "gretalind@post.example"
    assert [level("Greta_Lind@post.example", g), level("greta.lint@post.example", g), level("gretalind@farm.example", g), level("gretalint@farm.example", g), level("o@farm.example", g)] == [0, 1, 2, 3, 4]


PHONES = [("4155550182", "4155550182"), ("1-415-555-0182", "4155550182"), ("call (206) 555 0143 now", "2065550143"), ("+1 206.555.0143", "2065550143"), ("555-01", None), ("20655501", None), ("4150000182", None), ("4159999182", None), ("4151234582", None), ("none given", None), ("", None), (None, None)]


@pytest.mark.parametrize("area", [None, "415"])
def test_phone(table, area):
    assert one(table, [p for p, _ in PHONES], "string", lambda x: contacts.clean_phone_number(x, area)) == [w for _, w in PHONES]
    assert one(table, ["555-0182"], "string", lambda x: contacts.clean_phone_number(x, area)) == ["4155550182" if area else None]


NAME = "prefix string, given string, middle string, surname string, suffix string, nickname string"


def test_name_levels(table):
    def level(a, b):
        f = lambda x: dict(zip(names.PARTS, x, strict=True))
        df = table([(f(a), f(b))], f"a struct<{NAME}>, b struct<{NAME}>")
        return names.NameLevel(df.select(names.name_level(F.col("a"), F.col("b"))).first()[0]).name

    full = ("", "MARGARET", "", "LINDQVIST", "", "")
    assert level(full, full) == "EXACT"
    assert level(full, ("PROF", "MARGARET", "", "LINDQVIST", "", "")) == "GIVEN_SURNAME"
    assert level(full, ("", "PEGGY", "", "LINDQVIST", "", "")) == "NICKNAMES"
    assert level(full, ("", "MARGRAET", "", "LINDQVIST", "", "")) == "TYPO"
    assert level(("", "M", "", "LINDQVIST", "", ""), ("", "MALACHI", "", "LINDQVIST", "", "")) == "INITIALS"
    assert level(full, ("", "OTTO", "", "LINDQVIST", "", "")) == "ELSE"
    assert level(full, ("", None, "", "LINDQVIST", "", "")) == "NULL"


@pytest.mark.parametrize(
    "line, want",
    [
        ("POSTE RESTANTE", None),
        ("OLD MILL UNIT 7", None),
        ("88 FM 1460", ("88", "", "FM 1460", "", "", "", "", "")),
        ("7 2ND", ("7", "", "2ND", "", "", "", "", "")),
        ("19 E LARKSPUR LN", ("19", "E", "LARKSPUR", "LN", "", "", "", "")),
        ("2400 HARVEST BLVD. NW", ("2400", "", "HARVEST", "BLVD", "NW", "", "", "")),
        ("31 TALL PINE AVEN", ("31", "", "TALL PINE", "AVEN", "", "", "", "")),
        ("61 W", ("61", "", "W", "", "", "", "", "")),
        ("P.O. BOX 88", ("", "", "", "", "", "", "", "88")),
        ("RR 5 BOX 31", ("", "", "", "", "", "RR", "5", "31")),
        (" ", None),
    ],
)
def test_streets(line, want):
    assert parse_street(line) == want


def test_street_types(table):
    typed = ["Avenue", "ave.", "AVEN", "BOULV", "PARKWY", "Courts", "CTS", "annex", "beach", "STR", "HIGHWY", "larch", "x", ""]
    assert [street_type(w) for w in typed] == ["AVE", "AVE", "AVE", "BLVD", "PKWY", "CTS", "CTS", "ANX", "BCH", "ST", "HWY", None, None, None]
    assert all(street_type(k) == v and street_type(v) == v for k, v in TYPES.items())
    assert one(table, ["Lane", "zzz", None], "string", canonical_type) == ["LN", None, None]


ADDRESS = "array<struct<street1: string, street2: string, city: string, state: string, postal_code: string, country: string>>"


def test_addresses(table):
    a = lambda s, c="Ourtown", z="12345": {"street1": s, "street2": None, "city": c, "state": "AK", "postal_code": z, "country": "US"}
    df = table([(1, [a("19 Larkspur Ln")]), (2, [a("PO Box 9", "Elsewhere", "99999"), a("19 larkspur ln.")]), (3, []), (4, None)], f"record_id long, addresses {ADDRESS}")
    dim = AddressesDimension()
    made = dim.prepare(df)
    assert {r["record_id"]: r["addresses_featured"]["addresses"] and len(r["addresses_featured"]["addresses"]) for r in made.collect()} == {1: 1, 2: 2, 3: [], 4: None}
    x, y = (made.select(F.col("record_id").alias(f"record_id_{s}"), F.col("addresses_featured").alias(f"addresses_featured_{s}")) for s in "lr")
    got = {(r["record_id_l"], r["record_id_r"]): r["addresses_compared"] for r in dim.compare(x.crossJoin(y)).collect()}
    assert got[1, 1] == 0 and got[1, 2] == 1 and got[1, 3] == 6
    assert one(table, [" a  b! ", "!", None], "string", norm_field) == ["A B", None, None]


def test_geocode_asks_once(table):
    df = table([(1, "1 A St", "X", "AK", "1"), (2, "1 a st ", "x", "ak", "1"), (3, None, None, None, None)], "id int, street string, city string, state string, zipcode string")
    got = {r["id"]: (r["is_match"], r["latitude"]) for r in geocode(df, lambda rows: [(bool(r[0]), "exact", 1.0 if r[0] else None, 2.0) for r in rows]).collect()}
    assert got == {1: (True, 1.0), 2: (True, 1.0), 3: (False, None)}
    tokens = table([([("12", "AddressNumber"), ("Main", "StreetName"), ("Hill", "StreetName")],)], "t array<struct<token: string, label: string>>")
    assert tokens.select(tagged(F.col("t"), "StreetName"), tagged(F.col("t"), "State")).first()[:] == ("Main Hill", None)
