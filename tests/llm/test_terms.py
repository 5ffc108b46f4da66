import math
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinweave.llm import terms

ROWS = [
    (1, ["st", " ST ", "main", None, "", "  "], "x"),
    (1, ["st", " ST ", "main", None, "", "  "], "x"),  # delivered twice
    (2, ["st", "oak"], "y"),
    (3, [], "z"),
    (4, None, None),
    (None, ["st"], "n"),
    (5, ["oak", "elm", "b" * 5000], "c"),
    (6, ["elm", "oak"], "c"),
]
SCHEMA = "record_id long, terms array<string>, term string"


def plain(rows):
    recs = {i: [t.strip().lower() for t in ts if t and t.strip()] for i, ts, *_ in rows if i is not None and ts is not None}
    n = Counter(t for ts in recs.values() for t in set(ts))
    return recs, n


def brute_best(rows):
    recs, n = plain(rows)
    best = {}
    for i, ts in recs.items():
        scores = [(-round(c * math.log(len(recs) / n[t]), 9), t.encode()) for t, c in Counter(ts).items() if n[t] >= 2]
        if scores:
            best[i] = min(scores)[1].decode()
    return best


def found_best(df):
    s = terms.relevance(df, k1=math.inf, b=0, idf="plain", least_records=2)
    return {r["record_id"]: r["term"] for r in terms.most_characteristic(s).collect()}


def test_most_characteristic(table):
    df = table(ROWS, SCHEMA)
    assert found_best(df) == brute_best(ROWS) == {1: "st", 2: "st", 5: "elm", 6: "elm"}
    assert found_best(df.limit(0)) == {}


def test_frequencies_and_marks(table):
    recs, n = plain(ROWS)
    got = {r["term"]: (r["occurrences"], r["n_records"], round(r["frequency"], 9), r["mark"]) for r in terms.term_frequencies(table(ROWS, SCHEMA), rare=1, common=0.5).collect()}
    occ = Counter(t for ts in recs.values() for t in ts)
    want = {t: (occ[t], k, round(k / len(recs), 9), "rare" if k <= 1 else "common" if k > len(recs) * 0.5 else None) for t, k in n.items()}
    assert got == want
    assert terms.term_frequencies(table([], SCHEMA)).count() == 0


@pytest.mark.parametrize("heavy", [[], ["st"], ["st", "oak", "nowhere"]])
def test_counts_dont_depend_on_the_heavy_terms(table, heavy):
    posts = terms.postings(terms.records(table(ROWS, SCHEMA)))
    _, n = plain(ROWS)
    assert {r["term"]: r["n_records"] for r in terms.term_counts(posts, heavy).collect()} == dict(n)


def test_heavy_terms_are_the_frequent_ones(spark, table):
    df = table([(i, ["hot", f"t{i}", "warm"] if i % 2 else ["hot", f"t{i}"]) for i in range(400)], "record_id long, terms array<string>")
    assert set(terms.heavy_terms(terms.postings(terms.records(df)), 4)) >= {"hot", "warm"}


def test_relevance_by_the_formula(table):
    recs, n = plain(ROWS)
    mean = sum(map(len, recs.values())) / len(recs)
    want = {}
    for i, ts in recs.items():
        for t, c in Counter(ts).items():
            w = math.log(1 + (len(recs) - n[t] + 0.5) / (n[t] + 0.5))
            want[i, t] = w * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ts) / mean))
    got = {(r["record_id"], r["term"]): r["score"] for r in terms.relevance(table(ROWS, SCHEMA)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        terms.relevance(table(ROWS, SCHEMA), k1=math.inf)
    with pytest.raises(ValueError):
        terms.relevance(table(ROWS, SCHEMA), idf="other").count()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 8), st.lists(st.sampled_from(["a", "A ", "b", "é", "", None]), max_size=6)), max_size=12))
def test_any_table(table, data):
    one = defaultdict(list)
    for i, ts in data:
        one[i] = ts
    rows = [(i, ts, "x") for i, ts in one.items()]
    assert found_best(table(rows, SCHEMA)) == brute_best(rows)
