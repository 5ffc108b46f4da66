import random

import numpy as np
import pytest

from kinweave.llm import leakage, packing, truncation

PASSAGE = "When the second audit reached Marrowgate, the customs shed held 1463 iron rivets, 2294 of them polished by Odrin Vale. Nobody in Fennel Cross believed that 4915 barley sacks could vanish without any hurry, least of all Dario Venn. By the harvest fair, only 9299 of the 7319 tin whistles were left."
OTHER = "When the long frost reached Ostrel, the granary held 3802 brass weights, 6016 of them catalogued by Tobias Greel. Nobody in Quillhaven believed that 9428 glass beads could vanish against all advice, least of all Rafe Lindle. By the eclipse, only 12 of the 44 rope ladders were left."
ITEMS = [(1, f"Read the passage and answer.\n{PASSAGE}\nWho polished the rivets?"), (2, f"Read the passage and answer.\n{OTHER}"), (3, None), (4, ""), (5, "too short")]


def leaks(table, texts):
    docs = table([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, share int")
    return sorted((r["item_id"], r["doc_id"]) for r in leakage.leaked(docs, table(ITEMS, "item_id long, text string")).collect())


def test_leaks(table):
    sentences = PASSAGE.split(". ")
    words = PASSAGE.split()
    swapped = " ".join(w if i % 9 else "wagon" for i, w in enumerate(words))
    texts = [
        f"Nice mug. {PASSAGE} Would buy again.",
        "x " + ". ".join(reversed(sentences)),
        PASSAGE.upper().replace(",", ""),
        swapped,
        f"<p>{'</p><p>'.join(sentences)}</p>",
        " ".join(words[: len(words) * 6 // 10]),
        " ".join([*words[:25], "the", "mug", "is", "quite", "solid", *words[25:]]),
        PASSAGE + " " + OTHER,
        "word " * 30_000 + PASSAGE,
        # no cases
        "Read the passage and answer. Who polished the rivets?",
        " ".join(words[:8]),
        "When the flood reached Vellmouth, the dairy held 77 clay pipes, 12 of them measured by Ilse Quarrow.",
        None,
        "",
    ]
    assert leaks(table, texts) == sorted([(1, i) for i in range(9)] + [(2, 7)])


def test_leaks_of_empty_tables_and_a_crowded_filter(table, monkeypatch):
    docs = table([(1, PASSAGE), (1, PASSAGE), (2, OTHER), (None, PASSAGE)], "doc_id long, text string")
    items = table(ITEMS, "item_id long, text string")
    assert leakage.leaked(docs.limit(0), items).count() == leakage.leaked(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(leakage, "MOST", 2**20)
    monkeypatch.setattr(leakage, "FILTER", 0)
    assert sorted((r["item_id"], r["doc_id"]) for r in leakage.leaked(docs, items).collect()) == [(1, 1), (2, 2)]


def test_short_passages_must_occur_whole(table):
    items = table([(1, "Ostrel granary held four"), (2, "mug is"), (3, "quite another thing here")], "item_id long, text string")
    docs = table([(1, "so ostrel GRANARY held, four!"), (2, "ostrel granary held five"), (3, "the mug is quite"), (4, "granary held")], "doc_id long, text string")
    assert [(r["item_id"], r["doc_id"]) for r in leakage.leaked(docs, items).collect()] == [(1, 1)]


def test_leaks_do_not_depend_on_other_items(table):
    rng = random.Random(3)
    more = [(100 + i, " ".join(f"w{rng.randrange(4000)}" for _ in range(40))) for i in range(3_000)]
    docs = table([(1, f"Nice mug. {PASSAGE}"), (2, more[5][1]), (3, "nothing of that")], "doc_id long, text string")
    got = leakage.leaked(docs, table(ITEMS + more, "item_id long, text string")).collect()
    assert sorted((r["item_id"], r["doc_id"]) for r in got) == [(1, 1), (105, 2)]


def test_seeds_ignore_masked_positions():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 40, dtype=np.uint64)
    b = a.copy()
    b[12] += np.uint64(1)
    for m, mask in enumerate(leakage.MASKS):
        x, y = leakage.seeds(a, mask, m), leakage.seeds(b, mask, m)
        hit = {i for i in range(len(x)) if i <= 12 < i + len(mask) and mask[12 - i] == "1"}
        assert {i for i in range(len(x)) if x[i] != y[i]} == hit


SUBJECTS = "the hinge|this lamp|our kettle|the zip|my chair|the strap|that drill|the button".split("|")
ENDS = "works very well|is not worth the money|broke after two weeks|looks as good as new|was delivered on Monday|feels light and solid|makes no noise at all".split("|")


def reviews(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = " ".join(f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(ENDS)}." for _ in range(rng.randint(2, 7)))
        out.append((i, s if rng.random() < 0.8 else s[:-1], rng.choice(["shop", "kiosk"])))
    return out


def test_cut_texts(table):
    rows = reviews(900)
    cut = set()
    for k, (i, t, s) in enumerate(rows):
        if s == "kiosk" and len(t) > 100:
            rows[k] = (i, t[:100], s)
            if not t[:100].rstrip().endswith(".") and t[100:101] not in (".", ""):
                cut.add(i)
    rows += [(2000, None, "shop"), (2001, "", None), (2002, "   ", "shop"), (None, "The hin", "shop"), (2003, rows[0][1], None)]
    docs = table([(*r, "t", 0.0) for r in rows], "doc_id long, text string, source string, title string, score double")
    found = {r["doc_id"] for r in truncation.cut_off(docs, also="title").collect()}
    assert len(cut) > 100
    right = len(found & cut)
    assert right >= 0.9 * len(cut) and right >= 0.9 * len(found)
    rates = {r["source"]: r["share"] for r in truncation.cut_rates(docs).collect()}
    assert rates["kiosk"] > 0.3 > 0.05 > rates["shop"]
    assert truncation.cut_off(docs.limit(0)).count() == 0


def test_usual_lengths(table):
    docs = table([(i, "x" * (60 + i % 97), "a") for i in range(300)] + [(1000 + i, "y" * 255, "a") for i in range(60)] + [(5000, None, "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in truncation.usual_lengths(docs).collect()] == [("a", 255, 60)]


KINDS = [("small", 10), ("large", 40), ("none", 0)]


def pack(table, sizes, **more):
    items = table([(i, n, f"c{i % 3}" if i % 2 else None, "s") for i, n in enumerate(sizes)], "doc_id long, size long, cluster string, source string")
    return packing.pack(items, table(KINDS, "container_kind string, capacity_tokens long"), **more)


def check_packing(got, sizes):
    for kind, cap in KINDS[:2]:
        own = [r for r in got if r["container_kind"] == kind]
        assert {(r["doc_id"], r["piece"]) for r in own} == {(i, p) for i, n in enumerate(sizes) if n and n > 0 for p in range(-(-n // cap))}
        for i, n in enumerate(sizes):
            mine = sorted((r["piece"], r["size"]) for r in own if r["doc_id"] == i)
            assert sum(s for _, s in mine) == max(n or 0, 0) and all(s == cap for _, s in mine[:-1])
        by = {}
        for r in own:
            by.setdefault(r["container_id"], []).append(r)
        assert all(sum(r["size"] for r in v) <= cap and sorted(r["position"] for r in v) == list(range(len(v))) for v in by.values())
        yield kind, by


@pytest.mark.parametrize("shard", [5, 1000])
def test_packing_holds_whole_items(table, shard):
    rng = random.Random(shard)
    sizes = [rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 10, 11, 25, 95, 400]) for _ in range(60)] + [None]
    got = pack(table, sizes, shard=shard).collect()
    for kind, by in check_packing(got, sizes):
        cap = dict(KINDS)[kind]
        assert len(by) <= 1.25 * -(-sum(n or 0 for n in sizes) // cap) + 2
    assert pack(table, []).count() == 0


def test_copies_and_sources_are_kept_apart(table):
    sizes = [3] * 30
    got = pack(table, sizes, cluster="cluster").collect()
    for kind, by in check_packing(got, sizes):
        need = -(-90 // dict(KINDS)[kind])
        for v in by.values():
            cs = [r["doc_id"] % 3 for r in v if r["doc_id"] % 2]
            assert all(cs.count(c) <= -(-5 // need) for c in set(cs))
    alone = pack(table, sizes, source="source").collect()
    assert len({(r["container_kind"], r["container_id"]) for r in alone}) == 60


def test_best_fit_takes_the_tightest_container():
    b = packing.Bins(10)
    assert [b.put(0, 6), b.put(1, 7), b.put(2, 3), b.put(3, 4)] == [0, 1, 1, 0]
    c = packing.Bins(10)
    assert [c.put(0, 6, 1), c.put(1, 7, 2), c.put(2, 3, 2), c.put(3, 1, 2)] == [0, 1, 0, 2]
    assert packing.best_fit([5, 5, 5, 5], 10, ["a", "a", None, None]) in ([0, 1, 0, 1], [0, 1, 1, 0])


def test_token_counts(table):
    docs = table([(1, "Hello world"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|>"), (5, "word " * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["size"] for r in packing.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and None not in got and got[4] > 1 and got[5] >= 20_000
    keys = [r[0] for r in table([("A b c, d e!",), ("a B c d  e",), ("ok",), (None,)], "t string").select(packing.copies("t")).collect()]
    assert keys[0] == keys[1] and keys[2:] == [None, None]


def test_no_more_of_a_source_than_allowed_share_a_container(table):
    items = table([(i, 2, None, f"s{i % 4}" if i % 9 else None) for i in range(200)], "doc_id long, size long, cluster string, source string")
    got = packing.pack(items, table(KINDS, "container_kind string, capacity_tokens long"), source="source", per_source=3).collect()
    by = {}
    for r in got:
        source = f"s{r['doc_id'] % 4}" if r["doc_id"] % 9 else None
        by.setdefault((r["container_kind"], r["container_id"]), []).append(source)
    assert len(got) == 400 and max(v.count(s) for v in by.values() for s in set(v)) == 3
    assert len([k for k in by if k[0] == "small"]) <= 44 and len([k for k in by if k[0] == "large"]) <= 24


def test_many_copies_are_packed_in_reasonable_time():
    import time

    begun = time.time()
    at = packing.best_fit([10] * 12_000, 1_000, ["c"] * 12_000)
    assert max(at) + 1 == 120 and time.time() - begun < 20
