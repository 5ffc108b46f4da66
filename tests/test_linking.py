import math
import warnings
from enum import IntEnum

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.errors import SlowJoinError, SlowJoinWarning
from kinweave.operators import cluster, eda, joins, tf
from kinweave.operators.compare import EnumComparer
from kinweave.operators.diff import Diff, Updates, value_change
from kinweave.operators.fs import LevelWeights, Weights, em, level_proportions, odds_to_prob, prob_to_odds, train_using_labels
from kinweave.operators.linkers import EmptyLinker, FullLinker, IDLinker, JoinLinker, KeyLinker, MinhashLshLinker, NameBlocker, OrLinker, UnnestLinker, p_blocked
from kinweave.operators.model import Datasets, Linkage, Links, UnionTable, check_links, filter_links, n_total
from kinweave.operators.sampling import sample_all_links, sample_table
from kinweave.operators.within import pairs_within
from kinweave.plans.joins import check_join_algorithm, n_naive_comparisons

from .conftest import rows

SCHEMA = "record_id long, size long, code string, tags array<string>"


@pytest.fixture
def t1(table):
    return table([(11, 5, "k", ["red", "tan"]), (12, 7, "m", ["tan"]), (13, 9, "q", []), (14, 8, "m", ["sky"])], SCHEMA)


@pytest.fixture
def t2(table):
    return table([(70, 7, "m", ["tan", "ash"]), (71, 1, "q", ["ash"]), (72, None, "z", ["red", "sky"]), (73, 5, None, None), (74, 8, "m", [])], SCHEMA)


CODES = [(12, 70), (12, 74), (13, 71), (14, 70), (14, 74)]


def test_key_linker(t1, t2, table):
    assert rows(KeyLinker("code")(t1, t2).links) == CODES
    assert rows(KeyLinker(["code", ("size", lambda df: df["size"].cast("double"))])(t1, t2).links) == [(12, 70), (14, 74)]
    d = table([(3, "u"), (5, "v"), (8, "u"), (9, "u"), (10, None), (12, "v")], "record_id long, code string")
    assert rows(KeyLinker("code")(d, d).links) == [(3, 8), (3, 9), (5, 12), (8, 9)]
    assert rows(KeyLinker("code", max_pairs=4)(d, d).links) == [(5, 12)]


def test_counts(table):
    df = table([(1, "p", 2), (2, "r", 2), (3, "r", 2), (4, "r", 9), (5, "s", 9), (6, None, 4), (7, "s", 9)], "record_id long, code string, num long")
    k = KeyLinker("code")
    assert rows(k.key_counts_left(df)) == [("p", 1), ("r", 3), ("s", 2)]
    assert rows(k.pair_counts(df, df)) == [("p", 0), ("r", 3), ("s", 1)]
    assert n_total(k.pair_counts(df, df)) == 4
    assert rows(KeyLinker("code", task="link").pair_counts(df, df)) == [("p", 1), ("r", 9), ("s", 4)]
    assert n_total(KeyLinker(["code", "num"]).pair_counts(df, df)) == 2
    assert n_total(KeyLinker([lambda d: F.lit(None).cast("string")]).pair_counts(df, df)) == 0


def test_other_linkers(t1, t2):
    assert rows(UnnestLinker("tags")(t1, t2).links) == [(11, 70), (11, 72), (12, 70), (14, 72)]
    assert FullLinker()(t1, t2).links.count() == 20 and FullLinker()(t1, t1).links.count() == 6
    assert EmptyLinker()(t1, t2).links.count() == 0 and OrLinker({})(t1, t2).links.count() == 0
    assert rows(OrLinker(["code", "size"])(t1, t2).links) == sorted([*CODES, (11, 73)])
    assert rows(OrLinker({"a": "code", "b": "size"}).rule_counts(t1, t2)) == [(["a", "b"], 2), (["a"], 3), (["b"], 1)]
    assert rows(JoinLinker(lambda a, b: a.code == b.code)(t1, t2).links) == CODES


def test_id_linker(table):
    df = table([(0, "x"), (1, "x"), (2, "y"), (3, None)], "record_id long, label string")
    assert rows(IDLinker("label").match_linkage(df, df).links) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
    assert IDLinker("label").indefinite_linkage(df, df).links.count() == 7
    assert IDLinker("label").nonmatch_linkage(df, df).links.count() == 4
    assert IDLinker("label", when_null="match").linkage(df, df, "match").links.count() == 12


def test_minhash(table):
    words = [str(i) for i in range(30)]
    df = table([(0, words), (1, [*words[:29], "x"]), (2, [f"z{i}" for i in range(30)]), (3, []), (4, None)], "record_id long, terms array<string>")
    assert rows(MinhashLshLinker("terms", 3, 20)(df, df).links) == [(0, 1)]
    assert abs(p_blocked(0.5, 2, 5) - (1 - 0.75**5)) < 1e-12


def test_name_blocker(table):
    schema = "record_id string, name struct<prefix: string, given: string, middle: string, surname: string, suffix: string, nickname: string>"
    df = table([("w1", (None, "Greta", None, "Lindqvist", None, None)), ("w2", ("Dr", "G", None, "LINDQVIST", None, None)), ("w3", (None, "Otto", None, "Farrow", None, None)), ("w4", None)], schema)
    assert rows(NameBlocker()(df, df).links) == [("w1", "w2")]


@pytest.mark.parametrize("on, slow", [(lambda a, b: a.code == b.code, False), (True, True), (lambda a, b: F.levenshtein(a.code, b.code) < 2, True), (lambda a, b: (a.code == b.code) | (a["size"] == b["size"]), True), (lambda a, b: (a.code == b.code) & (a["size"] == b["size"]), False)])
def test_slow_joins(t1, t2, on, slow):
    if not slow:
        JoinLinker(on)(t1, t2)
        return
    with pytest.raises(SlowJoinError):
        JoinLinker(on)(t1, t2)
    with pytest.warns(SlowJoinWarning):
        JoinLinker(on, on_slow="warn")(t1, t2)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        JoinLinker(on, on_slow="ignore")(t1, t2)


def test_join_forms(t1, t2):
    assert joins.join(t1, t2, "code").columns == ["record_id", "size", "code", "tags", "record_id_right", "size_right", "tags_right"]
    assert joins.join(t1, t2, ("size", "size"), "left").count() == 4
    assert joins.join(t1, t2, lambda a, b: a.code == b.code, "anti").columns == t1.columns
    assert joins.join(t1, t2, [lambda a, b: a.code == b.code, "size"]).count() == 2
    assert joins.join(t1, t2, True, "cross").count() == 20
    assert joins.join(t1, t2, "code", "any_left").count() == 4
    assert joins.join(t1, t1, "code").count() == 6
    with pytest.raises(ValueError):
        joins.join(t1, t2, "code", "inner", rname="size", rename_all=True)
    assert n_naive_comparisons(4) == 6 and n_naive_comparisons(t1, t2) == 20 and check_join_algorithm(t1) is None


def test_deferred_conditions(t1, t2):
    left, right = joins.left, joins.right
    assert rows(JoinLinker(left.code == right.code)(t1, t2).links) == CODES
    assert rows(JoinLinker([left.code == right["code"], left["size"] - 1 < right["size"]])(t1, t2).links) == [(12, 70), (12, 74), (14, 74)]
    assert joins.join(t1, t2, (left.code == right.code) & (joins.deferred(F.length)(right.code) == 1)).count() == 5
    assert rows(JoinLinker(left.code.substr(1, 1) == right.code)(t1, t2).links) == CODES


def test_union_table(t1, t2):
    u = UnionTable([t1, t2]).filter(lambda t: t["size"] > 6).mutate(twice=lambda t: t["size"] * 2).rename(id="record_id").drop("tags", "code")
    assert u.table().columns == ["id", "size", "twice"] and rows(u.select("id", "twice").table()) == [(12, 14), (13, 18), (14, 16), (70, 14), (74, 16)]
    with pytest.raises(ValueError):
        UnionTable([t1, t2.drop("tags")])


def test_range_join_and_asof(table):
    v = table([(i, float(i)) for i in range(50)] + [(99, None)], "i int, v double")
    r = table([("a", 3.0, 5.5), ("wide", -1e9, 1e9), ("point", 7.0, 7.0), ("turned", 9.0, 8.0), ("null", None, 1.0)], "name string, lo double, hi double")
    got = joins.range_join(v, r, "v", "lo", "hi", 1.0)
    want = sorted([(i, n) for i in range(50) for n, lo, hi in (("a", 3.0, 5.5), ("wide", -1e9, 1e9), ("point", 7.0, 7.0)) if lo <= i <= hi], key=repr)
    assert rows(got.select("i", "name")) == want
    assert joins.range_join(v, r.where("name = 'a'"), "v", "lo", "hi", 1.0, how="left").count() == 51
    left = table([("x", 1), ("x", 5), ("y", 5), (None, 5), ("x", None)], "k string, t int")
    right = table([("x", 1, "one"), ("x", 1, "two"), ("x", 4, "four"), ("z", 0, "no")], "k string, t int, v string")
    got = joins.asof(left, right, ["k"], ("t", "t"))
    assert rows(got.select("k", "t", "v")) == rows(table([("x", 1, "two"), ("x", 5, "four"), ("y", 5, None), (None, 5, None), ("x", None, None)], "k string, t int, v string"))
    strict = joins.asof(left, right, ["k"], ("t", "t"), strict=True)
    assert {(r["k"], r["t"]): r["v"] for r in strict.collect()}[("x", 1)] is None


def test_lookup(table):
    a = table([(1,), (2,), (3,)], "k int")
    b = table([(1, "x"), (2, None)], "k int, v string")
    assert rows(joins.join_lookup(a, b, "k", {"v": "none"})) == [(1, "x"), (2, None), (3, "none")]
    with pytest.raises(ValueError):
        joins.join_lookup(b, b, "k")


def test_linkage(table, spark, tmp_path):
    left = table([(40,), (50,), (60,)], "record_id long")
    right = table([(17, "fig"), (18, "yew"), (19, "elm")], "record_id long, tree string")
    links = table([(40, 18, 6), (60, 17, 8), (60, 19, 9)], "record_id_l long, record_id_r long, weight long")
    x = Linkage(left, right, links)
    assert rows(x.left_linked().with_n_links()) == [(40, 1), (50, 0), (60, 2)]
    assert rows(x.left_linked().link_counts()) == [(0, 1), (1, 1), (2, 1)] and rows(x.right_linked().link_counts()) == [(1, 3)]
    got = x.left_linked().with_linked_values("tree", x=F.max("record_id"), y=F.col("record_id") + 1).orderBy("record_id").collect()
    assert [(r["record_id"], r["tree"] and sorted(r["tree"]), r["x"], r["y"] and sorted(r["y"])) for r in got] == [(40, ["yew"], 18, [19]), (50, None, None, None), (60, ["elm", "fig"], 19, [18, 20])]
    assert "linked" in x.left_linked().with_linked_values().columns
    assert rows(Links(links, left, right).with_right(t="tree").df.select("record_id_r", "t")) == [(17, "fig"), (18, "yew"), (19, "elm")]
    named = table([(40, 18, "mine")], "record_id_l long, record_id_r long, tree string")
    with pytest.raises(ValueError):
        Links(named, left, right).with_right("tree")
    best = F.max("weight").over(Window.partitionBy("record_id_l")) == F.col("weight")
    assert filter_links(links, best).count() == 2
    x.write(str(tmp_path / "x"))
    assert rows(Linkage.read(spark, str(tmp_path / "x")).links) == rows(links)
    with pytest.raises(Exception, match="exist"):
        x.write(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        check_links(left.withColumn("record_id", F.col("record_id").cast("string")), right, links)


def test_datasets(table):
    d = Datasets([table([(1, "a")], "record_id long, x string"), table([(2, 5)], "record_id long, x int")])
    assert list(d) == ["left", "right"] and d.shared_schema == {"record_id": "bigint"}
    assert rows(d.unioned()) == [("left", 1), ("right", 2)] and rows(d.all_record_ids()) == [(1,), (2,)]
    with pytest.raises(ValueError):
        Datasets([table([(1,)], "record_id long"), table([("a",)], "record_id string")])


def clusters(df):
    groups = {}
    for r, c in ((tuple(r[0]) if isinstance(r[0], tuple) else r[0], r[1]) for r in df.collect()):
        groups.setdefault(c, set()).add(r)
    return sorted(map(sorted, groups.values()))


CHAIN = [(k * 37 % 101, (k + 1) * 37 % 101) for k in range(100)]  # one path over 101 nodes in no order


@pytest.mark.parametrize(
    "edges, want",
    [
        ([(5, 31), (44, 7), (7, 31), (3, 44), (90, 3), (61, 60)], [[3, 5, 7, 31, 44, 90], [60, 61]]),
        ([(8, 20), (31, 8), (8, 47), (2, 3), (3, 2)], [[2, 3], [8, 20, 31, 47]]),
        ([], []),
        ([(17, 17)], [[17]]),
        (CHAIN, [list(range(101))]),
        ([(1, 2), (2, 3), (3, 1), (6, 5), (5, 4), (3, 4)], [[1, 2, 3, 4, 5, 6]]),
    ],
)
def test_components(table, edges, want):
    df = table(edges, "record_id_l long, record_id_r long")
    assert clusters(cluster.connected_components(df)) == want


def test_components_of_records(table):
    s = table([("oak", "elm"), ("yew", "elm"), ("fig", "ash")], "record_id_l string, record_id_r string")
    assert clusters(cluster.connected_components(s)) == [["ash", "fig"], ["elm", "oak", "yew"]]
    st = table([(("left", 1), ("right", 1)), (("left", 2), ("right", 3)), (("right", 3), ("left", 4))], "record_id_l struct<d: string, i: long>, record_id_r struct<d: string, i: long>")
    assert len(clusters(cluster.connected_components(st))) == 2
    e = table([(21, 25), (25, 22)], "record_id_l long, record_id_r long")
    r = table([(21,), (22,), (25,), (29,)], "record_id long")
    assert clusters(cluster.connected_components(e, r)) == [[21, 22, 25], [29]]
    two = cluster.connected_components(e, Datasets([r.where("record_id < 25"), r.where("record_id >= 25")]))
    labels = {**dict(map(tuple, two["left"].collect())), **dict(map(tuple, two["right"].collect()))}
    assert labels[21] == labels[22] == labels[25] != labels[29]
    assert len(clusters(cluster.connected_components(table(CHAIN, "record_id_l long, record_id_r long"), max_iter=1))) > 1


def test_degree(table):
    e = table([(5, 31), (7, 31), (44, 7), (60, 61), (60, 61)], "record_id_l long, record_id_r long")
    assert dict(map(tuple, cluster.degree(e).collect())) == {5: 1, 7: 2, 31: 2, 44: 1, 60: 1, 61: 1}
    assert rows(cluster.degree(e, table([(99,), (7,)], "record_id long"))) == [(7, 2), (99, 0)]


def test_cluster_scores(table):
    a = table([(0, 0), (1, 0), (2, 0), (3, 1)], "record_id long, label long")
    b = table([(0, 0), (1, 0), (2, 1), (3, 1)], "record_id long, label long")
    s = cluster.scores(a, b)
    assert s["rand"] == 0.5 and abs(s["adjusted_rand"]) < 1e-9 and abs(s["fowlkes_mallows"] - 1 / math.sqrt(6)) < 1e-9
    assert 0 < s["v_measure"] < 1 and abs(cluster.v_measure_score(a, a) - 1) < 1e-9
    assert abs(cluster.adjusted_mutual_info_score(a, a) - 1) < 1e-9 and abs(cluster.adjusted_mutual_info_score(a, b)) < 0.5
    with pytest.raises(ValueError):
        cluster.rand_score(a, b.where("record_id > 0"))


class Level(IntEnum):
    exact = 0
    close = 1
    off = 2


def test_comparer_and_weights(table, tmp_path):
    pairs = table([(1, 2, "a", "a"), (1, 3, "a", "b"), (1, 4, "a", None)], "record_id_l long, record_id_r long, x_l string, x_r string")
    c = EnumComparer("x", Level, [("exact", lambda p: p.x_l == p.x_r), (Level.off, lambda p: p.x_l != p.x_r)])
    assert [r["x"] for r in c(pairs).orderBy("record_id_r").collect()] == [0, 2, None]
    w = Weights.from_json({"x": {"exact": {"m": 0.9, "u": 0.0}, "close": {"m": 0.05, "u": 0.5}, "off": {"m": 0.05, "u": 0.5}}})
    got = w.score_compared(c(pairs), [c])
    assert got.columns == ["record_id_l", "record_id_r", "x_l", "x_r", "odds", "x", "x_odds"]
    assert [r["odds"] for r in got.orderBy("record_id_r").collect()] == [float("inf"), 0.1, None]
    w.to_json(tmp_path / "w.json")
    assert Weights.from_json(tmp_path / "w.json") == w
    assert w["x"].odds(-1) == 0.1 and w["x"].match_probability("exact") == 1.0 and LevelWeights("l", 0.0, 0.5).log_odds == -math.inf
    assert prob_to_odds(1) == math.inf and odds_to_prob(math.inf) == 1 and abs(odds_to_prob(prob_to_odds(0.3)) - 0.3) < 1e-12
    assert level_proportions({0: 3}, [0, 1]) == [0.75, 0.25]


def test_training(table):
    rng = range(60)
    df = table([(i, i // 2, f"n{i // 2}" if i % 10 else "typo") for i in rng], "record_id long, label_true long, name string")
    c = EnumComparer("name", Level, [("exact", lambda p: p.name_l == p.name_r), ("off", True)])
    w = train_using_labels([c], df, df, max_pairs=2_000)
    assert w["name"]["exact"].odds > 5 and w["name"]["off"].odds < 1
    m, u = em([(0, 0, 50), (1, 1, 900), (0, 1, 20), (1, 0, 20), (None, 0, 5)], [2, 2])
    assert m[0][0] > 0.9 > 0.2 > u[0][0]


def test_sampling(table, spark):
    a, b = spark.range(100).toDF("record_id"), spark.range(70).toDF("record_id")
    blocks = sample_table(spark.range(1_000, numPartitions=10).toDF("record_id"), 150, "block", seed=4)
    assert blocks.count() == 200 and blocks.count() == blocks.distinct().count()
    for n in (0, 1, 50, 5_000):
        s = sample_all_links(a, b, n)
        assert s.count() == s.distinct().count() == n
    assert sample_all_links(a, b, 10_000).count() == 7_000
    assert sample_table(a, 7, "hash").count() == 7 and 0 < sample_table(a, 50).count() < 90
    big = sample_all_links(spark.range(10_000).toDF("record_id"), spark.range(10_000).toDF("record_id"), 10_000)
    got = big.agg(F.avg("record_id_l"), F.avg("record_id_r"), F.avg((F.col("record_id_l") == F.col("record_id_r")).cast("int"))).first()
    assert abs(got[0] - 5000) < 100 and abs(got[1] - 5000) < 150 and got[2] < 0.01


def test_term_frequencies(table):
    df = table([("a",), ("a",), ("b",), (None,)], "x string")
    s = tf.stats_table(df, "x")
    assert rows(s) == rows(table([("a", 2, 0.5), ("b", 1, 0.25), (None, 1, 0.25)], "value string, count long, frequency double"))
    target = table([("a",), ("new",), (None,), ("b",)], "x string")
    assert rows(tf.add_frequencies(target, s, "x")) == rows(table([("a", 0.5), ("new", 0.25), (None, None), ("b", 0.25)], "x string, f double"))
    assert tf.keep_rare(target, df, ["x"], 0.3).count() == 2
    assert tf.keep_unambiguous(df, ["x"]).count() == 2 and tf.ambiguous(df, ["x"]).count() == 2


def test_diff(table, spark, tmp_path):
    before = table([(7, "reed", 3), (8, None, 5), (9, "moss", 5), (12, "fern", 1)], "id long, plant string, height long")
    after = table([(7, "reed", 3), (8, "sedge", 5), (12, "fern", 1), (15, "ivy", 2), (16, None, None)], "id long, plant string, height long")
    d = Diff.from_before_after(before, after, "id")
    assert rows(d.insertions) == [(15, "ivy", 2), (16, None, None)] and rows(d.deletions) == [(9, "moss", 5)]
    assert rows(d.updates.after()) == [(8, "sedge", 5)] and rows(d.unchanged()) == sorted([(7, "reed", 3), (12, "fern", 1)], key=repr)
    assert tuple(d.stats().first()) == (4, 5, 2, 1, 1, 2)
    d.write(str(tmp_path / "d"))
    assert rows(Diff.read(spark, str(tmp_path / "d")).after) == rows(after)
    whole = Diff.from_before_after(before, after, False)
    assert whole.insertions.count() == 5 and whole.deletions.count() == 4 and whole.updates.df.count() == 0
    later = table([(7, "reed", 3), (8, None, 5), (9, "moss", 6), (12, None, 6)], "id long, plant string, height long")
    u = Updates.from_tables(before, later, "id").changed()
    assert {r["id"]["before"] for r in u.df.collect()} == {9, 12} and rows(u.apply_to(before)) == rows(later)
    got = table([(None, None), ("x", None), (None, "x"), ("x", "x"), ("x", "y")], "a string, b string").select(value_change(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["remained_null", "became_null", "became_nonnull", "unchanged", "changed"]
    with pytest.raises(ValueError):
        Updates.from_tables(before, later.drop("height"), "id")
    assert Updates.from_tables(before, later.drop("height"), "id", "lax").after().columns == ["id", "plant"]


def test_eda(table):
    df = table([("b",), ("a",), ("a",), ("c",), (None,)], "x string")
    assert [tuple(r)[:3] for r in eda.distribution(df, "x").orderBy("rank").collect()] == [("a", 2, 0), (None, 1, 1), ("b", 1, 2), ("c", 1, 3)]


def test_streaming(spark, table, tmp_path):
    from kinweave.streaming.lookup import link_stream

    table([(1, "a"), (2, None), (3, "c")], "record_id long, k string").write.parquet(str(tmp_path / "in"))
    stored = table([(9, "a"), (8, None)], "record_id long, k string")
    stream = spark.readStream.schema("record_id long, k string").parquet(str(tmp_path / "in"))
    q = link_stream(stream, stored, ["k"]).writeStream.format("memory").queryName("linked").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select * from linked")) == [(1, 9)]


def test_degrees_from_keys(table):
    """Degrees come from counts: no pair of a large group is made. Repeated ids, several keys and nulls give what the pairs would."""
    d = table([(3, "u"), (5, "v"), (8, "u"), (8, "u"), (9, "u"), (10, None), (12, "v"), (None, "v"), (8, "v"), (9, "v"), (13, "w"), (14, "x"), (14, "x")], "record_id long, code string")
    k = KeyLinker("code")
    assert rows(k.degrees(d)) == rows(cluster.degree(k(d, d).links))
    assert rows(cluster.with_degrees(k.degrees(d), d.select("record_id").distinct())) == rows(cluster.degree(k(d, d).links, d.select("record_id").distinct()))
    many = d.sparkSession.range(200_000).selectExpr("id AS record_id", "'a' AS code")  # 20 billion pairs
    assert rows(cluster.histogram_of_degrees(k.degrees(many))) == [(199_999, 200_000)]
    with pytest.raises(ValueError):
        KeyLinker([("code", "other")]).degrees(d)


def test_spanning_links(table):
    d = table([(3, "u"), (5, "v"), (8, "u"), (8, "u"), (9, "u"), (10, None), (12, "v"), (None, "v"), (9, "v"), (13, "w"), (14, "x"), (14, "x")], "record_id long, code string")
    k = KeyLinker("code")
    assert rows(cluster.components(k.spanning_links(d))) == rows(cluster.components(k(d, d).links))
    many = d.sparkSession.range(100_000).selectExpr("id AS record_id", "'a' AS code")  # 5 billion pairs
    assert k.spanning_links(many).count() == 99_999


def test_rule_counts_from_keys(table):
    schema = "record_id long, a string, b long, c string"
    some = [(i, "xyz"[i % 3] if i % 7 else None, i % 4, "pq"[i % 5 % 2]) for i in range(60)] + [(None, "x", 1, "p")]
    rules = {"one": ["a", "b"], "two": "c", "three": ["b", "c"]}
    d, twice = table(some, schema), table([*some, some[5]], schema)
    by_pairs = {k: (lambda x, y, v=v: [x[n] == y[n] for n in ([v] if isinstance(v, str) else v)]) for k, v in rules.items()}
    assert rows(OrLinker(rules).rule_counts(d, d)) == rows(OrLinker(by_pairs).rule_counts(d, d))
    assert rows(OrLinker(rules).rule_counts(twice, twice)) == rows(OrLinker(by_pairs).rule_counts(twice, twice))
    many = d.sparkSession.range(100_000).selectExpr("id AS record_id", "'a' AS a", "id % 2 AS b")  # 5 billion pairs
    assert rows(OrLinker({"a": ["a"], "ab": ["a", "b"]}).rule_counts(many, many)) == [(["a", "ab"], 2_499_950_000), (["a"], 2_500_000_000)]


def test_join_linker_near(table):
    """Rows meet those of near bins only; the pairs are those of the whole join."""
    values = [*[i * 2.5 - 40 for i in range(40)], 1e15, 1e15 + 4, 1e300, float("inf"), float("inf"), float("nan"), float("nan"), None, -0.0, 0.1 + 0.2, 5.3, 10.3]
    d = table([(i, i % 3, v) for i, v in enumerate(values)], "record_id long, k long, x double")
    on = lambda a, b: (a.k == b.k) & (F.abs(a.x - b.x) <= 5)
    near = JoinLinker(on, near=("x", 5.0))
    assert rows(near(d, d).links) == rows(JoinLinker(on)(d, d).links)
    assert rows(near(d, d.select("*").where("k = 1")).links) == rows(JoinLinker(on)(d, d.select("*").where("k = 1")).links)
    many = d.sparkSession.range(60_000).selectExpr("id AS record_id", "1L AS k", "id * 5.0D AS x")  # 1.8 billion pairs agree in k
    assert near(many, many).links.count() == 59_999


def test_pairs_within(table, monkeypatch):
    """Scores are worked out once for each two values, not for each pair; the rows are those of the join."""
    from kinweave.operators import within

    monkeypatch.setattr(within, "BLOCK", 3)
    some = [(i, "uv"[i % 2] if i % 9 else None, [None, "p", "q", "r"][i % 4]) for i in range(40)] + [(None, "u", "p"), (7, "v", "q"), (7, "v", "q")]
    d = table(some, "id long, k string, v string")
    calls = d.sparkSession.sparkContext.accumulator(0)

    @F.udf("string")
    def joined(a, b):
        calls.add(1)
        return None if a is None or b is None else "".join(sorted([a, b]))

    out = rows(pairs_within(d, "id", ["k"], ["v"], lambda a, b: {"both": joined(a("v"), b("v")), "own": (a("v"), b("v"))}))
    made = calls.value
    a, b = d.toDF("l", "k", "x"), d.toDF("r", "k", "y")
    assert out == rows(a.join(b, "k").where("l < r").select("l", "r", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat(F.least("x", "y"), F.greatest("x", "y"))), "x"))
    assert made < len(out)
