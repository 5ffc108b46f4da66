import pytest
from pyspark.sql import functions as F

from kinweave import runtime

from .conftest import rows


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_equals_a_plain_join(table, how):
    big = table([("hot" if i % 3 else f"k{i % 7}" if i % 2 else None, i) for i in range(200)], "k string, i int")
    small = table([("hot", 1), ("k0", 2), ("k3", 3), ("unused", 4)], "k string, v int")
    hot = table([("hot",), ("k6",)], "k string")
    want = rows(big.join(small, "k", how).select("k", "i", "v"))
    assert rows(runtime.lookup(big, small, "k", how, hot=hot).select("k", "i", "v")) == want
    assert rows(runtime.lookup(big, small, "k", how).select("k", "i", "v")) == want
    assert runtime.lookup(big.limit(0), small, "k", how).count() == 0


def test_hot_keys_are_few(table):
    df = table([("a",)] * 50 + [("b",)] * 3 + [(None,)] * 90, "k string")
    assert rows(runtime.hot_keys(df, "k", least=10, share=0.1)) == [("a", 50)]


def test_once_takes_the_least_delivery(table):
    df = table([(1, "b", 2), (1, "a", 9), (2, None, 1), (None, "x", 1)], "id int, x string, y int")
    assert rows(runtime.once(df, "id", "x", "y")) == [(1, "a", 9), (2, None, 1)]


def test_materialized_tables_lie_in_the_shared_folder(spark, table):
    df = runtime.materialize(table([(1, [None, "x"])], "i int, a array<string>"))
    assert runtime.scratch_dir(spark).removeprefix("file:").lstrip("/") in df.inputFiles()[0] and rows(df) == [(1, [None, "x"])]
    assert runtime.spread(df).rdd.getNumPartitions() >= 4
    empty = runtime.materialize(df.where(F.col("i") > 5))
    assert empty.count() == 0 and empty.columns == ["i", "a"]


def test_a_folder_of_its_own_without_the_setting(spark, monkeypatch):
    class Unset:
        def get(self, *_):
            return None

    class Session:
        conf = Unset()
        sparkContext = type("Context", (), {"getConf": lambda self: Unset(), "master": "local[2]"})()

    monkeypatch.setattr(runtime, "_written", [])
    monkeypatch.setattr(runtime, "_own", [])
    at = runtime.scratch_dir(Session())
    assert at.startswith("file:///") and runtime.scratch_dir(Session()) == at
    Session.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        runtime.scratch_dir(Session())


def test_numbered(spark):
    df = spark.range(5_000).select((F.col("id") * 37 % 5_000).alias("v")).repartition(7)
    got = runtime.numbered(df, [F.desc("v")], "n").collect()
    assert len(got) == 5_000 and all(r["n"] == 4_999 - r["v"] for r in got)
    assert runtime.numbered(df.limit(0), ["v"], "n").collect() == []
