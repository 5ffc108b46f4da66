"""Queries of the linkers, joins and linked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import joins
from kinweave.operators.linkers import CoordinateLinker, EmptyLinker, FullLinker, IDLinker, JoinLinker, KeyLinker, OrLinker, UnnestLinker, lsh_curves
from kinweave.operators.model import Datasets, Linkage, Links, filter_links
from kinweave.plans.joins import n_naive_comparisons


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rec(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    df = t(spark, d, name)
    return df.withColumn("record_id", F.col(key))


def customers(s: SparkSession, d: str) -> DataFrame:
    return rec(s, d, "customer", "c_custkey")


def parts(s: SparkSession, d: str) -> DataFrame:
    return rec(s, d, "part", "p_partkey")


CUSTOMER = KeyLinker(["c_nationkey", "c_mktsegment"])
SEGMENT_PAIRS = "SELECT a.c_custkey AS record_id_l, b.c_custkey AS record_id_r FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey"


def key_links(s, d):
    c = customers(s, d)
    return CUSTOMER(c, c).links


def key_counts(s, d):
    return CUSTOMER.key_counts_left(customers(s, d))


def pair_counts_dedupe(s, d):
    c = customers(s, d)
    return CUSTOMER.pair_counts(c, c)


def pair_counts_link(s, d):
    c, p = customers(s, d), rec(s, d, "supplier", "s_suppkey")
    return KeyLinker([("s_nationkey", "c_nationkey")]).pair_counts(p, c)


def key_links_max_pairs(s, d):
    p = parts(s, d)
    return KeyLinker(["p_name", "p_size"], max_pairs=4)(p, p).links


def key_links_two_names(s, d):
    return KeyLinker([("s_nationkey", "c_nationkey")])(rec(s, d, "supplier", "s_suppkey"), customers(s, d)).links


def full_links(s, d):
    r, n = rec(s, d, "region", "r_regionkey"), rec(s, d, "nation", "n_nationkey")
    return FullLinker()(r, n).links


def empty_links(s, d):
    c = customers(s, d)
    return EmptyLinker()(c, c).links


def join_links(s, d):
    c = customers(s, d)
    return JoinLinker(lambda a, b: (a.c_nationkey == b.c_nationkey) & (F.abs(a.c_acctbal - b.c_acctbal) <= 50), near=("c_acctbal", 50.0))(c, c).links


RULES = {"brand_size": ["p_brand", "p_size"], "name_type": ["p_name", "p_type"]}


def or_links(s, d):
    p = parts(s, d)
    return OrLinker(RULES)(p, p).links


def or_rule_counts(s, d):
    p = parts(s, d)
    return OrLinker(RULES).rule_counts(p, p).select(F.array_join("rules", "+").alias("rules"), "n")


def _tags(df):
    return F.array(F.concat_ws("-", "p_brand", "p_size"), F.concat_ws("-", "p_type", "p_size"))


def unnest_links(s, d):
    p = parts(s, d)
    return UnnestLinker(_tags)(p, p).links


def _labelled(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("record_id"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("label"))
    return n


def id_match_links(s, d):
    n = _labelled(s, d)
    return IDLinker("label").match_linkage(n, n).links


def id_indefinite_links(s, d):
    n = _labelled(s, d)
    return IDLinker("label").indefinite_linkage(n, n).links


def range_join_balance(s, d):
    c = customers(s, d)
    ranges = c.select(F.col("c_custkey").alias("center"), "c_nationkey", (F.col("c_acctbal") - 50).alias("low"), (F.col("c_acctbal") + 50).alias("high"))
    met = joins.range_join(c.select("c_custkey", "c_nationkey", "c_acctbal"), ranges, "c_acctbal", "low", "high", 100.0, ["c_nationkey"])
    return met.where("center < c_custkey").select("center", "c_custkey")


def asof_previous_order(s, d):
    o = t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    out = joins.asof(o, o, ["o_custkey"], ("o_orderdate", "o_orderdate"), "previous_{name}", strict=True)
    return out.select("o_orderkey", F.col("previous_o_orderkey").alias("previous"))


def semi_customers_with_orders(s, d):
    return joins.join(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").select("o_custkey"), lambda a, b: a.c_custkey == b.o_custkey, "semi")


def anti_customers_without_orders(s, d):
    return joins.join(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").where("o_totalprice > 300000").select("o_custkey"), lambda a, b: a.c_custkey == b.o_custkey, "anti")


def lookup_with_default(s, d):
    n = t(s, d, "customer").select("c_custkey", "c_mktsegment")
    counts = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return joins.join_lookup(n, counts, "c_custkey", {"n_orders": 0})


def any_left_join(s, d):
    o = t(s, d, "orders").where("o_totalprice > 200000").select("o_custkey")
    return joins.join(t(s, d, "customer").select("c_custkey"), o, lambda a, b: a.c_custkey == b.o_custkey, "any_left").select("c_custkey", "o_custkey")


def positional_join(s, d):
    a = t(s, d, "supplier").select("s_suppkey", "s_name")
    b = t(s, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.concat_ws("-", "c_mktsegment", "c_custkey").alias("label"))
    return joins.positional(a, b, "s_suppkey", "{name}_b").select("s_suppkey", "s_suppkey_b", "label")


def _nation_customers(s, d) -> Linkage:
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("record_id"), "n_name")
    c = t(s, d, "customer").select(F.col("c_custkey").alias("record_id"), "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("long").alias("nation"))
    rich = c.where("c_acctbal > 0").select(F.col("nation").alias("record_id_l"), F.col("record_id").alias("record_id_r"))
    return Linkage(n, c, rich)


def with_n_links(s, d):
    return _nation_customers(s, d).left_linked().with_n_links()


def link_counts(s, d):
    return _nation_customers(s, d).right_linked().link_counts()


def link_counts_both_sides(s, d):
    return _nation_customers(s, d).link_counts_chart_data()


def linked_values(s, d):
    out = _nation_customers(s, d).left_linked().with_linked_values(best=F.max("c_acctbal"), segments=F.col("c_mktsegment"))
    return out.select("record_id", F.round("best", 4).alias("best"), F.array_join(F.array_sort("segments"), ",").alias("segments"))


def links_with_both(s, d):
    x = _nation_customers(s, d)
    return Links(x.links, x.left, x.right).with_both().df.select("record_id_l", "record_id_r", "n_name_l", "c_mktsegment_r", F.round("c_acctbal_r", 4).alias("c_acctbal_r"))


def filter_links_window(s, d):
    from pyspark.sql import Window

    x = _nation_customers(s, d)
    return filter_links(x.links, F.row_number().over(Window.partitionBy("record_id_l").orderBy("record_id_r")) <= 3)


def datasets_unioned(s, d):
    a, b = t(s, d, "supplier").withColumn("record_id", F.col("s_suppkey")), customers(s, d)
    return Datasets({"suppliers": a, "customers": b}).unioned()


def coordinate_links(s, d):
    from kinweave.runtime import once

    p = once(t(s, d, "coordinates"), "record_id", "lat", "lon")
    p = p.where(F.col("lat").isNotNull() & ~F.isnan("lat") & F.col("lon").isNotNull() & ~F.isnan("lon") & F.col("lat").between(-89, 89))
    return CoordinateLinker(0.1, task="dedupe").key_linker().pair_counts(p, p).groupBy().agg(F.count("*").cast("long").alias("n_bins"), F.sum("n").cast("long").alias("n_pairs"))


def naive_comparisons(s, d):
    return s.createDataFrame([(n_naive_comparisons(customers(s, d)),)], "n long")


def lsh_curve_table(s, d):
    return lsh_curves(s).select("band_size", "n_bands", F.round("jaccard", 4).alias("jaccard"), F.round("p", 6).alias("p"))


QUERIES = {f.__name__: f for f in (key_links, key_counts, pair_counts_dedupe, pair_counts_link, key_links_max_pairs, key_links_two_names, full_links, empty_links, join_links, or_links, or_rule_counts, unnest_links, id_match_links, id_indefinite_links, range_join_balance, asof_previous_order, semi_customers_with_orders, anti_customers_without_orders, lookup_with_default, any_left_join, positional_join, with_n_links, link_counts, link_counts_both_sides, linked_values, links_with_both, filter_links_window, datasets_unioned, coordinate_links, naive_comparisons, lsh_curve_table)}

_RULES = "a.p_brand = b.p_brand AND a.p_size = b.p_size", "a.p_name = b.p_name AND a.p_type = b.p_type"
_RICH = "rich AS (SELECT CAST(c_nationkey AS BIGINT) AS record_id_l, c_custkey AS record_id_r FROM customer WHERE c_acctbal > 0)"

SQL = {
    "key_links": SEGMENT_PAIRS,
    "key_counts": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL",
    "pair_counts_dedupe": "SELECT c_nationkey, c_mktsegment, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n FROM customer GROUP BY ALL",
    "pair_counts_link": "SELECT s_nationkey, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1",
    "key_links_max_pairs": """WITH k AS (SELECT p_name, p_size FROM part GROUP BY ALL HAVING count(*) * count(*) <= 4)
SELECT a.p_partkey AS record_id_l, b.p_partkey AS record_id_r FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey JOIN k ON k.p_name = a.p_name AND k.p_size = a.p_size""",
    "key_links_two_names": "SELECT s_suppkey AS record_id_l, c_custkey AS record_id_r FROM supplier JOIN customer ON s_nationkey = c_nationkey",
    "full_links": "SELECT r_regionkey AS record_id_l, n_nationkey AS record_id_r FROM region, nation",
    "empty_links": "SELECT c_custkey AS record_id_l, c_custkey AS record_id_r FROM customer WHERE false",
    "join_links": "SELECT a.c_custkey AS record_id_l, b.c_custkey AS record_id_r FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND abs(a.c_acctbal - b.c_acctbal) <= 50 AND a.c_custkey < b.c_custkey",
    "or_links": f"SELECT a.p_partkey AS record_id_l, b.p_partkey AS record_id_r FROM part a JOIN part b ON {_RULES[0]} AND a.p_partkey < b.p_partkey UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON {_RULES[1]} AND a.p_partkey < b.p_partkey",
    "or_rule_counts": f"""WITH x AS (SELECT a.p_partkey AS l, b.p_partkey AS r, 'brand_size' AS rule FROM part a JOIN part b ON {_RULES[0]} AND a.p_partkey < b.p_partkey
UNION ALL SELECT a.p_partkey, b.p_partkey, 'name_type' FROM part a JOIN part b ON {_RULES[1]} AND a.p_partkey < b.p_partkey),
y AS (SELECT l, r, string_agg(rule, '+' ORDER BY rule) AS rules FROM x GROUP BY l, r) SELECT rules, count(*) AS n FROM y GROUP BY rules""",
    "unnest_links": "SELECT a.p_partkey AS record_id_l, b.p_partkey AS record_id_r FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey",
    "id_match_links": "SELECT CAST(a.n_nationkey AS BIGINT) AS record_id_l, CAST(b.n_nationkey AS BIGINT) AS record_id_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_regionkey > 0",
    "id_indefinite_links": "SELECT CAST(a.n_nationkey AS BIGINT) AS record_id_l, CAST(b.n_nationkey AS BIGINT) AS record_id_r FROM nation a, nation b WHERE a.n_regionkey = 0 OR b.n_regionkey = 0",
    "range_join_balance": "SELECT a.c_custkey AS center, b.c_custkey FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_acctbal BETWEEN a.c_acctbal - 50 AND a.c_acctbal + 50 AND a.c_custkey < b.c_custkey",
    "asof_previous_order": """WITH days AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL),
p AS (SELECT *, lag(k) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS previous FROM days)
SELECT o_orderkey, previous FROM orders JOIN p USING (o_custkey, o_orderdate)""",
    "semi_customers_with_orders": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_customers_without_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "lookup_with_default": "SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer",
    "any_left_join": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN c_custkey END AS o_custkey FROM customer",
    "positional_join": "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), b AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) SELECT s_suppkey, c_custkey AS s_suppkey_b, c_mktsegment || '-' || c_custkey AS label FROM a JOIN b USING (n)",
    "with_n_links": f"WITH {_RICH} SELECT CAST(n_nationkey AS BIGINT) AS record_id, n_name, (SELECT count(*) FROM rich WHERE record_id_l = n_nationkey) AS n_links FROM nation",
    "link_counts": "SELECT CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_links, count(*) AS n_records FROM customer GROUP BY 1",
    "link_counts_both_sides": f"""WITH {_RICH}, l AS (SELECT (SELECT count(*) FROM rich WHERE record_id_l = n_nationkey) AS n_links FROM nation),
r AS (SELECT CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_links FROM customer)
SELECT 'left' AS side, n_links, count(*) AS n_records FROM l GROUP BY ALL UNION ALL SELECT 'right', n_links, count(*) FROM r GROUP BY ALL""",
    "linked_values": "SELECT CAST(n_nationkey AS BIGINT) AS record_id, round(max(c_acctbal), 4) AS best, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1",
    "links_with_both": "SELECT CAST(c_nationkey AS BIGINT) AS record_id_l, c_custkey AS record_id_r, n_name AS n_name_l, c_mktsegment AS c_mktsegment_r, round(c_acctbal, 4) AS c_acctbal_r, FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0",
    "filter_links_window": f"WITH {_RICH} SELECT record_id_l, record_id_r FROM rich QUALIFY row_number() OVER (PARTITION BY record_id_l ORDER BY record_id_r) <= 3",
    "datasets_unioned": "SELECT 'suppliers' AS dataset, s_suppkey AS record_id FROM supplier UNION ALL SELECT 'customers', c_custkey FROM customer",
    "coordinate_links": """WITH p AS (SELECT DISTINCT record_id, lat, lon FROM coordinates WHERE lat BETWEEN -89 AND 89 AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon)),
g AS (SELECT CAST(floor(lat / (0.30000000000000004 / (pi() * 6371.0 / 180))) AS BIGINT) AS a, CAST(floor(lon / (0.30000000000000004 / ((pi() * 6371.0 / 180) * cos(radians(lat))))) AS BIGINT) AS b FROM p),
n AS (SELECT a, b, count(*) AS k FROM g GROUP BY ALL) SELECT count(*) AS n_bins, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS n_pairs FROM n""",
    "naive_comparisons": "SELECT count(*) * (count(*) - 1) // 2 AS n FROM customer",
    "lsh_curve_table": """WITH g(band_size, n_bands) AS (VALUES (2, 5), (2, 10), (2, 20), (2, 40), (5, 5), (5, 10), (5, 20), (5, 40), (10, 5), (10, 10), (10, 20), (10, 40), (10, 80))
SELECT band_size, n_bands, round(k / 50, 4) AS jaccard, round(1 - pow(1 - pow(k / 50, band_size), n_bands), 6) AS p FROM g, range(51) AS r(k)""",
}
