"""Queries of comparison, scoring, clustering, frequencies, diffs and summaries."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import functions as F

from kinweave.operators import cluster, eda, tf
from kinweave.operators.compare import EnumComparer, compared_counts
from kinweave.operators.diff import Diff
from kinweave.operators.fs import ComparerWeights, LevelWeights, Weights, em, odds_to_log_odds, odds_to_prob, prob_to_odds, train_using_em, train_using_labels
from kinweave.operators.linkers import KeyLinker
from kinweave.operators.model import Links
from kinweave.operators.spatial import points_in_regions
from kinweave.queries.linkage import parts, t
from kinweave.runtime import once


class Agree(IntEnum):
    same = 0
    near = 1
    other = 2


NAME = EnumComparer("name_level", Agree, [("same", lambda p: p.p_name_l == p.p_name_r), ("near", lambda p: F.substring("p_name_l", 1, 3) == F.substring("p_name_r", 1, 3)), ("other", True)])
PRICE = EnumComparer("price_level", Agree, [("same", lambda p: F.abs(p.p_retailprice_l - p.p_retailprice_r) < 1), ("near", lambda p: F.abs(p.p_retailprice_l - p.p_retailprice_r) < 100), ("other", True)], as_string=True)
WEIGHTS = Weights((ComparerWeights("name_level", (LevelWeights("same", 0.8, 0.02), LevelWeights("near", 0.15, 0.08), LevelWeights("other", 0.05, 0.9))), ComparerWeights("price_level", (LevelWeights("same", 0.7, 0.01), LevelWeights("near", 0.2, 0.19), LevelWeights("other", 0.1, 0.8)))))


def _pairs(s, d):
    p = parts(s, d).select("record_id", "p_name", "p_retailprice", "p_brand", "p_size")
    links = KeyLinker(["p_brand", "p_size"])(p, p).links
    return Links(links, p, p).with_both().df


def levels(s, d):
    return PRICE(NAME(_pairs(s, d))).select("record_id_l", "record_id_r", "name_level", "price_level")


def level_vectors(s, d):
    c = compared_counts(levels(s, d), [NAME, PRICE])
    return c.select("vector_id", "n_pairs", F.round("pct", 6).alias("pct"))


def scored_pairs(s, d):
    x = WEIGHTS.score_compared(levels(s, d), [NAME, PRICE])
    return x.select("record_id_l", "record_id_r", F.round("odds", 6).alias("odds"), F.round(odds_to_prob(F.col("odds")), 9).alias("probability"), F.round(odds_to_log_odds(F.col("odds")), 6).alias("log_odds"), F.round("name_level_odds", 6).alias("name_level_odds"))


def probability_odds(s, d):
    x = t(s, d, "lineitem").select(F.col("l_discount").alias("p")).distinct()
    return x.select("p", F.round(prob_to_odds(F.col("p")), 9).alias("odds"))


def em_weights(s, d):
    """Weights by EM from all pairs that the link gives, for comparison with the same rounds over counts."""
    p = parts(s, d).select("record_id", "p_name", "p_retailprice", "p_brand", "p_size")
    links = KeyLinker(["p_brand", "p_size"])(p, p).links
    w = train_using_em([NAME, PRICE], p, p, links=links)
    return w.table(s)


def label_weights(s, d):
    r = once(t(s, d, "rldata_left").withColumn("label_true", F.col("label_true")), "record_id", "label_true", "fname_c1", "lname_c1", "by_year")
    name = EnumComparer("surname", Agree, [("same", lambda p: p.lname_c1_l == p.lname_c1_r), ("near", lambda p: F.levenshtein("lname_c1_l", "lname_c1_r") <= 2), ("other", True)])
    year = EnumComparer("year", Agree, [("same", lambda p: p.by_year_l == p.by_year_r), ("near", lambda p: F.abs(p.by_year_l - p.by_year_r) <= 1), ("other", True)])
    return train_using_labels([name, year], r, r).table(s)


SAME_PART = KeyLinker(["p_name", "p_brand"])


def _part_links(s, d):
    """Links that join the same parts as all links of equal keys do."""
    return SAME_PART.spanning_links(parts(s, d))


def component_labels(s, d):
    return cluster.connected_components(_part_links(s, d))


def component_records(s, d):
    c = cluster.connected_components(_part_links(s, d), parts(s, d).select("record_id"))
    sizes = c.groupBy("component").agg(F.count("*").alias("size"), F.min("record_id").alias("least"))
    return c.join(sizes, "component").select("record_id", F.col("least").alias("component"), "size")


def degrees(s, d):
    p = parts(s, d)
    return cluster.with_degrees(SAME_PART.degrees(p), p.select("record_id"))


def degree_counts(s, d):
    return cluster.histogram_of_degrees(degrees(s, d))


def _clusterings(s, d):
    e = t(s, d, "embeddings").select(F.col("vec_id").alias("record_id"), "label", F.expr("cast(vec_id % 7 as int)").alias("other"))
    return e.select("record_id", "label"), e.select("record_id", F.col("other").alias("label"))


def clustering_scores(s, d):
    a, b = _clusterings(s, d)
    x = cluster.scores(a, b)
    row = tuple(x[k] for k in ("rand", "adjusted_rand", "fowlkes_mallows", "mutual_info", "homogeneity", "completeness", "v_measure", "normalized_mutual_info"))
    return s.createDataFrame([tuple(round(x, 9) for x in row)], "rand double, adjusted_rand double, fowlkes_mallows double, mutual_info double, homogeneity double, completeness double, v_measure double, normalized_mutual_info double")


def adjusted_mutual_information(s, d):
    a, b = _clusterings(s, d)
    return s.createDataFrame([(cluster.adjusted_mutual_info_score(a, b),)], "ami double")


def term_statistics(s, d):
    x = tf.stats_table(t(s, d, "part"), "p_brand")
    return x.select("value", "count", F.round("frequency", 9).alias("frequency"))


def _model(s, d):
    return tf.TermFrequencyModel.from_table(t(s, d, "part"), "p_brand", "p_size")


def term_frequency_products(s, d):
    x = _model(s, d).add_frequency(t(s, d, "part").select("p_partkey", "p_brand", "p_size"))
    return x.select("p_partkey", F.round("frequency", 9).alias("frequency"))


def rare_needles(s, d):
    p = t(s, d, "part")
    return tf.keep_rare(p.select("p_partkey", "p_brand", "p_size"), p, ["p_brand", "p_size"], 0.0005).select("p_partkey")


def ambiguous_records(s, d):
    return tf.ambiguous(t(s, d, "part").select("p_partkey", "p_name", "p_size"), ["p_name", "p_size"]).select("p_partkey")


def unambiguous_records(s, d):
    return tf.keep_unambiguous(t(s, d, "part").select("p_partkey", "p_name", "p_size"), ["p_name", "p_size"]).select("p_partkey")


def _order_diff(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    before = o.where("o_orderkey % 11 <> 0")
    after = o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return Diff.from_before_after(before, after, "o_orderkey")


def diff_insertions(s, d):
    return _order_diff(s, d).insertions


def diff_deletions(s, d):
    return _order_diff(s, d).deletions


def diff_updates(s, d):
    u = _order_diff(s, d).updates.df
    return u.select(F.col("o_orderkey.before").alias("o_orderkey"), F.col("o_orderstatus.before").alias("status_before"), F.col("o_orderstatus.after").alias("status_after"))


def diff_stats(s, d):
    return _order_diff(s, d).stats()


def diff_changes(s, d):
    return _order_diff(s, d).updates.value_change_counts()


def diff_unchanged(s, d):
    return _order_diff(s, d).unchanged()


def diff_from_deltas(s, d):
    x = _order_diff(s, d)
    return Diff.from_deltas(x.before, x.insertions, x.deletions, x.updates).after


def value_distribution(s, d):
    x = eda.distribution(t(s, d, "orders"), "o_orderpriority")
    return x.select("value", "n", "rank", F.round("pct", 6).alias("pct"))


def word_distribution(s, d):
    w = t(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    x = eda.distribution(w, "w")
    return x.select("value", "n", "rank", F.round("pct", 6).alias("pct"))


def key_histogram(s, d):
    p = t(s, d, "part").groupBy("p_name", "p_size").agg(F.count("*").alias("n"))
    return eda.counts_histogram(p)


def column_profile(s, d):
    return eda.column_summary(t(s, d, "person_names").select("record_id", "fname_c1", "by_year", "intake"))


def p4_regions(s, d):
    """Points in squares of half a degree, given as polygons, made where there are points."""
    points = once(t(s, d, "coordinates"), "record_id", "lat", "lon")
    known = points.where("lat between -90 and 90 and lon is not null and not isnan(lat) and not isnan(lon)")
    at = known.select(F.floor(F.col("lat") * 2).alias("a"), F.floor(F.expr("pmod(lon + 180, 360) - 180") * 2).alias("b")).distinct()
    corner = lambda x, y: F.struct((F.col("a") / 2.0 + x).alias("lat"), (F.col("b") / 2.0 + y).alias("lon"))
    ring = F.array(corner(0.0, 0.0), corner(0.0, 0.5), corner(0.5, 0.5), corner(0.5, 0.0))
    regions = at.select(F.concat_ws(":", "a", "b").alias("region_id"), ring.alias("ring"))
    return points_in_regions(points, regions)


_ALL = (levels, level_vectors, scored_pairs, probability_odds, em_weights, label_weights, component_labels, component_records, degrees, degree_counts, clustering_scores, adjusted_mutual_information, term_statistics, term_frequency_products, rare_needles, ambiguous_records, unambiguous_records, diff_insertions, diff_deletions, diff_updates, diff_stats, diff_changes, diff_unchanged, diff_from_deltas, value_distribution, word_distribution, key_histogram, column_profile, p4_regions)
QUERIES = {f.__name__: f for f in _ALL}

_LEVELS = """lv AS (SELECT a.p_partkey AS record_id_l, b.p_partkey AS record_id_r,
 CASE WHEN a.p_name = b.p_name THEN 0 WHEN left(a.p_name, 3) = left(b.p_name, 3) THEN 1 ELSE 2 END AS name_level,
 CASE WHEN abs(a.p_retailprice - b.p_retailprice) < 1 THEN 'same' WHEN abs(a.p_retailprice - b.p_retailprice) < 100 THEN 'near' ELSE 'other' END AS price_level
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"""
_O = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders), before AS (SELECT * FROM o WHERE o_orderkey % 11 <> 0),
after AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM o WHERE o_orderkey % 13 <> 0),
upd AS (SELECT b.o_orderkey, b.o_custkey, b.o_orderstatus AS sb, a.o_orderstatus AS sa, b.o_totalprice FROM before b JOIN after a USING (o_orderkey) WHERE b.o_orderstatus IS DISTINCT FROM a.o_orderstatus)"""
_C = """e AS (SELECT label AS x, CAST(vec_id % 7 AS INTEGER) AS y FROM embeddings), c AS (SELECT x, y, count(*)::DOUBLE AS n FROM e GROUP BY ALL),
r AS (SELECT x, sum(n) AS m FROM c GROUP BY 1), k AS (SELECT y, sum(n) AS m FROM c GROUP BY 1),
z AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS tp, (SELECT sum(m * (m - 1) / 2) FROM r) AS a, (SELECT sum(m * (m - 1) / 2) FROM k) AS b,
(SELECT sum(n * ln(n)) FROM c) AS cl, (SELECT sum(m * ln(m)) FROM r) AS rl, (SELECT sum(m * ln(m)) FROM k) AS kl),
w AS (SELECT *, n * (n - 1) / 2 AS al, ln(n) - rl / n AS ht, ln(n) - kl / n AS hp, ln(n) + (cl - rl - kl) / n AS mi FROM z)"""

SQL = {
    "levels": f"WITH {_LEVELS} SELECT * FROM lv",
    "level_vectors": f"WITH {_LEVELS} SELECT (CASE name_level WHEN 0 THEN 'same' WHEN 1 THEN 'near' ELSE 'other' END) || ':' || price_level AS vector_id, count(*) AS n_pairs, round(100 * count(*) / (SELECT count(*) FROM lv), 6) AS pct FROM lv GROUP BY 1",
    "scored_pairs": f"""WITH {_LEVELS}, x AS (SELECT *, CASE name_level WHEN 0 THEN 0.8::DOUBLE / 0.02::DOUBLE WHEN 1 THEN 0.15::DOUBLE / 0.08::DOUBLE ELSE 0.05::DOUBLE / 0.9::DOUBLE END AS a, CASE price_level WHEN 'same' THEN 0.7::DOUBLE / 0.01::DOUBLE WHEN 'near' THEN 0.2::DOUBLE / 0.19::DOUBLE ELSE 0.1::DOUBLE / 0.8::DOUBLE END AS b FROM lv)
SELECT record_id_l, record_id_r, round(a * b, 6) AS odds, round(a * b / (1 + a * b), 9) AS probability, round(log10(a * b), 6) AS log_odds, round(a, 6) AS name_level_odds FROM x""",
    "probability_odds": "SELECT DISTINCT l_discount AS p, round(l_discount / (1 - l_discount), 9) AS odds FROM lineitem",
    "component_labels": "WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS component, count(*) OVER (PARTITION BY p_name, p_brand) AS k FROM part) SELECT p_partkey AS record_id, component FROM g WHERE k > 1",
    "component_records": "SELECT p_partkey AS record_id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS component, count(*) OVER (PARTITION BY p_name, p_brand) AS size FROM part",
    "degrees": "SELECT p_partkey AS record_id, count(*) OVER (PARTITION BY p_name, p_brand) - 1 AS degree FROM part",
    "degree_counts": "WITH g AS (SELECT count(*) OVER (PARTITION BY p_name, p_brand) - 1 AS degree FROM part) SELECT degree, count(*) AS n_records FROM g GROUP BY 1",
    "clustering_scores": f"""WITH {_C} SELECT round((al + 2 * tp - a - b) / al, 9) AS rand, round((tp - a * b / al) / ((a + b) / 2 - a * b / al), 9) AS adjusted_rand, round(tp / sqrt(a * b), 9) AS fowlkes_mallows,
round(mi, 9) AS mutual_info, round(mi / ht, 9) AS homogeneity, round(mi / hp, 9) AS completeness, round(2 * mi / (ht + hp), 9) AS v_measure, round(mi / ((ht + hp) / 2), 9) AS normalized_mutual_info FROM w""",
    "term_statistics": "SELECT p_brand AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM part), 9) AS frequency FROM part GROUP BY 1",
    "term_frequency_products": "WITH b AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS f FROM part GROUP BY 1), z AS (SELECT p_size, count(*) / (SELECT count(*) FROM part) AS g FROM part GROUP BY 1) SELECT p_partkey, round(f * g, 9) AS frequency FROM part JOIN b USING (p_brand) JOIN z USING (p_size)",
    "rare_needles": "WITH b AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS f FROM part GROUP BY 1), z AS (SELECT p_size, count(*) / (SELECT count(*) FROM part) AS g FROM part GROUP BY 1) SELECT p_partkey FROM part JOIN b USING (p_brand) JOIN z USING (p_size) WHERE f * g <= 0.0005",
    "ambiguous_records": "SELECT p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY p_name, p_size) > 1",
    "unambiguous_records": "SELECT p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY p_name, p_size) = 1",
    "diff_insertions": f"WITH {_O} SELECT * FROM after WHERE o_orderkey NOT IN (SELECT o_orderkey FROM before)",
    "diff_deletions": f"WITH {_O} SELECT * FROM before WHERE o_orderkey NOT IN (SELECT o_orderkey FROM after)",
    "diff_updates": f"WITH {_O} SELECT o_orderkey, sb AS status_before, sa AS status_after FROM upd",
    "diff_stats": f"""WITH {_O}, n AS (SELECT (SELECT count(*) FROM before) AS n_before, (SELECT count(*) FROM after) AS n_after, (SELECT count(*) FROM after WHERE o_orderkey NOT IN (SELECT o_orderkey FROM before)) AS n_insertions,
(SELECT count(*) FROM before WHERE o_orderkey NOT IN (SELECT o_orderkey FROM after)) AS n_deletions, (SELECT count(*) FROM upd) AS n_updates) SELECT *, n_before - n_deletions - n_updates AS n_unchanged FROM n""",
    "diff_changes": f"""WITH {_O}, s AS (SELECT 'o_orderstatus' AS "column", CASE WHEN sa IS NULL THEN 'became_null' ELSE 'changed' END AS change, count(*) AS n FROM upd GROUP BY ALL)
SELECT * FROM s UNION ALL SELECT c, 'unchanged', (SELECT count(*) FROM upd) FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) AS v(c)""",
    "diff_unchanged": f"WITH {_O} SELECT DISTINCT b.* FROM before b JOIN after a USING (o_orderkey) WHERE b.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus",
    "diff_from_deltas": f"WITH {_O} SELECT * FROM after",
    "value_distribution": "WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS rank, round(100 * n / (SELECT count(*) FROM orders), 6) AS pct FROM c",
    "word_distribution": "WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS value FROM part), c AS (SELECT value, count(*) AS n FROM w GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS rank, round(100 * n / (SELECT count(*) FROM w), 6) AS pct FROM c",
    "key_histogram": "WITH k AS (SELECT count(*) AS n FROM part GROUP BY p_name, p_size) SELECT n, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM k GROUP BY n",
    "column_profile": "SELECT 'record_id' AS \"column\", count(*) AS n_rows, count(*) - count(record_id) AS n_null, count(DISTINCT record_id) AS n_distinct FROM person_names UNION ALL SELECT 'fname_c1', count(*), count(*) - count(fname_c1), count(DISTINCT fname_c1) FROM person_names UNION ALL SELECT 'by_year', count(*), count(*) - count(by_year), count(DISTINCT by_year) FROM person_names UNION ALL SELECT 'intake', count(*), count(*) - count(intake), count(DISTINCT intake) FROM person_names",
    "p4_regions": """SELECT DISTINCT record_id, CAST(floor(lat * 2) AS BIGINT) || ':' || CAST(floor((lon - 360 * floor((lon + 180) / 360)) * 2) AS BIGINT) AS region_id FROM coordinates
WHERE lat BETWEEN -90 AND 90 AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon)""",
}
