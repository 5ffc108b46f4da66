"""The queries of the subpackage and the SQL they are held against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import addresses, components, leakage, matching, packing, terms, truncation, variants
from kinweave.runtime import materialize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scores = terms.relevance(_t(spark, d, "record_terms"), k1=math.inf, b=0, idf="plain", least_records=2)
    return terms.most_characteristic(scores).select("record_id", "term")


def p1_relevance(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    scores = terms.relevance(_t(spark, d, "record_terms"))
    return scores.select("record_id", "term", "tf", "n_records", F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_t(spark, d, "record_terms")).where("mark IS NOT NULL").select("term", "mark")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    f = terms.term_frequencies(_t(spark, d, "record_terms"))
    return f.select("term", "occurrences", "n_records", F.round("frequency", 9).alias("frequency"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(_t(spark, d, "links_table"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_location(_t(spark, d, "addresses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = matching.matches(_t(spark, d, "rldata_left"), _t(spark, d, "rldata_right"))
    return found.where("confidence >= 0.5").select("record_id_l", "record_id_r")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.matches(_t(spark, d, "rldata_left"), _t(spark, d, "rldata_right"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.same_entity(_t(spark, d, "person_names"))


def _packed(spark: SparkSession, d: str, **more) -> DataFrame:
    documents = _t(spark, d, "documents").withColumn("cluster", packing.copies("text"))
    sizes = packing.token_counts(documents, keep=("cluster", "source"))
    return packing.pack(sizes, _t(spark, d, "containers"), cluster="cluster", **more)


#: Texts of one source that may share a container: hardly fewer than a large one holds, so that little space is lost to the source rule.
PER_SOURCE = 48


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, source="source", per_source=PER_SOURCE)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(_packed(spark, d, source="source", per_source=PER_SOURCE), _t(spark, d, "containers"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Of each document with a text, how its pieces lie in the containers of each kind: their number, tokens and longest piece, and whether any container is too full."""
    from pyspark.sql import functions as F

    packed = materialize(_packed(spark, d, source="source", per_source=PER_SOURCE))
    caps = _t(spark, d, "containers").select("container_kind", "capacity_tokens").distinct()
    used = packed.groupBy("container_kind", "container_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"), F.countDistinct("position").alias("places"), F.max("position").alias("last"))
    sound = used.select("container_kind", "container_id", "used", ((F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("in_order"))
    each = packed.join(sound, ["container_kind", "container_id"]).join(F.broadcast(caps), "container_kind")
    whole = each.groupBy("container_kind", "doc_id").agg(F.count("*").alias("n_pieces"), F.sum("size").alias("tokens"), F.bool_and((F.col("used") <= F.col("capacity_tokens")) & F.col("in_order")).alias("fits"), F.max("capacity_tokens").alias("capacity"))
    split = F.col("n_pieces") == F.ceil(F.col("tokens") / F.col("capacity"))
    return whole.select("container_kind", "doc_id", (F.col("fits") & split).alias("sound"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_t(spark, d, "documents"), _t(spark, d, "benchmark")).select("item_id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_off(_t(spark, d, "documents"), also="title")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(_t(spark, d, "documents"), also="title")


QUERIES = {f.__name__: f for f in (p1_found, p1_relevance, p5_found, p5_frequencies, p6_found, p2_found, p3_found, p3_matches, p7_found, p8_pack, p8_fill, p8_pieces, p9_found, p10_found, p10_rates)}

_POSTS = """
WITH recs AS (SELECT record_id, any_value(terms) AS terms FROM record_terms WHERE terms IS NOT NULL AND record_id IS NOT NULL GROUP BY record_id),
entries AS (SELECT record_id, unnest(terms) AS entry FROM recs),
posts AS (SELECT record_id, lower(trim(entry)) AS term, count(*) AS tf FROM entries WHERE trim(entry) <> '' GROUP BY ALL),
counts AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS n_records FROM posts GROUP BY term),
total AS (SELECT count(*) AS n_all FROM recs)
"""

SQL = {
    "p1_found": _POSTS
    + """, scored AS (SELECT record_id, term, round(tf * ln(n_all / n_records), 9) AS score FROM posts JOIN counts USING (term), total WHERE n_records >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, encode(term)) AS place FROM scored)
SELECT record_id, term FROM ranked WHERE place = 1""",
    "p1_relevance": _POSTS
    + """, sums AS (SELECT sum(tf) AS length_all FROM posts),
lengths AS (SELECT record_id, sum(tf) AS length FROM posts GROUP BY record_id)
SELECT record_id, term, tf, n_records, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * CAST(length AS DOUBLE) * n_all / CAST(length_all AS DOUBLE))) * ln(1 + (n_all - n_records + 0.5) / (n_records + 0.5)), 6) AS score
FROM posts JOIN counts USING (term) JOIN lengths USING (record_id), total, sums""",
    "p5_found": _POSTS
    + "SELECT term, CASE WHEN n_records <= 2 THEN 'rare' ELSE 'common' END AS mark FROM counts, total WHERE n_records <= 2 OR n_records > 0.05 * n_all",
    "p5_frequencies": _POSTS + "SELECT term, occurrences, n_records, round(n_records / n_all, 9) AS frequency FROM counts, total",
    "p8_pieces": "SELECT container_kind, doc_id, true AS sound FROM documents, (SELECT DISTINCT container_kind FROM containers WHERE capacity_tokens > 0) WHERE doc_id IS NOT NULL AND length(text) > 0",
    "p6_found": """
WITH RECURSIVE edges AS (SELECT DISTINCT a, b FROM (SELECT record_id_l AS a, record_id_r AS b FROM links_table UNION ALL SELECT record_id_r, record_id_l FROM links_table) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
nodes AS (SELECT DISTINCT id FROM (SELECT record_id_l AS id FROM links_table UNION ALL SELECT record_id_r FROM links_table) WHERE id IS NOT NULL),
reach(id, root) USING KEY (id) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT e.b, min(r.root) FROM reach r JOIN edges e ON e.a = r.id JOIN recurring.reach old ON old.id = e.b WHERE r.root < old.root GROUP BY e.b
)
SELECT id AS record_id, root AS group_id FROM reach""",
}
