"""Queries of dimensions (names, e-mail addresses, phone numbers), blockers, remaining joins and sets of rows, near copies, and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import contacts, vectors
from kinweave.functions.streets import canonical_type
from kinweave.operators import cluster, eda, joins
from kinweave.operators.diff import Updates
from kinweave.operators.fs import ComparerWeights
from kinweave.operators.linkers import CoordinateLinker, JoinLinker, KeyLinker, MinhashLshLinker, NameBlocker
from kinweave.operators.model import Links, UnionTable, n_total
from kinweave.operators.sampling import sample_all_links, sample_table
from kinweave.operators.within import pairs_within
from kinweave.queries.linkage import CUSTOMER, customers, parts, t
from kinweave.queries.models import NAME, PRICE, WEIGHTS, _pairs
from kinweave.runtime import materialize, once, temporary
from kinweave.sources.io import links_from_labels, read_csv


def name_blocks(s, d):
    n = once(t(s, d, "person_names").where("name is not null and by_year is not null"), "record_id", "name", "by_year").where("by_year >= 1990")
    return NameBlocker()(n, n).links


def _contacts(s, d):
    """People's addresses and numbers made of what was typed as their names, dirt included."""
    n = once(t(s, d, "person_names"), "record_id", "fname_c1", "lname_c1", "by_year", "bm")
    user = F.concat(F.lit(" "), F.regexp_replace("lname_c1", r"\s+", "_"), F.lit("."), F.col("bm").cast("string"))
    typed = F.array(F.concat(user, F.lit("@Post.example ")), F.concat(F.lit("see "), F.regexp_replace("fname_c1", r"\s+", ""), F.lit("@"), F.lit("farm.example")), F.lit("nobody@"))
    number = F.array(F.concat(F.lit("+1 (415) 555-"), F.col("by_year").cast("string")), F.concat(F.lit("206 555 "), F.col("by_year").cast("string"), F.lit(" x")))
    return n.select("record_id", typed.alias("emails"), number.alias("phones"))


def email_addresses(s, d):
    dim = contacts.EmailsDimension()
    e = dim.prepare(_contacts(s, d)).select("record_id", F.explode("emails_parsed").alias("e"))
    return e.select("record_id", F.col("e.full").alias("full"), F.col("e.user").alias("user"), F.col("e.domain").alias("domain"))


def email_blocks(s, d):
    dim = contacts.EmailsDimension()
    c = dim.prepare(_contacts(s, d).where("emails[0] is not null"))
    return dim.block(c.withColumn("emails_parsed", F.slice("emails_parsed", 1, 1)), c.withColumn("emails_parsed", F.slice("emails_parsed", 1, 1)), "dedupe").links


def phone_numbers(s, d):
    c = contacts.PhonesDimension().prepare(_contacts(s, d))
    return c.select("record_id", F.explode("phones_cleaned").alias("phone"))


def phone_matches(s, d):
    dim = contacts.PhonesDimension()
    c = dim.prepare(_contacts(s, d)).where("phones[0] is not null")
    a, b = c.select(F.col("record_id").alias("record_id_l"), F.col("phones_cleaned").alias("phones_cleaned_l")), c.select(F.col("record_id").alias("record_id_r"), F.col("phones_cleaned").alias("phones_cleaned_r"))
    near = F.substring("record_id_l", 1, 9) == F.substring("record_id_r", 1, 9)
    out = dim.compare(a.join(b, near & (F.col("record_id_l") < F.col("record_id_r"))))
    return out.select("record_id_l", "record_id_r", F.col("phones_compared").alias("level"))


def type_spellings(s, d):
    w = t(s, d, "addresses").select(F.explode(F.split(F.upper("street1"), r"[^A-Za-z]+")).alias("w")).where(F.col("w").isin("STREET", "ST", "AVENUE", "AVE", "AV", "ROAD", "RD", "LANE", "LN", "DRIVE", "DR", "COURT", "CT"))
    return w.groupBy(canonical_type("w").alias("type")).agg(F.count("*").alias("n"))


def _maps(s, d):
    p = parts(s, d)
    each = p.select("p_partkey", "p_brand", F.explode(F.split("p_name", " ")).alias("w")).groupBy("p_partkey", "p_brand", "w").agg(F.count("*").alias("n"))
    return each.groupBy("p_partkey", "p_brand").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("w", (F.col("n") + F.length("w")).cast("double").alias("v"))))).alias("m"))


def sparse_vectors(s, d):
    m = _maps(s, d).select("p_partkey", "p_brand", F.map_entries("m").alias("entries"))
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda u, v: u + v)

    def scores(x, y):
        a, b = F.map_from_entries(x("entries")), F.map_from_entries(y("entries"))
        length = lambda v: F.round(vectors.norm(v, "l2", True), 6)
        return {"dot": F.round(vectors.dot(a, b, True), 6), "cosine": F.round(vectors.cosine_similarity(a, b, True), 6), "product": F.round(total(vectors.mul(a, b, True)), 6), "norm": (length(a), length(b))}

    x = pairs_within(m, "p_partkey", ["p_brand"], ["entries"], scores)
    return x.select(F.col("p_partkey_l").alias("l"), F.col("p_partkey_r").alias("r"), "dot", "cosine", "product", "norm")


def compare_and_score(s, d):
    x = WEIGHTS.compare_and_score(_pairs(s, d), [NAME, PRICE])
    return x.select("record_id_l", "record_id_r", F.round("odds", 6).alias("odds"))


def level_probabilities(s, d):
    w: ComparerWeights = WEIGHTS["name_level"]
    x = NAME(_pairs(s, d)).select("record_id_l", "record_id_r", "name_level")
    return x.select("record_id_l", "record_id_r", F.round(w.match_probability(F.col("name_level")), 9).alias("probability"), F.round(w.log_odds(F.col("name_level")), 6).alias("log_odds"))


def updates_of_structs(s, d):
    o = t(s, d, "orders").where("o_orderkey % 3 = 0")
    side = lambda status: F.struct(F.col("o_orderkey"), status.alias("status"))
    df = o.select(side(F.col("o_orderstatus")).alias("before"), side(F.when(F.col("o_orderkey") % 2 == 0, F.lit("Z")).otherwise(F.col("o_orderstatus"))).alias("after"))
    u = Updates.from_before_after(df, "before", "after").changed().df
    return u.select(F.col("o_orderkey.after").alias("o_orderkey"), F.col("status.before").alias("status_before"), F.col("status.after").alias("status_after"))


def label_links(s, d):
    both = t(s, d, "rldata_right").select("record_id", "label_true").distinct()
    return links_from_labels(both.where("label_true is not null")).select("record_id_l", "record_id_r")


def _few(s, d):
    a = t(s, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_nationkey")
    b = t(s, d, "supplier").where("s_acctbal > 7000").select("s_suppkey", "s_nationkey")
    return a, b


def right_join(s, d):
    a, b = _few(s, d)
    return joins.join(a, b, lambda x, y: x.c_custkey == y.s_suppkey, "right")


def outer_join(s, d):
    a, b = _few(s, d)
    return joins.join(a, b, lambda x, y: x.c_custkey == y.s_suppkey, "outer")


def any_inner_join(s, d):
    o = t(s, d, "orders").select("o_custkey")
    return joins.join(t(s, d, "customer").select("c_custkey"), o, lambda a, b: a.c_custkey == b.o_custkey, "any_inner").select("c_custkey", "o_custkey")


def intersect_keys(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("key")).intersect(t(s, d, "supplier").select(F.col("s_nationkey").alias("key")))


def key_pairs_total(s, d):
    c = customers(s, d)
    return s.createDataFrame([(int(n_total(CUSTOMER.pair_counts(c, c, ordered=False))),)], "n long")


def top_values(s, d):
    x = eda.distribution(t(s, d, "lineitem"), "l_quantity", limit=7)
    return x.select(F.col("value").cast("double").alias("value"), "n", "rank")


def chained_components(s, d):
    """Parts of a brand are linked with the next one unless sixty keys lie between: chains, no cliques."""
    return cluster.connected_components(_chains(s, d))


def _chains(s, d):
    from pyspark.sql import Window

    following = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    x = parts(s, d).select(F.col("p_partkey").alias("record_id_r"), following.alias("record_id_l"))
    return x.where("record_id_l - record_id_r <= 60").select("record_id_l", "record_id_r")


def coordinate_pairs(s, d):
    p = once(t(s, d, "coordinates"), "record_id", "lat", "lon").where("not isnan(lat) and not isnan(lon) and lat between -90 and 90")
    return CoordinateLinker(0.1, task="dedupe")(p, p).links


def _texts(s, d):
    """Each different text once, with the hashes of its runs of five words (of all words, where there are fewer)."""
    texts = t(s, d, "documents").where("text is not null and text <> ''").groupBy("text").agg(F.min("doc_id").alias("record_id"))
    words = texts.select("record_id", "text", F.split("text", " ").alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 5)))
    return words.select("record_id", "text", F.array_sort(F.array_distinct(runs)).alias("shingles"))


def _near(docs):
    """Bands of three: all but 4 in 100 million pairs of similarity 0.8 are looked at, then measured."""
    links = MinhashLshLinker("shingles", band_size=3, n_bands=24)(docs, docs).links
    sets = docs.select("record_id", "shingles")
    pairs = links.join(sets.toDF("record_id_l", "a"), "record_id_l").join(sets.toDF("record_id_r", "b"), "record_id_r")
    shared = F.size(F.array_intersect("a", "b"))
    pairs = pairs.withColumn("jaccard", shared / (F.size("a") + F.size("b") - shared))
    return pairs.where("jaccard >= 0.8").select("record_id_l", "record_id_r", F.round("jaccard", 6).alias("jaccard"))


def minhash_links(s, d):
    return _near(materialize(_texts(s, d)))


def text_classes(s, d):
    """The class of every document with a text: the least id among the copies and near copies that it is linked with, directly or through others."""
    docs = materialize(_texts(s, d))
    groups = cluster.connected_components(_near(docs), docs.select("record_id")).withColumnRenamed("component", "group")
    least = groups.groupBy("group").agg(F.min("record_id").alias("class_id"))
    of = groups.join(least, "group").join(docs, "record_id").select("text", "class_id")
    return t(s, d, "documents").where("text is not null and text <> ''").select("doc_id", "text").join(of, "text").select("doc_id", "class_id")


def sample_pairs(s, d):
    """What a sample of pairs must be: as many as asked for, different, of records that there are."""
    c = customers(s, d)
    x = materialize(sample_all_links(c, c, 10_000, seed=3))
    known = x.join(c.select(F.col("record_id").alias("record_id_l")), "record_id_l").join(c.select(F.col("record_id").alias("record_id_r")), "record_id_r")
    return s.createDataFrame([(x.count(), x.distinct().count(), known.count())], "n long, different long, known long")


def sample_hash(s, d):
    x = sample_table(t(s, d, "customer"), 100, "hash", seed=1).select("c_custkey")
    return x.agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("different"))


def linked_both_sides(s, d):
    c = customers(s, d).select("record_id", "c_mktsegment")
    x = KeyLinker(["c_mktsegment", "c_nationkey"])(customers(s, d), customers(s, d)).links
    return Links(x, c, c).with_left(segment="c_mktsegment").df.select("record_id_l", "record_id_r", "segment")


def deferred_links(s, d):
    near = joins.deferred(F.abs)(joins.left.c_acctbal - joins.right.c_acctbal) <= 20
    c = customers(s, d)
    return JoinLinker([joins.left.c_nationkey == joins.right["c_nationkey"], near], near=("c_acctbal", 20.0))(c, c).links


def union_table(s, d):
    a = t(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = t(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    u = UnionTable([a, b]).filter(lambda x: x.balance > 0).mutate(cents=lambda x: F.round(x.balance * 100).cast("long")).drop("balance").rename(country="nation")
    return u.select("key", "country", "cents").table()


def one_comparison(s, d):
    x = WEIGHTS.compare_one(_pairs(s, d), PRICE)
    return x.select("record_id_l", "record_id_r", "price_level", F.round("price_level_odds", 6).alias("odds"))


def labels_by_csv(s, d):
    """A table written as CSV in the layout of a published set of records and read back with its links."""
    at = temporary(s)
    r = once(t(s, d, "rldata_left"), "record_id", "label_true", "fname_c1", "fname_c2", "lname_c1", "lname_c2", "by_year", "bm", "bd").where("label_true is not null")
    r.write.option("header", True).csv(at)
    back = read_csv(s, at, "record_id long, label_true long, fname_c1 string, fname_c2 string, lname_c1 string, lname_c2 string, by_year long, bm long, bd long")
    return links_from_labels(back).select("record_id_l", "record_id_r")


_ALL = (deferred_links, union_table, one_comparison, labels_by_csv, name_blocks, email_addresses, email_blocks, phone_numbers, phone_matches, type_spellings, sparse_vectors, compare_and_score, level_probabilities, updates_of_structs, label_links, right_join, outer_join, any_inner_join, intersect_keys, key_pairs_total, top_values, chained_components, coordinate_pairs, minhash_links, text_classes, sample_pairs, sample_hash, linked_both_sides)
QUERIES = {f.__name__: f for f in _ALL}

_P = """p AS (SELECT a.p_partkey AS record_id_l, b.p_partkey AS record_id_r, CASE WHEN a.p_name = b.p_name THEN 0 WHEN left(a.p_name, 3) = left(b.p_name, 3) THEN 1 ELSE 2 END AS nl,
 CASE WHEN abs(a.p_retailprice - b.p_retailprice) < 1 THEN 0 WHEN abs(a.p_retailprice - b.p_retailprice) < 100 THEN 1 ELSE 2 END AS pl
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
o AS (SELECT *, CASE nl WHEN 0 THEN 0.8::DOUBLE / 0.02::DOUBLE WHEN 1 THEN 0.15::DOUBLE / 0.08::DOUBLE ELSE 0.05::DOUBLE / 0.9::DOUBLE END AS a, CASE pl WHEN 0 THEN 0.7::DOUBLE / 0.01::DOUBLE WHEN 1 THEN 0.2::DOUBLE / 0.19::DOUBLE ELSE 0.1::DOUBLE / 0.8::DOUBLE END AS b FROM p)"""
_N = "n AS (SELECT DISTINCT record_id, fname_c1, lname_c1, CAST(by_year AS VARCHAR) AS y, CAST(bm AS VARCHAR) AS bm FROM person_names WHERE record_id IS NOT NULL)"
_E = _N + """, u AS (SELECT record_id, regexp_extract(lower(x), '\\S+@\\S+') AS e FROM (SELECT record_id, unnest([' ' || regexp_replace(lname_c1, '\\s+', '_', 'g') || '.' || bm || '@Post.example ', 'see ' || regexp_replace(fname_c1, '\\s+', '', 'g') || '@farm.example']) AS x FROM n)),
e AS (SELECT DISTINCT record_id, replace(replace(e, '.', ''), '_', '') AS e FROM u WHERE e <> '')"""
_PH = _N + """, q AS (SELECT DISTINCT record_id, regexp_extract(regexp_replace(x, '\\D', '', 'g'), '1?(\\d{10})', 1) AS p FROM (SELECT record_id, unnest(['+1 (415) 555-' || y, '206 555 ' || y || ' x']) AS x FROM n)),
f AS (SELECT record_id, p FROM q WHERE p <> '' AND NOT regexp_matches(p, '0000|9999|12345'))"""
_FEW = "a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), b AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 7000)"
_DOCS = """t AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text), w AS (SELECT id, text, string_split(text, ' ') AS w FROM t),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g FROM w), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS l, b.id AS r, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
j AS (SELECT l, r, k / (x.n + y.n - k) AS jaccard FROM c JOIN n x ON x.id = l JOIN n y ON y.id = r WHERE k / (x.n + y.n - k) >= 0.8)"""
_WORD = "trim(regexp_replace(strip_accents(upper(unnest([name.prefix, name.given, name.middle, name.surname, name.suffix, name.nickname]))), '[^A-Z0-9]+', ' ', 'g'))"

SQL = {
    "deferred_links": "SELECT a.c_custkey AS record_id_l, b.c_custkey AS record_id_r FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND abs(a.c_acctbal - b.c_acctbal) <= 20 AND a.c_custkey < b.c_custkey",
    "union_table": "SELECT c_custkey AS key, c_nationkey AS country, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) FROM supplier WHERE s_acctbal > 0",
    "one_comparison": f"WITH {_P} SELECT record_id_l, record_id_r, CASE pl WHEN 0 THEN 'same' WHEN 1 THEN 'near' ELSE 'other' END AS price_level, round(b, 6) AS odds FROM o",
    "labels_by_csv": "WITH r AS (SELECT DISTINCT record_id, label_true FROM rldata_left WHERE label_true IS NOT NULL) SELECT a.record_id AS record_id_l, b.record_id AS record_id_r FROM r a JOIN r b ON a.label_true = b.label_true AND a.record_id < b.record_id",
    "name_blocks": f"WITH n AS (SELECT DISTINCT record_id, name FROM person_names WHERE by_year >= 1990 AND name IS NOT NULL), w AS (SELECT DISTINCT record_id, {_WORD} AS w FROM n) SELECT DISTINCT a.record_id AS record_id_l, b.record_id AS record_id_r FROM w a JOIN w b ON a.w = b.w AND a.w <> '' AND a.record_id < b.record_id",
    "email_addresses": f"WITH {_E} SELECT record_id, e AS full, split_part(e, '@', 1) AS user, split_part(e, '@', 2) AS domain FROM e",
    "email_blocks": f"WITH {_N}, u AS (SELECT record_id, regexp_extract(lower(' ' || regexp_replace(lname_c1, '\\s+', '_', 'g') || '.' || bm || '@Post.example '), '\\S+@\\S+') AS e FROM n), e AS (SELECT record_id, replace(replace(e, '.', ''), '_', '') AS e FROM u WHERE e <> '') SELECT DISTINCT a.record_id AS record_id_l, b.record_id AS record_id_r FROM e a JOIN e b ON a.e = b.e AND a.record_id < b.record_id",
    "phone_numbers": f"WITH {_PH} SELECT record_id, p AS phone FROM f",
    "phone_matches": f"""WITH {_PH}, k AS (SELECT DISTINCT record_id FROM n WHERE y IS NOT NULL), p AS (SELECT a.record_id AS l, b.record_id AS r FROM k a JOIN k b ON left(a.record_id, 9) = left(b.record_id, 9) AND a.record_id < b.record_id),
m AS (SELECT l, r, min(CASE WHEN x.p = z.p THEN 0 WHEN damerau_levenshtein(x.p, z.p) <= 1 THEN 1 ELSE 2 END) AS level FROM p JOIN f x ON x.record_id = l JOIN f z ON z.record_id = r GROUP BY ALL)
SELECT l AS record_id_l, r AS record_id_r, coalesce(level, 2) AS level FROM p LEFT JOIN m USING (l, r)""",
    "type_spellings": "WITH w AS (SELECT unnest(regexp_split_to_array(upper(street1), '[^A-Za-z]+')) AS w FROM addresses) SELECT CASE WHEN w IN ('STREET', 'ST') THEN 'ST' WHEN w IN ('AVENUE', 'AVE', 'AV') THEN 'AVE' WHEN w IN ('ROAD', 'RD') THEN 'RD' WHEN w IN ('LANE', 'LN') THEN 'LN' WHEN w IN ('DRIVE', 'DR') THEN 'DR' ELSE 'CT' END AS type, count(*) AS n FROM w WHERE w IN ('STREET', 'ST', 'AVENUE', 'AVE', 'AV', 'ROAD', 'RD', 'LANE', 'LN', 'DRIVE', 'DR', 'COURT', 'CT') GROUP BY 1",
    "sparse_vectors": """WITH e AS (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS w FROM part), c AS (SELECT p_partkey AS k, p_brand AS b, w, (count(*) + length(w))::DOUBLE AS v FROM e GROUP BY p_partkey, p_brand, w),
n AS (SELECT k, b, sqrt(sum(v * v)) AS n FROM c GROUP BY k, b), s AS (SELECT x.k AS l, y.k AS r, sum(x.v * y.v) AS d, sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v)) AS lengths FROM c x JOIN c y ON x.b = y.b AND x.w = y.w AND x.k < y.k GROUP BY x.k, y.k)
SELECT x.k AS l, y.k AS r, round(coalesce(d, 0), 6) AS dot, round(d / lengths, 6) AS cosine, round(coalesce(d, 0), 6) AS product, round(x.n, 6) AS norm FROM n x JOIN n y ON x.b = y.b AND x.k < y.k LEFT JOIN s ON s.l = x.k AND s.r = y.k""",
    "compare_and_score": f"WITH {_P} SELECT record_id_l, record_id_r, round(a * b, 6) AS odds FROM o",
    "level_probabilities": f"WITH {_P} SELECT record_id_l, record_id_r, round(a / (1 + a), 9) AS probability, round(log10(a), 6) AS log_odds FROM o",
    "updates_of_structs": "SELECT o_orderkey, o_orderstatus AS status_before, 'Z' AS status_after FROM orders WHERE o_orderkey % 6 = 0 AND o_orderstatus <> 'Z'",
    "label_links": "WITH r AS (SELECT DISTINCT record_id, label_true FROM rldata_right WHERE label_true IS NOT NULL) SELECT a.record_id AS record_id_l, b.record_id AS record_id_r FROM r a JOIN r b ON a.label_true = b.label_true AND a.record_id < b.record_id",
    "right_join": f"WITH {_FEW} SELECT * FROM a RIGHT JOIN b ON c_custkey = s_suppkey",
    "outer_join": f"WITH {_FEW} SELECT * FROM a FULL JOIN b ON c_custkey = s_suppkey",
    "any_inner_join": "SELECT c_custkey, c_custkey AS o_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "intersect_keys": "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "key_pairs_total": "WITH k AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n FROM k",
    "top_values": "WITH c AS (SELECT l_quantity::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS rank FROM c ORDER BY n DESC, value LIMIT 7",
    "chained_components": """WITH x AS (SELECT p_partkey AS k, p_brand AS b, coalesce(p_partkey - lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) > 60, true) AS begins FROM part), y AS (SELECT *, sum(begins::INT) OVER (PARTITION BY b ORDER BY k) AS run FROM x),
z AS (SELECT k, min(k) OVER (PARTITION BY b, run) AS component, count(*) OVER (PARTITION BY b, run) AS n FROM y) SELECT k AS record_id, component FROM z WHERE n > 1""",
    "coordinate_pairs": """WITH p AS (SELECT DISTINCT record_id, lat, lon FROM coordinates WHERE record_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND NOT isnan(lat) AND lon IS NOT NULL AND NOT isnan(lon)),
g AS (SELECT record_id, CAST(floor(lat / (0.30000000000000004 / (pi() * 6371.0 / 180))) AS BIGINT) AS a, floor(lon / (0.30000000000000004 / ((pi() * 6371.0 / 180) * cos(radians(lat))))) AS b FROM p)
SELECT x.record_id AS record_id_l, y.record_id AS record_id_r FROM g x JOIN g y ON x.a = y.a AND x.b = y.b AND x.record_id < y.record_id""",
    "minhash_links": f"WITH {_DOCS} SELECT l AS record_id_l, r AS record_id_r, round(jaccard, 6) AS jaccard FROM j",
    "text_classes": f"""WITH RECURSIVE {_DOCS}, e AS (SELECT l AS a, r AS b FROM j UNION ALL SELECT r, l FROM j),
reach(id, root) USING KEY (id) AS (SELECT id, id FROM t UNION SELECT e.b, min(r.root) FROM reach r JOIN e ON e.a = r.id JOIN recurring.reach old ON old.id = e.b WHERE r.root < old.root GROUP BY e.b)
SELECT doc_id, root AS class_id FROM documents JOIN t USING (text) JOIN reach USING (id)""",
    "sample_pairs": "SELECT CAST(10000 AS BIGINT) AS n, CAST(10000 AS BIGINT) AS different, CAST(10000 AS BIGINT) AS known",
    "sample_hash": "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS different",
    "linked_both_sides": "SELECT a.c_custkey AS record_id_l, b.c_custkey AS record_id_r, a.c_mktsegment AS segment FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey",
}
