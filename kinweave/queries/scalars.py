"""Queries of the functions of texts, arrays, sets, vectors and structs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import arrays, contacts, names, sets, structs, text, vectors
from kinweave.functions.streets import address_features, address_level, parse_street1
from kinweave.operators.spatial import haversine_km
from kinweave.operators.within import pairs_within
from kinweave.queries.linkage import t


def tokens(s, d):
    p = t(s, d, "part").select("p_partkey", text.tokenize(F.col("p_name")).alias("words"))
    return p.select("p_partkey", F.array_join("words", "|").alias("words"), F.size("words").cast("long").alias("n_words"))


def ngram_counts(s, d):
    p = t(s, d, "part").select(F.explode(text.ngrams(F.col("p_name"), 3)).alias("gram"))
    return p.groupBy("gram").agg(F.count("*").alias("n"))


def whitespace(s, d):
    a = t(s, d, "addresses")
    return a.select("record_id", text.norm_whitespace(F.col("street1")).alias("street1")).distinct()


def accents(s, d):
    return t(s, d, "person_names").select("record_id", text.strip_accents(F.col("lname_c1")).alias("surname")).distinct()


def _name_pairs(s, d):
    n = t(s, d, "part").select(F.col("p_name").alias("a")).distinct()
    return n.join(n.select(F.col("a").alias("b")), F.substring("a", 1, 1) == F.substring("b", 1, 1))


def edit_ratios(s, d):
    x, y = F.col("a"), F.col("b")
    return _name_pairs(s, d).select("a", "b", F.levenshtein(x, y).cast("long").alias("edits"), F.round(text.levenshtein_ratio(x, y), 6).alias("ratio"))


def damerau_ratios(s, d):
    x, y = F.col("a"), F.col("b")
    return _name_pairs(s, d).select("a", "b", text.damerau_levenshtein(x, y).cast("long").alias("edits"), F.round(text.damerau_levenshtein_ratio(x, y), 6).alias("ratio"))


def jaro_similarities(s, d):
    x, y = F.col("a"), F.col("b")
    return _name_pairs(s, d).select("a", "b", F.round(text.jaro_similarity(x, y), 6).alias("jaro"), F.round(text.jaro_winkler_similarity(x, y), 6).alias("jaro_winkler"))


def sounds(s, d):
    n = t(s, d, "part").select("p_name").distinct()
    return n.select("p_name", F.array_join(text.double_metaphone(F.col("p_name")), ",").alias("codes"))


def regex_struct(s, d):
    c = t(s, d, "customer").select("c_custkey", text.re_extract_struct(F.col("c_name"), r"(?P<word>[A-Za-z]+)#(?P<number>\d+)").alias("x"))
    return c.select("c_custkey", "x.word", "x.number")


def emails(s, d):
    docs = t(s, d, "documents")
    e = docs.select("doc_id", contacts.parsed_email(contacts.clean_email(F.col("text"))).alias("e"))
    return e.select("doc_id", F.col("e.full").alias("full"), F.col("e.user").alias("user"), F.col("e.domain").alias("domain"))


def phones(s, d):
    c = t(s, d, "customer").select("c_custkey", F.concat(F.lit("+1 (907) "), F.lpad(F.col("c_custkey").cast("string"), 3, "2"), F.lit("-"), F.lpad((F.col("c_custkey") * 37 % 10000).cast("string"), 4, "3")).alias("typed"))
    return c.select("c_custkey", contacts.clean_phone_number(F.col("typed")).alias("phone"))


def phone_levels(s, d):
    p = phones(s, d)
    a, b = p.toDF("l", "pl"), p.toDF("r", "pr")
    m = a.join(b, (F.col("r") == F.col("l") + 1) & F.col("pl").isNotNull() & F.col("pr").isNotNull())
    return m.select("l", "r", contacts.phone_level(F.col("pl"), F.col("pr")).alias("level"))


def email_levels(s, d):
    n = t(s, d, "part").select(F.concat(F.col("p_name"), F.lit("@shop.test")).alias("e")).distinct()
    n = n.select(F.translate(F.lower("e"), " ", ".").alias("e"))
    a, b = n.toDF("a"), n.toDF("b")
    m = a.join(b, F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return m.select("a", "b", contacts.email_level(contacts.parsed_email(F.col("a")), contacts.parsed_email(F.col("b"))).alias("level"))


def _quantities(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q")).alias("x"))
    return li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["q"]).alias("q"))


def array_stats(s, d):
    q = F.col("q")
    return _quantities(s, d).select(
        "l_orderkey",
        arrays.array_min(q).alias("least"),
        arrays.array_max(q).alias("most"),
        F.round(arrays.array_sum(q), 6).alias("total"),
        F.round(arrays.array_mean(q), 6).alias("mean"),
        F.round(arrays.array_median(q), 6).alias("median"),
        arrays.array_any(F.transform(q, lambda v: v > 40)).alias("any_large"),
        arrays.array_all(F.transform(q, lambda v: v > 10)).alias("all_large"),
    )


def array_combinations_n(s, d):
    q = _quantities(s, d)
    pairs = F.transform(arrays.array_combinations(F.col("q"), F.col("q")), lambda x: F.concat_ws(":", F.coalesce(x["l"].cast("int").cast("string"), F.lit("-")), F.coalesce(x["r"].cast("int").cast("string"), F.lit("-"))))
    return q.select("l_orderkey", F.size(pairs).cast("long").alias("n"), F.array_join(F.array_sort(pairs), " ").alias("pairs"))


def array_sorted(s, d):
    q = _quantities(s, d).select("l_orderkey", F.filter("q", lambda v: v.isNotNull()).alias("q"))
    return q.select("l_orderkey", F.array_join(F.transform(arrays.array_sort(F.col("q"), lambda v: -v), lambda v: v.cast("int").cast("string")), ",").alias("down"), F.array_join(F.transform(arrays.list_select(F.col("q"), arrays.list_grade_up(F.col("q"))), lambda v: v.cast("int").cast("string")), ",").alias("up"))


def array_isin_other(s, d):
    r = t(s, d, "record_terms").groupBy("record_id").agg(F.max("terms").alias("terms"))
    known = t(s, d, "document_counts").select("term")
    out = arrays.array_filter_isin_other(r, "terms", known, "term")
    return out.select("record_id", F.array_join("terms_filtered", "|").alias("kept"))


def _word_sets(s, d):
    return t(s, d, "part").select("p_partkey", F.array_distinct(text.tokenize(F.col("p_name"))).alias("words"), "p_brand", "p_size")


def jaccards(s, d):
    m = pairs_within(_word_sets(s, d), "p_partkey", ["p_brand", "p_size"], ["words"], lambda a, b: {"jaccard": F.round(sets.jaccard(a("words"), b("words")), 6)})
    return m.select(F.col("p_partkey_l").alias("l"), F.col("p_partkey_r").alias("r"), "jaccard")


def document_frequencies(s, d):
    return sets.document_counts(_word_sets(s, d), "words")


def idfs(s, d):
    return sets.term_idf(_word_sets(s, d), "words").select("term", F.round("idf", 6).alias("idf"))


def _terms(s, d):
    return t(s, d, "record_terms").groupBy("record_id").agg(F.max("terms").alias("terms"))


def value_counts(s, d):
    c = sets.add_array_value_counts(_terms(s, d), "terms")
    return c.select("record_id", F.explode("terms_counts").alias("term", "n"))


def tfidf(s, d):
    x = sets.add_tfidf(_terms(s, d), "terms", id="record_id")
    return x.select("record_id", F.explode("terms_tfidf").alias("term", "w")).select("record_id", "term", F.round("w", 6).alias("w"))


def rare(s, d):
    return sets.rare_terms(_terms(s, d), "terms", max_records_n=3)


def norms(s, d):
    e = t(s, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", F.round(vectors.norm(v), 5).alias("l2"), F.round(vectors.norm(v, "l1"), 4).alias("l1"), F.round(vectors.norm(vectors.normalize(v)), 6).alias("unit"))


def cosines(s, d):
    e = t(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    m = e.join(n, "vec_id")
    return m.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("w")), 4).alias("dot"), F.round(vectors.cosine_similarity(F.col("v"), F.col("w")), 5).alias("cosine"), F.round(arrays.array_sum(vectors.mul(F.col("v"), F.col("w"))), 4).alias("product"))


def struct_fields(s, d):
    n = t(s, d, "person_names").groupBy("record_id").agg(F.max(F.struct("name", "fname_c1", "lname_c1")).alias("n")).select("record_id", "n.*")
    x, y = F.col("name"), F.struct(F.col("fname_c1").alias("given"), F.col("lname_c1").alias("surname"))
    return n.select("record_id", structs.isnull(x, ["given", "surname"], "any").alias("any_null"), structs.isnull(x, ["given", "surname"], "all").alias("all_null"), structs.equal(x, y, ["given", "surname"]).alias("equal"), structs.rename(structs.select(x, "given"), ["given"], first="given")["first"].alias("first"))


def name_forms(s, d):
    n = t(s, d, "person_names").groupBy("record_id").agg(F.max("name").alias("name"))
    x = names.normalize_name(F.col("name"))
    return n.select("record_id", x["given"].alias("given"), x["surname"].alias("surname"), F.array_join(F.array_sort(names.name_tokens(x)), " ").alias("words"))


def name_levels(s, d):
    n = t(s, d, "person_names").groupBy("record_id").agg(F.max("name").alias("name"), F.max("by_year").alias("y"), F.max("bm").alias("m"), F.max("bd").alias("bd")).where("name is not null")
    n = n.select("record_id", names.normalize_name(F.col("name")).alias("n"), "y", "m", "bd")
    a, b = n.toDF("l", "nl", "y", "m", "bd"), n.toDF("r", "nr", "y", "m", "bd")
    return a.join(b, ["y", "m", "bd"]).where("l < r").select("l", "r", names.name_level(F.col("nl"), F.col("nr")).alias("level"))


def street_parts(s, d):
    a = t(s, d, "addresses").select("record_id", "street1").distinct()
    p = a.select("record_id", "street1", parse_street1(F.col("street1")).alias("p"))
    return p.select("record_id", "street1", "p.*")


def address_levels(s, d):
    a = t(s, d, "addresses").groupBy("record_id").agg(F.max(F.struct("street1", "street2", "city", "state", "postal_code", "country")).alias("a"))
    f = address_features(a, "a").select("record_id", "features")
    near = f.where(F.col("features.street_number").isNotNull() & F.col("features.postal_code").isNotNull())
    x, y = near.toDF("l", "fl"), near.toDF("r", "fr")
    m = x.join(y, (F.col("fl.street_number") == F.col("fr.street_number")) & (F.col("fl.postal_code") == F.col("fr.postal_code"))).where("l < r")
    return m.select("l", "r", address_level(F.col("fl"), F.col("fr")).alias("level"))


def distances(s, d):
    c = t(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 180 - 90.0).alias("lat"), (F.col("c_custkey") * 7 % 360 - 180.0).alias("lon"))
    return c.select("c_custkey", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0)), 6).alias("km"))


_ALL = (tokens, ngram_counts, whitespace, accents, edit_ratios, damerau_ratios, jaro_similarities, sounds, regex_struct, emails, phones, phone_levels, email_levels, array_stats, array_combinations_n, array_sorted, array_isin_other, jaccards, document_frequencies, idfs, value_counts, tfidf, rare, norms, cosines, struct_fields, name_forms, name_levels, street_parts, address_levels, distances)
QUERIES = {f.__name__: f for f in _ALL}

_PAIRS = "n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON left(x.p_name, 1) = left(y.p_name, 1))"
_Q = "q AS (SELECT l_orderkey, list(CASE WHEN l_linenumber <> 2 THEN l_quantity END ORDER BY l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_quantity END NULLS FIRST) AS q FROM lineitem GROUP BY 1)"
_TERMS = "r AS (SELECT record_id, max(terms) AS terms FROM record_terms GROUP BY 1)"
_PHONE = "p AS (SELECT c_custkey, '907' || CASE WHEN length(c_custkey::VARCHAR) >= 3 THEN left(c_custkey::VARCHAR, 3) ELSE lpad(c_custkey::VARCHAR, 3, '2') END || lpad((c_custkey * 37 % 10000)::VARCHAR, 4, '3') AS raw FROM customer), f AS (SELECT c_custkey, CASE WHEN NOT regexp_matches(raw, '0000|9999|12345') THEN raw END AS phone FROM p)"
_NORM = "btrim_(regexp_replace(strip_accents(upper({0})), '[^A-Z0-9]+', ' ', 'g'))"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(upper({x})), '[^A-Z0-9]+', ' ', 'g'))"


SQL = {
    "tokens": "SELECT p_partkey, array_to_string(regexp_split_to_array(trim(p_name), '\\s+'), '|') AS words, CAST(len(regexp_split_to_array(trim(p_name), '\\s+')) AS BIGINT) AS n_words FROM part",
    "ngram_counts": "WITH g AS (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3))) AS gram FROM part WHERE length(p_name) >= 3) SELECT gram, count(*) AS n FROM g GROUP BY 1",
    "whitespace": "SELECT DISTINCT record_id, trim(regexp_replace(street1, '\\s+', ' ', 'g')) AS street1 FROM addresses",
    "accents": "SELECT DISTINCT record_id, strip_accents(lname_c1) AS surname FROM person_names",
    "edit_ratios": f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b) AS edits, round((greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)), 6) AS ratio FROM p",
    "damerau_ratios": f"WITH {_PAIRS} SELECT a, b, damerau_levenshtein(a, b) AS edits, round((greatest(length(a), length(b)) - damerau_levenshtein(a, b)) / greatest(length(a), length(b)), 6) AS ratio FROM p",
    "jaro_similarities": f"WITH {_PAIRS} SELECT a, b, round(jaro_similarity(a, b), 6) AS jaro, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM p",
    "regex_struct": "SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#(\\d+)', 1) AS word, regexp_extract(c_name, '([A-Za-z]+)#(\\d+)', 2) AS number FROM customer",
    "emails": "WITH e AS (SELECT doc_id, nullif(regexp_extract(lower(text), '\\S+@\\S+'), '') AS e FROM documents) SELECT doc_id, e AS full, nullif(split_part(e, '@', 1), '') AS user, nullif(split_part(e, '@', 2), '') AS domain FROM e",
    "phones": f"WITH {_PHONE} SELECT c_custkey, phone FROM f",
    "phone_levels": f"WITH {_PHONE} SELECT a.c_custkey AS l, b.c_custkey AS r, CASE WHEN a.phone = b.phone THEN 0 WHEN damerau_levenshtein(a.phone, b.phone) <= 1 THEN 1 ELSE 2 END AS level FROM f a JOIN f b ON b.c_custkey = a.c_custkey + 1 WHERE a.phone IS NOT NULL AND b.phone IS NOT NULL",
    "email_levels": """WITH n AS (SELECT DISTINCT replace(lower(p_name), ' ', '.') AS u FROM part), p AS (SELECT x.u AS x, y.u AS y FROM n x JOIN n y ON left(x.u, 1) = left(y.u, 1))
SELECT x || '@shop.test' AS a, y || '@shop.test' AS b, CASE WHEN x = y THEN 0 WHEN damerau_levenshtein(x, y) <= 1 THEN 1 ELSE 4 END AS level FROM p""",
    "array_stats": f"WITH {_Q} SELECT l_orderkey, list_min(q) AS least, list_max(q) AS most, round(list_sum(q), 6) AS total, round(list_avg(q), 6) AS mean, round(list_median(q), 6) AS median, list_bool_or(list_transform(q, lambda v: v > 40)) AS any_large, list_bool_and(list_transform(q, lambda v: v > 10)) AS all_large FROM q",
    "array_combinations_n": f"""WITH {_Q}, v AS (SELECT l_orderkey, list_transform(q, lambda x: coalesce(CAST(CAST(x AS INTEGER) AS VARCHAR), '-')) AS q FROM q)
SELECT l_orderkey, CAST(len(q) * len(q) AS BIGINT) AS n, array_to_string(list_sort(flatten(list_transform(q, lambda x: list_transform(q, lambda y: x || ':' || y)))), ' ') AS pairs FROM v""",
    "array_sorted": f"WITH {_Q}, f AS (SELECT l_orderkey, list_transform(list_filter(q, lambda v: v IS NOT NULL), lambda v: CAST(v AS INTEGER)) AS q FROM q) SELECT l_orderkey, array_to_string(list_reverse_sort(q), ',') AS down, array_to_string(list_sort(q), ',') AS up FROM f",
    "array_isin_other": f"""WITH {_TERMS}, k AS (SELECT DISTINCT term FROM document_counts WHERE term IS NOT NULL), e AS (SELECT record_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM r),
x AS (SELECT record_id, string_agg(term, '|' ORDER BY pos) AS kept FROM e JOIN k USING (term) GROUP BY 1)
SELECT record_id, CASE WHEN terms IS NOT NULL THEN coalesce(kept, '') END AS kept FROM r LEFT JOIN x USING (record_id)""",
    "jaccards": """WITH w AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(p_name, ' ')) AS w FROM part)
SELECT a.p_partkey AS l, b.p_partkey AS r, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""",
    "document_frequencies": "WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS term FROM part) SELECT term, count(*) AS n_records FROM w GROUP BY 1",
    "idfs": "WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS term FROM part) SELECT term, round(ln((SELECT count(*) FROM part) / count(*)), 6) AS idf FROM w GROUP BY 1",
    "value_counts": f"WITH {_TERMS}, e AS (SELECT record_id, unnest(terms) AS term FROM r) SELECT record_id, term, count(*) AS n FROM e WHERE term IS NOT NULL GROUP BY ALL",
    "tfidf": f"""WITH {_TERMS}, e AS (SELECT record_id, unnest(terms) AS term FROM r), c AS (SELECT record_id, term, count(*) AS n FROM e WHERE term IS NOT NULL GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), l AS (SELECT record_id, sqrt(sum(n * n)) AS length FROM c GROUP BY 1), m AS (SELECT count(*) AS n_all FROM r WHERE terms IS NOT NULL)
SELECT record_id, term, round(n / length * ln(n_all / df), 6) AS w FROM c JOIN f USING (term) JOIN l USING (record_id), m""",
    "rare": f"WITH {_TERMS}, e AS (SELECT DISTINCT record_id, unnest(terms) AS term FROM r) SELECT term FROM e WHERE term IS NOT NULL GROUP BY 1 HAVING count(*) <= 3",
    "norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS l2, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS l1, 1.0::DOUBLE AS unit FROM embeddings",
    "cosines": """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS v, list_transform(b.embedding, lambda x: x::DOUBLE) AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(v, w), 4) AS dot, round(list_cosine_similarity(v, w), 5) AS cosine, round(list_dot_product(v, w), 4) AS product FROM p""",
    "struct_fields": "WITH n AS (SELECT record_id, any_value(name) AS name, any_value(fname_c1) AS f, any_value(lname_c1) AS l FROM person_names GROUP BY 1) SELECT record_id, name.given IS NULL OR name.surname IS NULL AS any_null, name.given IS NULL AND name.surname IS NULL AS all_null, name.given = f AND name.surname = l AS equal, name.given AS first FROM n",
    "name_forms": f"""WITH n AS (SELECT record_id, max(name) AS name FROM person_names GROUP BY 1)
SELECT record_id, {_norm('name.given')} AS given, {_norm('name.surname')} AS surname, CASE WHEN name IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws(' ', {', '.join(_norm('name.' + p) for p in names.PARTS)}), ' '), lambda w: w <> ''))), ' ') END AS words FROM n""",
    "distances": "WITH c AS (SELECT c_custkey, c_custkey % 180 - 90.0::DOUBLE AS lat, c_custkey * 7 % 360 - 180.0::DOUBLE AS lon FROM customer) SELECT c_custkey, round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(0)) * pow(sin(radians(0 - lon) / 2), 2)))), 6) AS km FROM c",
}
