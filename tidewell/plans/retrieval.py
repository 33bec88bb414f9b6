"""Retrieval queries: vectors, trigrams, fusion, boosts, the keyword index, caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import dictionary as D
from tidewell.functions import text as X
from tidewell.operators import relational as R
from tidewell.operators import retrieval as V
from tidewell.operators import text_rank as T
from tidewell.operators import vector_index as I
from tidewell.plans.registry import query, table
from tidewell.streaming import stores

_KNN = """q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
k AS (SELECT query, vec_id AS doc, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM k QUALIFY rank <= 10)"""


def nearest(spark, d, k=10):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    return V.knn(q, e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("dv")), k, "query", "qv", "doc", "dv")


@query("v01_cosine_top_k", f"WITH {_KNN} SELECT query, doc, rank, round(score, 6) AS score FROM r")
def v01(spark, d):
    return nearest(spark, d).select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def cells(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return I.build(e, "vec_id", "embedding"), e.filter("vec_id % 50 = 0")


@query("v02_cell_index", f"WITH {_KNN} SELECT query, doc, rank, round(score, 6) AS score FROM r")
def v02(spark, d):
    """The index in exact mode: near cells first, then those that a bound does not rule out."""
    index, q = cells(spark, d)
    return I.search(index, q, 10, "vec_id", "embedding", exact=True).select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("v02_cell_probes")
def v02_probes(spark, d):
    """The index with as many probes as other queries need, and the recall of each query's ten against all vectors."""
    index, q = cells(spark, d)
    probes = I.probes_for(index, table(spark, d, "embeddings").filter("vec_id % 50 = 25"), 10, "vec_id", "embedding")
    found = I.search(index, q, 10, "vec_id", "embedding", probes=probes)
    return I.recall(found, nearest(spark, d))


@query("v03_cosine_scalar", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v03(spark, d):
    e = table(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("v04_two_stage_lexical", """WITH c AS (SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'ring') ORDER BY p_partkey LIMIT 20)
SELECT p_partkey, CAST(contains(lower(p_type), 'promo') AS INT) + 2 AS score FROM c WHERE p_type IN ('PROMO', 'ECONOMY')""")
def v04(spark, d):
    c = table(spark, d, "part").filter(F.col("p_name").contains("ring")).orderBy("p_partkey").limit(20)
    return c.filter(F.col("p_type").isin("PROMO", "ECONOMY")).select("p_partkey", (F.contains(F.lower("p_type"), F.lit("promo")).cast("int") + 2).alias("score"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("v05_trigram_similarity", f"""WITH t AS (SELECT p_partkey, {_TRI.format("p_name")} AS a, {_TRI.format("'small rings'")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM t WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.3""")
def v05(spark, d):
    return table(spark, d, "part").select("p_partkey", V.jaccard(V.trigrams(F.col("p_name")), V.trigrams(F.lit("small rings"))).alias("score")).filter("score > 0.3").withColumn("score", F.round("score", 6))


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+'))"


@query("v06_text_and_vector", f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
t AS (SELECT doc_id, len(list_intersect({_WORDS.format("text")}, ['the', 'and', 'that'])) / 3.0 AS t, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS v FROM documents JOIN embeddings ON vec_id = doc_id, q)
SELECT doc_id, round(0.8 * v + 0.2 * t, 6) AS score FROM t WHERE t > 0""")
def v06(spark, d):
    """Vector similarity to a query's embedding and coverage of its terms, combined, for documents with any of them."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id = 0").select(F.col("embedding").alias("qv"))
    covered = F.size(F.array_intersect(V.words(F.col("text")), F.array(*map(F.lit, ("the", "and", "that"))))) / 3.0
    t = table(spark, d, "documents").select("doc_id", covered.alias("t")).filter("t > 0").join(e, "doc_id").crossJoin(F.broadcast(q))
    return t.select("doc_id", F.round(0.8 * V.cosine(F.col("qv"), F.col("embedding")) + 0.2 * F.col("t"), 6).alias("score"))


_SEQ = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("v06_cover_density", f"""WITH w AS (SELECT doc_id AS doc, {_SEQ.format("text")} AS w, source FROM documents),
q AS (SELECT doc AS query, source, list_distinct(w[1:3]) AS terms FROM w WHERE doc % 50 = 0),
p AS (SELECT doc, unnest(range(len(w))) AS place, unnest(w) AS term FROM w),
t AS (SELECT query, terms, len(terms) AS m, unnest(terms) AS term FROM q),
u AS (SELECT query, m, term, row_number() OVER (PARTITION BY query ORDER BY term) AS t FROM t),
h AS (SELECT query, m, t, doc, place, row_number() OVER (PARTITION BY query, doc ORDER BY place) - 1 AS i FROM u JOIN p USING (term) WHERE doc <> query),
l AS (SELECT *, last_value(CASE WHEN t = 1 THEN i END IGNORE NULLS) OVER z AS a, last_value(CASE WHEN t = 2 THEN i END IGNORE NULLS) OVER z AS b, last_value(CASE WHEN t = 3 THEN i END IGNORE NULLS) OVER z AS c FROM h WINDOW z AS (PARTITION BY query, doc ORDER BY i)),
b AS (SELECT *, CASE m WHEN 1 THEN a WHEN 2 THEN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END ELSE CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN least(a, b, c) END END AS s FROM l),
n AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY query, doc ORDER BY i), -1) AS s0 FROM b),
k AS (SELECT n.query, n.doc, sum(0.1 / (1 + (n.place - o.place) - (n.i - n.s))) AS rank FROM n JOIN h o ON o.query = n.query AND o.doc = n.doc AND o.i = n.s WHERE n.s > n.s0 GROUP BY n.query, n.doc),
v AS (SELECT doc, source, CAST(embedding AS DOUBLE[]) AS v FROM w LEFT JOIN embeddings ON vec_id = doc),
f AS (SELECT q.query, v.doc, q.source = v.source AS inside, coalesce(k.rank, 0) AS t, coalesce(CASE WHEN list_dot_product(v.v, v.v) = 0 OR list_dot_product(x.v, x.v) = 0 THEN 0 ELSE list_cosine_similarity(x.v, v.v) END, 0) AS c, k.rank IS NOT NULL OR (v.v IS NOT NULL AND x.v IS NOT NULL) AS found
  FROM q JOIN v x ON x.doc = q.query JOIN v ON v.doc <> q.query LEFT JOIN k ON k.query = q.query AND k.doc = v.doc),
g AS (SELECT *, bool_or(inside) OVER (PARTITION BY query) AS near FROM f WHERE found),
s AS (SELECT query, doc, t, 0.8 * c + 0.2 * least(t, 1) AS score FROM g WHERE inside OR NOT near),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
SELECT query, doc, round(t, 6) AS text, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def v06_cover(spark, d):
    """Text rank by cover density and vector similarity over all documents; a query is the first three words of a document, in its source."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = docs.join(e, "doc_id", "left")
    queries = both.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.array_distinct(F.slice(D.words(F.col("text")), 1, 3)).alias("terms"), F.col("embedding").alias("vector"), F.col("source").alias("category"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("category"))
    out = T.scan_combined(queries, texts, e.select(F.col("doc_id").alias("doc"), F.col("embedding").alias("vector")), 10)
    return out.select("query", "doc", F.round("text", 6).alias("text"), F.round("score", 6).alias("score"), "rank")


@query("v07_rank_fusion", """WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 30), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 30)
SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.7 / (60 + a.rank), 0) + coalesce(0.3 / (60 + b.rank), 0), 8) AS score FROM a FULL JOIN b ON a.id = b.id""")
def v07(spark, d):
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    top = lambda c: R.ranked(p.orderBy(F.desc(c), "id").limit(30), [F.desc(c), "id"])
    return V.reciprocal_rank_fusion({"price": (top("p_retailprice"), 0.7), "size": (top("p_size"), 0.3)}, ["id"]).withColumn("score", F.round("score", 8))


@query("v09_rule_boosts", "SELECT p_partkey, round(p_size / 50.0 + CASE WHEN p_type = 'PROMO' THEN 0.3 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 0.2 ELSE 0 END + CASE WHEN p_brand = 'Brand#2' THEN -0.5 ELSE 0 END, 6) AS score FROM part")
def v09(spark, d):
    rules = [(F.col("p_type") == "PROMO", 0.3), (F.col("p_name").contains("red"), 0.2), (F.col("p_brand") == "Brand#2", -0.5)]
    return table(spark, d, "part").select("p_partkey", F.round(V.boosted(F.col("p_size") / 50.0, rules), 6).alias("score"))


@query("v10_best_by_title", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY length(p_type) DESC, p_retailprice DESC, p_partkey) = 1")
def v10(spark, d):
    return V.best_by_title(table(spark, d, "part"), "p_name", "p_type", "p_retailprice", "p_partkey").select("p_name", "p_partkey")


@query("v11_noise_filter", "SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 60 AND role <> ''")
def v11(spark, d):
    return table(spark, d, "conversations").filter((F.length(F.trim("text")) >= 60) & (F.col("role") != "")).select("conv_id", "turn")


@query("v12_multi_source", f"""WITH a AS (SELECT 'documents' AS origin, doc_id AS id, {_WORDS.format("text")} AS w FROM documents UNION ALL SELECT 'benchmark', item_id, {_WORDS.format("text")} FROM benchmark),
s AS (SELECT origin, id, round(len(list_intersect(w, ['the', 'and', 'that'])) / sqrt(len(w)), 6) AS score FROM a WHERE len(list_intersect(w, ['the', 'and', 'that'])) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY score DESC, id) AS r FROM s)
SELECT origin, id, score, row_number() OVER (ORDER BY score DESC, origin, id) AS rank FROM k WHERE r <= 8 ORDER BY rank LIMIT 10""")
def v12(spark, d):
    """Two sources at most are asked; each gives its best, and one score ranks all of them together."""
    terms = F.array(*map(F.lit, ("the", "and", "that")))

    def best(name, id_col):
        w = table(spark, d, name).select(F.col(id_col).alias("id"), V.words(F.col("text")).alias("w"))
        hits = F.size(F.array_intersect("w", terms))
        return w.filter(hits > 0).select("id", F.round(hits / F.sqrt(F.size("w")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(8)

    sources = dict(list({"documents": "doc_id", "benchmark": "item_id"}.items())[:2])
    order = [F.desc("score"), "origin", "id"]
    return R.ranked(R.union_sources({n: best(n, i) for n, i in sources.items()}).orderBy(*order).limit(10), order).select("origin", "id", "score", "rank")


@query("v13_stop_after_lexical", f"WITH {_KNN} SELECT query, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) >= 0.02 AS enough FROM r GROUP BY query")
def v13(spark, d):
    s = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    return nearest(spark, d, 2).groupBy("query").agg((s(1) - s(2) >= 0.02).alias("enough"))


@query("v14_pins", f"WITH {_KNN} SELECT query, doc, pos FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY pin, rank) AS pos FROM (SELECT query, doc, 1 AS pin, rank FROM r WHERE doc NOT IN (400, 401) UNION ALL SELECT query, id, 0, id FROM q, (VALUES (400), (401)) v(id))) WHERE pos <= 5")
def v14(spark, d):
    pins = spark.createDataFrame([(400,), (401,)], "doc long")
    near = nearest(spark, d)
    put = near.select("query").distinct().crossJoin(F.broadcast(pins)).select("query", "doc", F.lit(0).alias("pin"), F.col("doc").alias("rank"))
    rest = near.join(F.broadcast(pins), "doc", "left_anti").select("query", "doc", F.lit(1).alias("pin"), F.col("rank").cast("long").alias("rank"))
    return R.top_per_group(put.unionByName(rest), ["query"], ["pin", "rank"], 5, "pos").select("query", "doc", F.col("pos").cast("long").alias("pos"))


_INDEX = """ix AS (SELECT term, doc, max(rel) AS relevance FROM (SELECT p_partkey AS doc, unnest(string_split(p_name, ' ')) AS term, 0.7 AS rel FROM part
UNION ALL SELECT p_partkey, lower(p_type), 1.0 FROM part UNION ALL SELECT p_partkey, lower(p_brand), 0.5 FROM part) GROUP BY ALL)"""


def part_index(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "doc")
    of = lambda c: p.select("doc", F.array(F.lower(c)).alias("terms"))
    return V.inverted_index([(p.select("doc", F.split("p_name", " ").alias("terms")), 0.7), (of("p_type"), 1.0), (of("p_brand"), 0.5)])


@query("v15_inverted_index", f"WITH {_INDEX} SELECT term, doc, CAST(relevance AS DOUBLE) AS relevance FROM ix")
def v15(spark, d):
    return part_index(spark, d)


_TERMS = "t(query, term) AS (VALUES (1, 'red'), (1, 'promo'), (2, 'ring'), (2, 'brand#2'), (2, 'small'), (3, 'red'), (3, 'nowhere'))"


def term_lists(spark):
    return spark.createDataFrame([(1, "red"), (1, "promo"), (2, "ring"), (2, "brand#2"), (2, "small"), (3, "red"), (3, "nowhere")], "query int, term string")


@query("v16_index_lookup", f"""WITH {_INDEX}, {_TERMS}, h AS (SELECT query, doc, count(*) AS hits, avg(relevance) AS score FROM t JOIN ix USING (term) GROUP BY ALL),
w AS (SELECT h.*, hits = size AS full_hit, bool_or(hits = size) OVER (PARTITION BY query) AS any_full FROM h JOIN (SELECT query, count(*) AS size FROM t GROUP BY query) USING (query))
SELECT query, doc, round(least(1.0, score), 6) AS score FROM w WHERE full_hit OR NOT any_full""")
def v16(spark, d):
    return V.lookup(part_index(spark, d), term_lists(spark)).withColumn("score", F.round("score", 6))


@query("v16_compound_lookup", f"""WITH RECURSIVE {_INDEX}, q AS (SELECT p_partkey AS query, replace(p_name, ' ', '') AS term FROM part WHERE p_partkey % 50 = 0),
m AS (SELECT DISTINCT term FROM q WHERE term NOT IN (SELECT term FROM ix)),
x AS (SELECT DISTINCT term FROM ix WHERE length(term) >= 2),
c AS (SELECT m.term, x.term AS part, i, i + length(x.term) AS j FROM m, (SELECT unnest(range(1, 40)) AS i) r, x WHERE i + length(x.term) - 1 <= length(m.term) AND substring(m.term, i, length(x.term)) = x.term AND length(x.term) < length(m.term)),
s AS (SELECT term, j, [part] AS parts, [i] AS starts FROM c WHERE i = 1 UNION ALL SELECT s.term, c.j, list_append(parts, part), list_prepend(c.i, starts) FROM s JOIN c ON c.term = s.term AND c.i = s.j),
b AS (SELECT term, parts FROM s WHERE j = length(term) + 1 QUALIFY row_number() OVER (PARTITION BY term ORDER BY len(parts), starts) = 1),
t AS (SELECT DISTINCT query, unnest(coalesce(parts, [q.term])) AS term FROM q LEFT JOIN b USING (term)),
h AS (SELECT query, doc, count(*) AS hits, avg(relevance) AS score FROM t JOIN ix USING (term) GROUP BY ALL),
w AS (SELECT h.*, hits = size AS full_hit, bool_or(hits = size) OVER (PARTITION BY query) AS any_full FROM h JOIN (SELECT query, count(*) AS size FROM t GROUP BY query) USING (query)),
k AS (SELECT query, doc, round(least(1.0, score), 6) AS score, row_number() OVER (PARTITION BY query ORDER BY least(1.0, score) DESC, doc) AS rank FROM w WHERE full_hit OR NOT any_full)
SELECT * FROM k WHERE rank <= 10""")
def v16_compound(spark, d):
    """Names written as one word, which the index does not have, looked up by the terms that they are made of."""
    terms = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.replace("p_name", F.lit(" "), F.lit("")).alias("term"))
    return V.lookup_or_split(R.cut(part_index(spark, d)), terms).withColumn("score", F.round("score", 6))


@query("v17_score_scaling", f"WITH {_INDEX} SELECT doc, round(relevance * 0.45 * CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0.15 END, 6) AS score FROM ix JOIN part ON doc = p_partkey WHERE term = 'promo'")
def v17(spark, d):
    ix = part_index(spark, d).filter("term = 'promo'").join(table(spark, d, "part"), F.col("doc") == F.col("p_partkey"))
    return ix.select("doc", F.round(F.col("relevance") * 0.45 * F.when(F.col("p_name").contains("ring"), 1.0).otherwise(0.15), 6).alias("score"))


@query("v18_rerank", f"""WITH {_KNN}, t AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT query, doc, score, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0), 6) AS near FROM r JOIN t a ON a.doc_id = query JOIN t b ON b.doc_id = doc)
SELECT query, doc, near, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY near DESC, score DESC, doc) AS pos FROM s""")
def v18(spark, d):
    """Rerank by the Jaccard similarity of words, which stands beside the first score and is cut by it on ties."""
    t = table(spark, d, "documents").select("doc_id", V.words(F.col("text")).alias("w"))
    w = nearest(spark, d).join(t.select(F.col("doc_id").alias("query"), F.col("w").alias("a")), "query").join(t.select(F.col("doc_id").alias("doc"), F.col("w").alias("b")), "doc")
    w = w.select("query", "doc", "score", F.round(V.jaccard(F.col("a"), F.col("b")), 6).alias("near"))
    pos = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), F.desc("score"), "doc"))
    return w.select("query", "doc", "near", F.round("score", 6).alias("score"), pos.cast("long").alias("pos"))


@query("v19_semantic_cache", f"WITH {_KNN} SELECT query, CASE WHEN score >= 0.3 THEN doc END AS cached FROM r WHERE rank = 1")
def v19(spark, d):
    return nearest(spark, d, 1).select("query", F.when(F.col("score") >= 0.3, F.col("doc")).alias("cached"))


@query("v19_cache_session")
def v19_session(spark, d):
    """Each label's questions in order, a second apart, through a cache: the same text, else a vector alike, within 300 s and 200 entries."""
    e = table(spark, d, "embeddings").withColumn("ts", F.timestamp_seconds(F.col("vec_id") * 1))
    asked = e.select(F.col("label").cast("string").alias("cache"), F.col("vec_id").alias("id"), "ts", F.concat(F.lit("Question "), F.col("vec_id") % 97).alias("text"), F.col("embedding").alias("vector"), F.concat(F.lit("answer "), "vec_id").alias("answer"))
    return stores.cache_table(asked).withColumn("score", F.round("score", 6))


@query("v20_cache_keys", "SELECT DISTINCT md5(lower(trim(regexp_replace(p_name || ' ' || p_type, '[ ]+', ' ', 'g')))) AS key FROM part")
def v20(spark, d):
    return table(spark, d, "part").select(F.md5(R.collapse(F.concat_ws(" ", "p_name", "p_type"))).alias("key")).distinct()


@query("v21_search_then_rerank", f"WITH {_KNN} SELECT query, doc FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc % 7, rank) AS pos FROM r) WHERE pos <= 5")
def v21(spark, d):
    return R.top_per_group(nearest(spark, d), ["query"], [F.col("doc") % 7, "rank"], 5).select("query", "doc")


@query("v22_match_counts", "SELECT p_partkey, CAST(contains(lower(p_name), 'red') AS INT) + CAST(contains(lower(p_name), 'ring') AS INT) AS title, CAST(contains(lower(p_type), 'promo') AS INT) AS kind FROM part")
def v22(spark, d):
    return table(spark, d, "part").select("p_partkey", V.matches(F.array(F.lit("RED"), F.lit("ring")), F.col("p_name")).alias("title"), V.matches(F.array(F.lit("promo")), F.col("p_type")).alias("kind"))


@query("v23_sections", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' the ')), chr(10)) AS found FROM documents")
def v23(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" the "))), "\n").alias("found"))


@query("v25_snippet", "SELECT doc_id, substring(text, greatest(1, instr(text, ' the ') - 20), 60) AS snippet FROM documents WHERE contains(text, ' the ')")
def v25(spark, d):
    at = F.greatest(F.lit(1), F.instr("text", " the ") - 20)
    return table(spark, d, "documents").filter(F.col("text").contains(" the ")).select("doc_id", F.substring("text", at, F.lit(60)).alias("snippet"))


_AT = "nullif(instr(lower(text), '{0}'), 0)"


@query("v25_snippet_of_terms", f"WITH a AS (SELECT doc_id, text, least({_AT.format(' und ')}, {_AT.format(' que ')}, {_AT.format(' les ')}, {_AT.format(' and ')}) AS place FROM documents) SELECT doc_id, substring(text, greatest(1, place - 20), 60) AS snippet FROM a WHERE place IS NOT NULL")
def v25_terms(spark, d):
    """Around the first of several terms."""
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), (" und ", " que ", " les ", " and ")).alias("snippet")).filter("snippet IS NOT NULL")


@query("v26_rule_card", """SELECT to_json({'id': p_partkey, 'title': array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' '), 'tags': [p_brand, p_type], 'body': p_name[1:200]}) AS card FROM part""")
def v26(spark, d):
    return table(spark, d, "part").select(F.struct(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("title"), F.array("p_brand", "p_type").alias("tags"), F.substring("p_name", 1, 200).alias("body")).alias("card")).select(F.to_json("card").alias("card"))


_REL = f"""{_KNN}, m AS (SELECT query, rank, (a.label = b.label) AS rel FROM r JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = doc),
n AS (SELECT a.vec_id AS query, count(*) AS relevant FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id)"""


def judged(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    m = nearest(spark, d).join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(e.select(F.col("vec_id").alias("doc"), F.col("label").alias("b")), "doc")
    of_label = e.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    n = e.filter("vec_id % 50 = 0").join(of_label, "label").select(F.col("vec_id").alias("query"), "relevant")
    return m.select("query", "rank", (F.col("a") == F.col("b")).alias("rel")).join(n, "query")


@query("m01_precision_at_k", f"WITH {_REL} SELECT query, round(count(*) FILTER (rel AND rank <= 5) / 5.0, 6) AS precision FROM m GROUP BY query")
def m01(spark, d):
    return judged(spark, d).groupBy("query").agg(F.round(F.count_if(F.col("rel") & (F.col("rank") <= 5)) / 5.0, 6).alias("precision"))


@query("m02_recall_hit_mrr", f"WITH {_REL} SELECT query, round(count(*) FILTER (rel) / any_value(relevant), 6) AS recall, bool_or(rel) AS hit, round(coalesce(1.0 / min(rank) FILTER (rel), 0), 6) AS mrr FROM m JOIN n USING (query) GROUP BY query")
def m02(spark, d):
    r = F.col("rel")
    return judged(spark, d).groupBy("query").agg(F.round(F.count_if(r) / F.max("relevant"), 6).alias("recall"), F.bool_or(r).alias("hit"), F.round(F.coalesce(1.0 / F.min(F.when(r, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


@query("m03_ndcg", f"""WITH {_REL} SELECT query, round(sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(ideal), 6) AS ndcg FROM m JOIN (SELECT query, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) x(i) WHERE i <= relevant) AS ideal FROM n) USING (query) GROUP BY query""")
def m03(spark, d):
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.max("relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return judged(spark, d).groupBy("query").agg(F.round(F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)) / ideal, 6).alias("ndcg"))


@query("m04_similarity_summary", f"WITH {_KNN} SELECT query, round(avg(score), 6) AS mean, round(max(score), 6) AS most, round(min(score), 6) AS least FROM r GROUP BY query")
def m04(spark, d):
    return nearest(spark, d).groupBy("query").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("most"), F.round(F.min("score"), 6).alias("least"))


@query("m05_coverage", "SELECT p_partkey, CAST(trunc((CAST(contains(p_name, 'red') AS INT) + CAST(contains(p_name, 'ring') AS INT) + CAST(contains(p_type, 'PROMO') AS INT)) * 100.0 / 3) AS BIGINT) AS coverage, instr(p_name, 'red') > 0 AND instr(p_name, 'red') < instr(p_name, 'ring') AS in_order FROM part")
def m05(spark, d):
    text = F.concat_ws(" ", "p_name", F.lower("p_type"))
    hits = V.matches(F.array(*map(F.lit, ("red", "ring", "promo"))), text)
    red, ring = F.instr("p_name", "red"), F.instr("p_name", "ring")
    return table(spark, d, "part").select("p_partkey", (hits * 100.0 / 3).cast("long").alias("coverage"), ((red > 0) & (red < ring)).alias("in_order"))


@query("m07_accuracy_by_category", "SELECT event_type, round(avg(CAST(CAST(props ->> '$.k' AS INT) > 50 AS INT)), 6) AS accuracy, round(avg(value), 4) AS latency, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def m07(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    p95 = R.percentiles(e, "event_type", "value", {"p95": 0.95}).withColumn("p95", F.round("p95", 4))
    return e.groupBy("event_type").agg(F.round(F.avg((F.col("k") > 50).cast("int")), 6).alias("accuracy"), F.round(F.avg("value"), 4).alias("latency")).join(p95, "event_type")


_SIM = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"


@query("v04_trigram_search", f"""WITH t AS (SELECT DISTINCT p_partkey AS query, unnest(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 3)[1:3]) AS term FROM part WHERE p_partkey % 50 = 0),
a AS (SELECT query, term, {_TRI.format("term")} AS g FROM t), p AS (SELECT p_partkey AS doc, {_TRI.format("p_name")} AS x, {_TRI.format("p_type")} AS y, {_TRI.format("p_brand")} AS z FROM part),
s AS (SELECT query, doc, term, greatest({_SIM.format("g", "x")}, {_SIM.format("g", "y")}, {_SIM.format("g", "z")}) AS s FROM a, p),
b AS (SELECT query, doc, sum(s) AS score FROM s GROUP BY query, doc HAVING max(s) >= 0.3),
r AS (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM b) SELECT * FROM r WHERE rank <= 10""")
def v04_trigrams(spark, d):
    """Each fiftieth part's name, word by word, against the names, types and brands of all parts."""
    p = table(spark, d, "part")
    q = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.split("p_name", " ").alias("terms"))
    return V.trigram_search(p.select(F.col("p_partkey").alias("doc"), "p_name", "p_type", "p_brand"), ["p_name", "p_type", "p_brand"], q, 10).withColumn("score", F.round("score", 6))


@query("v10_finalise", """WITH c AS (SELECT l_suppkey AS query, l_partkey AS doc, CAST(sum(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT c.*, p_name AS title, p_brand || ' ' || p_type AS content, p_brand = 'Brand#' || (query % 25 + 1) AS gate, length(p_name) < 9 AS noisy FROM c JOIN part ON p_partkey = doc),
g AS (SELECT *, bool_or(gate) OVER (PARTITION BY query) AS any_gate FROM r), h AS (SELECT * FROM g WHERE gate OR NOT any_gate),
n AS (SELECT *, bool_or(NOT noisy) OVER (PARTITION BY query) AS any_left FROM h), m AS (SELECT * FROM n WHERE NOT noisy OR NOT any_left),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query, title ORDER BY length(content) DESC, score DESC, doc) = 1),
k AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM t) SELECT * FROM k WHERE rank <= 5""")
def v10_finalise(spark, d):
    """What is shown of each supplier's parts: of its own brand if it has any, without short names if others are left, each name once."""
    sold = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("doc")).agg(F.sum("l_quantity").alias("score"))
    rows = sold.join(table(spark, d, "part"), F.col("p_partkey") == F.col("doc")).select("query", "doc", "score", F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("content"), "p_brand")
    own = F.col("p_brand") == F.concat(F.lit("Brand#"), (F.col("query") % 25 + 1).cast("string"))
    return V.finalise(rows, own, F.length("title") < 9, 5).select("query", "doc", "score", "rank")


_LANES = """q AS (SELECT p_partkey AS query, p_name, p_type, p_brand, CASE p_size % 3 WHEN 0 THEN ['name', 'type', 'brand'] WHEN 1 THEN ['brand', 'name', 'type'] ELSE ['type', 'brand', 'name'] END AS lanes FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT query, p.p_partkey AS doc, round(1.0 - abs(p.p_size - 25) / 50.0, 6) AS score, 'name' AS origin FROM q JOIN part p USING (p_name) UNION ALL
SELECT query, p.p_partkey, round(0.5 - abs(p.p_size - 10) / 100.0, 6), 'type' FROM q JOIN part p USING (p_type) UNION ALL SELECT query, p.p_partkey, round(0.8 - abs(p.p_size - 40) / 60.0, 6), 'brand' FROM q JOIN part p USING (p_brand))"""


@query("v12_call_budget", f"""WITH {_LANES}, c AS (SELECT query, lanes[i] AS origin, i AS call FROM q, (VALUES (1), (2)) t(i)),
f AS (SELECT s.*, call FROM s JOIN c USING (query, origin) QUALIFY row_number() OVER (PARTITION BY query, origin ORDER BY score DESC, doc) <= 10),
b AS (SELECT query, doc, score, origin FROM f QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY score DESC, call) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b) SELECT query, doc, score, origin, rank FROM k WHERE rank <= 5""")
def v12_budget(spark, d):
    """Of three sources each query asks the first two of its policy.

    A source's scores do not depend on the query, so that only the rows of each name, type or brand that a call gives meet the queries.
    """
    p = table(spark, d, "part")
    lanes = lambda *n: F.array(*map(F.lit, n))
    kind = F.col("p_size") % 3
    q = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), "p_name", "p_type", "p_brand", F.when(kind == 0, lanes("name", "type", "brand")).when(kind == 1, lanes("brand", "name", "type")).otherwise(lanes("type", "brand", "name")).alias("lanes"))

    def source(column, score):
        given = p.select(column, F.col("p_partkey").alias("doc"), F.round(score, 6).alias("score"))
        given = R.top_per_group(given, [column], [F.desc("score"), "doc"], V.call_rows(5), "place")
        return q.select("query", column).join(given, column).select("query", "doc", "score")

    z = F.col("p_size")
    sources = {"name": source("p_name", 1.0 - F.abs(z - 25) / 50.0), "type": source("p_type", 0.5 - F.abs(z - 10) / 100.0), "brand": source("p_brand", 0.8 - F.abs(z - 40) / 60.0)}
    return V.within_budget(q.select("query", "lanes"), sources, 2, 5)


@query("v13_two_passes", f"""WITH {_KNN}, w AS (SELECT doc_id, list_distinct({_SEQ.format("text")}) AS w FROM documents),
x AS (SELECT query, {_SEQ.format("text")}[1:3] AS t FROM q JOIN documents ON doc_id = query), l0 AS (SELECT query, doc_id AS doc, len(list_intersect(list_distinct(t), w)) / sqrt(len(w)) AS score FROM x, w WHERE doc_id <> query),
l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM l0 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 5),
a AS (SELECT query FROM l GROUP BY query HAVING coalesce(max(score) FILTER (rank = 1), 0) >= 0.35 AND coalesce(max(score) FILTER (rank = 1), 0) - coalesce(max(score) FILTER (rank = 2), 0) >= 0.02),
m AS (SELECT query, doc, 'vector' AS origin, rank FROM r WHERE query NOT IN (SELECT query FROM a) AND (query, doc) NOT IN (SELECT (query, doc) FROM l)),
u AS (SELECT query, doc, 'text' AS origin, rank FROM l UNION ALL SELECT * FROM m) SELECT query, doc, origin, row_number() OVER (PARTITION BY query ORDER BY origin, rank) AS place FROM u""")
def v13_passes(spark, d):
    """Documents by the words of a query first, and by its vector only where the best of those does not stand out."""
    docs = table(spark, d, "documents").select("doc_id", D.words(F.col("text")).alias("w"))
    q = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"))
    terms = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.array_distinct(F.slice("w", 1, 3)).alias("terms")).join(q, "query", "left_semi")
    lexical = T.scan_overlap(docs.select(F.col("doc_id").alias("doc"), F.array_distinct("w").alias("words")), terms, 5)
    return V.two_passes(q, R.cut(lexical), nearest(spark, d), 0.35, 0.02)


_TERMS_IN = "(contains(lower(b), 'the') OR contains(lower(b), 'und') OR contains(lower(b), 'que') OR contains(lower(b), 'les'))"


@query("v23_focused_sections", f"""WITH b AS (SELECT doc_id, list_filter(list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n+|\\n'), lambda b: trim(b) <> ''), lambda b: {_TERMS_IN}) AS b FROM documents),
k AS (SELECT doc_id, b, list_transform(b, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS k FROM b)
SELECT doc_id, md5(array_to_string(list_filter(b, lambda x, i: k[i] = '' OR list_position(k, k[i]) = i), chr(10))) AS digest FROM k""")
def v23_focused(spark, d):
    found = X.focused_sections(F.col("text"), ("the", "und", "que", "les"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(found, "\n")).alias("digest"))

