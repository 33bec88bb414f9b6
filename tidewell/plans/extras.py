"""Further query-understanding, ETL and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import assignment as A
from tidewell.operators import relational as R
from tidewell.operators import retrieval as V
from tidewell.plans.registry import CONTACTS, contacts, query, table
from tidewell.plans.relational import folder
from tidewell.plans.retrieval import _INDEX, part_index
from tidewell.sources import files
from tidewell.streaming import conversations as S


@query("s14_vector_sink_check", "SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS whole FROM embeddings")
def s14(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("whole"))


@query("s16_resume", "SELECT event_id FROM events WHERE event_id > 500 AND event_id % 7 <> 0")
def s16(spark, d):
    """What is left after an index and a set of processed ids."""
    e = table(spark, d, "events")
    done = e.filter("event_id % 7 = 0").select("event_id")
    return e.filter("event_id > 500").join(done, "event_id", "left_anti").select("event_id")


@query("j07_retro_update", f"WITH {CONTACTS} SELECT id, NOT EXISTS (SELECT 1 FROM contacts b WHERE b.customer = a.customer AND b.day > a.day AND b.day <= a.day + 7) AS resolved FROM contacts a")
def j07(spark, d):
    c = contacts(spark, d)
    return c.select("id", (~R.recontacted(c, ["customer"], "day")).alias("resolved"))


@query("w02_ranked_with_tie_break", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn FROM part")
def w02(spark, d):
    return R.numbered(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), [F.col("p_size"), F.col("p_partkey")], "rn", ["p_brand"]).select("p_partkey", "rn")


@query("k07_multi_key_order", "SELECT p_partkey, row_number() OVER (ORDER BY (p_type = 'PROMO') DESC, p_size DESC, p_retailprice DESC, p_partkey) AS pos FROM part ORDER BY pos LIMIT 25")
def k07(spark, d):
    order = [F.desc(F.col("p_type") == "PROMO"), F.desc("p_size"), F.desc("p_retailprice"), "p_partkey"]
    return R.ranked(table(spark, d, "part").orderBy(*order).limit(25), order, "pos").select("p_partkey", "pos")


@query("u02_postings_intersection", f"WITH {_INDEX}, h AS (SELECT doc, count(DISTINCT term) AS hits FROM ix WHERE term IN ('red', 'ring', 'promo') GROUP BY doc) SELECT doc FROM h WHERE hits = 3 OR NOT EXISTS (SELECT 1 FROM h WHERE hits = 3)")
def u02(spark, d):
    terms = spark.createDataFrame([(1, t) for t in ("red", "ring", "promo")], "query int, term string")
    return V.lookup(part_index(spark, d), terms).select("doc")


@query("v24_hard_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), ' the ') AND contains(lower(text), ' and ') AND NOT contains(text, '***')")
def v24(spark, d):
    t = F.lower("text")
    return table(spark, d, "documents").filter(F.contains(t, F.lit(" the ")) & F.contains(t, F.lit(" and ")) & ~F.col("text").contains("***")).select("doc_id")


@query("m06_alignment_accuracy")
def m06(spark, d):
    """Roles by character of another transcript of each conversation, in which words are missing and turns have other roles.

    conv_id, role, heard and n: how many aligned characters of a role were heard as which; others are ``missed``.
    """
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = F.filter(F.split("text", " "), lambda w, i: (F.hash(w, i) % 9 != 0))
    heard = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.lit("other")).otherwise(F.col("role")).alias("role"), F.array_join(said, " ").alias("text"))
    return S.alignment(c, heard)


@query("n02_seed_mapping", "SELECT p_type, count(DISTINCT w) AS words FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> '' GROUP BY p_type")
def n02(spark, d):
    w = F.filter(F.split("p_name", " "), lambda x: F.trim(x) != "")
    return table(spark, d, "part").select("p_type", F.explode(w).alias("w")).groupBy("p_type").agg(F.count_distinct("w").alias("words"))


@query("n04_count_tiers", f"WITH {CONTACTS}, n AS (SELECT customer, count(*) AS n FROM contacts GROUP BY customer), t AS (SELECT *, ntile(10) OVER (ORDER BY n, customer) AS k FROM n) SELECT customer, CASE WHEN k <= 4 THEN 'low' WHEN k <= 7 THEN 'medium' WHEN k <= 9 THEN 'high' ELSE 'top' END AS tier FROM t")
def n04(spark, d):
    """Customers by count of contacts in shares of 40, 30, 20 and 10 %; what does not divide goes to the first tiles."""
    n = contacts(spark, d).groupBy("customer").agg(F.count("*").alias("n"))
    ranked = R.numbered(n, [F.col("n"), F.col("customer")]).crossJoin(F.broadcast(n.agg(F.count("*").alias("all"))))
    return ranked.select("customer", R.tier(R.ntile(F.col("rank"), F.col("all"), 10), [(4, "low"), (7, "medium"), (9, "high")], "top").alias("tier"))


@query("n07_clipped_scores", "SELECT event_id, greatest(0, least(100, CAST(trunc(value * 3) AS BIGINT) - 10)) AS score FROM events")
def n07(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0), F.least(F.lit(100), (F.col("value") * 3).cast("long") - 10)).alias("score"))


@query("n11_term_contexts", "SELECT doc_id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS context FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]{0,20} the [^\n]{0,20}') AS c FROM documents)")
def n11(spark, d):
    """Each occurrence of a term with up to 20 characters on both sides."""
    found = F.regexp_extract_all("text", F.lit("([^\n]{0,20} the [^\n]{0,20})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("i", "context")).select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "context")


@query("t07_row_to_records", """SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, text AS document, '{"role":"' || role || '","turn":' || turn || '}' AS metadata, conv_id, CAST(length(text) AS BIGINT) AS size FROM conversations""")
def t07(spark, d):
    """A row as a vector store's record (id, document, metadata) and a relational one in the same row."""
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("document"), F.to_json(F.struct("role", "turn")).alias("metadata"), "conv_id", F.length("text").cast("long").alias("size"))


@query("x12_processing_status", f"""WITH {CONTACTS}, l AS (SELECT customer, arg_max(category, (ts, id)) AS status, max(ts) AS seen FROM contacts GROUP BY customer)
SELECT customer, CASE WHEN seen > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOUR THEN status END AS status FROM l""")
def x12(spark, d):
    """The last marker of each key, none once it has expired."""
    l = contacts(spark, d).groupBy("customer").agg(F.max_by("category", F.struct("ts", "id")).alias("status"), F.max("ts").alias("at"))
    return l.select("customer", F.when(F.col("at") > F.expr("timestamp_ntz'2024-01-30 00:00:00' - interval 6 hours"), F.col("status")).alias("status"))


@query("n12_fill_tags", "SELECT p_partkey, replace(replace('[NAME] of [BRAND], [NAME]', '[NAME]', p_name), '[BRAND]', p_brand) AS text FROM part")
def n12(spark, d):
    t = F.replace(F.replace(F.lit("[NAME] of [BRAND], [NAME]"), F.lit("[NAME]"), F.col("p_name")), F.lit("[BRAND]"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", t.alias("text"))


@query("n13_intent_filter", "SELECT conv_id, turn FROM (SELECT *, bool_or(contains(text, ' the ')) OVER (PARTITION BY conv_id) AS found FROM conversations) WHERE contains(text, ' the ') OR NOT found")
def n13(spark, d):
    return R.keep_if_none(table(spark, d, "conversations"), "conv_id", F.col("text").contains(" the ")).select("conv_id", "turn")


@query("n14_three_sentences", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 15)[1:3], ' ') AS text FROM conversations")
def n14(spark, d):
    kept = F.slice(F.filter(X.sentences(F.col("text")), lambda s: F.length(s) > 15), 1, 3)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("text"))


@query("n15_tolerant_json")
def n15(spark, d):
    """The whole objects of JSON arrays that may be cut off or stand among other text."""
    e = table(spark, d, "events")
    g = e.groupBy("user_id").agg(F.concat(F.lit("Here: ["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), ", "), F.lit("]")).alias("json"))
    cut = F.when(F.col("user_id") % 4 == 0, F.expr("left(json, length(json) - 5)")).otherwise(F.col("json"))
    return g.select("user_id", F.posexplode(X.json_objects(cut)).alias("i", "object"))


@query("n16_fragments")
def n16(spark, d):
    """A fragment stream for tests: texts cut after 10 to 60 characters, by a hash of conversation, turn and position."""
    n = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(51)).cast("int") + 10
    c = table(spark, d, "conversations").filter("length(text) > 0").withColumn("n", n)
    return c.select("conv_id", "turn", F.posexplode(F.expr("transform(sequence(1, length(text), n), i -> substring(text, i, n))")).alias("fragment", "text"))


@query("n16_gaussian_fragments", """WITH t AS (SELECT conv_id, turn, text, unnest(range(0, length(text) // 10 + 1)) AS i FROM conversations WHERE length(text) > 0),
k AS (SELECT *, md5(conv_id || ':' || turn || ':' || i) AS k FROM t), u AS (SELECT *, (CAST('0x' || substring(k, 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE AS a, CAST('0x' || substring(k, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE AS b FROM k),
n AS (SELECT *, CAST(greatest(10, least(60, floor(35 + 12.5::DOUBLE * sqrt(-2 * ln(a)) * cos(2 * pi() * b)))) AS BIGINT) AS n FROM u),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT conv_id, turn, CAST(i AS INT) AS fragment, substring(text, CAST(before AS BIGINT) + 1, n) AS text FROM s WHERE before < length(text)""")
def n16_gaussian(spark, d):
    """A fragment stream for tests: lengths from a normal distribution, clipped to 10 and 60, by a hash of conversation, turn and number."""
    c = table(spark, d, "conversations").filter("length(text) > 0")
    seed = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", F.inline(X.fragments(F.col("text"), seed)))


@query("n18_residual_words", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: NOT contains('red ring', w)), ' ') AS rest FROM part")
def n18(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.split("p_name", " "), lambda w: ~F.contains(F.lit("red ring"), w)), " ").alias("rest"))


@query("n19_extraction_cascade", """WITH t AS (SELECT conv_id, turn, text, replace(replace(lower(text), 'colour', 'color'), ' teh ', ' the ') AS c FROM conversations),
w AS (SELECT *, list_distinct(regexp_extract_all(c, '[a-z]+')) AS w FROM t)
SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN 'none' WHEN regexp_matches(c, '(^|[^0-9])[0-9]{3,}([^0-9]|$)') THEN 'pattern' WHEN len(list_intersect(w, ['the', 'and', 'with'])) > 0 THEN 'exact' WHEN len(list_filter(w, lambda x: levenshtein(x, 'the') <= 1 OR levenshtein(x, 'with') <= 1)) > 0 THEN 'near' ELSE 'rest' END AS stage,
CASE WHEN length(text) < 20 THEN '' WHEN regexp_matches(c, '(^|[^0-9])[0-9]{3,}([^0-9]|$)') THEN regexp_extract(c, '(^|[^0-9])([0-9]{3,})([^0-9]|$)', 2) WHEN len(list_intersect(w, ['the', 'and', 'with'])) > 0 THEN array_to_string(list_sort(list_intersect(w, ['the', 'and', 'with'])), ',')
ELSE array_to_string(list_sort(list_filter(w, lambda x: levenshtein(x, 'the') <= 1 OR levenshtein(x, 'with') <= 1)), ',') END AS found FROM w""")
def n19(spark, d):
    """Texts without information first; corrections; then patterns, exact names, and names one edit away, each where the stages before found nothing."""
    corrected = X.replace_all(F.lower("text"), {"colour": "color", " teh ": " the "})
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", corrected.alias("c")).withColumn("w", V.words(F.col("c")))
    pattern = "(^|[^0-9])([0-9]{3,})([^0-9]|$)"
    exact = F.array_sort(F.array_intersect("w", F.array(*map(F.lit, ("the", "and", "with")))))
    near = F.array_sort(F.filter("w", lambda x: (F.levenshtein(x, F.lit("the")) <= 1) | (F.levenshtein(x, F.lit("with")) <= 1)))
    short, by_pattern = F.length("text") < 20, F.col("c").rlike(pattern)
    stage = F.when(short, "none").when(by_pattern, "pattern").when(F.size(exact) > 0, "exact").when(F.size(near) > 0, "near").otherwise("rest")
    found = F.when(short, "").when(by_pattern, F.regexp_extract("c", pattern, 2)).when(F.size(exact) > 0, F.array_join(exact, ",")).otherwise(F.array_join(near, ","))
    return t.select("conv_id", "turn", stage.alias("stage"), found.alias("found"))


@query("n20_second_lane", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'issue' WHEN p_size > 30 THEN 'benefit' ELSE 'none' END AS lane FROM part")
def n20(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "issue").when(F.col("p_size") > 30, "benefit").otherwise("none").alias("lane"))


@query("n21_lane_fallback", f"WITH {_INDEX}, q(query, term) AS (VALUES (1, 'red'), (2, 'nowhere')), a AS (SELECT query, doc FROM q JOIN ix USING (term)) SELECT query, doc FROM a UNION ALL SELECT query, p_partkey FROM q, part WHERE p_size = 50 AND query NOT IN (SELECT query FROM a)")
def n21(spark, d):
    """The second lane's documents for queries whose first lane finds none."""
    q = spark.createDataFrame([(1, "red"), (2, "nowhere")], "query int, term string")
    first = q.join(part_index(spark, d), "term").select("query", "doc")
    failed = q.join(first.select("query").distinct(), "query", "left_anti").select("query")
    return first.unionByName(table(spark, d, "part").filter("p_size = 50").select(F.col("p_partkey").alias("doc")).crossJoin(R.sent_if_small(failed)))


@query("n22_predicted_document", f"WITH {_INDEX}, q(query, term) AS (VALUES (1, 'red'), (2, 'ring')) SELECT query, min(doc) AS doc FROM q JOIN ix USING (term) JOIN part ON p_partkey = doc WHERE contains(p_name, term) GROUP BY query")
def n22(spark, d):
    q = spark.createDataFrame([(1, "red"), (2, "ring")], "query int, term string")
    hits = q.join(part_index(spark, d), "term").join(table(spark, d, "part"), F.col("p_partkey") == F.col("doc"))
    return hits.filter(F.contains("p_name", "term")).groupBy("query").agg(F.min("doc").alias("doc"))


@query("n23_plausible_names", "SELECT p_partkey FROM part WHERE length(replace(replace(p_name, 'red', ''), ' ', '')) >= 5")
def n23(spark, d):
    return table(spark, d, "part").filter(F.length(X.replace_all(F.col("p_name"), {"red": "", " ": ""})) >= 5).select("p_partkey")


@query("n24_strong_support", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('red', 'small', 'blue'))) >= 1 AND p_type = 'PROMO'")
def n24(spark, d):
    strong = F.exists(F.split("p_name", " "), lambda w: ~w.isin("red", "small", "blue"))
    return table(spark, d, "part").filter(strong & (F.col("p_type") == "PROMO")).select("p_partkey")


@query("n25_sub_intent", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'a' WHEN contains(p_name, 'bolt') OR contains(p_name, 'widget') THEN 'b' END AS intent FROM part")
def n25(spark, d):
    return table(spark, d, "part").select("p_partkey", X.first_label(F.col("p_name"), [("a", ("ring",)), ("b", ("bolt", "widget"))]).alias("intent"))


@query("n26_flatten_sections", "SELECT conv_id || '_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id, role FROM conversations")
def n26(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("parts"))
    return g.select("conv_id", F.posexplode_outer("parts").alias("i", "p")).select(F.concat_ws("_", "conv_id", "i").alias("id"), "p.role")


@query("n28_validated_ids", "SELECT left(p_type, 3) || lpad(CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS VARCHAR), 5, '0') AS id, p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY') AND NOT contains(p_name, 'bolt')")
def n28(spark, d):
    p = table(spark, d, "part").filter(F.col("p_type").isin("PROMO", "ECONOMY") & ~F.col("p_name").contains("bolt"))
    p = R.numbered(p.select("p_type", "p_partkey"), [F.col("p_partkey")], "n", ["p_type"])
    return p.select(F.concat(F.substring("p_type", 1, 3), F.lpad(F.col("n").cast("string"), 5, "0")).alias("id"), "p_partkey")


@query("n27_phrases_out")
def n27(spark, d):
    """Phrases go from all texts of a nested record, whatever its shape."""
    card = F.to_json(F.struct("p_name", F.struct(F.array(F.struct(F.col("p_name").alias("title")), F.struct(F.col("p_brand").alias("title"))).alias("parts"), F.col("p_size").alias("size")).alias("more")))
    return table(spark, d, "part").select("p_partkey", X.json_without(card, ("red", "Brand#")).alias("card"))


@query("n29_line_packing")
def n29(spark, d):
    """Lines wrapped at 80 characters and packed to 300; every chunk begins with the item's heading."""
    wrapped = F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.regexp_extract_all(x, F.lit("(.{1,80})"), F.lit(1))))
    chunks = table(spark, d, "benchmark").select("item_id", F.posexplode(X.pack(wrapped, 280, "\n")).alias("chunk", "text"))
    return chunks.select("item_id", "chunk", F.concat_ws("\n", F.concat(F.lit("# item "), F.col("item_id")), "text").alias("text"))


@query("n33_first_known_tag", "SELECT p_partkey, coalesce(CASE WHEN list_position(w, 'red') > 0 AND (list_position(w, 'ring') IS NULL OR list_position(w, 'red') < list_position(w, 'ring')) THEN 'R' WHEN list_position(w, 'ring') > 0 THEN 'G' END, 'X') AS code FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def n33(spark, d):
    known = F.create_map(*map(F.lit, ("red", "R", "ring", "G")))
    codes = F.filter(F.transform(F.split("p_name", " "), lambda w: F.try_element_at(known, w)), lambda c: c.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.get(codes, F.lit(0)), F.lit("X")).alias("code"))


@query("n34_combined_score", "SELECT user_id, round(0.6 * avg(least(100, value)) + 0.4 * max(least(100, value)), 4) AS score, 0.6 * avg(least(100, value)) + 0.4 * max(least(100, value)) >= 30 AS passed FROM events GROUP BY user_id")
def n34(spark, d):
    v = F.least(F.lit(100.0), F.col("value"))
    g = table(spark, d, "events").groupBy("user_id").agg((0.6 * F.avg(v) + 0.4 * F.max(v)).alias("s"))
    return g.select("user_id", F.round("s", 4).alias("score"), (F.col("s") >= 30).alias("passed"))


@query("n35_bulk_load", "SELECT c_custkey AS id, lower(c_mktsegment) AS segment, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, NULL, 'supplier' FROM supplier")
def n35(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("segment"))
    return R.union_sources({"customer": c, "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))}).select("id", "segment", "origin")


@query("n36_merge_synonyms", "SELECT p_brand, array_to_string(list_sort(list_distinct(list_concat(list(p_type), ['OTHER']))), ',') AS synonyms FROM part GROUP BY p_brand")
def n36(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("have"))
    return g.select("p_brand", F.array_join(F.array_sort(F.array_union("have", F.array(F.lit("OTHER")))), ",").alias("synonyms"))


@query("v08_weight_presets", "SELECT preset, p_partkey, round(wv * p_size / 50.0 + wk * p_retailprice / 2000.0, 6) AS score FROM part, (VALUES ('balanced', 0.5, 0.5), ('lexical', 0.2, 0.8)) v(preset, wv, wk)")
def v08(spark, d):
    presets = {"balanced": (0.5, 0.5), "lexical": (0.2, 0.8)}
    p = table(spark, d, "part")
    return R.union_sources({k: p.select("p_partkey", F.round(a * F.col("p_size") / 50.0 + b * F.col("p_retailprice") / 2000.0, 6).alias("score")) for k, (a, b) in presets.items()}).withColumnRenamed("origin", "preset").select("preset", "p_partkey", "score")


def another_transcript(spark, d):
    """Conversations, and the same ones as heard: words are missing, and some turns have other roles."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = F.filter(F.split("text", " "), lambda w, i: F.hash(w, i) % 9 != 0)
    return c, c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.lit("other")).otherwise(F.col("role")).alias("role"), F.array_join(said, " ").alias("text"))


@query("m06_character_accuracy")
def m06_characters(spark, d):
    """How much of each conversation was heard, character by character, and how much of that with the right role."""
    said, heard = another_transcript(spark, d)
    out = S.alignment_accuracy(said, S.character_alignment(said, heard))
    return out.withColumns({"coverage": F.round("coverage", 6), "accuracy": F.round("accuracy", 6)})


@query("m06_confusion", "SELECT role, CASE WHEN turn % 3 = 2 THEN 'other' ELSE role END AS heard, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY ALL HAVING sum(length(text)) > 0")
def m06_confusion(spark, d):
    """Characters by role and role heard, where the words are the same ones."""
    said, heard = another_transcript(spark, d)
    heard = said.drop("role").join(heard.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    aligned = S.character_alignment(said, heard)
    return aligned.groupBy("role", "heard").agg(F.sum(F.col("end") - F.col("start")).alias("n"))


@query("w09_mismatch_spans")
def w09_spans(spark, d):
    """Spans of 20 characters or more that were heard with other roles."""
    said, heard = another_transcript(spark, d)
    return S.mismatch_spans(S.character_alignment(said, heard)).select("conv_id", "start", "characters", "turns")


@query("t10_overlapping_chunks")
def t10_overlapping(spark, d):
    """Section chunks of about 600 tokens, each beginning with up to 240 characters of whole lines of the one before."""
    chunks = X.overlapping(F.transform(X.section_chunks(F.col("text"), 600), lambda c: c["text"]), 240)
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


@query("t12_without_repeats", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(l) - len(list_filter(l, lambda x, i: trim(x) = '' OR list_position(list_transform(l, lambda y: trim(y)), trim(x)) = i)) AS gone, md5(array_to_string(list_filter(l, lambda x, i: trim(x) = '' OR list_position(list_transform(l, lambda y: trim(y)), trim(x)) = i), chr(10))) AS digest FROM l""")
def t12_without(spark, d):
    """Texts without the lines that an earlier line of them repeats."""
    lines = F.split("text", "\n")
    kept = X.first_of_equals(lines, lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+$", ""))  # as trim() of the SQL: any kind of blank
    t = table(spark, d, "documents").select("doc_id", F.size(lines).alias("n"), kept.alias("kept"))
    return t.select("doc_id", (F.col("n") - F.size("kept")).cast("long").alias("gone"), F.md5(F.array_join("kept", "\n")).alias("digest"))


@query("t16_rich_and_random_sample", """WITH n AS (SELECT doc_id, lang, n_chars, least(20, greatest(3, count(*) OVER (PARTITION BY lang) // 10)) AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= size * 6 // 10 AS rich FROM n),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, rich ORDER BY md5('5:' || doc_id), doc_id) AS k FROM r)
SELECT doc_id, lang, rich FROM s WHERE rich OR k <= size - size * 6 // 10""")
def t16_mixed(spark, d):
    """Of each language a tenth, 3 at least and 20 at most: six of ten by length, the others by a seeded hash among the rest."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    sizes = docs.groupBy(F.col("lang").alias("of")).agg(F.expr("least(20, greatest(3, count(*) div 10))").alias("size"))
    rich = R.top_per_group(docs, ["lang"], [F.desc("n_chars"), "doc_id"], 20, "r").join(sizes, F.col("lang").eqNullSafe(F.col("of"))).filter(F.expr("r <= size * 6 div 10"))
    rest = docs.join(rich.select("doc_id"), "doc_id", "left_anti")
    drawn = R.top_per_group(rest, ["lang"], [F.md5(F.concat(F.lit("5:"), F.col("doc_id").cast("string"))), "doc_id"], 20, "r").join(sizes, F.col("lang").eqNullSafe(F.col("of"))).filter(F.expr("r <= size - size * 6 div 10"))
    return rich.select("doc_id", "lang", F.lit(True).alias("rich")).unionByName(drawn.select("doc_id", "lang", F.lit(False).alias("rich")))


@query("f14_protected_corrections", """WITH t AS (SELECT p_partkey, 'a ' || p_name || ' [RED] small ' || lower(p_type) || ' "small ring" red' AS t FROM part),
s AS (SELECT p_partkey, regexp_split_to_array(t, '\\[[A-Z]+\\]|"[^"]*"') AS b, regexp_extract_all(t, '\\[[A-Z]+\\]|"[^"]*"') AS s FROM t)
SELECT p_partkey, array_to_string(list_transform(b, lambda x, i: replace(replace(replace(x, 'small ring', 'ringlet'), 'widget', 'gadget'), 'red', 'crimson') || coalesce(s[i], '')), '') AS text FROM s""")
def f14_protected(spark, d):
    """Corrections that leave tags and quoted words alone."""
    text = F.concat(F.lit("a "), "p_name", F.lit(" [RED] small "), F.lower("p_type"), F.lit(' "small ring" red'))
    return table(spark, d, "part").select("p_partkey", X.correct_outside(text, {"red": "crimson", "small ring": "ringlet", "widget": "gadget"}, r'\[[A-Z]+\]|"[^"]*"').alias("text"))


_NOTICE = "CASE id % 4 WHEN 0 THEN 'from ' || strftime(day, '%Y-%m-%d') || ' until ' || strftime(day + 5, '%Y-%m-%d') WHEN 1 THEN 'event of ' || strftime(day, '%Y/%m/%d') WHEN 2 THEN 'notice ' || strftime(day, '%Y.%m.%d') ELSE 'soon' END"


@query("f22_notice_dates", f"""WITH {CONTACTS}, n AS (SELECT id, {_NOTICE} AS t FROM contacts), x AS (SELECT id, t, regexp_extract_all(t, '[0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}') AS f FROM n),
b AS (SELECT id, t, coalesce(TRY_CAST(regexp_replace(f[1], '[/.]', '-', 'g') AS DATE), DATE '2024-01-01') AS first, TRY_CAST(regexp_replace(f[2], '[/.]', '-', 'g') AS DATE) AS last FROM x),
e AS (SELECT id, first, coalesce(last, first + CASE WHEN contains(t, 'event') THEN 14 ELSE 7 END) AS last FROM b)
SELECT id, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, DATE '2024-01-20' BETWEEN first AND last AS active FROM e""")
def f22_notices(spark, d):
    """First and last day of notices: dates in three ways of writing; without a last one 14 days for an event and 7 for all else."""
    day, at = F.col("day"), F.col("id") % 4
    write = lambda c, f: F.date_format(c, f)
    text = F.when(at == 0, F.concat(F.lit("from "), write(day, "yyyy-MM-dd"), F.lit(" until "), write(F.date_add(day, 5), "yyyy-MM-dd"))).when(at == 1, F.concat(F.lit("event of "), write(day, "yyyy/MM/dd"))).when(at == 2, F.concat(F.lit("notice "), write(day, "yyyy.MM.dd"))).otherwise("soon")
    n = contacts(spark, d).select("id", text.alias("t"))
    found = n.select("id", "t", X.dates("t").alias("d"))
    first = F.coalesce(F.get("d", F.lit(0)), F.lit("2024-01-01").cast("date"))
    out = found.select("id", first.alias("first"), F.coalesce(F.get("d", F.lit(1)), F.date_add(first, F.when(F.contains("t", F.lit("event")), 14).otherwise(7))).alias("last"))
    return out.select("id", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.lit("2024-01-20").cast("date").between(F.col("first"), F.col("last")).alias("active"))


_TIERS = [("few", 40, 1), ("some", 35, 3), ("many", 18, 6), ("most", 7, 12)]


@query("n04_exact_total", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('3:' || c_custkey), c_custkey) AS place, count(*) OVER () AS n FROM customer),
t AS (SELECT *, CASE WHEN place <= n * 40 // 100 THEN 'few' WHEN place <= n * 75 // 100 THEN 'some' WHEN place <= n * 93 // 100 THEN 'many' ELSE 'most' END AS tier FROM r),
b AS (SELECT *, CASE tier WHEN 'few' THEN 1 WHEN 'some' THEN 3 WHEN 'many' THEN 6 ELSE 12 END AS calls FROM t),
g AS (SELECT (SELECT count(*) FROM orders) - (SELECT sum(calls) FROM b) AS gap)
SELECT c_custkey, tier, CAST(calls + gap // n + CASE WHEN place <= gap - gap // n * n THEN 1 ELSE 0 END AS BIGINT) AS calls FROM b, g""")
def n04_exact(spark, d):
    """Contacts for each customer by tiers of 40, 35, 18 and 7 %, made up to exactly as many as there are orders."""
    c = table(spark, d, "customer").select("c_custkey")
    total = table(spark, d, "orders").count()
    return A.tiered_counts(c, "c_custkey", _TIERS, total, 3)


@query("a19_best_and_worst", """WITH r AS (SELECT user_id, event_type, avg(least(100, CAST(trunc(value) AS BIGINT))) AS score FROM events GROUP BY user_id, event_type),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS best, row_number() OVER (PARTITION BY user_id ORDER BY score, event_type) AS worst FROM r)
SELECT user_id, string_agg(event_type, ',' ORDER BY best) FILTER (best <= 3) AS best, string_agg(event_type, ',' ORDER BY worst) FILTER (worst <= 3) AS worst FROM n GROUP BY user_id""")
def a19_best(spark, d):
    """Each user's three best and three worst subjects by mean score."""
    score = F.avg(F.least(F.lit(100), F.col("value").cast("long")))
    r = table(spark, d, "events").groupBy("user_id", "event_type").agg(score.alias("score"))
    three = lambda sign: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((sign * F.col("score")).alias("s"), "event_type"))), 1, 3), lambda x: x["event_type"]), ",")
    return r.groupBy("user_id").agg(three(-1).alias("best"), three(1).alias("worst"))  # a row for each subject of a user


@query("m05_overall", """WITH k AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS o, list_distinct(o) AS w, ['red', 'ring', 'promo'] AS t FROM part),
s AS (SELECT p_partkey, len(list_intersect(w, t)) / 3.0 AS coverage, len(list_intersect(w, t)) / len(list_distinct(list_concat(w, t))) AS jaccard, CAST(CASE WHEN list_position(o, 'red') < list_position(o, 'ring') THEN 1 ELSE 0 END AS DOUBLE) AS in_order FROM k)
SELECT p_partkey, round(coverage, 6) AS coverage, round(jaccard, 6) AS jaccard, in_order, CAST(trunc(round((0.5 * coverage + 0.3 * in_order + 0.2 * jaccard) * 100, 6)) AS BIGINT) AS overall FROM s""")
def m05_overall(spark, d):
    """Coverage of terms, Jaccard similarity and order, and the whole percent of their weighted sum."""
    w = F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "))
    t = F.array(*map(F.lit, ("red", "ring", "promo")))
    at = lambda x: F.nullif(F.array_position("w", x), F.lit(0))
    k = table(spark, d, "part").select("p_partkey", w.alias("w"))
    s = k.select("p_partkey", (F.size(F.array_intersect("w", t)) / 3.0).alias("coverage"), V.jaccard(F.col("w"), t).alias("jaccard"), F.when(at("red") < at("ring"), 1.0).otherwise(0.0).alias("in_order"))
    overall = F.round((0.5 * F.col("coverage") + 0.3 * F.col("in_order") + 0.2 * F.col("jaccard")) * 100, 6).cast("long")
    return s.select("p_partkey", F.round("coverage", 6).alias("coverage"), F.round("jaccard", 6).alias("jaccard"), "in_order", overall.alias("overall"))


@query("s05_json_arrays", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s05_arrays(spark, d):
    """Files that hold a JSON array over several lines each, one for each region."""
    path, n = folder(spark, "arrays"), table(spark, d, "nation").withColumn("region", F.col("n_regionkey"))
    rows = F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))
    n.groupBy("region").agg(F.replace(rows, F.lit("},{"), F.lit("},\n{")).alias("json")).write.partitionBy("region").text(path)
    return files.read_json_array(spark, f"{path}/*", "n_nationkey int, n_name string, n_regionkey int")


@query("s14_vector_sink", "SELECT vec_id, len(embedding) AS width, label FROM embeddings")
def s14_sink(spark, d):
    """Vectors written to a table by label, in two batches of which the second repeats the first's last rows, and read again."""
    path, e = folder(spark, "vectors"), table(spark, d, "embeddings")
    files.append_new(e.filter("vec_id % 3 < 2"), path, ["vec_id"])
    files.append_new(e.filter("vec_id % 3 > 0"), path, ["vec_id"])
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("width"), "label")


@query("s16_resumed_load", "SELECT event_id, event_type FROM events")
def s16_resumed(spark, d):
    """A load in steps that stopped after its second of four: it goes on behind what its progress table has, and gives all rows once."""
    path, progress, e = folder(spark, "load"), folder(spark, "progress"), table(spark, d, "events").withColumn("step", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    files.resume(e, path, progress, "step", stop_after=2)
    files.resume(e, path, progress, "step")
    return spark.read.parquet(path).select("event_id", "event_type")


@query("u10_catalog", "SELECT table_name AS name, column_name AS column, ordinal_position - 1 AS position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'documents', 'conversations')")
def u10(spark, d):
    """Columns of tables, as the session's catalog has them."""
    names = ("region", "nation", "customer", "documents", "conversations")
    for name in names:
        table(spark, d, name).createOrReplaceTempView(f"{name}_view")
    return files.columns(spark, [f"{n}_view" for n in names]).select(F.regexp_replace("name", "_view$", "").alias("name"), "column", F.col("position").cast("int").alias("position"))

