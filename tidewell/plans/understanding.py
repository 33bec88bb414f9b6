"""Query understanding and text functions: dictionaries, routing, parsing, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import dictionary as D
from tidewell.functions import text as X
from tidewell.operators import assignment as A
from tidewell.operators import fuzzy as Z
from tidewell.operators import relational as R
from tidewell.plans.registry import AS_OF, CONTACTS, as_of, contacts, query, table

WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}]+'), lambda w: length(w) >= 2))"


@query("f01_normalise", "SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \\n]+', ' ', 'g')) AS text FROM conversations")
def f01(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.collapse(F.col("text")).alias("text"))


@query("f02_compact_key", "SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM part")
def f02(spark, d):
    return table(spark, d, "part").select("p_partkey", R.compact(F.concat_ws("-", "p_name", "p_brand")).alias("key"))


@query("f03_tokens", f"SELECT conv_id, turn, array_to_string(list_sort(list_filter({WORDS.format('text')}, lambda w: w NOT IN ('the', 'of', 'and'))), ' ') AS tokens FROM conversations")
def f03(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(X.tokens(F.col("text"), ("the", "of", "and"))), " ").alias("tokens"))


@query("f04_strip_suffix", "SELECT DISTINCT w, CASE WHEN w LIKE '%ing' AND length(w) >= 5 THEN left(w, length(w) - 3) WHEN w LIKE '%er' AND length(w) >= 4 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 3 THEN left(w, length(w) - 1) ELSE w END AS stem FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")
def f04(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return w.select("w", X.strip_suffix(F.col("w"), ("ing", "er", "s")).alias("stem"))


_DICTIONARY = "k(term, label) AS (VALUES ('small ring', 'jewel'), ('ring', 'round'), ('red', 'colour'), ('blue', 'colour'), ('widget', 'thing'))"
DICTIONARY = [("small ring", "jewel"), ("ring", "round"), ("red", "colour"), ("blue", "colour"), ("widget", "thing")]


@query("f05_longest_match", f"WITH {_DICTIONARY} SELECT p_partkey, first(term ORDER BY length(term) DESC, term) AS term FROM part JOIN k ON contains(p_name, term) GROUP BY p_partkey")
def f05(spark, d):
    k = F.broadcast(spark.createDataFrame(DICTIONARY, "term string, label string"))  # a fixed dictionary
    return table(spark, d, "part").join(k, F.contains("p_name", "term")).groupBy("p_partkey").agg(F.max_by("term", F.length("term")).alias("term"))


_SEQ = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("f05_dictionary_terms", f"""WITH RECURSIVE b AS (SELECT {_SEQ.format("text")} AS w FROM benchmark),
k AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS term, n FROM b, (SELECT unnest(range(1, 400)) AS i) x, (VALUES (2), (3)) y(n) WHERE i + n - 1 <= len(w)),
d AS (SELECT doc_id, {_SEQ.format("text")} AS w FROM documents),
o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT doc_id, i - 1 AS place, max(n) AS size, max_by(term, n) AS term FROM (SELECT doc_id, i, array_to_string(w[i:i + 1], ' ') AS g2, array_to_string(w[i:i + 2], ' ') AS g3 FROM o) JOIN k ON (k.n = 2 AND term = g2) OR (k.n = 3 AND term = g3) GROUP BY ALL),
n AS (SELECT a.doc_id, a.place, a.size, a.term, b.place AS following FROM h a ASOF LEFT JOIN h b ON a.doc_id = b.doc_id AND a.place + a.size <= b.place),
r AS (SELECT n.* FROM n JOIN (SELECT doc_id, min(place) AS place FROM h GROUP BY doc_id) USING (doc_id, place) UNION ALL SELECT n.* FROM r JOIN n ON n.doc_id = r.doc_id AND n.place = r.following)
SELECT doc_id, CAST(place AS INT) AS place, size, term FROM r""".replace("GROUP BY ALL", "GROUP BY doc_id, i"))
def f05_terms(spark, d):
    """Leftmost-longest occurrences of a large dictionary: all sequences of two and three words of the benchmark."""
    w = table(spark, d, "benchmark").select(D.words(F.col("text")).alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")))
    terms = w.select(F.explode(runs(2)).alias("term")).unionByName(w.select(F.explode(runs(3)).alias("term")))
    return D.extract_terms(table(spark, d, "documents"), terms, "doc_id", "text")


@query("f06_canonical", f"WITH {_DICTIONARY} SELECT p_partkey, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM part JOIN k ON contains(replace(p_name, ' ', ''), replace(term, ' ', '')) GROUP BY p_partkey")
def f06(spark, d):
    k = F.broadcast(spark.createDataFrame(DICTIONARY, "term string, label string"))
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return table(spark, d, "part").join(k, F.contains(tight(F.col("p_name")), tight(F.col("term")))).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


@query("f07_token_weight", f"WITH {_DICTIONARY}, w AS (SELECT p_partkey, term, sum(length(t) + 2) AS weight FROM part, (SELECT term, unnest(string_split(term, ' ')) AS t FROM k) WHERE list_contains(string_split(p_name, ' '), t) GROUP BY ALL) SELECT p_partkey, term, CAST(weight AS BIGINT) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rank DESC, length(term), term) <= 3 AND rank = max(rank) OVER (PARTITION BY p_partkey)".replace("rank", "weight"))
def f07(spark, d):
    k = spark.createDataFrame(DICTIONARY, "term string, label string").select("term", F.explode(F.split("term", " ")).alias("t"))
    w = table(spark, d, "part").join(F.broadcast(k), F.array_contains(F.split("p_name", " "), F.col("t"))).groupBy("p_partkey", "term").agg(F.sum(F.length("t") + 2).alias("weight"))
    best = w.withColumn("top", F.max("weight").over(Window.partitionBy("p_partkey"))).filter("weight = top").drop("top")
    return R.top_per_group(best, ["p_partkey"], [F.length("term"), "term"], 3).drop("rn")


@query("f08_fuzzy", "SELECT p_partkey, round(1 - levenshtein(p_name, 'smal rings') / greatest(length(p_name), 10), 6) AS score FROM part WHERE 1 - levenshtein(p_name, 'smal rings') / greatest(length(p_name), 10) >= 0.6")
def f08(spark, d):
    return table(spark, d, "part").select("p_partkey", X.similarity(F.col("p_name"), F.lit("smal rings")).alias("score")).filter("score >= 0.6").withColumn("score", F.round("score", 6))


@query("f09_sound_alike", "SELECT p_partkey, round(1 - levenshtein(regexp_replace(p_name, '[aeiou]', '', 'g'), 'sml rng') / greatest(length(regexp_replace(p_name, '[aeiou]', '', 'g')), 7), 6) AS score FROM part")
def f09(spark, d):
    """Similarity of consonant skeletons, the letter-level form of a phonetic comparison."""
    return table(spark, d, "part").select("p_partkey", F.round(X.similarity(F.regexp_replace("p_name", "[aeiou]", ""), F.lit("sml rng")), 6).alias("score"))


@query("f08_fuzzy_names")
def f08_names(spark, d):
    """Misspelt names (a letter gone, two exchanged, words the other way round) against all names with their types, by weighted ratio."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    n, at = F.col("name"), (F.col("p_partkey") % (F.length("name") - 3) + 2).cast("int")
    gone = F.concat(F.substring(n, F.lit(1), at - 1), F.substring(n, at + 1, F.length(n)))
    swapped = F.concat(F.substring(n, F.lit(1), at - 1), F.substring(n, at + 1, F.lit(1)), F.substring(n, at, F.lit(1)), F.substring(n, at + 2, F.length(n)))
    turned = F.array_join(F.reverse(F.split(n, " ")), " ")
    kind = F.col("p_partkey") % 3
    asked = p.select(F.col("p_partkey").alias("query"), F.when(kind == 0, gone).when(kind == 1, swapped).otherwise(turned).alias("text"))
    return Z.fuzzy_matches(asked, p.select(F.col("name").alias("term")).distinct(), 85.0).withColumn("score", F.round("score", 6))


@query("f08_partial_names")
def f08_partial(spark, d):
    """Names within longer labels, where a letter of them is gone, by partial ratio of 78 or more."""
    n = F.col("p_name")
    at = (F.col("p_partkey") % (F.length(n) - 2) + 2).cast("int")
    label = F.concat_ws(" ", "p_brand", F.concat(F.substring(n, F.lit(1), at - 1), F.substring(n, at + 1, F.length(n))), F.lower("p_type"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("query"), label.alias("text"), "p_name")
    return Z.fuzzy_matches(p, p.select(F.col("p_name").alias("term")).distinct(), 78.0, "partial").withColumn("score", F.round("score", 6))


# Letters as printable ASCII: DuckDB's edit distance counts bytes.
_APART = "array_to_string(list_transform([{0}]::INTEGER[], lambda n: chr(33 + n // 588) || chr(52 + (n % 588) // 28) || CASE n % 28 WHEN 0 THEN '' ELSE {1} END), '')"
_FINAL = "chr(CASE n % 28 " + " ".join(f"WHEN {i + 1} THEN {33 + X.INITIALS.index(ch) if ch in X.INITIALS else 80 + i}" for i, ch in enumerate(X.FINALS)) + " END)"


@query("f09_letters", "WITH s AS (SELECT p_partkey, p_partkey * 37 % 11172 AS a, p_size * 113 % 11172 AS b, (p_partkey * 37 + 28 * (p_size % 3) + p_size % 2) % 11172 AS c FROM part), l AS (SELECT p_partkey, "
    + _APART.format("a, b", _FINAL) + " AS x, " + _APART.format("c, b", _FINAL) + " AS y FROM s) SELECT p_partkey, length(x) AS n, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS score FROM l")
def f09_letters(spark, d):
    """Names of two syllables that the part's numbers give, against nearly the same ones, letter by letter."""
    syllable = lambda n: X.syllable(n % X.SYLLABLES)
    k, z = F.col("p_partkey"), F.col("p_size")
    x, y = F.concat(syllable(k * 37), F.lit(" "), syllable(z * 113)), F.concat(syllable(k * 37 + 28 * (z % 3) + z % 2), syllable(z * 113))
    n = F.length(X.letters(F.replace(x, F.lit(" "), F.lit("")))).cast("long")
    return table(spark, d, "part").select("p_partkey", n.alias("n"), F.round(X.sound_similarity(x, y), 6).alias("score"))


@query("f10_candidate_cascade", "SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN 1.0 WHEN contains(p_name, 'ring') THEN 0.9 WHEN contains(p_name, 'red') THEN 0.8 ELSE round(1 - levenshtein(p_name, 'red ring') / greatest(length(p_name), 8), 6) END AS score FROM part")
def f10(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.when(n == "red ring", 1.0).when(n.contains("ring"), 0.9).when(n.contains("red"), 0.8).otherwise(F.round(X.similarity(n, F.lit("red ring")), 6)).alias("score"))


@query("f10_cascade", """WITH q AS (SELECT p_partkey AS query, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' of ' || lower(p_type) WHEN 2 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name[1:p_partkey % 4] || p_name[p_partkey % 4 + 2:] END AS text FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part), m AS (SELECT query, name, replace(lower(text), ' ', '') AS t, replace(name, ' ', '') AS n, string_split(lower(text), ' ') AS has, string_split(name, ' ') AS words FROM q, n),
s AS (SELECT query, name, list_max([{'score': CASE WHEN t = n THEN 1.0::DOUBLE ELSE -1 END, 'o': 4, 'step': 'exact'}, {'score': CASE WHEN contains(t, n) OR contains(n, t) THEN 0.8::DOUBLE + 0.18::DOUBLE * least(length(t), length(n)) / greatest(length(t), length(n)) ELSE -1 END, 'o': 3, 'step': 'contains'},
  {'score': CASE WHEN list_has_all(has, words) THEN 0.75::DOUBLE ELSE -1 END, 'o': 2, 'step': 'words'}, {'score': 1 - levenshtein(t, n) / greatest(length(t), length(n))::DOUBLE, 'o': 1, 'step': 'sound'}]) AS b FROM m),
r AS (SELECT query, name, round(b.score, 6) AS score, b.step AS step, row_number() OVER (PARTITION BY query ORDER BY round(b.score, 9) DESC, name) AS rank FROM s WHERE b.score >= 0.6) SELECT query, name, score, step, rank FROM r WHERE rank <= 3""")
def f10_cascade(spark, d):
    """Names in capitals, with more words, turned round and misspelt, against all names: the best three by any of four steps."""
    p, n, k = table(spark, d, "part"), F.col("p_name"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(n, F.lit(" of "), F.lower("p_type"))).when(k == 2, F.array_join(F.reverse(F.split(n, " ")), " "))
    text = text.otherwise(F.concat(F.substring(n, F.lit(1), k.cast("int")), F.substring(n, k.cast("int") + 2, F.length(n))))
    out = Z.candidate_cascade(p.select(F.col("p_partkey").alias("query"), text.alias("text")), p.select(n.alias("name")))
    return out.select("query", "name", F.round("score", 6).alias("score"), "step", F.col("rank").cast("long").alias("rank"))


@query("f11_variants", "SELECT v AS variant, min(p_brand) AS canonical FROM (SELECT p_brand, unnest([p_brand, lower(p_brand), replace(p_brand, '#', ' '), replace(p_brand, '#', '')]) AS v FROM part) GROUP BY v")
def f11(spark, d):
    b = F.col("p_brand")
    v = F.array(b, F.lower(b), F.replace(b, F.lit("#"), F.lit(" ")), F.replace(b, F.lit("#"), F.lit("")))
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.explode(v).alias("variant")).groupBy("variant").agg(F.min("p_brand").alias("canonical"))


@query("f12_patterns", "WITH k(pattern, label) AS (VALUES ('^red .*ring$', 'red ring'), ('(small|big) ', 'sized')) SELECT p_partkey, label FROM part JOIN k ON regexp_matches(p_name, pattern)")
def f12(spark, d):
    k = F.broadcast(spark.createDataFrame([("^red .*ring$", "red ring"), ("(small|big) ", "sized")], "pattern string, label string"))
    return table(spark, d, "part").join(k, F.expr("p_name RLIKE pattern")).select("p_partkey", "label")


@query("f13_spans", "SELECT doc_id, len(regexp_extract_all(text, 'the of|of the|the|of')) AS spans FROM documents")
def f13(spark, d):
    """Non-overlapping spans of a term list, the longer terms first."""
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(the of|of the|the|of)"), F.lit(1))).cast("long").alias("spans"))


@query("f14_corrections", "SELECT p_partkey, replace(replace(replace(p_name, 'small ring', 'ringlet'), 'widget', 'gadget'), 'red', 'crimson') AS name FROM part")
def f14(spark, d):
    return table(spark, d, "part").select("p_partkey", X.replace_all(F.col("p_name"), {"red": "crimson", "small ring": "ringlet", "widget": "gadget"}).alias("name"))


@query("f16_route", f"WITH {CONTACTS} SELECT id, CASE WHEN category = 'error' AND value > 20 THEN 'escalate' WHEN category = 'error' THEN 'support' WHEN category IN ('purchase', 'signup') THEN 'sales' WHEN value < 1 THEN 'none' ELSE 'self service' END AS route FROM contacts")
def f16(spark, d):
    c, v = F.col("category"), F.col("value")
    return contacts(spark, d).select("id", F.when((c == "error") & (v > 20), "escalate").when(c == "error", "support").when(c.isin("purchase", "signup"), "sales").when(v < 1, "none").otherwise("self service").alias("route"))


@query("f17_gate", "SELECT conv_id, turn, n, CASE WHEN length(text) < 20 THEN 'none' WHEN n < 2 THEN 'keywords' ELSE 'full' END AS mode FROM (SELECT *, CAST(contains(text, ' the ') AS INT) + CAST(contains(text, ' le ') AS INT) + CAST(contains(text, ' of ') AS INT) + CAST(contains(text, ' de ') AS INT) AS n FROM conversations)")
def f17(spark, d):
    terms = F.array(*map(F.lit, (" the ", " le ", " of ", " de ")))
    c = table(spark, d, "conversations").withColumn("n", F.size(F.filter(terms, lambda t: F.contains("text", t))))
    return c.select("conv_id", "turn", "n", F.when(F.length("text") < 20, "none").when(F.col("n") < 2, "keywords").otherwise("full").alias("mode"))


GROUPS = [("jewel", ("ring",)), ("colour", ("red", "blue")), ("size", ("small", "big"))]


@query("f18_labels", "SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'ring') THEN 'jewel' END, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' END, CASE WHEN contains(p_name, 'small') OR contains(p_name, 'big') THEN 'size' END) AS labels, CASE WHEN contains(p_name, 'ring') THEN 'jewel' WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' WHEN contains(p_name, 'small') OR contains(p_name, 'big') THEN 'size' ELSE 'other' END AS first FROM part")
def f18(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.labels(F.col("p_name"), GROUPS), ",").alias("labels"), X.first_label(F.col("p_name"), GROUPS, "other").alias("first"))


@query("f19_largest_subset", "WITH k(pos, label, keys) AS (VALUES (1, 'a', ['red', 'ring']), (2, 'b', ['ring']), (3, 'c', ['red', 'bolt'])) SELECT p_partkey, first(label ORDER BY len(keys) DESC, pos) AS label FROM part JOIN k ON list_has_all(string_split(p_name, ' '), keys) GROUP BY p_partkey")
def f19(spark, d):
    k = F.broadcast(spark.createDataFrame([(1, "a", ["red", "ring"]), (2, "b", ["ring"]), (3, "c", ["red", "bolt"])], "pos int, label string, keys array<string>"))
    j = table(spark, d, "part").join(k, F.size(F.array_except("keys", F.split("p_name", " "))) == 0)
    return j.groupBy("p_partkey").agg(F.max_by("label", F.struct(F.size("keys"), -F.col("pos"))).alias("label"))


@query("f20_transition_score", f"WITH {CONTACTS}, t AS (SELECT customer, min_by(category, (ts, id)) AS early, max_by(category, (ts, id)) AS late FROM contacts GROUP BY customer) SELECT customer, CASE WHEN early = 'error' AND late = 'purchase' THEN 2 WHEN early = 'error' THEN 1 WHEN late = 'error' THEN -2 ELSE 0 END AS score FROM t")
def f20(spark, d):
    t = contacts(spark, d).groupBy("customer").agg(F.min_by("category", F.struct("ts", "id")).alias("early"), F.max_by("category", F.struct("ts", "id")).alias("late"))
    return t.select("customer", F.when((F.col("early") == "error") & (F.col("late") == "purchase"), 2).when(F.col("early") == "error", 1).when(F.col("late") == "error", -2).otherwise(0).alias("score"))


@query("f21_unit_numbers", "SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 + p_partkey % 7 * 1000000 AS n FROM part")
def f21(spark, d):
    written = F.concat((F.col("p_partkey") % 7).cast("string"), F.lit("m "), F.col("p_size").cast("string"), F.lit("k"))
    return table(spark, d, "part").select("p_partkey", X.number_of_units(written, {"m": 1_000_000, "k": 1000}).alias("n"))


@query("f22_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 14 AS VARCHAR) AS ends, CAST(o_orderdate AS DATE) + 14 >= DATE '2001-01-01' AS active FROM orders")
def f22(spark, d):
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    day = F.coalesce(F.try_to_timestamp(written, F.lit("yyyy.MM.dd")), F.try_to_timestamp(written, F.lit("dd/MM/yyyy"))).cast("date")
    o = table(spark, d, "orders").withColumn("ends", F.date_add(day, 14))
    return o.select("o_orderkey", F.col("ends").cast("string").alias("ends"), (F.col("ends") >= F.lit("2001-01-01").cast("date")).alias("active"))


@query("f23_classify", "SELECT s_suppkey, CASE WHEN s_name LIKE '%1' THEN 'first' WHEN s_name LIKE '%2%' THEN 'second' ELSE 'other' END AS kind FROM supplier")
def f23(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_name").endswith("1"), "first").when(F.col("s_name").contains("2"), "second").otherwise("other").alias("kind"))


@query("f24_priority", "SELECT p_partkey, greatest(1, least(10, CAST(floor(CAST(0.6 AS DOUBLE) * (p_partkey % 12) + CAST(0.4 AS DOUBLE) * p_size / 5) AS BIGINT))) AS priority FROM part")
def f24(spark, d):
    raw = F.floor(0.6 * (F.col("p_partkey") % 12) + 0.4 * F.col("p_size") / 5)
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(1), F.least(F.lit(10), raw)).alias("priority"))


@query("f25_pseudonym", "SELECT c_custkey, 'C' || left(md5(c_name), 8) AS alias FROM customer")
def f25(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), F.substring(F.md5("c_name"), 1, 8)).alias("alias"))


@query("f26_phone_mask", "SELECT c_custkey, regexp_replace('010' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '^([0-9]{3})([0-9]{4})([0-9]{4})$', '\\1-****-\\3') AS phone FROM customer")
def f26(spark, d):
    digits = F.concat(F.lit("010"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(digits, r"^(\d{3})(\d{4})(\d{4})$", "$1-****-$3").alias("phone"))


@query("f27_json", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, json_exists(props, '$.z') AS has_z FROM events")
def f27(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.z").isNotNull().alias("has_z"))


@query("f28_arrays", "SELECT p_partkey, len(w) AS n, list_contains(w, 'ring') AS ring, list_has_any(w, ['red', 'blue']) AS coloured FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def f28(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.size(w).cast("long").alias("n"), F.array_contains(w, "ring").alias("ring"), F.arrays_overlap(w, F.array(F.lit("red"), F.lit("blue"))).alias("coloured"))


@query("f29_math", "SELECT p_partkey, round(1 / log2(p_size + 1), 6) AS discount, round(sqrt(p_retailprice), 4) AS root, least(greatest(p_size, 10), 40) AS clipped FROM part WHERE p_size > 0")
def f29(spark, d):
    return table(spark, d, "part").filter("p_size > 0").select("p_partkey", F.round(1 / F.log2(F.col("p_size") + 1), 6).alias("discount"), F.round(F.sqrt("p_retailprice"), 4).alias("root"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clipped"))


@query("f30_vocabulary", "SELECT DISTINCT p_brand, w FROM (SELECT p_brand, w, row_number() OVER (PARTITION BY p_brand ORDER BY w) AS r FROM (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)) WHERE r <= 5")
def f30(spark, d):
    w = table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).dropDuplicates()
    return R.top_per_group(w, ["p_brand"], ["w"], 5).drop("rn")


@query("t01_mask_runs")
def t01(spark, d):
    """Look-around patterns, which the SQL side's regular expressions lack."""
    run = F.concat_ws(" ", F.repeat(F.lit("*"), (F.col("p_size") % 18).cast("int")), "p_name")
    return table(spark, d, "part").select("p_partkey", X.normalise_masks(run).alias("text"))


@query("t02_residual_masks", "SELECT doc_id, len(regexp_extract_all(text, '[*#$%&]{3}')) AS marks, regexp_matches(text, '\\[[A-Z]+\\]') AS tagged FROM documents")
def t02(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[*#$%&]{3}")).cast("long").alias("marks"), F.col("text").rlike(r"\[[A-Z]+\]").alias("tagged"))


@query("t03_merge_tags", "SELECT p_partkey, regexp_replace(p_name || ' [T][T] [T][T][T]', '(\\[T\\]){3,}', '[T]', 'g') AS text FROM part")
def t03(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.concat("p_name", F.lit(" [T][T] [T][T][T]")), r"(\[T\]){3,}", "[T]").alias("text"))


@query("t04_fillers", """WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[ \\n]+'), lambda w: {'w': w, 'k': lower(regexp_replace(w, '[.,;:!?]+$', ''))}), lambda x: x.k NOT IN ('the', 'of', 'le', 'de')) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(w, lambda x, i: i = 1 OR x.k = '' OR x.k <> w[i - 1].k), lambda x: x.w), ' ') AS text FROM w""")
def t04(spark, d):
    """Filler words go, and of a word that is said again and again the first stays."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.without_fillers(F.col("text"), ("the", "of", "le", "de")).alias("text"))


@query("t05_redact", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \\t\\n]+', '[URL]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '\\+?[0-9][0-9() -]{7,}[0-9]', '[PHONE]', 'g')) AS digest FROM documents")
def t05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text"))).alias("digest"))


@query("t06_rule_keywords", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(p_name, 'ring') THEN 'ring' END, CASE WHEN p_size > 30 THEN 'large' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END, CASE WHEN contains(p_name, 'red') THEN 'red' END], lambda x: x IS NOT NULL)[1:2], ',') AS tags FROM part")
def t06(spark, d):
    rules = [("ring", F.col("p_name").contains("ring")), ("large", F.col("p_size") > 30), ("promo", F.col("p_type") == "PROMO"), ("red", F.col("p_name").contains("red"))]
    tags = F.filter(F.array(*(F.when(fits, F.lit(tag)) for tag, fits in rules)), lambda x: x.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.array_join(F.slice(tags, 1, 2), ",").alias("tags"))


@query("t08_assign_ids", "SELECT lang || '_' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS VARCHAR), 6, '0') AS id, doc_id FROM documents")
def t08(spark, d):
    n = R.numbered(table(spark, d, "documents").select("lang", "doc_id"), [F.col("doc_id")], "n", ["lang"])
    return n.select(F.concat_ws("_", "lang", F.lpad(F.col("n").cast("string"), 6, "0")).alias("id"), "doc_id")


@query("t09_chunks")
def t09(spark, d):
    """Sentences packed greedily into chunks of 400 characters."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.pack(X.sentences(F.col("text")), 400)).alias("chunk", "text"))


@query("t10_paragraph_chunks")
def t10(spark, d):
    """Sections, their paragraphs packed into chunks of about 600 tokens at four characters each; no chunk crosses a section."""
    chunks = X.section_chunks(F.col("text"), 600)
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "c")).select("doc_id", "chunk", "c.heading", "c.text", F.ceil(F.length("c.text") / 4).alias("tokens"))


@query("t11_sentences", "SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS n FROM documents")
def t11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query("t12_repeated_blocks", "SELECT doc_id, len(list_distinct(string_split(text, chr(10)))) AS blocks FROM documents")
def t12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", "\n"))).cast("long").alias("blocks"))


@query("t13_url_normalise", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS url FROM pages")
def t13(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "/+$", "").alias("url"))


@query("t14_brand_replacement", "SELECT p_partkey, replace(replace(p_brand, 'Brand#1', 'Alpha '), 'Brand#2', 'Beta ') AS brand FROM part")
def t14(spark, d):
    return table(spark, d, "part").select("p_partkey", X.replace_all(F.col("p_brand"), {"Brand#1": "Alpha ", "Brand#2": "Beta "}).alias("brand"))


@query("t15_invert_dictionary", "SELECT w, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def t15(spark, d):
    return table(spark, d, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("t16_stratified_sample", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= least(20, greatest(3, count(*) OVER (PARTITION BY lang) // 10))")
def t16(spark, d):
    """A tenth of each language, 3 at least and 20 at most; tasks keep 20 each before the shuffle."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    n = docs.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    top = R.top_per_group(docs, ["lang"], [F.desc("n_chars"), "doc_id"], 20, "r")
    return top.join(n, F.col("lang").eqNullSafe(F.col("of"))).filter(F.col("r") <= F.greatest(F.lit(3), F.expr("n div 10"))).select("doc_id", "lang")


@query("t17_balanced_assignment", "SELECT agent, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) % 12 AS agent FROM events) GROUP BY agent")
def t17(spark, d):
    """Round robin in a pseudo-random order."""
    e = table(spark, d, "events").select(F.md5(F.col("event_id").cast("string")).alias("h"))
    return R.numbered(e, [F.col("h")], "n").withColumn("agent", F.col("n") % 12).groupBy("agent").agg(F.count("*").alias("n"))


_LOADS = "SELECT s_suppkey, CAST(coalesce(load, 0) AS BIGINT) AS load FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS load FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) ON l_suppkey = s_suppkey"


def loaded_suppliers(spark, d):
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("load"))
    return table(spark, d, "supplier").join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.coalesce("load", F.lit(0)).alias("load"))


_FILLED = f"""WITH a AS ({_LOADS}), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place FROM orders),
top AS (SELECT max(load) + (SELECT count(*) FROM orders) // (SELECT count(*) FROM supplier) + 1 AS level FROM a),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY level, load, s_suppkey) AS place FROM (SELECT *, unnest(range(load, (SELECT level FROM top))) AS level FROM a)),
m AS (SELECT o_orderkey, s_suppkey FROM o JOIN s USING (place))"""


def filled(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return A.least_loaded(orders, "o_orderkey", loaded_suppliers(spark, d), "s_suppkey", "load", [F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey")])


@query("t17_least_loaded", f"{_FILLED} SELECT * FROM m")
def t17_least(spark, d):
    """Orders in a pseudo-random order to the supplier with the least load, returned lines being the load so far."""
    return filled(spark, d)


@query("t17_validation", f"{_FILLED}, n AS (SELECT load + coalesce(new, 0) AS n FROM a LEFT JOIN (SELECT s_suppkey, count(*) AS new FROM m GROUP BY s_suppkey) USING (s_suppkey)) SELECT count(*) AS agents, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation, min(n) AS least, max(n) AS most, stddev_pop(n) <= 15 AND max(n) - min(n) <= 50 AS passed FROM n")
def t17_validation(spark, d):
    out = A.balance(filled(spark, d), loaded_suppliers(spark, d), "s_suppkey", "load", 15, 50)
    return out.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("t18_seeded_rows", """WITH u AS (SELECT c_custkey, n, CAST('0x' || substring(md5('11:' || c_custkey || ':' || n), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM customer, range(3) r(n))
SELECT c_custkey, n, CASE WHEN u < 0.4 THEN 'a' WHEN u < 0.75 THEN 'b' ELSE 'c' END AS kind FROM u""")
def t18(spark, d):
    """Three made-up rows for each customer, of kinds with given weights, by a seeded hash: any task gives the same ones."""
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("n"))
    return rows.select("c_custkey", "n", X.weighted_choice({"a": 0.4, "b": 0.35, "c": 0.25}, 11, "c_custkey", "n").alias("kind"))


@query("t19_structured_fields", "SELECT doc_id, regexp_extract(text, 'ersion ([0-9.]*[0-9])', 1) AS version, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def t19(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "ersion ([0-9.]*[0-9])", 1).alias("version"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("t20_backfill", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE 'Brand#2%' THEN 'two' END AS kind FROM part")
def t20(spark, d):
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_type")), F.when(b.startswith("Brand#1"), "one").when(b.startswith("Brand#2"), "two")).alias("kind"))


@query("s07_html_text")
def s07(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))


@query("n01_map_category", f"WITH {CONTACTS} SELECT id, coalesce(CASE replace(category, 'sign', 'log') WHEN 'logup' THEN 'account' WHEN 'click' THEN 'web' END, CASE WHEN contains(category, 'err') THEN 'fault' ELSE 'other' END) AS main FROM contacts")
def n01(spark, d):
    known = F.create_map(*map(F.lit, ("logup", "account", "click", "web")))
    norm = X.replace_all(F.col("category"), {"sign": "log"})
    return contacts(spark, d).select("id", F.coalesce(F.try_element_at(known, norm), X.first_label(F.col("category"), [("fault", ("err",))], "other")).alias("main"))


@query("n03_business_days", f"""WITH {CONTACTS}, l AS (SELECT max(day) AS last FROM contacts), x AS (SELECT CAST(unnest(generate_series(last - 20, last, INTERVAL 1 DAY)) AS DATE) AS x FROM l),
b AS (SELECT x FROM x WHERE isodow(x) <= 5 ORDER BY x DESC LIMIT 10) SELECT CAST(x AS VARCHAR) AS day, count(id) AS n FROM b LEFT JOIN contacts ON day = x GROUP BY x""")
def n03(spark, d):
    """The last ten weekdays up to the last contact, and the contacts of each."""
    daily = contacts(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    days = X.last_weekdays(daily.agg(F.max("day").alias("last")), "last", 10).join(daily, "day", "left")
    return days.select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("n05_timeline", "SELECT event_id, i, CAST(trunc(value) AS BIGINT) * i // 4 AS at FROM events, range(0, 4) t(i)")
def n05(spark, d):
    return table(spark, d, "events").select("event_id", F.col("value").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select("event_id", F.col("j").cast("long").alias("i"), F.expr("n * j div 4").alias("at"))


@query("n06_end_time", f"WITH {CONTACTS} SELECT id, strftime(ts + to_seconds(CAST(split_part(duration, ':', 1) AS BIGINT) * 60 + CAST(split_part(duration, ':', 2) AS BIGINT)), '%H:%M:%S') AS ends FROM contacts")
def n06(spark, d):
    return contacts(spark, d).select("id", F.date_format(F.col("ts") + F.make_dt_interval(secs=R.duration_seconds("duration")), "HH:mm:ss").alias("ends"))


@query("n08_expected_distribution", "WITH k(o_orderstatus, share) AS (VALUES ('F', 0.5), ('O', 0.3), ('X', 0.2)) SELECT o_orderstatus, share, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM orders) - share, 6) AS difference FROM (SELECT o_orderstatus, CAST(share AS DOUBLE) AS share FROM k) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) USING (o_orderstatus)")
def n08(spark, d):
    want = spark.createDataFrame([("F", 0.5), ("O", 0.3), ("X", 0.2)], "o_orderstatus string, share double")
    o = table(spark, d, "orders")
    n = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    j = want.join(n, "o_orderstatus", "left").crossJoin(o.agg(F.count("*").alias("all")))
    return j.select("o_orderstatus", "share", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("all") - F.col("share"), 6).alias("difference"))


@query("n09_truncation", "SELECT conv_id, turn, length(text) < 0.3 * avg(length(text)) OVER (PARTITION BY conv_id) AND NOT ends_with(text, '.') AS cut FROM conversations")
def n09(spark, d):
    mean = F.avg(F.length("text")).over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", ((F.length("text") < 0.3 * mean) & ~F.col("text").endswith(".")).alias("cut"))


@query("n10_add_patterns", "SELECT k, array_to_string(list_sort(list_distinct(list(p))), ',') AS patterns FROM (SELECT p_type AS k, p_brand AS p FROM part WHERE p_size > 40 UNION SELECT p_type, 'x.*' FROM part) GROUP BY k")
def n10(spark, d):
    p = table(spark, d, "part")
    have = p.filter("p_size > 40").select(F.col("p_type").alias("k"), F.col("p_brand").alias("p")).distinct()
    return R.insert_new(have, p.select(F.col("p_type").alias("k"), F.lit("x.*").alias("p")), ["k", "p"]).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("patterns"))


@query("n17_canonical_names", "SELECT regexp_extract(p_name, '([a-z]+)$', 1) AS name, min(p_partkey) AS id FROM part GROUP BY 1")
def n17(spark, d):
    return table(spark, d, "part").groupBy(F.regexp_extract("p_name", "([a-z]+)$", 1).alias("name")).agg(F.min("p_partkey").alias("id"))


@query("n30_split_at_marker", "SELECT doc_id, CASE WHEN instr(text, ' and ') > 0 THEN left(text, instr(text, ' and ') - 1) ELSE text END AS head FROM documents")
def n30(spark, d):
    at = F.instr("text", " and ")
    return table(spark, d, "documents").select("doc_id", F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("head"))


@query("n31_dangling_references", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)")
def n31(spark, d):
    p = table(spark, d, "part").filter("p_size <> 7")
    return table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_orderkey", "l_partkey")


@query("n32_context_pack", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS pack FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 800 GROUP BY conv_id")
def n32(spark, d):
    b = R.bounded(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.length("text"), 800)
    return b.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.array_join("x.text", "\n").alias("pack"))
