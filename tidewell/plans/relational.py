"""Scans, predicates, joins, aggregates, windows, sorts and set operations over contact records."""

from __future__ import annotations

from functools import reduce

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import assignment as A
from tidewell.operators import relational as R
from tidewell.sources import files
from tidewell.plans.registry import AS_OF, CONTACTS, as_of, contacts, query, table

D = f"DATE '{AS_OF}'"


@query("s01_table_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 100")
def s01(spark, d):
    return R.scan(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, 100, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s02_uniform_sources", """SELECT 'part' AS kind, p_partkey AS id, p_name || ' ' || p_type AS content, p_brand AS label FROM part
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""")
def s02(spark, d):
    parts = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("content"), F.col("p_brand").alias("label"))
    suppliers = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("content"))
    return parts.unionByName(suppliers, allowMissingColumns=True)


@query("s03_multi_get", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (3, 17, 42, 99, 1000000)")
def s03(spark, d):
    return R.multi_get(table(spark, d, "documents"), "doc_id", [3, 17, 42, 99, 1000000]).select("doc_id", "lang", "n_chars")


def folder(spark, name):
    """A new folder for files that a query writes and reads again."""
    return f"{R.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s04_csv_scan", "SELECT p_partkey, p_name || ', \"' || p_type || '\"' AS title, p_size FROM part")
def s04(spark, d):
    """A CSV round trip, with quotes and commas in a field."""
    path = folder(spark, "csv")
    files.write_csv(table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("title"), "p_size"), path)
    return files.read_csv(spark, path, "p_partkey long, title string, p_size int")


@query("s05_json_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s05(spark, d):
    """JSON arrays, one for each region."""
    path, n = folder(spark, "json"), table(spark, d, "nation")
    n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("json")).select("json").write.text(path)
    return spark.read.text(path).select(F.inline(F.from_json("value", "array<struct<n_nationkey:int,n_name:string,n_regionkey:int>>")))


#: Items of a file that a query writes for itself.
FILE_ITEMS = 1_000


@query("s06_section_scan", "SELECT item_id, 'body' AS title, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM benchmark")
def s06(spark, d):
    """Markdown files with many sections each."""
    path, b = folder(spark, "md"), table(spark, d, "benchmark")
    b.select(F.concat(F.lit("## body "), "item_id", F.lit("\n"), "text").alias("text")).repartition(-(-b.count() // FILE_ITEMS) + 1).write.text(path)
    heading = r"^(\w+) (\d+)$"
    return files.read_sections(spark, path).select(F.regexp_extract("title", heading, 2).cast("long").alias("item_id"), F.regexp_extract("title", heading, 1).alias("title"), "body")


@query("s09_load_chunks", "SELECT item_id % 8 AS part, md5(regexp_replace(string_agg(text, '' ORDER BY item_id), '[ \\t\\n\\r]+', '', 'g')) AS digest, true AS packed, true AS in_a_row FROM benchmark GROUP BY item_id % 8")
def s09(spark, d):
    """A folder of texts as chunks of 500 characters with running ids from 100 on: each file's chunks hold its text, and their ids follow each other."""
    path, b = folder(spark, "txt"), table(spark, d, "benchmark")
    b.select("text", (F.col("item_id") % 8).alias("part"), "item_id").repartition("part").sortWithinPartitions("part", "item_id").select("text", "part").write.partitionBy("part").text(path)
    chunks = R.cut(files.load_chunks(spark, f"{path}/*", 500, 99).withColumn("part", F.regexp_extract("path", r"part=(\d+)", 1).cast("long")))
    whole = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), ""), r"[ \t\n\r]+", "")
    one = F.size(X.sentences(F.col("text"))) <= 1  # a sentence that is longer is a chunk of its own
    run = (F.max("id") - F.min("id") + 1 == F.count("*")) & (F.min("id") >= 100)
    return chunks.groupBy("part").agg(F.md5(whole).alias("digest"), F.bool_and((F.length("text") <= 500) | one).alias("packed"), run.alias("in_a_row"))


@query("s18_export", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0")
def s18(spark, d):
    """Filtered rows to a file for spreadsheets, read again."""
    path = folder(spark, "export")
    files.write_csv(table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY' AND c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("s10_next_id", "SELECT coalesce(max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)), 0) + 1 AS next_id FROM customer")
def s10(spark, d):
    return R.next_number(table(spark, d, "customer"), "c_name")


@query("s11_insert_new", "SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN p_brand ELSE 'new' END AS label FROM part")
def s11(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_size").alias("size"))
    return R.insert_new(p.filter("size <= 25").drop("size"), p.drop("size").withColumn("label", F.lit("new")), ["id"])


@query("s12_upsert", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN upper(p_brand) ELSE p_brand END AS label, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS BIGINT) END AS size FROM part""")
def s12(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_size").cast("long").alias("size"))
    new = p.filter("id % 3 > 0").select("id", F.upper("label").alias("label"), F.lit(None).cast("long").alias("size"))
    return R.upsert(p.filter("id % 3 < 2"), new, ["id"], keep_old=["size"])


@query("s13_update_or_insert", """SELECT o_custkey AS id, max(o_totalprice) AS best FROM orders GROUP BY o_custkey
UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def s13(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("best"))
    return R.upsert(base, table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("best")), ["id"])


@query("s15_append_unseen", "SELECT event_id FROM events")
def s15(spark, d):
    e = table(spark, d, "events").select("event_id")
    return R.insert_new(e.filter("event_id % 3 = 0"), e, ["event_id"])


@query("s17_merge_sources", "SELECT CASE WHEN source IN ('src1', 'src2', 'src3') THEN source ELSE 'rest' END AS origin, count(*) AS n FROM documents GROUP BY ALL")
def s17(spark, d):
    docs = table(spark, d, "documents")
    named = ("src1", "src2", "src3")
    outputs = {s: docs.filter(F.col("source") == s).select("doc_id") for s in named}
    outputs["rest"] = docs.filter(~F.coalesce(F.col("source").isin(*named), F.lit(False))).select("doc_id")
    return R.union_sources(outputs).groupBy("origin").agg(F.count("*").alias("n"))


@query("p01_optional_filters", f"WITH {CONTACTS} SELECT count(*) AS n FROM contacts WHERE (category = 'click' OR category = 'view') AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def p01(spark, d):
    c = contacts(spark, d)
    given = [F.col("category").isin("click", "view"), F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date"))]
    return reduce(lambda x, f: x.filter(f), given, c).agg(F.count("*").alias("n"))


@query("p02_duration_parse", f"WITH {CONTACTS} SELECT id, duration, CAST(split_part(duration, ':', 1) AS BIGINT) * 60 + CAST(split_part(duration, ':', 2) AS BIGINT) AS seconds FROM contacts")
def p02(spark, d):
    return contacts(spark, d).select("id", "duration", R.duration_seconds("duration").cast("long").alias("seconds"))


@query("p03_dynamic_predicate", """SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'STANDARD', 'ECONOMY') OR (lower(p_name) LIKE '%re%' AND NOT lower(p_brand) LIKE '%1%') AND CAST(p_partkey AS VARCHAR) LIKE '1%'""")
def p03(spark, d):
    names, none = R.contains_any(["p_name"], ["re"]), ~R.contains_any(["p_brand"], ["1"])
    return table(spark, d, "part").filter(F.col("p_type").isin("PROMO", "STANDARD", "ECONOMY") | (names & none & F.col("p_partkey").cast("string").startswith("1"))).select("p_partkey")


@query("p04_ilike_group", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%version%' OR lower(source) LIKE '%license%' OR lower(source) LIKE '%version%'")
def p04(spark, d):
    return table(spark, d, "documents").filter(R.contains_any(["text", "source"], ["License", "version"])).select("doc_id")


@query("p05_like_any", "SELECT c_custkey FROM customer WHERE (c_mktsegment ILIKE 'auto%' OR c_mktsegment ILIKE '%ING') AND NOT (c_name LIKE '%1' OR c_name LIKE '%2')")
def p05(spark, d):
    return table(spark, d, "customer").filter(R.like_any("c_mktsegment", ["auto%", "%ING"], True) & ~R.like_any("c_name", ["%1", "%2"])).select("c_custkey")


@query("p06_scope_filter", "SELECT source, count(*) AS n FROM documents WHERE source LIKE 'src_' GROUP BY source")
def p06(spark, d):
    scopes = {"single": F.col("source").like("src_"), "all": F.lit(True)}  # _ stands for any character
    return table(spark, d, "documents").filter(scopes["single"]).groupBy("source").agg(F.count("*").alias("n"))


@query("p07_scope_choice", "SELECT doc_id, CASE WHEN lang = 'en' AND n_chars > 2000 THEN 'A' WHEN lang = 'en' THEN 'B' ELSE 'C' END AS policy FROM documents")
def p07(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when((F.col("lang") == "en") & (F.col("n_chars") > 2000), "A").when(F.col("lang") == "en", "B").otherwise("C").alias("policy"))


@query("p08_activity_tier", f"""WITH {CONTACTS} SELECT customer, date_diff('day', max(day), {D}) AS idle, CASE WHEN date_diff('day', max(day), {D}) <= 2 THEN 'active'
WHEN date_diff('day', max(day), {D}) <= 4 THEN 'recent' ELSE 'dormant' END AS tier, 100 - date_diff('day', max(day), {D}) * 10 // 3 AS relevance FROM contacts GROUP BY customer""")
def p08(spark, d):
    idle = F.datediff(as_of(), F.col("last"))
    c = contacts(spark, d).groupBy("customer").agg(F.max("day").alias("last"))
    return c.select("customer", idle.cast("long").alias("idle"), R.tier(idle, [(2, "active"), (4, "recent")], "dormant").alias("tier"), F.expr(f"cast(100 - datediff(date'{AS_OF}', last) * 10 div 3 as bigint)").alias("relevance"))


@query("p09_freshness", f"""SELECT c_custkey, CAST(coalesce(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01'), 9999) AS BIGINT) AS age,
CASE WHEN coalesce(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01'), 9999) <= 90 THEN 'valid' WHEN coalesce(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01'), 9999) <= 365 THEN 'stale' ELSE 'outdated' END AS state
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def p09(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    age = F.coalesce(F.datediff(F.lit("2001-08-01").cast("date"), "last"), F.lit(9999))
    return table(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", age.cast("long").alias("age"), R.tier(age, [(90, "valid"), (365, "stale")], "outdated").alias("state"))


@query("p10_safe_ratio", "SELECT o_custkey, CAST(round(CAST(count(*) FILTER (o_orderstatus = 'F') AS DECIMAL(20,4)) / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0) * 100, 1) AS DOUBLE) AS percent FROM orders GROUP BY o_custkey")
def p10(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") != "P").alias("b"))
    return g.select("o_custkey", R.safe_percent(F.col("a"), F.col("b")).alias("percent"))


@query("p11_age", "SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-01-31') AS BIGINT) AS years FROM orders")
def p11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.floor(F.months_between(as_of(), F.to_date("o_orderdate")) / 12).cast("long").alias("years"))


@query("p12_presentation", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS status,
left(coalesce(nullif(trim(c_name), ''), 'unknown'), 12) AS who, c_mktsegment || ' > ' || o_orderpriority AS category FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def p12(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "open").otherwise("pending")
    return o.select("o_orderkey", status.alias("status"), F.substring(F.coalesce(R.first_filled("c_name"), F.lit("unknown")), 1, 12).alias("who"), F.concat("c_mktsegment", F.lit(" > "), "o_orderpriority").alias("category"))


@query("p13_keep_if_none", """SELECT o_orderkey, o_custkey FROM (SELECT *, bool_or(o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey) AS found FROM orders) WHERE o_orderpriority = '1-URGENT' OR NOT found""")
def p13(spark, d):
    return R.keep_if_none(table(spark, d, "orders"), "o_custkey", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")


@query("p14_floor_but_one", """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE o_totalprice >= 200000 OR r = 1""")
def p14(spark, d):
    return R.floor_but_one(table(spark, d, "orders"), "o_custkey", "o_totalprice", 200000, "o_orderkey").select("o_orderkey", "o_custkey")


@query("p15_multi_field_search", f"WITH {CONTACTS} SELECT id FROM contacts WHERE (contains(CAST(customer AS VARCHAR), '12') OR contains(category, '12') OR contains(props, '12')) AND category <> 'error' AND day >= DATE '2024-01-10'")
def p15(spark, d):
    c = contacts(spark, d).withColumn("who", F.col("customer").cast("string"))
    return c.filter(R.contains_any(["who", "category", "props"], ["12"]) & (F.col("category") != "error") & (F.col("day") >= F.lit("2024-01-10").cast("date"))).select("id")


@query("p16_compact_match", "SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g'), 'redw') AND NOT contains(lower(p_type), 'promo')")
def p16(spark, d):
    return table(spark, d, "part").filter(F.contains(R.compact(F.col("p_name")), F.lit("redw")) & ~R.contains_any(["p_type"], ["promo"])).select("p_partkey")


@query("p17_prune_empty")
def p17(spark, d):
    """Null and empty values go from a record's JSON at every depth, and what is empty by that."""
    brand, note = F.when(F.col("p_size") > 25, F.col("p_brand")), F.when(F.col("p_size") > 40, F.lit(""))
    card = F.to_json(F.struct("p_name", F.struct(brand.alias("brand"), F.struct(note.alias("note")).alias("more")).alias("details"), F.array(note, brand).alias("list")), {"ignoreNullFields": "false"})
    return table(spark, d, "part").select("p_partkey", X.json_pruned(card).alias("card"))


@query("p18_random_pick", "SELECT * FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 1")
def p18(spark, d):
    """One customer, by a seeded hash: the same one however the table is partitioned."""
    return table(spark, d, "customer").orderBy(F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string"))), "c_custkey").limit(1)


@query("j01_enrich", "SELECT o_orderkey, coalesce(c_name, 'unknown') AS who, coalesce(n_name, 'none') AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j01(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return o.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("who"), F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("j02_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def j02(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("j03_inner", "SELECT c_mktsegment, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def j03(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j04_orphans", """SELECT 'customer' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def j04(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_anti").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id")).unionByName(o.join(c, on, "left_anti").select(F.lit("orders").alias("side"), F.col("o_orderkey").alias("id")))


_RECONTACT = f"""WITH {CONTACTS} SELECT id, customer, category, EXISTS (SELECT 1 FROM contacts b WHERE b.customer = a.customer AND b.category = a.category
AND b.day > a.day AND b.day <= a.day + 7) AS again FROM contacts a"""


@query("j05_recontact", f"SELECT id FROM ({_RECONTACT}) WHERE again")
def j05(spark, d):
    c = contacts(spark, d)
    return c.withColumn("again", R.recontacted(c, ["customer", "category"], "day")).filter("again").select("id")


@query("j06_recontact_flag", _RECONTACT)
def j06(spark, d):
    c = contacts(spark, d)
    return c.select("id", "customer", "category", R.recontacted(c, ["customer", "category"], "day").alias("again"))


@query("j08_keyword_trend", f"""WITH {CONTACTS}, k(keyword) AS (VALUES ('cl'), ('e'), ('sign'), ('zz'))
SELECT keyword, count(*) FILTER (day > {D} - 7 AND category IS NOT NULL) AS this_week, count(*) FILTER (day <= {D} - 7 AND day > {D} - 14) AS last_week
FROM k LEFT JOIN contacts ON contains(category, keyword) AND day > {D} - 14 GROUP BY keyword""")
def j08(spark, d):
    keywords = spark.createDataFrame([("cl",), ("e",), ("sign",), ("zz",)], "keyword string")
    # Contacts are first counted by category and day: the theta join then sees a few hundred rows, whatever their number.
    daily = contacts(spark, d).filter(F.col("day") > F.date_sub(as_of(), 14)).groupBy("category", "day").agg(F.count("*").alias("n"))
    j = keywords.join(daily, F.contains("category", "keyword"), "left")
    recent = F.col("day") > F.date_sub(as_of(), 7)
    return j.groupBy("keyword").agg(F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("this_week"), F.coalesce(F.sum(F.when(~recent, F.col("n"))), F.lit(0)).alias("last_week"))


@query("j09_one_row_cross", f"WITH {CONTACTS} SELECT category, round(count(*) / any_value(days), 4) AS per_day FROM contacts, (SELECT count(DISTINCT day) AS days FROM contacts) GROUP BY category")
def j09(spark, d):
    c = contacts(spark, d)
    days = c.agg(F.count_distinct("day").alias("days"))
    return c.groupBy("category").agg(F.count("*").alias("n")).crossJoin(days).select("category", F.round(F.col("n") / F.col("days"), 4).alias("per_day"))


@query("j10_lateral_top", "SELECT n_nationkey, c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3)")
def j10(spark, d):
    return R.top_per_group(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")


@query("j11_count_mismatch", "SELECT c_custkey, c_custkey % 20 AS stated, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS actual FROM customer WHERE c_custkey % 20 <> (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)")
def j11(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("actual"))
    j = table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", (F.col("c_custkey") % 20).alias("stated"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return j.filter("stated <> actual")


@query("j12_in_limited", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT DISTINCT s_nationkey FROM supplier ORDER BY s_nationkey LIMIT 3)")
def j12(spark, d):
    few = table(spark, d, "supplier").select("s_nationkey").distinct().orderBy("s_nationkey").limit(3)
    return table(spark, d, "customer").join(few, F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("c_custkey")


@query("j13_interval_join", f"""WITH {CONTACTS}, w AS (SELECT CAST(x AS DATE) AS start FROM generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 7 DAY) t(x))
SELECT CAST(start AS VARCHAR) AS week, count(id) AS n FROM w LEFT JOIN contacts ON day >= start AND day < start + 7 GROUP BY start""")
def j13(spark, d):
    weeks = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-02-05', interval 7 days)) AS start")
    daily = contacts(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    j = weeks.join(daily, (F.col("day") >= F.col("start")) & (F.col("day") < F.date_add("start", 7)), "left")
    return j.groupBy(F.col("start").cast("string").alias("week")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("j14_left_on_condition", "SELECT c_custkey, count(o_orderkey) AS finished FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def j14(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "F"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("finished"))


@query("j15_full_outer_ranks", """WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 20), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 20)
SELECT coalesce(a.id, b.id) AS id, a.r AS rank_a, b.r AS rank_b FROM a FULL JOIN b ON a.id = b.id""")
def j15(spark, d):
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    top = lambda c, name: R.ranked(p.orderBy(F.desc(c), "id").limit(20), [F.desc(c), "id"], name).select("id", name)
    return top("p_retailprice", "rank_a").join(top("p_size", "rank_b"), "id", "full_outer").select("id", "rank_a", "rank_b")


@query("j16_propagate", "SELECT p_partkey, coalesce(s, 'none') AS extra FROM part LEFT JOIN (SELECT l_partkey, max_by(l_returnflag, (l_orderkey, l_linenumber)) AS s FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def j16(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_returnflag", F.struct("l_orderkey", "l_linenumber")).alias("s"))
    return table(spark, d, "part").join(last, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("s", F.lit("none")).alias("extra"))


@query("j17_update_from", "SELECT c_custkey, CAST(coalesce(n, c_custkey % 5) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) ON o_custkey = c_custkey")
def j17(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 10")
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.col("c_custkey") % 5).alias("n"))


@query("j18_slot_match", """WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS slot FROM customer),
s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, k) AS slot FROM supplier, (SELECT unnest([1, 2, 3]) AS k))
SELECT c_custkey, s_suppkey FROM c JOIN s ON s_nationkey = c_nationkey AND c.slot = s.slot""")
def j18(spark, d):
    """Each supplier takes three customers of its nation, in order."""
    c = table(spark, d, "customer").withColumn("slot", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    s = table(spark, d, "supplier").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    s = s.withColumn("slot", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey", "k")))
    return c.join(s, (c["c_nationkey"] == s["s_nationkey"]) & (c["slot"] == s["slot"])).select("c_custkey", "s_suppkey")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_ROUND = """
a{i} AS (SELECT c_custkey, {g}, row_number() OVER (PARTITION BY {p} ORDER BY c_custkey) AS n FROM c WHERE {left}),
b{i} AS (SELECT s_suppkey, slot, {g}, row_number() OVER (PARTITION BY {p} ORDER BY s_suppkey, slot) AS n FROM s WHERE {free}),
m{i} AS (SELECT c_custkey, s_suppkey, slot, {i} AS round FROM a{i} JOIN b{i} USING (n, {p}))"""


def _rounds() -> str:
    out = []
    for i, g in enumerate((("nation", "segment"), ("nation",), ("region",), ("one",)), 1):
        left = " AND ".join([f"c_custkey NOT IN (SELECT c_custkey FROM m{k})" for k in range(1, i)] or ["true"])
        free = " AND ".join([f"(s_suppkey, slot) NOT IN (SELECT (s_suppkey, slot) FROM m{k})" for k in range(1, i)] or ["true"])
        out.append(_ROUND.format(i=i, g=", ".join(g), p=", ".join(g), left=left, free=free))
    return ",".join(out)


@query("j18_match_in_rounds", f"""WITH c AS (SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment, n_regionkey AS region, 1 AS one FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT s_suppkey, s_nationkey AS nation, {list(_SEGMENTS)}[s_suppkey % 5 + 1] AS segment, n_regionkey AS region, 1 AS one, unnest(range(1, 6 + s_suppkey % 8)) AS slot FROM supplier JOIN nation ON n_nationkey = s_nationkey),
{_rounds()} SELECT c_custkey, s_suppkey, round FROM m1 UNION ALL SELECT c_custkey, s_suppkey, round FROM m2 UNION ALL SELECT c_custkey, s_suppkey, round FROM m3 UNION ALL SELECT c_custkey, s_suppkey, round FROM m4""")
def j18_rounds(spark, d):
    """Customers to suppliers with 5 to 12 places: of the same nation and segment, then nation, then region, then any."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    c = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "region")
    segment = F.element_at(F.array(*map(F.lit, _SEGMENTS)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("nation"), segment.alias("segment"), "region", (F.col("s_suppkey") % 8 + 5).alias("places"))
    return A.match_in_rounds(c, "c_custkey", s, "s_suppkey", "places", [("nation", "segment"), ("nation",), ("region",), ()])
