"""Aggregates, windows, sorts and set operations over contact records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import relational as R
from tidewell.plans.registry import AS_OF, CONTACTS, as_of, contacts, query, table

D = f"DATE '{AS_OF}'"
SECONDS = "(CAST(split_part(duration, ':', 1) AS BIGINT) * 60 + CAST(split_part(duration, ':', 2) AS BIGINT))"


@query("a01_share", "SELECT o_orderstatus AS status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 2) AS percent FROM orders GROUP BY o_orderstatus")
def a01(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return g.select("status", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias("percent"))


@query("a02_filtered_counts", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM lineitem GROUP BY l_suppkey")
def a02(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum((F.col("l_linestatus") == "O").cast("int")).alias("open"))


@query("a03_distinct_counts", f"WITH {CONTACTS} SELECT category, count(DISTINCT customer) AS customers, count(DISTINCT customer) FILTER (day > {D} - 14) AS recent FROM contacts GROUP BY category")
def a03(spark, d):
    recent = F.when(F.col("day") > F.date_sub(as_of(), 14), F.col("customer"))
    return contacts(spark, d).groupBy("category").agg(F.count_distinct("customer").alias("customers"), F.count_distinct(recent).alias("recent"))


@query("a04_average_duration", f"WITH {CONTACTS} SELECT customer, round(avg({SECONDS}), 4) AS seconds FROM contacts GROUP BY customer")
def a04(spark, d):
    return contacts(spark, d).groupBy("customer").agg(F.round(F.avg(R.duration_seconds("duration")), 4).alias("seconds"))


@query("a05_profile", f"WITH {CONTACTS} SELECT customer, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS n FROM contacts WHERE day > {D} - 90 GROUP BY customer")
def a05(spark, d):
    c = contacts(spark, d).filter(F.col("day") > F.date_sub(as_of(), 90))
    return c.groupBy("customer").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count("*").alias("n"))


@query("a06_having", f"WITH {CONTACTS} SELECT customer, date_trunc('hour', ts) AS hour, count(*) AS n FROM contacts WHERE category = 'view' GROUP BY ALL HAVING count(*) >= 2")
def a06(spark, d):
    return contacts(spark, d).filter("category = 'view'").groupBy("customer", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")).filter("n >= 2")


@query("a07_daily_rollup", f"WITH {CONTACTS} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, count(DISTINCT customer) AS customers FROM contacts WHERE day > {D} - 30 GROUP BY day")
def a07(spark, d):
    return contacts(spark, d).filter(F.col("day") > F.date_sub(as_of(), 30)).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("customer").alias("customers"))


@query("a08_unnest_top", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def a08(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("a09_bucket_groups", "SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, CAST(min(p_size) AS BIGINT) AS least FROM part GROUP BY 1")
def a09(spark, d):
    return table(spark, d, "part").groupBy(R.tier(F.col("p_size"), [(10, "small"), (30, "medium")], "large").alias("bucket")).agg(F.count("*").alias("n"), F.min("p_size").cast("long").alias("least"))


@query("a10_aggregate_of_aggregate", "SELECT count(*) AS agents, round(avg(n), 4) AS mean, min(n) AS least, max(n) AS most, max(n) - min(n) AS spread FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def a10(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("agents"), F.round(F.avg("n"), 4).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("spread"))


@query("a11_moments", "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(coalesce(stddev_samp(o_totalprice), 0), 2) AS deviation, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority")
def a11(spark, d):
    p = F.col("o_totalprice")
    o = table(spark, d, "orders")
    median = R.percentiles(o, "o_orderpriority", "o_totalprice", {"median": 0.5}).withColumn("median", F.round("median", 2))
    return median.join(o.groupBy("o_orderpriority").agg(F.round(F.avg(p), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp(p), F.lit(0.0)), 2).alias("deviation"), (F.max(p) - F.min(p)).alias("spread")), "o_orderpriority")


@query("a12_percentiles", "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def a12(spark, d):
    p = R.percentiles(table(spark, d, "events"), "event_type", "value", {"p95": 0.95, "p99": 0.99})
    return p.select("event_type", F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"))


_WEEKS = f"count(*) FILTER (day > {D} - 7) AS this_week, count(*) FILTER (day <= {D} - 7 AND day > {D} - 14) AS last_week"
_TREND = "CASE WHEN last_week = 0 AND this_week > 0 THEN 'up' WHEN this_week > last_week * 1.05 THEN 'up' WHEN this_week < last_week * 0.95 THEN 'down' ELSE 'same' END"


def weeks(c):
    recent = F.col("day") > F.date_sub(as_of(), 7)
    return [F.count_if(recent).alias("this_week"), F.count_if(~recent & (F.col("day") > F.date_sub(as_of(), 14))).alias("last_week")]


@query("a13_trend", f"WITH {CONTACTS} SELECT *, {_TREND} AS trend FROM (SELECT category, {_WEEKS} FROM contacts GROUP BY category)")
def a13(spark, d):
    c = contacts(spark, d)
    return c.groupBy("category").agg(*weeks(c)).withColumn("trend", R.trend(F.col("this_week"), F.col("last_week")))


@query("a14_top_categories", f"WITH {CONTACTS} SELECT *, {_TREND} AS trend FROM (SELECT category, count(*) AS n, {_WEEKS} FROM contacts GROUP BY category ORDER BY n DESC, category LIMIT 3)")
def a14(spark, d):
    c = contacts(spark, d)
    return c.groupBy("category").agg(F.count("*").alias("n"), *weeks(c)).orderBy(F.desc("n"), "category").limit(3).withColumn("trend", R.trend(F.col("this_week"), F.col("last_week")))


@query("a15_day_changes", f"WITH {CONTACTS}, t AS (SELECT category, day, count(*) AS n FROM contacts GROUP BY ALL) SELECT category, CAST(day AS VARCHAR) AS day, n, CAST(floor((n - lag(n) OVER w) * 100.0 / lag(n) OVER w + 0.5) AS BIGINT) AS change FROM t WINDOW w AS (PARTITION BY category ORDER BY day)")
def a15(spark, d):
    w = Window.partitionBy("category").orderBy("day")
    t = contacts(spark, d).groupBy("category", "day").agg(F.count("*").alias("n")).withColumn("before", F.lag("n").over(w))
    return t.select("category", F.col("day").cast("string").alias("day"), "n", F.floor((F.col("n") - F.col("before")) * 100.0 / F.col("before") + 0.5).cast("long").alias("change"))


@query("a16_goal_percent", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, least(100.0, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / 1000, 1)) AS goal FROM orders GROUP BY o_orderpriority")
def a16(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return g.withColumn("goal", F.least(F.lit(100.0), F.round(F.col("done") * 100.0 / 1000, 1)))


@query("a17_alerts", """WITH s AS (SELECT l_suppkey, count(*) AS n, round(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*), 2) AS returned, round(avg(l_quantity), 2) AS load FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, 'returns' AS alert, returned AS value FROM s WHERE returned > 35 UNION ALL SELECT l_suppkey, 'load', load FROM s WHERE load > 26""")
def a17(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.count_if(F.col("l_returnflag") == "R") * 100.0 / F.count("*"), 2).alias("returned"), F.round(F.avg("l_quantity"), 2).alias("load"))
    rules = [("returns", "returned", 35), ("load", "load", 26)]  # one pass: an alert is an element of an array
    return s.select("l_suppkey", F.explode(F.filter(F.array(*(F.struct(F.lit(a).alias("alert"), F.col(c).alias("value"), (F.col(c) > m).alias("on")) for a, c, m in rules)), lambda x: x["on"])).alias("a")).select("l_suppkey", "a.alert", "a.value")


@query("a18_null_profile", "SELECT count(*) AS rows, count(*) - count(text) AS no_text, count(*) - count(lang) AS no_lang, count(*) FILTER (n_chars IS NULL OR n_chars = 0) AS blank FROM documents")
def a18(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("rows"), (F.count("*") - F.count("text")).alias("no_text"), (F.count("*") - F.count("lang")).alias("no_lang"), F.count_if(F.col("n_chars").isNull() | (F.col("n_chars") == 0)).alias("blank"))


@query("a19_learning", """WITH r AS (SELECT user_id, least(100, CAST(trunc(value) AS BIGINT)) AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, round(avg(score), 4) AS mean, round(count(*) FILTER (score >= 20) * 100.0 / count(*), 2) AS passed, round(avg(score) FILTER (rn <= 10) - avg(score) FILTER (rn > 10 AND rn <= 20), 4) AS gain FROM r GROUP BY user_id""")
def a19(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = table(spark, d, "events").select("user_id", F.least(F.lit(100), F.col("value").cast("long")).alias("score"), F.row_number().over(w).alias("rn"))
    s, rn = F.col("score"), F.col("rn")
    return r.groupBy("user_id").agg(F.round(F.avg(s), 4).alias("mean"), F.round(F.count_if(s >= 20) * 100.0 / F.count("*"), 2).alias("passed"), F.round(F.avg(F.when(rn <= 10, s)) - F.avg(F.when((rn > 10) & (rn <= 20), s)), 4).alias("gain"))


@query("a20_group_keywords", "SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY lang, word)) WHERE r <= 50")
def a20(spark, d):
    n = table(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return R.top_per_group(n, ["lang"], [F.desc("n"), "word"], 50).drop("rn")


@query("a21_remap", "SELECT CASE p_type WHEN 'PROMO' THEN 'campaign' WHEN 'SMALL' THEN 'size' WHEN 'MEDIUM' THEN 'size' WHEN 'LARGE' THEN 'size' ELSE 'general' END AS kind, count(*) AS n FROM part GROUP BY 1")
def a21(spark, d):
    known = F.create_map(*(F.lit(x) for kv in {"PROMO": "campaign", "SMALL": "size", "MEDIUM": "size", "LARGE": "size"}.items() for x in kv))
    return table(spark, d, "part").groupBy(F.coalesce(F.try_element_at(known, F.col("p_type")), F.lit("general")).alias("kind")).agg(F.count("*").alias("n"))


@query("a22_length_profile", "SELECT lang, min(n) AS least, max(n) AS most, CAST(trunc(avg(n)) AS BIGINT) AS mean, count(*) FILTER (n > 6000) AS long FROM (SELECT lang, length(regexp_replace(text, '[ \\n]+', '', 'g')) AS n FROM documents) GROUP BY lang")
def a22(spark, d):
    t = table(spark, d, "documents").select("lang", F.length(F.regexp_replace("text", "[ \n]+", "")).cast("long").alias("n"))
    return t.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").cast("long").alias("mean"), F.count_if(F.col("n") > 6000).alias("long"))


@query("a23_dictionary_summary", "SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY p_type")
def a23(spark, d):
    p = table(spark, d, "part").unpivot("p_partkey", ["p_brand", "p_type"], "facet", "value")
    return p.groupBy(F.substring("facet", 3, 9).alias("facet"), "value").agg(F.count("*").alias("n"))


@query("a24_distinct_pairs", "SELECT count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
def a24(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))


@query("a25_majority_vote", f"""WITH {CONTACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts DESC, id DESC) AS rn FROM contacts QUALIFY rn <= 3),
v AS (SELECT customer, category, count(*) AS n, min(rn) AS latest FROM r GROUP BY ALL) SELECT customer, first(category ORDER BY n DESC, latest) AS vote FROM v GROUP BY customer""")
def a25(spark, d):
    r = R.top_per_group(contacts(spark, d), ["customer"], [F.desc("ts"), F.desc("id")], 3)
    v = r.groupBy("customer", "category").agg(F.count("*").alias("n"), F.min("rn").alias("latest"))
    return v.groupBy("customer").agg(F.max_by("category", F.struct("n", -F.col("latest"))).alias("vote"))


@query("a26_group_concat", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def a26(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.sum(F.length("text")).alias("chars"))
    return g.select("conv_id", F.array_join("x.role", ">").alias("roles"), "chars")


@query("a27_positive_mean", "SELECT event_type, round(avg(value) FILTER (value > 5), 4) AS mean FROM events GROUP BY event_type")
def a27(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 5, F.col("value"))), 4).alias("mean"))


@query("a28_resolution_rate", f"""WITH {CONTACTS}, f AS (SELECT customer, NOT EXISTS (SELECT 1 FROM contacts b WHERE b.customer = a.customer AND b.category = a.category AND b.day > a.day AND b.day <= a.day + 7) AS ok FROM contacts a),
g AS (SELECT customer, count(*) AS n, count(*) FILTER (ok) AS resolved FROM f GROUP BY customer),
s AS (SELECT *, CAST(coalesce(sum(n - resolved) OVER (ORDER BY customer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g)
SELECT customer, n, resolved, greatest(0, least(n - resolved, 100 - before)) AS granted FROM s""")
def a28(spark, d):
    """First-contact resolution by customer; a budget of 100 more goes to customers in order until it is used up."""
    c = contacts(spark, d)
    ok = ~R.recontacted(c, ["customer", "category"], "day")
    g = c.select("customer", ok.alias("ok")).groupBy("customer").agg(F.count("*").alias("n"), F.count_if("ok").alias("resolved"))
    g = R.running_before(g.withColumn("open", F.col("n") - F.col("resolved")), ["customer"], "open", "before")
    return g.select("customer", "n", "resolved", F.greatest(F.lit(0), F.least(F.col("n") - F.col("resolved"), 100 - F.col("before"))).alias("granted"))


@query("w01_last_three", f"WITH {CONTACTS} SELECT customer, id, rn FROM (SELECT customer, id, row_number() OVER (PARTITION BY customer ORDER BY day DESC, id DESC) AS rn FROM contacts) WHERE rn <= 3")
def w01(spark, d):
    return R.top_per_group(contacts(spark, d), ["customer"], [F.desc("day"), F.desc("id")], 3).select("customer", "id", F.col("rn").cast("long").alias("rn"))


@query("w03_agent_rank", """SELECT l_suppkey, n, resolved, seconds, row_number() OVER (ORDER BY n DESC, resolved DESC, seconds, l_suppkey) AS rank FROM
(SELECT l_suppkey, count(*) AS n, round(count(*) FILTER (l_returnflag <> 'R') * 100.0 / count(*), 1) AS resolved, round(avg(l_quantity), 2) AS seconds FROM lineitem GROUP BY l_suppkey)""")
def w03(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("l_returnflag") != "R") * 100.0 / F.count("*"), 1).alias("resolved"), F.round(F.avg("l_quantity"), 2).alias("seconds"))
    return R.numbered(a, [F.desc("n"), F.desc("resolved"), F.col("seconds"), F.col("l_suppkey")])


@query("w05_same_role_runs", """WITH c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c) SELECT conv_id, CAST(island AS BIGINT) AS island, any_value(role) AS role, count(*) AS turns, string_agg(text, ' ' ORDER BY turn) AS text FROM i GROUP BY conv_id, island""")
def w05(spark, d):
    i = R.islands(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role")
    g = i.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return g.select("conv_id", "island", "role", "turns", F.array_join("x.text", " ").alias("text"))


@query("w06_latest_delta", f"WITH {CONTACTS}, t AS (SELECT day, count(*) AS n FROM contacts GROUP BY day) SELECT CAST(day AS VARCHAR) AS day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM t QUALIFY row_number() OVER (ORDER BY day DESC) = 1")
def w06(spark, d):
    t = contacts(spark, d).groupBy("day").agg(F.count("*").alias("n")).withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("day")))
    return t.orderBy(F.desc("day")).limit(1).withColumn("day", F.col("day").cast("string"))


_TRANSITIONS = "t AS (SELECT category, after, count(*) AS n FROM (SELECT category, lead(category) OVER (PARTITION BY customer ORDER BY ts, id) AS after FROM contacts) WHERE after IS NOT NULL GROUP BY ALL)"


def transitions(c):
    after = F.lead("category").over(Window.partitionBy("customer").orderBy("ts", "id"))
    return c.select("category", after.alias("after")).filter("after IS NOT NULL").groupBy("category", "after").agg(F.count("*").alias("n"))


@query("w07_transitions", f"WITH {CONTACTS}, {_TRANSITIONS} SELECT * FROM t")
def w07(spark, d):
    return transitions(contacts(spark, d))


@query("w08_list_positions", "SELECT p_partkey, pos FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part ORDER BY pos LIMIT 100) WHERE NOT contains(p_name, 'red')")
def w08(spark, d):
    best = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)
    return R.ranked(best, [F.desc("p_retailprice"), "p_partkey"], "pos").filter(~F.col("p_name").contains("red")).select("p_partkey", "pos")  # a skipped row still takes its position


@query("w09_day_islands", f"WITH {CONTACTS}, x AS (SELECT DISTINCT customer, day FROM contacts), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY customer ORDER BY day) AS INT) AS k FROM x) SELECT customer, CAST(min(day) AS VARCHAR) AS first, count(*) AS days FROM g GROUP BY customer, k")
def w09(spark, d):
    x = contacts(spark, d).select("customer", "day").distinct()
    k = F.date_sub("day", F.row_number().over(Window.partitionBy("customer").orderBy("day")))
    return x.withColumn("k", k).groupBy("customer", "k").agg(F.min("day").cast("string").alias("first"), F.count("*").alias("days")).drop("k")


@query("k01_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def k01(spark, d):
    o = table(spark, d, "orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice").crossJoin(o.agg(F.count("*").alias("total")))


@query("k02_pinned_first", "SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC, o_orderkey) AS pos FROM orders ORDER BY pos LIMIT 50")
def k02(spark, d):
    order = [F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_orderdate"), "o_orderkey"]
    return R.ranked(table(spark, d, "orders").orderBy(*order).limit(50), order, "pos").select("o_orderkey", "pos")


@query("k03_titled_top", "SELECT s_suppkey, CASE row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END AS title FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 3")
def k03(spark, d):
    order = [F.desc("s_acctbal"), "s_suppkey"]
    top = R.ranked(table(spark, d, "supplier").filter("s_acctbal > 0").orderBy(*order).limit(3), order)
    return top.select("s_suppkey", F.element_at(F.array(*map(F.lit, ("gold", "silver", "bronze"))), F.col("rank").cast("int")).alias("title"))


@query("k04_custom_order", "SELECT c_mktsegment, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 9 END, c_mktsegment) AS pos, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")
def k04(spark, d):
    n = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return R.ranked(n, [F.when(F.col("c_mktsegment") == "MACHINERY", 1).when(F.col("c_mktsegment") == "AUTOMOBILE", 2).otherwise(9), "c_mktsegment"], "pos")


@query("k05_nulls_last", "SELECT c_custkey, last, row_number() OVER (ORDER BY last DESC NULLS LAST, c_custkey) AS pos FROM (SELECT c_custkey, CAST(max(o_orderdate) AS VARCHAR) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey)")
def k05(spark, d):
    last = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").cast("string").alias("last"))
    c = table(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "last")
    return R.numbered(c, [F.desc_nulls_last("last"), F.col("c_custkey")], "pos")


@query("k06_recent_history", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5")
def k06(spark, d):
    return R.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


@query("k08_duration_order", f"WITH {CONTACTS} SELECT id, row_number() OVER (ORDER BY {SECONDS} DESC, id) AS pos FROM contacts ORDER BY pos LIMIT 30")
def k08(spark, d):
    c = contacts(spark, d).withColumn("s", R.duration_seconds("duration"))
    return R.ranked(c.orderBy(F.desc("s"), "id").limit(30), [F.desc("s"), "id"], "pos").select("id", "pos")


@query("k09_slots_with_fill", "SELECT conv_id, turn, pos FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role <> 'assistant'), turn) AS pos FROM conversations) WHERE pos <= 4")
def k09(spark, d):
    """Four slots: assistants' turns first, then filled up with the others."""
    return R.top_per_group(table(spark, d, "conversations"), ["conv_id"], [F.col("role") != "assistant", "turn"], 4, "pos").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


@query("k10_promote_first", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (turn <> lead_turn), turn) AS pos FROM (SELECT *, coalesce(min(turn) FILTER (length(text) > 500) OVER (PARTITION BY conv_id), -1) AS lead_turn FROM conversations)")
def k10(spark, d):
    first = F.coalesce(F.min(F.when(F.length("text") > 500, F.col("turn"))).over(Window.partitionBy("conv_id")), F.lit(-1))
    c = table(spark, d, "conversations").withColumn("first", first)
    return c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn") != F.col("first"), "turn")).cast("long").alias("pos"))


@query("k11_quota_mix", """WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, lang FROM r ORDER BY (k > 1), n_chars DESC, doc_id LIMIT 10""")
def k11(spark, d):
    """Ten longest documents, with at least one of each language."""
    r = R.top_per_group(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), "doc_id"], 10)
    return r.orderBy(F.col("rn") > 1, F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "lang")


@query("u01_table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def u01(spark, d):
    return R.union_sources({t: table(spark, d, t).agg(F.count("*").alias("n")) for t in ("orders", "part", "events")}).select(F.col("origin").alias("name"), "n")


@query("u03_ordered_distinct", "SELECT p_partkey, array_to_string(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: x), ' ') AS words FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part)")
def u03(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), " ").alias("words"))


@query("u04_merge_dictionaries", "SELECT p_type AS k, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS v FROM part GROUP BY p_type")
def u04(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("k"), F.col("p_brand").alias("v"))
    return p.filter("v < 'Brand#3'").unionByName(p.filter("v >= 'Brand#2'")).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("v"))


@query("u05_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def u05(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("u06_difference", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(['red', 'small', 'big'], x)), ' ') AS rest FROM part")
def u06(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.split("p_name", " "), lambda x: ~x.isin("red", "small", "big")), " ").alias("rest"))


@query("u07_first_source_wins", """WITH a AS (SELECT 1 AS src, p_partkey AS id, p_retailprice AS score FROM part WHERE p_size > 20 UNION ALL SELECT 2, p_partkey, p_size FROM part WHERE p_type = 'PROMO')
SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src) AS r FROM a) WHERE r = 1 ORDER BY score DESC, id LIMIT 50""")
def u07(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_size > 20").select(F.lit(1).alias("src"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    b = p.filter("p_type = 'PROMO'").select(F.lit(2).alias("src"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    return a.unionByName(b).groupBy("id").agg(F.min_by("score", "src").alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("u08_validation_report", """SELECT 'orders' AS "check", CAST(count(*) AS DOUBLE) AS actual, count(*) >= 1000 AS passed FROM orders UNION ALL SELECT 'finished share', round(avg(CAST(o_orderstatus = 'F' AS INT)), 4), avg(CAST(o_orderstatus = 'F' AS INT)) BETWEEN 0.2 AND 0.6 FROM orders
UNION ALL SELECT 'discount', round(max(l_discount), 4), max(l_discount) BETWEEN 0 AND 0.1 FROM lineitem""")
def u08(spark, d):
    o = table(spark, d, "orders")
    checks = [R.check("orders", o, F.count("*"), 1000, 1e18), R.check("finished share", o, F.avg((F.col("o_orderstatus") == "F").cast("int")), 0.2, 0.6), R.check("discount", table(spark, d, "lineitem"), F.max("l_discount"), 0, 0.1)]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("u09_load_check", "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS full_size FROM embeddings GROUP BY label")
def u09(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("full_size"))
