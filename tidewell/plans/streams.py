"""The batch form of the stream operators, which the stream tests hold their results against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.operators import relational as R
from tidewell.plans.aggregates import _TRANSITIONS, transitions
from tidewell.plans.registry import CONTACTS, contacts, query, table
from tidewell.streaming import conversations as S
from tidewell.streaming import retro, stores


@query("x01_micro_batches", "WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations) SELECT conv_id, batch, string_agg(text, ' ' ORDER BY turn) AS text FROM n GROUP BY conv_id, batch")
def x01(spark, d):
    return S.micro_batches(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("x02_overlap_merge")
def x02(spark, d):
    return S.merge_overlaps(table(spark, d, "conversations"))


@query("x03_repetition_filter", "SELECT conv_id, turn FROM conversations WHERE NOT (length(text) >= 10 AND len(list_distinct(string_split(text, ''))) <= 2)")
def x03(spark, d):
    spam = (F.length("text") >= 10) & (F.size(F.array_distinct(F.split("text", ""))) <= 2)
    return table(spark, d, "conversations").filter(~spam).select("conv_id", "turn")


@query("x04_carry_forward", f"""WITH {CONTACTS}, n AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts, id) AS turn FROM contacts),
s AS (SELECT *, last_value(CASE WHEN category = 'purchase' THEN id END IGNORE NULLS) OVER w AS known, last_value(CASE WHEN category = 'purchase' THEN ts END IGNORE NULLS) OVER w AS known_ts, last_value(CASE WHEN category = 'purchase' THEN turn END IGNORE NULLS) OVER w AS known_turn
FROM n WINDOW w AS (PARTITION BY customer ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, CASE WHEN ts - known_ts <= INTERVAL 180 MINUTE AND turn - known_turn <= 3 THEN known END AS carried FROM s""")
def x04(spark, d):
    c = contacts(spark, d).withColumn("entity", F.when(F.col("category") == "purchase", F.col("id")))
    return S.carried(c, "customer", ["ts", "id"], "ts", "entity", 180 * 60, 3).select("id", "carried")


@query("x05_cooldown")
def x05(spark, d):
    c = contacts(spark, d).select(F.col("customer").alias("session"), "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return S.throttle(c, 3600.0)


@query("x06_next_topic", f"""WITH {CONTACTS}, {_TRANSITIONS}, l AS (SELECT customer, max_by(category, (ts, id)) AS now, list_distinct(list(category)) AS seen FROM contacts WHERE day >= DATE '2024-01-29' GROUP BY customer)
SELECT customer, after AS next, pos FROM (SELECT customer, after, row_number() OVER (PARTITION BY customer ORDER BY n DESC, after) AS pos FROM l JOIN t ON category = now AND NOT list_contains(seen, after)) WHERE pos <= 2""")
def x06(spark, d):
    c = contacts(spark, d)
    now = c.filter(F.col("day") >= F.lit("2024-01-29").cast("date")).groupBy("customer").agg(F.max_by("category", F.struct("ts", "id")).alias("category"), F.collect_set("category").alias("seen"))
    j = now.join(transitions(c), "category").filter(~F.array_contains("seen", F.col("after")))
    return R.top_per_group(j, ["customer"], [F.desc("n"), "after"], 2, "pos").select("customer", F.col("after").alias("next"), F.col("pos").cast("long").alias("pos"))


@query("x07_retro_resolution", f"WITH {CONTACTS} SELECT customer, category, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM contacts b WHERE b.customer = a.customer AND b.category = a.category AND b.day > a.day AND b.day <= a.day + 7)) AS reopened FROM contacts a GROUP BY customer, category")
def x07(spark, d):
    c = contacts(spark, d)
    return c.withColumn("again", R.recontacted(c, ["customer", "category"], "day")).groupBy("customer", "category").agg(F.count("*").alias("n"), F.count_if("again").alias("reopened"))


@query("x08_sliding_hour", f"""WITH {CONTACTS}, w AS (SELECT customer, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * i) AS start FROM contacts, range(0, 12) r(i) WHERE category = 'view')
SELECT start, customer, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2""")
def x08(spark, d):
    return S.windowed_counts(contacts(spark, d).filter("category = 'view'"), ["customer"], "1 hour", "5 minutes").filter("n >= 2")


@query("x09_tumbling_day", f"WITH {CONTACTS} SELECT date_trunc('day', ts) AS start, category, count(*) AS n FROM contacts GROUP BY ALL")
def x09(spark, d):
    return S.windowed_counts(contacts(spark, d), ["category"], "1 day")


@query("x10_sessions", f"""WITH {CONTACTS}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY customer ORDER BY ts, id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM contacts),
s AS (SELECT *, sum(new) OVER (PARTITION BY customer ORDER BY ts, id) AS k FROM g) SELECT customer, min(ts) AS start, count(*) AS n FROM s GROUP BY customer, k""")
def x10(spark, d):
    return S.sessions(contacts(spark, d), ["customer"], "2 hours")


@query("x11_ttl_eviction", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 2 DAY ORDER BY ts DESC, event_id LIMIT 200")
def x11(spark, d):
    return S.latest(table(spark, d, "events"), "event_id", "ts", "2 days", "2024-01-30 00:00:00", 200).select("event_id")


@query("x05_triggered_cooldown")
def x05_triggered(spark, d):
    """At most one search a customer in 12 minutes, and only for events with a trigger."""
    c = contacts(spark, d).withColumn("hits", F.get_json_object("props", "$.k").cast("int") % 4).withColumn("confidence", F.col("value") / 60)
    c = c.withColumn("turn", (F.col("id") % 6).cast("int")).withColumn("wanted", F.col("category") == "error")
    c = c.select(F.col("customer").alias("session"), "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), S.triggered().alias("may"))
    return S.throttle(c, 720.0)


#: Operations on stored values: what is bought is put there, an error takes it away, all else looks.
def _operations(c):
    op = F.when(F.col("category") == "purchase", "put").when(F.col("category") == "error", "delete").otherwise("get")
    return c.select(F.col("customer").cast("string").alias("key"), "id", "ts", op.alias("op"), F.when(op == "put", F.concat(F.lit("bought "), "id")).alias("value"))


@query("s19_expiring_values", f"""WITH {CONTACTS}, n AS (SELECT *, last_value(CASE WHEN category IN ('purchase', 'error') THEN id END IGNORE NULLS) OVER w AS changed FROM contacts WINDOW w AS (PARTITION BY customer ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(n.customer AS VARCHAR) AS key, n.id, CASE n.category WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'get' END AS op, CASE WHEN p.category = 'purchase' AND n.ts < p.ts + INTERVAL 2 DAY THEN 'bought ' || p.id END AS value FROM n LEFT JOIN contacts p ON p.id = n.changed""")
def s19_values(spark, d):
    """Each customer's stored value after each contact; values live for two days."""
    return stores.store_table(_operations(contacts(spark, d)), 2 * 86400.0)


@query("x12_processing_markers", f"""WITH {CONTACTS}, n AS (SELECT *, last_value(CASE WHEN category IN ('signup', 'purchase') THEN id END IGNORE NULLS) OVER w AS changed FROM contacts WINDOW w AS (PARTITION BY customer ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT n.customer, count(*) AS polls, count(*) FILTER (p.category = 'signup' AND n.ts < p.ts + INTERVAL 1 DAY) AS busy FROM n LEFT JOIN contacts p ON p.id = n.changed WHERE n.category NOT IN ('signup', 'purchase') GROUP BY n.customer""")
def x12_markers(spark, d):
    """Polls that find a customer's process running: sign-up begins it, a purchase ends it, and after a day its marker is void."""
    c = contacts(spark, d)
    op = F.when(F.col("category") == "signup", "put").when(F.col("category") == "purchase", "delete").otherwise("get")
    marks = stores.store_table(c.select(F.col("customer").cast("string").alias("key"), "id", "ts", op.alias("op"), F.lit("running").alias("value")), 86400.0)
    return marks.filter("op = 'get'").groupBy(F.col("key").cast("long").alias("customer")).agg(F.count("*").alias("polls"), F.count("value").alias("busy"))


def streamed(spark, d, files: int = 4):
    """Contacts as a table that a stream has kept: they come in files by turns, and each batch rewrites the parts it touches."""
    c = contacts(spark, d).select("id", "customer", "category", "day")
    folder = R.shared_folder(spark)
    source, path = f"{folder}/contacts-{uuid.uuid4().hex}", f"{folder}/retro-{uuid.uuid4().hex}"
    c.repartition(files, F.pmod(F.xxhash64("id"), F.lit(files))).write.parquet(source)
    schema = "id long, customer long, category string, day date"
    sink = retro.retro_sink(path, schema, "customer", retro.reopened, "id")
    S.read_stream(spark, source, schema).writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return retro.current(spark, path, f"{schema}, resolved boolean")


_RESOLVED = f"WITH {CONTACTS}, r AS (SELECT *, NOT EXISTS (SELECT 1 FROM contacts b WHERE b.customer = a.customer AND b.category = a.category AND b.day > a.day AND b.day <= a.day + 7) AS resolved FROM contacts a)"


@query("j07_retro_stream", f"{_RESOLVED} SELECT id, resolved FROM r")
def j07_stream(spark, d):
    return streamed(spark, d).select("id", "resolved")


@query("x07_customer_counters", f"{_RESOLVED} SELECT customer, count(*) AS total, count(*) FILTER (resolved) AS resolved_first, CAST(max(day) AS VARCHAR) AS last_day FROM r GROUP BY customer")
def x07_counters(spark, d):
    return retro.counters(streamed(spark, d)).withColumn("last_day", F.col("last_day").cast("string"))
