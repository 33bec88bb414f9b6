"""Views and table functions in SQL: contact history of a customer and what it is worth, called from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans.registry import AS_OF, CONTACTS, contacts, query

VIEWS = {
    # Contacts with their age in days and whether the customer came back about the same within a week.
    "contact_history": f"""
SELECT c.*, datediff(DATE '{AS_OF}', day) AS days_ago,
  count(*) OVER (PARTITION BY customer, category ORDER BY datediff(day, DATE '1970-01-01') RANGE BETWEEN 1 FOLLOWING AND 7 FOLLOWING) > 0 AS came_back
FROM contact c""",
    # Customers with their last contact, contacts of 90 days, and the category that they call about most.
    "customer_activity": """
SELECT customer, max(day) AS last_day, min(days_ago) AS days_ago, count_if(days_ago <= 90) AS recent, count(*) AS total, count_if(came_back) AS reopened
FROM contact_history GROUP BY customer""",
}

FUNCTIONS = {
    # The last ten contacts of a customer with their level and score by age.
    "contact_relevance": """
(of BIGINT) RETURNS TABLE (id BIGINT, day DATE, category STRING, days_ago INT, level STRING, score INT)
RETURN SELECT id, day, category, days_ago,
  CASE WHEN days_ago <= 7 THEN 'high' WHEN days_ago <= 30 THEN 'medium' WHEN days_ago <= 90 THEN 'low' ELSE 'none' END,
  CASE WHEN days_ago <= 7 THEN 100 - days_ago * 5 WHEN days_ago <= 30 THEN 65 - (days_ago - 7) * 2 WHEN days_ago <= 90 THEN 20 - CAST((days_ago - 30) DIV 6 AS INT) ELSE 0 END
FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY day DESC, id DESC) AS place FROM contact_history) h
WHERE h.customer = contact_relevance.of AND place <= 10""",
    # Whether what is known of a customer still holds.
    "profile_relevance": """
(of BIGINT) RETURNS TABLE (last_day DATE, days_ago INT, relevance STRING, recent BIGINT)
RETURN SELECT last_day, coalesce(days_ago, 9999), CASE WHEN days_ago <= 30 THEN 'valid' WHEN days_ago <= 180 THEN 'stale' ELSE 'outdated' END, recent
FROM customer_activity a WHERE a.customer = profile_relevance.of""",
    # A customer's contacts about one category within some days, newest first in ``place``.
    "similar_contacts": """
(of BIGINT, about STRING, within INT DEFAULT 30) RETURNS TABLE (id BIGINT, day DATE, days_ago INT, came_back BOOLEAN, place INT)
RETURN SELECT id, day, days_ago, came_back, place
FROM (SELECT *, row_number() OVER (PARTITION BY customer, category ORDER BY day DESC, id DESC) AS place FROM contact_history) h
WHERE h.customer = similar_contacts.of AND h.category = similar_contacts.about AND h.days_ago <= similar_contacts.within""",
}


def register(history: DataFrame) -> SparkSession:
    """Views and functions over contacts (id, customer, category, day), for this session."""
    spark = history.sparkSession
    history.createOrReplaceTempView("contact")
    for name, body in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {body}")
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return spark


def session(spark: SparkSession, d: str) -> SparkSession:
    return register(contacts(spark, d).select("id", "customer", "category", "day"))


_HISTORY = f"""WITH {CONTACTS}, h AS (SELECT a.id, customer, category, day, date_diff('day', day, DATE '{AS_OF}') AS days_ago,
  EXISTS (SELECT 1 FROM contacts b WHERE b.customer = a.customer AND b.category = a.category AND b.day > a.day AND b.day <= a.day + 7) AS came_back FROM contacts a)"""


@query("q01_contact_history_view", f"{_HISTORY} SELECT id, customer, CAST(days_ago AS INT) AS days_ago, came_back FROM h")
def history_view(spark, d):
    return session(spark, d).sql("SELECT id, customer, days_ago, came_back FROM contact_history")


@query("q02_customer_activity_view", f"{_HISTORY} SELECT customer, CAST(max(day) AS VARCHAR) AS last_day, CAST(min(days_ago) AS INT) AS days_ago, count(*) FILTER (days_ago <= 90) AS recent, count(*) AS total, count(*) FILTER (came_back) AS reopened FROM h GROUP BY customer")
def activity_view(spark, d):
    return session(spark, d).sql("SELECT customer, string(last_day) AS last_day, days_ago, recent, total, reopened FROM customer_activity")


@query("q03_contact_relevance_function", f"""{_HISTORY} SELECT customer, id, CAST(days_ago AS INT) AS days_ago, CASE WHEN days_ago <= 7 THEN 'high' WHEN days_ago <= 30 THEN 'medium' WHEN days_ago <= 90 THEN 'low' ELSE 'none' END AS level,
CAST(CASE WHEN days_ago <= 7 THEN 100 - days_ago * 5 WHEN days_ago <= 30 THEN 65 - (days_ago - 7) * 2 WHEN days_ago <= 90 THEN 20 - (days_ago - 30) // 6 ELSE 0 END AS INT) AS score
FROM h QUALIFY row_number() OVER (PARTITION BY customer ORDER BY day DESC, id DESC) <= 10""")
def contact_relevance(spark, d):
    """The function for every customer, by a lateral join."""
    return session(spark, d).sql("SELECT c.customer, r.id, r.days_ago, r.level, r.score FROM (SELECT DISTINCT customer FROM contact) c, LATERAL contact_relevance(c.customer) r")


@query("q04_profile_relevance_function", f"{_HISTORY}, a AS (SELECT customer, CAST(min(days_ago) AS INT) AS days_ago, count(*) FILTER (days_ago <= 90) AS recent FROM h GROUP BY customer) SELECT c_custkey, coalesce(days_ago, 9999) AS days_ago, coalesce(CASE WHEN days_ago <= 30 THEN 'valid' WHEN days_ago <= 180 THEN 'stale' END, 'outdated') AS relevance, recent FROM customer LEFT JOIN a ON customer = c_custkey")
def profile_relevance(spark, d):
    """Customers without a contact are outdated."""
    spark = session(spark, d)
    spark.read.parquet(f"{d}/customer.parquet").createOrReplaceTempView("all_customers")
    return spark.sql("SELECT c_custkey, coalesce(p.days_ago, 9999) AS days_ago, coalesce(p.relevance, 'outdated') AS relevance, p.recent FROM all_customers LEFT JOIN LATERAL profile_relevance(c_custkey) p ON true")


@query("q05_similar_contacts_function", f"{_HISTORY}, l AS (SELECT customer, max_by(category, (day, id)) AS category FROM h GROUP BY customer) SELECT h.customer, h.id, CAST(days_ago AS INT) AS days_ago, came_back, CAST(row_number() OVER (PARTITION BY h.customer ORDER BY day DESC, h.id DESC) AS INT) AS place FROM h JOIN l USING (customer, category) WHERE days_ago <= 20")
def similar_contacts(spark, d):
    """Each customer's contacts of 20 days about what they called about last."""
    return session(spark, d).sql("SELECT c.customer, s.id, s.days_ago, s.came_back, s.place FROM (SELECT customer, max_by(category, struct(day, id)) AS about FROM contact GROUP BY customer) c, LATERAL similar_contacts(c.customer, c.about, 20) s")
