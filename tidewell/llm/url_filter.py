"""URL verdicts from host/path rules, else from a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import ascii_lower, named, read

#: One of these rejects an url.
STRICT = ("adult", "casino", "gambling", "nsfw", "phishing", "pills", "porn", "spam", "viagra", "warez", "xxx")
#: Two different ones of these reject it.
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "click", "deal", "farm", "free", "jackpot", "loan", "promo", "track", "win")
MIN_SOFT = 2
#: (verdict, rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """A pandas UDF: distinct strict and soft terms of a lower-cased text that stand between non-alphanumerics."""

    @F.pandas_udf("strict int, soft int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for kind, terms in enumerate((strict, soft)):
            for term in terms:
                automaton.add_word(term, (kind, term))
        automaton.make_automaton()
        edge = lambda text, at: not 0 <= at < len(text) or not (text[at].isascii() and text[at].isalnum())
        for texts in batches:
            rows = []
            for text in texts:
                found = {hit for end, hit in automaton.iter(text) if edge(text, end + 1) and edge(text, end - len(hit[1]))}
                rows.append((sum(k == 0 for k, _ in found), sum(k == 1 for k, _ in found)))
            yield pd.DataFrame(rows, columns=["strict", "soft"], dtype="int32")

    return hits


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """id_col, host, path, rule, verdict, strict_hits, soft_hits of every row.

    The longest fitting rule decides, of equally long ones the first in text order; without one, the vocabulary over
    the whole url does, query and fragment included. A null url or one without ``://`` has an empty host and path and no
    rule; a null one counts as the empty text. Repeated rows each get their row; other columns are ignored.
    """
    url = F.coalesce(named(url_col), F.lit(""))
    rows = pages.select(named(id_col).alias("id"), ascii_lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"), ascii_lower(url).alias("whole"))
    chosen = verdict = F.lit(None).cast("string")
    first_in_text = sorted(rules, key=lambda x: x[1], reverse=True)
    for kind, rule in sorted(first_in_text, key=lambda x: len(x[1])):  # the last one wraps the others
        at = rule.index("/")
        fits = ((F.col("host") == rule[:at]) | F.col("host").endswith("." + rule[:at])) & F.col("path").startswith(rule[at:])
        chosen, verdict = F.when(fits, rule).otherwise(chosen), F.when(fits, kind).otherwise(verdict)
    rows = rows.withColumns({"rule": chosen, "verdict": verdict, "hits": vocabulary_hits(strict, soft)(F.col("whole"))})
    rejected = (F.col("hits.strict") >= 1) | (F.col("hits.soft") >= min_soft)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(rejected, "block").otherwise("allow")).alias("verdict"), F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def _count(terms: Sequence[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(hp, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INT)" for t in terms)


ORACLE_SQL = f"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '{URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, coalesce(url, '') AS whole
  FROM pages),
r(kind, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(kind, length(rhost || rpath)) AS kind
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
n AS (SELECT *, translate(whole, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS hp FROM u),
c AS (SELECT page_id, host, path, CAST({_count(STRICT)} AS INT) AS strict_hits, CAST({_count(SOFT)} AS INT) AS soft_hits FROM n)
SELECT c.page_id, host, path, rule, coalesce(kind, CASE WHEN strict_hits >= 1 OR soft_hits >= {MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM c LEFT JOIN hit USING (page_id)
"""
