"""Fuzzy matching of names: similarity in percent, with candidates from an index of letter pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import sound_similarity
from tidewell.operators.relational import top_per_group

#: Shorter texts match nothing: a pair of letters says too little about them.
LEAST_LENGTH = 3


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & places.get(ch, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """Percent of both texts' characters that a common subsequence covers; two empty texts are equal."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one, as long as itself."""
    a, b = sorted((a, b), key=len)
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def weighted_ratio(a: str, b: str) -> float:
    """The ratio; or 0.95 of that of the texts with their words in order; or, where one is 1.5 times as long, 0.9 of the partial one."""
    sort = lambda s: " ".join(sorted(s.split()))
    best = max(ratio(a, b), 0.95 * ratio(sort(a), sort(b)))
    shorter, longer = sorted((len(a), len(b)))
    return max(best, 0.9 * partial_ratio(a, b)) if shorter and longer >= 1.5 * shorter else best


SCORERS = {"weighted": weighted_ratio, "partial": partial_ratio}


def in_order(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def forms(df: DataFrame, text: str) -> DataFrame:
    """text, form (0 as it is, 1 with its words in order), chars, pair (each of neighbouring characters once) and dup, how many pairs repeat another."""
    each = df.select(text, F.posexplode(F.array(F.col(text), in_order(F.col(text)))).alias("form", "of")).withColumn("chars", F.length("of")).filter("chars >= 2")
    pairs = F.transform(F.sequence(F.lit(1), F.col("chars") - 1), lambda i: F.substring("of", i, F.lit(2)))
    each = each.withColumn("pairs", F.array_distinct(pairs))
    return each.select(text, "form", "chars", (F.col("chars") - 1 - F.size("pairs")).alias("dup"), F.explode("pairs").alias("pair"))


def shared_at_least(chars: Column, dup: Column, share: float) -> Column:
    """Different pairs that two texts of so many characters together share, if their ratio is ``share`` or more.

    Of the two texts' pairs, each character that is not common breaks two of its own text and one of the other.
    """
    return chars * (0.5 - 1.5 * (1 - share)) - 1 - dup


def scores(scorer: str):
    score = SCORERS[scorer]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run.asNondeterministic()  # else the filter on the score, and so the score, moves to the rows before they are grouped


def fuzzy_matches(queries: DataFrame, candidates: DataFrame, least: float, scorer: str = "weighted", top: int = 3) -> DataFrame:
    """query, term, score, rank: the ``top`` terms of each query by similarity, of ``least`` percent or more.

    queries: query, text; candidates: term. Texts are compared in lower case without white space at their ends; texts of
    under LEAST_LENGTH characters match nothing. From 78 percent on, two texts of that length share a pair of neighbouring
    characters (an edit breaks two pairs at most), so that only terms under a common pair are scored, and none is missed;
    a lower bound is refused. Equal scores rank by term.
    """
    if least < 78:
        raise ValueError("below 78 percent, texts need not share a pair of letters")
    share = least / 100
    plain = lambda c: F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    q = queries.select("query", plain(F.col("text")).alias("text")).filter(F.length("text") >= LEAST_LENGTH)
    c = candidates.select("term", plain(F.col("term")).alias("name")).distinct().filter(F.length("name") >= LEAST_LENGTH)
    asked = forms(q.select("text").distinct(), "text")  # a text that many queries share is scored once
    index = forms(c.select("name").distinct(), "name").withColumnsRenamed({"chars": "others", "dup": "dups"})
    met = asked.join(index, ["form", "pair"]).groupBy("text", "name", "form", "chars", "others").agg(F.count("*").alias("shared"), F.min(F.least("dup", "dups")).alias("dup"))
    shorter, longer = F.least("chars", "others"), F.greatest("chars", "others")
    at_least = lambda chars, share: F.col("shared") >= shared_at_least(chars, F.col("dup"), share)
    if scorer == "partial":
        may = (F.col("form") == 0) & at_least(2 * shorter, share)
    else:
        whole = at_least(F.col("chars") + F.col("others"), share) | ((longer >= 1.5 * shorter) & at_least(2 * shorter, share / 0.9))
        may = F.when(F.col("form") == 0, whole).otherwise(at_least(F.col("chars") + F.col("others"), share / 0.95))
    met = met.filter(may).select("text", "name").distinct()
    scored = met.withColumn("score", scores(scorer)("text", "name")).filter(F.col("score") >= least)
    named = q.join(scored, "text").join(c, "name").select("query", "term", "score")
    return top_per_group(named, ["query"], [F.desc("score"), "term"], top, "rank")


#: Names that a cascade compares every text with: their table goes to all tasks.
MOST_NAMES = 10_000


def candidate_cascade(queries: DataFrame, names: DataFrame, least: float = 0.6, top: int = 3) -> DataFrame:
    """query, name, score, step, rank: the ``top`` names of each query by the best of four steps, of ``least`` or more.

    The steps, of which the first counts at equal scores, are: equal but for spaces and case, 1; one within the other, 0.80 to 0.98 by their lengths; all words of
    the name in the text, in any order, 0.75; and the similarity of their letters (syllables taken apart). Equal scores
    rank by name. queries: query, text; names: name, MOST_NAMES different ones at most, which is counted: more are
    refused, as then ``fuzzy_matches`` has an index. Each different text is compared once.
    """
    known = names.select("name").filter("name IS NOT NULL").distinct()
    if known.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names")
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    known = known.select("name", plain(F.col("name")).alias("n"), F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != "")).alias("words")).filter("n != ''")
    asked = queries.select("text").distinct().select("text", plain(F.col("text")).alias("t"), F.split(F.lower("text"), r"\s+").alias("has")).filter("t != ''")
    met = asked.crossJoin(F.broadcast(known))
    t, n = F.col("t"), F.col("n")
    inside = t.contains(n) | n.contains(t)
    steps = F.array(
        F.struct(F.when(t == n, 1.0).alias("score"), F.lit("exact").alias("step")),
        F.struct(F.when(inside, 0.80 + 0.18 * F.least(F.length("t"), F.length("n")) / F.greatest(F.length("t"), F.length("n"))).alias("score"), F.lit("contains").alias("step")),
        F.struct(F.when(F.size(F.array_except("words", "has")) == 0, 0.75).alias("score"), F.lit("words").alias("step")),
        F.struct(sound_similarity(t, n).alias("score"), F.lit("sound").alias("step")),
    )
    best = met.withColumn("best", F.array_max(F.transform(steps, lambda s, i: F.struct(F.coalesce(s["score"], F.lit(-1.0)).alias("score"), (-i).alias("order"), s["step"].alias("step")))))
    scored = best.select("text", "name", "best.score", "best.step").filter(F.col("score") >= least)
    return top_per_group(queries.select("query", "text").join(scored, "text").drop("text"), ["query"], [F.desc(F.round("score", 9)), "name"], top, "rank")

