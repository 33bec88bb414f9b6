"""MinHash near-deduplication by an inverted join over signature coordinates.

1. Documents with equal shingle sets are one set from here on, so exact copies cost nothing further.
2. A set is posted under the coordinate-value pairs of its signature. Two sets that should link agree on at least
   ``least_matches`` coordinates, so they meet under one of the rarest ``K - least_matches + 1`` pairs of either (the
   prefix); pairs that nobody shares fill the prefix first and are never joined.
3. A posting is not expanded into pairs: its members go to the group of the posting's most central member, the hub.
   Groups are dealt in blocks, each with a copy of the hub. A block's members are compared with the hub first and then
   with each other: collisions of whole signatures are counted, what is already connected is skipped, and the rest is
   confirmed on full sets. So a member is sent once, however large its group.
4. Only members that their block does not connect with the hub go on to the group's other blocks.
5. The links' connected components give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read
from tidewell.llm.common import named as column
from tidewell.llm.components import connected_components

COORDINATES = 64
#: A link at the similarity bound is lost with at most this probability.
MISS = 1e-9
#: Members of one block, and bytes of their sets, as far as a hash deals evenly.
BLOCK, BLOCK_BYTES = 256, 32 << 20

_RNG = np.random.default_rng(20240229)
FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def least_matches(percent: int) -> int:
    """The largest number of equal coordinates that a pair at the bound reaches with probability 1 - MISS."""
    p, below = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        below += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if below > MISS:
            return max(1, k)
    return COORDINATES


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles: words are split at ASCII white space, A-Z lower-cased."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), dtype=np.uint64, count=len(split))
    n = min(words, len(h))
    if not n:
        return h
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
        s ^= s >> np.uint64(31)
    s *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash under each coordinate; the coordinate is mixed in, so equal values mean equal coordinates."""
    least = np.full(COORDINATES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        h = FACTORS[:, None] * s[None, at : at + 2048] + SHIFTS[:, None]
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=1), out=least)
    return least * np.uint64(0x9E3779B97F4A7C15) + np.arange(COORDINATES, dtype=np.uint64)


def sketch(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sets = [shingles(t, words) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "id": part["id"].array,
                        "tid": part["tid"].array,
                        "n": [len(s) for s in sets],
                        "rep": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "sig": [signature(s).view(np.int64) if len(s) else None for s in sets],
                    }
                )

    return run


def set_bytes(words: int):
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, words).tobytes())

    return run


class Members:
    """Signatures and full sets of rows (rep, sig, items), and what is connected among them."""

    def __init__(self, pdf: pd.DataFrame, percent: int) -> None:
        self.rep, self.percent, self.least = pdf["rep"].tolist(), percent, least_matches(percent)
        self.sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.int64).reshape(len(pdf), COORDINATES)
        self.sets = [np.frombuffer(b, dtype=np.uint64) for b in pdf["items"]]
        self.size, self.label, self.found = np.array([len(s) for s in self.sets]), np.arange(len(pdf)), []

    def link(self, x: int, others: np.ndarray) -> None:
        """Confirm links of x with others that it is not connected with."""
        others = others[self.label[others] != self.label[x]]
        others = others[(self.sig[others] == self.sig[x]).sum(axis=1) >= self.least]
        mine = self.sets[x]
        for part in np.array_split(others, 1 + self.size[others].sum() // 2_000_000) if len(others) else ():
            if not len(part):
                continue
            items = np.concatenate([self.sets[y] for y in part])
            at = np.minimum(np.searchsorted(mine, items), len(mine) - 1)
            common = np.add.reduceat((mine[at] == items).astype(np.int64), np.cumsum(self.size[part]) - self.size[part])
            for y in part[100 * common >= self.percent * (len(mine) + self.size[part] - common)]:
                if self.label[x] != self.label[y]:
                    self.found.append((self.rep[x], self.rep[y]))
                    self.label[self.label == self.label[y]] = self.label[x]


def link_block(percent: int):
    """Links within a block, the hub's first; and (hub, member) of what it does not connect with the hub."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["central", "rep"], ascending=[False, True]).drop_duplicates("rep").reset_index(drop=True)
        m = Members(pdf, percent)
        for x in range(len(pdf)):
            if (m.label == m.label[0]).all():
                break
            m.link(x, np.arange(x + 1, len(pdf)))
        rest = np.flatnonzero(m.label != m.label[0])
        return pd.DataFrame([(*f, False) for f in m.found] + [(m.rep[0], m.rep[y], True) for y in rest], columns=["a", "b", "rest"])

    return run


def link_rest(percent: int):
    """Links of unconnected members with another block of their group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        m, block = Members(pdf, percent), pdf["block"].to_numpy()
        first, other = np.flatnonzero(pdf["first"]), np.flatnonzero(~pdf["first"])
        m.label[other[~pdf["rest"].to_numpy()[other]]] = len(pdf)  # connected through the hub
        for x in first:
            m.link(x, other[block[other] != block[x]])
        return pd.DataFrame(m.found, columns=["a", "b"])

    return run


def links(sketches: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect just what all links of similar sets connect. texts: id, tid, text."""
    sets = sketches.filter("n > 0").groupBy("rep").agg(F.first("sig").alias("sig"), F.min(F.struct("id", "tid")).alias("at"), F.first("n").alias("size"))
    posts = sets.select("rep", F.explode("sig").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    prefix = COORDINATES - least_matches(percent) + 1
    met = posts.join(shared, "token").groupBy("rep").agg(F.sum("n").alias("weight"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    room = F.greatest(F.lit(0), prefix - (COORDINATES - F.size("tokens")))  # pairs of its own come first in the prefix
    posted = cut(met.select("rep", "weight", F.explode(F.slice("tokens", F.lit(1), room)).alias("t")).select("rep", "weight", F.col("t.token").alias("token")))
    centre = posted.groupBy("token").agg(F.max(F.struct("weight", "rep")).alias("c"), F.count("*").alias("n")).filter("n > 1")
    members = cut(posted.select("token", "rep").join(centre.select("token", F.col("c.rep").alias("hub")), "token").select("hub", "rep").distinct())

    wanted = sets.join(members.select("rep").distinct(), "rep", "left_semi")
    same = texts["id"].eqNullSafe(F.col("at.id")) & (texts["tid"] == F.col("at.tid"))
    full = texts.join(wanted, same).select("rep", "sig", "size", "text").dropDuplicates(["rep"])
    as_bytes = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, dtype=np.int64).tobytes()), "binary")
    full = cut(full.select("rep", "size", as_bytes("sig").alias("sig"), set_bytes(words)("text").alias("items")))

    room = F.greatest(F.count("*") / BLOCK, F.sum("size") * 8 / BLOCK_BYTES)
    sizes = cut(members.join(full.select("rep", "size"), "rep").groupBy("hub").agg(F.ceil(room).cast("int").alias("blocks")))
    dealt = members.filter("hub != rep").join(sizes, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("central"))
    hubs = sizes.select("hub", F.col("hub").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("central"))
    data = full.select("rep", "sig", "items")
    found = cut(dealt.unionByName(hubs).join(data, "rep").groupBy("hub", "block").applyInPandas(link_block(percent), "a binary, b binary, rest boolean"))

    # What a block does not connect with its hub meets the other blocks of the group, and nothing else does.
    rest = found.filter("rest").select(F.col("a").alias("hub"), F.col("b").alias("rep")).join(sizes.filter("blocks > 1"), "hub")
    rest = cut(rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    parts = rest.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    i = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    every = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block"))
    firsts = rest.join(parts, "hub").select("hub", "rep", "block", F.lit(True).alias("first"), F.lit(True).alias("rest"), i.alias("i"), F.explode(every).alias("j"))
    others = dealt.join(parts, "hub").join(rest.select("hub", "rep", F.lit(True).alias("rest")), ["hub", "rep"], "left")
    others = others.select("hub", "rep", "block", F.lit(False).alias("first"), F.coalesce("rest", F.lit(False)).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"))
    more = firsts.unionByName(others).join(data, "rep").groupBy("hub", "i", "j").applyInPandas(link_rest(percent), "a binary, b binary")
    return found.filter("not rest").select("a", "b").unionByName(more).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", text_key: str | None = None) -> DataFrame:
    """id_col, n_shingles, component_id and kept of every row.

    Texts link if their sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more; component_id
    is the least id that links reach. A text without words, or a null one, links with nothing; a shorter one than a
    shingle is one shingle. Null ids never name a component that has others, and are kept only where all are null.
    Repeated rows share a component, and rows that repeat its least id are all kept.

    With text_key, a column of that name has the hash of each text, and of a component with words only the text that
    comes first is kept: the least by id, null ids last, then hash. Rows that repeat both id and text are one text.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), F.xxhash64(column(text_col)).alias("tid"))
    kind = dict(rows.dtypes)["id"]  # ids pass pandas as text: next to a null, it would make long ones doubles
    sketches = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(sketch(words), "id string, tid long, n long, rep binary, sig array<long>")
    sketches = cut(sketches.withColumn("id", F.col("id").cast(kind)))
    classes = connected_components(links(sketches, rows, words, percent), "a", "b")
    key = F.struct(F.isnull("id").alias("no_id"), "id", "tid") if text_key else F.col("id")
    light = sketches.select("id", "n", "rep", *(["tid"] if text_key else []))
    least = light.filter("n > 0").groupBy("rep").agg(F.min(key).alias("least")).join(classes, F.col("rep") == F.col("node"), "left").select("rep", "least", F.coalesce("component", "rep").alias("component"))
    linked = classes.select("component").distinct()
    of_class = least.join(linked, "component", "left_semi").groupBy("component").agg(F.min("least").alias("of_class"))
    named = least.join(of_class, "component", "left").select("rep", F.coalesce("of_class", "least").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.unhex(F.hex(F.xxhash64("id", "n"))))  # no single key for empty texts
    out = light.withColumn("rep", own).join(named, "rep", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(key))
    component, kept = F.col("component_id"), F.col("id").eqNullSafe(F.col("component_id"))
    if text_key:
        component, kept = F.col("component_id.id"), (F.col("n") == 0) | (key == F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *([F.col("tid").alias(text_key)] if text_key else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT DISTINCT x AS doc_id, x AS c FROM p UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM s LEFT JOIN m USING (doc_id)
"""
