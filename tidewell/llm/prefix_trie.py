"""The trie of all conversations' prefixes, by chained digests.

A turn's digest covers its role and text, and a prefix's digest covers the digest of the prefix before it and its last
turn's: equal digests at one depth are equal prefixes, all the way up. So nodes are groups of (depth, digest), whose hot
ones (the root, a frequent first turn) are counts and minima that Spark combines before the shuffle.

For sums over subtrees, a node is counted at all of its ancestors. Those lie on the path of any member; the smallest
member of a node stands for it, and the nodes that one conversation stands for are first summed up along its path, so
that a conversation sends one row for each of its prefixes, not one for each pair of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import read, stored

ROOT = bytes(32)
#: Ids that are joined to one text before the texts of a node meet.
ID_BLOCK = 256


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn with nulls first, then role and text), unit (the turn's digest) and bytes of its text."""
    said = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    unit = F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256))
    return said.select("conv_id", pos.cast("long").alias("pos"), unit.alias("unit"), F.octet_length("text").cast("long").alias("bytes"))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order with the digest of the prefix that each ends, and of the one before; only the last digest is held."""
    last = ROOT
    for batch in batches:
        digests, parents = [], []
        for depth, unit in zip(batch.column("depth").to_pylist(), batch.column("unit").to_pylist(), strict=True):
            parents.append(ROOT if depth == 1 else last)
            last = hashlib.sha256(parents[-1] + unit).digest()
            digests.append(last)
        columns = [batch.column(c) for c in ("conv_id", "depth", "bytes", "ends")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), pa.array(parents, pa.binary())], names=["conv_id", "depth", "bytes", "ends", "digest", "parent"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node over its texts in order, comma-joined; a node's texts are never held together."""
    now, so_far, names = None, None, ["depth", "digest", "ends_sha256"]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=names)
    for batch in batches:
        out = []
        for depth, digest, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
            if now != (depth, digest):
                if now is not None:
                    out.append((*now, so_far.hexdigest()))
                now, so_far = (depth, digest), hashlib.sha256(text.encode())
            else:
                so_far.update(f",{text}".encode())
        if out:
            yield make(out)
    if now is not None:
        yield make([(*now, so_far.hexdigest())])


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each distinct prefix: depth, digest, conv_id (smallest member), parent and parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has each conv_id once, with n_turns; ``turns`` has conv_id, depth (from 1 without gaps), n_turns,
    unit (the turn's digest) and bytes. Conversations without turns are members of the root only. A null conv_id is a
    conversation like others, but counts as the smallest member only where it is the only one, and not in ends_sha256.
    Without conversations there are no nodes. A conversation's chain is one task's, which holds one digest of it.
    """
    at_root = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), (F.col("n_turns") == 0).alias("ends"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"))
    rows = turns.select("conv_id", "depth", "bytes", (F.col("depth") == F.col("n_turns")).alias("ends"), "unit")
    chains = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(chained, "conv_id long, depth long, bytes long, ends boolean, digest binary, parent binary")
    prefixes = stored(at_root.unionByName(chains))

    node = ["depth", "digest"]
    nodes = stored(prefixes.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("parent").alias("parent"), F.bool_and("ends").alias("childless")))

    # What each conversation stands for, at and below each of its prefixes; then summed by prefix.
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), F.col("childless").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    nothing = F.lit(0).cast("long")
    path = prefixes.select("conv_id", *node, nothing.alias("leaves"), nothing.alias("saved")).unionByName(own)
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    path = path.select(*node, F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved")).filter("digest IS NOT NULL AND (leaves > 0 OR saved > 0)")
    sums = path.groupBy(*node).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    block = F.floor(F.col("conv_id") / ID_BLOCK)
    texts = prefixes.filter("ends AND conv_id IS NOT NULL").groupBy(*node, block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    ends = texts.repartition(*node).sortWithinPartitions(*node, "block").mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))

    out = nodes.join(children, node, "left").join(sums, node, "left").join(ends, node, "left").join(above, ["depth", "parent"], "left")
    zero = lambda c: F.coalesce(F.col(c), nothing).alias(c)
    return out.select(*node, "conv_id", "parent", "parent_conv_id", "n_convs", zero("n_children"), zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, family: int = 5, lengths: int = 9) -> tuple[DataFrame, DataFrame]:
    """The two tables of prefix_trie for conversations that begin with the first h turns of their family's first one.

    That one is c - c % family, and h the CRC-32 of c as decimal text, modulo ``lengths``; a null id counts as the empty
    text and has no family. The turns after a conversation's own first h follow.
    """
    said = stored(numbered(conversations))
    c = F.col("conv_id")
    all_of = said.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (c - c % family).alias("first"), (F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % lengths).alias("h"))
    lead = F.least("h", F.coalesce("n_first", F.lit(0).cast("long")))
    convs = all_of.join(all_of.select(c.alias("first"), F.col("n").alias("n_first")), "first", "left").select("conv_id", "first", "h", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    begun = said.filter(F.col("pos") < lengths).withColumnRenamed("conv_id", "first").join(convs.select("conv_id", "first", "h", "n_turns"), "first").filter("pos <= h")
    own = said.join(convs.select(c.alias("id"), "h", "lead", "n_turns"), c.eqNullSafe(F.col("id"))).filter("pos > h")
    columns = ["n_turns", "unit", "bytes"]
    return convs, begun.select("conv_id", F.col("pos").alias("depth"), *columns).unionByName(own.select("conv_id", (F.col("lead") + F.col("pos") - F.col("h")).alias("depth"), *columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = rebuilt(read(spark, sf_dir, "conversations"))
    return prefix_trie(convs, turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations),
b AS (SELECT c, flatten(list_transform(string_split(coalesce(CAST(c AS VARCHAR), ''), ''), lambda x: list_transform(range(8), lambda i: (ascii(x) >> i) & 1))) AS bits, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(bits, lambda x: CAST(x AS BIGINT))), lambda a, x: xor(a >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 9 AS h FROM b),
r AS (SELECT h.c, list_concat(coalesce(f.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN h f ON f.c = h.c - h.c % 5),
p AS (SELECT c, d, turns[1:d] AS path, len(turns) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].text) END AS bytes FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, bool_and(ends) AS childless, (count(*) - 1) * any_value(bytes) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, path),
s AS (SELECT e AS d, path[1:e] AS path, sum(CAST(childless AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (e = d - 1) AS n_children FROM (SELECT *, unnest(range(d + 1)) AS e FROM n) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.d = n.d AND s.path = n.path LEFT JOIN n u ON u.d = n.d - 1 AND u.path = n.path[1:n.d - 1]
"""
