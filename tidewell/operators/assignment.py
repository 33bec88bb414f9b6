"""Assignment of items to agents: the least loaded next, and matching within capacities from narrow groups to wide ones.

Both give every item its place in an order, by range partitions and offsets, and read its agent off that place; no task
goes through all items, and none holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.relational import cut, numbered, running_before, sent_if_small

#: Places of a block, at most.
BLOCK = 10_000


def least_loaded(items: DataFrame, item: str, agents: DataFrame, agent: str, load: str, order: Sequence[Column] = ()) -> DataFrame:
    """item, agent: each item, in order, goes to the agent with the least load so far; of equal ones to the one that began
    with less, then to the smaller id.

    Loads rise like water: between two loads that agents began with, all agents below take turns. So an item's place
    tells which stretch it falls in, and how far into it. ``order`` should tell all items apart; a null load is 0.
    Without agents nothing is assigned.
    """
    ranks = numbered(agents.select(F.col(agent).alias("agent "), F.coalesce(F.col(load), F.lit(0)).cast("long").alias("load ")), [F.col("load "), F.col("agent ")], "seat ")
    steps = ranks.groupBy("load ").agg(F.max("seat ").alias("active "))
    # A stretch takes active * (next load - load) items; the last one takes all that are left.
    at = numbered(steps, [F.col("load ")], "step ")
    following = at.select((F.col("step ") - 1).alias("step "), F.col("load ").alias("next "))
    room = at.join(following, "step ", "left").withColumn("room ", F.col("active ") * (F.col("next ") - F.col("load ")))
    starts = cut(running_before(room, [F.col("step ")], "room ", "start ").withColumn("end ", F.coalesce(F.col("start ") + F.col("room "), F.lit((1 << 62)))))
    placed = numbered(items.select(item, *(o.alias(f"o{i} ") for i, o in enumerate(order))), [F.col(f"o{i} ") for i in range(len(order))] or [F.col(item)], "place ")
    placed = placed.select(item, (F.col("place ") - 1).alias("place "))

    # Places and stretches meet by blocks of places: few enough to a block, and about two rows for each stretch.
    n, m = placed.count(), starts.count()
    width = max(1, min(BLOCK, n // max(m, 1)))
    blocks = F.sequence(F.expr(f"`start ` div {width}"), F.expr(f"least(`end ` - 1, {max(n - 1, 0)}) div {width}"))
    spread = starts.filter((F.col("start ") < n) & (F.col("end ") > F.col("start "))).select("start ", "end ", "active ", F.explode(blocks).alias("block "))
    met = placed.withColumn("block ", F.expr(f"`place ` div {width}")).join(spread, "block ").filter((F.col("place ") >= F.col("start ")) & (F.col("place ") < F.col("end ")))
    seat = (F.col("place ") - F.col("start ")) % F.col("active ") + 1
    return met.select(item, seat.alias("seat ")).join(sent_if_small(ranks), "seat ").select(item, F.col("agent ").alias(agent))


def balance(assigned: DataFrame, agents: DataFrame, agent: str, load: str, most_deviation: float, most_range: int) -> DataFrame:
    """One row: how even the loads are after an assignment, and whether deviation and range stay within their bounds."""
    new = assigned.groupBy(agent).agg(F.count("*").alias("new "))
    total = agents.join(new, agent, "left").select((F.coalesce(F.col(load), F.lit(0)) + F.coalesce("new ", F.lit(0))).alias("n"))
    out = total.agg(F.count("*").alias("agents"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"), F.min("n").alias("least"), F.max("n").alias("most"))
    return out.withColumn("passed", (F.col("deviation") <= most_deviation) & (F.col("most") - F.col("least") <= most_range))


def match_in_rounds(clients: DataFrame, client: str, hosts: DataFrame, host: str, capacity: str, rounds: Sequence[Sequence[str]]) -> DataFrame:
    """client, host, round: each round matches clients and free slots that agree in its columns; what is left goes on.

    Clients take slots in the order of ids, hosts have ``capacity`` slots each, taken one host after the other. No host
    is over its capacity, and a last round without columns matches everyone as long as there are slots. A null in a
    round's column agrees with a null.
    """
    columns = sorted({c for r in rounds for c in r})
    left = clients.select(F.col(client).alias("client "), *columns)
    slots = hosts.filter(F.col(capacity) > 0).select(F.col(host).alias("host "), *columns, F.explode(F.sequence(F.lit(1), F.col(capacity).cast("int"))).alias("slot "))
    found = None
    for i, group in enumerate(rounds):
        a = numbered(left, [F.col("client ")], "n ", group)
        b = numbered(slots, [F.col("host "), F.col("slot ")], "n ", group)
        b = b.select("host ", "slot ", F.col("n ").alias("m "), *(F.col(c).alias(f"{c} ") for c in group))
        same = F.col("n ") == F.col("m ")
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"{c} "))
        met = cut(a.join(b, same).select("client ", "host ", "slot ", F.lit(i + 1).alias("round")))
        found = met if found is None else found.unionByName(met)
        left = cut(left.join(met, "client ", "left_anti"))
        slots = cut(slots.join(met, ["host ", "slot "], "left_anti"))
    return found.select(F.col("client ").alias(client), F.col("host ").alias(host), "round")


def tiered_counts(df: DataFrame, key: str, tiers: Sequence[tuple[str, int, int]], total: int, seed: int) -> DataFrame:
    """key, tier, calls: rows dealt to tiers (name, percent, calls) by a seeded hash, and the calls made up to ``total``.

    What the tiers' calls fall short of the total, or exceed it by, is spread evenly; what that leaves goes to the first
    rows in the hash's order, one each.
    """
    places = numbered(df.select(key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("hash ")), [F.col("hash "), F.col(key)], "place ").drop("hash ")
    n, share, tier, calls = places.count(), 0, F, F
    for name, percent, size in tiers[:-1]:
        share += percent
        fits = F.col("place ") <= n * share // 100
        tier, calls = tier.when(fits, name), calls.when(fits, size)
    rows = cut(places.select(key, "place ", tier.otherwise(tiers[-1][0]).alias("tier"), calls.otherwise(tiers[-1][2]).alias("calls ")))
    gap = total - (rows.agg(F.sum("calls ")).first()[0] or 0)
    each = int(gap / n) if n else 0  # towards zero
    left = gap - each * n
    more = F.when(F.col("place ") <= abs(left), 1 if left > 0 else -1).otherwise(0)
    return rows.select(key, "tier", (F.col("calls ") + each + more).cast("long").alias("calls"))

