"""Mixing sources to target shares.

Texts are aggregated by the set of sources they occur in; a min-cost flow routes
their tokens to the sources' quotas, each further repetition of a text costing
more than the one before; documents are then chosen in a seeded random order along
the flow of their set. Only the sets (at most one row per set that occurs) reach
the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import stage


@dataclass
class Arc:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Min-cost flow by successive cheapest paths with potentials."""

    def __init__(self, nodes: int) -> None:
        self.graph: list[list[Arc]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.graph[a].append(Arc(b, room, cost, len(self.graph[b])))
        self.graph[b].append(Arc(a, 0, -cost, len(self.graph[a]) - 1))
        return a, len(self.graph[a]) - 1

    def through(self, at: tuple[int, int]) -> int:
        arc = self.graph[at[0]][at[1]]
        return self.graph[arc.to][arc.back].room

    def run(self, s: int, t: int) -> int:
        n, total = len(self.graph), 0
        price = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            came: list[tuple[int, int] | None] = [None] * n
            far[s] = 0
            heap: list[tuple[float, int]] = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for k, e in enumerate(self.graph[u]):
                    if e.room > 0 and (x := d + e.cost + price[u] - price[e.to]) < far[e.to]:
                        far[e.to], came[e.to] = x, (u, k)
                        heapq.heappush(heap, (x, e.to))
            if far[t] == float("inf"):
                return total
            for v in range(n):
                if far[v] < float("inf"):
                    price[v] += int(far[v])
            push, v = float("inf"), t
            while v != s:
                u, k = came[v]  # type: ignore[misc]
                push, v = min(push, self.graph[u][k].room), u
            v = t
            while v != s:
                u, k = came[v]  # type: ignore[misc]
                e = self.graph[u][k]
                e.room -= int(push)
                self.graph[v][e.back].room += int(push)
                v = u
            total += int(push)


def routed(sets: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each set of sources gives to each source.

    A source takes at most repeats times the tokens of a set, and all its sources
    together at most the largest of their repeats; the k-th use of a text costs k.
    """
    names, groups = sorted(quota), sorted(sets)
    where = {n: 1 + len(groups) + i for i, n in enumerate(names)}
    end = 1 + len(groups) + len(names)
    flow = Flow(end + 1)
    arcs = {}
    for i, g in enumerate(groups):
        own = [n for n in g if n in where]
        for k in range(max((repeats[n] for n in own), default=0)):
            flow.arc(0, 1 + i, sets[g], k + 1)
        for n in own:
            arcs[g, n] = flow.arc(1 + i, where[n], sets[g] * repeats[n], 0)
    for n in names:
        flow.arc(where[n], end, quota[n], 0)
    flow.run(0, end)
    return {k: f for k, at in arcs.items() if (f := flow.through(at))}


def attainable(sets: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total, in tokens, of which every source can give its share."""
    held = sum(sets.values()) * max(repeats.values(), default=1)
    low, high = 0, held
    while low < high:
        middle = (low + high + 1) // 2
        quota = {n: int(middle * s) for n, s in shares.items()}
        if sum(routed(sets, quota, repeats).values()) == sum(quota.values()):
            low = middle
        else:
            high = middle - 1
    return low


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, rows_per_group: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    docs: (key, source, tokens, digest); targets: (source, target_share,
    max_repeats). mix: (key, source, uses, tokens) of every document used; shares:
    (source, target_share, tokens, share, quota, reached) with the share really
    reached of all tokens. total: tokens wanted; None takes the largest total at which
    every source can give its share, and a larger one leaves sources short.

    Documents of one text in one source count as one (the least key), so no text is
    used more often by copies. Texts without tokens, and of sources without a
    target, are not used. Targets are few rows; shares that are null or not above 0 get nothing.
    """
    spark = docs.sparkSession
    goal = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").distinct().collect()]
    shares, repeats = {s: t for s, t, _ in goal}, {s: r for s, _, r in goal}
    known = docs.where(F.col("source").isin(list(shares)) & (F.col("tokens") > 0) & F.col("key").isNotNull())
    per_source = known.groupBy("digest", "source").agg(F.min("key").alias("key"), F.max("tokens").alias("tokens"))
    texts = per_source.groupBy("digest").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "key"))).alias("held"))
    texts = stage(texts.select("digest", "tokens", "held", F.transform("held", lambda x: x["source"]).alias("set")), "mix-texts")
    by_set = texts.groupBy("set").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()  # at most one row per set of sources
    sets = {tuple(r["set"]): int(r["tokens"]) for r in by_set}
    want = attainable(sets, shares, repeats) if total is None else total
    quota = {n: int(want * s) for n, s in shares.items()}
    flows = routed(sets, quota, repeats)

    # on a set's line, lap after lap of its texts, each source has one stretch
    stretches: dict[tuple[str, ...], list[tuple[str, int, int]]] = {}
    for (g, n), f in sorted(flows.items()):
        rows = stretches.setdefault(g, [])
        at = rows[-1][2] if rows else 0
        rows.append((n, at, at + f))
    plan = spark.sparkContext.broadcast({"|".join(g): (sets[g], rows) for g, rows in stretches.items()})

    groups = max(1, -(-max((r["n"] for r in by_set), default=1) // rows_per_group))
    chosen = texts.select("digest", "tokens", "held", F.array_join("set", "|").alias("set"), F.xxhash64(F.lit(seed), "digest").alias("h")).withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int"))
    before = chosen.groupBy("set", "g").agg(F.sum("tokens").alias("t"))
    before = before.select("set", "g", (F.sum("t").over(Window.partitionBy("set").orderBy("g")) - F.col("t")).alias("before"))
    within = Window.partitionBy("set", "g").orderBy("h", "digest")
    placed = chosen.withColumn("at", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).join(before, ["set", "g"]).withColumn("at", F.col("at") + F.col("before"))

    @F.pandas_udf("array<struct<source:string,uses:int>>")
    def uses(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, ats, lengths in batches:
            out = []
            for g, at, n in zip(names, ats, lengths, strict=True):
                lap, rows = plan.value.get(g, (0, []))
                middle = at + n / 2
                got = []
                for source, a, b in rows:  # laps whose middle lies in the stretch
                    k = int(np.ceil((b - middle) / lap) - np.ceil((a - middle) / lap))
                    if k > 0:
                        got.append({"source": source, "uses": k})
                out.append(got)
            yield pd.Series(out)

    used = placed.select("tokens", "held", F.explode(uses("set", "at", "tokens")).alias("u"))
    mix = stage(used.select(F.expr("filter(held, x -> x.source = u.source)[0].key").alias("key"), F.col("u.source").alias("source"), F.col("u.uses").alias("uses"), "tokens"), "mix")
    reached = mix.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    wanted = spark.createDataFrame([(s, t, quota[s]) for s, t, _ in goal], "source string, target_share double, quota long")
    every = wanted.join(reached, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return mix, every.select("source", "target_share", "quota", "tokens", (F.col("tokens") / whole).alias("share"), (F.col("tokens") >= F.col("quota") * 0.99).alias("reached"))
