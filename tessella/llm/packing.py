"""Filling fixed-capacity containers.

The configuration linear program over the histogram of sizes is solved by
multiplicative weights, each step pricing one configuration by a knapsack dynamic
program; the solution is rounded down and what is left is packed best fit
decreasing, still on the histogram. Items are then placed by their rank among the
items of their size, so nothing but the histogram (at most one entry per token of
capacity) and the plan made of it ever reach the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRID = 512  # steps into which pricing divides a capacity
STEP = 0.5  # share of a size's items that one pricing step may cover
RATE = 6.0  # how fast the weight of a covered size falls


def _priced(weight: np.ndarray, allowed: np.ndarray, grid: int) -> dict[int, int]:
    """The configuration of greatest weight: an unbounded knapsack, its multiplicities held to what there is."""
    w = np.where(weight > 0, weight, -np.inf)
    best = np.zeros(grid + 1)
    for c in range(1, grid + 1):
        best[c] = max(best[c - 1], (w[1 : c + 1] + best[c - 1 :: -1][:c]).max())
    out: dict[int, int] = {}
    left = allowed.copy()
    c = grid
    while c > 0:
        usable = np.where(left[1 : c + 1] > 0, w[1 : c + 1], -np.inf) + best[c - 1 :: -1][:c]
        k = int(usable.argmax())
        if usable[k] == -np.inf:
            break
        if best[c - 1] > usable[k] + 1e-12:
            c -= 1
            continue
        s = k + 1
        out[s] = out.get(s, 0) + 1
        left[s] -= 1
        c -= s
    return out


def solve(counts: np.ndarray, grid: int) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often the linear program uses each, by multiplicative weights.

    counts[s]: items of size s, 0 < s <= grid. The weight of a size falls by the
    exponential of its coverage; a covered size drops out.
    """
    n = counts.astype(float)
    size = np.arange(grid + 1)
    covered = np.zeros(grid + 1)
    used: dict[tuple[tuple[int, int], ...], float] = {}
    while True:
        live = (n > 0) & (covered < 1 - 1e-9)
        if not live.any():
            break
        weight = np.where(live, size / grid * np.exp(-RATE * covered), 0.0)
        need = np.ceil(n * (1 - covered) - 1e-9)
        p = _priced(weight, np.where(live, need, 0), grid)
        at = np.fromiter(p, dtype=int)
        per = np.fromiter(p.values(), dtype=float)
        t = max(min(np.maximum(n[at] * STEP, 1) / per), 1.0)
        t = min(t, max(min(n[at] * (1 - covered[at]) / per), 1e-9)) if (n[at] * (1 - covered[at]) / per >= 1).all() else min(n[at] * (1 - covered[at]) / per)
        covered[at] += per * t / n[at]
        key = tuple(sorted(p.items()))
        used[key] = used.get(key, 0.0) + t
    return [(dict(k), x) for k, x in used.items()]


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(configuration in exact sizes, containers filled so)] that holds every item of the histogram once."""
    unit = max(1, -(-capacity // GRID))
    grid = capacity // unit
    left = {s: n for s, n in sizes.items() if n > 0}
    classes: dict[int, list[int]] = {}
    for s in sorted(left, reverse=True):
        classes.setdefault(min(-(-s // unit), grid), []).append(s)
    counts = np.zeros(grid + 1, dtype=np.int64)
    for c, members in classes.items():
        counts[c] = sum(left[s] for s in members)
    out: list[tuple[dict[int, int], int]] = []
    stock = sorted(left)
    for p, x in sorted(solve(counts, grid), key=lambda t: -t[1]) if left else []:
        copies = int(x + 1e-9)
        while copies > 0:
            exact = _exact(p, classes, left)
            if exact is None or sum(s * a for s, a in exact.items()) > capacity:
                break
            stock = _filled_up(exact, left, stock, capacity)
            t = min(copies, *(left[s] // a for s, a in exact.items()))
            for s, a in exact.items():
                left[s] -= a * t
            out.append((exact, t))
            copies -= t
    out += _best_fit({s: n for s, n in left.items() if n > 0}, capacity)
    return out


def _exact(p: dict[int, int], classes: dict[int, list[int]], left: dict[int, int]) -> dict[int, int] | None:
    """Sizes in stock for a configuration in steps of the grid, largest first; None if the stock doesn't suffice."""
    out: dict[int, int] = {}
    for c, a in p.items():
        for s in classes[c]:
            take = min(a, left[s])
            if take:
                out[s] = take
                a -= take
            if not a:
                break
        if a:
            return None
    return out


def _filled_up(p: dict[int, int], left: dict[int, int], stock: list[int], capacity: int) -> list[int]:
    """Puts into p what still fits, largest first; returns the sizes in stock."""
    room = capacity - sum(s * a for s, a in p.items())
    at = bisect.bisect_right(stock, room)
    while at and room >= stock[0]:
        s = stock[at - 1]
        if left[s] <= 0:
            stock = [x for x in stock if left[x] > 0]
            at = bisect.bisect_right(stock, room)
            continue
        take = min(left[s] - p.get(s, 0), room // s)
        if take > 0:
            p[s] = p.get(s, 0) + take
            room -= take * s
        at = min(at - 1, bisect.bisect_right(stock, room))
    return stock


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Largest size first, each container then filled with the largest that still fit; like containers are one entry."""
    out: list[tuple[dict[int, int], int]] = []
    stock = sorted(left)
    while stock:
        room, p = capacity, {}
        at = len(stock)
        while at and room >= stock[0]:
            at = min(at, bisect.bisect_right(stock, room))
            if not at:
                break
            s = stock[at - 1]
            take = min(left[s] - p.get(s, 0), room // s)
            if take:
                p[s] = p.get(s, 0) + take
                room -= take * s
            at -= 1
        t = min(left[s] // a for s, a in p.items())
        for s, a in p.items():
            left[s] -= a * t
        stock = [s for s in stock if left[s] > 0]
        out.append((p, t))
    return out


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs at least."""
    return max(-(-sum(s * n for s, n in sizes.items()) // capacity), sum(n for s, n in sizes.items() if 2 * s > capacity))


def packed(items: DataFrame, capacity: int, rows_per_group: int = 50_000) -> DataFrame:
    """(key, part, tok_start, tok_end, size, container, fill) of every piece.

    items: (key, tokens). An item of more than capacity tokens is cut into full
    pieces and a rest; no other is cut. Items without tokens take no room and are
    left out; a key delivered again counts once; equal sizes are ordered by a hash
    of the key. fill is the share of the container's capacity that is used.
    """
    spark = items.sparkSession
    once = items.where("key is not null and tokens > 0").groupBy("key").agg(F.max("tokens").cast("int").alias("tokens"))
    cut = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))
    pieces = once.select("key", "tokens", F.explode(cut).alias("part")).select("key", "part", (F.col("part") * capacity).alias("tok_start"), F.least("tokens", (F.col("part") + 1) * capacity).alias("tok_end")).withColumn("size", F.col("tok_end") - F.col("tok_start"))
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity entries
    made = plan(histogram, capacity)
    return _assigned(spark, pieces, histogram, made, capacity, rows_per_group)


def _assigned(spark: SparkSession, pieces: DataFrame, histogram: dict[int, int], made: list[tuple[dict[int, int], int]], capacity: int, rows_per_group: int) -> DataFrame:
    # slots of each size, in order: from which rank on, in which containers, how many in each
    starts: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for p, t in made:
        fill = sum(s * a for s, a in p.items())
        for s, a in p.items():
            starts.setdefault(s, []).append((seen.get(s, 0), base, a, fill))
            seen[s] = seen.get(s, 0) + a * t
        base += t
    table = spark.sparkContext.broadcast({s: (np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])) for s, rows in starts.items()})
    # a size may have a third of all items, so they are ranked in groups of bounded size
    groups = max(1, -(-max(histogram.values(), default=1) // rows_per_group))
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("key", "part"), F.lit(groups)).cast("int"))
    before = grouped.groupBy("size", "g").agg(F.count("*").alias("n"))
    before = before.select("size", "g", (F.sum("n").over(Window.partitionBy("size").orderBy("g")) - F.col("n")).alias("before"))
    ranked = grouped.withColumn("r", F.row_number().over(Window.partitionBy("size", "g").orderBy(F.xxhash64("key"), "key", "part"))).join(before, ["size", "g"]).withColumn("r", F.col("r") + F.col("before") - 1)

    @F.pandas_udf("struct<container:long,fill:double>")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for size, rank in batches:
            container, fill = np.zeros(len(size), dtype=np.int64), np.zeros(len(size))
            sizes, ranks = size.to_numpy(), rank.to_numpy()
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                first, rows = table.value[int(s)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                container[at] = rows[k, 0] + (ranks[at] - first[k]) // rows[k, 1]
                fill[at] = rows[k, 2] / capacity
            yield pd.DataFrame({"container": container, "fill": fill})

    return ranked.select("key", "part", "tok_start", "tok_end", "size", place("size", "r").alias("p")).select("key", "part", "tok_start", "tok_end", "size", "p.container", "p.fill")
