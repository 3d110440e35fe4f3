"""Runs, intervals and neighbours in ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str, how: str = "sum", own: bool = True, part: Column | None = None) -> DataFrame:
    """df with name: the sum, max or last given value of the rows up to each (own) or before it.

    part splits a key's rows into stretches that follow each other in the order (a column that never falls along it): each
    stretch is a window of its own and takes over what the stretches before it came to, so that a key of any size is shared
    out. Without it a key is one window.
    """
    to = 0 if own else -1
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    if part is None:
        return df.withColumn(name, over(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, to)))
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    v = df.withColumn("_v", value).withColumn("_part", part)
    whole = {"sum": F.sum("_v"), "max": F.max("_v"), "last": F.max_by("_v", F.when(F.col("_v").isNotNull(), place))}[how]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = v.groupBy(*keys, "_part").agg(whole.alias("_whole")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), over(F.col("_whole")).over(before).alias("_carry")).where("_carry is not null")
    inner = v.withColumn("_in", over(F.col("_v")).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, to)))
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = {"sum": F.coalesce(F.col("_in") + F.col("_carry"), F.col("_in"), F.col("_carry")), "max": F.greatest("_in", "_carry"), "last": F.coalesce("_in", "_carry")}[how]
    return inner.join(parts, same, "left").withColumn(name, both).drop("_v", "_part", "_in", "_p", "_carry", *[f"_k{i}" for i in range(len(keys))])


def gap_islands(df: DataFrame, keys: Sequence[str], at: Column, gap: Column | float, tie: Sequence[str] = (), part: Column | None = None) -> DataFrame:
    """df with island: rows of a key number up from 0 whenever the step from the row before exceeds gap."""
    order = [at, *tie]
    marked = running(df, keys, order, at, "_prev", "last", own=False, part=part)
    marked = marked.withColumn("_new", F.when(at - F.col("_prev") > gap, 1).otherwise(0))
    return running(marked, keys, order, F.col("_new"), "island", "sum", part=part).drop("_new", "_prev")


def value_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run", part: Column | None = None) -> DataFrame:
    """df with name: rows of a key number up from 1 whenever the value differs from that of the row before."""
    marked = running(df, keys, order, F.struct(value), "_prev", "last", own=False, part=part)
    marked = marked.withColumn("_new", F.when(F.col("_prev").isNotNull() & F.col(value).eqNullSafe(F.col(f"_prev.{value}")), 0).otherwise(1))
    return running(marked, keys, order, F.col("_new"), name, "sum", part=part).drop("_new", "_prev")


def interval_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, slack: float = 0, width: int | None = None) -> DataFrame:
    """Merged intervals (keys, start, end, parts): those that overlap, touch, or lie within slack are one. width: the length of line that one window takes; without it a key is one window."""
    part = None if width is None else F.floor(F.col(start) / width)
    marked = running(df, keys, [start, end], F.col(end), "_reach", "max", own=False, part=part).withColumn("_new", F.when(F.col(start) > F.col("_reach") + slack, 1).otherwise(0))
    marked = running(marked, keys, [start, end], F.col("_new"), "_i", "sum", part=part)
    return marked.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_i")


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """(keys, covered): length of the union of half-open intervals."""
    return interval_islands(df, keys, start, end, width=width).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def carried_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, part: Column | None = None) -> DataFrame:
    """df with the last non-null value of column up to each row."""
    return running(df, keys, order, F.col(column), name, "last", part=part)


def next_given(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, part: Column | None = None) -> DataFrame:
    """df with the first non-null value after each row: the last one before it when the rows are read backwards, in time linear in the rows."""
    back = [F.struct(F.col(o).isNull(), F.negative(F.col(o)) if dict(df.dtypes)[o] in ("int", "bigint", "double") else F.col(o)) for o in order]
    if any(dict(df.dtypes)[o] not in ("int", "bigint", "double") for o in order):
        w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    return running(df, keys, back, value, name, "last", own=False, part=None if part is None else -part)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, tie: str, columns: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """left with the columns of the last right row at or before each row, within tolerance: one shuffle, no pairs.

    Both sides are laid on one line per key; right rows come first at equal places,
    and among them the greatest tie counts.
    """
    r = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"), F.struct(F.col(at).alias("_at"), *columns).alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = r.unionByName(l).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    near = F.lit(True) if tolerance is None else F.coalesce(F.col("_at") - F.col("_m._at") <= tolerance, F.lit(False))
    return joined.select("_l.*", *[F.when(near, F.col(f"_m.{c}")).alias(c) for c in columns])


def overlap_best(points: DataFrame, spans: DataFrame, keys: Sequence[str], start: str, end: str, s_start: str, s_end: str, bin_width: int) -> DataFrame:
    """points with best: the span that overlaps each interval most, the earliest on ties; null if none.

    A range join by bins of bin_width: both sides are placed into the bins they
    touch, so only intervals of one bin meet.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width).cast("long"), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / bin_width).cast("long")))
    p = points.withColumn("_row", F.struct(*points.columns))
    a = p.select(*keys, "_row", F.col(start).alias("_a"), F.col(end).alias("_b"), bins(start, end).alias("_bin"))
    b = spans.select(*keys, F.col(s_start).alias("_c"), F.col(s_end).alias("_d"), F.struct(*spans.columns).alias("_s"), bins(s_start, s_end).alias("_bin"))
    shared = F.least("_b", "_d") - F.greatest("_a", "_c")
    met = a.join(b, [*keys, "_bin"]).withColumn("_shared", shared).where("_shared > 0")
    best = met.groupBy("_row").agg(F.max_by("_s", F.struct("_shared", -F.col("_c"), -F.col("_d"))).alias("best"), F.max("_shared").alias("shared"))
    return points.withColumn("_row", F.struct(*points.columns)).join(best, "_row", "left").drop("_row")
