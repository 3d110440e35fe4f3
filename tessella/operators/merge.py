"""Merging tables under explicit precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import blank_to_null
from tessella.session import stage


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in a total order. An aggregation with partial results, not a window, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the last in a total order."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def delivered_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows delivered again counted once. Deliveries of a key agree in content, so any one stands, and columns that nothing reads are neither scanned nor shuffled; where arrival decides, use first_wins."""
    return df.dropDuplicates(list(keys))


def first_given_per_column(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key; every column has the first value in the order that is neither null nor blank."""
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in keys and c not in order]
    given = {c: blank_to_null(F.col(c)) if kinds[c] == "string" else F.col(c) for c in rest}
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(given[c], F.when(given[c].isNotNull(), place)).alias(c) for c in rest])


def priority_union(sources: Sequence[DataFrame], keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One row per key from the first source that has it; ties within a source by the given columns."""
    tagged = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return first_wins(every, keys, ["_prio", *within]).drop("_prio")


def fill_only(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left, with the columns' blanks filled from right; a value that is there stays."""
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    kinds = dict(left.dtypes)
    filled = [F.coalesce(blank_to_null(F.col(c)) if kinds[c] == "string" else F.col(c), F.col(f"_r_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns]
    return left.join(r, list(keys), "left").select(*filled)


def outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer merge; where both have a value the left one stands."""
    a = left.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in columns])
    b = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    return a.join(b, list(keys), "full_outer").select(*keys, *[F.coalesce(f"_l_{c}", f"_r_{c}").alias(c) for c in columns])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 within each key, in a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def dense_numbers(df: DataFrame, order: Column, name: str = "n") -> DataFrame:
    """df with numbers from 1 on over all rows in a total order, in parallel: rows are sorted across tasks, each task counts its own and begins where those before it end."""
    placed = stage(df.orderBy(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbers")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row per task
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_at", "_before")
