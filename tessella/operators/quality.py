"""Coverage and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.islands import union_length


def coverage(spans: DataFrame, totals: DataFrame, keys: Sequence[str], start: str, end: str, total: str, width: int | None = None) -> DataFrame:
    """(keys, total, covered, ratio): how much of each total the union of its spans covers; nothing covered gives 0."""
    got = totals.join(union_length(spans, keys, start, end, width), list(keys), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return got.select(*keys, total, "covered", F.when(F.col(total) > 0, F.col("covered") / F.col(total)).otherwise(0.0).alias("ratio"))


def warnings(ratio: Column, marks_per_100: Column, size: Column, low: float = 0.30, least_marks: float = 0.75, least_size: int = 40) -> Column:
    """Array of what is wrong with a transfer: none, low, low_punctuation."""
    return F.filter(F.array(F.when(ratio == 0, "none"), F.when((ratio > 0) & (ratio < low), "low"), F.when((size >= least_size) & (marks_per_100 < least_marks), "low_punctuation")), lambda x: x.isNotNull())


def validated(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "errors") -> DataFrame:
    """df with all errors of each row, in the order of the rules; a rule gives the condition that must hold, and null counts as broken."""
    return df.withColumn(name, F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules]), lambda x: x.isNotNull()))
