"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.packed_values import split_values
from tessella.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author in the authors fields of corpus_entry and catalog_hit, with its position."""
    both = table(spark, sf_dir, "corpus_entry").select(F.col("id").alias("entry_key"), "authors").unionByName(table(spark, sf_dir, "catalog_hit").select(F.col("work_id").alias("entry_key"), "authors"))
    once = both.where(F.length("authors") > 0).distinct()
    return split_values(once, "entry_key", "authors").select(F.col("key").alias("entry_key"), "pos", F.col("value").alias("author"))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
