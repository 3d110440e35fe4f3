"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.merge import last_wins


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A headed CSV of the given columns; others are left out."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def ndjson(df: DataFrame, path: str, source: str | None = None) -> None:
    """One object per line, with a constant source column if given."""
    (df if source is None else df.withColumn("source", F.lit(source))).write.mode("overwrite").json(path)


def sql_text(c: Column, kind: str) -> Column:
    """A value as SQL: numbers plain, texts quoted and escaped, null as NULL."""
    plain = c.cast("string") if kind in ("int", "bigint", "double", "smallint", "float") else F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(plain, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """(statement) of an INSERT per row."""
    values = [sql_text(F.col(c), t) for c, t in df.dtypes]
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *values), F.lit(");")).alias("statement"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in the place of those with the same key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, ["_new"]).drop("_new")


def vertical_split(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(df without the column, (key, column) where it has a value)."""
    return df.drop(column), df.select(key, column).where(F.col(column).isNotNull())
