"""Readers. Each adds _src and _ord where later steps decide by the order of arrival."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Encodings tried in turn when a text is not UTF-8.
LEGACY = ("gb18030", "gbk", "gb2312", "cp936")


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A headed CSV with quoted line breaks; a byte-order mark on the first name goes, missing values become ''."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def ndjson(spark: SparkSession, path: str, schema: StructType | str, wanted: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """One JSON object per line; with wanted, only rows whose key is in it (a semi-join right behind the scan)."""
    df = spark.read.schema(schema).json(path).withColumn("_src", F.input_file_name())
    return df if wanted is None or key is None else df.join(wanted.select(key), key, "left_semi")


def texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of files, decoded by decode()."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return raw.select("path", decode(F.col("content")).alias("text"))


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 with or without mark, else the first legacy encoding that fits, else UTF-8 with replacements."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decode_bytes(bytes(b)))

    return run(content)


def decode_bytes(b: bytes) -> str:
    for enc in ("utf-8-sig", *LEGACY):
        try:
            return b.decode(enc)
        except UnicodeDecodeError:
            continue
    return b.decode("utf-8", "replace")


_ESCAPES = {"0": "\0", "'": "'", '"': '"', "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "\\": "\\"}


def insert_tuples(sql: str, table: str) -> Iterator[list[object]]:
    """Rows of the first INSERT for a table in a dump: a scanner over quotes and brackets, with NULL, numbers and escapes read."""
    m = re.search(rf"INSERT\s+INTO\s+`?{re.escape(table)}`?\s*(?:\([^)]*\)\s*)?VALUES\s*", sql, re.I)
    if not m:
        return
    i, row, field, quoted, depth = m.end(), [], [], False, 0
    while i < len(sql):
        ch = sql[i]
        if quoted:
            if ch == "\\" and i + 1 < len(sql):
                field.append(_ESCAPES.get(sql[i + 1], sql[i + 1]))
                i += 2
                continue
            if ch == "'":
                if sql[i + 1 : i + 2] == "'":
                    field.append("'")
                    i += 2
                    continue
                quoted = False
            else:
                field.append(ch)
        elif ch == "'":
            quoted = True
            field.append("\0q")
        elif ch == "(" and depth == 0:
            depth, row, field = 1, [], []
        elif ch in ",)" and depth == 1:
            row.append(_typed("".join(field)))
            field = []
            if ch == ")":
                depth = 0
                yield row
        elif ch == ";" and depth == 0:
            return
        elif depth:
            field.append(ch)
        i += 1


def _typed(raw: str) -> object:
    if "\0q" in raw:
        return raw[raw.index("\0q") + 2 :]
    raw = raw.strip()
    if not raw or raw.upper() == "NULL":
        return None
    if re.fullmatch(r"-?\d+", raw):
        return int(raw)
    return float(raw) if re.fullmatch(r"-?\d*\.\d+(?:[eE][-+]?\d+)?", raw) else raw


def sql_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """A table of a dump as strings by position; files are read whole, each by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sql in b["value"]:
                rows = [[None if v is None else str(v) for v in r[: len(columns)]] + [None] * max(0, len(columns) - len(r)) for r in insert_tuples(sql, table)]
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.text(path, wholetext=True).mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on a SQLite file, read by one task where the file is; no rows if the file is missing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import sqlite3

        for _ in batches:
            if os.path.exists(path):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    yield from pd.read_sql_query(query, db, chunksize=10_000)

    return spark.range(1).mapInPandas(read, schema)


def with_file_order(df: DataFrame, order: str) -> DataFrame:
    """df with _ord: the rows numbered within each file by a column that keeps their order."""
    return df.withColumn("_src", F.input_file_name()).withColumn("_ord", F.row_number().over(Window.partitionBy("_src").orderBy(order)))
