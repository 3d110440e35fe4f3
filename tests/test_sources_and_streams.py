import datetime
import sqlite3

from pyspark.sql import functions as F

from tessella.sources import readers, writers
from tessella.streaming import windows


def test_csv_and_ndjson(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,t\n1,"x\ny"\n2,\n', encoding="utf-8")
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "a.csv")).collect())) == [("1", "x\ny"), ("2", "")]
    (tmp_path / "b.json").write_text('{"id":"Q1","v":1}\n{"id":"Q2","v":2}\n')
    want = spark.createDataFrame([("Q2",)], "id string")
    assert [r.v for r in readers.ndjson(spark, str(tmp_path / "b.json"), "id string, v int", want, "id").collect()] == [2]
    out = spark.createDataFrame([(1, "a,b", 3)], "x int, y string, z int")
    writers.csv(out, str(tmp_path / "o"), ["y", "x"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect()] == [("a,b", "1")]
    writers.ndjson(out, str(tmp_path / "p"), "here")
    assert spark.read.json(str(tmp_path / "p")).first().source == "here"


def test_legacy_text(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("卷一甲乙".encode("gb18030"))
    (tmp_path / "y.txt").write_bytes("﻿丙丁".encode())
    assert sorted(r.text for r in readers.texts(spark, str(tmp_path)).collect()) == ["丙丁", "卷一甲乙"]


def test_dump_and_sqlite(spark, tmp_path):
    sql = "INSERT INTO `other` VALUES (9);\nINSERT INTO `t` VALUES (1,'it''s, (ok)',NULL),(2,'a\\'b\\n',-3.5);\nINSERT INTO `t` VALUES (7,'later',1);"
    assert list(readers.insert_tuples(sql, "t")) == [[1, "it's, (ok)", None], [2, "a'b\n", -3.5]]
    (tmp_path / "d.sql").write_text(sql)
    assert [tuple(r) for r in readers.sql_dump(spark, str(tmp_path / "d.sql"), "t", ["a", "b", "c"]).collect()] == [("1", "it's, (ok)", None), ("2", "a'b\n", "-3.5")]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table p(i integer, n text)")
        db.execute("insert into p values (1, 'x')")
    assert [tuple(r) for r in readers.sqlite(spark, str(tmp_path / "d.db"), "select i, n from p", "i long, n string").collect()] == [(1, "x")]
    assert readers.sqlite(spark, str(tmp_path / "none.db"), "select 1 as i", "i long").count() == 0


def test_statements_and_upsert(spark):
    df = spark.createDataFrame([(1, "a'b", None)], "i int, t string, n int")
    assert writers.insert_statements(df, "t").first().statement == "INSERT INTO t (i, t, n) VALUES (1, 'a''b', NULL);"
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, writers.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    slim, side = writers.vertical_split(old, "k", "v")
    assert slim.columns == ["k"] and side.count() == 2


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("u", at + datetime.timedelta(minutes=m), float(m)) for m in (0, 10, 65, 300)], "user_id string, ts timestamp, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "1 hour", ["user_id"], "value", "10 minutes").writeStream.outputMode("append").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.tumbling(events, "ts", "1 hour", ["user_id"], "value")
    closed = sorted((r.window_start, r.n) for r in spark.table("tumbled").collect())
    assert closed and set(closed) <= {(r.window_start, r.n) for r in batch.collect()}
    q = windows.running_totals(stream, "user_id", "value").writeStream.outputMode("update").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.user_id, r.n, r.total) for r in spark.table("totals").collect()] == [("u", 4, 375.0)]
    assert windows.sessions(events, "ts", "2 hours", ["user_id"], "value").count() == 2
    assert windows.resumed(events.limit(1), events, ["ts"]).where(F.lit(True)).count() == 3
