"""Queries on the relational tables and the event stream, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import closure, islands, merge, resolve
from tessella.session import table
from tessella.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _revenue() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


_REV = "l_extendedprice * (1 - l_discount)"


@query(
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_REV}), 2) AS sum_disc, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_revenue()), 2).alias("sum_disc"), F.round(F.sum(_revenue() * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(
    f"""SELECT n_name, round(sum({_REV}), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"""
)
def local_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of suppliers from customers of their own nation."""
    c, o, l, s, n = (table(spark, d, x) for x in ("customer", "orders", "lineitem", "supplier", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (l.l_suppkey == s.s_suppkey) & (s.s_nationkey == c.c_nationkey)).join(n, n.n_nationkey == s.s_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query(f"SELECT round(sum(l_extendedprice * l_discount), 2) AS saved, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
def forecast_change(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount between 0.03 and 0.07 and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("saved"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL ORDER BY spent DESC, c_custkey LIMIT 50")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The fifty customers who spent most: a top-k report. Orders are aggregated before the join."""
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("orders"))
    return spent.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").orderBy(F.desc("spent"), "c_custkey").limit(50)


@query("SELECT r_name, n_name, c_mktsegment, round(sum(c_acctbal), 2) AS balance, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def rollup_balances(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).rollup("r_name", "n_name", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("*").alias("n"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


@query("SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)")
def cube_segments(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_linenumber"], []], "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS open_qty, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS full_qty FROM lineitem GROUP BY 1")
def pivoted_quantities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.sum("l_quantity"), 2))
    return p.select("l_returnflag", F.col("O").alias("open_qty"), F.col("F").alias("full_qty"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) WHERE ts < w + INTERVAL '1 hour' GROUP BY ALL"""
)
def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value").select("window_start", "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "ts", "2 hours", ["user_id"], "value").select("user_id", "session_start", "session_end", "n")


@query(
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS new FROM events)
    SELECT user_id, island, count(*) AS n, min(event_id) AS lo FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g) GROUP BY 1, 2"""
)
def event_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with less than a day between."""
    e = islands.gap_islands(table(spark, d, "events"), ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 86_400_000_000, ["event_id"])
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"))


@query(
    """WITH v AS (SELECT user_id, epoch_us(ts) AS at, event_id, value FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, epoch_us(ts) AS at, event_id FROM events WHERE event_type <> 'purchase'),
    j AS (SELECT e.event_id, v.event_id AS purchase_id, row_number() OVER (PARTITION BY e.event_id ORDER BY v.at DESC, CAST(v.event_id AS VARCHAR) DESC) AS rn FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.at <= e.at AND e.at - v.at <= 86400000000)
    SELECT event_id, purchase_id FROM j WHERE rn = 1"""
)
def asof_purchases(spark: SparkSession, d: str) -> DataFrame:
    """For every other event the user's last purchase within a day before it."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    left = e.where("event_type <> 'purchase'").select("user_id", "at", "event_id")
    right = e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase_id"))
    return islands.asof(left, right, ["user_id"], "at", "purchase_id", ["purchase_id"], 86_400_000_000).select("event_id", "purchase_id")


@query("SELECT event_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_large FROM events")
def carried_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("large", F.when(F.col("value") > 50, F.col("event_type")))
    return islands.carried_forward(e, ["user_id"], ["ts", "event_id"], "large", "last_large").select("event_id", "last_large")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """WITH s AS (SELECT o_custkey, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 90 AS b FROM orders), m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT o_custkey, CAST(sum(n) AS BIGINT) AS covered FROM (SELECT o_custkey, g, max(b) - min(a) AS n FROM i GROUP BY 1, 2) GROUP BY 1"""
)
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    """Days within ninety of an order, per customer."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("long")
    return islands.union_length(table(spark, d, "orders").select("o_custkey", day.alias("a"), (day + 90).alias("b")), ["o_custkey"], "a", "b")


@query("SELECT o_custkey, o_orderkey, o_totalprice, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def running_orders(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_parts(spark: SparkSession, d: str) -> DataFrame:
    """The three dearest parts of each brand."""
    return merge.numbered(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")]).where("n <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_type, max_by(x, length(x)) AS prefix FROM part LEFT JOIN (SELECT DISTINCT unnest([split_part(p_type, ' ', 1), split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2)]) AS x FROM part) ON starts_with(p_type, x) GROUP BY 1, 2")
def longest_prefixes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    words = F.split("p_type", " ")
    prefixes = p.select(F.explode(F.array(words[0], F.concat_ws(" ", words[0], F.coalesce(F.get(words, 1), F.lit("")))))).toDF("prefix").distinct()
    return resolve.longest_prefix(p, "p_type", prefixes, "prefix").select("p_partkey", "p_type", "prefix")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def idle_customers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def urgent_customers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O')")
def returned_and_open(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.where("l_returnflag = 'R'").select("l_partkey").intersect(l.where("l_linestatus = 'O'").select("l_partkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def never_bulk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


@query("SELECT r_name, c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
def region_segments(spark: SparkSession, d: str) -> DataFrame:
    """All patterns of two short lists: the region names and the segments."""
    names = table(spark, d, "region").select("r_name")
    few = F.broadcast(names) if names.limit(1001).count() <= 1000 else names  # a list of patterns; a longer one is not sent to every executor
    return table(spark, d, "customer").select("c_mktsegment").distinct().crossJoin(few).select("r_name", "c_mktsegment")


@query(
    """WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS a, 'N' || n_nationkey AS b FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'R' || (s_nationkey % 2) FROM supplier WHERE s_suppkey = 1),
    r(node) AS (SELECT 'R1' UNION SELECT b FROM r JOIN e ON a = node) SELECT node FROM r"""
)
def reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    link = lambda t, x, a, y, b: t.select(F.concat(F.lit(x), F.col(a).cast("string")).alias("a"), F.concat(F.lit(y), b.cast("string")).alias("b"))
    edges = link(n, "R", "n_regionkey", "N", F.col("n_nationkey")).unionByName(link(s, "N", "s_nationkey", "S", F.col("s_suppkey"))).unionByName(link(s.where("s_suppkey = 1"), "S", "s_suppkey", "R", F.col("s_nationkey") % 2))
    return closure.reachable(edges, "a", "b", spark.createDataFrame([("R1",)], "node string"), "node").select("node")


@query("SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def partners_by_nation(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def first_and_last_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = merge.first_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = merge.last_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@query("SELECT event_type, count_if(value > 50) AS large, count(DISTINCT user_id) AS users, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1")
def event_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query("SELECT label, count(*) AS n, round(avg(list_dot_product(embedding, embedding)), 4) AS mean_square FROM embeddings GROUP BY 1")
def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(square), 4).alias("mean_square"))
