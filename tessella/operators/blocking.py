"""Candidates by shared k-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import grams


def shared_grams(left: DataFrame, right: DataFrame, lid: str, ltext: str, rid: str, rtext: str, k: int = 2, least: int = 1) -> DataFrame:
    """(lid, rid, shared) of rows that share distinct k-grams; an inverted-index join with partial counts.

    The planner takes a side for as small as the texts it explodes; the hint keeps the grams from being sent through the driver.
    """
    a = left.select(F.col(lid), F.explode(grams(F.col(ltext), k, whole=True)).alias("g"))
    b = right.select(F.col(rid), F.explode(grams(F.col(rtext), k, whole=True)).alias("g"))
    return a.join(b.hint("merge"), "g").groupBy(lid, rid).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def top_shared(left: DataFrame, right: DataFrame, lid: str, ltext: str, rid: str, rtext: str, k: int = 2, top: int = 25, ratio: float | None = None) -> DataFrame:
    """The top rows of right per row of left by shared grams, ties by rid; ratio bounds the shorter length against the longer."""
    found = shared_grams(left, right, lid, ltext, rid, rtext, k)
    if ratio is not None:
        la = left.select(lid, F.length(ltext).alias("_la"))
        lb = right.select(rid, F.length(rtext).alias("_lb"))
        found = found.join(la, lid).join(lb, rid).where(F.least("_la", "_lb") >= ratio * F.greatest("_la", "_lb")).drop("_la", "_lb")
    w = Window.partitionBy(lid).orderBy(F.desc("shared"), rid)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def diagonal_window(needles: DataFrame, hay: DataFrame, nid: str, ntext: str, hid: str, htext: str, k: int = 5, bin_width: int = 128, most_places: int = 8, votes: int = 3) -> DataFrame:
    """(nid, hid, bin, votes): where in each hay text a needle most likely lies.

    Positions of common k-grams vote for diagonals in bins; three neighbouring
    bins are summed, the fullest wins, the lowest on ties. A gram with more than
    most_places places in a hay text votes for none there.
    """
    pos = lambda df, i, t, name: df.select(F.col(i), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda p: F.substring(F.col(t), p, F.lit(k)))).alias(name, "g"))
    a = pos(needles.where(F.length(ntext) >= k), nid, ntext, "_i")
    b = pos(hay.where(F.length(htext) >= k), hid, htext, "_p")
    rare = b.groupBy(hid, "g").agg(F.count("*").alias("_n"), F.collect_list("_p").alias("_ps")).where(F.col("_n") <= most_places)
    hits = a.join(rare, "g").select(nid, hid, F.explode(F.transform("_ps", lambda p: F.floor((p - F.col("_i")) / bin_width))).alias("bin"))
    count = hits.groupBy(nid, hid, "bin").agg(F.count("*").alias("_c"))
    spread = count.select(nid, hid, "_c", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).groupBy(nid, hid, "bin").agg(F.sum("_c").alias("votes"))
    return spread.groupBy(nid, hid).agg(F.max_by("bin", F.struct("votes", -F.col("bin"))).alias("bin"), F.max("votes").alias("votes")).where(F.col("votes") >= votes)
