"""Resolving references in stages, with gates against ambiguity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import stage


def unique_only(candidates: DataFrame, subject: Sequence[str], target: str, prefer: Sequence[Column] = ()) -> DataFrame:
    """(subject, target) where exactly one target is left. Each preference narrows a subject's candidates if it leaves any."""
    got = candidates
    for n, p in enumerate(prefer):
        flag = f"_p{n}"
        got = got.withColumn(flag, F.coalesce(p, F.lit(False)))
        kept = got.groupBy(*subject).agg(F.max(flag).alias("_any"))
        got = got.join(kept, list(subject)).where(f"not _any or {flag}").drop("_any", flag)
    return got.groupBy(*subject).agg(F.min(target).alias(target), F.max(target).alias("_hi")).where(F.col(target) == F.col("_hi")).drop("_hi")


def cascade(subjects: DataFrame, key: str, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(key, target, stage): each stage gets the subjects that none before resolved and returns (key, target)."""
    left, found = subjects, None
    for name, run in stages:
        got = stage(run(left).select(key, "target").withColumn("stage", F.lit(name)), "cascade")
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select(key), key, "left_anti")
    return found  # type: ignore[return-value]


def suffix_pairs(names: DataFrame, whole: str, part: str, least: int = 2, most: int = 3) -> DataFrame:
    """names with suffix: the proper ends of the whole names, so that an equi-join finds "ends with"."""
    n = F.length(whole)
    return names.withColumn(part, F.explode(F.filter(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(n > k, F.right(F.col(whole), k))), lambda x: x.isNotNull())))


def longest_prefix(df: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """df with prefix: the longest of prefixes that text begins with, else null; an equi-join on the beginnings of the text of those lengths that occur among prefixes."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).where(F.length(prefix) > 0).distinct().collect())  # one row per length
    at = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    starts = df.select(F.col(text).alias("_t")).distinct().select("_t", F.explode(F.transform(F.filter(at, lambda k: k <= F.length("_t")), lambda k: F.left(F.col("_t"), k))).alias(prefix))
    best = starts.join(prefixes.select(prefix).distinct(), prefix).groupBy("_t").agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return df.join(best, F.col(text) == F.col("_t"), "left").drop("_t")


def ranked_search(df: DataFrame, query: str, columns: Sequence[str], rank: Sequence[Column], order: Sequence[str], limit: int) -> DataFrame:
    """Rows that hold the query in any column, best rank first; an empty query matches all."""
    found = df
    if query:
        held = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(query.lower())) for c in columns]
        any_of = held[0]
        for h in held[1:]:
            any_of = any_of | h
        found = df.where(any_of)
    place = F.lit(len(rank))
    for i in range(len(rank) - 1, -1, -1):
        place = F.when(rank[i], F.lit(i)).otherwise(place)
    return found.withColumn("rank", place).orderBy("rank", *order).limit(limit)


def fuzzy_labels(subjects: DataFrame, labels: DataFrame, threshold: float = 0.78, shortlist: int = 32, results: int = 5, shortest: float = 0.35, longest: float = 2.85) -> DataFrame:
    """(subject, target, score, rank) of the targets whose label is most like each subject's key.

    subjects: (subject, key); labels: (target, label). Candidates share a bigram and are of a fitting length; of a target
    the label of greatest Jaccard similarity counts; the shortlist of them by that similarity is compared by the standard
    matcher, and the results are the best at or above the threshold, ties by target. A key without a bigram, or one that
    shares none, has no candidate and gives no row.
    """
    from tessella.functions.text import grams
    from tessella.operators.align import sequence_ratio

    a = subjects.where("length(key) >= 2").select("subject", "key", F.size(grams(F.col("key"), 2)).alias("na"), F.explode(grams(F.col("key"), 2)).alias("g"))
    named = labels.where("length(label) >= 2").select("target", "label").distinct()
    b = named.select("target", "label", F.size(grams(F.col("label"), 2)).alias("nb"), F.explode(grams(F.col("label"), 2)).alias("g"))
    share = F.length("label") / F.length("key")
    met = a.join(b, "g").where(share.between(shortest, longest)).groupBy("subject", "key", "target", "label", "na", "nb").agg(F.count("*").alias("n"))
    alike = met.withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = alike.groupBy("subject", "key", "target").agg(F.max_by("label", F.struct("jaccard", "label")).alias("label"), F.max("jaccard").alias("jaccard"))
    short = best.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("jaccard"), "target"))).where(F.col("place") <= shortlist)
    scored = short.select("subject", "target", sequence_ratio(F.col("key"), F.col("label")).alias("score")).where(F.col("score") >= threshold)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), "target"))).where(F.col("rank") <= results)


def matched_labels(subjects: DataFrame, labels: DataFrame, **fuzzy: float) -> DataFrame:
    """(subject, target, score, method, best): exact matches, and the fuzzy ones that are none; best marks a subject's first, exact before fuzzy, then by score and target."""
    exact = subjects.where("length(key) > 0").join(labels.select("target", F.col("label").alias("key")), "key").select("subject", "target").distinct().select("subject", "target", F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    near = fuzzy_labels(subjects, labels, **fuzzy).join(exact.select("subject", "target"), ["subject", "target"], "left_anti").select("subject", "target", "score", F.lit("fuzzy").alias("method"))  # type: ignore[arg-type]
    first = Window.partitionBy("subject").orderBy("method", F.desc("score"), "target")
    return exact.unionByName(near).withColumn("best", F.row_number().over(first) == 1)


def used_once(rows: DataFrame, offers: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(key, target): within a group each offer goes to one row, rows served in their order.

    rows: (group, key, order, role); offers: (group, target, role, place). A row takes the first offer left of its own role, else the first
    left of any. A group is one work or page; its rows are brought together.
    """
    import pandas as pd

    kind = dict(rows.dtypes)[key], dict(offers.dtypes)["target"]

    def serve(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        left = theirs.sort_values(["place", "target"]).to_dict("records")
        out = []
        for r in mine.sort_values([order, key]).to_dict("records"):
            pick = next((o for o in left if o["role"] == r["role"]), left[0] if left else None)
            if pick is not None:
                left.remove(pick)
                out.append((r[key], pick["target"]))
        return pd.DataFrame(out, columns=[key, "target"])

    mine = rows.select(F.col(group).alias("_g"), key, order, "role").groupBy("_g")
    theirs = offers.select(F.col(group).alias("_h"), "target", F.col("role").alias("role"), F.col("place").alias("place")).groupBy("_h")
    return mine.cogroup(theirs).applyInPandas(serve, f"{key} {kind[0]}, target {kind[1]}")
