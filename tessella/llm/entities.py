"""Matching works to catalogue items that share no key.

Candidates come from MinHash buckets over title shingles and over author and time; each pair gets features
from title, dynasty, years and authors; a logistic classifier is trained on weak
labels (votes of rules on pairs rich in evidence, with attributes hidden at
random, so that it learns to do without them) and calibrated on held-out pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.names import ERA_YEARS, Forms, era, han_tables, relation, years
from tessella.session import stage

# Words that name a kind of book, longest first in matching, and what title pages and catalogues add.
GENRES = "集解 文集 詩集 全集 別集 詩話 詞話 語錄 雜錄 筆記 叢談 本草 圖說 補遺 要義 正義 義疏 集 志 考 疏 記 注 經 傳 論 錄 譜 說 解 鈔 抄 序 箋 銘 賦".split()
PREFIXES = "欽定 御定 御製 御纂 重刊 新刊 重校 校刊 增訂 重訂 增補 新編 增廣 影印 足本".split()
SUFFIXES = "附錄 殘 四庫本 不分卷 書 影印本 刊本 抄本 上 下".split()
#: English names of kinds of book in item descriptions.
ENGLISH_GENRES = {
    "collected explanations": "集解", "anthology": "文集", "poems": "詩集", "remarks on poetry": "詩話", "recorded sayings": "語錄", "jottings": "雜錄", "notebook": "筆記", "miscellany": "叢談", "herbal": "本草", "illustrated handbook": "圖說", "supplement": "補遺",
    "essentials": "要義", "collected writings": "集", "gazetteer": "志", "study": "考", "subcommentary": "疏", "record": "記", "commentary": "注", "scripture": "經", "biographies": "傳",
}

HASHES = 24  # of one-row bands: a pair sharing a fifth of its shingles is found with probability 0.995
TRAINING_PAIRS = 20_000  # the bound of the labelled sample that reaches the driver
NEAR = 3  # years by which sources differ
AUTHOR_BANDS, AUTHOR_ROWS = 12, 2  # over the tokens of author and time
RELATED = "續续後后補补外別别前新增廣广"  # an added character that makes another book of a title
FEATURES = ("exact", "gap", "replaced", "odd", "genre", "edits", "dropped", "era_same", "era_other", "year_in", "year_out", "life_in", "life_out", "author_same", "author_like", "author_family", "author_other", "authors_era", "rival")
GROUPS = {"era": (7, 8), "year": (9, 10, 11, 12), "author": (13, 14, 15, 16), "authors_era": (17,)}


class Titles:
    """Titles without the ways of writing them."""

    def __init__(self, simple: dict[str, str]) -> None:
        self.simple = str.maketrans(simple)
        fold = lambda xs: sorted((x.translate(self.simple) for x in xs), key=len, reverse=True)
        self.genres, prefixes, suffixes = fold(GENRES), fold(PREFIXES), fold(SUFFIXES)
        self.prefix = re.compile("^(?:" + "|".join(prefixes) + ")(?=.{2})")
        self.suffix = re.compile(r"\s*[(\[〔【（［](?:" + "|".join(suffixes) + r"|[^()\[\]]*(?:book|work|text)|[^()\[\]]*卷[^()\[\]]*)[)\]〕】）］]\s*$|\s*(?:[一二三四五六七八九十百千零〇两\d]+卷|卷[一二三四五六七八九十百千零〇\d]+)\s*$", re.I)

    def __call__(self, raw: str | None) -> str:
        t = unicodedata.normalize("NFKC", raw or "").translate(self.simple).strip()
        before = None
        while before != t:
            before, t = t, self.suffix.sub("", t)
        t = re.sub(r"[^\w□]|[A-Za-z_]", "", t)
        return self.prefix.sub("", t)

    def split(self, t: str) -> tuple[str, str]:
        """Name and kind of book."""
        for g in self.genres:
            if t.endswith(g) and len(t) > len(g):
                return t[: -len(g)], g
        return t, ""

    def described(self, text: str | None) -> tuple[str | None, str | None, str | None, int | None]:
        """(author, kind of book, dynasty, year) that an item's description tells."""
        t = (text or "").strip()
        if m := re.match(r"^(?:(-?\d{1,4})年前後)?(.+?)(?:所撰|編著的|编著的|撰|著)([^所撰編著的]{1,3})$", t):
            kind = m[3].translate(self.simple)
            return m[2], kind if kind in self.genres else None, None, int(m[1]) if m[1] else None
        if m := re.match(r"^(\w+)-era (.+)$", t):
            return None, self._english(m[2]), era(m[1]), None
        if m := re.match(r"^(.+?) by (.+)$", t):
            return m[2], self._english(m[1]), None, None
        return None, None, None, None

    def _english(self, t: str) -> str | None:
        g = ENGLISH_GENRES.get(t.casefold())
        return g.translate(self.simple) if g else None

    def labels(self, title: str | None, aliases: object, description: str | None) -> list[str]:
        """Distinct titles of an item; one cut short goes where a longer one continues it, or gets the kind that the description tells."""
        given = [self(title), *(self(a) for a in (aliases if aliases is not None else ()))]  # type: ignore[attr-defined]
        given = list(dict.fromkeys(t for t in given if len(t) >= 2))
        kind = self.described(description)[1]
        out = []
        for t in given:
            if any(o != t and o.startswith(t) and len(o) - len(t) <= 2 for o in given):
                continue
            name, g = self.split(t)
            if kind and g != kind:
                if kind.startswith(g) and len(given) == 1:
                    t = name + kind
                elif g:
                    continue
            out.append(t)
        return out

    def shingles(self, t: str) -> list[str]:
        """Ordered pairs of characters of the name, and each with the kind of book."""
        name, g = self.split(t)
        chars = [c for c in name if c != "□"]
        pairs = {"".join(p) for p in combinations(chars[:24], 2)} if len(chars) <= 24 else {name[i : i + 2] for i in range(len(name) - 1)}
        out = sorted(pairs | {c + "|" + g for c in chars})
        return out or [t]


def minhashes(shingles: list[str], n: int = HASHES) -> list[int]:
    """n MinHash values of a set, each marked with its function's number."""
    base = np.array([xxhash.xxh64_intdigest(s) for s in shingles], dtype=np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for i in range(n):
            x = (base ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            out.append(int((x * np.uint64(0x94D049BB133111EB)).min().astype(np.int64)))
    return out


def _edits(a: str, b: str) -> list[tuple[int, int, str]]:
    """(place in a, place in b, kind) of the differences of a cheapest alignment; kind: replaced, added or dropped."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), dtype=int)
    cost[:, 0], cost[0] = range(n + 1), range(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append((i, j, "replaced"))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((i, j, "dropped"))
        else:
            j -= 1
            out.append((i, j, "added"))
    return out


def title_relation(a: str, b: str, split: Titles, odd: frozenset[str] | set[str]) -> list[float] | None:
    """(exact, gap, replaced, odd, genre, edits, dropped) of two titles, or None where nothing speaks for their being variants of one.

    At most a third of the longer title may differ; the kind of book and whether a character that makes another book of it
    was added are features, for the classifier to weigh.
    """
    if a == b:
        return [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    found = _edits(a, b)
    if 3 * len(found) > max(len(a), len(b)):
        return None
    (na, ga), (nb, gb) = split.split(a), split.split(b)
    gaps = [k == "replaced" and "□" in (a[i], b[j]) for i, j, k in found]
    changed = {a[i] for i, _, k in found if k != "added"} | {b[j] for _, j, k in found if k != "dropped"}
    moved = [k != "replaced" for _, _, k in found]
    kind = all(gaps) or (ga == gb and not any(x and (a[i] if k == "dropped" else b[j]) in RELATED for x, (i, j, k) in zip(moved, found, strict=True)) and all(i < len(na) or k == "added" for i, _, k in found))
    return [0.0, float(len(found) == 1 and all(gaps)), float(not all(gaps)), float(bool(changed & set(odd))), float(kind), len(found) - 1.0, float(any(moved))]


def _span(born: int | None, died: int | None) -> tuple[int, int] | None:
    return (born, died) if born is not None and died is not None else None


class Evidence:
    """Features of a pair beyond its titles."""

    def __init__(self, simple: dict[str, str], sounds: dict[str, str]) -> None:
        self.forms, self.titles = Forms(simple, sounds), Titles(simple)

    def __call__(self, work: dict, item: dict) -> list[float]:
        author, _, told_era, told_year = self.titles.described(item["description"])
        ie = era(item["dynasty_label"]) or told_era
        start = next((int(y) for y in (item["start_year"], item["end_year"], told_year) if y is not None and y == y), None)
        dated = _span(*years(None, work["date_not_before"], work["date_not_after"]))
        we = era(work["time_dynasty"])
        if we is None and dated:
            near = [e for e, (a, b) in ERA_YEARS.items() if a <= dated[1] and dated[0] <= b]
            we = near[0] if len(near) == 1 else None
        lives = [s for s in [_span(*years(work["author_dates"], None, None)), *(_span(*years(a["author_dates"], a["date_not_before"], a["date_not_after"])) for a in work["authorship"])] if s]
        out = [float(bool(ie and we and ie == we)), float(bool(ie and we and ie != we)), 0.0, 0.0, 0.0, 0.0]
        if start is not None and dated:
            gap = max(dated[0] - start, start - dated[1], 0)
            out[2], out[3] = float(gap <= NEAR), float(gap > 4 * NEAR)
        elif start is not None and lives:
            inside = any(a + 10 <= start <= b + 15 for a, b in lives)
            out[4], out[5] = float(inside), float(not inside)
        out += self.author(author, work)
        eras = {e for e in (era(a["time_dynasty"]) for a in work["authorship"]) if e}
        out.append(0.0 if not ie or not eras or we else (1.0 if ie in eras else -1.0))
        return out

    def author(self, author: str | None, work: dict) -> list[float]:
        names = [a["person_name"] for a in work["authorship"] if a["person_name"]]
        if not author or not names:
            return [0.0] * 4
        best, family, alike = 0, False, False
        mine = self.forms(author)[1]
        for n in names:
            for k1, f1 in self.forms(n)[1]:
                for k2, f2 in mine:
                    best = max(best, relation(k1, f1, k2, f2, {})[0])
                    alike = alike or (k1 == k2 and k1 in ("han", "latin", "org")) or {k1, k2} in ({"han", "latin"}, {"han", "org"}, {"latin", "org"})
                    family = family or (k1 == k2 == "han" and f1[:1] == f2[:1] and self.forms.surname(f1) > 0)
        return [float(best >= 2), float(best == 1), float(best == 0 and family), float(best == 0 and alike and not family)]


def weak_label(x: np.ndarray) -> int:
    """1, 0, or -1 for no label, by votes on a pair's features."""
    exact, gap, _, _, genre, _, _, era_same, era_other, year_in, year_out, life_in, life_out, same, like, family, other, _, rival = x
    if era_other or year_out or not genre or rival:
        return 0
    if life_out and other and not exact:
        return 0
    if other and not (era_same or year_in or life_in or same):
        return 0
    votes = exact + gap + era_same + year_in + life_in + same
    if votes >= 3 and not other and not life_out:
        return 1
    if not exact and not gap and other and not like and not family and (year_in or life_in or era_same):
        return 0
    return -1


class Classifier:
    """Logistic regression with a ridge and a Platt calibration."""

    def __init__(self, weights: np.ndarray, scale: tuple[float, float] = (1.0, 0.0)) -> None:
        self.weights, self.scale = weights, scale

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return w

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, seed: int = 7, hide: float = 0.35) -> Classifier:
        """Fitted on three quarters of the rows of FEATURES, each also with attributes hidden at random; the other quarter, as it is, calibrates."""
        rng = np.random.default_rng(seed)
        held = rng.permutation(len(x)) % 4 == 3
        copies, labels = [x[~held]], [y[~held]]
        for _ in range(2):
            z = x[~held].copy()
            for columns in GROUPS.values():
                gone = rng.random(len(z)) < hide
                for c in columns:
                    z[gone, c] = 0
            copies.append(z)
            labels.append(y[~held])
        wide = lambda v: np.hstack([v, np.ones((len(v), 1))])
        model = cls(cls._fit(wide(np.concatenate(copies)), np.concatenate(labels), 1.0))
        if held.sum() > 20 and len(set(y[held])) == 2:
            score = wide(x[held]) @ model.weights
            a, b = cls._fit(np.stack([score, np.ones(held.sum())], axis=1), y[held], 0.01)
            model.scale = (float(a), float(b))
        return model

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = np.hstack([x, np.ones((len(x), 1))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * s + self.scale[1], -30, 30)))


#: Where too few pairs have a weak label to train on: weights of FEATURES and the constant.
PRIOR = np.array([3.0, 1.0, -2.0, 2.0, 5.0, -2.0, -2.0, 2.0, -6.0, 3.0, -6.0, 2.0, -2.0, 3.0, 1.5, 0.5, -1.0, 1.0, -5.0, -6.5])


def _buckets(titles: DataFrame, simple: object) -> DataFrame:
    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Titles(simple.value)  # type: ignore[attr-defined]
        for s in batches:
            yield s.map(lambda x: sorted(set(minhashes(t.shingles(x)))))

    return titles.select("t", F.explode(hashed("t")).alias("bucket"))


def _met(left: DataFrame, right: DataFrame, a: str, b: str, salt_rows: int) -> DataFrame:
    """Distinct (a, b) of rows that share a bucket; a bucket of more than salt_rows rows of the left is joined in blocks of that size.

    The buckets come from exploded arrays, whose rows the planner does not count: the hint keeps it from sending them through the driver.
    """
    sizes = left.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")).hint("merge")
    x = left.join(sizes, "bucket").select("bucket", a, F.pmod(F.xxhash64(a), F.col("salts")).cast("int").alias("salt"))
    y = right.join(sizes, "bucket").select("bucket", b, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    most = F.floor(F.greatest(F.length(a), F.length(b)) / 3).cast("int")  # of what may differ, see title_relation
    fits = (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)
    return x.join(y.hint("merge"), ["bucket", "salt"]).where(fits).select(a, b).distinct()


def _title_pairs(works: DataFrame, items: DataFrame, authors: DataFrame, simple: object, salt_rows: int = 2000) -> DataFrame:
    """(t, label, v) of the titles and labels that may be one title, v the first of FEATURES.

    Candidates share a MinHash bucket of the title's shingles, or one of the tokens of author and time (authors: side, title,
    bucket), which finds titles that have little in common.
    """
    left, right = _buckets(works.select("t").distinct(), simple), _buckets(items.select(F.col("label").alias("t")).distinct(), simple).withColumnRenamed("t", "label")
    found = _met(left, right, "t", "label", salt_rows)
    people = _met(authors.where("side = 'w'").select(F.col("title").alias("t"), "bucket").distinct(), authors.where("side = 'i'").select(F.col("title").alias("label"), "bucket").distinct(), "t", "label", salt_rows)
    found = found.unionByName(people).distinct()
    # how many distinct titles use a character: one of few uses is likelier a slip than a name
    chars = works.select("t").unionByName(items.select(F.col("label").alias("t"))).distinct().select(F.explode(F.array_distinct(F.split("t", ""))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    rare = found.where("t <> label").select("t", "label", F.explode(F.array_distinct(F.concat(F.array_except(F.split("t", ""), F.split("label", "")), F.array_except(F.split("label", ""), F.split("t", ""))))).alias("c"))
    odd = rare.join(F.broadcast(chars.where("n <= 2")), "c").groupBy("t", "label").agg(F.collect_set("c").alias("odd"))

    @F.pandas_udf("array<double>")
    def related(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        split = Titles(simple.value)  # type: ignore[attr-defined]
        for t, label, odds in batches:
            yield pd.Series([title_relation(x, y, split, set(o) if o is not None else set()) for x, y, o in zip(t, label, odds, strict=True)])

    return found.join(odd.hint("merge"), ["t", "label"], "left").select("t", "label", related("t", "label", "odd").alias("v")).where("v is not null")


def _author_buckets(w: DataFrame, i: DataFrame, tables: object) -> DataFrame:
    """(side, title, bucket): MinHash bands over what is told of author and time, of works ('w') by their title and of items ('i') by each label."""

    def banded(tokens: list[str]) -> list[int]:
        if not tokens:
            return []
        h = minhashes(tokens, AUTHOR_BANDS * AUTHOR_ROWS)
        return sorted({xxhash.xxh64_intdigest(np.array([n, *h[n * AUTHOR_ROWS : (n + 1) * AUTHOR_ROWS]], dtype=np.int64).tobytes()) - (1 << 63) for n in range(AUTHOR_BANDS)})

    def told(find: Evidence, name: str | None, when: str | None, year: float | None) -> list[str]:
        forms = find.forms(name)[1] if name else []
        tokens = {f"{k}:{f}" for k, f in forms} | {f"c:{c}" for k, f in forms if k == "han" for c in f[1:]}
        return sorted(tokens | ({"e:" + when} if when else set()) | ({f"d:{int(year) // 10}"} if year is not None and year == year else set())) if tokens else []

    @F.pandas_udf("array<long>")
    def of_works(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = Evidence(*tables.value)  # type: ignore[attr-defined]
        for names, dynasty, first in batches:
            out = []
            for people, e, y in zip(names, dynasty, first, strict=True):
                year = float(y) if y and re.fullmatch(r"-?\d{1,4}", y) else None
                out.append(sorted({b for n in (people if people is not None else ()) for b in banded(told(find, n, era(e), year))}))
            yield pd.Series(out, dtype=object)

    @F.pandas_udf("array<long>")
    def of_items(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = Evidence(*tables.value)  # type: ignore[attr-defined]
        for text, dynasty, start in batches:
            out = []
            for t, e, y in zip(text, dynasty, start, strict=True):
                author, _, told_era, told_year = find.titles.described(t)
                out.append(banded(told(find, author, era(e) or told_era, y if y == y and y is not None else told_year)))
            yield pd.Series(out, dtype=object)

    a = w.select(F.lit("w").alias("side"), F.col("t").alias("title"), F.explode(of_works(F.transform("authorship", lambda x: x["person_name"]), "time_dynasty", "date_not_before")).alias("bucket"))
    b = i.select(F.lit("i").alias("side"), "labels", F.explode(of_items("description", "dynasty_label", "start_year")).alias("bucket")).select("side", F.explode("labels").alias("title"), "bucket")
    return stage(a.unionByName(b).distinct(), "entities-authors")


def features(works: DataFrame, items: DataFrame) -> DataFrame:
    """(kr_id, qid, x) of every candidate pair, x by FEATURES; of several titles of an item the closest counts."""
    spark = works.sparkSession
    tables = spark.sparkContext.broadcast(han_tables(spark))
    simple = spark.sparkContext.broadcast(tables.value[0])

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Titles(simple.value)
        for s in batches:
            yield s.map(t)

    @F.pandas_udf("array<string>")
    def labelled(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        t = Titles(simple.value)
        for title, aliases, description in batches:
            yield pd.Series([t.labels(*r) for r in zip(title, aliases, description, strict=True)])

    w = stage(works.withColumn("t", normal(F.coalesce("title", F.lit("")))).where("length(t) >= 2"), "entities-works")
    i = stage(items.withColumn("labels", labelled("wikidata_title", "aliases", "description")), "entities-items")
    labels = i.select("qid", F.explode("labels").alias("label"))
    near = stage(_title_pairs(w, labels, _author_buckets(w, i, tables), simple), "entities-titles")

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        find = Evidence(*tables.value)
        for ws, ims in batches:
            yield pd.Series([find(a, b) for a, b in zip(ws.to_dict("records"), ims.to_dict("records"), strict=True)])

    # tables that grow with the input; by the size of their compressed files the planner would broadcast some
    best = near.join(labels.hint("merge"), "label").join(w.select("kr_id", "t").hint("merge"), "t").groupBy("kr_id", "qid").agg(F.max("v").alias("v"))
    full = best.join(w.hint("merge"), "kr_id").join(i.hint("merge"), "qid")
    x = full.select("kr_id", "qid", F.concat("v", evidence(F.struct("time_dynasty", "date_not_before", "date_not_after", "author_dates", "authorship"), F.struct("dynasty_label", "start_year", "end_year", "description"))).alias("x"))
    # a pair that nothing but its title speaks for has a rival where time or author speak for another pair of the item
    speaks = sum((F.col("x")[FEATURES.index(n)] for n in ("era_same", "year_in", "life_in", "author_same")), F.lit(0.0)) > 0
    x = stage(x.withColumn("speaks", speaks & (F.col("x")[FEATURES.index("genre")] > 0)), "entities-evidence")
    v = lambda n: F.col("x")[FEATURES.index(n)]
    spoken = x.where(F.col("speaks") & (v("exact") + v("gap") > 0) & (v("era_other") + v("year_out") + v("life_out") == 0)).select("qid").distinct().withColumn("any", F.lit(True))
    rival = F.when(F.coalesce("any", F.lit(False)) & ~F.col("speaks"), 1.0).otherwise(0.0)
    return x.join(spoken.hint("merge"), "qid", "left").select("kr_id", "qid", F.concat("x", F.array(rival)).alias("x"))


def _sampled(pairs: DataFrame, n: int) -> pd.DataFrame:
    """x of the n pairs of least hash.

    A sort with a limit hands the driver n rows of every task; so rows are first cut at a hash below which a few more than n lie.
    """
    rows = pairs.select(F.xxhash64("kr_id", "qid").alias("h"), "kr_id", "qid", "x")
    total = rows.count()
    most = n + 10 * math.isqrt(n) + 100
    while most < total:
        near = rows.where(F.col("h") < (most << 64) // total - (1 << 63))
        if near.count() >= n:
            rows = near
            break
        most *= 2
    return rows.orderBy("h", "kr_id", "qid").limit(n).select("x").toPandas()


def trained(pairs: DataFrame) -> Classifier:
    """The classifier fitted on at most TRAINING_PAIRS pairs with a weak label, chosen by hash; PRIOR where fewer than 200 have one or all have the same."""
    sample = _sampled(pairs, TRAINING_PAIRS)
    if len(sample):
        x = np.array([list(v) for v in sample["x"]])
        y = np.array([weak_label(v) for v in x])
        known = y >= 0
        if known.sum() >= 200 and len(set(y[known])) == 2:
            return Classifier.train(x[known], y[known].astype(float))
    return Classifier(PRIOR)


def _scored(x: Column, model: Classifier) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model(np.array([list(v) for v in s])) if len(s) else np.zeros(0))

    return score(x)


def matched(works: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """(kr_id, qid, confidence) of the pairs that are one work.

    works: (kr_id, title, time_dynasty, date_not_before, date_not_after,
    author_dates, authorship); items: (qid, wikidata_title, aliases, dynasty_label,
    start_year, end_year, description). Keys or
    titles that are null match nothing; rows delivered again count once; further
    columns are ignored; empty tables give no pair.
    """
    w = works.where("kr_id is not null").dropDuplicates(["kr_id"]).select("kr_id", "title", "time_dynasty", "date_not_before", "date_not_after", "author_dates", F.coalesce("authorship", F.expr("filter(authorship, a -> false)"), F.array().cast(works.schema["authorship"].dataType)).alias("authorship"))
    i = items.where("qid is not null").dropDuplicates(["qid"]).select("qid", "wikidata_title", "aliases", "dynasty_label", F.col("start_year").cast("double"), F.col("end_year").cast("double"), "description")
    pairs = stage(features(w, i), "entities-features")
    model = trained(pairs)
    return pairs.select("kr_id", "qid", _scored(F.col("x"), model).alias("confidence")).where(F.col("confidence") >= least)
