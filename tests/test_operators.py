"""Core operators against brute force on small tables."""

import itertools
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import align, blocking, closure, components, documents, islands, merge, quality, resolve


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_functions(spark):
    df = spark.createDataFrame([("二十三", "1021–1086?", "DZ0012", "（清）王甲等", "（a（b）c"), ("一百零五", "x", "12.0", "李乙（撰）", ""), ("千", "-37--2", "no", None, None)], "n string, d string, i string, p string, b string")
    got = df.select(T.numeral(F.col("n")), T.year_span(F.col("d"))["first"], T.padded_id(F.col("i"), "DZ"), T.person_core(F.col("p")), T.paren_depth(F.col("b"))).collect()
    assert [r[0] for r in got] == [23, 105, 1000]
    assert [r[1] for r in got] == [1021, None, -37]
    assert [r[2] for r in got] == ["DZ0012", "DZ0012", ""]
    assert [r[3] for r in got] == ["王甲", "李乙", None]
    assert got[0][4] == [1, 1, 2, 2, 1, 1]


def test_grams_and_jaccard(spark):
    df = spark.createDataFrame([("甲乙丙甲乙", "乙丙丁"), ("甲", "甲"), ("", "")], "a string, b string")
    got = df.select(T.grams(F.col("a"), 2), T.grams(F.col("a"), 2, whole=True), F.round(T.jaccard(T.grams(F.col("a"), 2), T.grams(F.col("b"), 2)), 3)).collect()
    assert got[0][0] == ["甲乙", "乙丙", "丙甲"] and got[1][0] == [] and got[1][1] == ["甲"]
    assert [r[2] for r in got] == [0.25, 1.0, 1.0]


def test_fold_puts_several_characters_for_one(spark):
    df = spark.createDataFrame([("甲乙丙",)], "t string")
    assert df.select(T.fold(F.col("t"), {"甲": "A", "乙": "BB", "丙": ""})).first()[0] == "ABB"


def test_precedence(spark):
    a = spark.createDataFrame([("k", 2, "x"), ("k", 1, None), ("m", 1, "y")], "k string, o int, v string")
    assert rows(merge.first_wins(a, ["k"], ["o"])) == [("k", 1, None), ("m", 1, "y")]
    assert rows(merge.last_wins(a, ["k"], ["o"])) == [("k", 2, "x"), ("m", 1, "y")]
    assert rows(merge.first_given_per_column(a, ["k"], ["o"])) == [("k", "x"), ("m", "y")]
    b = spark.createDataFrame([("k", 9, "z"), ("n", 9, "w")], "k string, o int, v string")
    assert rows(merge.priority_union([b, a], ["k"], ["o"])) == [("k", 9, "z"), ("m", 1, "y"), ("n", 9, "w")]
    blank = spark.createDataFrame([("k", " "), ("m", "y")], "k string, v string")
    assert rows(merge.fill_only(blank, b, ["k"], ["v"])) == [("k", "z"), ("m", "y")]
    assert rows(merge.outer_merge(blank, b, ["k"], ["v"])) == [("k", " "), ("m", "y"), ("n", "w")]


def test_islands_and_intervals(spark):
    rng = random.Random(4)
    spans = [("a", s := rng.randint(0, 80), s + rng.randint(0, 9)) for _ in range(30)]
    df = spark.createDataFrame(spans, "k string, a int, b int")
    covered = len({p for _, a, b in spans for p in range(a, b)})
    assert rows(islands.union_length(df, ["k"], "a", "b")) == [("a", covered)]
    assert rows(islands.interval_islands(spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 8, 9)], "k string, a int, b int"), ["k"], "a", "b")) == [("a", 0, 7, 2), ("a", 8, 9, 1)]
    at = spark.createDataFrame([("a", x) for x in (1, 22, 44, 45)], "k string, at int")
    assert [r.island for r in islands.gap_islands(at, ["k"], F.col("at"), 21).orderBy("at").collect()] == [0, 0, 1, 1]
    totals = spark.createDataFrame([("a", 100), ("b", 10), ("c", 0)], "k string, n int")
    got = {r.k: (r.covered, round(r.ratio, 3)) for r in quality.coverage(df, totals, ["k"], "a", "b", "n").collect()}
    assert got == {"a": (covered, round(covered / 100, 3)), "b": (0, 0.0), "c": (0, 0.0)}


def test_asof_matches_brute_force(spark):
    rng = random.Random(6)
    left = [(rng.choice("ab"), rng.randint(0, 50), i) for i in range(40)]
    right = [(rng.choice("ab"), rng.randint(0, 50), f"r{i:02}") for i in range(25)]
    got = rows(islands.asof(spark.createDataFrame(left, "k string, at int, id int"), spark.createDataFrame(right, "k string, at int, rid string"), ["k"], "at", "rid", ["rid"], 5).select("id", "rid"))
    want = []
    for k, at, i in left:
        c = max(((a, r) for kk, a, r in right if kk == k and a <= at), default=None)
        want.append((i, c[1] if c and at - c[0] <= 5 else None))
    assert got == sorted(want, key=str)


def test_best_overlap_matches_brute_force(spark):
    rng = random.Random(8)
    p = [("a", s := rng.randint(0, 300), s + rng.randint(1, 60), i) for i in range(30)]
    q = sorted({("a", s := rng.randint(0, 300), s + rng.randint(1, 90)) for _ in range(20)})
    got = {r.id: (tuple(r.best)[1:3] if r.best else None) for r in islands.overlap_best(spark.createDataFrame(p, "k string, a int, b int, id int"), spark.createDataFrame(q, "k string, c int, d int"), ["k"], "a", "b", "c", "d", 16).collect()}
    for _, a, b, i in p:
        best = max(((min(b, d) - max(a, c), -c, -d) for _, c, d in q if min(b, d) > max(a, c)), default=None)
        assert got[i] == (None if best is None else (-best[1], -best[2]))


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    want = sorted((x, find(x)) for x in list(root))
    assert sorted(map(tuple, components.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect())) == want
    assert components.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    assert rows(closure.reachable(e, "a", "b", spark.createDataFrame([("a",)], "n string"), "n")) == [("a", 0), ("b", 1), ("c", 2)]


def test_resolution(spark):
    c = spark.createDataFrame([("s", "1", True), ("s", "2", False), ("t", "3", False), ("t", "4", False)], "k string, target string, good boolean")
    assert rows(resolve.unique_only(c, ["k"], "target")) == []
    assert rows(resolve.unique_only(c, ["k"], "target", [F.col("good")]).select("k", "target")) == [("s", "1")]
    p = spark.createDataFrame([("abcd",), ("abx",), ("q",)], "t string")
    pre = spark.createDataFrame([("a",), ("abc",)], "prefix string")
    assert rows(resolve.longest_prefix(p, "t", pre, "prefix")) == [("abcd", "abc"), ("abx", "a"), ("q", None)]
    n = spark.createDataFrame([("王安石",)], "w string")
    assert [r.part for r in resolve.suffix_pairs(n, "w", "part").collect()] == ["安石"]


def test_shared_grams_match_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 8)))) for i in range(25)]
    df = spark.createDataFrame(texts, "a int, t string")
    got = {(r.a, r.b): r.shared for r in blocking.shared_grams(df, df.select(F.col("a").alias("b"), F.col("t").alias("u")), "a", "t", "b", "u").collect()}
    g = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} if len(s) > 1 else {s}
    assert got == {(i, j): n for (i, s), (j, t) in itertools.product(texts, texts) if (n := len(g(s) & g(t)))}


def test_diagonal_window(spark):
    rng = random.Random(1)
    hay = "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(3000))
    a = spark.createDataFrame([(1, hay[1000:1100])], "n int, t string")
    b = spark.createDataFrame([(1, hay), (2, hay[:500])], "h int, u string")
    got = blocking.diagonal_window(a, b, "n", "t", "h", "u").collect()
    assert [(r.h, abs(r.bin * 128 - 1000) <= 256) for r in got] == [(1, True)]


def test_runs_equal_difflib_and_hold_their_invariants(spark):
    rng = random.Random(2)
    for _ in range(50):
        a = "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(0, 40)))
        runs = align.common_runs(a, b)
        assert sum(n for *_, n in runs) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in itertools.pairwise(runs))
    big = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(30_000))
    runs = align.common_runs(big[5000:9000], big)
    assert runs == [(0, 5000, 4000)]
    df = spark.createDataFrame([("甲乙丙", "甲乙丙丁"), ("", "甲"), (None, "甲")], "a string, b string")
    assert [r[0] for r in df.select(align.containment(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def test_align_units(spark):
    ref = spark.createDataFrame([(1, "甲乙丙丁戊己庚辛"), (2, "子丑寅卯辰巳午未"), (3, "一二三四五六七八"), (4, "")], "r int, k string")
    src = spark.createDataFrame([(10, "甲乙丙丁戊己庚辛"), (11, "子丑寅卯辰巳午未申酉"), (12, "天地玄黃宇宙洪荒")], "s int, j string")
    got = {r.r: (r.s, r.kind) for r in align.align_units(ref, src, "r", "k", "s", "j").collect()}
    assert got == {1: (10, "exact"), 2: (11, "contained")}


def test_documents(spark):
    xml = '<div><head>卷一</head><p>甲乙<note type="comm">丙丁</note>戊</p><p n="2">己<lb n="3"/></p></div>'
    df = spark.createDataFrame([(1, xml), (2, "<p>"), (3, None)], "k int, x string")
    assert [(r.kind, r.text, r.han_start, r.han_end) for r in documents.units(df, "k", "x").orderBy("id").collect()] == [("head", "卷一", 0, 2), ("text", "甲乙", 2, 4), ("comm", "丙丁", 4, 6), ("text", "戊", 6, 7), ("text", "己", 7, 8)]
    assert [r[0] for r in df.orderBy("k").select(documents.well_formed(F.col("x"))).collect()] == [True, False, None]
    assert rows(documents.milestones(df, "k", "x")) == [(1, 0, "3")]
    t = spark.createDataFrame([(1, "#+TITLE: 甲 \n#+PROPERTY: ID X1\n\n<pb:X1_a-1>¶\n乙丙¶\n丁。¶\n")], "k int, t string")
    r = t.select(documents.mandoku_header(F.col("t")), documents.mandoku_body(F.col("t"))).first()
    assert r[0] == {"TITLE": "甲", "ID": "X1"} and r[1] == "乙丙丁。"
    w = spark.createDataFrame([(1, "a\n== s ==\n[[t#x|d]] b\n[[u]]")], "k int, t string")
    assert [tuple(x) for x in w.select(F.explode(documents.wiki_links(F.col("t"))).alias("l")).select("l.*").collect()] == [("t", "d"), ("u", "u")]
    assert rows(documents.wiki_sections(w, "k", "t")) == [(1, 0, None, "a"), (1, 2, "s", "[[t#x|d]] b"), (1, 3, "s", "[[u]]")]


def test_transfer_keeps_the_characters():
    rng = random.Random(5)
    for _ in range(100):
        src = "".join(rng.choice("甲乙丙丁戊。，「」") for _ in range(30))
        tgt = "".join(rng.choice("甲乙丙丁戊　") for _ in range(25))
        han = lambda s: [c for c in s if "一" <= c <= "鿿"]
        assert han(documents.carried_marks(src, tgt)) == han(tgt)
        tidy = documents.finalized(src)
        assert documents.finalized(tidy) == tidy and han(tidy) == han(src)
    assert documents.carried_marks("「甲乙，丙。」", "甲乙丙") == "「甲乙，丙。」"
    assert documents.han_range("「甲乙，丙。」丁", 0, 3) == "「甲乙，丙。」"
    assert documents.filled("甲乙丙丁□己庚辛壬", ["甲乙丙丁戊己庚辛壬癸"]) == "甲乙丙丁戊己庚辛壬"
    assert documents.filled("甲乙丙丁□己庚辛壬", ["甲乙丙丁戊己庚辛壬", "甲乙丙丁戌己庚辛壬"]) == "甲乙丙丁□己庚辛壬"
    assert [n["error"] for n in documents.commentary("甲（乙）丙（丁")] == [None, "unclosed"]
