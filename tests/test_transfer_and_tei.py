"""Finding passages, carrying marks, and splitting and reducing bodies."""

import random
import re
import time
import xml.etree.ElementTree as ET
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessella.operators import align, documents, tei, transfer
from tessella.session import stage

HAN = [chr(c) for c in range(0x4E00, 0x5A00)]


def text(rng, n):
    return "".join(rng.choice(HAN) for _ in range(n))


def edited(rng, s, rate):
    out = []
    for ch in s:
        x = rng.random()
        out.append(rng.choice(HAN) if x < rate / 3 else "" if x < 2 * rate / 3 else ch + rng.choice(HAN) if x < rate else ch)
    return "".join(out)


@pytest.mark.parametrize("rate", [0.0, 0.02, 0.08])
def test_overlap_finds_edited_passages(rate):
    rng = random.Random(4)
    tape = text(rng, 4000)
    got = transfer.overlap(tape, edited(rng, tape[1500:1800], rate))
    assert got and abs(got[0] - 1500) <= 6 and abs(got[1] - 1800) <= 6
    assert transfer.overlap(tape, text(rng, 60)) is None and transfer.overlap(tape, "") is None
    assert transfer.overlap_from(tape, tape[10:60], 40) is None and transfer.overlap_from(tape, tape[100:160], 20) == (100, 160)
    assert transfer.overlap_flexible(tape, text(rng, 40) + "○" + tape[300:340]) == (300, 340)


def test_stretches_leave_out_what_is_covered():
    rng = random.Random(5)
    tape = text(rng, 500)
    assert transfer.stretches(tape, tape[100:200]) == [(100, 200, 0, 100)]
    assert transfer.stretches(tape, tape[100:200], [(120, 150)]) == [(100, 120, 0, 20), (150, 200, 50, 100)]
    assert transfer.stretches(tape, text(rng, 100)) == []
    assert transfer.free_parts(0, 10, [(2, 4), (3, 6), (9, 12)]) == [(0, 2), (6, 9)]


def test_marks_from_several_sources():
    rng = random.Random(6)
    a, b = text(rng, 40), text(rng, 40)
    marked = lambda s: "，".join(s[i : i + 8] for i in range(0, len(s), 8)) + "。"
    got, covered, used = transfer.from_sources(a + b, [marked(b), text(rng, 50), marked(a)])
    assert re.sub("[，。]", "", got) == a + b and covered == 1.0 and used == [0, 2] and got.count("。") == 2 and got.count("，") == 8
    assert transfer.scoped_marks("前" + marked(a) + text(rng, 30), a) == marked(a)
    assert transfer.scoped_marks(marked(text(rng, 40)), a) == a
    assert transfer.place_map("甲乙丙", "甲丁丙") == {0: 0, 2: 2} and transfer.place_map("甲乙丙", "甲丁丙", strict=False) == {0: 0, 1: 1, 2: 2}


def test_alignment_agrees_with_the_exact_matcher_where_nothing_is_unique():
    a, b = "甲乙丙丁" * 400, "甲乙丙丁" * 2500
    began = time.time()
    assert sum(n for *_, n in align.common_runs(a, b)) == 1600
    assert time.time() - began < 10


def test_one_text_against_a_million_characters():
    rng = random.Random(7)
    big = text(rng, 1_000_000)
    part = edited(rng, big[300_000:340_000], 0.03)
    began = time.time()
    runs = align.common_runs(part, big)
    assert time.time() - began < 20
    assert sum(n for *_, n in runs if n >= 10) >= 0.85 * len(part)


def test_paragraph_alignment(spark):
    rng = random.Random(8)
    p = [text(rng, 30) for _ in range(9)]
    src = spark.createDataFrame([(i, "f", i, k) for i, k in enumerate(p)] + [(99, "g", 0, p[0])], "src_id int, file string, idx int, key string")
    ref = [(1, p[0]), (2, p[3][5:]), (3, p[4] + p[5] + p[6]), (4, text(rng, 30)), (5, ""), (6, edited(rng, p[7] + p[8], 0.05)), (7, None)]
    got = {r.ref_id: (r.file, r.first_idx, r.last_idx, r.kind) for r in transfer.align_paragraphs(spark.createDataFrame(ref, "ref_id int, key string"), src).collect()}
    assert got == {1: ("f", 0, 0, "exact"), 2: ("f", 3, 3, "contained"), 3: ("f", 4, 6, "merged"), 6: ("f", 7, 8, "merged")}
    assert transfer.align_paragraphs(spark.createDataFrame([], "ref_id int, key string"), src).count() == 0


def test_aligning_broadcasts_no_keys(spark, monkeypatch):
    """Neither paragraphs nor their grams go through the driver, as they would where the planner takes them for small."""
    rng = random.Random(8)
    p = [text(rng, 30) for _ in range(6)]
    src = spark.createDataFrame([(i, "f", i, k) for i, k in enumerate(p)], "src_id int, file string, idx int, key string")
    ref = spark.createDataFrame([(1, p[0]), (2, p[3][5:]), (3, p[4] + p[5])], "ref_id int, key string")
    plans = []
    monkeypatch.setattr(transfer, "stage", lambda df, name: plans.append(df) or stage(df, name), raising=False)
    got = transfer.align_paragraphs(ref, src)
    assert {r.ref_id: r.kind for r in got.collect()} == {1: "exact", 2: "contained", 3: "merged"}
    for df in [*plans, got]:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_ratio_is_the_standard_one(spark):
    rng = random.Random(9)
    pairs = [("".join(rng.choice("甲乙丙") for _ in range(n)), "".join(rng.choice("甲乙丙") for _ in range(n))) for n in (0, 5, 300)]
    df = spark.createDataFrame([*pairs, (None, "甲")], "a string, b string")
    assert [r[0] for r in df.select(align.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [*(pytest.approx(SequenceMatcher(None, a, b).ratio()) for a, b in pairs), None]


BODY = '<body><p xml:id="a">一<milestone n="1"/>二<note target="#a">三</note></p><p style="x" place="inline">四<lb/>五<g ref="#G1"/>六</p><milestone n="2"/><p>七</p></body>'


def test_split_keeps_all_text():
    parts = tei.slices(BODY)
    assert [p["n"] for p in parts] == ["1", "2"]
    assert "".join("".join(ET.fromstring(p["xml"]).itertext()) for p in parts) == "一二三四五六七"
    assert tei.slices("<body><p>甲</p></body>") == [{"n": "", "xml": "<body><p>甲</p></body>"}]
    joined = tei.stitched([{"n": "1", "xml": '<b><p xml:id="a"/></b>'}, {"n": "1", "xml": '<b>尾<p xml:id="a"/><ref target="#a"/></b>'}])
    assert len(joined) == 1 and 's1-a"' in joined[0]["xml"] and "#s1-a" in joined[0]["xml"] and "尾" in joined[0]["xml"]


def test_reduction_keeps_text_around_what_goes():
    xml, done = tei.reduced(BODY, line_breaks=True, chars={"G1": "字"})
    assert "".join(ET.fromstring(xml).itertext()) == "一二三四五字六七"
    assert done == {"lb": 1, "g": 1, "@style": 1, "@place": 1} and 'rend="inline"' in xml
    assert tei.nested_heads([1, 2, 2, 3, 1, 3]) == [-1, 0, 0, 2, -1, 4]


def test_many_sections_in_time(spark):
    body = "<body>" + "".join(f'<milestone n="{i}"/><p>甲乙丙<ref target="#n{i}"/></p>' for i in range(6000)) + "</body>"
    began = time.time()
    parts = tei.sections(spark.createDataFrame([("d", body), ("bad", "<body>")], "doc string, x string"), "doc", "x")
    notes = spark.createDataFrame([("d", f"n{i}", f"c{i}") for i in range(6000)], "doc string, note_id string, content string")
    assert tei.attach_notes(parts, notes).count() == 6000
    assert time.time() - began < 30
    assert documents.parse_problem(parts.first().xml) is None


def test_fuzzy_labels_match_brute_force(spark):
    from tessella.operators import resolve

    rng = random.Random(11)
    keys = ["".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    labels = [(i // 2, "".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randint(1, 6)))) for i in range(40)] + [(50, keys[3])]
    got = resolve.fuzzy_labels(spark.createDataFrame(list(enumerate(keys)), "subject int, key string"), spark.createDataFrame(labels, "target int, label string"), threshold=0.5)
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = set()
    for s, k in enumerate(keys):
        best = {}
        for t, l in labels:
            a, b = grams(k), grams(l)
            if a & b and 0.35 <= len(l) / len(k) <= 2.85:
                best[t] = max(best.get(t, (0.0, "")), (len(a & b) / len(a | b), l))
        short = sorted(best, key=lambda t: (-best[t][0], t))[:32]
        scored = sorted((-SequenceMatcher(None, k, best[t][1]).ratio(), t) for t in short)
        want |= {(s, t, round(-x, 6), n + 1) for n, (x, t) in enumerate([p for p in scored if -p[0] >= 0.5][:5])}
    assert {(r.subject, r.target, round(r.score, 6), r["rank"]) for r in got.collect()} == want and want
    exact = resolve.matched_labels(spark.createDataFrame([(3, keys[3]), (4, None)], "subject int, key string"), spark.createDataFrame(labels, "target int, label string"))
    assert [(r.target, r.method) for r in exact.where("best").collect()] == [(50, "exact")] or len(keys[3]) < 2


def test_offers_are_used_once(spark):
    from tessella.operators import resolve

    rows = spark.createDataFrame([("w", 1, 2, "author"), ("w", 2, 1, "editor"), ("w", 3, 3, "author"), ("v", 4, 1, "author")], "g string, k int, o int, role string")
    offers = spark.createDataFrame([("w", "a", "author", 1), ("w", "e", "editor", 2), ("u", "x", "author", 1)], "g string, target string, role string, place int")
    assert {tuple(r) for r in resolve.used_once(rows, offers, "g", "k", "o").collect()} == {(2, "e"), (1, "a")}
