"""Names, works, packing and mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import entities, mixing, names, packing, tokens
from tessella.session import stage

SCHEMA = "record long, name string, era_text string, dates string, first string, last string, id string, component string"


def linked(spark, rows, authority=()):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    file = spark.createDataFrame(list(authority), "id string, name string, era_text string")
    return {int(r.record): r.component for r in names.variants(df, file).collect()}


def test_variants(spark):
    p = lambda i, n, e="", d="", x=None: (i, n, e, d, "", "", x)
    got = linked(
        spark,
        [
            p(1, "王安石", "宋", "1021-1086"), p(2, "（宋）王安石", "", ""), p(3, "王石安", "趙宋", "1021–1086?"), p(4, "王安石等", "宋", "1022-1086"), p(5, "王安石", "清", "1700-1760"), p(6, "王安硯", "宋", "1021-1086"), p(7, "王安禮", "宋", "1034-1095"),
            p(8, "Alexander Philip Mertonville", "清", "1800-1870"), p(9, "Mertonville, A. P.", "清", "1800-1870"), p(10, "Sandy Mertonville", "清", ""), p(11, "Rev. Alexander Mertonvlile", "清", "1800-1870"), p(12, "Robert Mertonville", "清", "1800-1870"),
            p(13, "半山老人", "", "", None), p(14, "", "宋"), p(15, None, "宋"), p(16, "大明德書院", ""), p(17, "明德 書院", ""), p(1, "王安石", "宋", "1021-1086"),
        ],
        [("900", "王安石", "宋"), ("900", "半山老人", "宋")],
    )
    assert len({got[i] for i in (1, 2, 3, 4, 6, 13)}) == 1
    assert got[5] != got[1] and got[7] != got[1]
    assert len({got[i] for i in (8, 9, 10, 11)}) == 1 and got[12] != got[8]
    assert got[16] == got[17]
    assert 14 not in got and 15 not in got


def test_ambiguous_undated_names_stay_apart(spark):
    got = linked(spark, [(1, "李公麟", "宋", "1049-1106", "", "", None), (2, "李公麟", "明", "1400-1460", "", "", None), (3, "李 公麟", "", "", "", "", None)])
    assert len(set(got.values())) == 3


class _Without:
    """A session whose ICU fails, or answers with as many lines as asked for."""

    def __init__(self, answer=None):
        self.answer = answer

    def __getattr__(self, name):
        return self

    def __call__(self, *args):
        if self.answer is None:
            raise TypeError("'JavaPackage' object is not callable")
        return self.answer if args[0][:1] == "一" else self


@pytest.mark.parametrize("answer", [None, "", "一\n丁"])
def test_missing_tables_of_characters_are_an_error(answer):
    """Empty ones would give a result that looks whole and misses links."""
    with pytest.raises(RuntimeError, match="ICU"):
        names.han_tables(_Without(answer))


def test_tables_of_characters(spark):
    simple, sounds = names.han_tables(spark)
    assert simple["葉"] == "叶" and sounds["王"] == "wang" and sounds["曾"] == "zeng"


def test_no_records(spark):
    assert linked(spark, []) == {}


def test_prefix_filter_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    forms = sorted({"".join(rng.choice("甲乙丙丁戊己庚") for _ in range(rng.randint(2, 4))) for _ in range(60)})
    df = spark.createDataFrame([(f, "han", f, False, names.tokens("han", f)) for f in forms], "form_id string, kind string, form string, typed boolean, tokens array<string>")
    got = {(r.fa, r.fb) for r in names.similar_forms(df, salt_rows=5).collect()}
    brute = set()
    for i, a in enumerate(forms):
        for b in forms[i + 1 :]:
            x, y = set(names.tokens("han", a)), set(names.tokens("han", b))
            if len(x & y) / len(x | y) >= names.SIMILARITY and names.relation("han", a, "han", b, {})[0]:
                brute.add((a, b))
    assert got <= brute
    assert {p for p in brute if names.relation("han", *p[:1], "han", p[1], {})[1] >= 0.6} <= got


@pytest.mark.parametrize(("text", "label"), [("（清）", "清"), ("國朝", "清"), ("Song dynasty", "宋"), ("北宋", "宋"), ("", None), (None, None)])
def test_era(text, label):
    assert names.era(text) == label


WORK = "kr_id string, title string, time_dynasty string, date_not_before string, date_not_after string, author_dates string, authorship array<struct<person_name:string,author_dates:string,date_not_before:string,date_not_after:string,time_dynasty:string>>, qid string"
ITEM = "qid string, wikidata_title string, aliases array<string>, dynasty_label string, start_year int, end_year int, description string, title string"


def test_matched(spark):
    a = [("王安石", "1021-1086", "", "", "宋")]
    works = spark.createDataFrame(
        [("w1", "《甲乙集》", "宋", "1060", "1070", "", a, "x"), ("w2", "甲乙集", "清", "1800", "1810", "", [], "x"), ("w3", "甲乙注", "宋", "1060", "1070", "", a, "x"), ("w4", None, "", "", "", "", None, "x"), ("w5", "", "", "", "", "", [], "x"), ("w1", "《甲乙集》", "宋", "1060", "1070", "", a, "x"), ("w6", "丙□記", "唐", "700", "710", "", [], "x")],
        WORK,
    )
    items = spark.createDataFrame(
        [("q1", "甲乙集 (Song dynasty book)", [], "北宋", 1065, None, "王安石所撰集", "t"), ("q2", "The Lost Leaf: poems", ["欽定甲乙集"], "Qing dynasty", 1805, None, None, "t"), ("q3", None, None, None, None, None, None, "t"), ("q4", "丙丁記", None, "唐朝", 705, None, "", "t"), ("q5", "無此書", [], "宋", None, None, "", "t")],
        ITEM,
    )
    got = entities.matched(works, items).collect()
    assert {(r.kr_id, r.qid) for r in got} == {("w1", "q1"), ("w2", "q2"), ("w6", "q4")}
    assert all(0.5 <= r.confidence <= 1 for r in got)
    assert entities.matched(works.limit(0), items).count() == 0


def test_classifier_is_calibrated_on_held_out_pairs():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(entities.FEATURES)))
    y = (rng.random(4000) < 0.5).astype(float)
    x[:, 0] = rng.random(4000) < np.where(y == 1, 0.9, 0.2)
    x[:, 5] = rng.random(4000) < np.where(y == 1, 0.8, 0.1)
    x[:, 6] = rng.random(4000) < np.where(y == 1, 0.0, 0.6)
    model = entities.Classifier.train(x[:3000], y[:3000])
    p = model(x[3000:])
    assert ((p > 0.5) == (y[3000:] == 1)).mean() > 0.85
    assert entities.Classifier(entities.PRIOR)(x[:2]).shape == (2,)


def test_minhash_finds_pairs_of_similar_sets():
    rng = random.Random(2)
    found = 0
    for _ in range(200):
        s = {str(rng.random()) for _ in range(4)}
        t = {*list(s)[:2], *(str(rng.random()) for _ in range(2))}  # Jaccard 1/3
        found += bool(set(entities.minhashes(sorted(s))) & set(entities.minhashes(sorted(t))))
    assert found >= 196


@pytest.mark.parametrize("capacity", [10, 100, 3000])
def test_plan_holds_every_item_once(capacity):
    rng = random.Random(capacity)
    sizes: dict[int, int] = {}
    for _ in range(400):
        s = min(capacity, 1 + int(rng.expovariate(5 / capacity)))
        sizes[s] = sizes.get(s, 0) + 1
    held: dict[int, int] = {}
    containers = 0
    for p, t in packing.plan(sizes, capacity):
        assert sum(s * a for s, a in p.items()) <= capacity and t > 0
        containers += t
        for s, a in p.items():
            held[s] = held.get(s, 0) + a * t
    assert held == sizes
    assert containers <= 1.03 * packing.lower_bound(sizes, capacity) + 2
    assert packing.plan({}, capacity) == []


def test_packed(spark):
    rows = [(i, 1 + (i * 37) % 90, "x") for i in range(300)] + [(1000, 250, "x"), (1001, 0, "x"), (None, 5, "x"), (1002, None, "x"), (5, 1 + (5 * 37) % 90, "x")]
    got = packing.packed(spark.createDataFrame(rows, "key long, tokens long, size string"), 100, rows_per_group=7).toPandas()
    sizes = {k: n for k, n, _ in rows if k is not None and n}
    assert got.groupby("key")["size"].sum().to_dict() == sizes
    assert (got[got.key != 1000].groupby("key").size() == 1).all() and len(got[got.key == 1000]) == 3
    used = got.groupby("container")["size"].sum()
    assert used.max() <= 100 and (got.groupby("container").fill.first() * 100 - used).abs().max() < 1e-9
    assert used.mean() > 92
    assert packing.packed(spark.createDataFrame([], "key long, tokens long"), 100).count() == 0


def test_flow_is_cheapest_and_within_bounds():
    sets = {("a",): 100, ("a", "b"): 50, ("b",): 30}
    flows = mixing.routed(sets, {"a": 120, "b": 60}, {"a": 1, "b": 2})
    out = {n: sum(f for (_, m), f in flows.items() if m == n) for n in "ab"}
    assert out == {"a": 120, "b": 60}
    assert flows[("a",), "a"] == 100  # nothing of b is repeated while a's own texts suffice
    assert mixing.attainable({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}) in (60, 61)


def test_mixed(spark):
    rows = [(i, "a", 10, f"t{i}".encode(), 1) for i in range(100)] + [(200 + i, "b", 10, f"u{i}".encode(), 1) for i in range(10)] + [(300, "b", 10, b"t1", 1), (301, "a", 10, b"t1", 1), (302, "c", 5, b"c", 1), (303, None, 5, b"d", 1), (304, "a", 0, None, 1)]
    docs = spark.createDataFrame(rows, "key long, source string, tokens long, digest binary, uses int")
    goal = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 2), ("z", None, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(docs, goal, rows_per_group=3)
    m, s = mix.toPandas(), {r.source: r for r in shares.collect()}
    assert m[m.source == "a"].uses.max() == 1 and m[m.source == "b"].uses.max() <= 2
    assert abs(s["a"].share - 0.8) < 0.03 and s["a"].reached and s["b"].reached
    short = {r.source: r for r in mixing.mixed(docs, goal, total=5000)[1].collect()}
    assert not short["a"].reached and not short["b"].reached
    again = mixing.mixed(docs, goal, rows_per_group=3)[0].toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, m.values))
    assert mixing.mixed(docs.limit(0), goal)[0].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "甲" * 2000)], "k long, t string")
    got = {r.k: r.tokens for r in tokens.sizes(df, "t", ["k"]).collect()}
    n = tokens.counter(tokens.TOKENIZER)
    assert got == {1: n("Hello world"), 2: 0, 3: 0, 4: n("甲" * 2000)}


def test_slips_in_readings_and_organisations(spark):
    forms = [("sound", "li|wangshi", True), ("sound", "li|wanshi", False), ("sound", "li|wnagshi", False), ("sound", "li|wengsha", False), ("sound", "linyuan|zhou", True), ("sound", "linyuan|zhoo", True), ("org", "甲乙丙丁戊|院", False), ("org", "甲乙丙戊|院", False), ("org", "甲乙|院", False), ("org", "甲丙|院", False)]
    df = spark.createDataFrame([(f, k, f, typed, names.tokens(k, f)) for k, f, typed in forms], "form_id string, kind string, form string, typed boolean, tokens array<string>")
    got = {(r.fa, r.fb): r.strength for r in names.similar_forms(df).collect()}
    assert got == {("li|wangshi", "li|wanshi"): 1, ("li|wangshi", "li|wnagshi"): 1, ("linyuan|zhoo", "linyuan|zhou"): 1, ("甲乙丙丁戊|院", "甲乙丙戊|院"): 1}


def test_one_form_of_many_records_is_brought_together_once(spark):
    many = [(i, "李公麟" if i % 2 else "李 公麟", "宋", "1049-1106", "", "", None) for i in range(400)]
    assert len(set(linked(spark, many).values())) == 1


def test_title_variants_are_weighed_not_gated():
    split = entities.Titles({})
    names_ = dict(zip(entities.FEATURES, entities.title_relation("甲乙丙集", "甲乙丙丁集", split, set()), strict=False))
    assert names_["dropped"] == 1 and names_["genre"] == 1 and names_["edits"] == 0
    assert dict(zip(entities.FEATURES, entities.title_relation("甲乙丙集", "續甲乙丙集", split, set()), strict=False))["genre"] == 0
    assert dict(zip(entities.FEATURES, entities.title_relation("甲乙丙集", "甲乙丙注", split, set()), strict=False))["genre"] == 0
    assert entities.title_relation("甲乙丙集", "丁戊己集", split, set()) is None


def test_training_sample_reaches_the_driver_once(spark, monkeypatch):
    """Not its full size from each of many tasks, and still the pairs of least hash."""
    n, asked = 20_000, 500
    monkeypatch.setattr(entities, "TRAINING_PAIRS", asked)
    pairs = stage(spark.range(n).selectExpr("cast(id as string) kr_id", "cast(id * 7 as string) qid", "concat(array(cast(id as double)), array_repeat(0D, 18)) x").repartition(40))
    hashes = pairs.select(F.xxhash64("kr_id", "qid").alias("h"), F.col("x")[0].alias("x0")).orderBy("h").limit(asked)
    want = [r.x0 for r in hashes.collect()]
    conf = spark.sparkContext._jsc.sc().conf()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    arrow = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    before = conf.get("spark.driver.maxResultSize", "1g")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
        conf.set("spark.driver.maxResultSize", "2m")
        assert entities.trained(pairs).weights is entities.PRIOR
        got = entities._sampled(pairs, asked)
    finally:
        conf.set("spark.driver.maxResultSize", before)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    assert [v[0] for v in got["x"]] == want
    assert len(entities._sampled(pairs.limit(3), asked)) == 3 and len(entities._sampled(pairs.limit(0), asked)) == 0


def test_candidates_are_never_broadcast(spark):
    """The planner takes exploded buckets for small, whatever their number; sent through the driver they would fill its memory."""
    rows = spark.range(5).selectExpr("cast(id as string) t", "id bucket")
    plan = entities._met(rows, rows.withColumnRenamed("t", "label"), "t", "label", 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
