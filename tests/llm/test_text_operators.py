"""Sentences, look-alikes and residue: known cases, odd input, brute force."""

import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import lookalike, residue, sentences


def cut(text, **known):
    seen = {k: (v, v) for k, v in known.items()}
    return [text[a:b] for a, b in sentences.segment(text, seen.get)]


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("其文真。故曰：「甲乙丙。丁戊己！」於是去（甲作乙。下同。），不還。", ["其文真。", "故曰：「甲乙丙。丁戊己！」", "於是去（甲作乙。下同。），不還。"]),
        ("“甲乙吗？”校者写道。版本为v80.58.2，见甲；另见乙……丙！", ["“甲乙吗？”校者写道。", "版本为v80.58.2，见甲；另见乙……丙！"]),
        ("「甲とは何か。まだ。」と述べる。次だ。", ["「甲とは何か。まだ。」と述べる。", "次だ。"]),
        ("It was lost, etc. Several hands wrote on fol. 12v of the roll. Dr. Smith left ... and came.", ["It was lost, etc.", "Several hands wrote on fol. 12v of the roll.", "Dr. Smith left ... and came."]),
        ('He replied, "None left. Look!" Then he wrote.', ['He replied, "None left. Look!"', "Then he wrote."]),
        ("Am 5. März wurde z. B. Bd. 3, S. 7 geprüft. Etwa 77,7 % fehlt!", ["Am 5. März wurde z. B. Bd. 3, S. 7 geprüft.", "Etwa 77,7 % fehlt!"]),
        ("कालः । लेखः ॥ ७४ ॥ पाठः", ["कालः ।", "लेखः ॥ ७४ ॥", "पाठः"]),
        ("ནོར་དང་། གེ་འོ།། ༈ ཆུ་ནོ།།", ["ནོར་དང་། གེ་འོ།།", "༈ ཆུ་ནོ།།"]),
        ("교정자는 “빠졌다. 보라.”라고 적었다. 끝이다.", ["교정자는 “빠졌다. 보라.”라고 적었다.", "끝이다."]),
        ("कालः ॥ ²७ ॥ पाठः ।", ["कालः ॥ ²७ ॥", "पाठः ।"]),
        ("Am 9. Ma\u0308rz kam er. Etwa.", ["Am 9. Ma\u0308rz kam er.", "Etwa."]),
        ("", []),
        ("  \n ", []),
        ("甲「乙。丙", ["甲「乙。", "丙"]),
    ],
)
def test_units(text, units):
    assert cut(text) == units


def test_document_evidence_decides():
    # "blk" is an abbreviation in this document: it stands before small letters
    assert cut("See blk. Five here.", blk=[5, 0, 0, 3, 0, 0, 0]) == ["See blk. Five here."]
    assert cut("It is a blk. Five here.", blk=[0, 0, 4, 3, 0, 6, 0]) == ["It is a blk.", "Five here."]


def test_units_cover_all_letters():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("甲乙。！「」（）ab. \n​།॥A") for _ in range(rng.randint(0, 60)))
        units = sentences.segment(t)
        assert all(a < b for a, b in units) and all(x[1] <= y[0] for x, y in itertools.pairwise(units))
        kept = "".join(t[a:b] for a, b in units)
        assert [c for c in kept if c.isalnum()] == [c for c in t if c.isalnum()]


def paragraphs(spark, rows):
    return spark.createDataFrame(rows, "row long, doc string, text string, heading string, extra int")


def test_sentences_frame(spark):
    src = paragraphs(spark, [(1, "f", "甲乙丙。丁戊己。", None, 1), (1, "f", "甲乙丙。丁戊己。", None, 2), (2, "f", "第一。章", "chapter", 1), (3, None, None, None, 1), (4, "f", "", None, 1), (None, "f", "甲。", None, 1)])
    ref = paragraphs(spark, [(10, "j", "甲乙丙　丁戊己", None, 1), (11, "j", "庚辛壬", None, 1), (12, "j", "甲。" * 3000, None, 1)])
    got = sorted(map(tuple, sentences.sentences(src, ref).collect()))
    assert got[:3] == [(1, 0, 4), (1, 4, 8), (2, 0, 5)[:1] + (0, 5)] or got[:3] == [(1, 0, 4), (1, 4, 8), (2, 0, 4)]
    assert [g for g in got if g[0] == 10] == [(10, 0, 3), (10, 4, 7)]
    assert [g for g in got if g[0] == 11] == [(11, 0, 3)]
    assert sum(g[0] == 12 for g in got) == 3000
    assert sentences.sentences(src.limit(0), ref.limit(0)).count() == 0


SAME = [("ABC", "ＡＢＣ"), ("ABC", "АВС"), ("file", "ﬁle"), ("é", "é"), ("甲​乙", "甲乙"), ("a b", "a b"), ("a-b", "a‑b"), ("二", "ニ"), ("⼈", "人"), ("ガ", "ガ"), ("ガ", "ｶﾞ"), ("豈", "豈"), ("ạ̄", "ạ̄")]
OTHER = [("a²", "a2"), ("a\nb", "a b"), ("a  b", "a b"), ("說", "説"), ("黃", "黄"), ("a", "A"), ("l", "I"), ("a–b", "a-b"), ("，", ",")]


def test_looks():
    rules = lookalike.rewrite_table({c: 9 for c in "abcABC"})
    rw = lookalike.Rewriter(rules)
    for a, b in SAME:
        assert rw(a) == rw(b), (a, b)
    for a, b in OTHER:
        assert rw(a) != rw(b), (a, b)
    assert lookalike.resolve_references("&#x7532;&#30002;&lt;&#60;&amp;") == "甲甲&lt;&lt;&amp;"
    for t in ("", "Аé甲　ﬃ" * 50):
        assert rw(rw(t)) == rw(t)


def test_representative_follows_the_corpus():
    assert lookalike.Rewriter(lookalike.rewrite_table({"А": 50, "A": 1}))("A") == "А"


def test_lookalike_pairs(spark):
    rows = [(1, "АВС", 0), (2, "ABC", 0), (2, "ABC", 1), (3, "ABC", 0), (4, "abd", 0), (5, None, 0), (6, "", 0), (7, "ＡBC" + "甲" * 5000, 0), (8, "ABC" + "甲" * 5000, 0)]
    df = spark.createDataFrame(rows, "row long, t string, form int")
    rules = lookalike.rewrite_table(lookalike.character_counts([df.select("t")]))
    forms = lookalike.classes(df, "row", "t", rules)
    want = {(1, 2), (1, 3), (7, 8)}
    assert {tuple(r) for r in lookalike.pairs(forms).collect()} == want
    assert {tuple(r) for r in lookalike.pairs(forms, salt_rows=1).collect()} == want
    assert lookalike.pairs(lookalike.classes(df.limit(0), "row", "t", rules)).count() == 0


RESIDUE = ["Dear <work_title>, x", "a [[juan_no]] b", "$edition.label$ c", "甲[INSERT title HERE]乙", "502 Bad Gateway\nnginx", "Dear {{name}}, welcome.", "書名：【請輸入書名】", "a ${x_y} b", "404 Not Found\n\nThe requested URL /a was not found on this server.", "Please enable JavaScript to view this page.\n© the editors", "Lorem ipsum dolor sit amet, consectetur elit sed do", "test test test test test test", "首頁　目錄　檢索\n本網站需要啟用 JavaScript 才能正常閱讀。"]
REAL = ["a <lb>b</lb><title>t</title> <br> c costs $5 or $6", "甲[[乙|丙]]丁[[戊]]", "The manual explains that `{{title}}` is replaced.", "The set {1, 2, 3} and ${} are marks.", "{{*|甲乙}}[[丙|丁]]故丙見丁。", "原闕五字，待補。甲乙丙丁戊己庚辛。", "In 404 the itinerary breaks off; page 404 is not found in our copy.", "", "  ", "".join(chr(0x4E00 + (i * i * 31 + i) % 5000) for i in range(4000))]


def test_residue(spark):
    texts = RESIDUE + REAL
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (99, None, "x")], "doc_id long, text string, body string")
    got = {r.doc for r in residue.residue(df, "doc_id", "text").collect()}
    assert got == set(range(len(RESIDUE)))
    assert residue.residue(df.limit(0), "doc_id", "text").count() == 0


def test_residue_spreads_over_near_duplicates(spark):
    base = "please enable javascript to view this page of the library catalogue and its many reading rooms today"
    other = "XX " + base + " with all its indexes, plates, maps, notes and tables of every kind, as they were printed in the year of the flood by the old press"
    twin = other.replace("every kind", "each kind")
    df = spark.createDataFrame([(1, other), (2, twin), (3, "A note on the hymn and its tune, copied late.")], "doc_id long, text string")
    hashes = {r.doc: r.sim for r in residue.prepared(df, "doc_id", "text").collect()}
    assert len(hashes) == 3
    bodies = spark.createDataFrame([(k, v) for k, v in hashes.items()], "rep long, sim long")
    near = {tuple(r) for r in residue.candidates(bodies).collect()}
    brute = {(a, b) for a, b in itertools.combinations(sorted(hashes), 2) if ((hashes[a] ^ hashes[b]) & (2**64 - 1)).bit_count() <= residue.MAX_HAMMING}
    assert near == brute


def test_simhash_tables_find_all_within_three_bits(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        x = rng.getrandbits(64)
        rows.append((2 * i, x))
        for b in rng.sample(range(64), i % 5):
            x ^= 1 << b
        rows.append((2 * i + 1, x))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    got = {tuple(r) for r in residue.candidates(spark.createDataFrame(signed, "rep long, sim long"), salt_rows=2).collect()}
    assert got == {(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if (x ^ y).bit_count() <= 3}


def test_batched_shingles_agree_with_single_ones():
    bodies = ["one two three four five six", "甲乙丙丁戊己", "", "a b", "甲 b 丙 d 戊 f"]
    assert residue.simhashes(bodies) == [residue.simhashes([b])[0] for b in bodies]
    assert residue.simhashes(["甲乙丙丁戊" * 1000], block=700) == residue.simhashes(["甲乙丙丁戊" * 1000])
    words = bodies[0].split()
    assert len(residue.shingles(bodies[0])) == len(words) - 4


def test_verified_pairs_match_brute_force(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    texts = {1: a, 2: a + " thirteen", 3: a.replace("six", "sixth"), 4: "quite another text with words of its own here"}
    df = spark.createDataFrame(list(texts.items()), "d long, t string")
    pairs = spark.createDataFrame(list(itertools.combinations(texts, 2)), "a long, b long")
    got = {tuple(r) for r in residue.verified(pairs, df, "d", "t").collect()}

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(x, y) for x, y in itertools.combinations(texts, 2) if len(sh(texts[x]) & sh(texts[y])) / len(sh(texts[x]) | sh(texts[y])) >= 0.8}
    assert got == want == {(1, 2)}
    assert isinstance(df.select(F.lit(1)).toPandas(), pd.DataFrame)


def test_residue_links_all_pairs_of_the_similarity(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(60):
        words = ["w" + chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(26)) + chr(97 + i % 26) for _ in range(rng.randint(3, 90))]
        other = list(words)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(len(other))] = "other"
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(["begin"] * (i % 3) + other)
    sets = {k: residue.shingles(v) for k, v in texts.items()}
    alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b]) >= residue.SIMILARITY}
    sims = dict(zip(texts, residue.simhashes(list(texts.values())), strict=True))
    far = {(a, b) for a, b in want if ((sims[a] ^ sims[b]) & (2**64 - 1)).bit_count() > residue.MAX_HAMMING}
    assert len(far) > 5
    used = np.bincount(np.concatenate([v.view(np.int64) & 1023 for v in sets.values()]), minlength=1024)
    packed = lambda v: residue.prefix(v.view(np.int64), used).view(np.uint8).reshape(-1, 8)[:, : residue.HEAD_BYTES].tobytes()
    df = spark.createDataFrame([(k, str(k), len(v), bytearray(packed(v))) for k, v in sets.items()], "rep long, body string, n int, heads binary")
    for salt_rows in (2, 2000):
        assert want <= {tuple(r) for r in residue.shingle_candidates(df, salt_rows, 30).collect()}


def test_label_reaches_a_variant_many_bits_away(spark):
    notice = "please enable javascript to view this page of the library catalogue and its many reading rooms and old maps today"
    pages = [f"{w} {notice}" for w in ("attn", "xx", "reader", "dear guest", "to all", "web", "client", "library")]
    sims = residue.simhashes([notice, *pages])
    assert max(((s ^ sims[0]) & (2**64 - 1)).bit_count() for s in sims) > residue.MAX_HAMMING
    df = spark.createDataFrame(list(enumerate([notice, *pages])), "doc_id long, text string")
    assert {r.doc for r in residue.residue(df, "doc_id", "text").collect()} == set(range(9))


def test_long_texts_are_read_like_short_ones():
    menu = "Home | News | Maps | Contact\n"
    for n in (3, 300):
        assert residue.trusted_label(residue.body_of(menu * n + "502 Bad Gateway\n" + menu * n, []), False) == "message"
    filler = " ".join(sorted(residue.LOREM)) + ". "
    real = "".join(f"the {a} of the {b} was copied late. " for a in ("hymn", "tune", "map", "page") for b in "abcdefghijklmnopqrstuvwxyz")
    assert residue.trusted_label(residue.body_of(filler * 6 + real + filler * 6, []), False) is None
    edge = "a note on the old hymn and its tune. " * 3
    assert residue.trusted_label(residue.body_of(edge + filler * 90 + edge, []), False) == "filler"


def test_messages_of_unlisted_wording_are_known_by_their_pages(spark):
    message = "Our server could not serve this page. Retry later, or open a new session in another browser."
    pages = ["Home | Maps | Help\n{}", "{}\n© the editors", "<html><body>{}</body></html>", "2024-05-06 07:08 {}"]
    poem = "the moon over the river was copied late and the hymn was read at dawn by the old press of the hill"
    rows = [(i, p.format(message)) for i, p in enumerate(pages)] + [(10 + i, p.format(poem)) for i, p in enumerate(pages)] + [(20, message.replace("Retry later", "It was said"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert residue.trusted_label(residue.masked(message)[0], False) is None
    assert {(r.doc, r.label, r.direct) for r in residue.residue(df, "doc_id", "text").collect()} == {(i, "message", False) for i in range(4)}
    assert residue.residue(df.where("doc_id < 2"), "doc_id", "text").count() == 0  # two pages are no proof


def test_slots_of_unlisted_shape_are_known_by_their_neighbours(spark):
    letter = "Dear {}, the work {} was added to your shelf on {} by the keepers of the reading room."
    listed, unlisted, filled = letter.format("{{name}}", "{{title}}", "{{date}}"), letter.format("⟦⟦name⟧⟧", "⟦⟦title⟧⟧", "⟦⟦date⟧⟧"), letter.format("Ann", "Hymns", "Monday")
    df = spark.createDataFrame([(1, listed), (2, unlisted), (3, filled), (4, "The marks ⟦⟦name⟧⟧ are used by an old press for names.")], "doc_id long, text string")
    assert {(r.doc, r.direct) for r in residue.residue(df, "doc_id", "text").collect()} == {(1, True), (2, False)}


def test_half_the_seeds_find_the_other_half_too(spark):
    texts = ["404 Not Found. The requested URL {} was not found on this server.", "Please enable JavaScript to view this page.", "本網站需要啟用 JavaScript 才能正常閱讀。請調整瀏覽器設定後重新整理。", "요청하신 페이지를 찾을 수 없습니다. 주소를 다시 확인해 주세요."]
    pages = ["{}", "Home | Maps | Help\n{}", "{}\n© the editors", "首頁　目錄　檢索\n{}"]
    df = spark.createDataFrame([(10 * i + j, p.format(t.format(f"/a/{i}{j}"))) for i, t in enumerate(texts) for j, p in enumerate(pages)], "doc_id long, text string")
    every = {r.doc for r in residue.residue(df, "doc_id", "text").collect()}
    got = residue.residue(df, "doc_id", "text", re.compile(r"(?:# )?not found(?!\w)")).collect()
    assert {r.doc for r in got} == every == {r.doc_id for r in df.collect()}
    assert sum(not r.direct for r in got) == 12


def test_patterns_tried_where_they_can_begin_find_the_same():
    rng = random.Random(3)
    atoms = [*"abfx019٣_-.:([{<$%@ \n'「》…~，　’甲一ßé", "2020-01-01", "2020-01-01 10:00:00", "www.a.org", "{{n}}", "{ab_c}", "__ab__", "<tag>", "【請填寫甲】", "«fooBar»", "««甲»»", "0af3", "Ａ９", "a_b("]
    for _ in range(3000):
        text = "".join(rng.choices(atoms, k=rng.randint(0, 30)))
        assert [m.span() for m in residue._found(residue.SLOT, residue._SLOT_START, text)] == [m.span() for m in residue.SLOT.finditer(text)]
        assert residue.loose_slots(text, []) == [m.span() for m in residue.LOOSE.finditer(text)]
        bare = text.casefold().replace("_", "-")
        assert residue._NUMBERS.sub("#", bare) == residue._MASK.sub("#", bare)


def test_preparing_a_text_takes_little_more_than_its_plain_patterns():
    """CPU seconds of all that is made of a text, against those of two patterns and the counts of its SimHash, each done in the plain way."""
    rng = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x5A00)]
    texts = ["".join(rng.choices(han, k=rng.randint(100, 500))) + f"，「{rng.choice(han)}」see {rng.randint(1, 999)} words。\n" * 3 for _ in range(500)]
    used = np.zeros(1 << residue.RARITY_BITS, dtype=np.uint8)

    def plain():
        for t in texts:
            list(residue.LOOSE.finditer(t))
            residue._MASK.sub("#", t)
        bits = np.unpackbits(residue._shingle_hashes(texts)[0].view(np.uint8).reshape(-1, 8), axis=1)
        np.add.reduceat(bits, np.arange(0, len(bits), 300), axis=0, dtype=np.int32)

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    assert min(seconds(lambda: residue._prepared(texts, residue.SEEDS, used)) for _ in range(5)) < 1.7 * min(seconds(plain) for _ in range(5))
