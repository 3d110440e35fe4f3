import pytest

from tessella.operators.packed_values import parse_field, split_values


def values(s):
    return [v for _, v, _ in parse_field(s)]


@pytest.mark.parametrize(
    ("field", "want"),
    [
        ("王甲、李乙（撰、注）、", ["王甲", "李乙（撰、注）"]),
        ("（清）宋茵（元）毛械早", ["（清）宋茵", "（元）毛械早"]),
        ("（宋）蘇宜  （清）鍾魘（撰）", ["（宋）蘇宜", "（清）鍾魘（撰）"]),
        ('["史脣聽", "康坷膩"]', ["史脣聽", "康坷膩"]),
        ('"Ives ""Old"" Hand, A.","Rud, P. J."', ['Ives "Old" Hand, A.', "Rud, P. J."]),
        ("Marmiley, Augustine E.;Ossatov, P.", ["Marmiley, Augustine E.", "Ossatov, P."]),
        ("G. A. Becsalow, Frederick Bran & Josephine J. Ulk", ["G. A. Becsalow", "Frederick Bran", "Josephine J. Ulk"]),
        ("M. Q. Ott, and W. B. Kav", ["M. Q. Ott", "W. B. Kav"]),
        ("Harvimark, Susannah", ["Harvimark, Susannah"]),
        ("1）武咒辮 2）方逢", ["武咒辮", "方逢"]),
        ("(1) 盧唇獗 (2) 釋泛", ["盧唇獗", "釋泛"]),
        ("1. 甲乙 2. 丙丁", ["甲乙", "丙丁"]),
        ("熊哪億；「弋倥、末仆書院」", ["熊哪億", "弋倥、末仆書院"]),
        ("釋度候　等", ["釋度候"]),
        ("石訖蔚等", ["石訖蔚"]),
        ("佚名", []),
        ("王甲<br/>李乙", ["王甲", "李乙"]),
        ("任搴惴　釋羞轂", ["任搴惴", "釋羞轂"]),
        ("甲乙|丙丁/戊己\n庚辛", ["甲乙", "丙丁", "戊己", "庚辛"]),
        ("艾·甕弋 + 鍾替", ["艾·甕弋", "鍾替"]),
        (";;、 ", []),
        (None, []),
        ("", []),
    ],
)
def test_values(field, want):
    assert values(field) == want


def test_open_marks_are_flagged_and_positions_run_from_one():
    got = parse_field("「甲乙、丙丁")
    assert [(p, f) for p, _, f in got] == [(1, "open_mark"), (2, "open_mark")]
    assert parse_field('["甲", "乙"')[0][2] == "open_mark"


def test_round_trip():
    names = ["王甲乙", "李丙丁", "張戊己"]
    for sep in ("、", "；", ";", "|", "/", "\n", "<br>", "，", " + ", "\t", "　"):
        assert values(sep.join(names)) == names


def test_frame(spark):
    df = spark.createDataFrame([("k1", "甲乙、丙丁", 1, "x"), ("k1", "甲乙、丙丁", 2, "x"), ("k2", None, 1, "x"), ("k3", "", 1, "x"), (None, "戊己", 1, "x"), ("k4", "甲乙、" * 5000, 1, "x")], "id string, authors string, pos int, value string")
    got = split_values(df, "id", "authors").collect()
    assert sorted((r.pos, r.value) for r in got if r.key == "k1") == [(1, "甲乙"), (1, "甲乙"), (2, "丙丁"), (2, "丙丁")]
    assert [r.value for r in got if r.key is None] == ["戊己"]
    assert sum(r.key == "k4" for r in got) == 5000
    assert not [r for r in got if r.key in ("k2", "k3")]
    assert split_values(df.limit(0), "id", "authors").count() == 0
