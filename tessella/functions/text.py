"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han characters as a class for regular expressions.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
SPACES = " \t\n\r　"


def content_only(c: Column, chars: str = HAN) -> Column:
    """Only the characters of the class."""
    return F.regexp_replace(c, f"[^{chars}]", "")


def fold(c: Column, table: Mapping[str, str]) -> Column:
    """Each character by the table's; several characters for one are put in one after another."""
    one = {a: b for a, b in table.items() if len(a) == 1 and len(b) <= 1}
    out = F.translate(c, "".join(a for a, b in one.items() if b) + "".join(a for a, b in one.items() if not b), "".join(b for b in one.values() if b)) if one else c
    for a, b in table.items():
        if a not in one:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def para_key(c: Column, table: Mapping[str, str] | None = None) -> Column:
    """Comparison key of a paragraph: its Han characters, folded. Never shown."""
    return fold(content_only(c), table or {})


def title_key(c: Column) -> Column:
    """Comparison key of a title: without white space, punctuation, separators and Latin letters."""
    return F.regexp_replace(c, r"[\p{P}\p{Z}\sA-Za-zＡ-Ｚａ-ｚ]", "")


def trimmed(c: Column) -> Column:
    """Without outer white space, the ideographic space included."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(trimmed(c)) > 0, c)


def first_given(*cs: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def grams(c: Column, k: int, whole: bool = False) -> Column:
    """Distinct k-grams in order; a text shorter than k has none, or with whole itself."""
    short = F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>")) if whole else F.array().cast("array<string>")
    many = F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))
    return F.when(F.length(c) >= k, F.array_distinct(many)).when(c.isNotNull(), short)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def drop_pairs(c: Column, pairs: Sequence[tuple[str, str]], depth: int = 3) -> Column:
    """Without the bracketed parts, nested ones up to depth."""
    for _ in range(depth):
        for a, b in pairs:
            c = F.regexp_replace(c, f"\\{a}[^\\{a}\\{b}]*\\{b}", "")
    return c


def strip_tags(c: Column) -> Column:
    """Markup out, space between tags squeezed."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"[ \t\r\n]+", " "))


def cap_newlines(c: Column, most: int = 2) -> Column:
    return F.regexp_replace(c, "\n{%d,}" % (most + 1), "\n" * most)


def numeral(c: Column) -> Column:
    """Value of a Han numeral below 10 000; null where another character stands in it.

    A fold over the characters: digits wait for a unit, a unit without a digit counts once.
    """
    digits = "〇零一二三四五六七八九"
    value = {d: max(i - 1, 0) for i, d in enumerate(digits)} | {"兩": 2, "两": 2, "廿": 20, "卅": 30}
    units = {"十": 10, "百": 100, "千": 1000}
    digit = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("open"), F.lit(False).alias("waiting"))

    def step(s: Column, ch: Column) -> Column:
        u, d = F.try_element_at(unit, ch), F.try_element_at(digit, ch)
        return F.when(
            u.isNotNull(),
            F.struct((s["total"] + F.when(s["waiting"], s["open"]).otherwise(1) * u).alias("total"), F.lit(0).alias("open"), F.lit(False).alias("waiting")),
        ).otherwise(F.struct((s["total"] + F.when(d >= 20, d).otherwise(0)).alias("total"), F.when(d >= 20, 0).otherwise(F.coalesce(d, F.lit(0))).alias("open"), (d < 20).alias("waiting")))

    chars = F.split(c, "")
    folded = F.aggregate(chars, start, step, lambda s: s["total"] + s["open"])
    return F.when(c.rlike("^[" + "".join([*value, *units]) + "]+$"), folded)


def year_span(c: Column) -> Column:
    """(first, last) of years written "a-b", with either dash; signs and doubt marks allowed; nulls where it reads otherwise."""
    p = r"^\s*(-?\d{1,4})\??\s*[-–—]\s*(-?\d{1,4})\??\s*$"
    a, b = F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)
    return F.struct(F.when(a != "", a.cast("int")).alias("first"), F.when(b != "", b.cast("int")).alias("last"))


def extent(c: Column) -> Column:
    """The first number in a statement of extent, else the statement."""
    n = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(n != "", n).otherwise(c)


def padded_id(c: Column, prefix: str, width: int = 4) -> Column:
    """prefix and the number in c padded to width; "12", "12.0" and "DZ0012" agree; empty where there is no number."""
    n = F.regexp_extract(c, r"^\D*(\d+)(?:\.0+)?$", 1)
    return F.when(n != "", F.concat(F.lit(prefix), F.lpad(n.cast("int").cast("string"), width, "0"))).otherwise("")


def paren_depth(c: Column, opened: str = "（(", closed: str = "）)") -> Column:
    """Depth of brackets behind each character; a closing mark never takes it below 0."""
    def step(s: Column, ch: Column) -> Column:
        last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))
        change = F.when(F.instr(F.lit(opened), ch) > 0, 1).when(F.instr(F.lit(closed), ch) > 0, -1).otherwise(0)
        return F.concat(s, F.array(F.greatest(F.lit(0), last + change)))

    return F.aggregate(F.split(c, ""), F.array().cast("array<int>"), step)


def sentences_plain(c: Column, marks: str = "。！？", closers: str = "」』）”’") -> Column:
    """Pieces that end in a mark and up to two closers; one pattern, no look-behind."""
    cut = F.regexp_replace(c, f"([{marks}][{closers}]{{0,2}})", "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), trimmed), lambda x: F.length(x) > 0)


def person_core(c: Column) -> Column:
    """A name without an appended "and others", a role in brackets or a dynasty before it."""
    c = F.regexp_replace(trimmed(c), r"[\s\x{3000}]*等$", "")
    c = F.regexp_replace(c, r"[（(][^（）()]*[)）]$", "")
    return trimmed(F.regexp_replace(trimmed(c), r"^[（(〔\[][^（）()〔〕\[\]]{1,3}[)）〕\]]", ""))


def label_in(c: Column, table: Mapping[str, str]) -> Column:
    """The table's label, else the text itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)
