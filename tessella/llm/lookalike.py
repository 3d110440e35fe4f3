"""Visually identical text with different characters.

Look-alike classes are computed by union-find over strings and code points, each
class gets the member that the corpus uses most as its representative, and texts
are rewritten greedily (leftmost, longest) by one multi-pattern automaton.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alikes in other scripts. Each row: characters, then the ones they look like.
CROSS_SCRIPT = (
    ("АВЕКМНОРСТХЅІЈҮԚԜ", "ABEKMHOPCTXSIJYQW"),  # Cyrillic capitals
    ("аеорсухѕіјһԁԛԝѵ", "aeopcyxsijhdqwv"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("νοϲϳ", "vocj"),  # Greek small letters
    ("ՕՍՏօոսհ", "OUSonuh"),  # Armenian
    ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCEHJKLMPSTVWZ"),  # Cherokee
    ("エカタニハロトー", "工力夕二八口卜一"),  # Katakana and Han
    ("ヘベペ", "へべぺ"),  # Katakana and Hiragana
    ("㇐㇑㇒㇔㇚", "一丨丿丶亅"),  # strokes
    ("゛゜", "゙゚"),  # sound marks standing alone
    ("‐‑⁃﹣－", "-----"),  # kinds of hyphen
)
# Radical codes that Unicode gives no decomposition, and the ideograph each shows.
RADICALS = (
    "⺁⺅⺉⺊⺋⺎⺏⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺝⺞⺠⺡⺢⺣⺤⺦⺨⺭⺯⺰⺱⺲⺾⻁⻂⻃⻄⻅⻈⻉⻋⻌⻐⻑⻓⻔⻗⻙⻚⻛⻜⻢⻥⻦⻩⻪⻬⻮⻰⻲",
    "厂亻刂卜㔾兀尣尢巳幺彑彐忄㣺扌攵旡月歺民氵氺灬爫丬犭礻糹纟罓罒艹虎衤覀西见讠贝车辶钅長长门雨韦页风飞马鱼鸟黄黾齐齿龙龟",
)
# Blocks whose compatibility characters look like what they decompose to.
COMPAT_BLOCKS = ((0x00B5, 0x00B5), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0x3131, 0x318E), (0xFB00, 0xFB4F))
# Invisible characters outside the category of format characters.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
_VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}


class UnionFind:
    """Disjoint sets of strings, with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        self.parent[x] = p
        return p

    def join(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in self.parent:
            by.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in by.values() if len(v) > 1]


def _invisible(cp: int, ch: str) -> bool:
    return cp in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or (unicodedata.category(ch) == "Cf" and cp not in _VISIBLE_FORMAT)


def lookalike_edges() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same; an invisible character looks like the empty string."""
    for row, like in (*CROSS_SCRIPT, RADICALS):
        yield from zip(row, like, strict=True)
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        if _invisible(cp, ch):
            yield ch, ""
            continue
        if cat == "Zs":
            yield ch, " "
            continue
        kind, _, codes = unicodedata.decomposition(ch).rpartition("> ")
        if not codes:
            continue
        to = "".join(chr(int(c, 16)) for c in codes.split())
        if not kind:
            yield ch, to
        elif kind in ("<wide", "<narrow"):
            if to.isalnum() or all(unicodedata.category(c)[0] in "LMN" for c in to):
                yield ch, to
        elif kind == "<noBreak" or kind in ("<initial", "<medial", "<final", "<isolated") or any(a <= cp <= b for a, b in COMPAT_BLOCKS):
            yield ch, to


def rewrite_table(counts: dict[str, int]) -> dict[str, str]:
    """What each string that looks like another is rewritten to.

    counts: how often the corpus uses each character. A class with the empty
    string is deleted. The representative is the single character used most, ties
    to the lowest code point; a class of single characters and one longer string
    (a ligature, say) is spelled out in the representatives of its characters.
    Strings are compared in canonical decomposition, so that split accents, sound
    marks and compatibility ideographs need no entry of their own.
    """
    uf = UnionFind()
    for a, b in lookalike_edges():
        na, nb = unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b)
        if na != nb:
            uf.join(na, nb)
    single: dict[str, str] = {}
    spelled: list[list[str]] = []
    for members in uf.classes():
        if "" in members:
            single.update((m, "") for m in members if m)
        elif any(len(m) > 1 for m in members):
            spelled.append(members)
        else:
            best = min(members, key=lambda m: (-counts.get(m, 0), m))
            single.update((m, best) for m in members if m != best)
    out = dict(single)
    for members in spelled:
        long = min((m for m in members if len(m) > 1), key=lambda m: (len(m), m))
        to = "".join(single.get(c, c) for c in long)
        out.update((m, to) for m in members if m != to and len(m) == 1)
    return out


class Rewriter:
    """Rewrites texts with one automaton over all patterns of the table."""

    def __init__(self, table: dict[str, str]) -> None:
        self.auto = ahocorasick.Automaton()
        for k, v in table.items():
            self.auto.add_word(k, (len(k), v))
        self.any = bool(table)
        self.ascii_stays = not any(k.isascii() for k in table)
        if self.any:
            self.auto.make_automaton()

    def __call__(self, text: str) -> str:
        if not self.any or (self.ascii_stays and text.isascii()):
            return text
        text = unicodedata.normalize("NFD", text)
        out, last = [], 0
        for end, (n, to) in self.auto.iter_long(text):
            start = end - n + 1
            if start > last:
                out.append(text[last:start])
            out.append(to)
            last = end + 1
        if last:
            out.append(text[last:])
            text = "".join(out)
        return unicodedata.normalize("NFC", text)


_REF = re.compile(r"&#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));|&(lt|gt|amp|quot|apos);")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _reference(m: re.Match[str]) -> str:
    if m[3]:
        ch = _NAMED[m[3]]
    else:
        cp = int(m[1], 16) if m[1] else int(m[2])
        if cp > sys.maxunicode or 0xD800 <= cp < 0xE000 or cp == 0:
            return m[0]
        ch = chr(cp)
    return {"<": "&lt;", "&": "&amp;"}.get(ch, ch)  # these two stay marked, so that text isn't taken for markup


def resolve_references(xml: str) -> str:
    """Character references as the characters they stand for."""
    return _REF.sub(_reference, xml) if "&" in xml else xml


def character_counts(texts: Iterable[DataFrame]) -> dict[str, int]:
    """How often each character occurs in the given one-column frames, over all rows; at most one entry per Unicode code point reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, dtype=np.int64)
        for b in batches:
            joined = "".join(x for x in b.iloc[:, 0] if x)
            if joined:
                points = np.frombuffer(unicodedata.normalize("NFD", joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                got = np.bincount(points)
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cp": at.astype(np.int64), "n": total[at]})

    frames = [t.toDF("t").mapInPandas(count, "cp long, n long") for t in texts]
    if not frames:
        return {}
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return {chr(r.cp): r.n for r in every.groupBy("cp").agg(F.sum("n").alias("n")).collect()}


def canonical(text: Column, table: dict[str, str], references: bool = False) -> Column:
    """The consistent form of a text column; null stays null, the empty text stays empty, texts are rewritten whole."""

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rw = Rewriter(table)
        for s in batches:
            yield s.map(lambda x: None if x is None else rw(resolve_references(x) if references else x))

    return rewrite(text)


def _digests(text: Column, table: dict[str, str], references: bool) -> Column:
    @F.pandas_udf("struct<form:binary,raw:binary>")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rw = Rewriter(table)

        def md5(x: str) -> bytes:
            return hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()

        for s in batches:
            raw = [resolve_references(x) if references else x for x in s]
            yield pd.DataFrame({"form": [md5(rw(x)) for x in raw], "raw": [md5(x) for x in s]})

    return digest(text)


def classes(df: DataFrame, key: str, text: str, table: dict[str, str], references: bool = False) -> DataFrame:
    """One row (row, form, raw) per key and text: digests of the consistent form and of the text as it stands.

    Rows with equal form look the same. Null and empty texts give no row, repeated
    rows one, and further columns are ignored whatever their names.
    """
    t = df.select(df[key].alias("row"), df[text].alias("t")).where(F.length("t") > 0)
    return t.select("row", _digests(F.col("t"), table, references).alias("d")).select("row", "d.form", "d.raw").distinct()


def pairs(forms: DataFrame, salt_rows: int = 2000) -> DataFrame:
    """Rows (row_a, row_b), row_a < row_b, that look the same but are not the same characters.

    forms: from classes(). Classes whose texts are all equal are left out before
    the join; a class of more than salt_rows rows is joined in blocks of that size.
    """
    groups = forms.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("form", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    rows = forms.join(groups, "form")
    a = rows.select("form", F.col("row").alias("row_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"))
    b = rows.select("form", F.col("row").alias("row_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b, ["form", "salt"]).where("row_a < row_b and raw_a <> raw_b").select("row_a", "row_b").distinct()
