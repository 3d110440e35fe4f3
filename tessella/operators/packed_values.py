"""Several values packed in one field: a parsing expression grammar for people's lists.

The grammar is a set of ordered alternatives; the first that consumes the whole
field wins, and a failed alternative (an unclosed quote, say) backtracks to the next:

    field   <- json / quoted / numbered / dated / split
    json    <- '[' string (',' string)* ']'
    quoted  <- dquoted (sep dquoted)*
    numbered<- (number item)+
    dated   <- (bracket name bracket?)+            no separator needed between items
    split   <- slot (sep slot)*                    sep chosen by an ordered scan
    slot    <- (enclosed / bracketed / plain)*
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bracket and quote pairs, and the wordings that name nobody.
BRACKETS = {"（": "）", "(": ")", "［": "］", "[": "]", "〔": "〕", "【": "】"}
QUOTES = {"「": "」", "『": "』", "“": "”", '"': '"', "‘": "’", "〈": "〉", "《": "》", "＂": "＂"}
NOBODY = {
    "佚名", "佚名氏", "無名氏", "无名氏", "不詳", "不详", "未詳", "未详", "闕名", "阙名", "缺名", "失名", "失考",
    "撰人不詳", "撰人未詳", "作者不詳", "作者不详", "不著撰人", "不著撰者", "無撰人", "亡名氏", "著者不詳", "不明", "未知",
    "作者未詳", "作者佚名", "撰者不詳", "撰者未詳", "不題撰人", "闕", "無", "等", "等人", "等撰", "諸人", "其他", "他", "ほか",
    "anonymous", "anon", "anon.", "unknown", "unknown author", "author unknown", "n/a", "none", "n.n.", "[n.n.]", "s.n.",
    "[s.n.]", "various", "various authors", "et al", "et al.", "et alii", "and others", "others", "u.a.", "u. a.", "etc.", "-", "?", "？",
}

_HAN = r"[㐀-鿿豈-﫿\U00020000-\U000323af]"
_OUTER = " \t\n\r\v\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_NUMBER = re.compile(r"[\s　]*(?:[（(]\s*\d{1,3}\s*[)）]|\d{1,3}\s*[)）．、]|\d{1,3}\.(?!\d)|[①-⑳])[\s　]*")
_NUMBER_HEAD = re.compile(r"[\s　]*(?:[（(]\s*1\s*[)）]|1\s*[)）．、]|1\.(?!\d)|①)")
_BREAK = re.compile(r"<br\s*/?>|\r\n?|[\n\t\v\f\u2028\u2029]", re.I)
_HARD = re.compile(r"[、；;|｜/／+＋\n]")
_TAIL = re.compile(rf"(?:[\s　]+(?:等|等人|他|ほか|et\s+al\.?|and\s+others|u\.\s?a\.)|(?<={_HAN})等人?|(?<=[）)])等人?|,?\s+et\s+al\.?|,?\s+and\s+others)[\s　]*$", re.I)
_AND = re.compile(r"\s*,?\s+(?:and|&|und|et|y)\s+|\s*＆\s*", re.I)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_HAN_ANY = re.compile(_HAN)
_LAST = re.compile(r"^(?:(?:de|van|von|der|la|le|di|da|al|el|du|ten|ter)[\s-])*[^\s,]+$", re.I)
_FIRSTS = re.compile(r"^(?:[A-ZÀ-Þ]\.[\s-]?|[A-ZÀ-Þ][\w'’-]*\s?)+(?:\s?(?:Jr|Sr)\.?)?$")


def _strip(s: str) -> str:
    return s.strip(_OUTER)


def _closer(s: str, i: int, close: str) -> int:
    """Index of the mark that closes the one at i, or -1; an inner pair of the same kind nests, a doubled quote is skipped."""
    opened, depth, k = s[i], 1, i + 1
    while k < len(s):
        if s[k] == close:
            if opened == close and k + 1 < len(s) and s[k + 1] == close:
                k += 2
                continue
            depth -= 1
            if not depth:
                return k
        elif s[k] == opened:
            depth += 1
        k += 1
    return -1


def _atoms(s: str) -> tuple[list[tuple[int, int, bool]], bool]:
    """slot <- (enclosed / bracketed / plain)*: spans with a flag whether separators count there; and whether a mark was left open."""
    out, start, i, bad = [], 0, 0, False
    pairs = BRACKETS | QUOTES
    while i < len(s):
        close = pairs.get(s[i])
        if close and not (s[i] in "‘" and i and s[i - 1].isalpha()):
            k = _closer(s, i, close)
            if k >= 0:
                if i > start:
                    out.append((start, i, True))
                out.append((i, k + 1, False))
                start = i = k + 1
                continue
            bad = True  # backtrack: the open mark is a plain character
        i += 1
    if start < len(s):
        out.append((start, len(s), True))
    return out, bad


def _cut(s: str, sep: re.Pattern[str], atoms: list[tuple[int, int, bool]]) -> list[str]:
    """Split at separators outside enclosed and bracketed atoms."""
    parts, last = [], 0
    for a, b, plain in atoms:
        if plain:
            for m in sep.finditer(s, a, b):
                parts.append(s[last : m.start()])
                last = m.end()
    return [*parts, s[last:]]


def _json(s: str) -> list[str] | None:
    if not (s.startswith("[") and s.endswith("]")):
        return None
    try:
        got = json.loads(s)
    except ValueError:
        return None
    return ["" if x is None else str(x) for x in got] if isinstance(got, list) and not any(isinstance(x, (list, dict)) for x in got) else None


_DQ = re.compile(r'\s*"((?:[^"]|"")*)"\s*')
_DSEP = re.compile(r"[,;，；、|\n\t]\s*|\s*$")


def _quoted(s: str) -> list[str] | None:
    """quoted <- dquoted (sep dquoted)*; fails on anything outside the quotes, so a malformed quote backtracks to split."""
    out, i = [], 0
    while i < len(s):
        m = _DQ.match(s, i)
        if m:
            out.append(m[1].replace('""', '"'))
            i = m.end()
        elif s[i] in ",;，；、|" and (not out or s[i - 1] in " ,;，；、|"):
            i += 1  # an empty slot
            continue
        else:
            return None
        if i < len(s):
            m = _DSEP.match(s, i)
            if not m:
                return None
            i = max(m.end(), i + 1)
    return out or None


def _numbered(s: str) -> list[str] | None:
    """numbered <- (number item)+; the numbers must run 1, 2, 3, so a date or a volume isn't taken for one."""
    if not _NUMBER_HEAD.match(s):
        return None
    out, last, want, i = [], None, 1, 0
    for m in _NUMBER.finditer(s):
        digits = re.sub(r"\D", "", m[0])
        n = int(digits) if digits else ord(_strip(m[0])[0]) - 0x245F
        if n != want or (m.start() and not (m[0][0].isspace() or s[m.start() - 1] in " 　\t\n;；,，、）)>" or m[0][0] in "(（①②③④⑤⑥⑦⑧⑨⑩")):
            continue
        if last is not None:
            out.append(s[last : m.start()])
        last, want = m.end(), want + 1
    if last is None:
        return None
    out.append(s[last:])
    return [re.sub(r"[\s;；,，、|]+$", "", x) for x in out]


def _dated(s: str) -> list[str] | None:
    """dated <- (bracket name bracket?)+: a bracket behind a name opens the next item unless a separator or the end follows it."""
    if not s or s[0] not in BRACKETS:
        return None
    atoms, bad = _atoms(s)
    if bad or _HARD.search("".join(s[a:b] for a, b, plain in atoms if plain)):
        return None
    out, start = [], 0
    for n, (a, b, plain) in enumerate(atoms):
        if not plain and n and a > start and s[a] in BRACKETS:
            named = any(p and _strip(s[x:y]) for x, y, p in atoms[:n] if x >= start)
            follows = n + 1 < len(atoms) and atoms[n + 1][2] and _strip(s[atoms[n + 1][0] : atoms[n + 1][1]])
            if named and follows:
                out.append(s[start:a])
                start = a
    return [*out, s[start:]] if out else None


def _inverted(parts: list[str]) -> bool:
    """Whether comma parts read "Surname, Given": pairs of one word and of given names or initials."""
    return len(parts) == 2 and bool(_LAST.match(parts[0])) and bool(_FIRSTS.match(parts[1])) and len(parts[0]) > 2


def _commas(s: str) -> list[str]:
    """Split at commas unless they stand inside "Surname, Given"."""
    atoms, _ = _atoms(s)
    parts = [_strip(p) for p in _cut(s, re.compile(r"[,，]"), atoms)]
    if len(parts) < 2:
        return parts
    if not _LATIN.search(s):
        return parts
    if _inverted(parts):
        return [s]
    if len(parts) % 2 == 0 and all(_LAST.match(p) and len(p) > 2 and not _HAN_ANY.search(p) for p in parts[::2]) and all(_FIRSTS.match(p) for p in parts[1::2]) and any("." in p for p in parts[1::2]):
        return [f"{a}, {b}" for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return parts


def _spaces(s: str) -> list[str]:
    """Runs of space between Han names of two characters or more separate them."""
    atoms, _ = _atoms(s)
    parts = [p for p in _cut(s, re.compile(r"[ 　]+"), atoms) if p]
    if len(parts) > 1 and all(len(_HAN_ANY.findall(re.sub(r"[（(].*?[)）]", "", p))) >= 2 or p in ("等", "等人") for p in parts) and not _LATIN.search(s):
        return parts
    return [s]


def _split(s: str) -> tuple[list[str], bool]:
    s = _BREAK.sub("\n", s)
    atoms, bad = _atoms(s)
    slots = []
    for hard in _cut(s, _HARD, atoms):
        dated = _dated(_strip(hard))
        for x in dated or [hard]:
            for y in _cut(x, _AND, _atoms(x)[0]) if _LATIN.search(x) or "＆" in x else [x]:
                for z in _commas(_strip(y)):
                    slots.extend(_spaces(z))
    return slots, bad


def _bare(x: str) -> str:
    """Without list numbers, enclosing quotes and outer space."""
    x = _strip(x)
    while len(x) > 1 and QUOTES.get(x[0]) and _closer(x, 0, QUOTES[x[0]]) == len(x) - 1:
        q = x[0]
        x = _strip(x[1:-1].replace(q * 2, q) if QUOTES[q] == q else x[1:-1])
    return x


def parse_field(raw: str | None) -> list[tuple[int, str, str | None]]:
    """(position, value, flag) of each value in the field; flag is 'open_mark' where a quote or bracket was left open."""
    if raw is None:
        return []
    s = _strip(raw)
    if not s:
        return []
    bad = False
    values: list[str] | None = _json(s)
    final = values is not None
    if values is None:
        values = _quoted(s)
        final = values is not None
    if values is None:
        numbered = _numbered(s)
        if numbered is not None:
            values = []
            for x in numbered:
                part, open_mark = _split(x)
                values, bad = values + part, bad or open_mark
    if values is None:
        values, bad = _split(s)
    out: list[tuple[int, str, str | None]] = []
    for x in values:
        x = _strip(x) if final else _bare(_TAIL.sub("", _strip(x)))
        if x and x.casefold() not in NOBODY and _strip(re.sub(r"^[\[［（(]|[\]］)）]$", "", x)).casefold() not in NOBODY:
            out.append((len(out) + 1, x, "open_mark" if bad else None))
    return out


def split_values(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row (key, pos, value, flag) per value of df[field], positions from 1 in order of writing.

    Null or empty fields and fields of empty slots give no row. Repeated input
    rows give repeated output rows; further columns of df are ignored, whatever
    their names. flag is 'open_mark' where a quote or bracket was left open and
    read as a plain character, else null. Texts of any length are parsed whole.
    """

    @F.pandas_udf("array<struct<pos:int,value:string,flag:string>>")
    def parse(batch: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batch:
            yield s.map(lambda x: [{"pos": p, "value": v, "flag": f} for p, v, f in parse_field(x)])

    got = df.select(F.col(key).alias("key"), parse(_text(df[field])).alias("_v"))
    return got.select("key", F.inline("_v"))


def _text(c: Column) -> Column:
    return c.cast("string")
