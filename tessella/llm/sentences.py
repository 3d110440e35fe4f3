"""Sentence boundaries across languages and scripts.

Scripts with terminators of their own are cut by rules per script. In scripts
that write abbreviations and sentence ends with the same full stop, a stop is
judged by what the document shows elsewhere: a token that unambiguous places
(before a small letter or a comma, or at the end of a paragraph) show to be an
abbreviation or a common word, and a capitalised word seen inside sentences. The
corpus answers where the document has no such place, a short list where neither has.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.lookalike import Rewriter, rewrite_table
from tessella.session import stage

# Terminators, marks and pairs.
STRONG = "。！？｡!?‼⁇⁈⁉؟۔։።၊။។᠃᠉꓿︒﹖﹗"
STOPS = ".．"
PAIRS = {"「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", "（": "）", "(": ")", "[": "]", "［": "］", "〈": "〉", "《": "》", "〔": "〕", "【": "】", "｢": "｣", "‹": "›", "﹁": "﹂", "﹃": "﹄"}
QUOTE_MARKS = "「『“„«｢‹\"﹁﹃"
CLOSERS = "」』”“»）)]］〉》〕】｣›\"﹂﹄’"
# Abbreviations for texts too small to show them; the second row may be a sentence's last word.
ABBREVIATIONS = frozenset("Dr Mr Mrs Ms Prof St Rev Hon Fr Sr Mme Mlle MM Nr No Bd S vol vols p pp fol fols ff chap ch t éd ed eds cf Vgl vgl z d h e.g i.e ca c approx resp bzw ggf n fig figs Abb Hrsg Jh ex art sect vs viz a.k.a".split())
LAST_WORDS = frozenset("etc usw al Co Inc Ltd Jr U.S U.K a.m p.m B.C A.D u.a".split())
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jh Jahrtausend Auflage Band Kapitel Buch Jänner leden".split())

_FORMAT = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cf") + "".join(map(chr, (*range(0xFE00, 0xFE10), 0x034F))) + "".join(map(chr, range(0xE0100, 0xE01F0)))
_GAP = re.escape(_FORMAT) + r"\s¶"
_GAPS = re.compile(f"[{_GAP}]*")
_GAP_BEFORE = re.compile(f"[{_GAP}]+$")
_GAP_SET = frozenset(_FORMAT + "¶")
HAN = re.compile("[㐀-䶿一-鿿豈-﫿⼀-⿟〇\U00020000-\U000323af]")
_CJK = re.compile("[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿⼀-⿟ｦ-ﾝ\U00020000-\U000323af]")
_EVENT = re.compile("[" + re.escape(STRONG + STOPS + "".join(PAIRS) + "".join(PAIRS.values()) + '"') + "།༎༑॥।" + "]")
_DIGIT = "0-9०-९²³¹⁰⁴-⁹０-９"
_DANDA = re.compile(f"[।॥](?:[{_GAP}]*[{_DIGIT}](?:[{re.escape(_FORMAT)}]*[{_DIGIT}])*[{_GAP}]*[।॥]|(?<=॥)[{_GAP}]*[०-९]+(?![\\w]))?")
_TOKEN_BEFORE = re.compile(r"[^\s\"“„«»(（\[「『/—–]+$")
_WORD = re.compile(r"[^\W\d_](?:[\w'’\-\u0300-\u036f" + re.escape(_FORMAT) + r"]*[\w\u0300-\u036f])?(?:\.[^\W\d_]+)*")
_PUNCTUATED = re.compile("[" + re.escape("。，、；：！？「」『』（）…．｡､·,.;:!?()“”\"‘’《》〈〉") + "]")

_fold = Rewriter(rewrite_table({chr(c): 1 << 20 for c in range(0x20, 0x7F)}))


def fold(token: str) -> str:
    """A token without look-alikes and invisible characters, so that every writing of it counts as one."""
    return token if token.isascii() else _fold(token)


def _gap(ch: str) -> bool:
    return ch.isspace() or ch in _GAP_SET


def _spans(text: str, events: list[re.Match[str]]) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets; a mark without its partner opens nothing."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in events:
        ch, i = m[0], m.start()
        if ch == '"':
            k = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == '"'), None)
            before = text[i - 1] if i else " "
            if k is not None and not (before.isspace() and i + 1 < len(text) and text[i + 1].isalnum()):
                found.append((stack[k][1], i))
                del stack[k:]
            elif k is None:
                stack.append((ch, i))
            continue
        k = next((n for n in range(len(stack) - 1, -1, -1) if ch in PAIRS.get(stack[n][0], "")), None)
        if k is not None and (ch != "“" or stack[k][0] == "„"):
            found.append((stack[k][1], i))
            del stack[k:]
        elif ch in PAIRS:
            stack.append((ch, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


Verdict = Callable[[str], tuple[list[int], list[int]] | None]
FIELDS = ("small", "comma", "last", "capital", "digit", "bare", "inside")


def _counts(token: str, verdict: Verdict) -> list[int] | None:
    """The document's counts if they decide anything, else the corpus's, else None."""
    got = verdict(token)
    if got is None:
        return None
    doc, corpus = got
    if doc and doc[0] + doc[1] + doc[2] + doc[5] >= 2:
        return doc
    return corpus or doc or None


def _abbreviation(token: str, verdict: Verdict) -> bool:
    if re.fullmatch(r"[^\W\d_]", token) and token.isupper():
        return True  # an initial
    if _never_last(token, verdict):
        return True
    c = _counts(token, verdict)
    if c is not None:
        small, comma, last, capital, digit, bare, _ = c
        marked, ended = small + comma, capital + digit + last
        if marked and marked >= 0.3 * (marked + bare) and marked >= 0.25 * (marked + last):
            return True
        if last + bare + ended > 2:
            return token in LAST_WORDS and marked + bare == 0
    return token in ABBREVIATIONS or token in LAST_WORDS or "." in token


def _never_last(token: str, verdict: Verdict) -> bool:
    """Whether the corpus shows the token with its stop before names or numbers only, and never at an end."""
    got = verdict(token)
    c = got[1] or got[0] if got else None
    if not c or c[2] or len(token) > 5:
        return False
    after = c[3] + c[4]
    return after >= 8 and (not c[5] or c[4] >= 0.9 * after)


def _proper(word: str, verdict: Verdict) -> bool:
    """Whether a capitalised word is a name: seen capitalised inside sentences and hardly in small letters."""
    c, low = _counts(word, verdict), _counts(word[:1].lower() + word[1:], verdict)
    return bool(c and c[6] and c[6] >= (low[5] if low else 0))


def _stop_ends(text: str, i: int, after: int, verdict: Verdict) -> bool:
    """Whether the full stop at i ends a sentence; after is where the text goes on behind it and its closing marks."""
    before = _GAP_BEFORE.sub("", text[max(0, i - 60) : i])
    if not before:
        return False
    prev = before[-1]
    following = text[after : after + 1]
    spaced = any(text[k].isspace() for k in range(i + 1, after))
    if _CJK.match(prev) or (prev in CLOSERS and _CJK.search(before[-12:])):
        return not (following.isdigit() and not spaced and prev.isdigit())
    if not following:
        return True
    if not spaced:
        return bool(_CJK.match(following)) or following in "“„«「"
    m = _TOKEN_BEFORE.search(before)
    token = fold(m[0]).lstrip("'’‘*") if m else ""
    if not token:
        return True
    if token.isdigit():
        word = _WORD.match(text, after)
        if len(token) <= 2 and word and fold(word[0]) in MONTHS:
            return False
        return not following.islower()
    if not any(c.isalpha() and (c.islower() or c.isupper()) for c in token):
        return True  # a script without case
    small = following.islower()
    if not _abbreviation(token, verdict):
        if not small:
            return True
        c = _counts(token, verdict)
        return bool(c and c[2] + c[3] >= 3 and c[5] and c[0] < 0.3 * (c[0] + c[2] + c[3]))
    if small:
        return False
    if re.fullmatch(r"[^\W\d_]", token):
        return False
    c = _counts(token, verdict)
    ends = (c is not None and c[2] > 0) or token in LAST_WORDS
    if following.isdigit():
        return ends
    if ends:
        return True
    if c is None or token in ABBREVIATIONS or c[3] + c[4] >= 0.3 * (c[0] + c[1] + c[3] + c[4]):
        return False  # stands before names or numbers
    word = _WORD.match(text, after)
    return not (word and _proper(fold(word[0]), verdict))


def _completes(text: str, a: int, b: int, start: int, after: int) -> bool:
    """Whether the quotation or bracket from a to b ends the sentence that began at start."""
    inner = _GAP_BEFORE.sub("", text[max(a + 1, b - 40) : b])
    while inner and inner[-1] in CLOSERS:
        inner = _GAP_BEFORE.sub("", inner[:-1])
    if not inner or not (inner[-1] in STRONG or inner[-1] in STOPS or inner[-1] in "།॥।") or inner.endswith(("...", "..")):
        return False
    following = text[after : after + 1]
    if not following:
        return True
    if following in "，、；：,;:）」』)》…—–-" or following.islower():
        return False
    lead = _GAP_BEFORE.sub("", text[max(0, a - 20) : a])
    if text[a] not in QUOTE_MARKS:
        return a == start
    introduced = lead[-1:] in (":", "：") or lead[-1:] in ("曰", "云")
    spaced = any(text[k].isspace() for k in range(b + 1, after))
    if _CJK.match(following) or "가" <= following <= "힣" or "ᄀ" <= following <= "ᇿ":
        if not introduced:
            return False
        return spaced or not ("぀" <= following <= "ゟ" or "가" <= following <= "힣" or "ᄀ" <= following <= "ᇿ")
    return True


def segment(text: str, verdict: Verdict = lambda _: None) -> list[tuple[int, int]]:
    """Start and end of each sentence unit, in code points, without the white space and invisible characters around it."""
    events = list(_EVENT.finditer(text))
    spans = _spans(text, events)
    opens = [a for a, _ in spans]
    cuts: list[int] = []
    start = _GAPS.match(text).end()  # type: ignore[union-attr]
    done = 0

    def cut(end: int) -> None:
        nonlocal start, done
        cuts.append(end)
        start, done = _GAPS.match(text, end).end(), end  # type: ignore[union-attr]

    for m in events:
        i, ch = m.start(), m[0]
        if i < done:
            continue
        at = bisect.bisect_right(opens, i) - 1
        if at >= 0 and i <= spans[at][1]:
            a, b = spans[at]
            if i == b and a != b:
                after = _GAPS.match(text, b + 1).end()  # type: ignore[union-attr]
                if _completes(text, a, b, start, after):
                    cut(b + 1)
            continue
        if ch in "।॥":
            d = _DANDA.match(text, i)
            cut(d.end() if d else i + 1)
            continue
        if ch in "།༎༑":
            nxt = i + 1
            while nxt < len(text) and _gap(text[nxt]):
                nxt += 1
            if ch == "༎":
                cut(i + 1)
            elif ch == "།" and text[nxt : nxt + 1] == "།":
                cut(nxt + 1)
            continue
        if ch not in STRONG and ch not in STOPS:
            continue
        end = i + 1
        while end < len(text) and (text[end] in STRONG or (text[end] in _GAP_SET and end + 1 < len(text) and text[end + 1] in STRONG)):
            end += 1
        if ch in STOPS and end == i + 1:
            if (i and text[i - 1] in ".．…") or text[i + 1 : i + 2] in (".", "．", "…"):
                continue  # an ellipsis
            if i and text[i - 1].isdigit() and text[i + 1 : i + 2].isdigit():
                continue
            after = _GAPS.match(text, end).end()  # type: ignore[union-attr]
            if not _stop_ends(text, i, after, verdict):
                continue
        elif ch in "!?" and end < len(text) and not _gap(text[end]) and not _CJK.match(text[end]) and text[end] not in CLOSERS and text[end] not in PAIRS:
            continue
        while end < len(text) and text[end] in CLOSERS and text[end] not in PAIRS and text[end] != '"':
            end += 1
        cut(end)

    units: list[tuple[int, int]] = []
    last = 0
    for end in [*cuts, len(text)]:
        a, b = _GAPS.match(text, last).end(), end  # type: ignore[union-attr]
        while b > a and _gap(text[b - 1]):
            b -= 1
        if b > a:
            if units and not any(c.isalnum() for c in text[a:b]):
                units[-1] = (units[-1][0], b)
            else:
                units.append((a, b))
        last = max(last, end)
    return units


def whole(text: str) -> list[tuple[int, int]]:
    """The text as one unit; none if it is empty or blank."""
    a = _GAPS.match(text).end()  # type: ignore[union-attr]
    b = len(text)
    while b > a and _gap(text[b - 1]):
        b -= 1
    return [(a, b)] if b > a else []


def evidence(text: str) -> Iterator[tuple[str, int]]:
    """(token, index in FIELDS) for every word of a cased script, by what follows it."""
    if "." not in text and not any("A" <= c <= "ɏ" for c in text):
        return
    before = ""
    for m in _WORD.finditer(text):
        word = m[0]
        if not (word[0].islower() or word[0].isupper()):
            before = ""
            continue
        token, e = fold(word), m.end()
        k = _GAPS.match(text, e).end() if text[e : e + 1] in _GAP_SET else e  # type: ignore[union-attr]
        if text[k : k + 1] == "." and text[k + 1 : k + 2] != ".":
            a = _GAPS.match(text, k + 1).end()  # type: ignore[union-attr]
            nxt = text[a : a + 1]
            if not nxt:
                yield token, 2
            elif nxt in ",;:)":
                yield token, 1
            elif a > k + 1:
                if nxt.islower():
                    yield token, 0
                elif nxt.isdigit():
                    yield token, 4
                else:
                    yield token, 3
            before = ""
            continue
        yield token, 5
        if word[0].isupper() and before and before[0].islower():
            yield token, 6
        before = token if text[e : e + 1].isspace() else ""


def wanted(text: str) -> list[str]:
    """Tokens whose evidence the stops of the text may need."""
    out: set[str] = set()
    if "." not in text:
        return []
    for m in re.finditer(r"\.(?=[\s" + re.escape(_FORMAT) + r"])", text):
        i = m.start()
        t = _TOKEN_BEFORE.search(_GAP_BEFORE.sub("", text[max(0, i - 60) : i]))
        if not t:
            continue
        token = fold(t[0]).lstrip("'’‘*")
        if token and any(c.islower() or c.isupper() for c in token):
            out.add(token)
            a = _GAPS.match(text, i + 1).end()  # type: ignore[union-attr]
            w = _WORD.match(text, a)
            if w and w[0][0].isupper():
                word = fold(w[0])
                out.update((word, word[:1].lower() + word[1:]))
    return sorted(out)


def _han_key(text: str) -> str:
    return "".join(HAN.findall(text))


def _evidence_table(paras: DataFrame) -> DataFrame:
    """(doc, token, f array<long>) of every token of a document, f by FIELDS."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter[tuple[str, str, int]] = Counter()
            for doc, text in zip(b["doc"], b["text"], strict=True):
                total.update((doc, token, f) for token, f in evidence(text))
            rows = [(*k, n) for k, n in total.items()]
            yield pd.DataFrame(rows, columns=["doc", "token", "f", "n"])

    long = paras.select("doc", "text").where(F.col("text").rlike("[A-Za-zÀ-ɏͰ-ӿ]")).mapInPandas(count, "doc string, token string, f int, n long")
    return long.groupBy("doc", "token").agg(*[F.sum(F.when(F.col("f") == i, F.col("n")).otherwise(0)).alias(f"f{i}") for i in range(len(FIELDS))]).select("doc", "token", F.array(*[f"f{i}" for i in range(len(FIELDS))]).alias("f"))


def _verdicts(paras: DataFrame) -> DataFrame:
    """(row, seen) with what document and corpus show of each token that a paragraph's stops need."""

    @F.pandas_udf("array<string>")
    def needs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(wanted)

    docs = stage(_evidence_table(paras), "p1-evidence")
    corpus = docs.groupBy("token").agg(*[F.sum(F.col("f")[i]).alias(f"f{i}") for i in range(len(FIELDS))]).select("token", F.array(*[f"f{i}" for i in range(len(FIELDS))]).alias("c"))
    ask = paras.where(F.col("text").rlike("[A-Za-zÀ-ɏͰ-ӿ]") & F.col("text").contains(".")).select("row", "doc", F.explode(needs("text")).alias("token"))
    pairs = ask.select("doc", "token").distinct().join(docs, ["doc", "token"], "left").join(corpus, "token", "left")
    return ask.join(pairs, ["doc", "token"]).groupBy("row").agg(F.collect_list(F.struct("token", "f", "c")).alias("seen"))


def _cut(text: Column, heading: Column, seen: Column) -> Column:
    @F.pandas_udf("struct<units:array<struct<a:int,b:int>>,bare:boolean,han:binary,cuts:array<struct<a:int,b:int>>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, headings, seens in batches:
            out = []
            for text, heading, seen in zip(texts, headings, seens, strict=True):
                known = {x["token"]: (_ints(x["f"]), _ints(x["c"])) for x in seen} if seen is not None else {}
                units = whole(text) if heading else segment(text, known.get)
                key = _han_key(text)
                bare = bool(key) and not _PUNCTUATED.search(text)
                cuts = None
                if key:
                    places = [m.start() for m in HAN.finditer(text)]
                    cuts = [{"a": bisect.bisect_left(places, a), "b": bisect.bisect_left(places, b)} for a, b in units]
                    cuts = [c for c in cuts if c["b"] > c["a"]]
                out.append(([{"a": a, "b": b} for a, b in units], bare, hashlib.md5(key.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() if key else None, cuts))
            yield pd.DataFrame(out, columns=["units", "bare", "han", "cuts"])

    return run(text, heading, seen)


def _ints(x: object) -> list[int]:
    return [] if x is None else [int(v) for v in x]  # type: ignore[attr-defined]


def _placed(text: Column, cuts: Column) -> Column:
    """The cuts, counted in Han characters, as places in a text of the same Han characters."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, every in batches:
            out = []
            for text, cuts in zip(texts, every, strict=True):
                places = [m.start() for m in HAN.finditer(text)]
                out.append([{"a": places[c["a"]], "b": places[c["b"] - 1] + 1} for c in cuts])
            yield pd.Series(out)

    return run(text, cuts)


def sentences(source: DataFrame, reference: DataFrame) -> DataFrame:
    """(row, sent_start, sent_end) of every sentence unit.

    source and reference: (row, doc, text, heading). A row with a heading is one
    unit. A reference text of Han characters without punctuation gets the units of
    the source text with the same Han characters (of several, a punctuated one
    with the least row), else is one unit. Null, empty and blank texts have no
    unit; a row delivered again counts once; further columns are ignored.
    """
    cols = ["row", "doc", "text", "heading"]
    both = source.select(*cols, F.lit(False).alias("ref")).unionByName(reference.select(*cols, F.lit(True).alias("ref")))
    paras = stage(both.where("row is not null and length(text) > 0").withColumn("doc", F.coalesce("doc", F.lit(""))).dropDuplicates(["row"]), "p1-paragraphs")
    asked = paras.join(_verdicts(paras), "row", "left")
    done = stage(asked.select("row", "ref", "text", _cut(F.col("text"), F.coalesce(F.length("heading") > 0, F.lit(False)), F.col("seen")).alias("r")).select("row", "ref", F.when(F.col("r.bare") & F.col("ref"), F.col("text")).alias("text"), "r.units", "r.bare", "r.han", F.when(~F.col("ref"), F.col("r.cuts")).alias("cuts")), "p1-units")
    bare = done.where("ref and bare")
    given = done.where("not ref and han is not null").groupBy("han").agg(F.min_by("cuts", F.struct("bare", "row")).alias("cuts"))
    moved = bare.select("row", "text", "han", "units").join(given, "han", "left")
    moved = moved.select("row", F.when(F.col("cuts").isNull(), F.col("units")).otherwise(_placed(F.col("text"), F.coalesce("cuts", F.array().cast("array<struct<a:int,b:int>>")))).alias("units"))
    own = done.where("not (ref and bare)").select("row", "units")
    return own.unionByName(moved).select("row", F.explode("units").alias("u")).select("row", F.col("u.a").alias("sent_start"), F.col("u.b").alias("sent_end"))
