"""Splitting, reading and rewriting documents.

Shallow reading (titles, breaks, links) is done by patterns in the JVM; what needs
a tree or a stack is done by the standard XML parser in pandas UDFs.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import HAN, content_only, trimmed

_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]")
SENTENCE_MARKS = "。！？；：，、"
TERMINAL = "。！？"
CLOSERS = "」』”’）)】》〉"
OPENERS = "「『“‘（(【《〈"


def _mapped(kind: str, fn: Callable, *cols: Column) -> Column:
    """fn over columns by Arrow batches; null where the first column is null, and, for a struct, where fn gives None."""
    if kind.startswith("struct<"):
        several = lambda *v: None if (x := fn(*v)) is None else [x]
        return F.get(_mapped(f"array<{kind}>", several, *cols), F.lit(0))
    if len(cols) == 1:

        @F.pandas_udf(kind)
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([None if v is None else fn(v) for v in s], dtype=object)

        return one(*cols)

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ss in batches:
            yield pd.Series([None if v[0] is None else fn(*v) for v in zip(*ss, strict=True)], dtype=object)

    return run(*cols)


def parse_problem(xml: str) -> str | None:
    """Why the XML does not parse; None if it does."""
    try:
        ET.fromstring(xml)
    except ET.ParseError as e:
        return str(e)
    return None


def well_formed(xml: Column) -> Column:
    return _mapped("boolean", lambda x: parse_problem(x) is None, xml)


def body_units(xml: str) -> list[dict]:
    """Units (kind text, comm or head) of a body in order, each with its text and its range in Han characters; units without Han are dropped."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out: list[dict] = []
    at = 0

    def put(kind: str, text: str | None) -> None:
        nonlocal at
        n = len(_HAN.findall(text or ""))
        if out and out[-1]["kind"] == kind and out[-1]["open"]:
            out[-1]["text"] += text or ""
            out[-1]["han_end"] += n
        else:
            out.append({"kind": kind, "text": text or "", "han_start": at, "han_end": at + n, "open": True})
        at += n

    def close() -> None:
        if out:
            out[-1]["open"] = False

    def walk(e: ET.Element, kind: str) -> None:
        tag = e.tag.rsplit("}", 1)[-1]
        own = "comm" if tag == "note" else "head" if tag == "head" else kind
        block = tag in ("p", "head", "l", "div", "lg", "note")
        if block:
            close()
        put(own, e.text)
        for c in e:
            walk(c, own)
            put(own, c.tail)
        if block:
            close()

    walk(root, "text")
    return [{k: v for k, v in u.items() if k != "open"} for u in out if u["han_end"] > u["han_start"]]


def units(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, id, kind, text, han_start, han_end) of the units of each body; ids from 0 in order. Text that does not parse has none."""
    u = _mapped("array<struct<kind:string,text:string,han_start:int,han_end:int>>", body_units, F.col(xml))
    return df.select(key, F.posexplode(u).alias("id", "u")).select(key, "id", "u.*")


def tag_counts(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, tag, n): elements of each body by name, read by pattern."""
    tags = F.regexp_extract_all(F.col(xml), F.lit(r"<([A-Za-z][A-Za-z0-9]*)[\s/>]"), F.lit(1))
    return df.select(key, F.explode(tags).alias("tag")).groupBy(key, "tag").agg(F.count("*").alias("n"))


def milestones(df: DataFrame, key: str, xml: str, pattern: str = r'<(?:milestone|pb|lb)[^>]*\bn="([^"]*)"[^>]*/>') -> DataFrame:
    """(key, pos, n): break marks of each body in order."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(pattern), F.lit(1))).alias("pos", "n"))


def split_at(df: DataFrame, key: str, xml: str, mark: str) -> DataFrame:
    """(key, part, content): the text between marks (a pattern); what comes before the first is part 0."""
    cut = F.split(F.regexp_replace(F.col(xml), mark, "\u0001"), "\u0001")
    return df.select(key, F.posexplode(cut).alias("part", "content"))


def mandoku_header(text: Column) -> Column:
    """Map of the #+ lines at the start: TITLE, and each property by its name."""
    head = F.regexp_extract(text, r"^((?:#[^\n]*\n|\s*\n)*)", 1)
    titles = F.transform(F.regexp_extract_all(head, F.lit(r"(?m)^#\+TITLE:[ \t]*(.*)$"), F.lit(1)), lambda v: F.struct(F.lit("TITLE").alias("key"), trimmed(v).alias("value")))
    names = F.regexp_extract_all(head, F.lit(r"(?m)^#\+PROPERTY:[ \t]*(\S+)[ \t]+.*$"), F.lit(1))
    values = F.regexp_extract_all(head, F.lit(r"(?m)^#\+PROPERTY:[ \t]*\S+[ \t]+(.*)$"), F.lit(1))
    props = F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), trimmed(v).alias("value")))
    every = F.concat(titles, props)
    first = F.filter(every, lambda x, i: i == F.array_position(F.transform(every, lambda y: y["key"]), x["key"]).cast("int") - 1)
    return F.map_from_entries(first)


def mandoku_body(text: Column) -> Column:
    """The text behind the header, without page marks and line-end signs; lines broken inside a paragraph are joined."""
    body = F.regexp_replace(text, r"^(?:#[^\n]*\n|\s*\n)*", "")
    return F.regexp_replace(F.regexp_replace(body, r"<pb:[^>]*>", ""), r"¶\n?", "")


def wiki_links(text: Column) -> Column:
    """array<struct<target,label>> of [[target|label]], a section after # left out of the target."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    return F.transform(raw, lambda r: F.struct(trimmed(F.regexp_replace(F.split(r, r"\|", 2)[0], r"#.*$", "")).alias("target"), trimmed(F.element_at(F.split(r, r"\|", 2), -1)).alias("label")))


def wiki_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, section, content): lines with the ==section== they stand under, headings themselves left out."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))
    heading = F.regexp_extract("content", r"^==+\s*(.*?)\s*==+\s*$", 1)
    from tessella.operators.islands import carried_forward

    marked = lines.withColumn("_h", F.when(heading != "", heading))
    return carried_forward(marked, [key], ["line"], "_h", "section").where("_h is null and length(content) > 0").select(key, "line", "section", "content")


def commentary(text: str) -> list[dict]:
    """Bracketed notes with their places; an unclosed bracket yields one entry with error set."""
    out, stack = [], []
    for i, ch in enumerate(text):
        if ch in "（(":
            stack.append(i)
        elif ch in "）)" and stack:
            a = stack.pop()
            if not stack:
                out.append({"start": a, "end": i + 1, "text": text[a + 1 : i], "error": None})
    out += [{"start": a, "end": len(text), "text": text[a + 1 :], "error": "unclosed"} for a in stack[:1]]
    return sorted(out, key=lambda x: x["start"])


def notes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, start, end, text, error) of bracketed notes."""
    n = _mapped("array<struct<start:int,end:int,text:string,error:string>>", commentary, F.col(text))
    return df.select(key, F.posexplode(n).alias("pos", "u")).select(key, "pos", "u.*")


def strip_marks(c: Column, marks: str = SENTENCE_MARKS + OPENERS + CLOSERS) -> Column:
    return F.translate(c, marks, "")


def carried_marks(source: str, target: str) -> str:
    """target with the punctuation of source: marks go behind the Han character they follow in the source, along the common runs.

    The Han characters of the result are those of the target; if they were not, the target is returned.
    """
    from tessella.operators.align import common_runs

    chars, after, before = [], {}, {}
    pending = ""
    for ch in source:
        if _HAN.match(ch):
            if pending:
                before[len(chars)] = pending
                pending = ""
            chars.append(ch)
        elif ch in OPENERS:
            pending += ch
        elif ch in SENTENCE_MARKS + CLOSERS and chars:
            after[len(chars) - 1] = after.get(len(chars) - 1, "") + ch
    plain = "".join(_HAN.findall(target))
    to = {i + k: j + k for i, j, n in common_runs("".join(chars), plain) for k in range(n)}
    behind = {to[i]: m for i, m in after.items() if i in to}
    ahead = {to[i]: m for i, m in before.items() if i in to}
    out, at = [], 0
    for ch in target:
        if _HAN.match(ch):
            out.append(ahead.get(at, "") + ch + behind.get(at, ""))
            at += 1
        elif ch not in SENTENCE_MARKS + OPENERS + CLOSERS:
            out.append(ch)
    got = "".join(out)
    return got if "".join(_HAN.findall(got)) == plain else target


def with_marks_of(source: Column, target: Column) -> Column:
    return _mapped("string", carried_marks, source, target)


def filled(text: str, corpus: list[str], context: int = 7, longest: int = 8) -> str:
    """text with each run of □ filled where all places of the corpus with the same context agree; the longest context first."""
    def fill(m: re.Match[str]) -> str:
        n = len(m[0])
        if n > longest:
            return m[0]
        for size in (context * 2, context):
            a, b = text[max(0, m.start() - size) : m.start()], text[m.end() : m.end() + size]
            if len(a) + len(b) < context or "□" in a + b:
                continue
            found = {x.group(1) for c in corpus for x in re.finditer(f"(?={re.escape(a)}(.{{{n}}}){re.escape(b)})", c)}
            found = {f for f in found if "□" not in f}
            if len(found) == 1:
                return found.pop()
        return m[0]

    return re.sub("□+", fill, text)


def finalized(text: str, most: int = 100) -> str:
    """Punctuation tidied to a fixpoint: doubled marks, a mark behind an opener, space before a mark, long runs of line breaks."""
    rules = ((r"([。！？；：，、])\1+", r"\1"), (r"([「『（])[。，、；：]", r"\1"), (r"[ 　]+([。！？；：，、」』）])", r"\1"), (r"[，、；：]+([。！？])", r"\1"), (r"([。！？])[，、；：]+", r"\1"), (r"\n{3,}", "\n\n"))
    for _ in range(most):
        before = text
        for p, r in rules:
            text = re.sub(p, r, text)
        if text == before:
            return text
    raise ValueError(f"punctuation has not settled after {most} rounds")


def tidy(c: Column) -> Column:
    return _mapped("string", finalized, c)


def han_range(text: str, first: int, last: int) -> str:
    """The part of a text from its first to before its last Han character by number, with opening marks before and closing marks behind it."""
    at = [m.start() for m in _HAN.finditer(text)]
    if first >= last or first >= len(at):
        return ""
    a, b = at[first], at[min(last, len(at)) - 1] + 1
    while a and text[a - 1] in OPENERS:
        a -= 1
    while b < len(text) and text[b] in SENTENCE_MARKS + CLOSERS:
        b += 1
    return text[a:b]


def slice_by_han(text: Column, first: Column, last: Column) -> Column:
    return _mapped("string", lambda t, a, b: han_range(t, int(a), int(b)), text, first, last)


def adequately_punctuated(text: Column) -> Column:
    """Whether a text of 20 Han characters or more has 75 marks per 100 of them, times a hundredth; a shorter one any."""
    han, marks = F.length(content_only(text, HAN)), F.regexp_count(text, F.lit("[" + SENTENCE_MARKS + "]"))
    return F.when(han < 20, marks > 0).otherwise(marks * 100 >= 0.75 * han)
