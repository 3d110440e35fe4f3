"""Splitting and reducing TEI bodies: by milestones, with the notes they point to, and to plainer elements.

Trees are read by the standard parser in pandas UDFs; every function takes and gives XML text.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.documents import _mapped

# Elements and attributes that have a plainer form.
RENAMED = {"juan": "head", "mulu": "head", "lg": "lg", "dialog": "sp", "def": "def"}
DROPPED_ATTRIBUTES = ("style", "facs", "rendition")


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ET.Element) -> str:
    return ET.tostring(e, encoding="unicode")


def _drop(parent: ET.Element, e: ET.Element) -> None:
    """Take e out and leave what follows it."""
    at = list(parent).index(e)
    tail = e.tail or ""
    if at:
        parent[at - 1].tail = (parent[at - 1].tail or "") + tail
    else:
        parent.text = (parent.text or "") + tail
    parent.remove(e)


def reduced(xml: str, renamed: Mapping[str, str] = RENAMED, attributes: Sequence[str] = DROPPED_ATTRIBUTES, line_breaks: bool = False, anchors: bool = False, chars: Mapping[str, str] | None = None) -> tuple[str, dict[str, int]]:
    """(XML, how often each rule was applied): elements renamed, attributes dropped, place moved to rend, glyph references as text, and without line breaks or anchors where asked; text around what goes stays."""
    root = ET.fromstring(xml)
    done: dict[str, int] = {}
    count = lambda k: done.__setitem__(k, done.get(k, 0) + 1)
    for parent in list(root.iter()):
        for e in list(parent):
            n = _name(e)
            if (n in ("lb", "pb") and line_breaks) or (n == "anchor" and anchors):
                _drop(parent, e)
                count(n)
            elif n == "g" and chars and (c := chars.get(e.get("ref", "").lstrip("#"))):
                e.tail = c + (e.tail or "")
                _drop(parent, e)
                count("g")
    for e in root.iter():
        n = _name(e)
        if renamed.get(n, n) != n:
            e.tag = renamed[n]
            count(n)
        for a in attributes:
            if e.attrib.pop(a, None) is not None:
                count("@" + a)
        if n in ("p", "seg", "entry") and "place" in e.attrib:
            e.set("rend", e.attrib.pop("place"))
            count("@place")
        if e.text:
            e.text = re.sub(r"\n{3,}", "\n\n", e.text)
        if e.tail:
            e.tail = re.sub(r"\n{3,}", "\n\n", e.tail)
    return _text(root), done


def promoted(root: ET.Element, mark: str) -> None:
    """Lift nested marks to the top: what stands before one in its parents and what stands behind it become two elements. One walk over the tree."""
    out: list[ET.Element] = []

    def split(e: ET.Element) -> list[ET.Element]:
        pieces, now = [], ET.Element(e.tag, dict(e.attrib))
        now.text = e.text
        for c in e:
            if _name(c) == mark:
                pieces += [now, c]
                now = ET.Element(e.tag, {k: v for k, v in e.attrib.items() if not k.endswith("id")})
                now.text, c.tail = c.tail, None
                continue
            parts = split(c) if any(_name(x) == mark for x in c.iter()) else [c]
            for p in parts:
                if _name(p) == mark and p is not c:
                    pieces += [now, p]
                    now = ET.Element(e.tag, {k: v for k, v in e.attrib.items() if not k.endswith("id")})
                else:
                    now.append(p)
            parts[-1].tail = c.tail
        return [*pieces, now]

    for c in list(root):
        tail = c.tail
        parts = [c] if _name(c) == mark or not any(_name(x) == mark for x in c.iter()) else split(c)
        parts[-1].tail = tail
        out += parts
        root.remove(c)
    root.extend(out)


def slices(xml: str, mark: str = "milestone", label: str = "n") -> list[dict]:
    """{n, xml} of the parts between marks; what comes before the first goes with it, a body without marks is one part, and nested marks are lifted first."""
    root = ET.fromstring(xml)
    promoted(root, mark)
    parts: list[dict] = []
    now, lead = ET.Element(root.tag, dict(root.attrib)), root.text
    now.text = lead
    for c in list(root):
        if _name(c) == mark:
            if parts or any(len(x) or (x.text or "").strip() for x in now) or (now.text or "").strip():
                if parts:
                    now = ET.Element(root.tag, dict(root.attrib))
            parts.append({"n": c.get(label, ""), "e": now})
            if c.tail and c.tail.strip():
                now.text = (now.text or "") + c.tail
        else:
            now.append(c)
    if not parts:
        parts = [{"n": "", "e": now}]
    return [{"n": p["n"], "xml": _text(p["e"])} for p in parts]


def stitched(parts: Sequence[Mapping]) -> list[dict]:
    """Neighbouring parts of one number put together; ids of the later ones get a prefix, and pointers to them too."""
    out: list[dict] = []
    for k, p in enumerate(parts):
        if out and out[-1]["n"] == p["n"]:
            a, b = ET.fromstring(out[-1]["xml"]), ET.fromstring(p["xml"])
            prefixed(b, f"s{k}-")
            if b.text and b.text.strip():
                if len(a):
                    a[-1].tail = (a[-1].tail or "") + b.text
                else:
                    a.text = (a.text or "") + b.text
            a.extend(list(b))
            out[-1] = {"n": p["n"], "xml": _text(a)}
        else:
            out.append(dict(p))
    return out


_ID = "{http://www.w3.org/XML/1998/namespace}id"


def prefixed(root: ET.Element, prefix: str) -> int:
    """Give the ids of a tree a prefix, and the pointers to them; how many ids there were."""
    ids = {e.get(_ID) for e in root.iter() if e.get(_ID)}
    for e in root.iter():
        if e.get(_ID):
            e.set(_ID, prefix + e.get(_ID, ""))
        for a in ("target", "corresp", "from", "to"):
            if e.get(a):
                e.set(a, " ".join("#" + prefix + t[1:] if t[:1] == "#" and t[1:] in ids else t for t in e.get(a, "").split()))
    return len(ids)


def attach_notes(parts: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, part, notes): the notes that each part points to, by an inverted index of pointers, in the order of their ids.

    parts: (doc, part, xml); notes: (doc, note_id, content). Parts without any are left out.
    """
    pointers = parts.select("doc", "part", F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(r'(?:target|corresp|xml:id)="#?([^"\s]+)"'), F.lit(1)))).alias("note_id"))
    met = pointers.join(notes, ["doc", "note_id"])
    return met.groupBy("doc", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("note_id", "content"))), lambda x: x["content"]).alias("notes"))


def nested_heads(levels: Sequence[int]) -> list[int]:
    """The place of the heading that each heading of a level stands under, -1 at the top."""
    out, stack = [], []
    for i, level in enumerate(levels):
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append(stack[-1][1] if stack else -1)
        stack.append((level, i))
    return out


def sections(df: DataFrame, key: str, xml: str, mark: str = "milestone") -> DataFrame:
    """(key, part, n, xml) of the parts of each body; text that does not parse has none."""

    def cut(x: str) -> list[dict]:
        try:
            return stitched(slices(x, mark))
        except ET.ParseError:
            return []

    u = _mapped("array<struct<n:string,xml:string>>", cut, F.col(xml))
    return df.select(key, F.posexplode(u).alias("part", "u")).select(key, "part", "u.n", "u.xml")


def reduction(xml: Column, **options: object) -> Column:
    """struct<xml,changes> of each body reduced; null where it does not parse."""

    def run(x: str) -> dict | None:
        try:
            text, done = reduced(x, **options)  # type: ignore[arg-type]
        except ET.ParseError:
            return None
        return {"xml": text, "changes": sum(done.values())}

    return _mapped("struct<xml:string,changes:int>", run, xml)
