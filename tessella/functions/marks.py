"""Cleaning of parallel texts and page sources as column expressions, and tests on lines and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import count_matches, trimmed

SENTENCE_END = "。！？"


def without_commentary(c: Column) -> Column:
    """Without 〈…〉 and {{…}}."""
    return F.regexp_replace(F.regexp_replace(c, "〈[^〉]*〉", ""), r"\{\{[^{}]*\}\}", "")


def without_inline_notes(c: Column, name: str = "inlinecomment") -> Column:
    """Without the spans of that class and what they hold."""
    return F.regexp_replace(c, f'(?is)<span class="{name}">.*?</span>', "")


def without_citations(c: Column, header: str = "(?m)^《[^》\n]{1,20}》[：:]", least: int = 3) -> Column:
    """Without the headers of cited passages, where a text has at least so many of them; with fewer it stays as it is."""
    return F.when(count_matches(c, header) >= least, F.regexp_replace(c, header, "")).otherwise(c)


def notes_in_brackets(c: Column) -> Column:
    """The ways of writing a note, 〈…〉, {{…}} and spans, as （…）; a mark that follows the bracket goes before it."""
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "〈([^〉]*)〉", "（$1）"), r"\{\{([^{}|]*)\}\}", "（$1）"), '(?is)<span class="[a-z]*comment">(.*?)</span>', "（$1）")
    return F.regexp_replace(one, "（([^（）]*)）([。，；：！？])", "$2（$1）")


def cleaned_parallel(c: Column) -> Column:
    """A parallel text for alignment: page marks out, small and vertical forms of marks as usual ones, brackets dropped."""
    return F.translate(F.regexp_replace(c, r"<pb:[^>]*>|\[[0-9]+[a-z]?\]|¶", ""), "﹐﹑﹒﹔﹕﹖﹗︒︑︐｡､「」『』（）()〈〉【】", "，、。；：？！。、，。、")


def cleaned_html(c: Column) -> Column:
    """Links with what they hold, images and tags of tables out, space between tags squeezed."""
    c = F.regexp_replace(c, r"(?is)<a\b[^>]*>.*?</a>", "")
    c = F.regexp_replace(c, r"(?is)</?(?:img|table|tbody|tr|td)\b[^>]*>", "")
    return trimmed(F.regexp_replace(c, r">\s+<", "><"))


def section_key(c: Column) -> Column:
    """A heading without 《》, middle dots and white space."""
    return F.regexp_replace(c, r"[《》·\s　]", "")


def chapter_key(c: Column) -> Column:
    """A chapter title without 注 before it, its number behind it, and spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\s　]", ""), "^注", ""), "第[一二三四五六七八九十百0-9]+[上中下]?$", "")


def without_disambiguation(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"[(（][^()（）]*[)）]\s*$", ""))


def cleaned_title(c: Column) -> Column:
    """A title without tags and what stands up to "No. X ", white space as single spaces."""
    c = trimmed(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "[ \t\r\n　]+", " "))
    return F.regexp_replace(c, r"^.*?No\. ?[0-9A-Za-z]+ ", "")


def reign_years(c: Column) -> Column:
    """(first, last) of "a年-b年" with or without 年; a doubtful year is null, and so are both of any other text."""
    p = r"^\s*(-?[0-9]+|\?)年?\s*[-–—]\s*(-?[0-9]+|\?)年?(\?)?\s*$"
    year = lambda i: F.regexp_extract(c, p, i)
    doubt = F.regexp_extract(c, p, 3)
    return F.struct(F.when(year(1).rlike("^-?[0-9]+$"), year(1).cast("int")).alias("first"), F.when(year(2).rlike("^-?[0-9]+$") & (doubt == ""), year(2).cast("int")).alias("last"))


def chapter_title_ok(c: Column, ends: str, skip: str, least: int = 3, most: int = 16) -> Column:
    """Whether a chapter title is fit for matching: neither short nor long, of a known kind, none of those to be skipped."""
    return F.length(c).between(least, most) & F.right(c, F.lit(1)).rlike(f"[{ends}]") & ~c.rlike(skip)


def is_heading_line(c: Column, patterns: Sequence[str], longest: int = 120) -> Column:
    """Whether a line opens a part: not long, without a mark that ends a sentence, of one of the patterns."""
    return (F.length(c) <= longest) & ~c.rlike(f"[{SENTENCE_END}]") & c.rlike("|".join(f"(?:{p})" for p in patterns))


def continues(c: Column) -> Column:
    """Whether a paragraph breaks off inside a sentence: it ends neither in a mark nor in a mark and closers."""
    return ~F.coalesce(c.rlike("[。！？…；：.!?]['\"」』”’）)】》〉]*\\s*$"), F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def holds_any(c: Column, markers: Sequence[str]) -> Column:
    """Whether a page holds any of the markers, in either case."""
    found = [F.contains(F.lower(c), F.lit(m.lower())) for m in markers]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))


def single_opening(c: Column) -> Column:
    """One opening mark where a boundary has doubled it."""
    return F.regexp_replace(c, "([「『（《])\\1+", "$1")
