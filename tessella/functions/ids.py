"""Identifiers, file names, numbers and addresses as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.names import lookup
from tessella.functions.text import numeral


def last_number(c: Column) -> Column:
    """The number a text ends in, else that of a Han numeral behind 卷, else 0 for front matter; null where it has none of them."""
    tail, han = F.regexp_extract(c, r"([0-9]+)$", 1), F.regexp_extract(c, "卷([〇零一二三四五六七八九十百千]+)", 1)
    return F.coalesce(F.when(tail != "", tail.cast("int")), F.when(han != "", numeral(han)), F.when(c.rlike("序|目錄|凡例|提要"), F.lit(0)))


def isolated_number(c: Column) -> Column:
    """The first number of one to four digits that stands alone, without leading zeros; empty where there is none."""
    n = F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{1,4})(?:[^0-9]|$)", 1)
    return F.when(n == "", "").otherwise(F.coalesce(F.nullif(F.ltrim(n, F.lit("0")), F.lit("")), F.lit("0")))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9]+$", "")


def file_parts(path: Column, longest: int = 3) -> Column:
    """(section, title, dynasty, author) of "section-title[-dynasty-author]": the dynasty only where three parts follow the section and it is short."""
    p = F.split(stem_of(path), "-")
    n = F.size(p)
    told = (n >= 4) & (F.length(F.get(p, F.lit(2))) <= longest)
    return F.struct(p[0].alias("section"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("title"), F.when(told, F.get(p, F.lit(2))).otherwise("").alias("dynasty"), F.when(told, F.get(p, F.lit(3))).otherwise("").alias("author"))


def title_of_file(path: Column, number: Column) -> Column:
    """The stem without section, running number and the work's own number."""
    t = F.regexp_replace(F.regexp_replace(stem_of(path), "^[^-]*-", ""), "-[0-9]+$", "")
    return F.trim(F.replace(t, F.coalesce(F.nullif(number, F.lit("")), F.lit("\u0000")), F.lit("")))


def page_url(base: str, page: Column) -> Column:
    """An address with the page's name percent-encoded, a space as %20."""
    e = F.replace(F.replace(F.replace(F.url_encode(page), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(base), e)


def item_id(c: Column) -> Column:
    """The id of an item from the id itself or an address that ends in it; empty otherwise."""
    return F.regexp_extract(c, r"(?:^|/)(Q[0-9]+)$", 1)


def canon_of(c: Column, known: Sequence[str]) -> Column:
    """The known prefix of two letters, else of one, else empty."""
    two, one = [k for k in known if len(k) == 2], [k for k in known if len(k) == 1]
    return F.when(F.left(c, F.lit(2)).isin(two), F.left(c, F.lit(2))).when(F.left(c, F.lit(1)).isin(one), F.left(c, F.lit(1))).otherwise("")


def work_id_parts(c: Column, known: Sequence[str]) -> Column:
    """(canon, lead, number, trail) of a work's id, the number padded to four; null where the canon is unknown or no number follows."""
    canon = canon_of(c, known)
    rest = F.substr(c, F.length(canon) + 1)
    number = F.regexp_extract(rest, r"^([A-Za-z]?)([0-9]+)([A-Za-z]?)$", 2)
    part = lambda i: F.regexp_extract(rest, r"^([A-Za-z]?)([0-9]+)([A-Za-z]?)$", i)
    return F.when((canon != "") & (number != ""), F.struct(canon.alias("canon"), part(1).alias("lead"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number).alias("number"), part(3).alias("trail")))


def looser_id(c: Column) -> Column:
    """An id with its n and leading zeros left out, under which it may be listed."""
    return F.regexp_replace(F.regexp_replace(c, "n", ""), r"^([A-Z]+)0+", "$1")


def juan_label(c: Column, longest: int = 8) -> Column:
    """卷 with its number where a title has it, else the title's last characters."""
    n = F.regexp_extract(c, "(卷[〇零一二三四五六七八九十百千0-9]+)", 1)
    return F.when(n != "", n).otherwise(F.right(c, F.lit(longest)))


def url_parts(c: Column) -> Column:
    """(host, kind, id): what an address asks for, by its query or the last part of its path."""
    chapter, res = F.try_parse_url(c, F.lit("QUERY"), F.lit("chapter")), F.try_parse_url(c, F.lit("QUERY"), F.lit("res"))
    path = F.regexp_extract(F.try_parse_url(c, F.lit("PATH")), "([^/]+)/?$", 1)
    return F.struct(F.try_parse_url(c, F.lit("HOST")).alias("host"), F.when(chapter.isNotNull(), "chapter").when(res.isNotNull(), "res").otherwise("page").alias("kind"), F.coalesce(chapter, res, path).alias("id"))


def numbered_label(c: Column, ids: Mapping[str, int]) -> Column:
    """(id, label) of a label or of what is left without 朝 or 代 at its end; id is null where neither is known."""
    bare = F.regexp_replace(c, "[朝代]$", "")
    return F.struct(F.coalesce(F.try_element_at(lookup(ids), c), F.try_element_at(lookup(ids), bare)).alias("id"), F.when(F.try_element_at(lookup(ids), c).isNotNull(), c).otherwise(bare).alias("label"))
