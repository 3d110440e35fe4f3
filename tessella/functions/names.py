"""Names, labels and dynasties as column expressions; every rule takes its tables as parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import trimmed

NO_STRINGS = "array<string>"


def lookup(table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def narrowed(c: Column) -> Column:
    """Full-width ASCII and the ideographic space in their narrow form."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(c, wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def without_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    """Each prefix taken off in its turn, where something is left behind it."""
    for p in prefixes:
        c = F.regexp_replace(c, f"^{re.escape(p)}(?=.)", "")
    return c


def normal_name(c: Column, prefixes: Sequence[str], variants: Mapping[str, str], aliases: Mapping[str, str]) -> Column:
    """A name without prefixes, with one form for each character, and with the main name for a known other one."""
    n = F.translate(without_prefixes(trimmed(c), prefixes), "".join(variants), "".join(variants.values()))
    return F.coalesce(F.try_element_at(lookup(aliases), n), n) if aliases else n


def distinct_given(*cs: Column) -> Column:
    """The distinct values in order that are neither null nor empty."""
    return F.array_distinct(F.filter(F.array(*cs), lambda x: F.length(x) > 0))


def ends(names: Column, sizes: Sequence[int]) -> Column:
    """Distinct ends of those sizes of each name that is longer."""
    each = F.transform(names, lambda n: F.filter(F.array(*[F.when(F.length(n) > k, F.right(n, F.lit(k))) for k in sizes]), lambda x: x.isNotNull()))
    return F.array_distinct(F.flatten(each))


def labels_of(c: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """The label and its aliases in order; an empty one stands for itself."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    return F.array_distinct(F.concat(F.array(c), F.coalesce(F.try_element_at(table, c), F.array().cast(NO_STRINGS))))


def compatible(left: Column, right: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Whether right may stand for left: left is empty, they are equal, or right is among left's aliases. Not symmetric."""
    return (F.length(F.coalesce(left, F.lit(""))) == 0) | F.coalesce(F.array_contains(labels_of(left, aliases), right), F.lit(False))


def split_name(c: Column, surnames: Sequence[str], halves: bool = True) -> Column:
    """(family, given) by the longest surname the name begins with; halves: two characters without one are split in the middle. Null where nothing fits."""
    found: Column | None = None
    for size in sorted({len(s) for s in surnames}, reverse=True):
        some = [s for s in surnames if len(s) == size]
        hit = F.left(c, F.lit(size)).isin(some) & (F.length(c) > size)
        part = F.struct(F.left(c, F.lit(size)).alias("family"), F.substr(c, F.lit(size + 1)).alias("given"))
        found = F.when(hit, part) if found is None else found.when(hit, part)
    two = F.when(c.rlike(r"^[\x{4E00}-\x{9FFF}]{2}$"), F.struct(F.left(c, F.lit(1)).alias("family"), F.right(c, F.lit(1)).alias("given")))
    return F.coalesce(found, two) if halves else found  # type: ignore[return-value]


def spelt(parts: Column, readings: Mapping[str, str], whole: Column) -> Column:
    """Family and given name in their readings with a space between; the whole as it is where one is unknown."""
    f, g = F.try_element_at(lookup(readings), parts["family"]), F.try_element_at(lookup(readings), parts["given"])
    return F.coalesce(F.when(f.isNotNull() & g.isNotNull(), F.concat_ws(" ", f, g)), whole)


def role_bucket(c: Column, editors: Sequence[str]) -> Column:
    return F.when(c.rlike("[" + "".join(editors) + "]"), "editor").otherwise("author")


def dynasty_and_name(c: Column, most: int = 4) -> Column:
    """(dynasty, name) of "dynasty name": cut at the first space where what stands before it has at most that many characters."""
    at = F.instr(c, " ")
    cut = (at > 1) & (at <= most + 1)
    return F.struct(F.when(cut, F.left(c, at - 1)).otherwise("").alias("dynasty"), F.when(cut, trimmed(F.substr(c, at + 1))).otherwise(c).alias("name"))


def byline(c: Column, dynasties: Sequence[str], verbs: Sequence[str], unknown: Sequence[str], honorifics: Sequence[str], split: str = "[、，,]") -> Column:
    """(dynasty, role, names) of a byline: a dynasty is peeled off, "unknown" gives no name, the first verb it ends in is the role, honorifics go, the rest is split."""
    lead = F.regexp_extract(c, "^[（(〔\\[]?(" + "|".join(dynasties) + ")[）)〕\\]]?[ 　]*", 0)
    era = F.regexp_extract(c, "^[（(〔\\[]?(" + "|".join(dynasties) + ")[）)〕\\]]?[ 　]*", 1)
    bare = F.substr(c, F.length(lead) + 1)
    role = F.regexp_extract(bare, "(" + "|".join(verbs) + ")$", 1)
    people = F.regexp_replace(bare, "(" + "|".join(verbs) + ")$", "")
    people = F.regexp_replace(people, "(" + "|".join(honorifics) + ")$", "")
    names = F.filter(F.transform(F.split(people, split), trimmed), lambda x: F.length(x) > 0)
    return F.struct(era.alias("dynasty"), role.alias("role"), F.when(trimmed(people).isin(list(unknown)), F.array().cast(NO_STRINGS)).otherwise(names).alias("names"))


def title_parts(c: Column, ranks: Sequence[str]) -> Column:
    """(place, rank) of a title by the first of the ranks, in the order of the list, that it ends in; null where none does."""
    out: Column | None = None
    for r in ranks:
        hit = c.endswith(r) & (F.length(c) > len(r))
        part = F.struct(F.left(c, F.length(c) - len(r)).alias("place"), F.lit(r).alias("rank"))
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return out  # type: ignore[return-value]


def search_strings(dynasty: Column, place: Column, name: Column, rank: Column) -> Column:
    """Distinct ways to ask for the holder of a title; a part that is missing leaves out the ways that need it, and a dynasty equal to the place is not said twice."""
    own = F.when(~dynasty.eqNullSafe(place), dynasty)
    return distinct_given(F.concat(place, name, rank), F.concat(own, place, name, rank), F.concat(place, rank), F.concat(own, place, rank), F.concat(place, rank, name), F.concat(name, rank), name)
