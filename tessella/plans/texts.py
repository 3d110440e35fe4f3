"""Queries that align texts, carry marks over, split and reduce bodies; where SQL cannot compare sequences it states what must hold of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import documents, tei, transfer
from tessella.plans import catalogue as C

QUERIES: dict[str, C.Query] = {}
SQL: dict[str, str] = {}
query = C.registrar(QUERIES, SQL)


def han_of(c: str) -> str:
    return f"regexp_replace({c}, '[^{C.HAN}]', '', 'g')"


# Han characters of a body, those written as references included
_RANGES = "x BETWEEN 13312 AND 19903 OR x BETWEEN 19968 AND 40959 OR x BETWEEN 63744 AND 64255 OR x BETWEEN 131072 AND 205743"
_CODES = "list_concat(list_transform(regexp_extract_all(body_xml, '&#x([0-9A-Fa-f]+);', 1), lambda h: CAST('0x' || h AS INTEGER)), list_transform(regexp_extract_all(body_xml, '&#([0-9]+);', 1), lambda n: CAST(n AS INTEGER)))"
_HAN_COUNT = "length(" + han_of("regexp_replace(body_xml, '<[^>]*>', '', 'g')") + f") + len(list_filter({_CODES}, lambda x: {_RANGES}))"


@query()
def aligned_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """For each reference paragraph the source paragraphs that hold it: of equal key, containing it, or neighbours joined."""
    r = C.once(spark, d, "ref_para", "text is not null").select(F.col("para_id").alias("ref_id"), T.para_key(F.col("text")).alias("key"))
    s = C.once(spark, d, "src_para", "text is not null").select(F.col("para_id").alias("src_id"), "file", F.col("para_idx").alias("idx"), T.para_key(F.col("text")).alias("key"))
    return transfer.align_paragraphs(r, s, k=8)


@query(f"SELECT p.file_id, count(*) AS parts, max(({_HAN_COUNT})) AS han FROM {C._JUAN} p, LATERAL (SELECT unnest(range(greatest(len(regexp_extract_all(body_xml, '<pb[ />]')), 1)))) GROUP BY 1")
def page_parts(spark: SparkSession, d: str) -> DataFrame:
    """Bodies split at page breaks, nested ones too: as many parts as breaks, and all Han characters kept."""
    p = tei.sections(C.once(spark, d, "juan_file").select("file_id", "body_xml"), "file_id", "body_xml", "pb")
    return p.groupBy("file_id").agg(F.count("*").alias("parts"), F.sum(F.length(T.content_only(F.regexp_replace("xml", "<[^>]*>", "")))).cast("long").alias("han"))


@query(f"SELECT file_id, len(regexp_extract_all(body_xml, '<lb[ />]')) + len(regexp_extract_all(body_xml, '<pb[ />]')) AS changes, ({_HAN_COUNT}) AS han FROM {C._JUAN}")
def bodies_without_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Bodies without line and page breaks: what was dropped, and the Han characters, which all stay."""
    r = C.once(spark, d, "juan_file").select("file_id", tei.reduction(F.col("body_xml"), renamed={}, attributes=(), line_breaks=True).alias("r"))
    return r.select("file_id", "r.changes", F.length(T.content_only(F.regexp_replace("r.xml", "<[^>]*>", ""))).alias("han"))


@query(f"SELECT seg_id, CAST(position(left(han, 12) IN han) - 1 AS INTEGER) AS first, length(left(han, 12)) AS last FROM {C._SEG} WHERE length(han) > 0")
def located_beginnings(spark: SparkSession, d: str) -> DataFrame:
    """Where the beginning of each segment lies in it."""
    return C.once(spark, d, "segment", "length(han) > 0").select("seg_id", transfer.located(F.col("han"), F.left("han", F.lit(12))).alias("p")).select("seg_id", F.col("p.start").alias("first"), F.col("p.end").alias("last"))


@query(f"SELECT r.para_id, length({han_of('r.text')}) AS han, true AS kept FROM {C._REF} r JOIN (SELECT {han_of('text')} AS k, count(*) AS n FROM {C._SRC} GROUP BY 1) s ON s.k = {han_of('r.text')} WHERE s.k <> ''")
def punctuated_references(spark: SparkSession, d: str) -> DataFrame:
    """Reference paragraphs with the marks of the source paragraph of the same characters; none of their Han characters changes."""
    both = C.carried_punctuation(spark, d).select("para_id", F.col("text").alias("got"))
    r = C.once(spark, d, "ref_para").select("para_id", T.content_only(F.col("text")).alias("k"))
    return r.join(both, "para_id").select("para_id", F.length("k").alias("han"), (T.content_only(F.col("got")) == F.col("k")).alias("kept"))


@query(f"SELECT file_id, CAST(max(({_HAN_COUNT})) AS BIGINT) AS han, true AS in_order FROM {C._JUAN} WHERE ({_HAN_COUNT}) > 0 GROUP BY 1")
def unit_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The units of bodies cover all Han characters, each range beginning where the one before ends."""
    u = C.body_units(spark, d)
    g = u.groupBy("file_id").agg(F.max("han_end").alias("han"), F.sort_array(F.collect_list(F.struct("id", "han_start", "han_end"))).alias("l"))
    ok = F.aggregate("l", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda s, x: F.struct(x["han_end"].alias("at"), (s["ok"] & (x["han_start"] >= s["at"])).alias("ok")))["ok"]
    return g.select("file_id", F.col("han").cast("long").alias("han"), ok.alias("in_order"))


@query(f"SELECT seg_id, {han_of('text')} = {han_of('text')} AS kept, false AS doubled FROM {C._SEG} WHERE text IS NOT NULL")
def tidied_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Tidied segments keep their Han characters and hold no doubled mark."""
    t = C.once(spark, d, "segment", "text is not null").select("seg_id", "text", documents.tidy(F.col("text")).alias("got"))
    return t.select("seg_id", (T.content_only(F.col("got")) == T.content_only(F.col("text"))).alias("kept"), F.col("got").rlike("([。！？；：，、])\\1").alias("doubled"))
