"""Queries of the operators for language-model text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import entities, lookalike, mixing, names, packing, residue, sentences, tokens
from tessella.session import stage, table



def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence unit of every paragraph in src_para and ref_para."""
    src = table(spark, sf_dir, "src_para").select(F.col("para_id").alias("row"), F.col("file").alias("doc"), "text", "heading")
    ref = table(spark, sf_dir, "ref_para").select(F.col("para_id").alias("row"), F.col("juan_id").alias("doc"), "text", F.lit(None).cast("string").alias("heading"))
    return sentences.sentences(src, ref).select(F.col("row").alias("para_id"), "sent_start", "sent_end")


def p2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a work and an item that are one work, with the confidence of each."""
    return entities.matched(table(spark, sf_dir, "work"), table(spark, sf_dir, "work_hit"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a work and an item that are one work."""
    return p2_scored(spark, sf_dir).select("kr_id", "qid")


LOOKALIKE_TEXTS = (("segment", "seg_id", "han", False), ("src_para", "para_id", "text", False), ("juan_file", "file_id", "body_xml", True))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that look the same but differ in their characters, in segment, src_para and juan_file."""
    counts = lookalike.character_counts(table(spark, sf_dir, t).select(c) for t, _, c, _ in LOOKALIKE_TEXTS)
    rules = lookalike.rewrite_table(counts)
    found = []
    for t, key, text, references in LOOKALIKE_TEXTS:
        forms = stage(lookalike.classes(table(spark, sf_dir, t), key, text, rules, references), "p3-forms")
        found.append(lookalike.pairs(forms).select(F.lit(t).alias("tbl"), "row_a", "row_b"))
    return reduce(DataFrame.unionByName, found)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of authorship records of one person or organisation whose names differ in any character."""
    held = table(spark, sf_dir, "work").select(F.explode("authorship").alias("a")).select("a.*")
    records = held.select(F.col("record_id").alias("record"), F.col("person_name").alias("name"), F.col("time_dynasty").alias("era_text"), F.col("author_dates").alias("dates"), F.col("date_not_before").alias("first"), F.col("date_not_after").alias("last"), F.col("cbdb_id").alias("id"))
    hits = table(spark, sf_dir, "cbdb_hit").select(F.col("cbdb_id").alias("id"), "primary_name", "matched_string", F.col("dynasty").alias("era_text"))
    authority = hits.select("id", F.explode(F.array("primary_name", "matched_string")).alias("name"), "era_text").distinct()
    linked = names.variants(records, authority)
    spelt = linked.select(F.col("record").cast("long").alias("row"), F.col("component").alias("form")).join(records.select(F.col("record").alias("row"), F.col("name").alias("raw")).distinct(), "row")
    return lookalike.pairs(spelt).select(F.col("row_a").alias("record_a"), F.col("row_b").alias("record_b"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and fill of the containers of every capacity of pack_spec, holding all documents."""
    sized = stage(tokens.sizes(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select(F.col("doc_id").alias("key"), "tokens"), "p6-tokens")
    specs = table(spark, sf_dir, "pack_spec").where("capacity_tokens > 0").distinct().collect()  # one row per kind of container
    made = [packing.packed(sized, r["capacity_tokens"]).select(F.lit(r["spec_id"]).alias("spec_id"), "container", F.col("key").alias("doc_id"), "part", "tok_start", "tok_end", "fill") for r in sorted(specs, key=lambda r: r["spec_id"])]
    return reduce(DataFrame.unionByName, made)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = tokens.sizes(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return stage(sized.select(F.col("doc_id").alias("key"), "source", "tokens", "digest"), "p7-tokens")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the largest mix at which every source gives its target share, and how often each is used."""
    mix, _ = mixing.mixed(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"))
    return mix.select(F.col("key").alias("doc_id"), "source", "uses", "tokens")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares really reached, for the largest mix that meets all targets and for one of as many tokens as all documents have."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_target")
    every = sized.agg(F.sum("tokens")).first()[0] or 0
    met, asked = mixing.mixed(sized, targets)[1], mixing.mixed(sized, targets, total=every)[1]
    return met.withColumn("mix", F.lit("all targets met")).unionByName(asked.withColumn("mix", F.lit("all tokens asked for")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or script notices."""
    return residue.residue(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id")).distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_scored": p2_scored, "p3_found": p3_found, "p4_found": p4_found, "p6_packed": p6_packed, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}
SQL: dict[str, str] = {}
