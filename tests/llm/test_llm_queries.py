"""Every query of the subpackage on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {
    "p1_found": ["para_id", "sent_start", "sent_end"], "p2_found": ["kr_id", "qid"], "p3_found": ["tbl", "row_a", "row_b"], "p4_found": ["record_a", "record_b"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries_have_their_columns(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))
    if name in ("p3_found", "p4_found"):
        assert all(r[-2] < r[-1] for r in rows)


def test_packed_documents_are_whole(spark):
    packed = queries.p6_packed(spark, DATA)
    sizes = spark.read.parquet(f"{DATA}/pack_spec.parquet").distinct()
    parts = packed.groupBy("spec_id", "doc_id").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("n"), F.min("tok_start").alias("first"), F.max("tok_end").alias("last"))
    assert parts.where("n <> last - first or first <> 0").count() == 0
    held = packed.groupBy("spec_id", "container").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("n")).join(sizes, "spec_id")
    assert held.where("n > capacity_tokens").count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 0").select("doc_id").distinct().count()
    assert [r["count"] for r in parts.groupBy("spec_id").count().collect()] == [docs] * sizes.count()


def test_mix_keeps_repeats_and_shares(spark):
    mix = queries.p7_mix(spark, DATA)
    target = spark.read.parquet(f"{DATA}/mix_target.parquet")
    assert mix.groupBy("doc_id", "source").agg(F.sum("uses").alias("n")).join(target, "source").where("n > max_repeats").count() == 0
    shares = queries.p7_shares(spark, DATA)
    assert shares.groupBy("mix").count().count() == 2
