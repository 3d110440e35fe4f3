"""Every registered query against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry
from tessella.plans import catalogue

DATA = "/root/testdata/sf0.001"
CORE = [m for m in entry._modules() if not m.__name__.startswith("tessella.llm")]
QUERIES = {n: q for m in CORE for n, q in m.QUERIES.items()}
SQL = {n: s for m in CORE for n, s in m.SQL.items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(SQL[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    order = [list(rel.columns).index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_entry_is_a_query():
    assert callable(entry.entry) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_title_jaccard_has_no_prefix_key(spark):
    titles = [dict(read(spark, DATA).collect()) for read in (lambda s, d: catalogue.works(s, d).select("kr_id", "title"), lambda s, d: catalogue.items(s, d).select("qid", "wikidata_title"))]
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    sides = [{k: grams(t) for k, t in side.items() if t and len(t) >= 2} for side in titles]
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sides[0].items() for b, y in sides[1].items() if x & y}
    got = {(r.kr_id, r.qid): r.similarity for r in QUERIES["title_jaccard"](spark, DATA).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert any(a[:2] != b[:2] for a, b in ((titles[0][k], titles[1][q]) for k, q in got))


def test_person_cores_keep_names_with_spaces_at_brackets(spark, tmp_path):
    names = ["（清） 王安石", "王安石 （撰）", "王安石 等", "王安石 ", "王安石", None]
    people = [{"record_id": i, "person_name": n, "time_dynasty": "清代"} for i, n in enumerate(names)]
    schema = "kr_id string, loaded_at string, authorship array<struct<record_id:long,person_name:string,time_dynasty:string>>"
    spark.createDataFrame([("w", "2020", people)], schema).write.parquet(f"{tmp_path}/work.parquet")
    got = {r.record_id: (r.era, r.core) for r in QUERIES["person_cores"](spark, str(tmp_path)).collect()}
    assert {k: (e, c.strip()) for k, (e, c) in got.items()} == {i: ("清", "王安石") for i in range(5)}
    assert all(c == c.strip() for _, c in got.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize(("name", "unread"), [("juan_without_segments", ("body_xml", "title")), ("juan_coverage", ("han", "text", "made_at")), ("segment_runs", ("text", "made_at", "has_punct")), ("exact_titles", ("authorship", "vols"))])
def test_scans_read_only_what_is_needed(spark, name, unread):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    read = [line.split("ReadSchema: struct<")[1] for line in plan.split("\n") if "ReadSchema: struct<" in line]
    assert read
    for column in unread:
        assert not any(f"{column}:" in f",{r}".replace(",", ", ").split() for r in read), column
        assert not any(f",{column}:" in f",{r}" for r in read), column


def test_entry_survives_without_the_packages_of_llm():
    """A child process in which a package that only llm needs can't be imported still lists the core queries."""
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['xxhash'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert 'work_entries' in q and 'p2_found' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_a_cluster_needs_a_shared_folder():
    from tessella.session import shared_dir

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake())
