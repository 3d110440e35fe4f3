"""Queries that merge, resolve and choose across sources, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import names
from tessella.functions import text as T
from tessella.operators import islands, merge, resolve
from tessella.plans import catalogue as C
from tessella.plans.scalars import ALIASES, DYNASTIES, PREFIXES, VARIANTS, _LABELS_SQL, _N, normal
from tessella.session import stage, table

QUERIES: dict[str, C.Query] = {}
SQL: dict[str, str] = {}
query = C.registrar(QUERIES, SQL)


def given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


_NO = "CAST(TRY_CAST(NULLIF(regexp_extract({0}, '^[^0-9]*([0-9]+)([.]0+)?$', 1), '') AS INTEGER) AS VARCHAR)"


def number(c: str) -> Column:
    return F.expr(f"cast(try_cast(nullif(regexp_extract({c}, '^[^0-9]*([0-9]+)([.]0+)?$', 1), '') as int) as string)")


_CN = f"(SELECT *, {_NO.format('dz_no')} AS no FROM {C._CORPUS})"
_FIRST_CN = f"(SELECT no, arg_min_null(id, id) AS entry, arg_min_null(title, id) AS c_title, arg_min_null(dynasty, id) AS c_dynasty, arg_min_null(rel_path, id) AS path FROM {_CN} WHERE no IS NOT NULL GROUP BY 1)"
_BY_TITLE = f"(SELECT title, min(work_id) AS work_id, arg_min_null(dynasty, work_id) AS k_dynasty, arg_min_null(juan_count, work_id) AS juan FROM {C._CATALOG} WHERE coalesce(title, '') <> '' GROUP BY 1)"
_ITEM_BY_TITLE = f"(SELECT wikidata_title AS title, min(qid) AS qid, arg_min_null(dynasty_label, qid) AS i_dynasty FROM {C._ITEM} WHERE coalesce(wikidata_title, '') <> '' GROUP BY 1 HAVING count(*) = 1)"


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """The first corpus entry of each number."""
    c = C.once(spark, d, "corpus_entry").select(number("dz_no").alias("no"), F.col("id").alias("entry"), F.col("title").alias("c_title"), F.col("dynasty").alias("c_dynasty"), F.col("rel_path").alias("path")).where("no is not null")
    return merge.first_wins(c, ["no"], ["entry"])


def by_title(spark: SparkSession, d: str) -> DataFrame:
    """The first catalogue work of each title."""
    k = C.once(spark, d, "catalog_hit").select("title", "work_id", F.col("dynasty").alias("k_dynasty"), F.col("juan_count").alias("juan")).where("coalesce(title, '') <> ''")
    return merge.first_wins(k, ["title"], ["work_id"])


def unique_items(spark: SparkSession, d: str) -> DataFrame:
    """Items alone under their title."""
    i = C.items(spark, d).where("coalesce(wikidata_title, '') <> ''").groupBy(F.col("wikidata_title").alias("title"))
    return i.agg(F.min("qid").alias("qid"), F.min_by("dynasty_label", "qid").alias("i_dynasty"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(
    f"""SELECT w.kr_id, coalesce({C._given('w.title')}, {C._given('c_title')}) AS title, coalesce(NULLIF(w.vols, ''), NULLIF(w.juan_count, ''), CAST(files AS VARCHAR)) AS extent,
    coalesce({C._given('w.time_dynasty')}, {C._given('first_era')}, {C._given('c_dynasty')}, {C._given('k_dynasty')}, {C._given('i_dynasty')}) AS dynasty, coalesce(NULLIF(w.author_dates, ''), NULLIF(first_dates, '')) AS dates,
    entry, work_id, qid, coalesce(files, 0) AS files, coalesce(authors, '') AS authors FROM {C._WORK} w LEFT JOIN {_FIRST_CN} c ON c.no = {_NO.format('w.dzid')} LEFT JOIN {_BY_TITLE} k ON k.title = w.title LEFT JOIN {_ITEM_BY_TITLE} i ON i.title = w.title
    LEFT JOIN (SELECT kr_id, count(*) AS files FROM {C._JUAN} GROUP BY 1) j ON j.kr_id = w.kr_id
    LEFT JOIN (SELECT kr_id, string_agg(coalesce(person_name, ''), '、' ORDER BY TRY_CAST(author_index AS INTEGER), record_id) AS authors, arg_min_null(time_dynasty, (TRY_CAST(author_index AS INTEGER), record_id)) AS first_era, arg_min_null(author_dates, (TRY_CAST(author_index AS INTEGER), record_id)) AS first_dates FROM {C._AUTHOR} GROUP BY 1) a ON a.kr_id = w.kr_id"""
)
def full_entries(spark: SparkSession, d: str) -> DataFrame:
    """Works joined on the left with corpus, catalogue, items, files and authors, each field from the first source that gives it."""
    w = C.works(spark, d).select("kr_id", "title", "vols", "juan_count", "time_dynasty", "author_dates", number("dzid").alias("no"))
    place = F.struct(F.expr("try_cast(author_index as int)").alias("i"), "record_id")
    a = C.authorships(spark, d).groupBy("kr_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.coalesce("person_name", F.lit("")).alias("name")))).alias("l"), F.min_by("time_dynasty", place).alias("first_era"), F.min_by("author_dates", place).alias("first_dates"))
    j = C.once(spark, d, "juan_file").groupBy("kr_id").agg(F.count("*").alias("files"))
    full = w.join(numbered(spark, d), "no", "left").join(by_title(spark, d), "title", "left").join(unique_items(spark, d), "title", "left").join(j, "kr_id", "left").join(a, "kr_id", "left")
    return full.select(
        "kr_id", T.first_given(F.col("title"), F.col("c_title")).alias("title"), F.coalesce(given("vols"), given("juan_count"), F.col("files").cast("string")).alias("extent"),
        T.first_given(F.col("time_dynasty"), F.col("first_era"), F.col("c_dynasty"), F.col("k_dynasty"), F.col("i_dynasty")).alias("dynasty"), F.coalesce(given("author_dates"), given("first_dates")).alias("dates"),
        "entry", "work_id", "qid", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce(F.array_join(F.transform("l", lambda x: x["name"]), "、"), F.lit("")).alias("authors"),
    )


_WORK_NO = f"(SELECT no, arg_min_null(kr_id, kr_id) AS kr_id, arg_min_null(title, kr_id) AS w_title, arg_min_null(time_dynasty, kr_id) AS w_dynasty FROM (SELECT *, {_NO.format('dzid')} AS no FROM {C._WORK}) WHERE no IS NOT NULL GROUP BY 1)"


def works_by_number(spark: SparkSession, d: str) -> DataFrame:
    w = C.works(spark, d).select(number("dzid").alias("no"), "kr_id", F.col("title").alias("w_title"), F.col("time_dynasty").alias("w_dynasty")).where("no is not null")
    return merge.first_wins(w, ["no"], ["kr_id"])


@query(f"SELECT e.id, coalesce({C._given('e.title')}, {C._given('w_title')}) AS title, coalesce({C._given('e.dynasty')}, {C._given('w_dynasty')}, {C._given('k_dynasty')}) AS dynasty, w.kr_id, k.work_id, k.juan, i.qid FROM {_CN} e LEFT JOIN {_WORK_NO} w ON w.no = e.no LEFT JOIN {_BY_TITLE} k ON k.title = e.title LEFT JOIN {_ITEM_BY_TITLE} i ON i.title = e.title")
def corpus_entries(spark: SparkSession, d: str) -> DataFrame:
    """Corpus entries joined on the left with works by number and with catalogue and items by title."""
    e = C.once(spark, d, "corpus_entry").select("id", "title", "dynasty", number("dz_no").alias("no"))
    full = e.join(works_by_number(spark, d), "no", "left").join(by_title(spark, d), "title", "left").join(unique_items(spark, d), "title", "left")
    return full.select("id", T.first_given(F.col("title"), F.col("w_title")).alias("title"), T.first_given(F.col("dynasty"), F.col("w_dynasty"), F.col("k_dynasty")).alias("dynasty"), "kr_id", "work_id", "juan", "qid")


@query(
    f"""WITH s AS (SELECT title, 0 AS p, entry AS id, no FROM (SELECT w_title AS title, no FROM {_WORK_NO} WHERE w_title <> '') JOIN {_FIRST_CN} USING (no) UNION ALL SELECT title, 1, id, no FROM {_CN} WHERE title <> ''),
    kept AS (SELECT * FROM s WHERE id IN (SELECT id FROM {C._CORPUS} WHERE bytes > 20000))
    SELECT title, id, no, p AS source FROM kept QUALIFY row_number() OVER (PARTITION BY title ORDER BY p, id) = 1"""
)
def path_map(spark: SparkSession, d: str) -> DataFrame:
    """Titles with the entry that holds them, from the first source whose entry is among the files; one that is refused does not erase a lower one."""
    c = numbered(spark, d).select("no", F.col("entry").alias("id"))
    first = works_by_number(spark, d).where("w_title <> ''").select(F.col("w_title").alias("title"), "no").join(c, "no").select("title", "id", "no")
    second = C.once(spark, d, "corpus_entry", "title <> ''").select("title", "id", number("dz_no").alias("no"))
    held = C.once(spark, d, "corpus_entry", "bytes > 20000").select("id")
    kept = [x.withColumn("source", F.lit(i)).join(held, "id", "left_semi").select("title", "id", "no", "source") for i, x in enumerate((first, second))]
    return merge.priority_union(kept, ["title"], ["id"])


@query(f"SELECT k.work_id, coalesce(NULLIF(c.title, ''), NULLIF(k.title, '')) AS title, coalesce(NULLIF(w.w_dynasty, ''), NULLIF(c.dynasty, ''), NULLIF(k.dynasty, '')) AS dynasty, coalesce(NULLIF(k.authors, ''), NULLIF(c.authors, '')) AS authors FROM {C._CATALOG} k LEFT JOIN (SELECT title, arg_min_null(dynasty, id) AS dynasty, arg_min_null(authors, id) AS authors FROM {C._CORPUS} WHERE title <> '' GROUP BY 1) c ON c.title = k.title LEFT JOIN (SELECT title, arg_min_null(time_dynasty, kr_id) AS w_dynasty FROM {C._WORK} WHERE title <> '' GROUP BY 1) w ON w.title = k.title")
def work_info(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue works with what later sources say, which stands before what earlier ones said."""
    k = C.once(spark, d, "catalog_hit").select("work_id", F.col("title").alias("t"), F.col("dynasty").alias("k_dynasty"), F.col("authors").alias("k_authors"))
    c = merge.first_wins(C.once(spark, d, "corpus_entry", "title <> ''").select("title", "id", "dynasty", "authors"), ["title"], ["id"]).select(F.col("title").alias("t"), F.col("title").alias("c_title"), F.col("dynasty").alias("c_dynasty"), F.col("authors").alias("c_authors"))
    w = merge.first_wins(C.works(spark, d).where("title <> ''").select("title", "kr_id", "time_dynasty"), ["title"], ["kr_id"]).select(F.col("title").alias("t"), F.col("time_dynasty").alias("w_dynasty"))
    full = k.join(c, "t", "left").join(w, "t", "left")
    return full.select("work_id", F.coalesce(given("c_title"), given("t")).alias("title"), F.coalesce(given("w_dynasty"), given("c_dynasty"), given("k_dynasty")).alias("dynasty"), F.coalesce(given("k_authors"), given("c_authors")).alias("authors"))


@query(f"SELECT w.kr_id, c.path FROM {C._WORK} w JOIN {_FIRST_CN} c ON c.no = {_NO.format('w.dzid')} WHERE coalesce(c.path, '') <> ''")
def parallel_paths(spark: SparkSession, d: str) -> DataFrame:
    """Works with the file that holds them; works without one are left out."""
    return C.works(spark, d).select("kr_id", number("dzid").alias("no")).join(numbered(spark, d), "no").where("coalesce(path, '') <> ''").select("kr_id", "path")


@query(f"SELECT w.kr_id, coalesce(a.qid, b.qid) AS qid, CASE WHEN a.qid IS NOT NULL THEN 'title' WHEN b.qid IS NOT NULL THEN 'alias' END AS via, CASE WHEN coalesce(a.qid, b.qid) IS NOT NULL THEN 'https://items.example/' || coalesce(a.qid, b.qid) END AS url FROM {C._WORK} w LEFT JOIN {_ITEM_BY_TITLE} a ON a.title = w.title LEFT JOIN (SELECT title, min(qid) AS qid FROM (SELECT qid, unnest(aliases) AS title FROM {C._ITEM}) WHERE title <> '' GROUP BY 1) b ON b.title = w.title")
def crossed_works(spark: SparkSession, d: str) -> DataFrame:
    """The item of a work by its title, else by an alias; an address only where there is one."""
    b = C.items(spark, d).select("qid", F.explode("aliases").alias("title")).where("title <> ''").groupBy("title").agg(F.min("qid").alias("b"))
    full = C.works(spark, d).select("kr_id", "title").join(unique_items(spark, d).select("title", F.col("qid").alias("a")), "title", "left").join(b, "title", "left")
    q = F.coalesce("a", "b")
    return full.select("kr_id", q.alias("qid"), F.when(F.col("a").isNotNull(), "title").when(F.col("b").isNotNull(), "alias").alias("via"), F.concat(F.lit("https://items.example/"), q).alias("url"))


@query(f"SELECT title, max(k) AS work_id, max(c) AS id, max(w) AS kr_id, CASE WHEN max(k) IS NOT NULL THEN 'catalog' WHEN max(c) IS NOT NULL THEN 'corpus' ELSE 'work' END AS first FROM (SELECT title, min(work_id) AS k, NULL AS c, NULL AS w FROM {C._CATALOG} WHERE title <> '' GROUP BY 1 UNION ALL SELECT title, NULL, min(id), NULL FROM {C._CORPUS} WHERE title <> '' GROUP BY 1 UNION ALL SELECT title, NULL, NULL, min(kr_id) FROM {C._WORK} WHERE title <> '' GROUP BY 1) GROUP BY 1")
def title_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Full outer merge of three sources by title."""
    a = C.once(spark, d, "catalog_hit", "title <> ''").groupBy("title").agg(F.min("work_id").alias("work_id"))
    b = C.once(spark, d, "corpus_entry", "title <> ''").groupBy("title").agg(F.min("id").alias("id"))
    c = C.works(spark, d).where("title <> ''").groupBy("title").agg(F.min("kr_id").alias("kr_id"))
    full = a.join(b, "title", "full_outer").join(c, "title", "full_outer")
    return full.select("title", "work_id", "id", "kr_id", F.when(F.col("work_id").isNotNull(), "catalog").when(F.col("id").isNotNull(), "corpus").otherwise("work").alias("first"))


@query(f"SELECT title FROM {C._CATALOG} WHERE title <> '' UNION SELECT title FROM {C._CORPUS} WHERE title <> '' UNION SELECT title FROM {C._WORK} WHERE title <> ''")
def all_titles(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (x.where("title <> ''").select("title") for x in (C.once(spark, d, "catalog_hit"), C.once(spark, d, "corpus_entry"), C.works(spark, d)))
    return a.unionByName(b).unionByName(c).distinct()


@query(f"SELECT qid FROM {C._ITEM} WHERE wikidata_title IS NOT NULL AND wikidata_title NOT IN (SELECT title FROM {C._WORK} WHERE title IS NOT NULL)")
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    """Items whose title no work has: what is still to be fetched."""
    return C.items(spark, d).where("wikidata_title is not null").join(C.works(spark, d).select(F.col("title").alias("wikidata_title")), "wikidata_title", "left_anti").select("qid")


# authorities


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, name, ord, era) of every way to ask for a person, in the order in which they are tried."""
    raw, n = F.col("person_name"), normal("person_name")
    v = names.distinct_given(raw, n, F.translate(raw, "傳", "傅"), F.concat(n, F.lit("帝")))
    return C.authorships(spark, d).where("coalesce(person_name, '') <> ''").select("record_id", F.col("time_dynasty").alias("era"), F.posexplode(v).alias("ord", "name"))


_ASKED = f"(SELECT record_id, era, name, ord FROM (SELECT record_id, time_dynasty AS era, unnest([person_name, n, translate(person_name, '傳', '傅'), n || '帝']) AS name, unnest(range(4)) AS ord FROM {_N}) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY record_id, name ORDER BY ord) = 1)"
_GATE = f"(coalesce(era, '') = '' OR coalesce(list_contains({_LABELS_SQL.format('era')}, dynasty), false))"


@query(
    f"""WITH e AS (SELECT record_id, cbdb_id, true AS exact FROM {_ASKED} JOIN {C._CBDB} ON matched_string = name WHERE {_GATE}),
    s AS (SELECT DISTINCT record_id, era, unnest([CASE WHEN length(name) > 2 THEN right(name, 2) END, CASE WHEN length(name) > 3 THEN right(name, 3) END]) AS k FROM {_ASKED}),
    x AS (SELECT record_id, cbdb_id, false AS exact FROM s JOIN {C._CBDB} ON matched_string = k WHERE {_GATE}),
    c AS (SELECT record_id, cbdb_id, bool_or(exact) AS exact FROM (SELECT * FROM e UNION ALL SELECT * FROM x) GROUP BY ALL),
    k AS (SELECT *, bool_or(exact) OVER (PARTITION BY record_id) AS has FROM c)
    SELECT record_id, min(cbdb_id) AS cbdb_id, has AS exact FROM k WHERE exact OR NOT has GROUP BY record_id, has HAVING count(DISTINCT cbdb_id) = 1"""
)
def authority_hits(spark: SparkSession, d: str) -> DataFrame:
    """Persons of the authority file by a variant of the name or by its end, of a dynasty that agrees; exact hits first, and only where one person is left."""
    asked = stage(_asked(spark, d), "asked")
    h = C.once(spark, d, "cbdb_hit").select("cbdb_id", "matched_string", "dynasty")
    gate = names.compatible(F.col("era"), F.col("dynasty"), DYNASTIES)
    exact = asked.join(h, asked["name"] == h["matched_string"]).where(gate).select("record_id", "cbdb_id", F.lit(True).alias("exact"))
    ends = asked.select("record_id", "era", F.explode(names.ends(F.array("name"), (2, 3))).alias("k")).distinct()
    suffix = ends.join(h, ends["k"] == h["matched_string"]).where(gate).select("record_id", "cbdb_id", F.lit(False).alias("exact"))
    every = exact.unionByName(suffix).groupBy("record_id", "cbdb_id").agg(F.max("exact").alias("exact"))
    best = every.groupBy("record_id").agg(F.max("exact").alias("any"))
    kept = every.join(best, "record_id").where("exact or not any").groupBy("record_id", "any").agg(F.min("cbdb_id").alias("cbdb_id"), F.max("cbdb_id").alias("hi"))
    return kept.where("cbdb_id = hi").select("record_id", "cbdb_id", F.col("any").alias("exact"))


@query(
    f"""SELECT record_id, min(cbdb_id) AS cbdb_id FROM (SELECT record_id, n AS primary_name FROM {_N} WHERE regexp_matches(time_dynasty, '[明清]')) JOIN (SELECT DISTINCT cbdb_id, translate(primary_name, '傳邱脩于', '傅丘修於') AS primary_name FROM {C._CBDB} WHERE regexp_matches(dynasty, '[明清]') AND primary_name <> '') USING (primary_name) GROUP BY 1 HAVING count(DISTINCT cbdb_id) = 1"""
)
def late_persons(spark: SparkSession, d: str) -> DataFrame:
    """Persons of the last two dynasties taken as one class, by primary name, where one answers."""
    a = C.authorships(spark, d).where("coalesce(person_name, '') <> ''").where(F.col("time_dynasty").rlike("[明清]")).select("record_id", normal("person_name").alias("primary_name"))
    h = C.once(spark, d, "cbdb_hit", "primary_name <> ''").where(F.col("dynasty").rlike("[明清]")).select("cbdb_id", F.translate("primary_name", "".join(VARIANTS), "".join(VARIANTS.values())).alias("primary_name")).distinct()
    return resolve.unique_only(a.join(h, "primary_name"), ["record_id"], "cbdb_id").select("record_id", "cbdb_id")


@query(
    f"""WITH b AS (SELECT title, unnest(authorship) AS a FROM {C._WORK} WHERE coalesce(title, '') <> ''), r AS (SELECT title, a.record_id AS record_id, a.person_name AS name, a.cbdb_id AS cbdb_id FROM b WHERE coalesce(a.person_name, '') <> ''),
    k AS (SELECT DISTINCT title, name, cbdb_id FROM r WHERE coalesce(cbdb_id, '') <> ''), q AS (SELECT * FROM r WHERE coalesce(cbdb_id, '') = '')
    SELECT q.record_id, min(k.cbdb_id) AS cbdb_id, string_agg(DISTINCT q.title, '|') AS title FROM q JOIN k USING (title) WHERE q.name = k.name OR ends_with(q.name, k.name) OR ends_with(k.name, q.name) GROUP BY q.record_id HAVING count(DISTINCT k.cbdb_id) = 1"""
)
def text_authors(spark: SparkSession, d: str) -> DataFrame:
    """Persons known as authors of a text of the same title whose name is that of the record or ends like it, where one is left."""
    r = C.works(spark, d).where("coalesce(title, '') <> ''").select("title", F.explode("authorship").alias("a")).select("title", "a.record_id", F.col("a.person_name").alias("name"), "a.cbdb_id").where("coalesce(name, '') <> ''")
    k = r.where("coalesce(cbdb_id, '') <> ''").select("title", F.col("name").alias("k_name"), "cbdb_id").distinct()
    q = r.where("coalesce(cbdb_id, '') = ''").select("title", "record_id", "name")
    fits = (F.col("name") == F.col("k_name")) | F.col("name").endswith(F.col("k_name")) | F.col("k_name").endswith(F.col("name"))
    got = q.join(k, "title").where(fits).groupBy("record_id").agg(F.min("cbdb_id").alias("cbdb_id"), F.max("cbdb_id").alias("hi"), F.array_join(F.collect_set("title"), "|").alias("title"))
    return got.where("cbdb_id = hi").drop("hi")


@query(f"SELECT record_id, arg_min_null(cbdb_id, (ord, label_ord, cbdb_id)) AS cbdb_id, min(ord) AS ord FROM (SELECT record_id, ord, unnest(l) AS dynasty, unnest(range(len(l))) AS label_ord, name FROM (SELECT *, {_LABELS_SQL.format('era')} AS l FROM {_ASKED} WHERE coalesce(era, '') <> '')) a JOIN {C._CBDB} h ON h.matched_string = a.name AND h.dynasty = a.dynasty GROUP BY 1")
def first_probes(spark: SparkSession, d: str) -> DataFrame:
    """The first answer to a probe by variant and then by dynasty label, both in their order."""
    a = _asked(spark, d).where("coalesce(era, '') <> ''").select("record_id", "ord", "name", F.posexplode(names.labels_of(F.col("era"), DYNASTIES)).alias("label_ord", "dynasty"))
    h = C.once(spark, d, "cbdb_hit").select("cbdb_id", F.col("matched_string").alias("name"), "dynasty")
    return a.join(h, ["name", "dynasty"]).groupBy("record_id").agg(F.min_by("cbdb_id", F.struct("ord", "label_ord", "cbdb_id")).alias("cbdb_id"), F.min("ord").alias("ord"))


@query(f"SELECT record_id, coalesce(a.id, b.id) AS cbdb_id, CASE WHEN a.id IS NOT NULL THEN 'dynasty' WHEN b.id IS NOT NULL THEN 'name' END AS via FROM (SELECT record_id, person_name AS name, {C.era_sql('time_dynasty')} AS era FROM {C._AUTHOR} WHERE coalesce(person_name, '') <> '') r LEFT JOIN (SELECT matched_string AS name, dynasty AS era, min(cbdb_id) AS id FROM {C._CBDB} GROUP BY ALL) a ON a.name = r.name AND a.era = r.era LEFT JOIN (SELECT matched_string AS name, min(cbdb_id) AS id FROM {C._CBDB} GROUP BY ALL) b ON b.name = r.name")
def looked_up_persons(spark: SparkSession, d: str) -> DataFrame:
    """The row of name and dynasty, else that of the name."""
    r = C.authorships(spark, d).where("coalesce(person_name, '') <> ''").select("record_id", F.col("person_name").alias("name"), T.label_in(F.col("time_dynasty"), C.ERAS).alias("era"))
    h = C.once(spark, d, "cbdb_hit").select(F.col("matched_string").alias("name"), F.col("dynasty").alias("era"), "cbdb_id")
    a, b = h.groupBy("name", "era").agg(F.min("cbdb_id").alias("a")), h.groupBy("name").agg(F.min("cbdb_id").alias("b"))
    full = r.join(a, ["name", "era"], "left").join(b, "name", "left")
    return full.select("record_id", F.coalesce("a", "b").alias("cbdb_id"), F.when(F.col("a").isNotNull(), "dynasty").when(F.col("b").isNotNull(), "name").alias("via"))


@query(
    f"""WITH a AS (SELECT record_id, kr_id, NULLIF(cbdb_id, '') AS own, person_name AS name, NULLIF({C.era_sql('time_dynasty')}, '') AS era, TRY_CAST(author_index AS INTEGER) AS i FROM {C._AUTHOR} WHERE coalesce(person_name, '') <> ''),
    h AS (SELECT cbdb_id, matched_string AS name, NULLIF(dynasty, '') AS era FROM {C._CBDB}), k AS (SELECT kr_id, name, own FROM a WHERE own IS NOT NULL),
    s1 AS (SELECT record_id, own AS target, 'own id' AS stage FROM a WHERE own IS NOT NULL), l1 AS (SELECT * FROM a WHERE own IS NULL),
    s2 AS (SELECT record_id, min(k.own) AS target, 'same work' AS stage FROM l1 JOIN k USING (kr_id) WHERE ends_with(k.name, l1.name) OR ends_with(l1.name, k.name) GROUP BY record_id HAVING count(DISTINCT k.own) = 1), l2 AS (SELECT * FROM l1 WHERE record_id NOT IN (SELECT record_id FROM s2)),
    s3 AS (SELECT record_id, min(cbdb_id) AS target, 'name and dynasty' AS stage FROM l2 JOIN h USING (name, era) GROUP BY record_id HAVING count(DISTINCT cbdb_id) = 1), l3 AS (SELECT * FROM l2 WHERE record_id NOT IN (SELECT record_id FROM s3)),
    s4 AS (SELECT record_id, min(cbdb_id) AS target, 'name alone' AS stage FROM l3 JOIN h USING (name) GROUP BY record_id HAVING count(DISTINCT cbdb_id) = 1), l4 AS (SELECT * FROM l3 WHERE record_id NOT IN (SELECT record_id FROM s4)),
    s5 AS (SELECT record_id, min(k.own) AS target, 'other work' AS stage FROM l4 JOIN (SELECT DISTINCT name, own FROM k) k USING (name) GROUP BY record_id HAVING count(DISTINCT k.own) = 1), l5 AS (SELECT * FROM l4 WHERE record_id NOT IN (SELECT record_id FROM s5)),
    s6 AS (SELECT record_id, min(cbdb_id) AS target, 'end of name' AS stage FROM l5 JOIN h ON length(l5.name) > 2 AND h.name = right(l5.name, 2) GROUP BY record_id HAVING count(DISTINCT cbdb_id) = 1)
    SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5 UNION ALL SELECT * FROM s6"""
)
def author_table(spark: SparkSession, d: str) -> DataFrame:
    """Authority ids in six stages, each for those that none before resolved and only where one id answers."""
    a = C.authorships(spark, d).where("coalesce(person_name, '') <> ''").select("record_id", "kr_id", given("cbdb_id").alias("own"), F.col("person_name").alias("name"), F.nullif(T.label_in(F.col("time_dynasty"), C.ERAS), F.lit("")).alias("era"))
    a = stage(a, "authors")
    h = stage(C.once(spark, d, "cbdb_hit").select(F.col("cbdb_id").alias("target"), F.col("matched_string").alias("name"), given("dynasty").alias("era")), "cbdb")
    known = a.where("own is not null").select("kr_id", F.col("name").alias("k_name"), F.col("own").alias("target"))
    ends_alike = F.col("k_name").endswith(F.col("name")) | F.col("name").endswith(F.col("k_name"))
    one = lambda x: resolve.unique_only(x, ["record_id"], "target")
    return resolve.cascade(
        a,
        "record_id",
        [
            ("own id", lambda x: x.where("own is not null").select("record_id", F.col("own").alias("target"))),
            ("same work", lambda x: one(x.join(known, "kr_id").where(ends_alike))),
            ("name and dynasty", lambda x: one(x.join(h, ["name", "era"]))),
            ("name alone", lambda x: one(x.join(h.drop("era"), "name"))),
            ("other work", lambda x: one(x.join(known.select(F.col("k_name").alias("name"), "target").distinct(), "name"))),
            ("end of name", lambda x: one(x.where("length(name) > 2").withColumn("end", F.right("name", F.lit(2))).join(h.select(F.col("name").alias("end"), "target"), "end"))),
        ],
    ).select("record_id", "target", "stage")


# tiers, choices, scores


@query(
    f"""WITH l AS (SELECT record_id, kr_id, person_name AS name, coalesce(function, '') AS role, {C.era_sql("coalesce(time_dynasty, '')")} AS era FROM {C._AUTHOR} WHERE coalesce(person_name, '') <> ''), r AS (SELECT cbdb_id, matched_string AS name, primary_name, coalesce(dynasty, '') AS era FROM {C._CBDB}),
    t1 AS (SELECT record_id, min(cbdb_id) AS hit, count(DISTINCT cbdb_id) AS n FROM l JOIN r USING (name, era) WHERE primary_name = name GROUP BY 1), t2 AS (SELECT record_id, min(cbdb_id) AS hit, count(DISTINCT cbdb_id) AS n FROM l JOIN r USING (name, era) GROUP BY 1), t3 AS (SELECT record_id, min(cbdb_id) AS hit, count(DISTINCT cbdb_id) AS n FROM l JOIN r USING (name) GROUP BY 1)
    SELECT record_id, CASE WHEN t1.n IS NOT NULL THEN 'B' WHEN t2.n IS NOT NULL THEN 'C' WHEN t3.n IS NOT NULL THEN 'D' ELSE 'none' END AS tier, coalesce(t1.hit, t2.hit, t3.hit) AS hit, coalesce(t1.n, t2.n, t3.n, 0) AS n, coalesce(coalesce(t1.n, t2.n, t3.n) > 1, false) AS ambiguous FROM l LEFT JOIN t1 USING (record_id) LEFT JOIN t2 USING (record_id) LEFT JOIN t3 USING (record_id)"""
)
def tiered_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches in tiers of fewer and fewer equal fields; the first of several is kept and marked as ambiguous."""
    l = C.authorships(spark, d).where("coalesce(person_name, '') <> ''").select("record_id", F.col("person_name").alias("name"), T.label_in(F.coalesce("time_dynasty", F.lit("")), C.ERAS).alias("era"))
    r = C.once(spark, d, "cbdb_hit").select("cbdb_id", F.col("matched_string").alias("name"), "primary_name", F.coalesce("dynasty", F.lit("")).alias("era"))
    tier = lambda keys, rows, t: l.join(rows, keys).groupBy("record_id").agg(F.struct(F.lit(t).alias("tier"), F.min("cbdb_id").alias("hit"), F.countDistinct("cbdb_id").alias("n")).alias(t))
    full = l.select("record_id")
    for t, keys, rows in (("B", ["name", "era"], r.where("primary_name = name")), ("C", ["name", "era"], r), ("D", ["name"], r.drop("era"))):
        full = full.join(tier(keys, rows, t), "record_id", "left")
    best = full.select("record_id", F.coalesce("B", "C", "D").alias("m"))
    return best.select("record_id", F.coalesce("m.tier", F.lit("none")).alias("tier"), "m.hit", F.coalesce("m.n", F.lit(0)).alias("n"), F.coalesce(F.col("m.n") > 1, F.lit(False)).alias("ambiguous"))


@query(f"SELECT r.record_id, max_by(h.cbdb_id, (score, h.cbdb_id)) AS best, max(score) AS score FROM {_ASKED} r JOIN (SELECT *, 0 AS z FROM {C._CBDB}) h ON h.matched_string = r.name, LATERAL (SELECT CASE WHEN h.primary_name = r.name THEN 10 ELSE 5 END + CASE WHEN coalesce(h.dynasty, '') <> '' AND h.dynasty = {C.era_sql('r.era')} THEN 2 ELSE 0 END AS score) WHERE score >= 7 GROUP BY 1")
def scored_persons(spark: SparkSession, d: str) -> DataFrame:
    """The best namesake by points for the kind of name and for the dynasty, if it has enough of them."""
    r = _asked(spark, d)
    h = C.once(spark, d, "cbdb_hit").select("cbdb_id", F.col("matched_string").alias("name"), "primary_name", "dynasty")
    points = F.when(F.col("primary_name") == F.col("name"), 10).otherwise(5) + F.when((F.col("dynasty") != "") & (F.col("dynasty") == T.label_in(F.col("era"), C.ERAS)), 2).otherwise(0)
    return r.join(h, "name").withColumn("score", points).where("score >= 7").groupBy("record_id").agg(F.max_by("cbdb_id", F.struct("score", "cbdb_id")).alias("best"), F.max("score").alias("score"))


@query(f"SELECT title, person, works FROM (SELECT title, a.person_name AS person, count(DISTINCT kr_id) AS works FROM (SELECT kr_id, title, unnest(authorship) AS a FROM {C._WORK} WHERE coalesce(title, '') <> '') WHERE coalesce(a.person_name, '') <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY title ORDER BY works DESC, person) <= 3")
def suggested_authors(spark: SparkSession, d: str) -> DataFrame:
    """For each title at most three authors, those of most works first: the limit is the feature."""
    g = C.works(spark, d).where("coalesce(title, '') <> ''").select("kr_id", "title", F.explode("authorship").alias("a")).select("kr_id", "title", F.col("a.person_name").alias("person")).where("coalesce(person, '') <> ''").groupBy("title", "person").agg(F.countDistinct("kr_id").alias("works"))
    return merge.numbered(g, ["title"], [F.desc("works"), F.col("person")]).where("n <= 3").select("title", "person", "works")


@query(f"SELECT kr_id, coalesce(min_by(file_id, (n, file_id)) FILTER (contains(title, '十')), min_by(file_id, (n, file_id)) FILTER (n = '2'), min_by(file_id, (n, file_id))) AS chosen FROM {C._JUAN} GROUP BY 1")
def chosen_files(spark: SparkSession, d: str) -> DataFrame:
    """Of each work the first file whose title holds the text asked for, else the one of the number, else the first."""
    at = F.struct("n", "file_id")
    pick = lambda c: F.min_by("file_id", F.when(c, at))
    return C.once(spark, d, "juan_file").groupBy("kr_id").agg(F.coalesce(pick(F.contains("title", F.lit("十"))), pick(F.col("n") == "2"), F.min_by("file_id", at)).alias("chosen"))


@query(f"SELECT k.work_id, x.file, e.id IS NULL AS missing, CAST(row_number() OVER (PARTITION BY k.work_id ORDER BY x.file) AS INTEGER) AS pos FROM (SELECT work_id, unnest(files) AS file FROM {C._CATALOG}) x JOIN {C._CATALOG} k USING (work_id) LEFT JOIN (SELECT min(id) AS id, file_title FROM {C._CORPUS} GROUP BY 2) e ON e.file_title = k.title")
def resolved_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of each work in order, marked where the corpus has no text of the work's title."""
    k = C.once(spark, d, "catalog_hit").select("work_id", F.col("title").alias("file_title"), F.posexplode(F.sort_array("files")).alias("p", "file"))
    e = C.once(spark, d, "corpus_entry").groupBy("file_title").agg(F.min("id").alias("id"))
    return k.join(e, "file_title", "left").select("work_id", "file", F.col("id").isNull().alias("missing"), (F.col("p") + 1).alias("pos"))


@query(f"SELECT canon || core AS grp, count(*) AS files, count(DISTINCT vol) AS volumes, bool_or(trail <> '') AS lettered, min(vol) AS first_vol FROM (SELECT regexp_extract(f, '^([A-Z]+)[0-9]+n', 1) AS canon, CAST(regexp_extract(f, '^[A-Z]+([0-9]+)n', 1) AS INTEGER) AS vol, lpad(regexp_extract(f, 'n([0-9]+)[a-zA-Z]?$', 1), 4, '0') AS core, regexp_extract(f, 'n[0-9]+([a-zA-Z]?)$', 1) AS trail FROM (SELECT unnest(files) AS f FROM {C._CATALOG})) GROUP BY 1")
def stem_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files put together into works by canon and number."""
    f = C.once(spark, d, "catalog_hit").select(F.explode("files").alias("f"))
    x = lambda p: F.regexp_extract("f", p, 1)
    p = f.select(x("^([A-Z]+)[0-9]+n").alias("canon"), x("^[A-Z]+([0-9]+)n").cast("int").alias("vol"), F.lpad(x("n([0-9]+)[a-zA-Z]?$"), 4, "0").alias("core"), x("n[0-9]+([a-zA-Z]?)$").alias("trail"))
    return p.groupBy(F.concat("canon", "core").alias("grp")).agg(F.count("*").alias("files"), F.countDistinct("vol").alias("volumes"), F.bool_or(F.col("trail") != "").alias("lettered"), F.min("vol").alias("first_vol"))


@query(
    f"""WITH l AS (SELECT kr_id, a.person_name AS name, min(TRY_CAST(a.author_index AS INTEGER)) AS i, arg_min_null(a.function, a.record_id) AS role FROM (SELECT kr_id, unnest(authorship) AS a FROM {C._WORK}) WHERE coalesce(a.person_name, '') <> '' GROUP BY 1, 2),
    r AS (SELECT DISTINCT kr_id, matched_string AS name FROM (SELECT kr_id, a.cbdb_id AS id FROM (SELECT kr_id, unnest(authorship) AS a FROM {C._WORK}) WHERE coalesce(a.cbdb_id, '') <> '') JOIN {C._CBDB} ON cbdb_id = id),
    m AS (SELECT coalesce(l.kr_id, r.kr_id) AS kr_id, coalesce(l.name, r.name) AS name, coalesce(l.role, '') AS role, coalesce(i, 999) AS i FROM l FULL JOIN r ON l.kr_id = r.kr_id AND l.name = r.name)
    SELECT kr_id, name, role, CAST(row_number() OVER (PARTITION BY kr_id ORDER BY i, name) AS INTEGER) AS pos FROM m"""
)
def merged_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors of a work and the other names of those it knows, the work's own first, numbered anew."""
    a = C.authorships(spark, d)
    l = a.where("coalesce(person_name, '') <> ''").groupBy("kr_id", F.col("person_name").alias("name")).agg(F.min(F.expr("try_cast(author_index as int)")).alias("i"), F.min_by("function", "record_id").alias("role"))
    r = a.where("coalesce(cbdb_id, '') <> ''").select("kr_id", "cbdb_id").join(C.once(spark, d, "cbdb_hit").select("cbdb_id", F.col("matched_string").alias("name")), "cbdb_id").select("kr_id", "name").distinct()
    m = l.join(r, ["kr_id", "name"], "full_outer").select("kr_id", "name", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("i", F.lit(999)).alias("i"))
    return merge.numbered(m, ["kr_id"], ["i", "name"], "pos").select("kr_id", "name", "role", "pos")


# plans of what to apply


_ROW = f"(SELECT record_id, person_name AS name, coalesce(time_dynasty, '') AS era, coalesce(function, '') AS role, coalesce(cbdb_id, '') AS own, kr_id FROM {C._AUTHOR})"


def _apply_rows(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(c, F.lit(""))
    return C.authorships(spark, d).select("record_id", F.col("person_name").alias("name"), e("time_dynasty").alias("era"), e("function").alias("role"), e("cbdb_id").alias("own"), "kr_id")


@query(f"SELECT record_id, CASE WHEN coalesce(name, '') = '' THEN 'skip' WHEN own <> '' THEN 'link' WHEN h.n = 1 THEN 'suggest' WHEN h.n > 1 THEN 'review' ELSE 'create' END AS action FROM {_ROW} LEFT JOIN (SELECT matched_string AS name, count(DISTINCT cbdb_id) AS n FROM {C._CBDB} GROUP BY 1) h USING (name)")
def apply_actions(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each record, the first rule that holds."""
    h = C.once(spark, d, "cbdb_hit").groupBy(F.col("matched_string").alias("name")).agg(F.countDistinct("cbdb_id").alias("n"))
    act = F.when(F.coalesce("name", F.lit("")) == "", "skip").when(F.col("own") != "", "link").when(F.col("n") == 1, "suggest").when(F.col("n") > 1, "review").otherwise("create")
    return _apply_rows(spark, d).join(h, "name", "left").select("record_id", act.alias("action"))


@query(f"SELECT action, count(*) AS n FROM ({SQL['apply_actions']}) GROUP BY 1")
def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return apply_actions(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query(f"SELECT 'a' || lpad(CAST(1000 + row_number() OVER (ORDER BY record_id) AS VARCHAR), 8, '0') AS id, record_id, name, concat_ws('|', NULLIF(era, ''), name, NULLIF(role, '')) AS asked FROM {_ROW} WHERE coalesce(name, '') <> '' AND own = '' AND name NOT IN (SELECT matched_string FROM {C._CBDB} WHERE matched_string IS NOT NULL)")
def new_records(spark: SparkSession, d: str) -> DataFrame:
    """Records for persons that the authority file does not cover, numbered on from a start over all rows, in parallel."""
    covered = C.once(spark, d, "cbdb_hit").select(F.col("matched_string").alias("name"))
    left = _apply_rows(spark, d).where("coalesce(name, '') <> '' and own = ''").join(covered, "name", "left_anti")
    n = merge.dense_numbers(left, F.col("record_id"), "no")
    return n.select(F.concat(F.lit("a"), F.lpad((F.col("no") + 1000).cast("string"), 8, "0")).alias("id"), "record_id", "name", F.concat_ws("|", given("era"), "name", given("role")).alias("asked"))


@query(f"SELECT w.kr_id, coalesce(NULLIF(p.title, ''), w.title) AS title, coalesce(NULLIF(p.dynasty, ''), w.time_dynasty) AS dynasty, p.id IS NOT NULL AS corrected FROM {C._WORK} w LEFT JOIN (SELECT no, entry AS id, c_title AS title, c_dynasty AS dynasty FROM {_FIRST_CN}) p ON p.no = {_NO.format('w.dzid')}")
def corrected_works(spark: SparkSession, d: str) -> DataFrame:
    """Works with corrections laid over them where a correction says something."""
    return C.works(spark, d).select("kr_id", "title", "time_dynasty", number("dzid").alias("no")).join(numbered(spark, d), "no", "left").select("kr_id", F.coalesce(given("c_title"), F.col("title")).alias("title"), F.coalesce(given("c_dynasty"), F.col("time_dynasty")).alias("dynasty"), F.col("entry").isNotNull().alias("corrected"))


_META = ("title", "vols", "source", "edition_label", "edition_date", "time_dynasty")


@query("SELECT kr_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN '{c}=' || {c} END" for c in _META) + f"], lambda x: x IS NOT NULL), ';') AS payload FROM {C._WORK}")
def payloads(spark: SparkSession, d: str) -> DataFrame:
    """Fields and values of each work's record, empty ones dropped."""
    pairs = F.array(*[F.when(F.length(c) > 0, F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in _META])
    kept = F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull()))
    return C.works(spark, d).select("kr_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("payload"))


@query(f"SELECT record_id, {C.era_sql("coalesce(time_dynasty, '')")} || '|' || left(kr_id, 3) || '|' || coalesce(person_name, '') || '|' || coalesce(function, '') || '|' || coalesce(author_dates, '') AS match_key FROM {C._AUTHOR}")
def full_match_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of five parts for every record; a missing part is empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return C.authorships(spark, d).select("record_id", F.concat_ws("|", T.label_in(e("time_dynasty"), C.ERAS), F.left("kr_id", F.lit(3)), e("person_name"), e("function"), e("author_dates")).alias("match_key"))


@query(f"SELECT qid, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), '|') AS labels FROM (SELECT qid, list_concat([coalesce(wikidata_title, '')], list_transform(coalesce(aliases, []), lambda a: coalesce(a, ''))) AS l FROM {C._ITEM})")
def ordered_labels(spark: SparkSession, d: str) -> DataFrame:
    """Title and aliases of every item in order, once each."""
    every = F.concat(F.array(F.coalesce("wikidata_title", F.lit(""))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit(""))))
    return C.items(spark, d).select("qid", F.array_join(F.array_distinct(F.filter(every, lambda x: F.length(x) > 0)), "|").alias("labels"))


# windows over rows in order


@query(f"SELECT juan_id, max_by(a, (n, -a)) AS span_start, max_by(b, (n, -a)) AS span_end, max(n) AS parts FROM (SELECT juan_id, g, min(a) AS a, max(b) AS b, count(*) AS n FROM (SELECT *, sum(CASE WHEN a > reach + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY juan_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT juan_id, han_start AS a, han_end AS b, max(han_end) OVER (PARTITION BY juan_id ORDER BY han_start, han_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {C._SEG} WHERE kind = 'comm' AND han_start < han_end)) GROUP BY ALL) GROUP BY 1")
def fullest_spans(spark: SparkSession, d: str) -> DataFrame:
    """In each juan the run of commentary, gaps of up to twenty characters bridged, that has most parts."""
    s = C.once(spark, d, "segment", "kind = 'comm' and han_start < han_end").select("juan_id", F.col("han_start").alias("a"), F.col("han_end").alias("b"))
    i = islands.interval_islands(s, ["juan_id"], "a", "b", 20, 1 << 16)
    best = F.struct("parts", -F.col("a"))
    return i.groupBy("juan_id").agg(F.max_by("a", best).alias("span_start"), F.max_by("b", best).alias("span_end"), F.max("parts").alias("parts"))


@query(f"SELECT file, run, min(para_idx) AS first_idx, max(para_idx) AS last_idx, count(*) AS paragraphs, md5(string_agg(text, '' ORDER BY para_idx, para_id)) AS digest FROM (SELECT *, CAST(sum(CASE WHEN para_idx - prev > 21 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY para_idx, para_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, lag(para_idx) OVER (PARTITION BY file ORDER BY para_idx, para_id) AS prev FROM (SELECT * FROM {C._SRC} WHERE coalesce(key, '') <> ''))) GROUP BY 1, 2")
def source_runs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with Han text in runs with gaps of at most 20, and the text of each run."""
    p = C.once(spark, d, "src_para", "coalesce(key, '') <> ''").select("file", "para_idx", "para_id", "text")
    r = islands.gap_islands(p, ["file"], F.col("para_idx"), 21, ["para_id"], C.stretch("para_idx"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_idx", "para_id", "text"))), lambda x: x["text"]), "")
    return r.groupBy("file", F.col("island").alias("run")).agg(F.min("para_idx").alias("first_idx"), F.max("para_idx").alias("last_idx"), F.count("*").alias("paragraphs"), F.md5(text).alias("digest"))


@query(f"SELECT seg_id, string_agg(k, '' ORDER BY i) FILTER (i < 0) AS before, string_agg(k, '' ORDER BY i) FILTER (i > 0) AS behind FROM (SELECT a.seg_id, left(b.kind, 1) AS k, b.rn - a.rn AS i FROM (SELECT seg_id, juan_id, row_number() OVER (PARTITION BY juan_id ORDER BY id) AS rn FROM {C._SEG}) a JOIN (SELECT juan_id, kind, row_number() OVER (PARTITION BY juan_id ORDER BY id) AS rn FROM {C._SEG}) b ON a.juan_id = b.juan_id AND abs(b.rn - a.rn) <= 6) GROUP BY 1")
def context_of_segments(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the six segments on each side."""
    w = Window.partitionBy("juan_id").orderBy("id")
    k = F.left("kind", F.lit(1))
    side = lambda a, b: F.nullif(F.array_join(F.collect_list(k).over(w.rowsBetween(a, b)), ""), F.lit(""))
    return C.once(spark, d, "segment").select("seg_id", side(-6, -1).alias("before"), side(1, 6).alias("behind"))


@query(f"SELECT para_id, prev_id, next_id FROM (SELECT para_id, max(CASE WHEN coalesce(key, '') <> '' THEN para_idx END) OVER (PARTITION BY file ORDER BY para_idx, para_id ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN coalesce(key, '') <> '' THEN para_idx END) OVER (PARTITION BY file ORDER BY para_idx, para_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n, para_idx FROM {C._SRC}), LATERAL (SELECT CASE WHEN para_idx - p <= 5 THEN p END AS prev_id, CASE WHEN n - para_idx <= 5 THEN n END AS next_id)")
def nearest_mapped(spark: SparkSession, d: str) -> DataFrame:
    """The nearest places with Han text at or before and at or behind each paragraph, within five."""
    p = C.once(spark, d, "src_para").select("para_id", "file", "para_idx", F.when(F.length("key") > 0, F.col("para_idx")).alias("at"))
    p = islands.running(p, ["file"], ["para_idx", "para_id"], F.col("at"), "p", "last", part=C.stretch("para_idx"))
    p = islands.next_given(p, ["file"], ["para_idx", "para_id"], F.col("at"), "n", C.stretch("para_idx"))
    n = F.coalesce("at", "n")
    return p.select("para_id", F.when(F.col("para_idx") - F.col("p") <= 5, F.col("p")).alias("prev_id"), F.when(n - F.col("para_idx") <= 5, n).alias("next_id"))


@query(f"SELECT para_id FROM (SELECT *, lead(len) OVER w AS next_len, lead(text) OVER w AS next_text FROM (SELECT *, length(text) AS len FROM {C._SRC} WHERE text IS NOT NULL) WINDOW w AS (PARTITION BY file ORDER BY para_idx, para_id)) JOIN (SELECT file, l[least(len(l) - 1, CAST(floor(0.9 * len(l)) AS INTEGER)) + 1] AS p90 FROM (SELECT file, list_sort(list(length(text))) AS l FROM {C._SRC} WHERE text IS NOT NULL GROUP BY file)) USING (file) WHERE len >= p90 AND next_len <= greatest(floor(0.55 * p90), 12) AND regexp_matches(next_text, '[。！？]$')")
def geometry_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Long paragraphs followed by a short one that ends a sentence, by the lengths of their file."""
    w = Window.partitionBy("file").orderBy("para_idx", "para_id")
    p = C.once(spark, d, "src_para", "text is not null").select("file", "para_idx", "para_id", F.length("text").alias("len"), F.col("text").rlike("[。！？]$").alias("ends"))
    p = p.withColumn("next_len", F.lead("len").over(w)).withColumn("next_ends", F.lead("ends").over(w)).join(C.length_percentiles(spark, d).select("file", "p90"), "file")
    return p.where("len >= p90 and next_ends").where(F.col("next_len") <= F.greatest(F.floor(0.55 * F.col("p90")), F.lit(12))).select("para_id")


@query(f"SELECT juan_id, gram, n, round(n / total, 6) AS share FROM (SELECT juan_id, left(han, 2) AS gram, count(*) AS n, sum(count(*)) OVER (PARTITION BY juan_id) AS total FROM {C._SEG} WHERE kind = 'comm' AND length(han) >= 2 GROUP BY 1, 2) WHERE n >= 2 AND n >= 0.03 * total")
def note_labels(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of two characters that the notes of a juan share often enough."""
    n = C.once(spark, d, "segment", "kind = 'comm' and length(han) >= 2").groupBy("juan_id", F.left("han", F.lit(2)).alias("gram")).agg(F.count("*").alias("n"))
    total = n.groupBy("juan_id").agg(F.sum("n").alias("total"))
    return n.join(total, "juan_id").where("n >= 2 and n >= 0.03 * total").select("juan_id", "gram", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(f"SELECT dz_no, min_by(title, id) FILTER (coalesce(title, '') <> '') AS first_title, max_by(authors, id) FILTER (coalesce(authors, '') <> '') AS last_authors FROM {C._CORPUS} WHERE dz_no IS NOT NULL GROUP BY 1")
def hints_by_number(spark: SparkSession, d: str) -> DataFrame:
    """The first title and the last authors that any entry of a number gives."""
    at = lambda c: F.when(F.length(c) > 0, F.col("id"))
    return C.once(spark, d, "corpus_entry", "dz_no is not null").groupBy("dz_no").agg(F.min_by("title", at("title")).alias("first_title"), F.max_by("authors", at("authors")).alias("last_authors"))


@query(f"SELECT file, slice, min(para_id) AS first_id, count(*) AS paragraphs, coalesce(string_agg(CASE WHEN coalesce(heading, '') <> '' THEN text END, ' — ' ORDER BY para_idx, para_id), '') AS title FROM (SELECT *, CAST(sum(CASE WHEN coalesce(heading, '') <> '' AND NOT prev_heading THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY para_idx, para_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slice FROM (SELECT *, coalesce(lag(coalesce(heading, '') <> '') OVER (PARTITION BY file ORDER BY para_idx, para_id), false) AS prev_heading FROM {C._SRC})) GROUP BY 1, 2")
def heading_slices(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at headings; headings without content between them become one title."""
    p = C.once(spark, d, "src_para").select("file", "para_idx", "para_id", "text", (F.length(F.coalesce("heading", F.lit(""))) > 0).alias("is_heading"))
    order, part = ["para_idx", "para_id"], C.stretch("para_idx")
    p = islands.running(p, ["file"], order, F.col("is_heading"), "prev", "last", own=False, part=part)
    p = islands.running(p, ["file"], order, F.when(F.col("is_heading") & ~F.coalesce("prev", F.lit(False)), 1).otherwise(0), "slice", "sum", part=part)
    heads = F.sort_array(F.collect_list(F.when(F.col("is_heading"), F.struct("para_idx", "para_id", "text"))))
    return p.groupBy("file", "slice").agg(F.min("para_id").alias("first_id"), F.count("*").alias("paragraphs"), F.array_join(F.transform(heads, lambda x: x["text"]), " — ").alias("title"))


@query()
def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    """Items for each work by exact title or, with a score, by a like one; the first of each work is marked."""
    w = C.works(spark, d).where("title is not null").select(F.col("kr_id").alias("subject"), T.title_key(F.col("title")).alias("key"))
    l = C._labels(spark, d).select(F.col("qid").alias("target"), F.col("k").alias("label"))
    return resolve.matched_labels(w, l).select(F.col("subject").alias("kr_id"), F.col("target").alias("qid"), F.round("score", 6).alias("score"), "method", "best")


@query()
def once_used_authors(spark: SparkSession, d: str) -> DataFrame:
    """Persons known for the works of a title given to the records of those works that name none, each once, of the same kind of role first."""
    from tessella.functions.names import role_bucket
    from tessella.plans.scalars import EDITORS

    a = C.works(spark, d).select("kr_id", "title", F.explode("authorship").alias("a")).select("kr_id", "title", "a.record_id", "a.author_index", "a.cbdb_id", role_bucket(F.col("a.function"), EDITORS).alias("role")).withColumn("order", F.expr("coalesce(try_cast(author_index as int), 999)"))
    open_ = a.where("coalesce(cbdb_id, '') = ''")
    known = a.where("coalesce(cbdb_id, '') <> '' and title <> ''").groupBy("title", F.col("cbdb_id").alias("target")).agg(F.min("role").alias("role"), F.min("order").alias("place"))
    offers = open_.select("kr_id", "title").distinct().join(known, "title").select("kr_id", "target", "role", "place")
    return resolve.used_once(open_, offers, "kr_id", "record_id", "order")
