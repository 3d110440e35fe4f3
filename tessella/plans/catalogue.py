"""Queries on the catalogue, authority and text tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import align, blocking, documents, islands, merge, quality, resolve
from tessella.session import stage, table
from tessella.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HAN = T.HAN
MARKS = "。！？；：，、"
ERAS = {"大清": "清", "清代": "清", "清朝": "清", "國朝": "清", "Qing": "清", "明朝": "明", "明代": "明", "皇明": "明", "Ming": "明", "宋朝": "宋", "宋代": "宋", "北宋": "宋", "南宋": "宋", "趙宋": "宋", "Song": "宋", "唐朝": "唐", "唐代": "唐", "李唐": "唐", "Tang": "唐", "元朝": "元", "元代": "元", "蒙元": "元", "Yuan": "元", "漢朝": "漢", "漢代": "漢", "兩漢": "漢", "Han": "漢", "晉代": "晉", "兩晉": "晉", "晋": "晉", "Jin": "晉"}
_ERA_SQL = "CASE " + " ".join(f"WHEN {{0}} = '{a}' THEN '{b}'" for a, b in ERAS.items()) + " ELSE {0} END"


def era_sql(c: str) -> str:
    return _ERA_SQL.replace("{0}", c)


def registrar(queries: dict[str, Query], texts: dict[str, str]) -> Callable[..., Callable[[Query], Query]]:
    """A decorator that enters a query, and the SQL that gives the same rows, under its name."""

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            queries[fn.__name__] = fn
            if sql:
                texts[fn.__name__] = sql
            return fn

        return add

    return query


query = registrar(QUERIES, SQL)


def works(spark: SparkSession, d: str) -> DataFrame:
    return merge.delivered_once(table(spark, d, "work").drop("loaded_at"), ["kr_id"])


def authorships(spark: SparkSession, d: str) -> DataFrame:
    """One row per authorship record, with its work."""
    return works(spark, d).select("kr_id", F.explode("authorship").alias("a")).select("kr_id", "a.*")


_WORK = "(SELECT * FROM work QUALIFY row_number() OVER (PARTITION BY kr_id ORDER BY loaded_at) = 1)"
_AUTHOR = f"(SELECT kr_id, a.* FROM (SELECT kr_id, unnest(authorship) AS a FROM {_WORK}))"
_CORPUS = "(SELECT * FROM corpus_entry QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_CATALOG = "(SELECT * FROM catalog_hit QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY loaded_at) = 1)"
_SRC = "(SELECT * FROM src_para QUALIFY row_number() OVER (PARTITION BY para_id ORDER BY loaded_at) = 1)"
_REF = "(SELECT * FROM ref_para QUALIFY row_number() OVER (PARTITION BY para_id ORDER BY loaded_at) = 1)"
_SEG = "(SELECT * FROM segment QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY loaded_at) = 1)"
_JUAN = "(SELECT * FROM juan_file QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at) = 1)"
_CBDB = "(SELECT * FROM cbdb_hit QUALIFY row_number() OVER (PARTITION BY cbdb_id, matched_string ORDER BY loaded_at) = 1)"
_ITEM = "(SELECT * FROM work_hit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hit_id, loaded_at) = 1)"
_KEYS = {"corpus_entry": ["id"], "catalog_hit": ["work_id"], "src_para": ["para_id"], "ref_para": ["para_id"], "segment": ["seg_id"], "juan_file": ["file_id"], "cbdb_hit": ["cbdb_id", "matched_string"]}


def once(spark: SparkSession, d: str, name: str, where: str = "true") -> DataFrame:
    """A table with every delivery counted once; deliveries agree in content, so where is tested before they are joined."""
    return merge.delivered_once(table(spark, d, name).where(where).drop("loaded_at"), _KEYS[name])


def items(spark: SparkSession, d: str) -> DataFrame:
    """The items behind the hits, whose item fields agree."""
    return merge.delivered_once(table(spark, d, "work_hit").select("qid", "wikidata_title", "aliases", "dynasty_label", "start_year", "end_year", "description"), ["qid"])


def stretch(at: str, size: int = 4096) -> Column:
    """Which stretch of that many numbers a row lies in, for windows that share out a long file."""
    return F.floor(F.col(at) / size)


def _given(c: str) -> str:
    return f"NULLIF(regexp_replace({c}, '^[ \\t\\n\\r　]+|[ \\t\\n\\r　]+$', '', 'g'), '')"


# search and top-k


@query(
    f"""SELECT work_id, title, canon, CASE WHEN lower(work_id) = 'b1' THEN 0 WHEN starts_with(lower(work_id), 'b1') THEN 1 WHEN contains(lower(work_id), 'b1') THEN 2 WHEN contains(lower(coalesce(title, '')), 'b1') THEN 3 ELSE 4 END AS rank
    FROM {_CATALOG} WHERE contains(lower(work_id), 'b1') OR contains(lower(coalesce(title, '')), 'b1') OR contains(lower(coalesce(canon, '')), 'b1') OR contains(lower(coalesce(dynasty, '')), 'b1') OR contains(lower(coalesce(category, '')), 'b1')
    ORDER BY rank, canon, work_id LIMIT 40"""
)
def catalogue_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranked substring search over five columns, 40 best: the limit is the feature."""
    q = "b1"
    rank = [F.lower("work_id") == q, F.lower("work_id").startswith(q), F.contains(F.lower("work_id"), F.lit(q)), F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q))]
    return resolve.ranked_search(once(spark, d, "catalog_hit"), q, ["work_id", "title", "canon", "dynasty", "category"], rank, ["canon", "work_id"], 40).select("work_id", "title", "canon", "rank")


@query(
    f"""SELECT id, dz_no, title, CASE WHEN ltrim(dz_no, '0') = '12' THEN 0 WHEN starts_with(coalesce(title, ''), '12') THEN 1 ELSE 2 END AS rank FROM {_CORPUS}
    WHERE contains(lower(id), '12') OR contains(lower(coalesce(dz_no, '')), '12') OR contains(lower(coalesce(title, '')), '12') OR contains(lower(coalesce(rel_path, '')), '12')
    ORDER BY rank, lpad(coalesce(NULLIF(dz_no, ''), '99999'), 5, '0'), id LIMIT 30"""
)
def corpus_search(spark: SparkSession, d: str) -> DataFrame:
    """Search by number or title, the exact number first, then by padded number."""
    df = once(spark, d, "corpus_entry").withColumn("_no", F.lpad(F.coalesce(F.nullif("dz_no", F.lit("")), F.lit("99999")), 5, "0"))
    rank = [F.ltrim(F.col("dz_no"), F.lit("0")) == "12", F.coalesce("title", F.lit("")).startswith("12")]
    return resolve.ranked_search(df, "12", ["id", "dz_no", "title", "rel_path"], rank, ["_no", "id"], 30).select("id", "dz_no", "title", "rank")


@query(
    f"""WITH a AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(title)), lambda i: substring(title, i, 2))) AS g FROM {_CORPUS}),
    b AS (SELECT DISTINCT work_id, unnest(list_transform(range(1, length(title)), lambda i: substring(title, i, 2))) AS g FROM {_CATALOG}),
    s AS (SELECT id, work_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY ALL)
    SELECT id, work_id, shared, row_number() OVER (PARTITION BY id ORDER BY shared DESC, work_id) AS rank FROM s QUALIFY rank <= 5"""
)
def shared_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus entry the five catalogue titles that share most bigrams."""
    return blocking.top_shared(once(spark, d, "corpus_entry").where(F.length("title") >= 2), once(spark, d, "catalog_hit").where(F.length("title") >= 2), "id", "title", "work_id", "title", k=2, top=5).select("id", "work_id", "shared", "rank")


@query(
    f"""WITH t AS (SELECT kr_id, unnest(list_distinct(list_transform(range(1, length(title)), lambda i: substring(title, i, 2)))) AS g FROM {_WORK} WHERE length(title) >= 2),
    i AS (SELECT qid, unnest(list_distinct(list_transform(range(1, length(wikidata_title)), lambda i: substring(wikidata_title, i, 2)))) AS g FROM {_ITEM} WHERE length(wikidata_title) >= 2),
    c AS (SELECT kr_id, qid, count(*) AS n FROM t JOIN i USING (g) GROUP BY ALL)
    SELECT kr_id, qid, round(n / (a + b - n), 6) AS similarity FROM c JOIN (SELECT kr_id, count(*) AS a FROM t GROUP BY 1) USING (kr_id) JOIN (SELECT qid, count(*) AS b FROM i GROUP BY 1) USING (qid)"""
)
def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Bigram similarity of all works and items that share a bigram, wherever it stands in the titles."""
    t, i = works(spark, d).where(F.length("title") >= 2), items(spark, d).where(F.length("wikidata_title") >= 2)
    shared = blocking.shared_grams(t, i, "kr_id", "title", "qid", "wikidata_title", k=2)
    nt, ni = t.select("kr_id", F.size(T.grams(F.col("title"), 2)).alias("nt")), i.select("qid", F.size(T.grams(F.col("wikidata_title"), 2)).alias("ni"))
    return shared.join(nt, "kr_id").join(ni, "qid").select("kr_id", "qid", F.round(F.col("shared") / (F.col("nt") + F.col("ni") - F.col("shared")), 6).alias("similarity"))


# scalars


@query(
    f"""SELECT para_id, length(k) AS key_length, md5(k) AS key_digest, CASE WHEN k = '' THEN false ELSE row_number() OVER (PARTITION BY k ORDER BY para_id) > 1 END AS duplicate
    FROM (SELECT para_id, regexp_replace(text, '[^{HAN}]', '', 'g') AS k FROM {_SRC} WHERE text IS NOT NULL)"""
)
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    """Comparison keys of paragraphs; the first of each key stands, the others are marked."""
    p = once(spark, d, "src_para", "text is not null").select("para_id", T.para_key(F.col("text")).alias("k"))
    first = p.where("k <> ''").groupBy("k").agg(F.min("para_id").alias("first"))
    return p.join(first, "k", "left").select("para_id", F.length("k").alias("key_length"), F.md5("k").alias("key_digest"), F.coalesce(F.col("para_id") != F.col("first"), F.lit(False)).alias("duplicate"))


@query(f"SELECT kr_id, regexp_replace(title, '[\\p{{P}}\\p{{Z}}\\sA-Za-zＡ-Ｚａ-ｚ]', '', 'g') AS key FROM {_WORK}")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).select("kr_id", T.title_key(F.col("title")).alias("key"))


@query(
    f"""SELECT record_id, TRY_CAST(NULLIF(regexp_extract(author_dates, '{(p := "^[ ]*(-?[0-9]{1,4})[?]?[ ]*[-–—][ ]*(-?[0-9]{1,4})[?]?[ ]*$")}', 1), '') AS INTEGER) AS born,
    TRY_CAST(NULLIF(regexp_extract(author_dates, '{p}', 2), '') AS INTEGER) AS died FROM {_AUTHOR}"""
)
def date_spans(spark: SparkSession, d: str) -> DataFrame:
    """Years of birth and death from dates as written."""
    return authorships(spark, d).select("record_id", T.year_span(F.col("author_dates")).alias("y")).select("record_id", F.col("y.first").alias("born"), F.col("y.last").alias("died"))


@query(f"SELECT kr_id, CASE WHEN regexp_extract(vols, '([0-9]+)', 1) <> '' THEN regexp_extract(vols, '([0-9]+)', 1) ELSE vols END AS extent, coalesce('DZ' || lpad(CAST(TRY_CAST(NULLIF(regexp_extract(dzid, '^[^0-9]*([0-9]+)([.]0+)?$', 1), '') AS INTEGER) AS VARCHAR), 4, '0'), '') AS dz FROM {_WORK} WHERE dzid IS NOT NULL")
def extents_and_ids(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).where("dzid is not null").select("kr_id", T.extent(F.col("vols")).alias("extent"), T.padded_id(F.col("dzid"), "DZ").alias("dz"))


@query(
    f"""WITH n AS (SELECT i AS v, CASE WHEN i < 10 THEN substring('一二三四五六七八九', i, 1) WHEN i < 20 THEN '十' || CASE WHEN i % 10 = 0 THEN '' ELSE substring('一二三四五六七八九', i % 10, 1) END
    ELSE substring('一二三四五六七八九', i // 10, 1) || '十' || CASE WHEN i % 10 = 0 THEN '' ELSE substring('一二三四五六七八九', i % 10, 1) END END AS s FROM range(1, 100) t(i))
    SELECT file_id, CAST(v AS INTEGER) AS number FROM {_JUAN} LEFT JOIN n ON s = regexp_extract(title, '卷([一二三四五六七八九十]+)$', 1)"""
)
def juan_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written in Han numerals behind 卷."""
    j = once(spark, d, "juan_file").withColumn("n", F.regexp_extract("title", "卷([一二三四五六七八九十]+)$", 1))
    return j.select("file_id", F.when(F.col("n") != "", T.numeral(F.col("n"))).alias("number"))


@query(f"SELECT id, 'dz' || lpad(coalesce(dz_no, ''), 4, '0') || '-' || substring(sha1(rel_path), 1, 12) AS made, split_part(rel_path, '/', 1) AS root, split_part(rel_path, '/', 1) = '目錄' AS catalogue FROM {_CORPUS} WHERE rel_path IS NOT NULL")
def entry_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids made from number and path; rows of the catalogue folder are marked."""
    root = F.split("rel_path", "/")[0]
    return once(spark, d, "corpus_entry", "rel_path is not null").select("id", F.concat(F.lit("dz"), F.lpad(F.coalesce("dz_no", F.lit("")), 4, "0"), F.lit("-"), F.left(F.sha1("rel_path"), F.lit(12))).alias("made"), root.alias("root"), (root == "目錄").alias("catalogue"))


_SP = "[ \\t\\n\\r　]"


def _core_sql(c: str) -> str:
    """What person_core does, in SQL."""
    trim = f"regexp_replace({{0}}, '^{_SP}+|{_SP}+$', '', 'g')"
    c = f"regexp_replace({trim.format(c)}, '[\\s　]*等$', '')"
    c = f"regexp_replace({c}, '[（(][^（）()]*[)）]$', '')"
    c = f"regexp_replace({trim.format(c)}, '^[（(〔\\[][^（）()〔〕\\[\\]]{{{{1,3}}}}[)）〕\\]]', '')".replace("{{1,3}}", "{1,3}")
    return trim.format(c)


@query(f"SELECT record_id, {era_sql('time_dynasty')} AS era, {_core_sql('person_name')} AS core FROM {_AUTHOR} WHERE person_name IS NOT NULL")
def person_cores(spark: SparkSession, d: str) -> DataFrame:
    """Names of all authorship records without what people add to them, and dynasties under one label."""
    a = authorships(spark, d).where(F.col("person_name").isNotNull())
    return a.select("record_id", T.label_in(F.col("time_dynasty"), ERAS).alias("era"), T.person_core(F.col("person_name")).alias("core"))


# arrays and structs


@query(f"SELECT kr_id, array_to_string(list_transform(list_filter(authorship, lambda a: coalesce(a.person_name, '') <> ''), lambda a: a.person_name || CASE WHEN coalesce(a.function, '') <> '' THEN '（' || a.function || '）' ELSE '' END), '、') AS authors FROM {_WORK} WHERE len(list_filter(authorship, lambda a: coalesce(a.person_name, '') <> '')) > 0")
def formatted_authors(spark: SparkSession, d: str) -> DataFrame:
    named = F.filter("authorship", lambda a: F.coalesce(a["person_name"], F.lit("")) != "")
    role = lambda a: F.when(F.coalesce(a["function"], F.lit("")) != "", F.concat(F.lit("（"), a["function"], F.lit("）"))).otherwise("")
    return works(spark, d).where(F.size(named) > 0).select("kr_id", F.array_join(F.transform(named, lambda a: F.concat(a["person_name"], role(a))), "、").alias("authors"))


@query(f"SELECT kr_id, coalesce(NULLIF(time_dynasty, ''), list_extract(list_filter(list_transform(authorship, lambda a: a.time_dynasty), lambda x: coalesce(x, '') <> ''), 1)) AS dynasty FROM {_WORK}")
def entry_dynasties(spark: SparkSession, d: str) -> DataFrame:
    """A work's dynasty: its own, else the first that an author has."""
    told = F.filter(F.transform("authorship", lambda a: a["time_dynasty"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return works(spark, d).select("kr_id", F.coalesce(F.nullif("time_dynasty", F.lit("")), F.try_element_at(told, F.lit(1))).alias("dynasty"))


@query(f"SELECT qid, array_to_string(list_sort(list_distinct(list_filter(list_concat([wikidata_title], coalesce(aliases, [])), lambda x: coalesce(x, '') <> ''))), '|') AS labels FROM {_ITEM} WHERE coalesce(wikidata_title, '') <> ''")
def item_labels(spark: SparkSession, d: str) -> DataFrame:
    every = F.concat(F.array("wikidata_title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return items(spark, d).where("coalesce(wikidata_title, '') <> ''").select("qid", F.array_join(F.sort_array(F.array_distinct(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""))), "|").alias("labels"))


_FIELDS = ["title", "vols", "juan_count", "source", "edition_label", "edition_date", "cbeta_id", "dzid", "time_dynasty", "date_not_before", "date_not_after", "author_dates"]


@query("SELECT kr_id, " + " + ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END" for c in _FIELDS) + f" AS given FROM {_WORK}")
def payload_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many fields a work's record has when empty ones are dropped."""
    pairs = F.create_map(*[x for c in _FIELDS for x in (F.lit(c), F.col(c))])
    return works(spark, d).select("kr_id", F.size(F.map_filter(pairs, lambda k, v: F.coalesce(v, F.lit("")) != "")).alias("given"))


@query(f"SELECT record_id, {era_sql('time_dynasty')} || '|' || coalesce(person_name, '') || '|' || coalesce(function, '') AS match_key FROM {_AUTHOR} WHERE time_dynasty IS NOT NULL")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    return authorships(spark, d).where("time_dynasty is not null").select("record_id", F.concat_ws("|", T.label_in(F.col("time_dynasty"), ERAS), F.coalesce("person_name", F.lit("")), F.coalesce("function", F.lit(""))).alias("match_key"))


# joins


@query(
    f"""SELECT w.kr_id, coalesce({_given('w.title')}, {_given('c.title')}) AS title, coalesce({_given('w.time_dynasty')}, {_given('c.dynasty')}) AS dynasty, coalesce(j.files, 0) AS files, coalesce(a.n, 0) AS authors
    FROM {_WORK} w LEFT JOIN (SELECT CAST(CAST(dz_no AS INTEGER) AS VARCHAR) AS no, min_by(title, id) AS title, min_by(dynasty, id) AS dynasty FROM {_CORPUS} WHERE regexp_matches(dz_no, '^[0-9]+$') GROUP BY 1) c ON c.no = CAST(TRY_CAST(NULLIF(regexp_extract(w.dzid, '^[^0-9]*([0-9]+)([.]0+)?$', 1), '') AS INTEGER) AS VARCHAR)
    LEFT JOIN (SELECT kr_id, count(*) AS files FROM {_JUAN} GROUP BY 1) j ON j.kr_id = w.kr_id LEFT JOIN (SELECT kr_id, count(*) AS n FROM {_AUTHOR} GROUP BY 1) a ON a.kr_id = w.kr_id"""
)
def work_entries(spark: SparkSession, d: str) -> DataFrame:
    """Works joined on the left with catalogue, files and authors; own values before the catalogue's."""
    w = works(spark, d).withColumn("no", F.nullif(F.regexp_extract("dzid", r"^\D*(\d+)(?:\.0+)?$", 1), F.lit("")).cast("int").cast("string"))
    c = merge.first_wins(once(spark, d, "corpus_entry").where(F.col("dz_no").rlike("^[0-9]+$")).select(F.col("dz_no").cast("int").cast("string").alias("no"), "id", F.col("title").alias("c_title"), F.col("dynasty").alias("c_dynasty")), ["no"], ["id"])
    j = once(spark, d, "juan_file").groupBy("kr_id").agg(F.count("*").alias("files"))
    a = authorships(spark, d).groupBy("kr_id").agg(F.count("*").alias("n"))
    full = w.join(c.drop("id"), "no", "left").join(j, "kr_id", "left").join(a, "kr_id", "left")
    return full.select("kr_id", T.first_given(F.col("title"), F.col("c_title")).alias("title"), T.first_given(F.col("time_dynasty"), F.col("c_dynasty")).alias("dynasty"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("n", F.lit(0)).alias("authors"))


@query(
    f"""SELECT title, source, id FROM (SELECT title, 0 AS p, 'catalog' AS source, min(work_id) AS id FROM {_CATALOG} WHERE title <> '' GROUP BY title UNION ALL SELECT title, 1, 'corpus', min(id) FROM {_CORPUS} WHERE title <> '' GROUP BY title
    UNION ALL SELECT title, 2, 'work', min(kr_id) FROM {_WORK} WHERE title <> '' GROUP BY title) QUALIFY row_number() OVER (PARTITION BY title ORDER BY p, id) = 1"""
)
def title_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each title with its id in the first of three sources that has it."""
    a = once(spark, d, "catalog_hit", "title <> ''").select("title", F.lit("catalog").alias("source"), F.col("work_id").alias("id"))
    b = once(spark, d, "corpus_entry", "title <> ''").select("title", F.lit("corpus").alias("source"), "id")
    c = works(spark, d).where("title <> ''").select("title", F.lit("work").alias("source"), F.col("kr_id").alias("id"))
    return merge.priority_union([a, b, c], ["title"], ["id"])


@query(f"SELECT coalesce(a.dynasty, b.dynasty) AS dynasty, coalesce(a.n, 0) AS catalogued, coalesce(b.n, 0) AS held FROM (SELECT dynasty, count(*) AS n FROM {_CATALOG} WHERE dynasty <> '' GROUP BY 1) a FULL JOIN (SELECT dynasty, count(*) AS n FROM {_CORPUS} WHERE dynasty <> '' GROUP BY 1) b ON a.dynasty = b.dynasty")
def dynasty_holdings(spark: SparkSession, d: str) -> DataFrame:
    a = once(spark, d, "catalog_hit", "dynasty <> ''").groupBy("dynasty").agg(F.count("*").alias("catalogued"))
    b = once(spark, d, "corpus_entry", "dynasty <> ''").groupBy("dynasty").agg(F.count("*").alias("held"))
    return a.join(b, "dynasty", "full_outer").select("dynasty", F.coalesce("catalogued", F.lit(0)).alias("catalogued"), F.coalesce("held", F.lit(0)).alias("held"))


_TKEY = "regexp_replace({0}, '[\\p{{P}}\\p{{Z}}\\sA-Za-zＡ-Ｚａ-ｚ]', '', 'g')"
_LABELS = f"(SELECT DISTINCT qid, regexp_replace(l, '[\\p{{P}}\\p{{Z}}\\sA-Za-zＡ-Ｚａ-ｚ]', '', 'g') AS k FROM (SELECT qid, unnest(list_concat([wikidata_title], coalesce(aliases, []))) AS l FROM {_ITEM}) WHERE l IS NOT NULL)"
_TITLES = f"(SELECT kr_id, regexp_replace(title, '[\\p{{P}}\\p{{Z}}\\sA-Za-zＡ-Ｚａ-ｚ]', '', 'g') AS k FROM {_WORK} WHERE title IS NOT NULL)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    every = F.concat(F.array("wikidata_title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return items(spark, d).select("qid", F.explode(every).alias("l")).where("l is not null").select("qid", T.title_key(F.col("l")).alias("k")).where("k <> ''").distinct()


@query(f"SELECT kr_id, qid FROM {_TITLES} JOIN {_LABELS} USING (k) WHERE k <> '' GROUP BY ALL")
def exact_titles(spark: SparkSession, d: str) -> DataFrame:
    """Works and items of one normalised title."""
    w = works(spark, d).where("title is not null").select("kr_id", T.title_key(F.col("title")).alias("k"))
    return w.join(_labels(spark, d), "k").select("kr_id", "qid").distinct()


@query(f"SELECT kr_id, min(qid) AS qid FROM {_TITLES} JOIN {_LABELS} USING (k) WHERE k <> '' GROUP BY kr_id HAVING count(DISTINCT qid) = 1")
def unique_titles(spark: SparkSession, d: str) -> DataFrame:
    """The item of a title, given only where there is exactly one."""
    return resolve.unique_only(exact_titles(spark, d), ["kr_id"], "qid").select("kr_id", "qid")


@query(f"SELECT a.cbdb_id AS whole_id, b.cbdb_id AS part_id, a.primary_name AS whole, b.matched_string AS part FROM (SELECT DISTINCT cbdb_id, primary_name FROM {_CBDB} WHERE primary_name IS NOT NULL) a JOIN {_CBDB} b ON (length(a.primary_name) > 2 AND right(a.primary_name, 2) = b.matched_string) OR (length(a.primary_name) > 3 AND right(a.primary_name, 3) = b.matched_string)")
def suffix_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that end in another name, by an equi-join on their ends."""
    c = once(spark, d, "cbdb_hit")
    ends = resolve.suffix_pairs(c.where("primary_name is not null").select(F.col("cbdb_id").alias("whole_id"), F.col("primary_name").alias("whole")).distinct(), "whole", "part")
    return ends.join(c.select(F.col("cbdb_id").alias("part_id"), F.col("matched_string").alias("part")), "part").select("whole_id", "part_id", "whole", "part")


@query(
    f"""WITH a AS (SELECT record_id, NULLIF(cbdb_id, '') AS own, person_name AS name, NULLIF({era_sql('time_dynasty')}, '') AS era FROM {_AUTHOR} WHERE coalesce(person_name, '') <> ''),
    h AS (SELECT cbdb_id, matched_string AS name, NULLIF(dynasty, '') AS era FROM {_CBDB}),
    s1 AS (SELECT record_id, own AS target, 'own id' AS stage FROM a WHERE own IS NOT NULL),
    s2 AS (SELECT record_id, min(cbdb_id) AS target, 'name and dynasty' AS stage FROM a JOIN h USING (name, era) WHERE record_id NOT IN (SELECT record_id FROM s1) GROUP BY record_id HAVING count(DISTINCT cbdb_id) = 1),
    s3 AS (SELECT record_id, min(cbdb_id) AS target, 'name alone' AS stage FROM a JOIN h USING (name) WHERE record_id NOT IN (SELECT record_id FROM s1) AND record_id NOT IN (SELECT record_id FROM s2) GROUP BY record_id HAVING count(DISTINCT cbdb_id) = 1)
    SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3"""
)
def author_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Authority ids in stages: own id, name with dynasty, name alone; each stage only where one id answers."""
    a = authorships(spark, d).where("coalesce(person_name, '') <> ''").select("record_id", F.nullif("cbdb_id", F.lit("")).alias("own"), F.col("person_name").alias("name"), F.nullif(T.label_in(F.col("time_dynasty"), ERAS), F.lit("")).alias("era"))
    h = stage(once(spark, d, "cbdb_hit").select(F.col("cbdb_id").alias("target"), F.col("matched_string").alias("name"), F.nullif("dynasty", F.lit("")).alias("era")), "cbdb")
    return resolve.cascade(
        stage(a, "authors"),
        "record_id",
        [
            ("own id", lambda x: x.where("own is not null").select("record_id", F.col("own").alias("target"))),
            ("name and dynasty", lambda x: resolve.unique_only(x.join(h, ["name", "era"]), ["record_id"], "target")),
            ("name alone", lambda x: resolve.unique_only(x.join(h.drop("era"), "name"), ["record_id"], "target")),
        ],
    ).select("record_id", "target", "stage")


@query(f"SELECT matched_string AS name, coalesce(dynasty, '') AS era, min(cbdb_id) AS first_id, count(DISTINCT cbdb_id) AS ids FROM {_CBDB} GROUP BY ALL")
def first_id_by_name(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "cbdb_hit").groupBy(F.col("matched_string").alias("name"), F.coalesce("dynasty", F.lit("")).alias("era")).agg(F.min("cbdb_id").alias("first_id"), F.countDistinct("cbdb_id").alias("ids"))


@query(
    f"""WITH o AS (SELECT r.para_id, s.seg_id, least(r.han_end, s.han_end) - greatest(r.han_start, s.han_start) AS shared, s.han_start AS a, s.han_end AS b FROM {_REF} r JOIN {_SEG} s ON r.juan_id = s.juan_id AND r.han_start < s.han_end AND s.han_start < r.han_end)
    SELECT para_id, seg_id, shared FROM o WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY para_id ORDER BY shared DESC, a, b, seg_id) = 1"""
)
def best_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segment that each reference paragraph overlaps most."""
    r = once(spark, d, "ref_para", "han_start < han_end").select("para_id", "juan_id", "han_start", "han_end")
    s = merge.first_wins(once(spark, d, "segment", "han_start < han_end").select("juan_id", F.col("han_start").alias("a"), F.col("han_end").alias("b"), "seg_id"), ["juan_id", "a", "b"], ["seg_id"])
    got = islands.overlap_best(r, s, ["juan_id"], "han_start", "han_end", "a", "b", 64)
    return got.where("best is not null").select("para_id", F.col("best.seg_id").alias("seg_id"), "shared")


@query(f"SELECT file_id, juan_id FROM {_JUAN} WHERE juan_id NOT IN (SELECT juan_id FROM segment WHERE juan_id IS NOT NULL)")
def juan_without_segments(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "juan_file").join(table(spark, d, "segment").select("juan_id"), "juan_id", "left_anti").select("file_id", "juan_id")


@query(f"SELECT file_id, juan_id FROM {_JUAN} WHERE juan_id IN (SELECT juan_id FROM ref_para)")
def juan_with_reference(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "juan_file").join(table(spark, d, "ref_para").select("juan_id"), "juan_id", "left_semi").select("file_id", "juan_id")


# aggregation


@query(f"SELECT coalesce(person_name, '') AS name, coalesce({era_sql('time_dynasty')}, '') AS era, count(*) AS records, count(DISTINCT kr_id) AS works, string_agg(DISTINCT function, ';' ORDER BY function) AS functions FROM {_AUTHOR} GROUP BY 1, 2")
def author_groups(spark: SparkSession, d: str) -> DataFrame:
    g = authorships(spark, d).groupBy(F.coalesce("person_name", F.lit("")).alias("name"), F.coalesce(T.label_in(F.col("time_dynasty"), ERAS), F.lit("")).alias("era"))
    return g.agg(F.count("*").alias("records"), F.countDistinct("kr_id").alias("works"), F.array_join(F.sort_array(F.collect_set("function")), ";").alias("functions"))


@query(f"SELECT kr_id, string_agg(coalesce(person_name, ''), '、' ORDER BY TRY_CAST(author_index AS INTEGER), record_id) AS authors, count(*) AS n FROM {_AUTHOR} GROUP BY 1")
def authors_in_order(spark: SparkSession, d: str) -> DataFrame:
    placed = F.sort_array(F.collect_list(F.struct(F.expr("try_cast(author_index as int)").alias("i"), "record_id", F.coalesce("person_name", F.lit("")).alias("name"))))
    return authorships(spark, d).groupBy("kr_id").agg(placed.alias("p"), F.count("*").alias("n")).select("kr_id", F.array_join(F.transform("p", lambda x: x["name"]), "、").alias("authors"), "n")


@query(
    f"""SELECT count(*) AS works, count(*) FILTER (coalesce(title, '') <> '') AS titled, count(*) FILTER (coalesce(time_dynasty, '') <> '') AS dated, count(*) FILTER (len(authorship) > 0) AS authored, count(*) FILTER (len(authorship) > 1) AS several,
    CAST(sum(len(list_filter(authorship, lambda a: coalesce(a.cbdb_id, '') <> ''))) AS BIGINT) AS identified, count(*) FILTER (coalesce(cbeta_id, '') <> '' OR coalesce(dzid, '') <> '') AS crossed FROM {_WORK}"""
)
def build_statistics(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return works(spark, d).agg(
        F.count("*").alias("works"), F.count_if(has("title")).alias("titled"), F.count_if(has("time_dynasty")).alias("dated"), F.count_if(F.size("authorship") > 0).alias("authored"), F.count_if(F.size("authorship") > 1).alias("several"),
        F.sum(F.size(F.filter("authorship", lambda a: F.coalesce(a["cbdb_id"], F.lit("")) != ""))).alias("identified"), F.count_if(has("cbeta_id") | has("dzid")).alias("crossed"),
    )


@query(f"SELECT dz_no, count(*) AS n, min(id) AS first_id FROM {_CORPUS} WHERE dz_no <> '' GROUP BY 1 HAVING count(*) > 1")
def shared_numbers(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "corpus_entry", "dz_no <> ''").groupBy("dz_no").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query(
    f"SELECT dz_no, " + ", ".join(f"min_by({c}, id) FILTER ({_given(c)} IS NOT NULL) AS {c}" for c in ("title", "section", "dynasty", "authors")) + f" FROM {_CORPUS} WHERE dz_no IS NOT NULL GROUP BY 1"
)
def folded_entries(spark: SparkSession, d: str) -> DataFrame:
    """Per number the first value given in each column, in the order of ids."""
    e = once(spark, d, "corpus_entry", "dz_no is not null").select("dz_no", "id", "title", "section", "dynasty", "authors")
    return merge.first_given_per_column(e, ["dz_no"], ["id"])


@query(f"SELECT work_id, f AS stem, regexp_extract(f, '^([A-Z]+)[0-9]+n', 1) AS canon, CAST(regexp_extract(f, '^[A-Z]+([0-9]+)n', 1) AS INTEGER) AS vol, regexp_extract(f, 'n([0-9]+[a-zA-Z]?)$', 1) AS core, CAST(row_number() OVER (PARTITION BY work_id ORDER BY f) AS INTEGER) AS pos FROM (SELECT work_id, unnest(files) AS f FROM {_CATALOG})")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    """File names of a work in order, taken apart."""
    f = once(spark, d, "catalog_hit").select("work_id", F.posexplode(F.sort_array("files")).alias("p", "stem"))
    return f.select("work_id", "stem", F.regexp_extract("stem", "^([A-Z]+)[0-9]+n", 1).alias("canon"), F.regexp_extract("stem", "^[A-Z]+([0-9]+)n", 1).cast("int").alias("vol"), F.regexp_extract("stem", "n([0-9]+[a-zA-Z]?)$", 1).alias("core"), (F.col("p") + 1).alias("pos"))


# windows


@query(
    f"""WITH s AS (SELECT juan_id, id, han, han_end, id - lag(id) OVER (PARTITION BY juan_id ORDER BY id) AS step FROM {_SEG}), r AS (SELECT *, CAST(sum(CASE WHEN step > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY juan_id ORDER BY id) AS BIGINT) AS island FROM s)
    SELECT juan_id, island, min(id) AS first_id, max(id) AS last_id, count(*) AS segments, CAST(sum(length(coalesce(han, ''))) AS BIGINT) AS chars FROM r GROUP BY 1, 2"""
)
def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of segments without a missing number."""
    runs = islands.gap_islands(once(spark, d, "segment").select("juan_id", "id", F.length(F.coalesce("han", F.lit(""))).alias("han")), ["juan_id"], F.col("id"), 1, part=stretch("id"))
    return runs.groupBy("juan_id", "island").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("segments"), F.sum("han").alias("chars"))


@query(
    f"""WITH s AS (SELECT juan_id, han_start AS a, han_end AS b FROM {_SEG} WHERE kind <> 'head' AND han_start < han_end), t AS (SELECT juan_id, max(han_end) AS total FROM {_SEG} GROUP BY 1),
    m AS (SELECT *, max(b) OVER (PARTITION BY juan_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY juan_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m),
    u AS (SELECT juan_id, g, max(b) - min(a) AS n FROM i GROUP BY 1, 2)
    SELECT t.juan_id, t.total, CAST(coalesce(sum(n), 0) AS BIGINT) AS covered, round(CASE WHEN t.total > 0 THEN coalesce(sum(n), 0) / t.total ELSE 0 END, 6) AS ratio FROM t LEFT JOIN u USING (juan_id) GROUP BY t.juan_id, t.total"""
)
def juan_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each juan its text and commentary segments cover."""
    s = once(spark, d, "segment")
    totals = s.groupBy("juan_id").agg(F.max("han_end").alias("total"))
    got = quality.coverage(s.where("kind <> 'head' and han_start < han_end"), totals, ["juan_id"], "han_start", "han_end", "total", 1 << 16)
    return got.select("juan_id", "total", F.col("covered").cast("long").alias("covered"), F.round("ratio", 6).alias("ratio"))


@query(f"SELECT para_id, last_value(CASE WHEN coalesce(heading, '') <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY file ORDER BY para_idx, para_id ROWS UNBOUNDED PRECEDING) AS under FROM {_SRC}")
def headings_above(spark: SparkSession, d: str) -> DataFrame:
    """The heading each paragraph stands under."""
    p = once(spark, d, "src_para").select("file", "para_idx", "para_id", F.when(F.coalesce("heading", F.lit("")) != "", F.col("text")).alias("h"))
    return islands.carried_forward(p, ["file"], ["para_idx", "para_id"], "h", "under", stretch("para_idx")).select("para_id", "under")


@query(f"SELECT para_id, first_value(CASE WHEN coalesce(heading, '') <> '' THEN para_id END IGNORE NULLS) OVER (PARTITION BY file ORDER BY para_idx, para_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_heading FROM {_SRC}")
def headings_below(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "src_para").select("file", "para_idx", "para_id", "heading")
    return islands.next_given(p, ["file"], ["para_idx", "para_id"], F.when(F.coalesce("heading", F.lit("")) != "", F.col("para_id")), "next_heading", stretch("para_idx")).select("para_id", "next_heading")


@query(
    f"""SELECT seg_id, last_value(CASE WHEN kind = 'comm' THEN seg_id END IGNORE NULLS) OVER (PARTITION BY juan_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS comm_before,
    first_value(CASE WHEN kind = 'comm' THEN seg_id END IGNORE NULLS) OVER (PARTITION BY juan_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS comm_behind FROM {_SEG}"""
)
def nearest_commentary(spark: SparkSession, d: str) -> DataFrame:
    s = once(spark, d, "segment").select("seg_id", "juan_id", "id", F.when(F.col("kind") == "comm", F.col("seg_id")).alias("comm"))
    s = islands.running(s, ["juan_id"], ["id"], F.col("comm"), "comm_before", "last", own=False, part=stretch("id"))
    return islands.next_given(s, ["juan_id"], ["id"], F.col("comm"), "comm_behind", stretch("id")).select("seg_id", "comm_before", "comm_behind")


@query(
    f"""WITH s AS (SELECT juan_id, id, kind, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY juan_id ORDER BY id) THEN 1 ELSE 0 END AS new FROM {_SEG}), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY juan_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM s)
    SELECT juan_id, run, min(kind) AS kind, count(*) AS segments FROM r GROUP BY 1, 2"""
)
def kind_runs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring segments of one kind stitched together."""
    s = islands.value_runs(once(spark, d, "segment").select("juan_id", "id", "kind"), ["juan_id"], ["id"], "kind", part=stretch("id"))
    return s.groupBy("juan_id", "run").agg(F.min("kind").alias("kind"), F.count("*").alias("segments"))


@query(f"SELECT file, len(l) AS paragraphs, l[least(len(l) - 1, CAST(floor(0.9 * len(l)) AS INTEGER)) + 1] AS p90 FROM (SELECT file, list_sort(list(length(text))) AS l FROM {_SRC} WHERE text IS NOT NULL GROUP BY file)")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank 90th percentile of paragraph lengths in each file, by counts of lengths."""
    n = once(spark, d, "src_para", "text is not null").groupBy("file", F.length("text").alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("file").orderBy("len")
    n = n.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(Window.partitionBy("file")))
    at = F.least(F.col("all") - 1, F.floor(0.9 * F.col("all"))) + 1
    return n.where(F.col("upto") >= at).groupBy("file").agg(F.max("all").alias("paragraphs"), F.min("len").alias("p90"))


# documents and quality


@query(f"SELECT seg_id, length(regexp_replace(coalesce(text, ''), '[^{HAN}]', '', 'g')) AS han, len(regexp_extract_all(coalesce(text, ''), '[{MARKS}]')) AS marks FROM {_SEG}")
def punctuation_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return once(spark, d, "segment").select("seg_id", F.length(T.content_only(t)).alias("han"), T.count_matches(t, f"[{MARKS}]").alias("marks"))


@query(f"SELECT para_id, len(list_filter(string_split(regexp_replace(text, '([。！？][」』）”’]{{0,2}})', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '[ \\t\\n\\r　]+', '', 'g') <> '')) AS pieces FROM {_SRC} WHERE text IS NOT NULL")
def plain_sentences(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "src_para", "text is not null").select("para_id", F.size(T.sentences_plain(F.col("text"))).alias("pieces"))


@query(f"SELECT file_id, tag, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(body_xml, '<([A-Za-z][A-Za-z0-9]*)[\\s/>]', 1)) AS tag FROM {_JUAN}) GROUP BY ALL")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents.tag_counts(once(spark, d, "juan_file"), "file_id", "body_xml")


@query("""SELECT doc_id, l AS raw FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS l FROM documents)""")
def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(documents.wiki_links(F.col("text"))).alias("l")).select("doc_id", F.when(F.col("l.target") == F.col("l.label"), F.col("l.target")).otherwise(F.concat_ws("|", "l.target", "l.label")).alias("raw"))


@query("""SELECT doc_id, regexp_replace(regexp_extract(text, '#\\+TITLE:[ \\t]*([^\\n]*)', 1), '[ \\t　]+$', '') AS title, regexp_replace(regexp_extract(text, '#\\+PROPERTY:[ \\t]*ID[ \\t]+([^\\n]*)', 1), '[ \\t　]+$', '') AS id FROM documents WHERE starts_with(text, '#+TITLE')""")
def text_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of line-marked texts."""
    h = table(spark, d, "documents").where(F.col("text").startswith("#+TITLE")).select("doc_id", documents.mandoku_header(F.col("text")).alias("h"))
    return h.select("doc_id", F.col("h")["TITLE"].alias("title"), F.coalesce(F.col("h")["ID"], F.lit("")).alias("id"))


@query(
    f"""SELECT id, array_to_string(list_filter([CASE WHEN coalesce(title, '') <> '' THEN NULL ELSE 'title missing' END, CASE WHEN coalesce(regexp_matches(dz_no, '^[0-9]{{1,4}}$'), false) THEN NULL ELSE 'number malformed' END, CASE WHEN coalesce(bytes > 0, false) THEN NULL ELSE 'empty file' END,
    CASE WHEN coalesce(ends_with(rel_path, '.txt'), false) THEN NULL ELSE 'not a text' END, CASE WHEN coalesce(dynasty, '') <> '' THEN NULL ELSE 'dynasty missing' END], lambda x: x IS NOT NULL), '; ') AS errors FROM {_CORPUS}"""
)
def entry_errors(spark: SparkSession, d: str) -> DataFrame:
    """All that is wrong with each entry."""
    rules = [("title missing", F.coalesce("title", F.lit("")) != ""), ("number malformed", F.col("dz_no").rlike("^[0-9]{1,4}$")), ("empty file", F.col("bytes") > 0), ("not a text", F.col("rel_path").endswith(".txt")), ("dynasty missing", F.coalesce("dynasty", F.lit("")) != "")]
    return quality.validated(once(spark, d, "corpus_entry"), rules).select("id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' AS statement FROM nation")
def insert_statements(spark: SparkSession, d: str) -> DataFrame:
    return writers.insert_statements(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")


@query()
def body_units(spark: SparkSession, d: str) -> DataFrame:
    """Text, commentary and heading units of each body with their Han ranges."""
    return documents.units(once(spark, d, "juan_file").repartition("file_id"), "file_id", "body_xml")


@query()
def note_spans(spark: SparkSession, d: str) -> DataFrame:
    """Bracketed notes of the source paragraphs."""
    return documents.notes(once(spark, d, "src_para", "text is not null"), "para_id", "text")


@query()
def aligned_units(spark: SparkSession, d: str) -> DataFrame:
    """Source paragraphs of the same Han characters for each reference paragraph, the least of equal ones."""
    key = T.para_key(F.col("text"))
    r = once(spark, d, "ref_para", "text is not null").select("para_id", key.alias("k"))
    s = once(spark, d, "src_para", "text is not null").select(F.col("para_id").alias("src_id"), key.alias("k"))
    return r.where("k <> ''").join(s.where("k <> ''").groupBy("k").agg(F.min("src_id").alias("src_id")), "k").select("para_id", "src_id")


SQL["aligned_units"] = f"SELECT r.para_id, min(s.para_id) AS src_id FROM (SELECT para_id, regexp_replace(text, '[^{HAN}]', '', 'g') AS k FROM {_REF}) r JOIN (SELECT para_id, regexp_replace(text, '[^{HAN}]', '', 'g') AS k FROM {_SRC}) s USING (k) WHERE k <> '' GROUP BY 1"


@query()
def carried_punctuation(spark: SparkSession, d: str) -> DataFrame:
    """Reference paragraphs with the punctuation of the source paragraph of the same characters; their Han characters never change."""
    r, s = once(spark, d, "ref_para"), once(spark, d, "src_para")
    pairs = aligned_units(spark, d)
    both = pairs.join(r.select("para_id", F.col("text").alias("target")), "para_id").join(s.select(F.col("para_id").alias("src_id"), F.col("text").alias("source")), "src_id")
    return both.select("para_id", "src_id", documents.with_marks_of(F.col("source"), F.col("target")).alias("text"))


@query()
def tidied_text(spark: SparkSession, d: str) -> DataFrame:
    """Punctuation of the segments tidied to a fixpoint."""
    return once(spark, d, "segment", "text is not null").select("seg_id", documents.tidy(F.col("text")).alias("text"))


@query()
def matched_runs(spark: SparkSession, d: str) -> DataFrame:
    """Common runs of segments of one juan that follow each other."""
    w = Window.partitionBy("juan_id").orderBy("id")
    s = once(spark, d, "segment", "length(han) > 0").select("juan_id", "seg_id", "han", F.lead("han").over(w).alias("next"), F.lead("seg_id").over(w).alias("next_id")).where("next is not null")
    return s.select("seg_id", "next_id", F.size(align.matching_blocks(F.col("han"), F.col("next"))).alias("runs"), F.round(align.sequence_ratio(F.col("han"), F.col("next")), 6).alias("ratio"))
