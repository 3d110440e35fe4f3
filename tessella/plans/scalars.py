"""Queries of the rules on names, ids, titles, lines and pages, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import ids, marks, names
from tessella.functions import text as T
from tessella.plans import catalogue as C
from tessella.session import table

QUERIES: dict[str, C.Query] = {}
SQL: dict[str, str] = {}
query = C.registrar(QUERIES, SQL)

# Tables the rules are run with here.
PREFIXES = ("國朝", "皇清", "皇明", "釋", "沙門", "比丘")
VARIANTS = {"傳": "傅", "邱": "丘", "脩": "修", "于": "於"}
ALIASES = {"東坡居士": "蘇軾", "六一居士": "歐陽修"}
DYNASTIES = {"清": ("大清", "清代", "清朝", "國朝"), "明": ("皇明", "明代", "明朝"), "宋": ("北宋", "南宋", "宋代"), "唐": ("唐代", "李唐"), "元": ("元代", "元朝"), "漢": ("西漢", "東漢", "漢代")}
SURNAMES = ("歐陽", "司馬", "皇甫", "諸葛", "孔", "盧", "袁", "胡", "史", "羅", "釋", "康", "孫", "孟", "任", "郝", "夏", "馮", "彭", "陳", "王", "李", "張", "劉")
READINGS = {"孔": "Kong", "盧": "Lu", "袁": "Yuan", "胡": "Hu", "史": "Shi"}
EDITORS = ("編", "輯", "纂")
SIMPLE = {"书": "書", "杂": "雜", "录": "錄", "记": "記", "诗": "詩", "经": "經", "传": "傳", "论": "論"}
CANONS = ("KR", "T", "X", "U", "N", "D", "J", "P")
RANKS = ("集", "志", "經", "記", "傳", "文集", "詩集")
COURTS = {"漢": 1, "唐": 2, "宋": 3, "元": 4, "明": 5, "清": 6}
VERBS = ("撰", "著", "譯", "注", "編", "輯", "校", "疏")

_TRIM = "regexp_replace({0}, '^[ \\t\\n\\r　]+|[ \\t\\n\\r　]+$', '', 'g')"
trim = _TRIM.format
_NAMED = f"(SELECT * FROM {C._AUTHOR} WHERE coalesce(person_name, '') <> '')"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return C.authorships(spark, d).where("coalesce(person_name, '') <> ''")


def _case(c: str, m: dict) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{a}' THEN '{b}'" for a, b in m.items()) + f" ELSE {c} END"


_OUT = "translate({0}, '" + "".join(VARIANTS) + "', '" + "".join(VARIANTS.values()) + "')"


def _normal_sql() -> str:
    src = f"(SELECT record_id, time_dynasty, person_name, {trim('person_name')} AS s FROM {_NAMED})"
    for p in PREFIXES:
        src = f"(SELECT record_id, time_dynasty, person_name, CASE WHEN starts_with(s, '{p}') AND length(s) > {len(p)} THEN substring(s, {len(p) + 1}) ELSE s END AS s FROM {src})"
    return f"(SELECT record_id, time_dynasty, person_name, {_case('x', ALIASES)} AS n FROM (SELECT record_id, time_dynasty, person_name, {_OUT.format('s')} AS x FROM {src}))"


_N = _normal_sql()


def normal(c: str) -> Column:
    return names.normal_name(F.col(c), PREFIXES, VARIANTS, ALIASES)


@query(f"SELECT record_id, n AS name FROM {_N}")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    """Names without role prefixes, in one form of each character, under the main name."""
    return _named(spark, d).select("record_id", normal("person_name").alias("name"))


def _variants() -> Column:
    raw = F.col("person_name")
    n = normal("person_name")
    return names.distinct_given(raw, n, F.translate(raw, "傳", "傅"), F.concat(n, F.lit("帝")))


_VARS = f"(SELECT record_id, time_dynasty, [person_name, n, translate(person_name, '傳', '傅'), n || '帝'] AS v FROM {_N})"
_DISTINCT = "list_filter({0}, lambda x, i: x <> '' AND list_position({0}, x) = i)"


@query(f"SELECT record_id, array_to_string({_DISTINCT.format('v')}, '|') AS variants FROM {_VARS}")
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Ways to look a name up, in order and once each."""
    return _named(spark, d).select("record_id", F.array_join(_variants(), "|").alias("variants"))


@query(f"SELECT record_id, array_to_string({_DISTINCT.format('q')}, '|') AS asked FROM (SELECT record_id, [person_name, n, translate(person_name, '傳', '傅'), n || '帝', right(n, 2)] AS q FROM {_N})")
def query_names(spark: SparkSession, d: str) -> DataFrame:
    """The variants, and the name's last two characters."""
    asked = F.array_distinct(F.concat(_variants(), F.array(F.right(normal("person_name"), F.lit(2)))))
    return _named(spark, d).select("record_id", F.array_join(asked, "|").alias("asked"))


@query(
    f"""SELECT record_id, string_agg(DISTINCT k, '|' ORDER BY k) AS keys FROM (SELECT record_id, unnest([CASE WHEN length(x) > 2 THEN right(x, 2) END, CASE WHEN length(x) > 3 THEN right(x, 3) END]) AS k FROM (SELECT record_id, unnest({_DISTINCT.format('v')}) AS x FROM {_VARS})) WHERE k IS NOT NULL GROUP BY 1"""
)
def suffix_keys(spark: SparkSession, d: str) -> DataFrame:
    """The ends of two and three characters of every variant that is longer."""
    k = names.ends(_variants(), (2, 3))
    return _named(spark, d).select("record_id", F.array_join(F.sort_array(k), "|").alias("keys")).where("keys <> ''")


_HITS = f"(SELECT cbdb_id, matched_string, primary_name, dynasty FROM {C._CBDB} WHERE primary_name IS NOT NULL)"


@query(f"SELECT cbdb_id, matched_string, len(list_intersect([primary_name, translate(primary_name, '傳邱脩于', '傅丘修於')], [matched_string, translate(matched_string, '傳邱脩于', '傅丘修於')])) > 0 AS same FROM {_HITS}")
def names_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether two names have a variant in common."""
    of = lambda c: F.array_distinct(F.array(F.col(c), F.translate(F.col(c), "傳邱脩于", "傅丘修於")))
    return C.once(spark, d, "cbdb_hit", "primary_name is not null").select("cbdb_id", "matched_string", F.arrays_overlap(of("primary_name"), of("matched_string")).alias("same"))


_LABELS_SQL = "CASE " + " ".join(f"WHEN {{0}} = '{k}' THEN ['{k}', " + ", ".join(f"'{x}'" for x in v) + "]" for k, v in DYNASTIES.items()) + " ELSE [{0}] END"


@query(f"SELECT cbdb_id, matched_string, array_to_string({_LABELS_SQL.format('e')}, '|') AS labels FROM (SELECT cbdb_id, matched_string, coalesce(dynasty, '') AS e FROM {C._CBDB})")
def dynasty_labels(spark: SparkSession, d: str) -> DataFrame:
    """A dynasty's label and the others it goes by."""
    return C.once(spark, d, "cbdb_hit").select("cbdb_id", "matched_string", F.array_join(names.labels_of(F.coalesce("dynasty", F.lit("")), DYNASTIES), "|").alias("labels"))


@query(f"SELECT record_id, cbdb_id, coalesce(era, '') = '' OR coalesce(list_contains({_LABELS_SQL.format('era')}, dynasty), false) AS compatible FROM (SELECT record_id, person_name AS matched_string, time_dynasty AS era FROM {_NAMED}) JOIN {C._CBDB} USING (matched_string)")
def compatible_dynasties(spark: SparkSession, d: str) -> DataFrame:
    """For each record and namesake in the authority file whether their dynasties agree as far as they are told."""
    a = _named(spark, d).select("record_id", F.col("person_name").alias("matched_string"), F.col("time_dynasty").alias("era"))
    h = C.once(spark, d, "cbdb_hit").select("matched_string", "cbdb_id", "dynasty")
    return a.join(h, "matched_string").select("record_id", "cbdb_id", names.compatible(F.col("era"), F.col("dynasty"), DYNASTIES).alias("compatible"))


def _split_sql(c: str, halves: bool, part: str) -> str:
    out = "CASE "
    for size in (2, 1):
        some = ", ".join(f"'{s}'" for s in SURNAMES if len(s) == size)
        out += f"WHEN left({c}, {size}) IN ({some}) AND length({c}) > {size} THEN " + (f"left({c}, {size}) " if part == "family" else f"substring({c}, {size + 1}) ")
    if halves:
        out += f"WHEN regexp_matches({c}, '^[一-鿿]{{2}}$') THEN " + (f"left({c}, 1) " if part == "family" else f"right({c}, 1) ")
    return out + "END"


@query(f"SELECT record_id, {_split_sql('person_name', True, 'family')} AS family, {_split_sql('person_name', True, 'given')} AS given, {_split_sql('person_name', False, 'family')} AS listed_family FROM {_NAMED}")
def split_names(spark: SparkSession, d: str) -> DataFrame:
    """Family and given name by the longest surname; listed_family without the halving of two-character names."""
    c = F.col("person_name")
    s, only = names.split_name(c, SURNAMES), names.split_name(c, SURNAMES, halves=False)
    return _named(spark, d).select("record_id", s["family"].alias("family"), s["given"].alias("given"), only["family"].alias("listed_family"))


@query(f"SELECT record_id, coalesce(CASE " + " ".join(f"WHEN left(person_name, 1) = '{k}' AND right(person_name, 1) = '{g}' THEN '{v} {w}'" for k, v in READINGS.items() for g, w in READINGS.items()) + f" END, person_name) AS spelt FROM {_NAMED} WHERE regexp_matches(person_name, '^[一-鿿]{{2}}$')")
def spelt_names(spark: SparkSession, d: str) -> DataFrame:
    """Two-character names in the readings of their parts, the whole where a reading is missing."""
    c = F.col("person_name")
    return _named(spark, d).where(c.rlike(r"^[\x{4E00}-\x{9FFF}]{2}$")).select("record_id", names.spelt(names.split_name(c, SURNAMES), READINGS, c).alias("spelt"))


@query(f"SELECT record_id, CASE WHEN regexp_matches(function, '[編輯纂]') THEN 'editor' ELSE 'author' END AS bucket FROM {_NAMED}")
def role_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("record_id", names.role_bucket(F.col("function"), EDITORS).alias("bucket"))


@query(f"SELECT record_id, n || CASE WHEN coalesce(time_dynasty, '') <> '' THEN '|' || time_dynasty ELSE '' END AS cache_key FROM {_N}")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Normal name and dynasty, or the name alone."""
    return _named(spark, d).select("record_id", F.concat(normal("person_name"), F.when(F.length("time_dynasty") > 0, F.concat(F.lit("|"), F.col("time_dynasty"))).otherwise("")).alias("cache_key"))


@query(f"SELECT record_id, coalesce(wikidata_qid, '') <> '' OR coalesce(cbdb_id, '') <> '' OR coalesce(norbert_id, '') <> '' AS known FROM {C._AUTHOR}")
def has_authority(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of three authority ids is given."""
    return C.authorships(spark, d).select("record_id", (F.length(F.concat(*[F.coalesce(c, F.lit("")) for c in ("wikidata_qid", "cbdb_id", "norbert_id")])) > 0).alias("known"))


# titles and headings


@query(f"SELECT kr_id, {trim('regexp_replace(title, $$[(（][^()（）]*[)）]\\s*$$$, $$$$)')} AS title FROM {C._WORK}".replace("$$$, $$$$", "$', ''").replace("$$[", "'["))
def undisambiguated(spark: SparkSession, d: str) -> DataFrame:
    """Titles without a bracketed addition at the end."""
    return C.works(spark, d).select("kr_id", marks.without_disambiguation(F.col("title")).alias("title"))


@query(f"SELECT hit_id, translate(query_title, '《》', '') AS title FROM (SELECT DISTINCT hit_id, query_title FROM work_hit)")
def unquoted_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_hit").select("hit_id", F.translate("query_title", "《》", "").alias("title")).distinct()


@query(f"SELECT qid, translate(wikidata_title, '{''.join(SIMPLE)}', '{''.join(SIMPLE.values())}') AS title FROM {C._ITEM} WHERE wikidata_title IS NOT NULL")
def traditional_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles with simplified characters put in their traditional form, by a table."""
    return C.items(spark, d).where("wikidata_title is not null").select("qid", T.fold(F.col("wikidata_title"), SIMPLE).alias("title"))


@query("SELECT hit_id, regexp_replace(regexp_replace(regexp_replace(query_title, '[\\s　]', '', 'g'), '^注', ''), '第[一二三四五六七八九十百0-9]+[上中下]?$', '') AS key FROM (SELECT DISTINCT hit_id, query_title FROM work_hit)")
def chapter_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_hit").select("hit_id", "query_title").distinct().select("hit_id", marks.chapter_key(F.col("query_title")).alias("key"))


@query(f"SELECT kr_id, regexp_replace({trim('regexp_replace(regexp_replace(title, $$<[^>]*>$$, $$$$, $$g$$), $$[ \\t\\r\\n　]+$$, $$ $$, $$g$$)')}, '^.*?No\\. ?[0-9A-Za-z]+ ', '') AS title FROM {C._WORK}".replace("$$", "'"))
def cleaned_titles(spark: SparkSession, d: str) -> DataFrame:
    return C.works(spark, d).select("kr_id", marks.cleaned_title(F.col("title")).alias("title"))


@query(f"SELECT para_id, regexp_replace(text, '[《》·\\s　]', '', 'g') AS key FROM {C._SRC} WHERE coalesce(heading, '') <> ''")
def section_keys(spark: SparkSession, d: str) -> DataFrame:
    return C.once(spark, d, "src_para", "coalesce(heading, '') <> ''").select("para_id", marks.section_key(F.col("text")).alias("key"))


@query(f"SELECT kr_id, " + "CASE " + " ".join(f"WHEN ends_with(title, '{r}') AND length(title) > {len(r)} THEN left(title, length(title) - {len(r)})" for r in RANKS) + " END AS place, CASE " + " ".join(f"WHEN ends_with(title, '{r}') AND length(title) > {len(r)} THEN '{r}'" for r in RANKS) + f" END AS rank FROM {C._WORK}")
def title_parts(spark: SparkSession, d: str) -> DataFrame:
    """Titles cut at the first ending, in the order of a list, that they have."""
    p = names.title_parts(F.col("title"), RANKS)
    return C.works(spark, d).select("kr_id", p["place"].alias("place"), p["rank"].alias("rank"))


@query(
    f"""SELECT record_id, array_to_string({_DISTINCT.format('s')}, '|') AS asked FROM (SELECT record_id, [place || person_name || rank, own || place || person_name || rank, place || rank, own || place || rank, place || rank || person_name, person_name || rank, person_name] AS s
    FROM (SELECT record_id, person_name, NULLIF(function, '') AS rank, left(kr_id, 3) AS place, CASE WHEN NULLIF(time_dynasty, '') IS DISTINCT FROM left(kr_id, 3) THEN NULLIF(time_dynasty, '') END AS own FROM {_NAMED}))"""
)
def search_strings(spark: SparkSession, d: str) -> DataFrame:
    """Ways to ask for a person by dynasty, section, name and role."""
    g = lambda c: F.nullif(c, F.lit(""))
    return _named(spark, d).select("record_id", F.array_join(names.search_strings(g("time_dynasty"), F.left("kr_id", F.lit(3)), F.col("person_name"), g("function")), "|").alias("asked"))


@query(f"SELECT file_id, CASE WHEN length(title) BETWEEN 3 AND 16 AND regexp_matches(right(title, 1), '[卷篇章一二三四五六七八九十]') AND NOT regexp_matches(title, '目錄|凡例') THEN true ELSE false END AS fit FROM {C._JUAN} WHERE title IS NOT NULL")
def fit_chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    return C.once(spark, d, "juan_file", "title is not null").select("file_id", marks.chapter_title_ok(F.col("title"), "卷篇章一二三四五六七八九十", "目錄|凡例").alias("fit"))


@query(f"SELECT file_id, CASE WHEN regexp_extract(title, '(卷[〇零一二三四五六七八九十百千0-9]+)', 1) <> '' THEN regexp_extract(title, '(卷[〇零一二三四五六七八九十百千0-9]+)', 1) ELSE right(title, 8) END AS label, CAST(regexp_extract(juan_id, '([0-9]+)$', 1) AS INTEGER) AS number FROM {C._JUAN}")
def juan_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of juan from their titles and numbers from their ids."""
    return C.once(spark, d, "juan_file").select("file_id", ids.juan_label(F.col("title")).alias("label"), F.coalesce(ids.last_number(F.col("juan_id")), ids.last_number(F.col("title"))).alias("number"))


@query(f"SELECT kr_id, [left(kr_id, 3), left(kr_id, 4)] AS parts, coalesce(a.n, 0) AS of_part, coalesce(b.n, 0) AS of_class, concat_ws('・', left(kr_id, 3), CASE WHEN b.n > 1 THEN left(kr_id, 4) END) AS section FROM {C._WORK} LEFT JOIN (SELECT left(kr_id, 3) AS p, count(*) AS n FROM {C._WORK} GROUP BY 1) a ON a.p = left(kr_id, 3) LEFT JOIN (SELECT left(kr_id, 4) AS c, count(*) AS n FROM {C._WORK} GROUP BY 1) b ON b.c = left(kr_id, 4)".replace("[left(kr_id, 3), left(kr_id, 4)] AS parts, ", ""))
def work_sections(spark: SparkSession, d: str) -> DataFrame:
    """Part and class of a work's id, each looked up in its table; a class of one work is left out of the label."""
    w = C.works(spark, d).select("kr_id", F.left("kr_id", F.lit(3)).alias("p"), F.left("kr_id", F.lit(4)).alias("c"))
    a, b = w.groupBy("p").agg(F.count("*").alias("of_part")), w.groupBy("c").agg(F.count("*").alias("of_class"))
    return w.join(a, "p", "left").join(b, "c", "left").select("kr_id", "of_part", "of_class", F.concat_ws("・", "p", F.when(F.col("of_class") > 1, F.col("c"))).alias("section"))


# ids, files, addresses


@query(f"SELECT kr_id, coalesce('DZ' || lpad(CAST(TRY_CAST(NULLIF(regexp_extract(dzid, '^[^0-9]*([0-9]+)([.]0+)?$', 1), '') AS INTEGER) AS VARCHAR), 4, '0'), '') AS padded, coalesce(NULLIF(ltrim(regexp_extract(dzid, '([0-9]+)', 1), '0'), ''), '') AS digits, regexp_replace(coalesce(dzid, ''), '[.]0+$', '') AS plain FROM {C._WORK}")
def catalogue_ids(spark: SparkSession, d: str) -> DataFrame:
    """Three ways to normalise a catalogue number: padded, digits only, and only without a decimal part."""
    c = F.col("dzid")
    return C.works(spark, d).select("kr_id", F.coalesce(T.padded_id(c, "DZ"), F.lit("")).alias("padded"), F.coalesce(F.ltrim(F.regexp_extract(c, "([0-9]+)", 1), F.lit("0")), F.lit("")).alias("digits"), F.regexp_replace(F.coalesce(c, F.lit("")), "[.]0+$", "").alias("plain"))


@query(f"SELECT work_id, left(work_id, 1) AS canon, regexp_extract(substring(work_id, 2), '^([A-Za-z]?)([0-9]+)([A-Za-z]?)$', 1) AS lead, lpad(regexp_extract(substring(work_id, 2), '^([A-Za-z]?)([0-9]+)([A-Za-z]?)$', 2), 4, '0') AS number, regexp_extract(substring(work_id, 2), '^([A-Za-z]?)([0-9]+)([A-Za-z]?)$', 3) AS trail, regexp_replace(replace(work_id, 'n', ''), '^([A-Z]+)0+', '\\1') AS looser FROM {C._CATALOG} WHERE left(work_id, 1) IN ('T', 'X', 'U', 'N', 'D', 'J', 'P') AND regexp_matches(work_id, '^.[A-Za-z]?[0-9]+[A-Za-z]?$')")
def work_id_parts(spark: SparkSession, d: str) -> DataFrame:
    """Ids of works taken apart, and the id under which one may be listed."""
    p = ids.work_id_parts(F.col("work_id"), CANONS)
    return C.once(spark, d, "catalog_hit").withColumn("p", p).where("p is not null").select("work_id", "p.canon", "p.lead", "p.number", "p.trail", ids.looser_id(F.col("work_id")).alias("looser"))


_STEM = "regexp_replace(string_split(rel_path, '/')[-1], '\\.[A-Za-z0-9]+$', '')"


@query(f"SELECT id, p[1] AS section, coalesce(p[2], '') AS title, CASE WHEN len(p) >= 4 AND length(p[3]) <= 3 THEN p[3] ELSE '' END AS dynasty, CASE WHEN len(p) >= 4 AND length(p[3]) <= 3 THEN p[4] ELSE '' END AS author FROM (SELECT id, string_split({_STEM}, '-') AS p FROM {C._CORPUS} WHERE rel_path IS NOT NULL)")
def file_name_parts(spark: SparkSession, d: str) -> DataFrame:
    p = ids.file_parts(F.col("rel_path"))
    return C.once(spark, d, "corpus_entry", "rel_path is not null").withColumn("p", p).select("id", "p.section", "p.title", "p.dynasty", "p.author")


@query(f"SELECT id, trim(replace(regexp_replace(regexp_replace({_STEM}, '^[^-]*-', ''), '-[0-9]+$', ''), coalesce(NULLIF(dz_no, ''), chr(1)), '')) AS title, CASE WHEN n = '' THEN '' ELSE coalesce(NULLIF(ltrim(n, '0'), ''), '0') END AS number FROM (SELECT *, regexp_extract(id, '(?:^|[^0-9])([0-9]{{1,4}})(?:[^0-9]|$)', 1) AS n FROM {C._CORPUS}) WHERE rel_path IS NOT NULL")
def file_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles read off file names, and the first number that stands alone in an id."""
    return C.once(spark, d, "corpus_entry", "rel_path is not null").select("id", ids.title_of_file(F.col("rel_path"), F.col("dz_no")).alias("title"), ids.isolated_number(F.col("id")).alias("number"))


@query(f"SELECT qid, 'https://wiki.example/' || url_encode(wikidata_title) AS url, regexp_extract('https://items.example/' || qid, '(?:^|/)(Q[0-9]+)$', 1) AS id FROM {C._ITEM} WHERE wikidata_title IS NOT NULL")
def page_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages by their names, and the id an item's address ends in."""
    return C.items(spark, d).where("wikidata_title is not null").select("qid", ids.page_url("https://wiki.example/", F.col("wikidata_title")).alias("url"), ids.item_id(F.concat(F.lit("https://items.example/"), "qid")).alias("id"))


@query(f"SELECT file_id, 'texts.example' AS host, CASE file_id % 3 WHEN 0 THEN 'chapter' WHEN 1 THEN 'res' ELSE 'page' END AS kind, CASE file_id % 3 WHEN 2 THEN juan_id ELSE CAST(file_id AS VARCHAR) END AS id FROM {C._JUAN}")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """What an address asks for: a chapter, a resource, or a page by its path."""
    j = C.once(spark, d, "juan_file").select("file_id", F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("https://texts.example/wiki?if=en&chapter="), "file_id")).when(F.col("file_id") % 3 == 1, F.concat(F.lit("https://texts.example/wiki?res="), "file_id")).otherwise(F.concat(F.lit("https://texts.example/book/"), "juan_id")).alias("url"))
    return j.withColumn("p", ids.url_parts(F.col("url"))).select("file_id", "p.host", "p.kind", "p.id")


_COURT = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COURTS.items()) + " END"


@query(f"SELECT record_id, coalesce({_COURT.format('t')}, {_COURT.format('b')}) AS court, CASE WHEN {_COURT.format('t')} IS NOT NULL THEN t ELSE b END AS label FROM (SELECT record_id, time_dynasty AS t, regexp_replace(time_dynasty, '[朝代]$', '') AS b FROM {C._AUTHOR} WHERE coalesce(time_dynasty, '') <> '')")
def court_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of dynasties by label, or by the label without 朝 or 代."""
    return C.authorships(spark, d).where("coalesce(time_dynasty, '') <> ''").withColumn("p", ids.numbered_label(F.col("time_dynasty"), COURTS)).select("record_id", F.col("p.id").alias("court"), "p.label")


_YEARS = "^\\s*(-?[0-9]+|\\?)年?\\s*[-–—]\\s*(-?[0-9]+|\\?)年?(\\?)?\\s*$"


@query(f"SELECT record_id, TRY_CAST(NULLIF(regexp_extract(author_dates, '{_YEARS}', 1), '') AS INTEGER) AS first, CASE WHEN regexp_extract(author_dates, '{_YEARS}', 3) = '' THEN TRY_CAST(NULLIF(regexp_extract(author_dates, '{_YEARS}', 2), '') AS INTEGER) END AS last FROM {C._AUTHOR}")
def reign_years(spark: SparkSession, d: str) -> DataFrame:
    """First and last year as written; a doubtful one is null."""
    return C.authorships(spark, d).withColumn("p", marks.reign_years(F.col("author_dates"))).select("record_id", "p.first", "p.last")


@query(f"SELECT work_id, CASE WHEN position(' ' IN a) BETWEEN 2 AND 5 THEN left(a, position(' ' IN a) - 1) ELSE '' END AS dynasty, CASE WHEN position(' ' IN a) BETWEEN 2 AND 5 THEN {trim('substring(a, position($$ $$ IN a) + 1)')} ELSE a END AS name FROM (SELECT work_id, dynasty || ' ' || authors AS a FROM {C._CATALOG} WHERE authors IS NOT NULL AND dynasty IS NOT NULL)".replace("$$", "'"))
def dynasty_and_names(spark: SparkSession, d: str) -> DataFrame:
    """A dynasty and the name behind it, cut at the first space."""
    a = C.once(spark, d, "catalog_hit", "authors is not null and dynasty is not null").select("work_id", F.concat_ws(" ", "dynasty", "authors").alias("a"))
    return a.withColumn("p", names.dynasty_and_name(F.col("a"))).select("work_id", "p.dynasty", "p.name")


_BY = "(" + "|".join(VERBS) + ")$"
_ERAS = "^[（(〔\\[]?(" + "|".join(DYNASTIES) + ")[）)〕\\]]?[ 　]*"


@query(
    f"""SELECT record_id, regexp_extract(t, '{_ERAS}', 1) AS dynasty, regexp_extract(b, '{_BY}', 1) AS role, array_to_string(CASE WHEN {trim('p')} IN ('佚名', '闕名') THEN [] ELSE list_filter(list_transform(regexp_split_to_array(p, '[、，,]'), lambda x: {trim('x')}), lambda x: length(x) > 0) END, '|') AS names
    FROM (SELECT *, regexp_replace(regexp_replace(b, '{_BY}', ''), '(先生|大師|法師)$', '') AS p FROM (SELECT *, regexp_replace(t, '{_ERAS}', '') AS b FROM (SELECT record_id, coalesce(time_dynasty, '') || person_name || coalesce(function, '') AS t FROM {_NAMED})))"""
)
def bylines(spark: SparkSession, d: str) -> DataFrame:
    """Bylines made of dynasty, name and role read back into their parts."""
    t = F.concat(F.coalesce("time_dynasty", F.lit("")), "person_name", F.coalesce("function", F.lit("")))
    p = names.byline(t, tuple(DYNASTIES), VERBS, ("佚名", "闕名"), ("先生", "大師", "法師"))
    return _named(spark, d).withColumn("p", p).select("record_id", "p.dynasty", "p.role", F.array_join("p.names", "|").alias("names"))


# documents, lines and pages


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '〈[^〉]*〉', '', 'g'), '\\{\\{[^{}]*\\}\\}', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def texts_without_commentary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(marks.without_commentary(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(text, '(?is)<span class=\"inlinecomment\">.*?</span>', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def texts_without_inline_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(marks.without_inline_notes(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN n >= 3 THEN md5(regexp_replace(text, '(?m)^《[^》\\n]{1,20}》[：:]', '', 'g')) ELSE md5(text) END AS digest, n AS headers FROM (SELECT doc_id, text, len(regexp_extract_all(text, '(?m)^《[^》\\n]{1,20}》[：:]')) AS n FROM documents WHERE text IS NOT NULL)")
def texts_without_citations(spark: SparkSession, d: str) -> DataFrame:
    """Texts without headers of citations, if they have three or more."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.md5(marks.without_citations(F.col("text"))).alias("digest"), T.count_matches(F.col("text"), "(?m)^《[^》\n]{1,20}》[：:]").alias("headers"))


_NOTED = "regexp_replace(regexp_replace(regexp_replace(text, '〈([^〉]*)〉', '（\\1）', 'g'), '\\{\\{([^{}|]*)\\}\\}', '（\\1）', 'g'), '(?is)<span class=\"[a-z]*comment\">(.*?)</span>', '（\\1）', 'g')"


@query(f"SELECT doc_id, md5(regexp_replace({_NOTED}, '（([^（）]*)）([。，；：！？])', '\\2（\\1）', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def notes_in_brackets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(marks.notes_in_brackets(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(translate(regexp_replace(text, '<pb:[^>]*>|\\[[0-9]+[a-z]?\\]|¶', '', 'g'), '﹐﹑﹒﹔﹕﹖﹗︒︑︐｡､「」『』（）()〈〉【】', '，、。；：？！。、，。、')) AS digest FROM documents WHERE text IS NOT NULL")
def cleaned_parallels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(marks.cleaned_parallel(F.col("text"))).alias("digest"))


@query(f"SELECT file_id, md5({trim('regexp_replace(regexp_replace(regexp_replace(body_xml, $$(?is)<a\\b[^>]*>.*?</a>$$, $$$$, $$g$$), $$(?is)</?(?:img|table|tbody|tr|td)\\b[^>]*>$$, $$$$, $$g$$), $$>\\s+<$$, $$><$$, $$g$$)')}) AS digest FROM {C._JUAN}".replace("$$", "'"))
def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.once(spark, d, "juan_file").select("file_id", F.md5(marks.cleaned_html(F.col("body_xml"))).alias("digest"))


@query("SELECT doc_id, regexp_matches(text, '(?i)\\{\\{(?:disambig|otheruses)') AS disambiguation, contains(lower(text), 'captcha') OR contains(lower(text), 'verify you are human') AS challenge, starts_with(text, '**') AS blob, regexp_matches(text, '^[ 　]') AS indented FROM documents WHERE text IS NOT NULL")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Disambiguation pages, challenges to readers, heading blobs and indented texts."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", t.rlike(r"(?i)\{\{(?:disambig|otheruses)").alias("disambiguation"), marks.holds_any(t, ("captcha", "verify you are human")).alias("challenge"), t.startswith("**").alias("blob"), t.rlike("^[ 　]").alias("indented"))


_STARTS = ("卷[一二三四五六七八九十百]+$", "^(?:Chapter|Section) [0-9]+", "^第[一二三四五六七八九十]+[章節卷]", "^巻[一二三四五六七八九十]+", "序$")


@query(f"SELECT para_id, length(text) <= 120 AND NOT regexp_matches(text, '[。！？]') AND regexp_matches(text, '{'|'.join(f'(?:{p})' for p in _STARTS)}') AS opens FROM {C._SRC} WHERE text IS NOT NULL")
def opening_lines(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that open a part."""
    return C.once(spark, d, "src_para", "text is not null").select("para_id", marks.is_heading_line(F.col("text"), _STARTS).alias("opens"))


@query(f"SELECT para_id, NOT regexp_matches(text, '[。！？…；：.!?][''\"」』”’）)】》〉]*\\s*$') AS continues FROM {C._SRC} WHERE text IS NOT NULL")
def broken_off(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that do not end a sentence."""
    return C.once(spark, d, "src_para", "text is not null").select("para_id", marks.continues(F.col("text")).alias("continues"))


@query(f"SELECT seg_id, coalesce(lower(trim(CAST(has_punct AS VARCHAR))) IN ('1', 'true', 'yes'), false) AS marked, CASE WHEN h < 20 THEN coalesce(has_punct, false) ELSE m * 100 >= 0.75 * h END AS adequate FROM (SELECT seg_id, has_punct, length(coalesce(han, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[。！？；：，、]')) AS m FROM {C._SEG})")
def adequate_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with marks enough: a short one any, a longer one three quarters of a mark in a hundred characters."""
    h, m = F.length(F.coalesce("han", F.lit(""))), T.count_matches(F.coalesce("text", F.lit("")), "[。！？；：，、]")
    return C.once(spark, d, "segment").select("seg_id", marks.truthy(F.col("has_punct").cast("string")).alias("marked"), F.when(h < 20, F.coalesce("has_punct", F.lit(False))).otherwise(m * 100 >= 0.75 * h).alias("adequate"))


@query(f"SELECT seg_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '「+', '「', 'g'), '『+', '『', 'g'), '（+', '（', 'g'), '《+', '《', 'g') AS text FROM {C._SEG} WHERE text IS NOT NULL")
def single_openings(spark: SparkSession, d: str) -> DataFrame:
    """One opening mark where several stand."""
    return C.once(spark, d, "segment", "text is not null").select("seg_id", marks.single_opening(F.col("text")).alias("text"))


@query(f"SELECT seg_id, translate(text, '。！？；：，、「『“‘（(【《〈」』”’）)】》〉', '') AS bare, contains(regexp_replace(text, '<[^>]*>', '', 'g'), '') AND length(regexp_replace(text, '<[^>]*>|\\s', '', 'g')) > 0 AS readable FROM {C._SEG} WHERE text IS NOT NULL".replace("contains(regexp_replace(text, '<[^>]*>', '', 'g'), '') AND ", ""))
def bare_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts without marks, and whether there is more in them than tags."""
    from tessella.operators.documents import strip_marks

    t = F.col("text")
    return C.once(spark, d, "segment", "text is not null").select("seg_id", strip_marks(t).alias("bare"), (F.length(F.regexp_replace(t, r"<[^>]*>|\s", "")) > 0).alias("readable"))
