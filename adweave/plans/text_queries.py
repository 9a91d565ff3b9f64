"""Queries over text, date and lookup functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from adweave.functions import dates as D
from adweave.functions import geo as G
from adweave.functions import text as T
from adweave.functions import wordlists as W
from adweave.plans.adapters import JOBS, by_key, by_key_sql, jobs, table

FOLD = "trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]+', '', 'g')), '[^a-z0-9/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
NORMALISE = "trim(regexp_replace(regexp_replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _words(values) -> str:
    return "\\b(?:" + "|".join(values) + ")\\b"


COMPANIES = ["Acme GmbH (Berlin)", "Nordwind AG", "TopTalent Recruiting Ltd", "Blue & Co. KG", "Staffing Partners SE", "Café Olé S.A."]
TITLES = ["Senior Engineer (m/w/d)", "Sachbearbeiter*in", "Data Analyst (all genders)", "Koch m/w/d", "Lead Developer 12345"]
CITIES = ["München, Bayern", "Köln", "Wien, AT", "Graz", "Praha 1", "Roma"]
WORDING = ["Full-time", "Part time, permanent", "Internship", "Freelance contract", "Teilzeit und Vollzeit", "befristet", "regular", "", "Full time or part time"]
PLACES = ["Remote - EMEA", "Hybrid in Berlin", "On-site", "Home office", "Europe", "the office", "Paris"]
CODES = ["CB22 4QR", "T12 X70A", "in sw1a 1aa and EC1", "CB22", "none", "D6W XY12"]

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def docs(spark, d):
    return table(spark, d, "documents")


@query("b1_fold", f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def b1(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("b2_normalise", f"SELECT doc_id, md5({NORMALISE.format('text')}) AS normal FROM documents")
def b2(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalise(F.col("text"))).alias("normal"))


@query("b3_tidy", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '[ \\t\\x{A0}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS tidy FROM pages")
def b3(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.tidy(F.col("html"))).alias("tidy"))


@query(
    "b4_b7_company",
    f"""WITH s AS (SELECT s_suppkey, {by_key_sql('s_suppkey', COMPANIES)} || ' ' || s_name AS company FROM supplier)
    SELECT s_suppkey, trim(regexp_replace(regexp_replace({FOLD.format("regexp_replace(company, '\\([^)]*\\)', ' ', 'g')")}, '{_words(W.LEGAL_FORMS)}', ' ', 'g'), '\\s+', ' ', 'g')) AS company_key,
           regexp_matches(lower(company), '{_words(W.AGENCY_WORDS)}') AS agency FROM s""",
)
def b4(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat_ws(" ", by_key(F.col("s_suppkey"), COMPANIES), "s_name").alias("company"))
    return s.select("s_suppkey", T.normal_company(F.col("company")).alias("company_key"), T.is_agency(F.col("company")).alias("agency"))


@query(
    "b5_normal_title",
    f"""WITH s AS (SELECT p_partkey, p_name || ' ' || {by_key_sql('p_partkey', TITLES)} AS title FROM part)
    SELECT p_partkey, {FOLD.format(f"regexp_replace(title, '{W.GENDER_MARKERS}', ' ', 'g')")} AS title_key FROM s""",
)
def b5(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.normal_title(F.concat_ws(" ", "p_name", by_key(F.col("p_partkey"), TITLES))).alias("title_key"))


CITY_CASE = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.CITY_ALIASES.items()) + " ELSE c END"


@query("b6_normal_city", f"WITH s AS (SELECT c_custkey, {FOLD.format('string_split(' + by_key_sql('c_custkey', CITIES) + chr(44) + chr(39) + chr(44) + chr(39) + ')[1]')} AS c FROM customer) SELECT c_custkey, {CITY_CASE} AS city FROM s")
def b6(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.normal_city(by_key(F.col("c_custkey"), CITIES)).alias("city"))


TYPE_SQL = by_key_sql("o_orderkey", ["full_time_permanent,fixed_term", "part_time", "internship_or_working_student", "freelance_or_contract,fixed_term", "part_time", "fixed_term", "full_time_permanent", "", "part_time"])


@query("b9_job_types", f"SELECT o_orderkey, {TYPE_SQL} AS types FROM orders")
def b9(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.job_types_from_text(by_key(F.col("o_orderkey"), WORDING)), ",").alias("types"))


@query(
    "b10_b13_work_mode",
    f"SELECT o_orderkey, nullif({by_key_sql('o_orderkey', ['remote', 'hybrid', 'on_site', 'remote', '', 'on_site', ''])}, '') AS mode, o_orderkey % 7 IN (0, 4) AS europe FROM orders",
)
def b10(spark, d):
    t = by_key(F.col("o_orderkey"), PLACES)
    return table(spark, d, "orders").select("o_orderkey", T.work_mode_from_text(t).alias("mode"), T.is_europe_wide(t).alias("europe"))


NAMES = ["English", "Deutsch", "Français (courant)", "Spanish", "Klingon", "español"]


@query("b14_language_code", f"SELECT o_orderkey, nullif({by_key_sql('o_orderkey', ['en', 'de', 'fr', 'es', '', 'es'])}, '') AS code FROM orders")
def b14(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.language_code(by_key(F.col("o_orderkey"), NAMES)).alias("code"))


STARTED = "2000-06-01 09:30:00"
LATEST = "CASE date_precision WHEN 'exact' THEN posted_at WHEN 'day' THEN date_trunc('day', posted_at) + INTERVAL 1 DAY + INTERVAL 3 HOUR END"
EARLIEST = "CASE date_precision WHEN 'exact' THEN posted_at WHEN 'day' THEN date_trunc('day', posted_at) - INTERVAL 3 HOUR END"


@query(
    "b18_c1_freshness",
    f"""WITH {JOBS} SELECT job_key, CAST(epoch({LATEST}) AS BIGINT) AS latest, CAST(epoch({EARLIEST}) AS BIGINT) AS earliest,
    CASE WHEN ({LATEST}) IS NULL THEN 'unknown' WHEN ({LATEST}) >= TIMESTAMP '{STARTED}' - to_hours(24 * (1 + job_key % 30)) THEN 'fresh' ELSE 'too_old' END AS state FROM jobs""",
)
def b18(spark, d):
    j, p = jobs(spark, d), F.col("date_precision")
    start = D.window_start(F.to_timestamp(F.lit(STARTED)), 24 * (1 + F.col("job_key") % 30))
    return j.select("job_key", F.unix_seconds(D.latest_possible(F.col("posted_at"), p)).alias("latest"), F.unix_seconds(D.earliest_possible(F.col("posted_at"), p)).alias("earliest"), D.freshness(F.col("posted_at"), p, start).alias("state"))


@query(
    "b16_b17_dates",
    """SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE) AS BIGINT) AS closes, CAST(epoch(date_trunc('day', o_orderdate) + INTERVAL 12 HOUR) AS BIGINT) AS noon,
    strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER), '%Y-%m-%d') AS posted, greatest(1, CAST(ceil((o_orderkey % 100) / 24.0) AS INTEGER)) AS days FROM orders""",
)
def b16(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    wording = F.concat(F.lit("Posted "), (F.col("o_orderkey") % 30).cast("string"), F.lit(" days ago"))
    return o.select(
        "o_orderkey",
        F.unix_seconds(D.parse_closing(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("closes"),
        F.unix_seconds(D.day_at_utc(F.col("day"))).alias("noon"),
        F.date_format(D.relative_day(wording, F.col("day")), "yyyy-MM-dd").alias("posted"),
        D.days_back(F.col("o_orderkey") % 100).alias("days"),
    )


@query(
    "b21_reach",
    "SELECT c_custkey, round(greatest(1.5, 0.6 * pow((c_custkey * 7919 % 900000 + 500) / 1000.0, 0.4)), 6) AS reach, round(greatest(0.0, (c_custkey % 50) - greatest(1.5, 0.6 * pow((c_custkey * 7919 % 900000 + 500) / 1000.0, 0.4))), 6) AS edge FROM customer",
)
def b21(spark, d):
    people = F.col("c_custkey") * 7919 % 900000 + 500
    return table(spark, d, "customer").select("c_custkey", F.round(G.reach_km(people), 6).alias("reach"), F.round(G.edge_distance((F.col("c_custkey") % 50).cast("double"), people), 6).alias("edge"))


@query(
    "b23_shingles",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split({FOLD.format('text')}, ' '), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS n FROM w""",
)
def b23(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.shingles(F.col("text"))).cast("bigint").alias("n"))


SHINGLE_SET = f"""(SELECT *, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
    FROM (SELECT *, list_filter(string_split({FOLD.format('text')}, ' '), lambda x: x <> '') AS w FROM {{}}))"""


@query(
    "b24_containment",
    f"""WITH a AS (SELECT doc_id, len(s) AS m, unnest(s) AS x FROM {SHINGLE_SET.format('documents')}), b AS (SELECT item_id, len(s) AS n, unnest(s) AS x FROM {SHINGLE_SET.format('benchmark')})
    SELECT doc_id, item_id, round(count(*) / least(any_value(m), any_value(n)), 6) AS share FROM a JOIN b USING (x) GROUP BY 1, 2""",
)
def b24(spark, d):
    """Every document with every passage that it shares a shingle with."""
    from adweave.operators.dedupe import containments

    runs = T.shingles(F.col("text")).alias("words")
    out = containments(docs(spark, d).select("doc_id", runs), table(spark, d, "benchmark").select("item_id", runs), "doc_id", "item_id")
    return out.withColumn("share", F.round("share", 6))


@query(
    "b24_containment_join",
    f"""WITH a AS (SELECT min(doc_id) AS doc_id, count(*) AS documents, s FROM (SELECT doc_id, list_sort(s) AS s FROM {SHINGLE_SET.format('documents')}) GROUP BY s),
    b AS (SELECT min(item_id) AS item_id, count(*) AS items, s FROM (SELECT item_id, list_sort(s) AS s FROM {SHINGLE_SET.format('benchmark')}) GROUP BY s),
    p AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(s) AS x FROM a) JOIN (SELECT item_id, unnest(s) AS x FROM b) USING (x) GROUP BY 1, 2)
    SELECT doc_id, item_id, documents, items, round(n / least(len(a.s), len(b.s)), 6) AS share FROM p JOIN a USING (doc_id) JOIN b USING (item_id) WHERE 2 * n >= least(len(a.s), len(b.s))""",
)
def b24_join(spark, d):
    """Documents and passages of which the shorter is half in the other, copies as one."""
    from adweave.operators.containment import containment_join

    pairs, docs_of, items_of = containment_join(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"), "doc_id", "item_id", 50, T.shingles(F.col("text")))
    number = lambda members, key, name: members.groupBy(F.col("rep").alias(key)).agg(F.count("*").alias(name))
    out = pairs.join(number(docs_of, "doc_id", "documents"), "doc_id").join(number(items_of, "item_id", "items"), "item_id")
    return out.select("doc_id", "item_id", "documents", "items", F.round("share", 6).alias("share"))


@query(
    "b27_identity_keys",
    f"""WITH s AS (SELECT s_suppkey, {by_key_sql('s_suppkey', COMPANIES)} AS company, {by_key_sql('s_suppkey', TITLES)} AS title, {by_key_sql('s_suppkey', CITIES)} AS place FROM supplier),
    k AS (SELECT s_suppkey, {FOLD.format("string_split(place, ',')[1]")} AS c, trim(regexp_replace(regexp_replace({FOLD.format("regexp_replace(company, '\\([^)]*\\)', ' ', 'g')")}, '{_words(W.LEGAL_FORMS)}', ' ', 'g'), '\\s+', ' ', 'g')) AS n,
      {FOLD.format(f"regexp_replace(title, '{W.GENDER_MARKERS}', ' ', 'g')")} AS t FROM s)
    SELECT s_suppkey, 'copy:src:' || CAST(s_suppkey AS VARCHAR) || ';job:' || n || '|' || t || '|' || {CITY_CASE} AS keys FROM k""",
)
def b27(spark, d):
    from adweave.operators.memory import identity_keys

    k = F.col("s_suppkey")
    keys = identity_keys(F.lit("src"), k.cast("string"), by_key(k, COMPANIES), by_key(k, TITLES), by_key(k, CITIES))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(keys, ";").alias("keys"))


@query("b29_postcodes", f"SELECT o_orderkey, {by_key_sql('o_orderkey', ['CB22', 'T12', 'SW1A', 'CB22', '', 'D6W'])} AS codes FROM orders")
def b29(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.postcodes(by_key(F.col("o_orderkey"), CODES)), ",").alias("codes"))


REGIONS = ["Landkreis Bautzen", "County of Cork", "Sachsen", "Province de Liège", "City of Leeds"]


@query("b31_region_key", f"SELECT c_custkey, {by_key_sql('c_custkey', ['bautzen', 'cork', 'sachsen', 'liege', 'leeds'])} || ' ' || CAST(c_nationkey AS VARCHAR) AS region FROM customer")
def b31(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.region_key(F.concat_ws(" ", by_key(F.col("c_custkey"), REGIONS), F.col("c_nationkey").cast("string"))).alias("region"))


@query(
    "b32_salary",
    "SELECT o_orderkey, 'EUR ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || CASE WHEN o_orderkey % 3 = 0 THEN '-' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT) + 5000) ELSE '' END || ' a year' AS salary FROM orders",
)
def b32(spark, d):
    low = F.floor("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", T.salary_text(low, F.when(F.col("o_orderkey") % 3 == 0, low + 5000), F.lit("EUR"), F.lit("year")).alias("salary"))


@query("b33_cefr", f"SELECT o_orderkey, CAST({by_key_sql('o_orderkey', ['1', '2', '3', '4', '5', '6', '6', '3'])} AS INTEGER) AS level FROM orders")
def b33(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.cefr(by_key(F.col("o_orderkey"), ["A1", "A2", "B1", "B2", "C1", "C2", "native", "x"])).alias("level"))


@query(
    "b34_urls",
    "SELECT page_id, string_split(url, '#')[1] AS url, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), '[-_+%.]+', ' ', 'g'), '\\s+', ' ', 'g')) AS slug FROM pages",
)
def b34(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_without_fragment(F.col("url")).alias("url"), T.slug_words(F.col("url")).alias("slug"))


@query("b36_content_key", "SELECT doc_id, sha256(coalesce(text, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(source, '')) AS key FROM documents")
def b36(spark, d):
    return docs(spark, d).select("doc_id", T.content_key(F.col("text"), F.col("lang"), F.col("source")).alias("key"))


@query("b37_json_snapshot", "SELECT o_orderkey, o_orderstatus AS status, round(o_totalprice, 2) AS price, CAST(epoch(o_orderdate) AS BIGINT) AS at FROM orders")
def b37(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_orderstatus", "o_totalprice", F.unix_seconds(F.to_utc_timestamp("o_orderdate", F.current_timezone())).alias("at"))).alias("snapshot"))
    back = F.from_json("snapshot", "o_orderstatus string, o_totalprice double, at long")
    return o.select("o_orderkey", back["o_orderstatus"].alias("status"), F.round(back["o_totalprice"], 2).alias("price"), back["at"].alias("at"))


@query("b38_effective_types", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'part_time' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'fixed_term' WHEN o_orderkey % 3 = 1 THEN 'full_time_permanent,fixed_term' ELSE 'full_time_permanent' END AS types FROM orders")
def b38(spark, d):
    k = F.col("o_orderkey")
    stated = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("full_time_permanent"), F.lit("fixed_term"))).otherwise(F.array(F.lit("full_time_permanent")))
    read = F.when(k % 3 == 0, F.lit("part_time")).when(k % 2 == 0, F.lit("fixed_term"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.effective_types(stated, read), ",").alias("types"))


@query("b39_clamp_reasons", "SELECT l_orderkey, l_linenumber, greatest(0, least(CAST(l_quantity AS INTEGER) - 5, 40)) AS role, l_returnflag || ',' || l_linestatus || ',x' AS reasons FROM lineitem")
def b39(spark, d):
    from adweave.operators.scoring import clamped, first_reasons

    r = first_reasons(F.array(F.lit(" "), "l_returnflag", F.concat(F.lit(" "), "l_linestatus"), F.lit(""), F.lit("x"), F.lit("y")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clamped(F.col("l_quantity").cast("int") - 5, 40).alias("role"), F.array_join(r, ",").alias("reasons"))


@query("b42_title_case", "SELECT n_nationkey, 'Nation_' || CAST(n_nationkey AS VARCHAR) AS name FROM nation")
def b42(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.title_case_if_caps(F.col("n_name")).alias("name"))
