"""Queries over selection of ads, employers and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from adweave.operators import dedupe
from adweave.operators import selection as S
from adweave.operators.conditions import smallest_town
from adweave.plans.adapters import TOWNS, by_key, by_key_sql, km_sql, table, towns, utc

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


CONTROL = [("s0", ["C0", "C1"], True, True), ("s1", ["C2"], False, True), ("s2", ["C1", "C3"], True, False), ("s3", ["C4"], False, False)]
CONTROL_SQL = "control AS (SELECT * FROM (VALUES ('s0', ['C0', 'C1'], true, true), ('s1', ['C2'], false, true), ('s2', ['C1', 'C3'], true, false), ('s3', ['C4'], false, false)) v(source, countries, uses_terms, uses_places))"


@query(
    "a36_c20_select_feed",
    f"""WITH {CONTROL_SQL}, a AS (SELECT 's' || CAST(l_suppkey % 5 AS VARCHAR) AS source, CAST(l_orderkey AS VARCHAR) AS id, (l_linenumber * 100000 + l_partkey) * 1000 + CAST(l_quantity AS BIGINT) AS ordinal, CASE WHEN l_partkey % 4 > 0 THEN 'C' || CAST(l_partkey % 5 AS VARCHAR) END AS country, l_partkey % 2 = 0 AS matched, l_partkey % 3 = 0 AS near FROM lineitem),
    f AS (SELECT source, id, min(ordinal) AS ordinal, arg_min(country, ordinal) FILTER (country IS NOT NULL OR true) AS c0, arg_min({{'c': country, 'm': matched, 'n': near}}, ordinal) AS x FROM a GROUP BY 1, 2)
    SELECT source, id AS source_job_id, ordinal FROM f JOIN control USING (source) WHERE (x.c IS NULL OR list_contains(countries, x.c)) AND (NOT uses_terms OR x.m) AND (NOT uses_places OR x.n)""",
)
def a36(spark, d):
    i, p = table(spark, d, "lineitem"), F.col("l_partkey")
    a = i.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"), F.col("l_orderkey").cast("string").alias("source_job_id"), ((F.col("l_linenumber") * 100000 + p) * 1000 + F.col("l_quantity").cast("bigint")).alias("ordinal"), F.when(p % 4 > 0, F.concat(F.lit("C"), (p % 5).cast("string"))).alias("country"), (p % 2 == 0).alias("matched"), (p % 3 == 0).alias("near"))
    control = spark.createDataFrame(CONTROL, "source string, countries array<string>, uses_terms boolean, uses_places boolean")
    return S.select_feed(a, control).select("source", "source_job_id", "ordinal")


@query(
    "c11_match_places",
    f"""WITH {TOWNS}, w AS (SELECT country, name, town_id, latitude, longitude FROM towns WHERE town_id IN (3, 14)), a AS (SELECT town_id AS ad_id, country, latitude, longitude, CASE WHEN town_id % 5 = 0 THEN '' ELSE name END AS loc, town_id % 7 = 0 AS lost FROM towns)
    SELECT ad_id, NOT EXISTS (SELECT 1 FROM w WHERE w.country = a.country) OR loc = '' OR EXISTS (SELECT 1 FROM w WHERE w.country = a.country AND (w.name = loc OR (NOT lost AND {km_sql('w', 'a')} <= 30))) AS near FROM a""",
)
def c11(spark, d):
    t = towns(spark, d)
    k = F.col("town_id")
    a = t.select(k.alias("ad_id"), "country", F.when(k % 5 == 0, "").otherwise(F.col("names")[0]).alias("location_text"), F.when(k % 7 > 0, k).alias("town_id"))
    wanted = t.where("town_id IN (3, 14)").select("country", F.col("names")[0].alias("name"), F.lit("city").alias("kind"), "town_id", F.lit(30.0).alias("radius_km"))
    return S.match_places(a, wanted, t)


FOUND = [["C1"], ["C2", "other"], ["C9"], ["other"], [], ["C1", "C2"]]


@query(
    "c12_career_country",
    """WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN ['C1'] WHEN 1 THEN ['C2', 'other'] WHEN 2 THEN ['C9'] WHEN 3 THEN ['other'] WHEN 4 THEN [] ELSE ['C1', 'C2'] END AS f, o_orderkey % 4 = 0 AS eu, o_orderkey % 7 = 0 AS els, o_orderkey % 2 = 0 AS one FROM orders)
    SELECT k AS o_orderkey, CASE WHEN list_contains(f, 'C1') THEN 'C1' WHEN list_contains(f, 'C2') THEN 'C2' WHEN list_contains(f, 'C9') THEN NULL WHEN list_contains(f, 'other') AND NOT eu THEN NULL WHEN eu THEN '' WHEN els THEN NULL WHEN one THEN 'C1' ELSE '' END AS country FROM a""",
)
def c12(spark, d):
    k = F.col("o_orderkey")
    found = F.coalesce(*(F.when(k % 6 == i, F.array(*(F.lit(x) for x in f)) if f else F.array().cast("array<string>")) for i, f in enumerate(FOUND)))
    own = F.when(k % 2 == 0, F.array(F.lit("C1"))).otherwise(F.array(F.lit("C1"), F.lit("C2")))
    return table(spark, d, "orders").select(k, S.country_of_career_ad(found, F.array(F.lit("C1"), F.lit("C2")), k % 4 == 0, k % 7 == 0, own).alias("country"))


@query(
    "c13_hires_near",
    f"""WITH {TOWNS}, w AS (SELECT * FROM towns WHERE town_id = 9), k AS (SELECT town_id % 40 AS employer, bool_and(CASE WHEN towns.town_id % 11 = 0 THEN false ELSE {km_sql('towns', 'w')} > 225 END) AS far FROM towns JOIN (SELECT country, latitude, longitude FROM w) w USING (country) GROUP BY 1)
    SELECT DISTINCT town_id % 40 AS employer FROM towns WHERE town_id % 40 NOT IN (SELECT employer FROM k WHERE far)""",
)
def c13(spark, d):
    t = towns(spark, d)
    known = F.col("town_id") % 11 > 0
    offices = t.select((F.col("town_id") % 40).alias("employer"), "country", F.when(known, F.col("latitude")).alias("latitude"), F.when(known, F.col("longitude")).alias("longitude"))
    wanted = t.where("town_id = 9").select("country", "latitude", "longitude", F.lit(200.0).alias("radius_km"))
    return S.hires_near(offices.select("employer").distinct(), offices, wanted)


@query("c15_needs_requirements", "SELECT doc_id AS job_key FROM documents WHERE n_chars % 101 >= 50 AND n_chars < 500 AND doc_id % 3 > 0")
def c15(spark, d):
    j = table(spark, d, "documents").select(F.col("doc_id").alias("job_key"), (F.col("n_chars") % 101).alias("score"), (F.col("n_chars") >= 500).alias("complete"), F.when(F.col("doc_id") % 3 == 0, True).alias("read_online"))
    return S.needs_requirements(j).select("job_key")


@query("c16_ground_places", "SELECT o_orderkey AS job_key, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 < 2 AND c_custkey % 2 = 0")
def c16(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    say = F.when(F.col("o_orderkey") % 4 < 2, F.concat(F.lit("Work in "), "c_name", F.lit(" now"))).otherwise("Work anywhere")
    from adweave.functions.text import normalise

    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(normalise(F.col("c_name")).alias("name"), F.lit("X").alias("country"))
    return S.ground_places(o.select(F.col("o_orderkey").alias("job_key"), F.lit(1).alias("at"), F.col("c_name").alias("name"), F.lit("X").alias("country"), say.alias("text")), known).select("job_key", "name")


@query("d19_screened", "SELECT p_partkey FROM part WHERE (p_name, p_brand) IN (SELECT p_name, p_brand FROM part WHERE p_partkey % 20 = 0)")
def d19(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"))
    return S.screened(p, p.where("p_partkey % 20 = 0")).select("p_partkey")


@query("d20_accepted_answers", "SELECT c_custkey AS id, arg_min(event_type, ts) AS answer FROM customer JOIN events ON user_id = c_custkey GROUP BY 1")
def d20(spark, d):
    answers = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("answer"), utc("ts").alias("at"))
    return S.accepted_answers(answers, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))[0]


@query(
    "d21_same_fact",
    "WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS a, list_distinct(string_split(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'other ' || p_name || ' a b' END, ' ')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) = least(len(a), len(b)) OR len(list_intersect(a, b)) >= 0.6 * len(list_distinct(list_concat(a, b))) AS same FROM w",
)
def d21(spark, d):
    p = table(spark, d, "part")
    a = F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "))
    b = F.array_distinct(F.split(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("other "), "p_name", F.lit(" a b"))), " "))
    return p.select("p_partkey", S.same_fact(a, b).alias("same"))


@query("i15_plan_countries", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'C1,C2' WHEN 1 THEN 'C1,C3' WHEN 2 THEN 'C3' ELSE 'C1,C2,C3,C4' END AS countries FROM customer")
def i15(spark, d):
    k = F.col("c_custkey") % 4
    listed = F.when(k == 0, F.array(F.lit("C2"), F.lit("C1"))).when(k == 1, F.array(F.lit("C1")))
    named = F.when(k.isin(1, 2), F.array(F.lit("C3")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(S.plan_countries(listed, named, ["C1", "C2", "C3", "C4"]), ",").alias("countries"))


@query("i16_rate_ad", "SELECT event_id, event_type AS rating, 'a' AS blockers, CASE WHEN event_type IS NOT NULL THEN user_id END AS rated_by FROM events WHERE event_type IN ('view', 'click')")
def i16(spark, d):
    e = table(spark, d, "events").select("event_id", F.lit("scored").alias("kind"), F.col("event_type").alias("rating"), F.array(F.lit("a"), F.lit("z")).alias("blockers"), F.col("props").alias("note"), F.col("user_id").alias("rated_by"), utc("ts").alias("rated_at"))
    good, _ = S.rate(e, {"scored": ["view", "click"]}, ["a", "b"])
    return good.select("event_id", "rating", F.array_join("blockers", ",").alias("blockers"), "rated_by")


@query("i12_to_redo", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def i12(spark, d):
    pool = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, "closed").alias("reason"))
    done = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.to_redo(pool, done, ["o_orderkey"]).select("o_orderkey")


@query("e18_condition_status", "SELECT l_suppkey AS condition_id, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 49) THEN 'estimate' ELSE 'applied' END AS status FROM lineitem GROUP BY 1")
def e18(spark, d):
    return S.condition_status(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("condition_id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), "estimate").otherwise("service").alias("by")))


@query("e10_employer_survey", "SELECT source AS employer, lang AS country, count(*) AS jobs, array_to_string(list_sort(list(DISTINCT n_chars % 90))[1:40], ',') AS towns FROM documents GROUP BY 1, 2")
def e10(spark, d):
    a = table(spark, d, "documents").select(F.col("source").alias("employer"), F.col("lang").alias("country"), (F.col("n_chars") % 90).alias("town"))
    return S.employer_survey(a).select("employer", "country", "jobs", F.array_join(F.transform("towns", lambda t: t.cast("string")), ",").alias("towns"))


@query("e5_source_report", "WITH f AS (SELECT event_type AS source, count(*) AS found, count(*) FILTER (value < 10) AS screened_out FROM events WHERE event_type <> 'error' GROUP BY 1), r AS (SELECT event_type AS source, CAST(sum(user_id % 3) AS BIGINT) AS requests FROM events GROUP BY 1) SELECT source, coalesce(found, 0) AS found, coalesce(screened_out, 0) AS screened_out, coalesce(requests, 0) AS requests, CASE WHEN coalesce(found, 0) = 0 AND coalesce(requests, 0) > 0 THEN 'nothing' ELSE 'searched' END AS status FROM f FULL JOIN r USING (source)")
def e5(spark, d):
    e = table(spark, d, "events")
    return S.source_report(e.where("event_type <> 'error'").select(F.col("event_type").alias("source"), (F.col("value") < 10).alias("screened_out")), e.select(F.col("event_type").alias("source"), (F.col("user_id") % 3).alias("requests")))


@query("e12_progress", "SELECT lang AS kind, count(*) AS collected, count(quality) AS rated FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1")
def e12(spark, d):
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("rating"))
    return S.progress(table(spark, d, "documents").select("doc_id", F.col("lang").alias("kind")).join(l, "doc_id", "left"))


@query("b40_smallest_town", "SELECT c_custkey, greatest(coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 10 END, 0), CAST(round_even(0.5 * c_custkey, 0) AS BIGINT)) AS least FROM customer")
def b40(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", smallest_town(F.when(k % 3 > 0, k * 10), F.lit(0.5), k).alias("least"))


@query("b11_contract_lookup", f"SELECT o_orderkey, {by_key_sql('o_orderkey', ['full_time_permanent', 'fixed_term', 'freelance_or_contract,fixed_term', ''])} AS types FROM orders")
def b11(spark, d):
    known = spark.createDataFrame([("a", ["full_time_permanent"]), ("b", ["fixed_term"]), ("c", ["freelance_or_contract", "fixed_term"])], "k string, types array<string>")
    o = table(spark, d, "orders").select("o_orderkey", by_key(F.col("o_orderkey"), ["a", "b", "c", "d"]).alias("k"))
    return o.join(F.broadcast(known), "k", "left").select("o_orderkey", F.coalesce(F.array_join("types", ","), F.lit("")).alias("types"))


@query("b25_b26_title_ratio")
def b26(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("a"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("b"))
    return t.select("p_partkey", F.round(dedupe.title_ratios("a", "b"), 4).alias("ratio"))


@query("g4_view_newest", "SELECT o_orderkey AS job_key, o_orderstatus FROM orders WHERE o_orderkey % 9 > 0")
def g4(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_key"), "o_orderstatus", F.col("o_orderdate").alias("posted_at"), F.floor("o_totalprice").alias("score"), (F.col("o_orderkey") % 9 == 0).alias("dismissed"))
    return S.view(c, "newest").select("job_key", "o_orderstatus")
