"""Queries over where jobs are, late rules, languages and what is new."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adweave.operators import results as S
from adweave.plans.adapters import by_key, by_key_sql, table, utc
from adweave.streaming import feeds

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def order_of_lines():
    """Numbers of an order's lines repeat, so the part and quantity go along."""
    return (F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_quantity").cast("bigint")


@query(
    "d25_job_point",
    """WITH c AS (SELECT l_orderkey AS job_key, (l_linenumber * 100000 + l_partkey) * 1000 + CAST(l_quantity AS BIGINT) AS ordinal, 'C' || CAST(l_suppkey % 7 AS VARCHAR) AS country,
      CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey % 90 AS DOUBLE) END AS lat, CASE WHEN l_partkey % 8 = 0 OR l_partkey % 4 > 0 THEN CAST(l_suppkey % 180 AS DOUBLE) END AS lon,
      CASE WHEN l_partkey % 3 = 0 THEN CAST(l_quantity AS DOUBLE) END AS tlat, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS tlon FROM lineitem),
    j AS (SELECT job_key, arg_min(country, ordinal) FILTER (country IN ('C1', 'C2', 'C5')) AS country,
      arg_min({'a': lat, 'b': lon}, ordinal) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS p, arg_min({'a': tlat, 'b': tlon}, ordinal) FILTER (tlat IS NOT NULL) AS t FROM c GROUP BY 1)
    SELECT job_key, country, CASE WHEN p IS NOT NULL THEN p.a ELSE t.a END AS latitude, CASE WHEN p IS NOT NULL THEN p.b ELSE t.b END AS longitude, CASE WHEN p IS NOT NULL THEN 'address' WHEN t IS NOT NULL THEN 'town' END AS how FROM j""",
)
def d25(spark, d):
    i, p, s = table(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    number = lambda test, value: F.when(test, value.cast("double"))
    copies = i.select(
        F.col("l_orderkey").alias("job_key"), order_of_lines().alias("ordinal"), F.concat(F.lit("C"), (s % 7).cast("string")).alias("country"),
        number(p % 4 == 0, p % 90).alias("latitude"), number((p % 8 == 0) | (p % 4 > 0), s % 180).alias("longitude"),
        number(p % 3 == 0, F.col("l_quantity")).alias("town_latitude"), number(p % 3 == 0, F.col("l_linenumber")).alias("town_longitude"),
    )
    return S.job_points(copies, ("C1", "C2", "C5"))


@query(
    "b30_town_of_district",
    """WITH a AS (SELECT c_custkey, n_regionkey AS country, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || '-' || c_mktsegment WHEN 2 THEN 'Nowhere-' || n_name ELSE c_mktsegment END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    t AS (SELECT lower(n_name) AS name, n_regionkey AS country FROM nation)
    SELECT c_custkey, a.name, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.name = lower(a.name) AND t.country = a.country) THEN a.name
      WHEN contains(a.name, '-') AND EXISTS (SELECT 1 FROM t WHERE t.name = lower(string_split(a.name, '-')[1]) AND t.country = a.country) THEN string_split(a.name, '-')[1] END AS town FROM a""",
)
def b30(spark, d):
    n, k = table(spark, d, "nation"), F.col("c_custkey")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lower("n_name"), F.lit("-"), "c_mktsegment")).when(k % 4 == 2, F.concat(F.lit("Nowhere-"), "n_name")).otherwise(F.col("c_mktsegment"))
    asked = c.select("c_custkey", name.alias("name"), F.col("n_regionkey").alias("country"))
    return S.towns_of_districts(asked, n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("country"))).drop("country")


STATED = ["part_time", "part_time,fixed_term", "", "full_time_permanent", "full_time_permanent,fixed_term"]
READ = ["part_time", "", "fixed_term"]
LATE_MODES = ["remote", "on_site", "", "hybrid"]


@query(
    "c14_late_rules",
    f"""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'closed' END AS reason, nullif({by_key_sql("o_custkey", LATE_MODES)}, '') AS mode,
      list_filter(string_split({by_key_sql("o_orderkey", STATED)}, ','), lambda x: x <> '') AS stated, nullif({by_key_sql("o_custkey", READ)}, '') AS read, o_custkey % 2 = 0 AS no_remote FROM orders),
    e AS (SELECT *, CASE WHEN len(stated) = 0 AND read IS NOT NULL THEN [read] WHEN len(stated) > 1 AND list_contains(stated, read) THEN [read] ELSE stated END AS types FROM o)
    SELECT k AS o_orderkey, CASE WHEN reason IS NOT NULL THEN reason WHEN no_remote AND mode = 'remote' THEN 'remote_by_text' WHEN len(types) > 0 AND NOT list_has_any(types, ['part_time', 'fixed_term']) THEN 'job_type_by_text' END AS reason FROM e""",
)
def c14(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    some = lambda s: F.filter(F.split(s, ","), lambda x: x != "")
    maybe = lambda s: F.nullif(s, F.lit(""))
    wanted = F.array(F.lit("part_time"), F.lit("fixed_term"))
    return o.select("o_orderkey", S.late_reason(F.when(k % 10 == 0, "closed"), maybe(by_key(c, LATE_MODES)), some(by_key(k, STATED)), maybe(by_key(c, READ)), c % 2 == 0, wanted).alias("reason"))


SPOKEN = ["de", "fr,de,it", "en,ga", "nl,fr,de", "es"]


@query(
    "b15_languages_for",
    f"""WITH c AS (SELECT l_orderkey AS id, (l_linenumber * 100000 + l_partkey) * 1000 + CAST(l_quantity AS BIGINT) AS line, string_split({by_key_sql("l_suppkey", SPOKEN)}, ',') AS own, CASE l_partkey % 3 WHEN 0 THEN ['fr', 'ga'] WHEN 1 THEN ['de'] ELSE [] END AS place FROM lineitem),
    n AS (SELECT id, line, CASE WHEN len(own) > 1 AND list_has_any(own, place) THEN list_filter(own, lambda x: list_contains(place, x)) ELSE own END AS own FROM c),
    u AS (SELECT id, 0 AS line, 0 AS place, 'en' AS lang FROM n UNION ALL SELECT id, line, generate_subscripts(own, 1), unnest(own) FROM n),
    f AS (SELECT id, lang, min(line * 100 + place) AS first FROM u GROUP BY 1, 2)
    SELECT id AS search_id, string_agg(lang, ',' ORDER BY first) AS languages FROM f GROUP BY 1""",
)
def b15(spark, d):
    i, p = table(spark, d, "lineitem"), F.col("l_partkey")
    place = F.when(p % 3 == 0, F.array(F.lit("fr"), F.lit("ga"))).when(p % 3 == 1, F.array(F.lit("de"))).otherwise(F.array().cast("array<string>"))
    rows = i.select(F.col("l_orderkey").alias("search_id"), order_of_lines().alias("ordinal"), F.split(by_key(F.col("l_suppkey"), SPOKEN), ",").alias("languages"), place.alias("place_languages"))
    return S.languages_for(rows).withColumn("languages", F.array_join("languages", ","))


@query(
    "e17_shown_counts",
    "WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1), r AS (SELECT event_type AS search_id, e.user_id, bool_or(event_id = first) AS is_new FROM events e JOIN f USING (user_id) GROUP BY 1, 2) SELECT search_id, count(*) AS shown, count(*) FILTER (is_new) AS new_count FROM r GROUP BY 1",
)
def e17(spark, d):
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    return S.shown_counts(e.join(first, "user_id").select(F.col("event_type").alias("search_id"), F.col("user_id").alias("job_id"), (F.col("event_id") == F.col("first")).alias("is_new")))


@query("k4_changed_since", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '2024-01-20') - INTERVAL 5 MINUTE")
def k4(spark, d):
    """The second run's rows: the first one saw all up to a day in the middle."""
    e, name = table(spark, d, "events").withColumn("at", utc("ts")), f"k4-{uuid.uuid4().hex}"
    first, commit = feeds.changed_since(e.where(F.col("at") <= F.to_timestamp(F.lit("2024-01-20"))), "at", name)
    first.write.format("noop").mode("overwrite").save()
    commit()
    return feeds.changed_since(e, "at", name)[0].select("event_id")
