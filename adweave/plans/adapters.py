"""The given tables seen as the engine's inputs, for Spark and for SQL alike.

No given table holds job ads.  Each function here maps one to an operator's
input; the text constant beside it is the same mapping in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(c: str | Column) -> Column:
    """A time without zone as UTC; the session's zone may be any."""
    return F.to_utc_timestamp(F.col(c) if isinstance(c, str) else c, F.current_timezone())


def by_key(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def by_key_sql(key: str, values: list[str]) -> str:
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as ads: the source is the company, the first six words the title."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ad_id"), F.col("doc_id").alias("ordinal"), "source", F.col("doc_id").cast("string").alias("source_job_id"),
        F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"), F.col("source").alias("company"), F.col("lang").alias("country"),
        F.lit(None).cast("string").alias("town"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.col("text").alias("description"), (F.col("n_chars") >= 500).alias("complete"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("posted_at"),
    )


ADS = """ads AS (SELECT doc_id AS ad_id, doc_id AS ordinal, source, CAST(doc_id AS VARCHAR) AS source_job_id,
  array_to_string(string_split(text, ' ')[1:6], ' ') AS title, source AS company, lang AS country, text AS description, n_chars >= 500 AS complete,
  TIMESTAMP '2024-01-01' + to_hours(doc_id) AS posted_at FROM documents)"""

TYPES = ["full_time_permanent", "fixed_term", "part_time", "", "internship_or_working_student"]
MODES = ["on_site", "hybrid", "remote", "", "on_site", "on_site", "hybrid"]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs, with how exactly their day is known."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("job_key"), utc("o_orderdate").alias("posted_at"), by_key(k, ["exact", "day", "unknown"]).alias("date_precision"),
        (k % 11 == 0).alias("dismissed"), (k % 13 == 0).alias("condition_no"), F.col("o_custkey").alias("company_id"), F.col("o_totalprice").alias("price"),
    )


JOBS = f"""jobs AS (SELECT o_orderkey AS job_key, o_orderdate AS posted_at, {by_key_sql("o_orderkey", ["exact", "day", "unknown"])} AS date_precision,
  o_orderkey % 11 = 0 AS dismissed, o_orderkey % 13 = 0 AS condition_no, o_custkey AS company_id, o_totalprice AS price FROM orders)"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line items as the copies of a job at several sources."""
    i = table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey")
    kind = by_key(n, TYPES)
    mode = by_key(n, MODES)
    return i.select(
        F.col("l_orderkey").alias("job_key"), F.col("l_linenumber").alias("line"), F.when(kind != "", F.array(kind)).alias("job_types"), F.when(mode != "", mode).alias("work_mode"),
        F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("C"), (F.col("l_suppkey") % 5).cast("string"))).alias("country"),
        F.when(n % 3 == 0, utc("l_shipdate")).alias("closes_at"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("source"),
    )


COPIES = f"""copies AS (SELECT l_orderkey AS job_key, l_linenumber AS line, nullif({by_key_sql("l_partkey", TYPES)}, '') AS job_type, nullif({by_key_sql("l_partkey", MODES)}, '') AS work_mode,
  CASE WHEN l_suppkey % 4 > 0 THEN 'C' || CAST(l_suppkey % 5 AS VARCHAR) END AS country,
  CASE WHEN l_partkey % 3 = 0 THEN l_shipdate END AS closes_at, 's' || CAST(l_suppkey % 7 AS VARCHAR) AS source FROM lineitem)"""


def _spot(key: Column, step: int, low: float) -> Column:
    return F.lit(low) + (key * step % 997) / 100.0


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as towns, at places that follow from their keys."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("town_id"), F.array("c_name", F.concat(F.lit("Bad "), F.col("c_mktsegment"), F.lit(" "), k.cast("string"))).alias("names"), F.concat(F.lit("N"), (F.col("c_nationkey") % 3).cast("string")).alias("country"),
        _spot(k, 37, 45.0).alias("latitude"), _spot(k, 61, 5.0).alias("longitude"), (k * 7919 % 900000 + 500).alias("people"),
        F.concat(F.lit("R"), (k % 9).cast("string")).alias("region"), F.concat(F.lit("D"), (k % 31).cast("string")).alias("district"), F.concat(F.lit("A"), (k % 101).cast("string")).alias("area"),
    )


TOWNS = """towns AS (SELECT c_custkey AS town_id, c_name AS name, 'Bad ' || c_mktsegment || ' ' || CAST(c_custkey AS VARCHAR) AS name2, 'N' || CAST(c_nationkey % 3 AS VARCHAR) AS country,
  45.0 + (c_custkey * 37 % 997) / 100.0 AS latitude, 5.0 + (c_custkey * 61 % 997) / 100.0 AS longitude, c_custkey * 7919 % 900000 + 500 AS people,
  'R' || CAST(c_custkey % 9 AS VARCHAR) AS region, 'D' || CAST(c_custkey % 31 AS VARCHAR) AS district, 'A' || CAST(c_custkey % 101 AS VARCHAR) AS area FROM customer)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as points on the map."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("point_id"), F.concat(F.lit("N"), (F.col("s_nationkey") % 3).cast("string")).alias("country"), _spot(k, 53, 45.1).alias("latitude"), _spot(k, 29, 5.1).alias("longitude"))


POINTS = """points AS (SELECT s_suppkey AS point_id, 'N' || CAST(s_nationkey % 3 AS VARCHAR) AS country,
  45.1 + (s_suppkey * 53 % 997) / 100.0 AS latitude, 5.1 + (s_suppkey * 29 % 997) / 100.0 AS longitude FROM supplier)"""


def km_sql(a: str, b: str) -> str:
    return (
        f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude))"
        f" * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2)))))"
    )


def reach_sql(people: str) -> str:
    return f"greatest(1.5, 0.6 * pow({people} / 1000.0, 0.4))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger: the type is the step, the value tokens."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", utc("ts").alias("ts"), "user_id", F.col("event_type").alias("source"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), F.round(F.col("value") * 100).cast("bigint").alias("input_tokens"), F.round(F.col("value") * 10).cast("bigint").alias("output_tokens"))


EVENTS = """ledger AS (SELECT event_id, ts, user_id, event_type AS source, 'm' || CAST(user_id % 4 AS VARCHAR) AS model,
  CAST(round(value * 100) AS BIGINT) AS input_tokens, CAST(round(value * 10) AS BIGINT) AS output_tokens FROM events)"""

LANGS = ["en", "de", "fr", "es"]
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line items as evidence on jobs, their suppliers' keys as people's levels."""
    i = table(spark, sf_dir, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    asked = F.array(
        F.struct(by_key(p, LANGS).alias("language"), by_key(s + p, [*LEVELS, "not_needed"]).alias("level"), (p % 2 == 0).alias("must_have")),
        F.struct(by_key(p + 1, LANGS).alias("language"), by_key(s * 3 + p, [*LEVELS, "not_needed"]).alias("level"), (p % 3 == 0).alias("must_have")),
    )
    spoken = F.array(F.struct(by_key(s, LANGS).alias("language"), by_key(s, LEVELS).alias("level")), F.struct(by_key(s + 1, LANGS).alias("language"), by_key(s + 2, LEVELS).alias("level")))
    return i.select(
        F.col("l_orderkey").alias("job_key"), F.col("l_linenumber").alias("line"), asked.alias("languages_asked"), F.when(s % 10 > 0, spoken).alias("languages"), by_key(p + s, LANGS).alias("ad_language"),
        F.col("l_quantity").cast("int").alias("role_and_skills"), (p % 25).cast("int").alias("seniority"), (p % 17).cast("int").alias("hard_requirements"), (s % 12).cast("int").alias("location_and_preferences"),
        F.when(p % 5 > 0, (p % 12).cast("double")).alias("years_required"), F.when(s % 6 > 0, (s % 8).cast("double")).alias("years_full_time"),
        F.when(p % 41 == 0, "out_of_reach").alias("citizenship"), F.when(p % 23 == 0, "lacking").alias("doctorate"),
    )


EVIDENCE = f"""evidence AS (SELECT l_orderkey AS job_key, l_linenumber AS line,
  {by_key_sql("l_partkey", LANGS)} AS a1, {by_key_sql("(l_suppkey + l_partkey)", [*LEVELS, "not_needed"])} AS v1, l_partkey % 2 = 0 AS m1,
  {by_key_sql("(l_partkey + 1)", LANGS)} AS a2, {by_key_sql("(l_suppkey * 3 + l_partkey)", [*LEVELS, "not_needed"])} AS v2, l_partkey % 3 = 0 AS m2,
  l_suppkey % 10 > 0 AS known, {by_key_sql("l_suppkey", LANGS)} AS s1, l_suppkey % 6 + 1 AS h1, {by_key_sql("(l_suppkey + 1)", LANGS)} AS s2, (l_suppkey + 2) % 6 + 1 AS h2,
  {by_key_sql("(l_partkey + l_suppkey)", LANGS)} AS ad_language,
  CAST(l_quantity AS INTEGER) AS role, l_partkey % 25 AS seniority, l_partkey % 17 AS hard, l_suppkey % 12 AS place,
  CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey % 12 AS DOUBLE) END AS years_required, CASE WHEN l_suppkey % 6 > 0 THEN CAST(l_suppkey % 8 AS DOUBLE) END AS years_have,
  l_partkey % 41 = 0 AS citizenship, l_partkey % 23 = 0 AS doctorate FROM lineitem)"""
