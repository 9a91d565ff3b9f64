"""Queries over places, distances and conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from adweave.functions.geo import edge_point, haversine_km
from adweave.operators import conditions as C
from adweave.operators import places as P
from adweave.plans.adapters import POINTS, TOWNS, by_key, by_key_sql, km_sql, points, reach_sql, table, towns, utc
from adweave.plans.text_queries import NORMALISE

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


REGION_ROWS = [(f"R{i}", "region", f"N{c}", [f"State {i}", f"Land {i}"]) for i in range(9) for c in range(3)]


def regions(spark):
    return spark.createDataFrame(REGION_ROWS, "code string, level string, country string, names array<string>")


def _texts(spark, d):
    """Places as ads write them: a town's name among other parts."""
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    name = F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    form = F.col("o_orderkey") % 4
    text = F.when(form == 0, name).when(form == 1, F.concat(F.lit("State 3, "), name)).when(form == 2, F.concat(name, F.lit("; nowhere"))).otherwise(F.lit("State 4"))
    return o.select(text.alias("text"), F.concat(F.lit("N"), (F.col("o_orderkey") % 3).cast("string")).alias("country"))


TEXTS = """texts AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN n WHEN 1 THEN 'State 3, ' || n WHEN 2 THEN n || '; nowhere' ELSE 'State 4' END AS text, 'N' || CAST(o_orderkey % 3 AS VARCHAR) AS country, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey END AS town
  FROM (SELECT *, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS n FROM orders))"""


@query("d9_locate", f"WITH {TOWNS}, {TEXTS} SELECT text, texts.country, town_id FROM texts JOIN towns ON town_id = town AND towns.country = texts.country")
def d9(spark, d):
    return P.locate(_texts(spark, d), towns(spark, d), regions(spark))


@query("d10_find_region", "SELECT DISTINCT 'Province of State ' || CAST(c_custkey % 12 AS VARCHAR) AS name, 'N' || CAST(c_nationkey % 3 AS VARCHAR) AS country, 'R' || CAST(c_custkey % 12 AS VARCHAR) AS code FROM customer WHERE c_custkey % 12 < 9")
def d10(spark, d):
    # "state" and "province of" both say only what kind of region it is, so the number is what is left
    c = table(spark, d, "customer").select(F.concat(F.lit("Province of State "), (F.col("c_custkey") % 12).cast("string")).alias("name"), F.concat(F.lit("N"), (F.col("c_nationkey") % 3).cast("string")).alias("country")).distinct()
    return P.find_region(c, regions(spark))


@query(
    "d11_town_at",
    f"""WITH {TOWNS}, {POINTS}, k AS (SELECT point_id, town_id, people, {km_sql('points', 'towns')} AS km FROM points JOIN towns USING (country)),
    i AS (SELECT point_id, arg_max(town_id, (people, -town_id)) AS town_id FROM k WHERE km <= {reach_sql('people')} GROUP BY 1), n AS (SELECT point_id, arg_min(town_id, (km, town_id)) AS town_id FROM k GROUP BY 1)
    SELECT n.point_id, coalesce(i.town_id, n.town_id) AS town_id FROM n LEFT JOIN i USING (point_id)""",
)
def d11(spark, d):
    return P.town_at(points(spark, d), towns(spark, d))


@query(
    "d12_part_of",
    f"""WITH {TOWNS} SELECT a.town_id, arg_max(b.town_id, (b.people, -b.town_id)) AS part_of FROM towns a JOIN towns b ON a.country = b.country AND b.people > a.people AND b.people >= 50000
    WHERE {km_sql('a', 'b')} <= {reach_sql('b.people')} GROUP BY 1""",
)
def d12(spark, d):
    return P.part_of(towns(spark, d))


@query(
    "d14_near_km",
    f"""WITH {TOWNS}, {POINTS} SELECT point_id, CASE WHEN EXISTS (SELECT 1 FROM towns a WHERE a.country = points.country AND greatest(0.0, {km_sql('points', 'a')} - {reach_sql('a.people')}) <= 12) THEN 'yes' ELSE 'no' END AS answer FROM points""",
)
def d14(spark, d):
    return C.near_km(points(spark, d), towns(spark, d), 12.0)


@query(
    "d16_travel_candidates",
    f"""WITH {TOWNS}, {POINTS}, k AS (SELECT point_id, town_id, {km_sql('points', 'a')} AS km FROM points JOIN towns a USING (country))
    SELECT point_id, town_id, round(km, 6) AS distance, CAST(row_number() OVER (PARTITION BY point_id ORDER BY km, town_id) AS INTEGER) AS place FROM k WHERE km <= 30 / 60.0 * 120 QUALIFY place <= 2""",
)
def d16(spark, d):
    return C.travel_candidates(points(spark, d), towns(spark, d), 30, "car").withColumn("distance", F.round("distance", 6))


@query("d15_near_minutes", "WITH m AS (SELECT l_orderkey, bool_or(coalesce(l_quantity <= 10, false)) AS ok FROM lineitem WHERE l_linenumber = 1 OR l_quantity > 40 GROUP BY 1) SELECT o_orderkey AS job_key, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'yes' ELSE 'no' END AS answer FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def d15(spark, d):
    measured = table(spark, d, "lineitem").where("l_linenumber = 1 OR l_quantity > 40").select(F.col("l_orderkey").alias("job_key"), F.col("l_quantity").alias("minutes"))
    return C.near_minutes(table(spark, d, "orders").select(F.col("o_orderkey").alias("job_key")), measured, 10)


@query(
    "d17_recall_travel",
    """WITH m AS (SELECT user_id % 20 AS origin, event_id % 30 AS destination, event_type AS mode, arg_max(value, ts) AS minutes FROM events WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY ALL),
    c AS (SELECT DISTINCT c_custkey % 25 AS origin, c_nationkey AS destination, 'view' AS mode FROM customer)
    SELECT c.origin, c.destination, round(m.minutes, 2) AS minutes, m.minutes IS NULL AS to_ask FROM c LEFT JOIN m USING (origin, destination, mode)""",
)
def d17(spark, d):
    m = table(spark, d, "events").select((F.col("user_id") % 20).alias("origin"), (F.col("event_id") % 30).alias("destination"), F.col("event_type").alias("mode"), F.col("value").alias("minutes"), utc("ts").alias("measured_at"))
    c = table(spark, d, "customer").select((F.col("c_custkey") % 25).alias("origin"), F.col("c_nationkey").cast("bigint").alias("destination"), F.lit("view").alias("mode")).distinct()
    known, ask = C.recall_travel(c, m, F.to_timestamp(F.lit("2024-02-20")), 30)
    done = known.select("origin", "destination", F.round("minutes", 2).alias("minutes"), F.lit(False).alias("to_ask"))
    return done.unionByName(ask.select("origin", "destination", F.lit(None).cast("double").alias("minutes"), F.lit(True).alias("to_ask")))


@query("i17_travel_detail", "SELECT l_orderkey AS job_key, arg_min(l_suppkey, (l_quantity, l_suppkey)) AS town, min(l_quantity) AS minutes, CASE WHEN min(l_quantity) <= 8 THEN 'near' ELSE 'too_far' END AS verdict FROM lineitem GROUP BY 1")
def i17(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_key"), F.col("l_suppkey").alias("town"), F.col("l_quantity").alias("minutes"))
    return C.travel_detail(m, 8)


@query("d18_region_members", f"WITH {TOWNS} SELECT town_id FROM towns WHERE (region IN ('R1', 'R5') OR district = 'D7' OR area = 'A3') AND town_id NOT IN (3, 10)")
def d18(spark, d):
    return C.region_members(towns(spark, d), ["R1", "R5", "D7", "A3"], [3, 10]).select("town_id")


CONDITION_ROWS = [(1, "N0", 100000, None, [], [], []), (2, "N1", None, 0.011, [], ["R2", "D4"], [4]), (3, "N2", None, None, [5, 8, 11, 20, 41, 80], [], [8])]
COUNTRY_PEOPLE = [("N0", 9_000_000), ("N1", 17_500_000), ("N2", 60_000_000)]


@query(
    "h2_anchor_towns",
    f"""WITH {TOWNS}, p AS (SELECT DISTINCT a.town_id FROM towns a JOIN towns b ON a.country = b.country AND b.people > a.people AND b.people >= 50000 WHERE {km_sql('a', 'b')} <= {reach_sql('b.people')})
    SELECT 1 AS condition_id, town_id FROM towns WHERE country = 'N0' AND people >= 100000 AND town_id NOT IN (SELECT town_id FROM p)
    UNION ALL SELECT 2, town_id FROM towns WHERE country = 'N1' AND people >= 192500 AND town_id NOT IN (SELECT town_id FROM p) AND (region = 'R2' OR district = 'D4') AND town_id <> 4
    UNION ALL SELECT 3, town_id FROM towns WHERE country = 'N2' AND town_id IN (5, 11, 20, 41, 80)""",
)
def h2(spark, d):
    t = towns(spark, d)
    rows = spark.createDataFrame(CONDITION_ROWS, "condition_id int, country string, min_people long, share double, towns array<long>, regions array<string>, avoid array<long>")
    return C.anchor_towns(t, rows, spark.createDataFrame(COUNTRY_PEOPLE, "country string, country_people long"), P.part_of(t))


@query(
    "i5_condition_fits",
    f"""WITH {TOWNS} SELECT town_id, CASE WHEN people % 10 = 0 THEN 'unknown' WHEN people >= 250000 THEN 'yes' ELSE 'no' END AS size,
    CASE WHEN country = 'N2' THEN 'unknown' WHEN people % 10 = 0 THEN 'unknown' WHEN region IN ('R1', 'R2') AND town_id % 7 <> 0 THEN 'yes' ELSE 'no' END AS fit,
    CASE WHEN country = 'N2' THEN 'yes' WHEN people % 10 = 0 THEN 'unknown' WHEN region IN ('R1', 'R2') AND town_id % 7 <> 0 THEN 'no' ELSE 'yes' END AS avoid FROM towns""",
)
def i5(spark, d):
    listed, excepted, here, known = F.col("region").isin("R1", "R2"), F.col("town_id") % 7 == 0, F.col("country") != "N2", F.col("people") % 10 != 0
    answer = lambda kind: C.fits(F.lit(kind), F.col("people"), F.lit(250000), listed, excepted, here, known)
    return towns(spark, d).select("town_id", answer("town_size").alias("size"), answer("towns_that_fit").alias("fit"), answer("towns_to_avoid").alias("avoid"))


@query("h4_narrow_countries", "SELECT c_custkey, array_to_string(list_filter(['C0', 'C1', 'C2', 'C3'], lambda x: (c_custkey % 3 = 0 OR x IN ('C1', 'C' || CAST(c_custkey % 5 AS VARCHAR))) AND x <> 'C' || CAST(c_nationkey % 4 AS VARCHAR)), ',') AS left_over FROM customer")
def h4(spark, d):
    k = F.col("c_custkey")
    only = F.when(k % 3 != 0, F.array(F.lit("C1"), F.concat(F.lit("C"), (k % 5).cast("string"))))
    never = F.array(F.concat(F.lit("C"), (F.col("c_nationkey") % 4).cast("string")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(C.narrow_countries(F.array(*(F.lit(f"C{i}") for i in range(4))), only, never), ",").alias("left_over"))


@query("i8_apply_edits", "SELECT c_custkey AS condition_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 15 <> 0 THEN c_custkey % 2 = 0 ELSE false END AS switched_off, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 15 <> 0 THEN c_custkey * 10 ELSE 1000 END AS min_people, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 15 <> 0 AND c_nationkey % 2 = 0 THEN false ELSE true END AS measured, c_custkey % 3 = 0 AND c_custkey % 15 <> 0 AS changed_by_you FROM customer")
def i8(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    own = c.select(k.alias("condition_id"), F.lit(False).alias("switched_off"), F.lit(1000).cast("bigint").alias("min_people"), F.lit(60).alias("max_minutes"), F.lit("car").alias("travel_mode"), F.lit(True).alias("measured"))
    edits = c.where("c_custkey % 3 = 0").select(k.alias("condition_id"), (k % 2 == 0).alias("switched_off"), F.when(k % 15 == 0, -1).otherwise(k * 10).alias("min_people"), F.lit(None).cast("int").alias("max_minutes"), F.when(F.col("c_nationkey") % 2 == 0, "train").alias("travel_mode"))
    out, _ = C.apply_edits(own, edits)
    return out.select("condition_id", "switched_off", "min_people", "measured", "changed_by_you")


@query("b20_b22_edge_point", f"WITH {TOWNS}, {POINTS}, k AS (SELECT point_id, town_id, t.latitude AS tl, t.longitude AS to_, points.latitude AS pl, points.longitude AS po, people, {km_sql('points', 't')} AS km FROM points JOIN towns t ON t.town_id = point_id) SELECT point_id, round(km, 5) AS km, round(tl + (pl - tl) * least(1.0, {reach_sql('people')} / km), 5) AS lat, round(to_ + (po - to_) * least(1.0, {reach_sql('people')} / km), 5) AS lon FROM k")
def b22(spark, d):
    p = points(spark, d).withColumnsRenamed({"latitude": "pl", "longitude": "po"}).drop("country")
    both = p.join(towns(spark, d), F.col("town_id") == F.col("point_id"))
    at = [F.col(c) for c in ("pl", "po", "latitude", "longitude")]
    lat, lon = edge_point(*at, F.col("people"))
    return both.select("point_id", F.round(haversine_km(*at), 5).alias("km"), F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


PLACE_NAMES = [("Northland", "NL"), ("North", "XX"), ("North Ireland", "GB"), ("Ireland", "IE"), ("Ohio", "other"), ("Dublin", "IE")]
SPOTS = ["Dublin, North Ireland", "Ireland", "Dublin Ohio", "Northland; Ireland", "nothing", "North", "Dublin or Northland"]
SPOT_CODES = ["GB,IE", "IE", "other", "IE,NL", "", "XX", "IE,NL"]


@query("b12_countries_in", f"SELECT DISTINCT {by_key_sql('o_orderkey', SPOTS)} || ' ' || CAST(o_custkey AS VARCHAR) AS text, {by_key_sql('o_orderkey', SPOT_CODES)} AS codes FROM orders")
def b12(spark, d):
    t = table(spark, d, "orders").select(F.concat_ws(" ", by_key(F.col("o_orderkey"), SPOTS), F.col("o_custkey").cast("string")).alias("text"))
    return P.countries_in(t, spark.createDataFrame(PLACE_NAMES, "name string, code string")).select("text", F.array_join("countries", ",").alias("codes"))


@query("a30_town_names", f"WITH {TOWNS}, n AS (SELECT {NORMALISE.format('name')} AS name, country, town_id, people FROM towns UNION SELECT {NORMALISE.format('name2')}, country, town_id, people FROM towns) SELECT name, country, arg_max(town_id, (people, -town_id)) AS town_id FROM n GROUP BY 1, 2")
def a30(spark, d):
    return P.town_names(towns(spark, d)).select("name", "country", "town_id")


@query("a29_postcode_points", f"WITH {TOWNS} SELECT 'P' || CAST(town_id % 200 AS VARCHAR) AS code, country, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM towns GROUP BY 1, 2")
def a29(spark, d):
    t = towns(spark, d).withColumn("code", F.concat(F.lit("P"), (F.col("town_id") % 200).cast("string")))
    return P.postcode_points(t).select("code", "country", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))
