"""Places: names to towns, points to towns, countries in a text.

``towns`` has town_id, names (array, the first is the name), country, latitude,
longitude, people, region, district, area; ``regions`` code, level, country,
names (array).  Both are dimension tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.functions.geo import cell, haversine_km, reach_km
from adweave.functions.storage import materialise
from adweave.functions.text import bound, normalise, postcodes, region_key

MAX_NAME_WORDS = 4
#: Degrees of a grid cell.
CELL = 0.5
QUALIFIER = "\\s*\\([^)]*\\)|,.*$| (an der|am|im|upon|on) .*$"


def town_names(towns: DataFrame) -> DataFrame:
    """``name, country, town_id, people, latitude, longitude``: every spelling, and
    each without its qualifier; of a name in a country only the biggest town."""
    spelled = towns.select("town_id", "country", "people", "latitude", "longitude", F.explode("names").alias("n"))
    both = spelled.withColumn("name", F.explode(F.array_distinct(F.array(normalise(F.col("n")), normalise(F.regexp_replace("n", QUALIFIER, ""))))))
    best = F.struct("people", (-F.col("town_id")).alias("o"))
    return both.where("name <> ''").groupBy("name", "country").agg(*(F.max_by(c, best).alias(c) for c in ("town_id", "people", "latitude", "longitude")))


def name_runs(text: Column) -> Column:
    """Runs of one to four words with the place of the first: ``array<struct<n, at, name>>``."""

    def run(words: Column, n: int) -> Column:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.array_join(F.slice(words, i, n), " ").alias("name")))

    words = F.filter(F.split(normalise(text), " "), lambda w: w != "")
    return bound(words, lambda w: F.concat(*(run(w, n) for n in range(1, MAX_NAME_WORDS + 1))))


def locate(texts: DataFrame, towns: DataFrame, regions: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``text, country, town_id``: the town that each distinct text names.

    The name with most words wins, then the bigger town, then the first.  Parts
    that are a state's name don't count, a district's only where no other part
    names a town.  A text without a town but with a known postcode (``codes``:
    code, country, latitude, longitude) is in that point's town.  Texts without
    any have no row.
    """
    wanted = texts.select("text", "country").where("text IS NOT NULL AND country IS NOT NULL").distinct()
    states = regions.where("level = 'region'").select(F.explode("names").alias("n")).select(normalise(F.col("n")).alias("name")).distinct()
    parts = wanted.select("text", "country", F.posexplode(F.split("text", "[,;|]")).alias("i", "part")).withColumn("name", normalise(F.col("part")))
    parts = parts.join(states, "name", "left_anti")
    district = F.lower("part").rlike("\\b(kreis|landkreis|county|district|co\\.)")
    runs = parts.select("text", "country", "i", district.alias("vague"), F.explode(name_runs(F.col("part"))).alias("r")).select("text", "country", "i", "vague", "r.*")
    hits = runs.join(town_names(towns), ["name", "country"])
    best = F.struct((~F.col("vague")).alias("sure"), "n", "people", (-F.col("i")).alias("i"), (-F.col("at")).alias("at"))
    found = hits.groupBy("text", "country").agg(F.max_by("town_id", best).alias("town_id"))
    if codes is None:
        return found
    left = wanted.join(found, ["text", "country"], "left_anti").select("text", "country", F.posexplode(postcodes(F.col("text"))).alias("i", "code"))
    points = left.join(codes, ["code", "country"]).groupBy("text", "country").agg(F.min_by(F.struct("latitude", "longitude"), "i").alias("p"))
    points = points.select("text", "country", "p.*").withColumn("point_id", F.xxhash64("text", "country"))
    inside = town_at(points, towns).select("point_id", "town_id")
    return found.unionByName(points.join(inside, "point_id").select("text", "country", "town_id"))


def around(latitude: Column, longitude: Column, km: Column, degrees: float = CELL) -> Column:
    """The grid cells that a circle can touch, also over a pole or the line where longitudes start again."""
    d_lat = km / 111.0
    top = F.abs(latitude) + d_lat
    d_lon = F.when(top >= 89.9, F.lit(180.0)).otherwise(d_lat / F.cos(F.radians(top)))
    line = lambda v, d: F.sequence(F.floor((v - d) / degrees).cast("int"), F.floor((v + d) / degrees).cast("int"))
    turn = round(360 / degrees)
    lons = F.when(d_lon >= 180, F.sequence(F.lit(0), F.lit(turn - 1))).otherwise(F.array_distinct(F.transform(line(longitude, F.least(d_lon, F.lit(180.0))), lambda b: F.pmod(b, F.lit(turn)))))
    return F.flatten(F.transform(line(latitude, d_lat), lambda a: F.transform(lons, lambda b: F.struct(a.alias("c_lat"), b.alias("c_lon")))))


def stands_in(latitude: Column, longitude: Column, degrees: float = CELL) -> tuple[Column, Column]:
    """The grid cell of a point, as ``around`` counts them."""
    return cell(latitude, degrees).alias("c_lat"), F.pmod(cell(longitude, degrees), F.lit(round(360 / degrees))).alias("c_lon")


def within(points: DataFrame, circles: DataFrame, km: str = "km") -> DataFrame:
    """Points (point_id, country, latitude, longitude) in circles (circle_id, country,
    latitude, longitude, km): every pair, with ``distance``.

    A range join by grid cells: a circle is copied to each cell that it can
    touch, a point stands in one.
    """
    p = points.select("*", *stands_in(F.col("latitude"), F.col("longitude"))).withColumnsRenamed({"latitude": "p_lat", "longitude": "p_lon"})
    c = circles.withColumn("c", F.explode(around(F.col("latitude"), F.col("longitude"), F.col(km)))).select("*", "c.*").drop("c").withColumnsRenamed({"latitude": "q_lat", "longitude": "q_lon"})
    both = p.join(c, ["country", "c_lat", "c_lon"]).withColumn("distance", haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon")))
    return both.where(F.col("distance") <= F.col(km)).drop("c_lat", "c_lon")


SPOT = ["country", "latitude", "longitude"]


def by_spot(towns: DataFrame, least_ids: int = 1) -> DataFrame:
    """The towns of each spot as one row: ``country, latitude, longitude, people, town_id, ids``.

    ``town_id`` has most ``people`` (ties: the least id), and what that one
    doesn't reach no other of the spot does; ``ids`` are the spot's least ones, in order.
    """
    best = F.struct("people", (-F.col("town_id")).alias("o"))
    if least_ids == 1:
        ids = F.array(F.min("town_id"))
        return towns.groupBy(*SPOT).agg(F.max("people").alias("people"), F.max_by("town_id", best).alias("town_id"), ids.alias("ids"))
    # least ids are found part by part, so a spot with very many towns is no large group
    part = F.pmod(F.xxhash64("town_id"), F.lit(64))
    few = lambda c: F.slice(F.array_sort(c), 1, least_ids)
    w = Window.partitionBy(*SPOT, part).orderBy("town_id")
    first = towns.withColumn("_n", F.row_number().over(w))
    return first.groupBy(*SPOT).agg(F.max("people").alias("people"), F.max_by("town_id", best).alias("town_id"), few(F.collect_list(F.when(F.col("_n") <= least_ids, F.col("town_id")))).alias("ids"))


def of_spots(points: DataFrame) -> DataFrame:
    """Each different spot of points once, as ``point_id`` (its country and coordinates)."""
    spots = points.select(*SPOT).where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    return spots.select(F.struct(*SPOT).alias("point_id"), *SPOT)


def to_points(points: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` of spots for the points that stand there."""
    return points.select("point_id", *SPOT).join(found.select("*", "point_id.*").drop("point_id"), SPOT).drop(*SPOT)


#: Half the way round the earth: no ring is wider.
WIDEST_KM = 20_038.0


def nearest_by_rings(points: DataFrame, towns: DataFrame, first_km: float = 100.0) -> DataFrame:
    """``point_id, town_id, distance``: the nearest town of each point's country, ties by town_id.

    Places ask once, however many points they have.  Each round joins the places
    that are still open with the towns in the cells around them, at cells as wide
    as the ring, so that a place asks for some ten of them; a place with a town
    in the ring is done, the others go on with twice the ring.  Points of
    countries without towns, or without coordinates, have no row.
    """
    centres = towns.groupBy("country", F.col("latitude").alias("q_lat"), F.col("longitude").alias("q_lon")).agg(F.min("town_id").alias("town_id"))
    centres = materialise(centres, "rings-centres")
    spot = ["country", "latitude", "longitude"]
    spots = points.select(*spot).where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    still = materialise(spots.join(centres.select("country").distinct(), "country", "left_semi"), "rings-open")
    done, km = [], first_km
    while not still.isEmpty():
        degrees = 360 / max(1, int(360 * 111 / km))
        asked = still.select(*spot, F.explode(around(F.col("latitude"), F.col("longitude"), F.lit(km), degrees)).alias("c")).select(*spot, "c.*")
        met = asked.join(centres.select("*", *stands_in(F.col("q_lat"), F.col("q_lon"), degrees)), ["country", "c_lat", "c_lon"])
        met = met.select(*spot, "town_id", haversine_km(F.col("latitude"), F.col("longitude"), F.col("q_lat"), F.col("q_lon")).alias("distance"))
        hits = met.where(F.col("distance") <= km).groupBy(*spot).agg(F.min(F.struct("distance", "town_id")).alias("best"))
        hits = materialise(hits.select(*spot, "best.town_id", "best.distance"), "rings-done")
        done.append(hits)
        if km >= WIDEST_KM:
            break
        still, km = materialise(still.join(hits, spot, "left_anti"), "rings-open"), min(2 * km, WIDEST_KM)
    if not done:
        return points.join(centres.select("country", "town_id", F.lit(0.0).alias("distance")).where("false"), "country").select("point_id", "town_id", "distance")
    return points.join(reduce(DataFrame.unionByName, done), spot).select("point_id", "town_id", "distance")


def town_at(points: DataFrame, towns: DataFrame) -> DataFrame:
    """``point_id, town_id``: the biggest town that reaches the point, else the nearest.

    Points are (point_id, country, latitude, longitude); those without
    coordinates, or in a country without towns, have no row.
    """
    circles = by_spot(towns).select(F.col("town_id").alias("circle_id"), *SPOT, "people", reach_km(F.col("people")).alias("km"))
    inside = within(of_spots(points), circles).groupBy("point_id").agg(F.max_by("circle_id", F.struct("people", (-F.col("circle_id")).alias("o"))).alias("town_id"))
    inside = materialise(to_points(points, inside), "towns-inside")
    rest = points.join(inside, "point_id", "left_anti")
    return inside.unionByName(nearest_by_rings(rest, towns).select("point_id", "town_id"))


def part_of(towns: DataFrame, least: int = 50_000) -> DataFrame:
    """``town_id, part_of``: the biggest larger town, of ``least`` people on, that reaches it."""
    points = towns.select(F.col("town_id").alias("point_id"), "country", "latitude", "longitude", F.col("people").alias("own"))
    big = by_spot(towns.where(F.col("people") >= least)).select(F.col("town_id").alias("circle_id"), *SPOT, "people", reach_km(F.col("people")).alias("km"))
    found = within(points, big).where(F.col("people") > F.col("own"))
    return found.groupBy(F.col("point_id").alias("town_id")).agg(F.max_by("circle_id", F.struct("people", (-F.col("circle_id")).alias("o"))).alias("part_of"))


def find_region(names: DataFrame, regions: DataFrame) -> DataFrame:
    """``name, country, code``: whole names before shortened ones, states before districts."""
    spelled = regions.select("code", "level", "country", F.explode("names").alias("n"))
    keys = spelled.select("code", "level", "country", F.explode(F.array(F.struct(F.lit(0).alias("short"), normalise(F.col("n")).alias("key")), F.struct(F.lit(1).alias("short"), region_key(F.col("n")).alias("key")))).alias("k")).select("code", "level", "country", "k.*")
    asked = names.select("name", "country", F.explode(F.array(F.struct(F.lit(0).alias("cut"), normalise(F.col("name")).alias("key")), F.struct(F.lit(1).alias("cut"), region_key(F.col("name")).alias("key")))).alias("k")).select("name", "country", "k.*").where("key <> ''")
    rank = F.struct("cut", (F.col("level") != "region").alias("l"), "short", "code")
    return asked.join(keys, ["country", "key"]).groupBy("name", "country").agg(F.min_by("code", rank).alias("code"))


def countries_in(texts: DataFrame, place_names: DataFrame) -> DataFrame:
    """``text, countries``: the codes that a text's place names stand for.

    ``place_names`` is (name, code), where code ``other`` is any place outside the
    countries covered.  Each segment is read by itself; a longer name uses up its
    words before a shorter one is looked for; a foreign name beside a covered
    country makes the segment foreign.
    """
    wanted = texts.select("text").where("text IS NOT NULL").distinct()
    parts = wanted.select("text", F.posexplode(F.split("text", "\\s*(?:;|\\||\\n| / | or | oder | und )\\s*")).alias("i", "part"))
    runs = parts.select("text", "i", F.explode(name_runs(F.col("part"))).alias("r")).select("text", "i", "r.*")
    hits = runs.join(place_names.select(normalise(F.col("name")).alias("name"), "code").distinct(), "name")
    group = hits.groupBy("text", "i").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("o"), "at", (F.col("at") + F.col("n")).alias("to"), "code"))).alias("h"))
    zero = F.struct(F.array().cast("array<struct<at:int,to:int>>").alias("used"), F.array().cast("array<string>").alias("codes"))

    def take(a: Column, x: Column) -> Column:
        free = ~F.exists(a["used"], lambda u: (x["at"] < u["to"]) & (u["at"] < x["to"]))
        span = F.array(F.struct(x["at"].alias("at"), x["to"].alias("to")))
        return F.when(free, F.struct(F.concat(a["used"], span).alias("used"), F.concat(a["codes"], F.array(x["code"])).alias("codes"))).otherwise(a)

    codes = F.array_distinct(F.aggregate("h", zero, take, lambda a: a["codes"]))
    codes = F.when(F.array_contains(codes, "other") & (F.size(codes) > 1), F.array(F.lit("other"))).otherwise(codes)
    found = group.select("text", F.explode(codes).alias("code")).groupBy("text").agg(F.array_sort(F.collect_set("code")).alias("countries"))
    return wanted.join(found, "text", "left").select("text", F.coalesce("countries", F.array().cast("array<string>")).alias("countries"))


def build_gazetteer(cities: DataFrame, names: DataFrame, languages: DataFrame, most: int = 8) -> DataFrame:
    """``cities`` with ``names``: its own name, then up to ``most`` others in a
    language of its country that are neither colloquial nor historic, by name."""
    others = names.where("NOT colloquial AND NOT historic").join(languages, "language").alias("o")
    own = others.join(cities.alias("c"), F.col("o.town_id") == F.col("c.town_id")).where("o.country = c.country AND o.name <> c.name").select("c.town_id", "o.name").distinct()
    listed = own.groupBy("town_id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("more"))
    return cities.join(listed, "town_id", "left").withColumn("names", F.concat(F.array("name"), F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def postcode_points(places: DataFrame) -> DataFrame:
    return places.groupBy("code", "country").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def nearest(pairs: DataFrame, keys: list[str], k: int = 2, by: str = "distance", tie: str = "town_id") -> DataFrame:
    """The ``k`` rows of each key with the least ``by``."""
    w = Window.partitionBy(*keys).orderBy(by, tie)
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
