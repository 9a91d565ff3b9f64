"""Which ads, employers and rows go on to the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.functions.geo import haversine_km
from adweave.functions.text import normalise
from adweave.operators.rules import contains_word

DEFAULT_RADIUS_KM = 25.0


def select_feed(ads: DataFrame, control: DataFrame) -> DataFrame:
    """Ads of bulk feeds that a search asks for, by each source's own rules.

    ``control`` has a row for each source: countries, uses_terms, uses_places.
    The first of equal ids stays; an ad without a country passes the country
    test; ``matched`` and ``near`` are asked only where the source uses them.
    """
    first = ads.withColumn("_n", F.row_number().over(Window.partitionBy("source", "source_job_id").orderBy("ordinal"))).where("_n = 1").drop("_n")
    rows = first.join(F.broadcast(control), "source")
    in_country = F.col("country").isNull() | F.array_contains("countries", F.col("country"))
    return rows.where(in_country & (~F.col("uses_terms") | F.col("matched")) & (~F.col("uses_places") | F.col("near"))).select(ads.columns)


def match_places(ads: DataFrame, wanted: DataFrame, towns: DataFrame) -> DataFrame:
    """``ad_id, near``: whether an ad is at or near a wanted place of its country.

    ``ads``: ad_id, country, location_text, town_id (null: not known); ``wanted``:
    country, name, kind, town_id, radius_km.  Without a wanted place in the
    country, or without a location, the answer is yes; a named place is; then
    the distance to a city decides, and an unknown town isn't near.
    """
    spot = towns.select("town_id", "latitude", "longitude")
    places = wanted.join(spot.withColumnsRenamed({"latitude": "w_lat", "longitude": "w_lon"}), "town_id", "left").select("country", normalise(F.col("name")).alias("w"), "kind", F.coalesce("radius_km", F.lit(DEFAULT_RADIUS_KM)).alias("radius"), "w_lat", "w_lon")
    listed = places.groupBy("country").agg(F.collect_list(F.struct("w", "kind", "radius", "w_lat", "w_lon")).alias("places"))
    rows = ads.join(F.broadcast(listed), "country", "left").join(spot, "town_id", "left").withColumn("_t", normalise(F.col("location_text")))
    named = F.exists("places", lambda p: (p["w"] != "") & contains_word(F.col("_t"), p["w"]))
    close = F.exists("places", lambda p: (p["kind"] == "city") & F.coalesce(haversine_km(p["w_lat"], p["w_lon"], F.col("latitude"), F.col("longitude")) <= p["radius"], F.lit(False)))
    near = F.when(F.col("places").isNull() | (F.col("_t") == ""), True).when(named, True).otherwise(F.coalesce(close, F.lit(False)))
    return rows.select("ad_id", near.alias("near"))


def country_of_career_ad(found: Column, searched: Column, europe_wide: Column, hires_elsewhere: Column, own: Column) -> Column:
    """The country of an ad on an employer's own site, ``""`` if it is kept without one,
    or null if it goes.

    A searched country that the text names; else none if it names another covered
    one; a foreign place goes unless it is Europe-wide; a text that names none
    goes if the employer hires elsewhere; else it is the employer's only country.
    """
    wanted = F.array_intersect(found, searched)
    covered = F.filter(found, lambda c: c != "other")
    return (
        F.when(F.size(wanted) > 0, wanted[0])
        .when(F.size(covered) > 0, F.lit(None))
        .when(F.array_contains(found, "other") & ~europe_wide, F.lit(None))
        .when(europe_wide, F.lit(""))
        .when(hires_elsewhere, F.lit(None))
        .when(F.size(own) == 1, own[0])
        .otherwise(F.lit(""))
    )


def hires_near(employers: DataFrame, offices: DataFrame, wanted: DataFrame, margin_km: float = 25.0) -> DataFrame:
    """Employers without those whose every known office is too far from every wanted place.

    ``offices``: employer, country, latitude, longitude (null: not known);
    ``wanted``: country, latitude, longitude, radius_km.
    """
    w = F.broadcast(wanted.withColumnsRenamed({"latitude": "w_lat", "longitude": "w_lon"}))
    far = offices.join(w, "country").groupBy("employer").agg(
        F.bool_and(F.coalesce(haversine_km(F.col("latitude"), F.col("longitude"), F.col("w_lat"), F.col("w_lon")) > F.col("radius_km") + margin_km, F.lit(False))).alias("far")
    )
    return employers.join(far.where("far"), "employer", "left_anti")


def needs_requirements(jobs: DataFrame, least: int = 50) -> DataFrame:
    """Jobs worth reading in full: scored high enough, only a summary, not read yet."""
    return jobs.where((F.col("score") >= least) & ~F.col("complete") & ~F.coalesce("read_online", F.lit(False)))


def ground_places(proposed: DataFrame, towns: DataFrame, most: int = 3) -> DataFrame:
    """Proposed towns (job_key, at, name, country, text) whose words stand in the text and
    which the gazetteer (name, country) knows; the first ``most`` of each job."""
    words = F.split(normalise(F.col("name")), " ")
    said = F.forall(words, lambda w: contains_word(F.col("_t"), w))
    known = proposed.withColumn("_t", normalise(F.col("text"))).where(said).withColumn("_n", normalise(F.col("name"))).join(towns.select(F.col("name").alias("_n"), "country"), ["_n", "country"], "left_semi")
    return known.withColumn("_p", F.row_number().over(Window.partitionBy("job_key").orderBy("at"))).where(F.col("_p") <= most).drop("_p", "_n", "_t")


def screened(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """All rows of the picked (title, company) pairs, which were screened once each."""
    return rows.join(picked.select("title", "company").distinct(), ["title", "company"], "left_semi")


def accepted_answers(answers: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first answer to each id that was asked, and the ids to ask again."""
    first = answers.groupBy("id").agg(F.min_by("answer", "at").alias("answer"))
    return asked.join(first, "id"), asked.join(first, "id", "left_anti")


def same_fact(a: Column, b: Column, least: float = 0.6) -> Column:
    """Two facts' words: one contains the other, or they share most."""
    shared = F.size(F.array_intersect(a, b))
    small, all_words = F.least(F.size(a), F.size(b)), F.size(F.array_union(a, b))
    return (small > 0) & ((shared == small) | (shared >= least * all_words))


def plan_countries(listed: Column, of_places: Column, every: list[str]) -> Column:
    """The countries to search: listed ones and those of named places, or all."""
    some = F.array_union(F.coalesce(listed, F.array().cast("array<string>")), F.coalesce(of_places, F.array().cast("array<string>")))
    return F.when(F.size(some) > 0, F.array_sort(some)).otherwise(F.array(*(F.lit(c) for c in every)))


def rate(ratings: DataFrame, allowed: dict[str, list[str]], blockers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ratings that are allowed for their kind, cleaned, and those refused.

    Unknown blockers go, notes are cut at 500 characters, and taking a rating
    back (null) clears who gave it and when.
    """
    fits = F.coalesce(*(F.when(F.col("kind") == k, F.col("rating").isin(v)) for k, v in allowed.items()), F.lit(False)) | F.col("rating").isNull()
    out = ratings.where(fits).withColumn("blockers", F.array_intersect("blockers", F.array(*(F.lit(b) for b in blockers)))).withColumn("note", F.substring("note", 1, 500))
    for c in ("rated_by", "rated_at"):
        out = out.withColumn(c, F.when(F.col("rating").isNotNull(), F.col(c)))
    return out, ratings.where(~fits)


def to_redo(pool: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the new conditions admit and that no earlier work covers."""
    return pool.where(F.col("reason").isNull()).join(done.select(keys).distinct(), keys, "left_anti")


def condition_status(measured: DataFrame) -> DataFrame:
    """``condition_id, status``: an estimate if any of its ways was estimated."""
    return measured.groupBy("condition_id").agg(F.when(F.bool_or(F.col("by") == "estimate"), "estimate").otherwise("applied").alias("status"))


def employer_survey(ads: DataFrame, most_towns: int = 40) -> DataFrame:
    """``employer, country, jobs, towns``: where each employer has jobs."""
    return ads.where("country IS NOT NULL").groupBy("employer", "country").agg(F.count("*").alias("jobs"), F.slice(F.array_sort(F.collect_set("town")), 1, most_towns).alias("towns"))


def source_report(ads: DataFrame, requests: DataFrame) -> DataFrame:
    """``source, found, screened_out, requests, status`` of one search."""
    found = ads.groupBy("source").agg(F.count("*").alias("found"), F.count_if("screened_out").alias("screened_out"))
    asked = requests.groupBy("source").agg(F.sum("requests").alias("requests"))
    both = found.join(asked, "source", "full_outer").na.fill(0, ["found", "screened_out", "requests"])
    return both.withColumn("status", F.when((F.col("found") == 0) & (F.col("requests") > 0), "nothing").otherwise("searched"))


def progress(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("collected"), F.count("rating").alias("rated"))


def view(cards: DataFrame, order: str, show_dismissed: bool = False) -> DataFrame:
    """A result list as shown: by score or newest, dated jobs first."""
    rows = cards if show_dismissed else cards.where(~F.coalesce("dismissed", F.lit(False)))
    first = [F.desc_nulls_last("score")] if order == "score" else [F.desc_nulls_last("posted_at")]
    return rows.orderBy(F.col("posted_at").isNull(), *first, "job_key")
