"""Conditions about places: which towns they mean, and how a job answers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.functions.geo import edge_distance, haversine_km, reach_km
from adweave.functions.text import normalise
from adweave.operators.places import SPOT, by_spot, find_region, of_spots, to_points, town_names, within

#: The fastest that a mode of travel gets on, in km/h.
FASTEST = {"train": 220, "car": 120, "bike": 25, "walk": 7}


def smallest_town(min_people: Column, share: Column, country_people: Column) -> Column:
    """The larger of a number of people and a share of the country's, half to even."""
    return F.greatest(F.coalesce(min_people, F.lit(0)), F.coalesce(F.bround(share * country_people), F.lit(0)).cast("bigint"))


def anchor_towns(towns: DataFrame, conditions: DataFrame, countries: DataFrame, parts: DataFrame) -> DataFrame:
    """``condition_id, town_id``: the towns that a condition measures to.

    Towns of its smallest size on that aren't part of a bigger one, only those
    in its named towns and regions where it names any, never those it avoids.
    ``conditions``: condition_id, country, min_people, share, towns, regions,
    avoid (arrays of ids and codes; null or empty: none).
    """
    base = conditions.join(countries, "country").withColumn("least", smallest_town(F.col("min_people"), F.col("share"), F.col("country_people")))
    rows = towns.join(base, "country").join(parts, "town_id", "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    named = F.array_contains("towns", F.col("town_id")) | F.arrays_overlap("regions", F.array("region", "district", "area"))
    fits_name = F.when(some("towns") | some("regions"), F.coalesce(named, F.lit(False))).otherwise(True)
    fits_size = (F.col("least") <= 0) | ((F.col("people") >= F.col("least")) & F.col("part_of").isNull())
    avoided = F.coalesce(F.array_contains("avoid", F.col("town_id")), F.lit(False))
    return rows.where(fits_name & fits_size & ~avoided).select("condition_id", "town_id")


def fits(kind: Column, people: Column, least: Column, listed: Column, excepted: Column, any_here: Column, known_town: Column) -> Column:
    """yes, no or unknown for one place and one condition.

    ``listed``: the place is in the condition's towns or regions; ``any_here``:
    it lists some in this country.  Nothing to avoid here is fine; nothing that
    fits here isn't known; a place that isn't known answers nothing.
    """
    member = F.coalesce(listed, F.lit(False)) & ~F.coalesce(excepted, F.lit(False))
    return (
        F.when((kind == "towns_to_avoid") & ~any_here, "yes")
        .when((kind == "towns_that_fit") & ~any_here, "unknown")
        .when(~known_town, "unknown")
        .when(kind == "town_size", F.when(people >= least, "yes").otherwise("no"))
        .when(kind == "towns_to_avoid", F.when(member, "no").otherwise("yes"))
        .when(kind == "towns_that_fit", F.when(member, "yes").otherwise("no"))
        .otherwise("unknown")
    )


def near_km(points: DataFrame, anchors: DataFrame, max_km: float, to_centre: bool = False) -> DataFrame:
    """``point_id, answer``: yes if the edge of an anchor is near enough, else no."""
    reach = F.lit(max_km + 0.001) if to_centre else max_km + reach_km(F.col("people")) + 0.001
    circles = by_spot(anchors).select(F.col("town_id").alias("circle_id"), *SPOT, "people", reach.alias("km"))
    close = within(of_spots(points), circles).where(edge_distance(F.col("distance"), F.col("people"), to_centre) <= max_km)
    hit = to_points(points, close.select("point_id").distinct()).select("point_id").distinct().withColumn("hit", F.lit(True))
    return points.select("point_id").join(hit, "point_id", "left").select("point_id", F.when(F.col("hit"), "yes").otherwise("no").alias("answer"))


def near_minutes(asked: DataFrame, measured: DataFrame, limit: int) -> DataFrame:
    """``job_key, answer``: yes if a measured way is short enough, no if all are
    too long, unknown if nothing was measured."""
    best = measured.groupBy("job_key").agg(F.bool_or(F.coalesce(F.col("minutes") <= limit, F.lit(False))).alias("ok"))
    return asked.select("job_key").join(best, "job_key", "left").select("job_key", F.when(F.col("ok").isNull(), "unknown").when(F.col("ok"), "yes").otherwise("no").alias("answer"))


def travel_candidates(points: DataFrame, anchors: DataFrame, minutes: int, mode: str, k: int = 2) -> DataFrame:
    """The ``k`` nearest anchors that ``mode`` could reach in time at its fastest."""
    reach = minutes / 60.0 * FASTEST[mode]
    circles = by_spot(anchors, k).select("ids", *SPOT, F.lit(reach).alias("km"))
    w = Window.partitionBy("point_id").orderBy("distance", "town_id")
    met = within(of_spots(points), circles).select("point_id", "distance", F.explode("ids").alias("town_id"))
    return to_points(points, met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)).select("point_id", "town_id", "distance", "place")


def recall_travel(candidates: DataFrame, memory: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Candidates (origin, destination, mode) with remembered minutes, and those to ask."""
    keys = ["origin", "destination", "mode"]
    fresh = memory.where(F.col("measured_at") >= now - F.make_dt_interval(F.lit(days))).groupBy(*keys).agg(F.max_by("minutes", "measured_at").alias("minutes"), F.max("measured_at").alias("measured_at"))
    return candidates.join(fresh, keys), candidates.join(fresh, keys, "left_anti")


def travel_detail(measured: DataFrame, limit: int) -> DataFrame:
    """``job_key, town, minutes, verdict``: the best town, near or too far, or none."""
    best = measured.groupBy("job_key").agg(F.min_by("town", F.struct("minutes", "town")).alias("town"), F.min("minutes").alias("minutes"))
    return best.withColumn("verdict", F.when(F.col("minutes").isNull(), "none").when(F.col("minutes") <= limit, "near").otherwise("too_far"))


def apply_edits(conditions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions with a person's edits, and the edits that were refused.

    An edit (condition_id, switched_off, min_people, max_minutes, travel_mode)
    changes what it states.  A negative size, or minutes outside 1 to 600, or an
    unknown condition is refused with its reason.  Another travel mode voids the
    measurements.
    """
    known = edits.join(conditions.select("condition_id").withColumn("known", F.lit(True)), "condition_id", "left")
    why = F.when(F.col("known").isNull(), "unknown condition").when(F.col("min_people") < 0, "size out of range").when(~F.col("max_minutes").between(1, 600), "minutes out of range")
    judged = known.withColumn("why", why)
    good = judged.where("why IS NULL").drop("why", "known")
    out = conditions.alias("c").join(good.alias("e"), "condition_id", "left")
    pick = lambda n: F.coalesce(F.col(f"e.{n}"), F.col(f"c.{n}")).alias(n)
    changed = F.coalesce(F.col("e.travel_mode") != F.col("c.travel_mode"), F.lit(False))
    rest = [F.col(f"c.{n}") for n in conditions.columns if n not in ("condition_id", "switched_off", "min_people", "max_minutes", "travel_mode", "measured", "changed_by_you")]
    applied = out.select("condition_id", *rest, *(pick(n) for n in ("switched_off", "min_people", "max_minutes", "travel_mode")), F.when(changed, False).otherwise(F.col("c.measured")).alias("measured"), good_mark("e"))
    return applied, judged.where("why IS NOT NULL").drop("known")


def good_mark(side: str) -> Column:
    states = F.coalesce(*(F.col(f"{side}.{n}").cast("string") for n in ("switched_off", "min_people", "max_minutes", "travel_mode")))
    return states.isNotNull().alias("changed_by_you")


#: Kinds of condition that name towns or regions, and those that name countries.
TOWN_KINDS, COUNTRY_KINDS = ("towns_that_fit", "towns_to_avoid"), ("countries_that_fit", "countries_to_avoid")
#: People from which on a place counts as a city, where a condition only rules some out.
CITY_PEOPLE = 20_000


def canonical_conditions(answers: DataFrame, towns: DataFrame, regions: DataFrame) -> DataFrame:
    """What was looked up about conditions, in the terms of the gazetteer.

    ``answers``: condition_id, text, understood_as, kind, confidence, searched,
    countries (arrays of codes), towns, regions, exceptions (arrays of name, country),
    min_people, share, note.  Only places in searched countries count.  A region is
    known by ``find_region``; a town that no town's name is but a region's is that
    region; other regions are ``unknown_regions``.  A condition that is left without
    what its kind needs is ``could_not_check``; exceptions count beside regions only.
    Null arrays are empty ones.
    """
    places = "array<struct<name:string,country:string>>"
    given = lambda c: F.filter(F.coalesce(c, F.array().cast(places)), lambda x: F.array_contains("searched", x["country"]))
    rows = answers.select("*", *(given(c).alias(f"_{c}") for c in ("towns", "regions", "exceptions")))
    listed = F.concat(*(F.transform(F.col(f"_{c}"), lambda x, i: F.struct(F.lit(n).alias("from"), i.alias("at"), x["name"].alias("name"), x["country"].alias("country"))) for n, c in enumerate(("regions", "towns"))))  # noqa: B023
    items = rows.select("condition_id", F.explode(listed).alias("x")).select("condition_id", "x.*")
    is_town = town_names(towns).select(F.col("name").alias("_key"), F.col("country").alias("_in")).distinct()
    code = find_region(items.select("name", "country").distinct(), regions).withColumnsRenamed({"name": "_name", "country": "_c"})
    items = items.join(is_town, (normalise(F.col("name")) == F.col("_key")) & (F.col("country") == F.col("_in")), "left").join(code, (F.col("name") == F.col("_name")) & (F.col("country") == F.col("_c")), "left")
    place = F.struct("from", "at", "name", "country", "code")
    as_region = F.col("code").isNotNull() & ((F.col("from") == 0) | F.col("_key").isNull())
    of = lambda c: F.array_sort(F.collect_list(F.when(c, place)))
    found = items.groupBy("condition_id").agg(of((F.col("from") == 1) & ~as_region).alias("_t"), of(as_region).alias("_r"), of((F.col("from") == 0) & F.col("code").isNull()).alias("_u"))
    out = rows.join(found, "condition_id", "left")
    names = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(x["name"].alias("name"), x["country"].alias("country")))
    codes = F.array_distinct(F.transform(F.coalesce("_r", F.array()), lambda x: x["code"]))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    lacking = (
        (F.col("kind").isin(*TOWN_KINDS) & (size("_t") <= 0) & (size("_r") <= 0))
        | (F.col("kind").isin(*COUNTRY_KINDS) & (size("countries") <= 0))
        | ((F.col("kind") == "town_size") & (F.coalesce("min_people", F.lit(0)) == 0) & (F.coalesce("share", F.lit(0.0)) == 0))
    )
    kind = F.when(lacking, "could_not_check").otherwise(F.col("kind"))
    status = F.when(kind == "could_not_check", "not_checked").when(F.col("confidence") == "checked", "applied").otherwise("estimate")
    here = F.filter(F.coalesce("countries", F.array().cast("array<string>")), lambda x: F.array_contains("searched", x))
    in_towns = kind.isin(*TOWN_KINDS)
    none, no_codes = F.array().cast(places), F.array().cast("array<string>")
    return out.select(
        "condition_id", "text", F.coalesce(F.nullif("understood_as", F.lit("")), "text").alias("understood_as"), kind.alias("kind"), status.alias("status"), names(F.col("_t")).alias("towns"),
        F.when(in_towns, codes).otherwise(no_codes).alias("regions"), F.when(in_towns & (F.size(codes) > 0), F.col("_exceptions")).otherwise(none).alias("exceptions"),
        F.when(kind.isin(*COUNTRY_KINDS), here).otherwise(no_codes).alias("countries"), "min_people", "share", F.transform(F.coalesce("_u", F.array()), lambda x: x["name"]).alias("unknown_regions"), "note",
    )


def near_conditions(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Limits to places (``near``), from what was asked and what was looked up about the places.

    ``asked``: condition_id, text, understood_as, min_people, share, named (town ids),
    look_up (null: nothing needs looking up), max_minutes, max_km, travel_mode.
    ``found``: condition_id, kind, min_people, share, towns, regions, countries, as
    ``canonical_conditions`` gives them with ids for towns.  Sizes that were found
    replace those asked for; a fact that couldn't be checked is left out if there
    is a size or a name (``fact_unused``).  Where a fact only rules places out, cities
    of CITY_PEOPLE count.  What is then left without any place is ``could_not_check``.
    """
    f = found.select("condition_id", *(F.col(c).alias(f"_{c}") for c in ("kind", "min_people", "share", "towns", "regions", "countries")))
    rows = asked.join(f, "condition_id", "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    number = lambda c: F.coalesce(c, F.lit(0)) > 0
    looked = F.col("look_up").isNotNull()
    is_ = lambda k: looked & F.coalesce(F.col("_kind") == k, F.lit(False))
    places = some("_towns") | some("_regions")
    fit, avoid, size = is_("towns_that_fit") & places, is_("towns_to_avoid") & places, is_("town_size")
    in_, out_ = is_("countries_that_fit"), is_("countries_to_avoid")
    least = F.when(size & number(F.col("_min_people")), F.col("_min_people")).otherwise(F.col("min_people"))
    share = F.when(size & number(F.col("_share")), F.col("_share")).otherwise(F.col("share"))
    sized = number(least) | number(share) | some("named")
    unused = looked & ~(fit | avoid | size | in_ | out_)
    default = (avoid | in_ | out_) & ~sized
    usable = sized | fit | default
    kind = F.when(usable, "near").otherwise("could_not_check")
    timed = number(F.col("max_minutes"))
    only = lambda c, value, empty: F.when(usable & c, F.coalesce(value, F.array())).otherwise(F.array().cast(empty))
    kinds = dict(found.dtypes)
    return rows.select(
        "condition_id", "text", F.coalesce(F.nullif("understood_as", F.lit("")), "text").alias("understood_as"), kind.alias("kind"), F.when(~usable, "not_checked").when(timed, "estimate").otherwise("applied").alias("status"),
        F.when(usable, F.when(default, F.lit(CITY_PEOPLE)).otherwise(least)).cast("bigint").alias("min_people"), F.when(usable, share).alias("share"), F.when(usable, F.col("named")).alias("named"),
        only(fit, F.col("_towns"), kinds["towns"]).alias("towns"), only(fit, F.col("_regions"), kinds["regions"]).alias("regions"), only(avoid, F.col("_towns"), kinds["towns"]).alias("avoided"), only(avoid, F.col("_regions"), kinds["regions"]).alias("avoided_regions"),
        only(in_, F.col("_countries"), kinds["countries"]).alias("countries_fit"), only(out_, F.col("_countries"), kinds["countries"]).alias("countries_avoided"), (usable & unused).alias("fact_unused"),
        F.when(usable & timed, F.col("max_minutes")).alias("max_minutes"), F.when(usable, F.coalesce("travel_mode", F.when(timed, "transit"))).alias("travel_mode"), F.when(usable & ~timed, F.col("max_km")).alias("max_km"),
    )


def narrow_countries(countries: Column, only: Column, never: Column) -> Column:
    """Countries that a condition leaves; an empty array voids it."""
    kept = F.when(F.coalesce(F.size(only), F.lit(0)) > 0, F.array_intersect(countries, only)).otherwise(countries)
    return F.array_except(kept, F.coalesce(never, F.array().cast("array<string>")))


def region_members(towns: DataFrame, codes: list[str], exceptions: list[int]) -> DataFrame:
    """Towns in any of the regions, districts or areas, without the exceptions."""
    return towns.where(F.arrays_overlap(F.array("region", "district", "area"), F.array(*(F.lit(c) for c in codes)))).where(~F.col("town_id").isin(exceptions))


def distance_between(a: str, b: str) -> Column:
    return haversine_km(F.col(f"{a}.latitude"), F.col(f"{a}.longitude"), F.col(f"{b}.latitude"), F.col(f"{b}.longitude"))
