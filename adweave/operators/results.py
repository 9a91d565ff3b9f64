"""What a search's result says beside the scores: where a job is, what was left out late, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.functions.text import effective_types, fold

#: Why a job goes after its text was read, in the order of the tests.
LATE_REASONS = ("remote_by_text", "job_type_by_text")


def job_points(copies: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """``job_key, country, latitude, longitude, how``: where each job is.

    ``copies``: job_key, ordinal, country, latitude, longitude, town_latitude,
    town_longitude (of the place that the copy names, null where none is known).
    The country is that of the first copy in a ``supported`` one.  The point is the
    first copy's with coordinates of its own (``how`` is address), else the first
    named place's (town), else null.
    """
    address = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    town = F.col("town_latitude").isNotNull() & F.col("town_longitude").isNotNull()
    known = F.col("country").isin(*supported)
    first = lambda value, where: F.min_by(value, F.when(where, F.col("ordinal")))
    point = lambda lat, lon: F.struct(F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))
    out = copies.groupBy("job_key").agg(
        first(F.col("country"), known).alias("country"),
        F.bool_or(known).alias("_known"),
        first(point("latitude", "longitude"), address).alias("_address"),
        F.bool_or(address).alias("_has_address"),
        first(point("town_latitude", "town_longitude"), town).alias("_town"),
        F.bool_or(town).alias("_has_town"),
    )
    how = F.when(F.col("_has_address"), "address").when(F.col("_has_town"), "town")
    spot = F.when(F.col("_has_address"), F.col("_address")).when(F.col("_has_town"), F.col("_town"))
    return out.select("job_key", F.when(F.col("_known"), F.col("country")).alias("country"), spot["latitude"].alias("latitude"), spot["longitude"].alias("longitude"), how.alias("how"))


def towns_of_districts(names: DataFrame, towns: DataFrame) -> DataFrame:
    """``names`` (name, country) with ``town``: the name, if it is a town's, else the
    part before its first hyphen, if that is one, else null.  ``towns``: name, country."""
    known = towns.select(fold(F.col("name")).alias("_key"), F.col("country").alias("_in")).distinct().withColumn("_is", F.lit(True))
    as_side = lambda n: known.toDF(f"_{n}_key", f"_{n}_in", f"_{n}_is")
    rows = names.withColumn("_part", F.when(F.col("name").contains("-"), F.substring_index("name", "-", 1)))
    rows = rows.join(as_side("w"), (fold(F.col("name")) == F.col("_w_key")) & (F.col("country") == F.col("_w_in")), "left")
    rows = rows.join(as_side("p"), (fold(F.col("_part")) == F.col("_p_key")) & (F.col("country") == F.col("_p_in")), "left")
    return rows.select(*names.columns, F.when(F.col("_w_is"), F.col("name")).when(F.col("_p_is"), F.trim("_part")).alias("town"))


def late_reason(reason: Column, read_mode: Column, stated: Column, read_type: Column, exclude_remote: Column, wanted: Column) -> Column:
    """The reason of a job once its text was read: an earlier one stays.

    A job whose text says remote goes where remote jobs are excluded; one whose
    types, narrowed by its text, aren't wanted goes as well.  Nothing known leaves
    nothing out.
    """
    types = effective_types(stated, read_type)
    remote = F.coalesce(exclude_remote & (read_mode == "remote"), F.lit(False))
    other = F.coalesce((F.size(types) > 0) & ~F.arrays_overlap(types, wanted), F.lit(False))
    return F.coalesce(reason, F.when(remote, LATE_REASONS[0]), F.when(other, LATE_REASONS[1]))


def languages_for(countries: DataFrame) -> DataFrame:
    """``search_id, languages``: English first, then those of the countries in order.

    ``countries``: search_id, ordinal, languages, place_languages.  Where a country
    has several languages and the places chosen in it have some of them, only
    those count.
    """
    narrow = F.array_intersect("languages", F.coalesce("place_languages", F.array().cast("array<string>")))
    own = F.when((F.size("languages") > 1) & (F.size(narrow) > 0), narrow).otherwise(F.col("languages"))
    rows = countries.select("search_id", F.struct("ordinal", own.alias("own")).alias("r")).groupBy("search_id").agg(F.collect_list("r").alias("rows"))
    # countries of one ordinal take turns: first their first languages, by name, then their second ones
    spoken = F.flatten(F.transform("rows", lambda r: F.transform(F.coalesce(r["own"], F.array().cast("array<string>")), lambda x, i: F.struct(r["ordinal"].alias("ordinal"), i.alias("place"), x.alias("language")))))
    ordered = F.transform(F.array_sort(spoken), lambda x: x["language"])
    return rows.select("search_id", F.array_distinct(F.concat(F.array(F.lit("en")), ordered)).alias("languages"))


def shown_counts(results: DataFrame) -> DataFrame:
    """``search_id, shown, new_count`` of results (search_id, job_id, is_new); a job counts once."""
    each = results.groupBy("search_id", "job_id").agg(F.bool_or("is_new").alias("is_new"))
    return each.groupBy("search_id").agg(F.count("*").alias("shown"), F.count_if("is_new").alias("new_count"))
