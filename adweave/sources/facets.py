"""Filters ("facets") that career sites show beside their lists: which one stands for countries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.functions.storage import materialise
from adweave.operators.places import countries_in, locate

#: Share of a facet's values that must name one country.
COUNTRY_SHARE = 0.6
VALUE = "struct<id:string,descriptor:string,count:bigint>"


def facet_values(pages: DataFrame) -> DataFrame:
    """``board, place, parameter, values``: the facets of each board's page that hold plain values.

    ``pages`` is (board, payload), the payload JSON with ``facets``.  A facet
    whose first value is a facet holds facets; these are walked through to any
    depth, one level a round, until none is left.  ``place`` is the facet's place in
    the walk (an array of positions).  Facets without values, and payloads that
    can't be read, give none.
    """
    walk = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    level = pages.select("board", F.posexplode(walk(F.try_parse_json("payload"), "$.facets")).alias("at", "facet")).select("board", F.array("at").alias("place"), "facet")
    found = []
    while True:
        values = walk(F.col("facet"), "$.values")
        level = materialise(level.select("board", "place", F.coalesce(F.try_variant_get("facet", "$.facetParameter", "string"), F.lit("")).alias("parameter"), values.alias("values")).where(F.size("values") > 0), "facets")
        nested = F.try_variant_get(F.col("values")[0], "$.facetParameter", "string").isNotNull()
        found.append(level.where(~nested).select("board", "place", "parameter", F.transform("values", lambda v: F.try_variant_get(v, "$", VALUE)).alias("values")))
        level = level.where(nested).select("board", "place", F.posexplode("values").alias("at", "facet")).select("board", F.concat("place", F.array("at")).alias("place"), "facet")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def country_facets(facets: DataFrame, place_names: DataFrame) -> DataFrame:
    """``board, parameter, id, descriptor, count, codes``: the values of the facet that stands for countries.

    Sites name that facet differently, so of those with ``location`` or ``country``
    in their name, where 60 % of the values or more name exactly one country, the
    one with the largest such share is taken; then the one with the fewest values
    (countries rather than offices), one with ``country`` in its name, and the
    first of the page.  ``codes`` are the covered countries that a value names.
    """
    named = F.lower("parameter")
    each = facets.where(named.contains("location") | named.contains("country")).select("board", "place", "parameter", F.size("values").alias("n"), F.explode("values").alias("v"))
    each = each.select("board", "place", "parameter", "n", "v.*")
    said = countries_in(each.select(F.col("descriptor").alias("text")), place_names).withColumnsRenamed({"text": "descriptor", "countries": "named"})
    each = materialise(each.join(said, "descriptor", "left"), "facet-values")
    shares = each.groupBy("board", "place", "parameter", "n").agg((F.count_if(F.size("named") == 1) / F.first("n")).alias("share"))
    rank = Window.partitionBy("board").orderBy(F.desc("share"), "n", ~F.lower("parameter").contains("country"), "place")
    best = shares.where(F.col("share") >= COUNTRY_SHARE).withColumn("r", F.row_number().over(rank)).where("r = 1").select("board", "place")
    codes = F.filter(F.coalesce("named", F.array().cast("array<string>")), lambda c: c != "other")
    return each.join(best, ["board", "place"]).select("board", "parameter", "id", "descriptor", "count", codes.alias("codes"))


def facet_survey(facets: DataFrame, chosen: DataFrame, place_names: DataFrame, towns: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs by country (board, country, jobs), ``other`` for values that name no covered one, and
    the towns (board, country, town_id) that the values of all location facets name."""
    code = F.explode(F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit("other"))))
    jobs = chosen.select("board", code.alias("country"), F.coalesce("count", F.lit(0)).alias("count")).groupBy("board", "country").agg(F.sum("count").alias("jobs"))
    spots = facets.where(F.lower("parameter").contains("location")).select("board", F.explode("values").alias("v")).select("board", F.col("v.descriptor").alias("text")).distinct()
    said = countries_in(spots.select("text"), place_names).select("text", F.explode("countries").alias("country")).where("country <> 'other'")
    return jobs, spots.join(locate(said, towns, regions), "text").select("board", "country", "town_id").distinct()


def with_facet_country(ads: DataFrame, chosen: DataFrame) -> DataFrame:
    """``ads`` (board, facet_id, country, ...) with the country of the filter under which they were
    listed, where that names one covered country; else their own."""
    one = chosen.where("size(codes) = 1 AND id IS NOT NULL").groupBy("board", F.col("id").alias("facet_id")).agg(F.min(F.col("codes")[0]).alias("_facet"))
    return ads.join(one, ["board", "facet_id"], "left").withColumn("country", F.coalesce("_facet", "country")).drop("_facet")
