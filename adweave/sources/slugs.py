"""Jobs of career sites that list only the addresses of their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.functions import dates as D
from adweave.functions.text import bound, normalise, once
from adweave.operators.places import town_names
from adweave.sources.html import fact, job_posting, marked

#: A job's page: words of the place and title, then its number.
JOB_PATH = "/job/([^/?#]+)/(\\d+)/?(?:[?#]|$)"
POSTCODE = "^[A-Z0-9 -]*\\d[A-Z0-9 -]*$"
SLUG_WORDS = 3


def stated_place(text: Column, country_names: Column) -> tuple[Column, Column]:
    """The place as shown and the country of "Walldorf, DE, 69190".

    The country is the last part of two capitals (UK is GB); postcodes and the
    country's code are left out, and its name (``country_names``: code to name) is added.
    """
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    code = F.try_element_at(F.filter(parts, lambda p: p.rlike("^[A-Z]{2}$")), F.lit(-1))
    country = F.when(code == "UK", "GB").otherwise(code)
    named = F.array_compact(F.array(F.try_element_at(country_names, country)))
    left = F.filter(parts, lambda p: ~p.eqNullSafe(code) & ~p.rlike(POSTCODE))
    return F.nullif(F.array_join(F.concat(left, named), ", "), F.lit("")), country


def jobs_of_addresses(urls: DataFrame, towns: DataFrame) -> DataFrame:
    """``board, url, source_job_id, title, location_text, country`` of the job pages among ``urls`` (board, url).

    The words of an address are the town and the title; a postcode at their end goes.
    The town is the longest run of the first 3 to 1 words that the gazetteer
    knows, of several countries' the one with most people; without one the
    country is ``other``.  Addresses of other pages have no row, repeated ones have one.
    """
    slug = F.try_url_decode(F.replace(F.regexp_extract("url", JOB_PATH, 1), F.lit("+"), F.lit("%2B")))
    rows = urls.select("board", "url").distinct().select("board", "url", F.filter(F.split(slug, "-"), lambda w: w != "").alias("w"), F.regexp_extract("url", JOB_PATH, 2).alias("number")).where("number <> ''")
    last = F.try_element_at("w", F.lit(-1))
    rows = rows.withColumn("w", F.when(last.rlike(POSTCODE), F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w")))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(SLUG_WORDS))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.lit(1), n), " ").alias("run")))
    asked = rows.where(F.size("w") > 0).select("url", F.explode(runs).alias("r")).select("url", "r.n", normalise(F.col("r.run")).alias("name")).where("name <> ''")
    known = town_names(towns).join(towns.select("town_id", F.col("names")[0].alias("town")), "town_id")
    best = F.struct("n", "people", (-F.col("town_id")).alias("o"))
    found = asked.join(known, "name").groupBy("url").agg(F.max_by(F.struct("town", "country"), best).alias("t"))
    out = rows.join(found, "url", "left")
    return out.select("board", "url", F.concat_ws("/", "board", "number").alias("source_job_id"), F.array_join("w", " ").alias("title"), F.col("t.town").alias("location_text"), F.coalesce("t.country", F.lit("other")).alias("country"))


def date_posted(page: Column) -> Column:
    """The posting time that a page marks, in either of the usual forms, else that of its linked data."""
    # "Wed Sep 09 02:00:00 UTC 2026": the weekday is cut, Spark doesn't read it
    long = lambda said: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(said, "^[A-Za-z]{3} ", ""), " [A-Z]{2,4} (?=\\d{4}$)", " "), F.lit("MMM dd HH:mm:ss yyyy"))
    return F.coalesce(bound(marked(page, "datePosted"), lambda said: F.coalesce(long(said), D.parse_iso(said))), D.parse_iso(fact(job_posting(page), "$.datePosted")))


def with_page_marks(jobs: DataFrame, pages: DataFrame, country_names: Column) -> DataFrame:
    """``jobs`` of addresses with what their own pages (url, payload) mark for search engines.

    Title, company, place and text are taken where the page has them; jobs
    whose page wasn't read go, as a listed address alone says too little.
    """
    p = F.col("payload")
    read = pages.dropDuplicates(["url"]).select(
        "url", marked(p, "title").alias("_title"), marked(p, "hiringOrganization").alias("_company"), F.coalesce(marked(p, "streetAddress"), marked(p, "addressLocality")).alias("_place"), marked(p, "description").alias("description"), date_posted(p).alias("_at")
    )
    read = once(read)
    shown, code = stated_place(F.col("_place"), country_names)
    out = once(jobs.join(read, "url").withColumns({"_shown": shown, "_code": code}))
    return out.select(
        "board", "url", "source_job_id", F.coalesce(F.regexp_replace("_title", "\\s+", " "), "title").alias("title"), F.col("_company").alias("company"), F.coalesce("_shown", "location_text").alias("location_text"), F.coalesce("_code", "country").alias("country"),
        F.coalesce("description", F.lit("")).alias("description"), F.col("description").isNotNull().alias("description_is_complete"), D.day_at_utc(F.col("_at")).alias("posted_at"), F.when(F.col("_at").isNull(), "unknown").otherwise("day").alias("date_precision"),
    )
