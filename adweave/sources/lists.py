"""Result pages that hold many ads each, read by the elements of the page.

A page is ``payload``, HTML as it came; each block that opens like an ad becomes a
row of the common shape.  Elements are found by class and end with their own end tag,
also where others of their name are nested inside.  Blocks without an id or a title are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.functions import dates as D
from adweave.functions.storage import materialise
from adweave.functions.text import bound, once
from adweave.operators.places import countries_in
from adweave.sources.html import attribute, element, elements, html_to_text, start_tag, unescape
from adweave.sources.normalise import FREE, FULL, INTERN, FIXED, PART, SHAPE

IRISH_ZONE = "Europe/Dublin"
#: In how many parts ads with the same labels are dealt.
LABEL_PARTS = 32
#: Hours a week from which on a job is full time.
FULL_TIME_HOURS = 30
#: Fixed values of the Irish site: the kinds of a vacancy.
IRISH_KINDS = {"3": PART, "4": INTERN, "6": FREE, "10": INTERN}
#: Wording of a period after an amount.
PERIODS = {"annually": "year", "daily": "day", "hourly": "hour", "monthly": "month", "weekly": "week"}


def blocks(page: Column, opening: str) -> Column:
    """The parts of a page that begin with ``opening`` (a pattern), each up to the next one."""
    return F.filter(F.split(page, f"(?={opening})"), lambda b: b.rlike(f"^(?:{opening})"))


def inner(block: Column, tag: str, named: str) -> Column:
    """The text of the first such element; null if there is none or it is empty."""
    return bound(F.trim(html_to_text(element(block, start_tag(tag, "class", named))["content"])), lambda t: F.nullif(t, F.lit("")))


def hidden(block: Column, name: str) -> Column:
    """The value of a form's hidden field."""
    tag = F.regexp_extract(block, f"(?is)<input\\b[^>]*\\bid=[\"']{name}[\"'][^>]*>", 0)
    return bound(F.trim(unescape(F.regexp_extract(tag, "(?is)\\bvalue=[\"']([^\"']*)[\"']", 1))), lambda v: F.nullif(v, F.lit("")))


def _shaped(name: str, rows: DataFrame, *more: str, **cols: Column) -> DataFrame:
    out = once(rows.select(F.lit(name).alias("source"), *(cols.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in SHAPE.items()), *more))
    return out.where((F.coalesce("source_job_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def _day(at: Column) -> dict[str, Column]:
    return {"posted_at": D.day_at_utc(at), "date_precision": F.when(at.isNull(), "unknown").otherwise("day")}


def euraxess_list(pages: DataFrame, place_names: DataFrame, site: str = "") -> DataFrame:
    """Research jobs.  The country is set only where all labels together name exactly one."""
    rows = pages.select(F.explode(blocks(F.col("payload"), "<div\\b[^>]*\\bid=[\"']job-teaser-content[\"']")).alias("b"))
    link = F.coalesce(element(F.col("b"), start_tag("h3", "class", "ecl-content-block__title"))["content"], F.lit(""))
    metas = elements(F.col("b"), start_tag("li", "class", "ecl-content-block__primary-meta-item"))
    rows = once(rows.select("b", link.alias("link"), F.array_join(metas, "\n").alias("metas"), F.transform(elements(F.col("b"), start_tag("span", "class", "ecl-label")), lambda x: F.trim(html_to_text(x))).alias("labels")))
    posted = F.regexp_extract(html_to_text(F.col("metas")), "Posted on:\\s*(\\d{1,2}\\s+\\w+\\s+\\d{4})", 1)
    day = F.to_date(F.try_to_timestamp(F.regexp_replace(posted, "\\s+", " "), F.lit("d MMMM yyyy")))
    rows = once(rows.select("*", F.regexp_extract("link", "(?is)<a\\b[^>]*\\bhref=[\"']([^\"']+)[\"']", 1).alias("path"), day.alias("day"))).where("path <> ''")
    # pages are read once
    found = materialise(rows, "euraxess-blocks")
    place = F.regexp_replace(F.regexp_replace(inner(F.col("b"), "div", "id-Work-Locations"), "\\s+", " "), "^Work Locations: ?|Number of offers: ?\\d+,? ?", "")
    # all is read from the blocks before the labels are looked up: many ads have the same few labels, so after that few tasks have them
    rows = _shaped(
        "euraxess", found, "labels", source_job_id=F.regexp_extract("path", "([^/]+)/*$", 1), url=F.when(F.startswith("path", F.lit("/")), F.concat(F.lit(site), "path")).otherwise(F.col("path")), title=F.trim(html_to_text(F.col("link"))),
        company=F.nullif(F.trim(html_to_text(F.regexp_extract("metas", "(?is)<a\\b[^>]*>(.*?)</a\\s*>", 1))), F.lit("")), location_text=F.coalesce(F.nullif(F.btrim(place, F.lit(" ,")), F.lit("")), F.try_element_at("labels", F.lit(-1))),
        description=inner(F.col("b"), "div", "ecl-content-block__description"), description_is_complete=F.lit(False), **_day(F.col("day")),
    )
    lists = materialise(found.select("labels").distinct(), "euraxess-labels")
    by_label = countries_in(lists.select(F.explode("labels").alias("text")), place_names).select("text", F.explode("countries").alias("code"))
    of = lists.withColumn("text", F.explode("labels")).join(by_label, "text").groupBy("labels").agg(F.collect_set("code").alias("codes"))
    of = of.select("labels", F.when(F.size("codes") == 1, F.col("codes")[0]).alias("code"), F.explode(F.sequence(F.lit(0), F.lit(LABEL_PARTS - 1))).alias("part"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(LABEL_PARTS)).cast("int")).join(of, ["labels", "part"], "left")
    return rows.withColumn("country", F.col("code").cast(SHAPE["country"])).select("source", *SHAPE)


def jobsacuk_list(pages: DataFrame, site: str = "") -> DataFrame:
    """University jobs.  Pages have ``seen_on`` too, from which the year of "27 Aug" follows."""
    rows = pages.select(F.to_date("seen_on").alias("seen"), F.explode(blocks(F.col("payload"), "<div\\b[^>]*\\bclass=[\"'][^\"']*j-search-result__result[^\"']*[\"']")).alias("b"))
    rows = once(rows.select("*", F.regexp_extract("b", "(?is)<a\\b[^>]*\\bhref=[\"'](/job/[^\"']*)[\"'][^>]*>(.*?)</a\\s*>", 1).alias("path"), html_to_text(F.col("b")).alias("text"))).where("path <> ''")
    written = F.regexp_replace(F.nullif(F.regexp_extract("text", "Date Placed:?\\s*(\\d{1,2}\\s+[A-Za-z]{3})", 1), F.lit("")), "\\s+", " ")
    rows = rows.withColumn("written", written)
    rows = once(rows.withColumn("day", D.day_without_year(F.col("written"), F.col("seen"))))
    salary = F.filter(F.transform(F.split(F.regexp_replace(inner(F.col("b"), "div", "j-search-result__info"), "^Salary:", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _shaped(
        "jobsacuk", rows, source_job_id=F.coalesce(F.nullif(F.regexp_extract("b", "^<div\\b[^>]*\\bdata-advert-id=[\"']([^\"']+)[\"']", 1), F.lit("")), "path"), url=F.concat(F.lit(site), "path"),
        title=F.trim(html_to_text(F.regexp_extract("b", "(?is)<a\\b[^>]*\\bhref=[\"']/job/[^\"']*[\"'][^>]*>(.*?)</a\\s*>", 1))), company=inner(F.col("b"), "div", "j-search-result__employer"),
        location_text=F.nullif(F.trim(F.regexp_extract("text", "(?m)^Location:[ \\t]*(.*)$", 1)), F.lit("")), salary_text=F.nullif(F.array_join(salary, " · "), F.lit("")), **_day(F.col("day")),
    )


def _irish(text: Column) -> Column:
    """An ISO time; one without a zone is Irish."""
    zoned = text.rlike("(Z|[+-]\\d{2}:?\\d{2})$")
    return F.when(zoned, D.parse_iso(text)).otherwise(F.to_utc_timestamp(D.parse_iso(text), IRISH_ZONE))


def jobsireland_list(pages: DataFrame, site: str = "") -> DataFrame:
    """Irish jobs.  Coordinates stand in a list of their own on the page (``lat;lon;...;id;...``)
    and are joined by id, the first of an id; a job closes at the end of its Irish day."""
    spots = F.transform(F.regexp_extract_all(F.regexp_extract("payload", "(?is)<ul\\b[^>]*\\bid=[\"']longlats[\"'][^>]*>(.*?)</ul\\s*>", 1), F.lit("(?is)<li[^>]*>([^<]*)"), F.lit(1)), lambda x: F.split(x, ";"))
    rows = pages.select(F.filter(spots, lambda p: F.size(p) > 2).alias("spots"), F.explode(blocks(F.col("payload"), "<div\\b(?=[^>]*\\bdata-vacancyid)[^>]*\\bclass=[\"'][^\"']*job-heading[^\"']*[\"']")).alias("b"))
    rows = once(rows.select("*", *(hidden(F.col("b"), field).alias(name) for name, field in (("id", "JobId"), ("starts", "StartDate"), ("ends", "EndDate"), ("kind", "VacancyTypeId"))))).where(F.col("id").rlike("^\\d+$"))
    spot = F.get(F.filter("spots", lambda p: F.trim(F.element_at(p, -2)) == F.col("id")), F.lit(0))
    kinds = F.create_map(*(F.lit(x) for kv in IRISH_KINDS.items() for x in kv))
    rows = once(rows.select("b", "id", spot.alias("spot"), _irish(F.col("starts")).alias("starts"), _irish(F.col("ends")).alias("ends"), F.try_element_at(kinds, F.col("kind")).alias("kind")))
    number = lambda i: F.trim(F.get("spot", F.lit(i))).try_cast("double")
    posted, closing, kind = F.col("starts"), F.col("ends"), F.col("kind")
    return _shaped(
        "jobsireland", rows, source_job_id=F.col("id"), url=F.concat(F.lit(f"{site}/en-US/job-Details?id="), "id"), title=hidden(F.col("b"), "JobTitle"), location_text=F.nullif(F.btrim(hidden(F.col("b"), "Location"), F.lit(" ,")), F.lit("")),
        company=F.nullif(F.trim(unescape(F.regexp_extract("b", "(?is)<img\\b[^>]*\\balt=[\"']Logo of ([^\"']*)[\"']", 1))), F.lit("")), country=F.lit("IE"), latitude=F.when(number(1).isNotNull(), number(0)), longitude=F.when(number(0).isNotNull(), number(1)),
        posted_at=posted, date_precision=F.when(posted.isNull(), "unknown").otherwise("exact"), job_types=F.when(kind.isNotNull(), F.array(kind)), closes_at=D.end_of_day(F.to_date(F.from_utc_timestamp(closing, IRISH_ZONE)), IRISH_ZONE),
    )


def types_from_hours(text: Column) -> Column:
    """Full time from FULL_TIME_HOURS on, part time below, null where no hours are named."""
    hours = F.regexp_extract(text, "(\\d+(?:\\.\\d+)?)\\s*hours", 1).try_cast("double")
    return F.when(hours >= FULL_TIME_HOURS, F.array(F.lit(FULL), F.lit(FIXED))).when(hours.isNotNull(), F.array(F.lit(PART)))


def euro_salary(text: Column) -> Column:
    """"30000.00 - 34500.00 Euro Annually" as "€30,000 – €34,500 a year".

    Other wordings stay as they are; amounts of zero are left out, and null is
    returned where no other is left.
    """
    form = "^([\\d.,]+)(?:\\s*-\\s*([\\d.,]+))?\\s*Euro\\s*(\\w+)?"
    found = lambda i: F.regexp_replace(F.regexp_extract(text, form, i), ",", "").try_cast("double")
    amounts = F.array_distinct(F.filter(F.array(found(1), found(2)), lambda x: x > 0))
    unit = F.try_element_at(F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv)), F.lower(F.regexp_extract(text, form, 3)))
    after = F.when(unit.isNull(), "").when(unit == "hour", " an hour").otherwise(F.concat(F.lit(" a "), unit))
    shown = F.array_join(F.transform(amounts, lambda x: F.concat(F.lit("€"), F.regexp_replace(F.format_number(x, 2), "\\.00$", ""))), " – ")
    return F.when(~text.rlike(form), F.nullif(text, F.lit(""))).when(F.size(amounts) > 0, F.concat(shown, after))


def jobsireland_details(pages: DataFrame) -> DataFrame:
    """``source_job_id, description, company, job_types, salary_text`` of Irish jobs' own pages.

    ``pages`` has source_job_id and payload.  Facts are the items of a list, each
    named by its picture: the employer, the hours (full time from FULL_TIME_HOURS
    on) and the salary in Euro.  A page without a text of the ad has no row.
    """
    text = html_to_text(element(F.col("payload"), start_tag("pre", "ng-bind-html", "Description"))["content"])
    listed = element(F.col("payload"), start_tag("ul", "class", "job-detail_list"))["content"]
    items = elements(F.col("listed"), start_tag("li"))
    rows = once(pages.select("source_job_id", text.alias("description"), listed.alias("listed"))).where("description <> ''")
    rows = rows.select("source_job_id", "description", F.transform(items, lambda x: F.struct(F.lower(attribute(element(x, start_tag("img"))["tag"], "alt")).alias("icon"), F.nullif(F.trim(html_to_text(element(x, "(?is)<div\\b(?![^>]*\\bclass=)[^>]*>")["content"])), F.lit("")).alias("text"))).alias("facts"))
    fact = lambda name: F.get(F.filter("facts", lambda x: x["icon"].contains(name) & x["text"].isNotNull()), F.lit(0))["text"]
    rows = once(once(rows).select("source_job_id", "description", fact("employer").alias("company"), fact("hours").alias("hours"), fact("euro").alias("euro")))
    return rows.select("source_job_id", "description", "company", types_from_hours(F.col("hours")).alias("job_types"), euro_salary(F.col("euro")).alias("salary_text"))


def with_irish_details(ads: DataFrame, details: DataFrame) -> DataFrame:
    """``ads`` of the list with what their own pages say; a job without a page keeps its row.
    Stated job types stay, other facts of the page win."""
    named = details.dropDuplicates(["source_job_id"]).select("source_job_id", *(F.col(c).alias(f"_{c}") for c in ("description", "company", "job_types", "salary_text")))
    out = ads.join(named, "source_job_id", "left")
    types = F.when(F.coalesce(F.size("job_types"), F.lit(0)) <= 0, F.coalesce("_job_types", "job_types")).otherwise(F.col("job_types"))
    complete = F.when(F.col("_description").isNotNull(), F.lit(True)).otherwise(F.col("description_is_complete"))
    new = {"description": F.coalesce("_description", "description"), "company": F.coalesce("_company", "company"), "salary_text": F.coalesce("_salary_text", "salary_text"), "job_types": types, "description_is_complete": complete}
    return out.withColumns(new).select(ads.columns)
