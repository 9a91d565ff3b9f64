"""Landed payloads of each source as ads of one shape.

A normaliser takes a DataFrame with ``payload`` (one item as text) and returns
ads.  Rows without an id or a title are left out; what a source doesn't say is
null.  ``NORMALISERS`` is the registry that a user adds sources to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.functions import dates as D
from adweave.functions.text import job_types_from_text, salary_text, title_case_if_caps, work_mode_from_text
from adweave.sources.html import fact, html_to_text, job_posting

SHAPE = {
    "source_job_id": "string", "url": "string", "title": "string", "company": "string", "location_text": "string", "country": "string", "latitude": "double", "longitude": "double",
    "posted_at": "timestamp", "date_precision": "string", "description": "string", "description_is_complete": "boolean", "job_types": "array<string>", "work_mode": "string",
    "employer_url": "string", "salary_text": "string", "closes_at": "timestamp",
}

NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def source(name: str):
    def add(run):
        def normalise(payloads: DataFrame) -> DataFrame:
            rows, cols = run(payloads)
            out = rows.select(F.lit(name).alias("source"), *(cols.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in SHAPE.items()))
            return out.where((F.coalesce("source_job_id", F.lit("")) != "") & (F.coalesce(F.trim("title"), F.lit("")) != ""))

        NORMALISERS[name] = normalise
        return normalise

    return add


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select(F.from_json("payload", schema).alias("p")).select("p.*")


def xml(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select(F.from_xml("payload", schema, {"ignoreNamespace": "true"}).alias("p")).select("p.*")


def types(*pairs: tuple[Column, str]) -> Column:
    """The job types whose condition holds; null if none does."""
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for c, k in pairs)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def stamped(time: Column) -> dict[str, Column]:
    return {"posted_at": time, "date_precision": F.when(time.isNull(), "unknown").otherwise("exact")}


def day(text: Column, form: str = "yyyy-MM-dd") -> dict[str, Column]:
    at = D.day_at_utc(F.try_to_timestamp(text, F.lit(form)))
    return {"posted_at": at, "date_precision": F.when(at.isNull(), "unknown").otherwise("day")}


def local(time: Column, zone: str) -> dict[str, Column]:
    """A local time without zone; midnight is only a day."""
    at, kind = F.try_to_timestamp(F.regexp_replace(F.substring(time, 1, 19), "T", " ")), D.precision_of(F.try_to_timestamp(F.regexp_replace(F.substring(time, 1, 19), "T", " ")))
    return {"posted_at": F.when(kind == "day", D.day_at_utc(at)).otherwise(F.to_utc_timestamp(at, zone)), "date_precision": kind}


def one_country(codes: Column) -> Column:
    """The country, if all places name the same one."""
    own = F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))
    return F.when(F.size(own) == 1, F.upper(own[0]))


def joined(parts: Column, mark: str = "; ") -> Column:
    own = F.array_distinct(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.when(F.size(own) > 0, F.array_join(own, mark))


FULL, FIXED, PART, INTERN, FREE = "full_time_permanent", "fixed_term", "part_time", "internship_or_working_student", "freelance_or_contract"


@source("adzuna")
def adzuna(payloads):
    r = parsed(payloads, "id string, redirect_url string, title string, company struct<display_name:string>, location struct<display_name:string>, country string, latitude double, longitude double, created string, description string, contract_type string, contract_time string, salary_min double, salary_max double, salary_is_predicted string")
    kind, time = F.col("contract_type"), F.col("contract_time")
    shown = F.coalesce(F.col("salary_is_predicted"), F.lit("0")) != "1"
    currency = F.when(F.col("country") == "GB", "GBP").when(F.col("country") == "CH", "CHF").when(F.col("country") == "PL", "PLN").otherwise("EUR")
    kinds = types((time == "part_time", PART), ((kind == "contract"), FREE), ((kind == "contract"), FIXED), ((kind == "permanent") & F.coalesce(time != "part_time", F.lit(True)), FULL), (kind.isNull() & (time == "full_time"), FULL), (kind.isNull() & (time == "full_time"), FIXED))
    return r, {
        "source_job_id": F.col("id"), "url": F.col("redirect_url"), "title": html_to_text(F.col("title")), "company": F.col("company.display_name"), "location_text": F.col("location.display_name"), "country": F.col("country"),
        "latitude": F.col("latitude"), "longitude": F.col("longitude"), **stamped(D.parse_iso(F.col("created"))), "description": html_to_text(F.col("description")), "description_is_complete": F.lit(False),
        "job_types": kinds, "salary_text": F.when(shown, salary_text(F.col("salary_min"), F.col("salary_max"), currency)),
    }


@source("arbeitnow")
def arbeitnow(payloads):
    r = parsed(payloads, "slug string, url string, title string, company_name string, location string, created_at long, description string, job_types array<string>, remote boolean")
    return r, {
        "source_job_id": F.col("slug"), "url": F.col("url"), "title": F.col("title"), "company": F.col("company_name"), "location_text": F.col("location"), **stamped(F.timestamp_seconds("created_at")),
        "description": html_to_text(F.col("description")), "description_is_complete": F.lit(True), "job_types": job_types_from_text(F.array_join("job_types", ", ")), "work_mode": F.when(F.col("remote"), "remote"),
    }


@source("jobtech")
def jobtech(payloads):
    r = parsed(payloads, "id string, headline string, webpage_url string, publication_date string, removed boolean, employer struct<name:string>, workplace_address struct<city:string,municipality:string,region:string,country:string,coordinates:array<double>>, employment_type struct<label:string>, working_hours_type struct<label:string>, duration struct<label:string>, workplace_model struct<label:string>, salary_description string, application_details struct<url:string>, description struct<text:string>")
    a = F.col("workplace_address")
    # of spellings that differ only in case, the first that isn't all capitals
    names = F.filter(F.array(a["city"], a["municipality"], a["region"]), lambda x: F.coalesce(x, F.lit("")) != "")
    mixed = F.aggregate(names, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(x)), F.transform(seen, lambda s: F.when((F.lower(s) == F.lower(x)) & (s == F.upper(s)), x).otherwise(s))).otherwise(F.concat(seen, F.array(x))))
    abroad = F.coalesce(a["country"], F.lit("Sverige")) != "Sverige"
    hours, duration = F.lower("working_hours_type.label"), F.lower("duration.label")
    kinds = types((hours.contains("deltid"), PART), (duration.contains("tillsvidare"), FULL), (duration.isNotNull() & ~duration.contains("tillsvidare"), FIXED))
    return r.where(~F.coalesce("removed", F.lit(False)) & ~abroad), {
        "source_job_id": F.col("id"), "url": F.col("webpage_url"), "title": F.col("headline"), "company": F.col("employer.name"), "location_text": F.when(F.size(mixed) > 0, F.array_join(mixed, ", ")), "country": F.lit("SE"),
        "longitude": F.try_element_at(a["coordinates"], F.lit(1)), "latitude": F.try_element_at(a["coordinates"], F.lit(2)), "posted_at": F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace("publication_date", "T", " ")), "Europe/Stockholm"), "date_precision": F.when(F.col("publication_date").isNull(), "unknown").otherwise("exact"),
        "description": F.col("description.text"), "description_is_complete": F.lit(True), "job_types": kinds, "work_mode": work_mode_from_text(F.col("workplace_model.label")), "employer_url": F.col("application_details.url"), "salary_text": F.col("salary_description"),
    }


@source("bundesagentur")
def bundesagentur(payloads):
    r = parsed(payloads, "referenznummer string, stellenangebotsTitel string, firma string, stellenlokationen array<struct<adresse:struct<ort:string,region:string,land:string>,breite:double,laenge:double>>, datumErsteVeroeffentlichung string, gehaltsspanneVon double, gehaltsspanneBis double, stellenangebotsart string, arbeitszeitVollzeit boolean, vertragsdauer string, stellenangebotsBeschreibung string")
    places = F.col("stellenlokationen")
    towns = joined(F.transform(places, lambda x: x["adresse"]["ort"]), ", ")
    land = F.lower(F.coalesce(places[0]["adresse"]["land"], F.lit("deutschland")))
    country = F.when(land == "deutschland", "DE").when(land == "österreich", "AT").when(land == "schweiz", "CH")
    art, duration = F.upper("stellenangebotsart"), F.upper("vertragsdauer")
    kinds = types((art.contains("AUSBILDUNG") | art.contains("PRAKTIKUM"), INTERN), (art.contains("SELBST"), FREE), (~F.col("arbeitszeitVollzeit"), PART), (F.col("arbeitszeitVollzeit") & (duration == "UNBEFRISTET"), FULL), (duration == "BEFRISTET", FIXED))
    return r, {
        "source_job_id": F.col("referenznummer"), "title": F.col("stellenangebotsTitel"), "company": F.col("firma"), "location_text": F.coalesce(towns, places[0]["adresse"]["region"]), "country": country,
        "latitude": F.when(F.size(places) == 1, places[0]["breite"]), "longitude": F.when(F.size(places) == 1, places[0]["laenge"]), **day(F.substring("datumErsteVeroeffentlichung", 1, 10)),
        "description": F.col("stellenangebotsBeschreibung"), "description_is_complete": F.col("stellenangebotsBeschreibung").isNotNull(), "job_types": kinds, "salary_text": salary_text(F.col("gehaltsspanneVon"), F.col("gehaltsspanneBis"), F.lit("EUR")),
    }


@source("servicebund")
def servicebund(payloads):
    r = xml(payloads, "title string, link string, guid string, pubDate string, description string")
    text = html_to_text(F.col("description"))
    said = lambda label: F.nullif(F.trim(F.regexp_extract(text, f"(?m)^\\W*{label}\\s*:\\s*(.+)$", 1)), F.lit(""))
    time = F.try_to_timestamp(F.regexp_replace("pubDate", "^\\w{3},\\s*|\\s*[A-Z+].{2,5}$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    kind = D.precision_of(time)
    close = F.try_to_timestamp(F.regexp_extract(said("Bewerbungsfrist"), "(\\d{1,2}\\.\\d{1,2}\\.\\d{4})", 1), F.lit("d.M.yyyy"))
    place = said("Ort")
    return r, {
        "source_job_id": F.regexp_extract(F.regexp_replace("link", "[#?].*$", ""), "([^/]+?)(?:\\.html)?/?$", 1), "url": F.substring_index("link", "#", 1), "title": F.col("title"), "company": said("Arbeitgeber"), "location_text": place,
        "country": F.when(place.rlike("^\\d{5}\\s+\\S"), "DE"), "posted_at": F.when(kind == "day", D.day_at_utc(time)).otherwise(F.to_utc_timestamp(time, "Europe/Berlin")), "date_precision": kind, "description": text, "description_is_complete": F.lit(False), "closes_at": D.end_of_day(close, "Europe/Berlin"),
    }


@source("reed")
def reed(payloads):
    r = parsed(payloads, "jobId long, jobTitle string, jobUrl string, employerName string, locationName string, date string, minimumSalary double, maximumSalary double, jobDescription string, contractType string, partTime boolean, fullTime boolean, externalUrl string")
    kind = F.lower("contractType")
    kinds = types((F.col("partTime"), PART), ((kind == "permanent") & F.coalesce("fullTime", F.lit(True)), FULL), (kind == "contract", FREE), (kind.isin("contract", "temporary"), FIXED))
    return r, {
        "source_job_id": F.col("jobId"), "url": F.col("jobUrl"), "title": F.col("jobTitle"), "company": F.col("employerName"), "location_text": F.col("locationName"), "country": F.lit("GB"), **day(F.col("date"), "dd/MM/yyyy"),
        "description": html_to_text(F.col("jobDescription")), "description_is_complete": F.col("contractType").isNotNull(), "job_types": kinds, "employer_url": F.col("externalUrl"), "salary_text": salary_text(F.col("minimumSalary"), F.col("maximumSalary"), F.lit("GBP")),
    }


@source("teachingvacancies")
def teachingvacancies(payloads):
    r = parsed(payloads, "url string, title string, jobLocation array<struct<address:struct<addressLocality:string,postalCode:string>>>, datePosted string, hiringOrganization struct<name:string>, description string, employmentType array<string>, validThrough string")
    kind = lambda k: F.array_contains("employmentType", k)
    kinds = types((kind("PART_TIME"), PART), (kind("TEMPORARY"), FIXED), (kind("FULL_TIME") & ~kind("TEMPORARY"), FULL))
    return r, {
        "source_job_id": F.regexp_extract("url", "([^/]+)/?$", 1), "url": F.col("url"), "title": F.col("title"), "company": F.col("hiringOrganization.name"), "location_text": joined(F.transform("jobLocation", lambda x: F.concat_ws(" ", x["address"]["addressLocality"], x["address"]["postalCode"]))), "country": F.lit("GB"),
        **day(F.substring("datePosted", 1, 10)), "description": html_to_text(F.col("description")), "description_is_complete": F.lit(True), "job_types": kinds, "closes_at": D.parse_closing(F.col("validThrough")),
    }


@source("nhsjobs")
def nhsjobs(payloads):
    r = xml(payloads, "id string, reference string, title string, employer string, url string, locations struct<location:array<string>>, postDate string, closeDate string, description string, type string, salary string")
    pounds = F.regexp_replace("salary", "£?(\\d[\\d,]*)(?:\\.00)?", "£$1")
    return r, {
        "source_job_id": F.coalesce("id", "reference"), "url": F.col("url"), "title": F.col("title"), "company": F.col("employer"), "location_text": joined(F.col("locations.location")), "country": F.lit("GB"),
        "posted_at": F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_replace("postDate", "T", " "), "(\\.\\d{6})\\d+", "$1")), "Europe/London"), "date_precision": F.when(F.col("postDate").isNull(), "unknown").otherwise("exact"),
        "closes_at": F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_replace("closeDate", "T", " "), "(\\.\\d{6})\\d+", "$1")), "Europe/London"), "description": html_to_text(F.col("description")), "description_is_complete": F.lit(False), "job_types": job_types_from_text(F.col("type")), "salary_text": pounds,
    }


@source("leforem")
def leforem(payloads):
    r = parsed(payloads, "numerooffreforem string, titreoffre string, lieuxtravailregionnuts array<string>, lieuxtravaillocalite array<string>, lieuxtravailgeo array<struct<lat:double,lon:double>>, datedebutdiffusion string, nomemployeur string, typecontrat string, regimetravail string, url string")
    point, part = F.try_element_at("lieuxtravailgeo", F.lit(1)), F.lower("regimetravail").contains("temps partiel")
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) <= 180), c)
    contract = F.lower("typecontrat")
    return r, {
        "source_job_id": F.col("numerooffreforem"), "url": F.col("url"), "title": F.col("titreoffre"), "company": F.col("nomemployeur"), "location_text": joined(F.transform("lieuxtravaillocalite", lambda x: title_case_if_caps(x))), "country": F.substring(F.try_element_at("lieuxtravailregionnuts", F.lit(1)), 1, 2),
        "latitude": fine(point["lat"]), "longitude": fine(point["lon"]), **day(F.substring("datedebutdiffusion", 1, 10)), "description": F.concat_ws("\n", "typecontrat", "regimetravail"), "description_is_complete": F.lit(False),
        "job_types": types((part, PART), (contract.contains("indéterminée") & ~F.coalesce(part, F.lit(False)), FULL), (contract.contains("déterminée") & ~contract.contains("indéterminée"), FIXED), (contract.contains("stage"), INTERN)),
    }


@source("nav")
def nav(payloads):
    # contact persons are personal data and aren't read at all
    r = parsed(payloads, "status string, ad_content struct<uuid:string,title:string,published:string,applicationDue:string,workLocations:array<struct<city:string,country:string>>,employer:struct<name:string>,engagementtype:string,extent:string,applicationUrl:string,link:string,description:string>").where("status = 'ACTIVE'")
    a = F.col("ad_content")
    home = F.size(F.filter(a["workLocations"], lambda x: F.upper(x["country"]).isin("NORGE", "NO"))) == F.size(a["workLocations"])
    kind, extent = F.lower(a["engagementtype"]), F.lower(a["extent"])
    due = F.try_to_timestamp(F.substring(a["applicationDue"], 1, 10), F.lit("yyyy-MM-dd"))
    return r, {
        "source_job_id": a["uuid"], "url": a["link"], "title": a["title"], "company": a["employer"]["name"], "location_text": joined(F.transform(a["workLocations"], lambda x: title_case_if_caps(x["city"]))), "country": F.when(home & (F.size(a["workLocations"]) > 0), "NO"), **local(a["published"], "Europe/Oslo"),
        "closes_at": D.end_of_day(due, "Europe/Oslo"), "description": html_to_text(a["description"]), "description_is_complete": F.lit(True), "employer_url": a["applicationUrl"],
        "job_types": types((extent == "deltid", PART), ((kind == "fast") & F.coalesce(extent != "deltid", F.lit(True)), FULL), (kind.isin("vikariat", "engasjement", "prosjekt", "sesong"), FIXED), (kind.isin("lærling", "trainee"), INTERN), (kind == "selvstendig næringsdrivende", FREE)),
    }


@source("ashby")
def ashby(payloads):
    r = parsed(payloads, "id string, title string, jobUrl string, isListed boolean, location string, address struct<postalAddress:struct<addressCountry:string>>, secondaryLocations array<struct<location:string,address:struct<addressCountry:string>>>, publishedAt string, employmentType string, workplaceType string, isRemote boolean, descriptionPlain string, company string").where("isListed")
    where = lambda place, country: F.nullif(F.concat_ws(", ", place, country), F.lit(""))
    places = F.concat(F.array(where(F.col("location"), F.col("address.postalAddress.addressCountry"))), F.coalesce(F.transform("secondaryLocations", lambda x: where(x["location"], x["address"]["addressCountry"])), F.array().cast("array<string>")))
    mode = F.when(F.lower("workplaceType") == "remote", "remote").when(F.lower("workplaceType") == "hybrid", "hybrid").when(F.lower("workplaceType") == "onsite", "on_site").when(F.col("isRemote"), "remote").otherwise(work_mode_from_text(F.col("location")))
    return r, {
        "source_job_id": F.col("id"), "url": F.col("jobUrl"), "title": F.col("title"), "company": F.col("company"), "location_text": joined(places), **stamped(D.parse_iso(F.col("publishedAt"))), "description": F.col("descriptionPlain"), "description_is_complete": F.lit(True),
        "job_types": job_types_from_text(F.regexp_replace("employmentType", "([a-z])([A-Z])", "$1 $2")), "work_mode": mode,
    }


@source("greenhouse")
def greenhouse(payloads):
    r = parsed(payloads, "id long, title string, absolute_url string, location struct<name:string>, first_published string, updated_at string, content string, company string")
    return r, {"source_job_id": F.col("id"), "url": F.col("absolute_url"), "title": F.col("title"), "company": F.col("company"), "location_text": F.col("location.name"), **stamped(D.parse_iso(F.coalesce("first_published", "updated_at"))), "description": html_to_text(F.col("content")), "description_is_complete": F.col("content").isNotNull(), "work_mode": work_mode_from_text(F.col("location.name"))}


@source("lever")
def lever(payloads):
    r = parsed(payloads, "id string, text string, hostedUrl string, categories struct<allLocations:array<string>,location:string,commitment:string>, createdAt long, country string, workplaceType string, descriptionPlain string, lists array<struct<text:string,content:string>>, additionalPlain string, company string")
    places = F.coalesce(F.col("categories.allLocations"), F.array("categories.location"))
    sections = F.array_join(F.transform("lists", lambda x: F.concat_ws("\n", x["text"], html_to_text(x["content"]))), "\n\n")
    return r, {
        "source_job_id": F.col("id"), "url": F.col("hostedUrl"), "title": F.col("text"), "company": F.col("company"), "location_text": joined(places), "country": F.when(F.size(places) <= 1, F.upper("country")), **stamped(F.timestamp_millis("createdAt")),
        "description": F.concat_ws("\n\n", "descriptionPlain", sections, "additionalPlain"), "description_is_complete": F.lit(True), "job_types": job_types_from_text(F.col("categories.commitment")), "work_mode": work_mode_from_text(F.regexp_replace("workplaceType", "-", " ")),
    }


@source("recruitee")
def recruitee(payloads):
    r = parsed(payloads, "id long, title string, careers_url string, locations array<struct<city:string,country:string,country_code:string>>, published_at string, created_at string, remote boolean, hybrid boolean, on_site boolean, description string, requirements string, employment_type_code string, company_name string")
    mode = F.when(F.col("remote"), "remote").when(F.col("hybrid"), "hybrid").when(F.col("on_site"), "on_site")
    return r, {
        "source_job_id": F.col("id"), "url": F.col("careers_url"), "title": F.col("title"), "company": F.col("company_name"), "location_text": joined(F.transform("locations", lambda x: F.concat_ws(", ", x["city"], x["country"]))), "country": one_country(F.transform("locations", lambda x: x["country_code"])),
        **stamped(D.parse_iso(F.regexp_replace(F.coalesce("published_at", "created_at"), " UTC$", "Z"))), "description": html_to_text(F.concat_ws("<br>", "description", "requirements")), "description_is_complete": F.lit(True), "job_types": job_types_from_text(F.col("employment_type_code")), "work_mode": mode,
    }


@source("workable")
def workable(payloads):
    r = parsed(payloads, "shortcode string, title string, url string, locations array<struct<city:string,country:string,countryCode:string>>, published_on string, employment_type string, telecommuting boolean, description string, company string")
    return r, {
        "source_job_id": F.col("shortcode"), "url": F.col("url"), "title": F.col("title"), "company": F.col("company"), "location_text": joined(F.transform("locations", lambda x: F.concat_ws(", ", x["city"], x["country"]))), "country": one_country(F.transform("locations", lambda x: x["countryCode"])), **day(F.col("published_on")),
        "description": html_to_text(F.col("description")), "description_is_complete": F.col("description").isNotNull(), "job_types": job_types_from_text(F.col("employment_type")), "work_mode": F.when(F.col("telecommuting"), "remote"),
    }


@source("teamtailor")
def teamtailor(payloads):
    r = xml(payloads, "title string, link string, guid string, pubDate string, description string, remoteStatus string, locations struct<location:array<struct<city:string,country:string>>>")
    zoned = F.when(F.col("pubDate").rlike("[+-]\\d{4}$"), F.try_to_timestamp(F.regexp_replace("pubDate", "^\\w{3},\\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z")))
    return r, {
        "source_job_id": F.coalesce("guid", "link"), "url": F.col("link"), "title": F.col("title"), "location_text": joined(F.transform("locations.location", lambda x: F.concat_ws(", ", x["city"], x["country"]))), **stamped(zoned), "description": html_to_text(F.col("description")), "description_is_complete": F.lit(True),
        "work_mode": F.when(F.lower("remoteStatus") == "fully", "remote").when(F.lower("remoteStatus").isin("hybrid", "temporary"), "hybrid"),
    }


@source("dvinci")
def dvinci(payloads):
    r = parsed(payloads, "id long, position string, jobPublicationURL string, startDate string, description string, jobOpening struct<createdDate:string,type:string,contractPeriod:string,workingTimes:array<string>,locations:array<struct<name:string,latitude:double,longitude:double>>>, company string")
    o = F.col("jobOpening")
    intern = F.coalesce(F.lower(o["type"]).rlike("praktik|intern|werkstudent"), F.lit(False))
    part, fixed = F.array_contains(o["workingTimes"], "part_time"), F.lower(o["contractPeriod"]) == "fixed"
    single = F.size(o["locations"]) == 1
    return r, {
        "source_job_id": F.col("id"), "url": F.col("jobPublicationURL"), "title": F.col("position"), "company": F.col("company"), "location_text": joined(F.transform(o["locations"], lambda x: x["name"])), "latitude": F.when(single, o["locations"][0]["latitude"]), "longitude": F.when(single, o["locations"][0]["longitude"]), **day(F.substring(F.coalesce(o["createdDate"], F.col("startDate")), 1, 10)),
        "description": html_to_text(F.col("description")), "description_is_complete": F.lit(True), "job_types": types((intern, INTERN), (~intern & part, PART), (~intern & fixed, FIXED), (~intern & ~F.coalesce(fixed, F.lit(False)) & F.array_contains(o["workingTimes"], "full_time"), FULL)),
    }


@source("prospective")
def prospective(payloads):
    r = parsed(payloads, "id string, title string, start_date string, links struct<directlink:string>, szas struct<pensum_min:int,pensum_max:int,city:string,country:string>, description string, company string")
    s = F.col("szas")
    low, high = F.coalesce(s["pensum_min"], s["pensum_max"]), F.coalesce(s["pensum_max"], s["pensum_min"])
    return r, {
        "source_job_id": F.col("id"), "url": F.col("links.directlink"), "title": F.col("title"), "company": F.col("company"), "location_text": s["city"], "country": F.coalesce(s["country"], F.when(F.coalesce(s["city"], F.lit("")) == "", F.lit("CH"))), **day(F.substring("start_date", 1, 10)),
        "description": html_to_text(F.col("description")), "description_is_complete": F.lit(True), "job_types": types((low < 90, PART), (high >= 90, FULL)),
    }


@source("workday")
def workday(payloads):
    r = parsed(payloads, "title string, externalPath string, locationsText string, postedOn string, seen_on string, country string, company string, detail struct<jobDescription:string,startDate:string,timeType:string,remoteType:string>")
    seen = D.relative_day(F.col("postedOn"), F.to_date("seen_on"))
    exact = F.try_to_timestamp(F.col("detail.startDate"), F.lit("yyyy-MM-dd"))
    at = D.day_at_utc(F.coalesce(exact, seen.cast("timestamp")))
    return r, {
        "source_job_id": F.regexp_extract("externalPath", "([^/]+)$", 1), "url": F.col("externalPath"), "title": F.col("title"), "company": F.col("company"), "location_text": F.when(~F.col("locationsText").rlike("^\\d+ Locations?$"), F.col("locationsText")), "country": F.col("country"), "posted_at": at, "date_precision": F.when(at.isNull(), "unknown").otherwise("day"),
        "description": html_to_text(F.col("detail.jobDescription")), "description_is_complete": F.col("detail.jobDescription").isNotNull(), "job_types": job_types_from_text(F.col("detail.timeType")), "work_mode": work_mode_from_text(F.col("detail.remoteType")),
    }


@source("successfactors")
def successfactors(payloads):
    r = xml(payloads, "title string, id string, guid string, link string, location string, employer string, description string, pubDate string")
    last = F.regexp_extract(F.trim("location"), ",\\s*([A-Z]{2})\\s*(?:,\\s*[\\w -]*\\d[\\w -]*)?$", 1)
    return r, {
        "source_job_id": F.coalesce("id", "guid"), "url": F.col("link"), "title": F.trim(F.regexp_replace("title", "\\s*\\([^()]*,[^()]*\\)\\s*$", "")), "company": F.col("employer"), "location_text": F.trim(F.regexp_replace("location", ",\\s*[\\w -]*\\d[\\w -]*$", "")), "country": F.nullif(F.when(last == "UK", "GB").otherwise(last), F.lit("")),
        "description": html_to_text(F.col("description")), "description_is_complete": F.lit(True), "date_precision": F.lit("unknown"),
    }


def from_page(name: str, id_pattern: str, country: str | None = None):
    """A normaliser for pages with linked data: payload is HTML, ``url`` its address."""

    @source(name)
    def page(payloads):
        r = payloads.withColumn("p", job_posting(F.col("payload")))
        p = F.col("p")
        posted, kind = fact(p, "$.datePosted"), fact(p, "$.employmentType")
        timed = posted.contains("T")
        linked, whole = html_to_text(fact(p, "$.description")), html_to_text(F.col("payload"))
        return r, {
            "source_job_id": F.regexp_extract("url", id_pattern, 1), "url": F.col("url"), "title": fact(p, "$.title"), "company": fact(p, "$.hiringOrganization.name"),
            "location_text": F.coalesce(fact(p, "$.jobLocation.address.addressLocality"), fact(p, "$.jobLocation[0].address.addressLocality"), fact(p, "$.jobLocation.address.addressRegion")), "country": F.coalesce(fact(p, "$.jobLocation.address.addressCountry"), F.lit(country)),
            "posted_at": F.when(timed, D.parse_iso(posted)).otherwise(D.day_at_utc(F.try_to_timestamp(F.substring(posted, 1, 10), F.lit("yyyy-MM-dd")))), "date_precision": F.when(posted.isNull(), "unknown").when(timed, "exact").otherwise("day"),
            "description": F.when(F.length(linked) > 0, linked).otherwise(whole), "description_is_complete": F.lit(True), "job_types": job_types_from_text(F.regexp_replace(kind, "_", " ")), "work_mode": F.when(fact(p, "$.jobLocationType") == "TELECOMMUTE", "remote"), "closes_at": D.parse_closing(fact(p, "$.validThrough")),
        }

    return page


for _name, _pattern, _country in (("eightfold", "/(\\d+)(?:[^/]*)$", None), ("werkenvoornederland", "([^/]+)/?$", "NL"), ("jobsireland", "(\\d+)", "IE"), ("euraxess", "(\\d+)$", None), ("jobsacuk", "/([A-Z0-9]+)/?", "GB")):
    from_page(_name, _pattern, _country)


def normalise_source(name: str, payloads: DataFrame) -> DataFrame:
    return NORMALISERS[name](payloads)


#: Bits of an ordinal below the source's number: 2 ** 21 partitions of 2 ** 33 rows.
ORDINAL_BITS = 54


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources' ads, in the order given, as ``ordinal``'s high part; up to 511 sources."""
    numbered = [f.withColumn("ordinal", F.lit(i << ORDINAL_BITS).cast("bigint") + F.monotonically_increasing_id()) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def merge_details(ads: DataFrame, details: DataFrame, keys: tuple[str, ...] = ("source", "source_job_id")) -> DataFrame:
    """Ads with their pages' details: a longer text replaces the summary, other
    fields are taken where the ad has none."""
    fields = [c for c in details.columns if c not in keys]
    out = ads.join(details.select(*keys, *(F.col(c).alias(f"_d_{c}") for c in fields)), list(keys), "left")
    for c in fields:
        longer = F.length(f"_d_{c}") > F.coalesce(F.length(c), F.lit(0)) if c == "description" else F.lit(False)
        out = out.withColumn(c, F.when(longer, F.col(f"_d_{c}")).otherwise(F.coalesce(c, f"_d_{c}")))
    return out.drop(*(f"_d_{c}" for c in fields))


def sitemap_changed_since(sitemaps: DataFrame, since: Column) -> DataFrame:
    """``url, lastmod`` of a sitemap's entries that changed, or don't say when."""
    entry = F.explode(F.from_xml("payload", "url array<struct<loc:string,lastmod:string>>")["url"])
    rows = sitemaps.select(entry.alias("u")).select(F.trim("u.loc").alias("url"), D.parse_iso(F.col("u.lastmod")).alias("lastmod"))
    return rows.where(F.col("lastmod").isNull() | (F.col("lastmod") >= since))


def read_wanted(lines: DataFrame) -> DataFrame:
    """``company, title, place, url`` from lines ``company | title | place | url``."""
    parts = F.transform(F.split("value", "\\|"), lambda x: F.trim(x))
    rows = lines.where(~F.ltrim("value").startswith("#")).select(parts.alias("p")).where(F.size("p") >= 2)
    field = lambda i: F.nullif(F.coalesce(F.get("p", F.lit(i)), F.lit("")), F.lit(""))
    return rows.select(*(field(i).alias(n) for i, n in enumerate(("company", "title", "place", "url"))))


def load_employers(lines: DataFrame) -> DataFrame:
    """``name, system, board, countries, elsewhere, towns`` from an employer's JSON in
    ``value``; what a line doesn't say is empty or false, and lines without a name go."""
    e = lines.select(F.from_json("value", "name string, system string, board string, countries array<string>, elsewhere boolean, towns map<string,array<string>>").alias("e")).select("e.*")
    empty = {"countries": F.array().cast("array<string>"), "elsewhere": F.lit(False), "towns": F.create_map().cast("map<string,array<string>>")}
    return e.where("name IS NOT NULL").select("name", "system", "board", *(F.coalesce(c, v).alias(c) for c, v in empty.items()))


def prune_sources(control: DataFrame, countries: list[str]) -> DataFrame:
    """``control`` with ``status``: searched, disabled, unavailable or not for these countries."""
    meets = F.arrays_overlap("countries", F.array(*(F.lit(c) for c in countries)))
    return control.withColumn("status", F.when(~F.col("enabled"), "disabled").when(F.col("unavailable_reason").isNotNull(), "unavailable").when(~meets, "other countries").otherwise("searched"))


def admitted(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``url, allowed`` by host rules: our agent's group, else ``*``; the longest
    pattern wins, and allowing wins a tie."""
    own = robots.withColumn("mine", (F.lower("agent") == agent.lower()).cast("int")).where("mine = 1 OR agent = '*'")
    best_group = own.groupBy("host").agg(F.max("mine").alias("best"))
    rules = own.join(best_group, "host").where("mine = best").select("host", "pattern", "allow")
    rows = urls.select("url", F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("/")).alias("path"))
    hits = rows.join(rules, "host").where(F.startswith("path", "pattern") & (F.col("pattern") != ""))
    ruled = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    return rows.select("url").distinct().join(ruled, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))
