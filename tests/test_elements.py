"""Elements, marks, addresses and filters of pages, nested and broken ones too."""

import json

from pyspark.sql import functions as F

from adweave.sources import facets, lists, slugs
from adweave.sources.html import attribute, element, elements, marked, start_tag

TOWNS = "town_id long, names array<string>, country string, latitude double, longitude double, people long, region string, district string, area string"


def read(spark, html, column):
    return spark.createDataFrame([(html,)], "h string").select(column.alias("x")).first()["x"]


def test_elements_end_with_their_own_end(spark):
    div = lambda html: read(spark, html, element(F.col("h"), start_tag("div", "class", "job")))
    assert div("<div class='x'>no</div><div class=\"a job b\"><div>in</div> and <DIV>more<div/></DIV></div> after</div>")["content"] == "<div>in</div> and <DIV>more<div/></DIV>"
    assert div("<div class='job'>open <div>in</div> to the end")["content"] == "open <div>in</div> to the end"
    assert div("<div class='job'><!-- </div> --><script>'</div>'</script>x</div>y")["content"].strip() == "x"
    assert div("<div title='a > b' class='job' data-x=\"1 > 0\">x</div>")["content"] == "x"
    assert div("<divider class='job'>x</divider>") is None and div("") is None and div(None) is None
    assert div("<div class='job'><divider>a</divider></div>z")["content"] == "<divider>a</divider>"
    assert read(spark, "<ul><li>a<li>b</li></ul><li class='k'>c", elements(F.col("h"), start_tag("li"))) == ["a", "b", "c"]
    assert read(spark, "<a href='x' data-alt='no' alt='A &amp; B'>", attribute(F.col("h"), "alt")) == "A & B"
    deep = "<div class='job'>" + "<div>" * 300 + "core" + "</div>" * 300 + "</div><div>no</div>"
    assert div(deep)["content"] == "<div>" * 300 + "core" + "</div>" * 300
    long = "<div class='job'>" + "<p title=\"" + "a > b " * 20_000 + "\">x</p>" * 3 + "</div>no"
    assert div(long)["content"].endswith("x</p>")


def test_marks_of_a_page(spark):
    page = "<meta itemprop='datePosted' content='Wed Sep 09 02:00:00 UTC 2026'><h1><span itemprop='title'>A <b>clerk</b></span></h1><div class='d' itemprop=\"description\"><div>One</div><div>Two</div></div><i itemprop='subtitle'>no</i>"
    got = spark.createDataFrame([(page,)], "h string").select(*(marked(F.col("h"), n).alias(n) for n in ("title", "description", "nothing")), slugs.date_posted(F.col("h")).cast("string").alias("at")).first()
    assert tuple(got) == ("A clerk", "One\n\nTwo", None, "2026-09-09 02:00:00")


def test_jobs_of_addresses_and_their_pages(spark):
    towns = spark.createDataFrame(
        [(1, ["Frankfurt am Main", "Frankfurt"], "DE", 50.0, 8.6, 750_000, None, None, None), (2, ["Frankfurt"], "US", 38.2, -84.8, 28_000, None, None, None), (3, ["Bühl"], "DE", 48.7, 8.1, 29_000, None, None, None), (4, ["Main"], "DE", 49.0, 9.0, 90, None, None, None)],
        TOWNS,
    )
    urls = [("b1", f"https://b1.example/job/{x}") for x in ("Frankfurt-am-Main-Clerk-60311/11/", "B%C3%BChl-Praktikum-HR-%28dmw%29-77815/12", "Frankfurt-Cook/13/?a=1", "Nowhere-Nurse/14/", "Frankfurt-Cook/13/?a=1", "bad%zz-Cook/15/")] + [("b1", "https://b1.example/about/"), ("b1", None)]
    jobs = slugs.jobs_of_addresses(spark.createDataFrame(urls, "board string, url string"), towns)
    got = {r["source_job_id"]: (r["title"], r["location_text"], r["country"]) for r in jobs.collect()}
    assert got.pop("b1/15")[2] == "other"
    assert got == {
        "b1/11": ("Frankfurt am Main Clerk", "Frankfurt am Main", "DE"), "b1/12": ("Bühl Praktikum HR (dmw)", "Bühl", "DE"),
        "b1/13": ("Frankfurt Cook", "Frankfurt am Main", "DE"), "b1/14": ("Nowhere Nurse", None, "other"),
    }
    pages = [(urls[0][1], "<span itemprop='title'>Clerk</span><meta itemprop='streetAddress' content='Walldorf, DE, 69190'><meta itemprop='hiringOrganization' content='Acme'><div itemprop='description'>Do</div><meta itemprop='datePosted' content='2026-09-09'>"), (urls[3][1], "<p>nothing marked</p>")]
    names = F.create_map(F.lit("DE"), F.lit("Germany"))
    full = {r["source_job_id"]: r for r in slugs.with_page_marks(jobs, spark.createDataFrame(pages, "url string, payload string"), names).collect()}
    assert full.keys() == {"b1/11", "b1/14"}
    a, b = full["b1/11"], full["b1/14"]
    assert (a["title"], a["company"], a["location_text"], a["country"], a["description"], a["date_precision"]) == ("Clerk", "Acme", "Walldorf, Germany", "DE", "Do", "day")
    assert (b["title"], b["country"], b["description"], b["description_is_complete"], b["posted_at"]) == ("Nowhere Nurse", "other", "", False, None)


def test_irish_details(spark):
    page = "<pre ng-bind-html='x.Description'>Do <b>this</b>\nand that</pre><ul class='job-detail_list'><li><img alt='Employer icon'><div class='t'>Employer</div><div>Acme <div>Ltd</div></div></li><li><img alt='Hours'><div>39.0 hours a week</div></li><li><img alt='Euro'><div>30000.00 - 34500.00 Euro Annually</div></li><li>odd</li></ul>"
    pages = spark.createDataFrame([("1", page), ("2", "<p>no ad</p>"), ("3", None)], "source_job_id string, payload string")
    details = lists.jobsireland_details(pages)
    r = details.collect()
    assert len(r) == 1 and r[0]["company"].split() == ["Acme", "Ltd"] and r[0]["job_types"] == ["full_time_permanent", "fixed_term"] and r[0]["salary_text"] == "€30,000 – €34,500 a year"
    ads = spark.createDataFrame([("1", "Old", None, None, ["part_time"], False), ("2", "Two", "s", "d", None, False)], "source_job_id string, company string, salary_text string, description string, job_types array<string>, description_is_complete boolean")
    out = {x["source_job_id"]: x for x in lists.with_irish_details(ads, details).collect()}
    assert out["1"]["job_types"] == ["part_time"] and out["1"]["description_is_complete"] and out["2"]["company"] == "Two" and not out["2"]["description_is_complete"]


def test_nested_facets(spark):
    value = lambda i, text, n=1: {"id": i, "descriptor": text, "count": n}
    deep = {"facetParameter": "a", "values": [{"facetParameter": "b", "values": [{"facetParameter": "locationCountry", "values": [value("1", "Spain", 4), value("2", "France", 2), value(None, "Spain", 1)]}]}, {"facetParameter": "Locations", "values": [value("3", "Spain"), value("4", "France"), value("5", "x"), value("6", "France")]}]}
    pages = [("p", json.dumps({"facets": [{"facetParameter": "jobs", "values": [value("9", "Spain")]}, deep]})), ("q", "{broken"), ("r", json.dumps({"facets": []})), ("s", None), ("t", json.dumps({"facets": [{"facetParameter": "location", "values": [value("1", "x"), value("2", "Spain")]}]}))]
    found = facets.facet_values(spark.createDataFrame(pages, "board string, payload string"))
    assert sorted((r["board"], r["parameter"], len(r["values"])) for r in found.collect()) == [("p", "Locations", 4), ("p", "jobs", 1), ("p", "locationCountry", 3), ("t", "location", 2)]
    chosen = facets.country_facets(found, spark.createDataFrame([("Spain", "ES"), ("France", "FR")], "name string, code string"))
    assert sorted((r["board"], r["parameter"], r["id"] or "", r["codes"]) for r in chosen.collect()) == [("p", "locationCountry", "", ["ES"]), ("p", "locationCountry", "1", ["ES"]), ("p", "locationCountry", "2", ["FR"])]
    ads = spark.createDataFrame([(1, "p", "1", None), (2, "p", "7", "DE"), (3, "q", None, None)], "ad long, board string, facet_id string, country string")
    assert {r["ad"]: r["country"] for r in facets.with_facet_country(ads, chosen).collect()} == {1: "ES", 2: "DE", 3: None}
