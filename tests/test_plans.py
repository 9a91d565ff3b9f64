"""How often plans work out what is costly, and how many rows their joins meet."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from adweave.sources import lists

NAMES = "name string, code string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("source", ["euraxess", "jobsacuk", "jobsireland", "details"])
def test_elements_are_looked_for_once(spark, source):
    """Filters on what was read from a page don't read it again."""
    pages = spark.range(3).select(F.col("id").cast("string").alias("source_job_id"), F.lit("<p>").alias("payload"), F.lit("2024-01-01").alias("seen_on")).repartition(2)
    made = {
        "euraxess": (lambda: lists.euraxess_list(pages, spark.createDataFrame([("Spain", "ES")], NAMES)), "id-Work-Locations"),
        "jobsacuk": (lambda: lists.jobsacuk_list(pages), "Date Placed"),
        "jobsireland": (lambda: lists.jobsireland_list(pages), "StartDate"),
        "details": (lambda: lists.jobsireland_details(pages), "ng-bind-html"),
    }
    run, mark = made[source]
    # the pattern of a start tag names its attribute twice or three times, for both quotes and the lookahead
    assert 1 <= plan(run()).count(mark) <= 8


def test_ads_of_few_labels_are_read_before_they_are_dealt_by_them(spark):
    """Else all ads of a list of labels are one task's, with all that is read from their blocks."""
    block = "<div id='job-teaser-content'><h3 class='ecl-content-block__title'><a href='/jobs/7'>Chemist</a></h3><span class='ecl-label'>Spain</span><div class='id-Work-Locations'>Work Locations: Bilbao</div></div>"
    out = lists.euraxess_list(spark.createDataFrame([(block,)], "payload string"), spark.createDataFrame([("Spain", "ES")], NAMES))
    lines = plan(out).splitlines()
    join, read = (next(i for i, line in enumerate(lines) if mark in line) for mark in ("Join LeftOuter", "id-Work-Locations"))
    assert join < read and "part" in lines[join]
    row = out.first()
    assert (row["source_job_id"], row["title"], row["location_text"], row["country"]) == ("7", "Chemist", "Bilbao", "ES")


def test_titles_are_compared_once_and_places_by_cells(spark):
    """Pairs against all pairs, where each mix of coordinates, towns and names occurs; equal titles cost one row."""
    import math
    import random

    from adweave.operators import dedupe

    rng = random.Random(7)
    rows = []
    for i in range(240):
        own, town = rng.random() < 0.4, rng.random() < 0.5
        spot = lambda yes: (50 + rng.random(), 8 + rng.random()) if yes else (None, None)
        rows.append((i, i, rng.random() < 0.2, "acme", "", "", rng.choice(["clerk of sales", "clerk for sales", "clerks of sales", "cook"]), rng.choice(["DE", "AT", None]), rng.choice(["", "bonn", "bonn beuel", "ulm"]), *spot(own), *spot(town)))
    small = spark.createDataFrame(rows, "ad_id long, ordinal long, agency boolean, company_key string, levels string, numbers string, t string, country string, town string, latitude double, longitude double, t_lat double, t_lon double")
    small = small.withColumn("words", F.array_distinct(F.split("t", " ")))

    def km(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    def one_place(a, b):
        if a[7] and b[7] and a[7] != b[7]:
            return False
        for k in (9, 11):
            if a[k] is not None and b[k] is not None:
                return km(a[k : k + 2], b[k : k + 2]) <= 30
        return not a[8] or not b[8] or a[8] in b[8] or b[8] in a[8]

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and dedupe.title_ratio(a[6], b[6]) >= 85 and one_place(a, b)}
    got = [(r["a"], r["b"]) for r in dedupe.candidate_pairs(small).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert dedupe.like_titles(small).count() <= 16


def test_towns_of_one_spot_meet_a_point_as_one(spark):
    """Many towns at a spot: the answers of all pairs, by joins that see the spot once."""
    from adweave.operators import conditions, places

    town = spark.range(400).select(F.col("id").alias("town_id"), F.lit("N").alias("country"), (50 + F.col("id") % 4 / 10).alias("latitude"), F.lit(8.0).alias("longitude"), (F.col("id") * 37 % 400 * 1000).alias("people"))
    point = spark.range(100).select(F.col("id").alias("point_id"), F.lit("N").alias("country"), (50 + F.col("id") % 5 / 10).alias("latitude"), F.lit(8.01).alias("longitude"))
    assert places.by_spot(town).count() == 4
    got = conditions.travel_candidates(point, town, 30, "car")
    assert {(r["point_id"], r["place"], r["town_id"]) for r in got.where("point_id IN (0, 1)").collect()} == {(0, 1, 0), (0, 2, 4), (1, 1, 1), (1, 2, 5)} and got.count() == 200
    assert {r["answer"] for r in conditions.near_km(point, town, 12.0).collect()} == {"yes"}
    best = {k: max((i * 37 % 400 * 1000, -i) for i in range(400) if i % 4 == k)[1] * -1 for k in range(4)}
    assert {r["town_id"] for r in places.town_at(point.where("point_id % 5 < 4"), town).collect()} <= set(best.values())


def test_terms_of_several_words_carry_no_sets(spark):
    """Each other word of a term is looked up, an ad's whole set of words isn't joined to each term."""
    from adweave.operators import rules

    ads = spark.createDataFrame([(1, "red blue cook", "green tea", ["en"]), (2, "red cook", "blue green", ["en"]), (3, None, "red blue green", ["en"])], "ad_id long, title string, description string, languages array<string>")
    terms = spark.createDataFrame([("blue red", "en", "job_title"), ("blue green red", "en", "field_or_skill"), ("tea", "en", "field_or_skill"), ("cook red blue", "en", "job_title"), ("blue red", "de", "job_title")], "text string, language string, kind string")
    hits = rules.term_hits(ads, terms)
    assert {(r["ad_id"], r["text"]) for r in hits.collect()} == {(1, "blue red"), (3, "blue green red"), (1, "tea"), (1, "cook red blue")}
    assert "collect_set(x" not in plan(hits)


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """No filter on the list's size is moved below the columns, where it would work out each text again."""
    from adweave.functions.text import shingles
    from adweave.operators import containment, dedupe, rules

    rows = spark.range(4).select("id", F.concat_ws(" ", *(F.lit(w) for w in "abcdef"), F.col("id").cast("string")).alias("text"))
    runs = shingles(F.col("text"))
    plans = [dedupe.containments(rows.select("id", runs.alias("words")), rows.select(F.col("id").alias("k"), runs.alias("words")), "id", "k")]
    plans.append(containment.shared_words(*(containment.hashed_sets(rows, "id", runs, None) for _ in range(2)), False))
    seen = []
    monkeypatch.setattr(rules, "materialise", lambda df, label: seen.append(df) or df)
    out = rules.unmatched_names(rows.selectExpr("id", "'x' AS lang", "text AS name"), rows.where("id = 2").selectExpr("text AS term"))
    assert {tuple(r) for r in out.collect()} == {("x", 3)} and len(seen) == 2
    for df in [*plans, seen[1]]:
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("regexp_replace" in line for line in lines)
        assert not any("Filter" in line and "regexp_replace" in line for line in lines)
