"""Where jobs are, late rules, counts and agency repeats, against plain loops."""

import random

from pyspark.sql import functions as F

from adweave.operators import dedupe, results


def test_job_points(spark):
    rows = [
        (1, 1, "XX", None, None, 5.0, 6.0), (1, 2, "DE", 1.0, None, None, None), (1, 3, "FR", 2.0, 3.0, None, None), (1, 4, "DE", 8.0, 9.0, None, None),
        (2, 2, "XX", None, None, 7.0, 7.5), (2, 1, None, None, None, None, None), (3, 1, "DE", None, None, None, 4.0),
    ]
    copies = spark.createDataFrame(rows, "job_key long, ordinal long, country string, latitude double, longitude double, town_latitude double, town_longitude double")
    got = {r["job_key"]: tuple(r)[1:] for r in results.job_points(copies, ("DE", "FR")).collect()}
    assert got == {1: ("DE", 2.0, 3.0, "address"), 2: (None, 7.0, 7.5, "town"), 3: ("DE", None, None, None)}
    assert results.job_points(copies.limit(0), ("DE",)).collect() == []


def test_towns_of_districts(spark):
    names = spark.createDataFrame([(1, "Köln-Deutz", "DE"), (2, "Baden-Baden", "DE"), (3, "Köln", "FR"), (4, "x-Köln", "DE"), (5, None, "DE"), (6, "", None)], "n int, name string, country string")
    towns = spark.createDataFrame([("Koln", "DE"), ("Köln", "DE"), ("Baden-Baden", "DE"), ("Baden", "DE")], "name string, country string")
    assert {r["n"]: r["town"] for r in results.towns_of_districts(names, towns).collect()} == {1: "Köln", 2: "Baden-Baden", 3: None, 4: None, 5: None, 6: None}


def test_late_reasons(spark):
    rows = [(1, "closed", "remote", ["a"], None), (2, None, "remote", [], None), (3, None, None, ["a", "b"], "b"), (4, None, None, ["a", "b"], "a"), (5, None, "hybrid", None, None), (6, None, None, [], "b")]
    df = spark.createDataFrame(rows, "k int, reason string, mode string, stated array<string>, read string")
    out = df.select("k", results.late_reason(F.col("reason"), F.col("mode"), F.col("stated"), F.col("read"), F.lit(True), F.array(F.lit("a"))).alias("r"))
    assert {r["k"]: r["r"] for r in out.collect()} == {1: "closed", 2: "remote_by_text", 3: "job_type_by_text", 4: None, 5: None, 6: "job_type_by_text"}


def test_languages_and_counts(spark):
    rows = [(1, 1, ["de"], []), (1, 2, ["nl", "fr", "de"], ["fr", "xx"]), (2, 1, ["fr", "en"], None), (3, 1, ["nl", "fr"], ["xx"])]
    out = results.languages_for(spark.createDataFrame(rows, "search_id int, ordinal int, languages array<string>, place_languages array<string>"))
    assert {r["search_id"]: r["languages"] for r in out.collect()} == {1: ["en", "de", "fr"], 2: ["en", "fr"], 3: ["en", "nl", "fr"]}
    shown = spark.createDataFrame([(1, 1, True), (1, 1, False), (1, 2, False), (2, 1, None)], "search_id int, job_id int, is_new boolean")
    assert {r["search_id"]: (r["shown"], r["new_count"]) for r in results.shown_counts(shown).collect()} == {1: (2, 1), 2: (1, 0)}


def test_agency_repeats_equal_all_pairs(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    common = " ".join(f"c{i}" for i in range(9))  # a passage in every ad
    texts = [" ".join(r.choice(words) for _ in range(r.randint(6, 14))) for _ in range(8)]
    jobs = []
    for i in range(60):
        own = r.choice(texts) + " " + (" ".join(r.choice(words) for _ in range(r.randint(0, 12))))
        jobs.append((i, i, r.choice(["Cook", "Cook", "Senior Cook", "Driver 12345"]), "Best Staffing" if i % 3 == 0 else f"Firm {i}", r.choice(["DE", "FR", None]), f"{common} {own}" if i % 2 else own))
    df = spark.createDataFrame(jobs, "job_key long, ordinal long, title string, company string, country string, description string")
    got = {x["job_key"]: x["repeats"] for x in dedupe.tag_agency_repeats(df).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {}
    for a in jobs:
        for b in jobs:
            if a[3] == "Best Staffing" and b[3] != "Best Staffing" and a[2] == b[2] and (a[4] is None or b[4] is None or a[4] == b[4]):
                s, t = grams(a[5]), grams(b[5])
                if s and t and len(s & t) >= 0.5 * min(len(s), len(t)):
                    want[a[0]] = min(b[1], want.get(a[0], 10**9))
    assert got == want and len(want) > 3


def test_languages_of_countries_with_one_ordinal_take_turns(spark):
    rows = [(1, 5, ["fr", "de", "it"], []), (1, 5, ["nl", "fr", "de"], []), (2, 7, ["es"], []), (2, 3, ["en", "ga"], ["ga"]), (3, 1, [], None)]
    got = results.languages_for(spark.createDataFrame(rows, "search_id int, ordinal long, languages array<string>, place_languages array<string>"))
    assert {r["search_id"]: r["languages"] for r in got.collect()} == {1: ["en", "fr", "nl", "de", "it"], 2: ["en", "ga", "es"], 3: ["en"]}
