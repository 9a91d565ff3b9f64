"""Queries that answer for all rows."""

from pathlib import Path

import pytest

from adweave.operators import dedupe, rules
from adweave.plans import registry

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables aren't here")


def pairs(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_containments_of_all_pairs(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c"]), (3, []), (4, None)], "l long, words array<string>")
    right = spark.createDataFrame([(40, ["a", "b"]), (199, ["c", "d", "e", "f"]), (5, ["x"])], "r long, words array<string>")
    assert pairs(dedupe.containments(left, right, "l", "r"), "l", "r", "share") == {(1, 40, 1.0), (1, 199, 1 / 3), (2, 199, 1.0)}


@given
def test_containment_query_has_more_than_one_item_a_document(spark):
    out = pairs(registry.queries()["b24_containment"](spark, DATA), "doc_id", "item_id")
    assert any(i != d % 40 for d, i in out)


@given
def test_places_are_measured_to_every_town(spark):
    q = registry.queries()
    nearest = pairs(q["d16_travel_candidates"](spark, DATA), "point_id", "town_id")
    assert {t for _, t in nearest} - {t for t in range(1000) if t % 50 == 7}
    assert q["d14_near_km"](spark, DATA).where("answer = 'yes'").count() > 0


@given
def test_broadest_titles_of_every_part(spark):
    assert any(r["id"] % 4 == 3 for r in registry.queries()["c17_broadest_titles"](spark, DATA).collect())


@given
def test_states_of_all_jobs(spark):
    events, known = spark.read.parquet(f"{DATA}/events.parquet"), {r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()}
    users = [r["user_id"] for r in events.select("user_id").collect()]
    out = registry.queries()["i11_set_states"](spark, DATA).collect()
    assert sorted(r["job_id"] for r in out if not r["refused"]) == sorted(set(users) & known)
    assert sorted(r["job_id"] for r in out if r["refused"]) == sorted(u for u in users if u not in known)


def test_unmatched_names_by_all_words_of_a_term(spark):
    names = spark.createDataFrame([(1, "en", "senior Data engineer"), (2, "en", "data clerk"), (3, "de", "Koch"), (4, "de", None), (5, "en", "engineer of data")], "id long, lang string, name string")
    terms = spark.createDataFrame([("data engineer",), ("data",), ("",), (None,), ("data absent",)], "term string").where("term IS NULL OR term <> 'data'")
    assert pairs(rules.unmatched_names(names, terms), "lang", "n") == {("en", 1), ("de", 2)}


def test_long_words_may_differ_by_more_than_two_letters(spark):
    long = "abcdefghijklmnopqrstuvwxyz"
    titles = ["abcdefghijklmnopq", "abdefgijklmnpq", long, long[1:5] + long[6:12] + long[13:20] + long[21:], "Koch", "qponmlkjihgfedcba"]
    rows = [(i, i, f"s{i}", str(i), t, "Acme", "de", None, None, None, "x", True) for i, t in enumerate(titles)]
    ads = spark.createDataFrame(rows, "ad_id long, ordinal long, source string, source_job_id string, title string, company string, country string, town string, latitude double, longitude double, description string, complete boolean")
    assert pairs(dedupe.duplicate_edges(ads), "a", "b") == {(0, 1), (2, 3)}
