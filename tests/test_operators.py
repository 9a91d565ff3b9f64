"""Operators on rows of our own: every branch, nulls, ties, brute force."""

import random

import pytest
from pyspark.sql import functions as F

from adweave.functions import dates, text
from adweave.operators import conditions, dedupe, memory, places, rules, scoring
from adweave.operators.components import connected_components
from adweave.sources.html import html_to_text
from adweave.sources.normalise import NORMALISERS, admitted


def values(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, s string")
    return [r[1] for r in df.select("i", fn(F.col("s"))).orderBy("i").collect()]


def test_fold_and_normalise(spark):
    words = ["Straße & Café", "Łódź Ørsted", "A/B  c d", None, "été", "ﬁn"]
    assert values(spark, text.fold, words)[:4] == ["strae cafe", "odz rsted", "a/b c d", ""]
    assert values(spark, text.normalise, words)[:5] == ["strasse cafe", "łodz ørsted", "a b c d", "", "ete"]


def test_tidy(spark):
    assert values(spark, text.tidy, [" a \r\n\n\n\n b  c ", None]) == ["a\n\nb c", ""]


def test_job_types(spark):
    got = values(spark, text.job_types_from_text, ["Intern part-time", "Contract", "part time", "full time or part time", "full-time", "", None, "permanent"])
    assert got == [["internship_or_working_student", "part_time"], ["freelance_or_contract", "fixed_term"], ["part_time"], ["part_time"], ["full_time_permanent", "fixed_term"], [], [], ["full_time_permanent"]]


def test_dates(spark):
    day = lambda s: dates.relative_day(s, F.to_date(F.lit("2024-03-10")))
    assert [str(x) for x in values(spark, day, ["Posted Today", "Posted 30+ Days Ago", "yesterday", "soon"])] == ["2024-03-10", "2024-02-09", "2024-03-09", "None"]
    turn = lambda s: dates.day_without_year(s, F.to_date(F.lit("2024-03-10")))
    assert [str(x) for x in values(spark, turn, ["9 Mar", "27 Aug", "x"])] == ["2024-03-09", "2023-08-27", "None"]
    close = lambda s: F.date_format(dates.parse_closing(s), "yyyy-MM-dd HH:mm")
    assert values(spark, close, ["2024-05-01", "2024-05-01T10:00:00Z", "soon", None]) == ["2024-05-01 23:59", "2024-05-01 10:00", None, None]


def test_html(spark):
    page = "<div>A&amp;B<script>x</script><ul><li>one<li>two</ul></div>"
    assert values(spark, html_to_text, [page, "&lt;p&gt;Hi&lt;/p&gt;", None]) == ["A&B\n\n• one\n• two", "Hi", ""]


def test_indel_ratio():
    assert dedupe.indel_ratio("abc", "abc") == 100.0 and round(dedupe.indel_ratio("design", "desig"), 2) == 90.91 and dedupe.indel_ratio("ab", "cd") == 0.0
    assert dedupe.title_ratio("hardware engineer", "engineer hardware") == 100.0 and dedupe.title_ratio("elektronik", "elektrotechnik") == 0.0


AD = "ad_id long, ordinal long, source string, source_job_id string, title string, company string, country string, town string, latitude double, longitude double, description string, complete boolean, posted_at timestamp"


def ad(i, title, company="Acme GmbH", source=None, job=None, country="DE", town="Berlin", description="", complete=True):
    return (i, i, source or f"s{i}", job or str(i), title, company, country, town, None, None, description, complete, None)


def test_duplicate_edges(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        ad(1, "Software Engineer (m/w/d)"), ad(2, "Engineer Software"), ad(3, "Senior Software Engineer"), ad(4, "Software Enginer", town=None), ad(5, "Software Engineer", country="AT"), ad(6, "Software Engineer", town="Hamburg"),
        ad(7, "Koch", "Top Recruiting"), ad(8, "Koch", "Top Recruiting", description=words), ad(9, "Koch", "Top Recruiting", description=words), ad(10, "x", None, "s", "same"), ad(11, "y", None, "s", "same"), ad(12, None), ad(13, "Software Engineer 12345"),
    ]
    got = {tuple(sorted(r)) for r in dedupe.duplicate_edges(spark.createDataFrame(rows, AD)).collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (4, 6), (8, 9), (10, 11)}


def test_known_towns_are_compared_by_where_they_are(spark):
    """Salford and Manchester are one place, two Neustadts far apart aren't; unknown names still go by their letters."""
    towns = spark.createDataFrame(
        [(1, ["Manchester"], "GB", 53.48, -2.24, 550_000, None, None, None), (2, ["Salford"], "GB", 53.49, -2.29, 100_000, None, None, None), (3, ["Neustadt"], "DE", 49.35, 8.14, 53_000, None, None, None), (4, ["Neustadt am Main"], "DE", 49.93, 9.57, 1_300, None, None, None)],
        "town_id long, names array<string>, country string, latitude double, longitude double, people long, region string, district string, area string",
    )
    regions = spark.createDataFrame([], "code string, level string, country string, names array<string>")
    at = lambda i, country, town, point=(None, None): (*ad(i, "Koch", country=country, town=town)[:8], *point, "", True, None)
    rows = [at(1, "GB", "Salford"), at(2, "GB", "Manchester"), at(3, "DE", "Neustadt"), at(4, "DE", "Neustadt am Main"), at(5, "DE", "Neustadt am Fluss"), at(6, "GB", None, (53.5, -2.2)), at(7, "GB", "Leeds", (53.8, -1.55)), at(8, None, "Salford")]
    frame = spark.createDataFrame(rows, AD)
    edges = lambda *more: {tuple(sorted(r)) for r in dedupe.duplicate_edges(frame, *more).collect()}
    with_towns, without = edges((towns, regions, None)), edges()
    assert with_towns - without == {(1, 2)}
    assert without - with_towns == {(3, 4), (3, 5), (4, 5)} & (without - with_towns) and (3, 4) in without - with_towns
    assert (6, 7) not in with_towns and {(1, 6), (2, 6), (1, 8), (6, 8)} <= with_towns


@pytest.mark.parametrize("seed", range(3))
def test_duplicate_edges_lose_nothing(spark, seed):
    r = random.Random(seed)
    base = ["elektroniker", "assistant", "warehouse", "driver", "night", "shift", "berlin", "maschinenbau"]

    def spoil(w):
        i = r.randrange(len(w))
        return r.choice([w, w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "q" + w[i:]])

    rows = [ad(i, " ".join(spoil(w) for w in r.sample(base, 3))) for i in range(60)]
    got = {tuple(sorted(x)) for x in dedupe.duplicate_edges(spark.createDataFrame(rows, AD)).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and dedupe.title_ratio(a[4].lower(), b[4].lower()) >= 90}
    assert want <= got


@pytest.mark.parametrize("seed", range(3))
def test_links_make_the_groups_of_all_pairs(spark, seed):
    """Equal ads are linked to one of them; agencies, unknown places, near titles and ads of one ordinal as in all pairs."""
    r = random.Random(seed)
    texts = ["", "short text of an ad", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(8, 64)), " ".join(f"v{i}" for i in range(60))]
    # one letter less is alike by 90, one word more or less by 85 only
    titles = ["warehouse driver night", "warehouse driver nights", "warehous driver night", "maschinenbau elektroniker assistentt", "maschinenbau elektronikr assistent", "maschinenbu elektronikr assistnt", "koch"]
    firms = ["Acme GmbH", "Acme GmbH", "Top Recruiting", "Acme (Recruiting)", None]
    rows = []
    for i in range(120):
        spot = r.choice([(None, None)] * 4 + [(50.0, 8.0), (50.1, 8.1), (53.0, 9.0)])
        rows.append((*ad(i, r.choice(titles), r.choice(firms), "s", str(i if i % 30 else 0), r.choice(["DE", "DE", "FR", None]), r.choice(["Berlin", "Bonn", None]))[:8], *spot, r.choice(texts), r.random() < 0.6, None))
        rows[-1] = (i, r.choice([i, i // 10]), *rows[-1][2:])
    frame = spark.createDataFrame(rows, AD)
    groups = lambda edges: dict(connected_components(edges).collect())
    want = groups(dedupe.duplicate_edges(frame))
    assert groups(dedupe.duplicate_links(frame)) == want and len(set(want.values())) > 3
    same = spark.createDataFrame([ad(i, "Koch", description=str(i)) for i in range(200)], AD)
    assert dedupe.duplicate_links(same).count() == 199


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rules_first_reason_and_unknown(spark):
    jobs = spark.createDataFrame([(1, "2024-01-01", "exact", True, True), (2, "2024-05-30", "day", False, False), (3, None, "unknown", False, False), (4, "2024-05-31 12:00:00", "exact", False, True)], "job_key long, d string, date_precision string, dismissed boolean, condition_no boolean").withColumn("posted_at", F.to_timestamp("d"))
    copies = spark.createDataFrame([(2, ["a"], None, "DE", None), (2, ["b"], None, None, None), (3, None, None, None, None), (4, None, "remote", "FR", None)], "job_key long, job_types array<string>, work_mode string, country string, closes_at timestamp")
    search = spark.createDataFrame([(1, 24, ["b"], False, ["DE"])], "search_id int, hours long, job_types array<string>, exclude_remote boolean, countries array<string>").withColumn("started_at", F.to_timestamp(F.lit("2024-06-01 02:00:00")))
    assert {r["job_key"]: r["reason"] for r in rules.apply_rules(jobs, copies, search).collect()} == {1: "dismissed", 2: None, 3: None, 4: "country"}


def test_remember_is_not_a_closure(spark):
    keyed = spark.createDataFrame([(1, ["k1"]), (2, ["k2"]), (3, ["k1", "k2"]), (4, ["old", "k9"]), (5, ["k9"])], "ordinal long, keys array<string>")
    known = spark.createDataFrame([("old", 7)], "key string, job_id long")
    got = {r["ordinal"]: (r["job_id"], r["is_new"]) for r in memory.remember(keyed, known, 100).collect()}
    assert got[1] == got[3] and got[1] != got[2] and got[4] == (7, False) and got[5] == (7, False) and got[2][1]


def brute_score(asked, spoken, written):
    levels = {"A1": 1, "A2": 2, "B1": 3, "B2": 4, "C1": 5, "C2": 6}
    if not spoken:
        return 15
    have, best, named = {k: levels[v] for k, v in spoken}, 15, set()
    for lang, level, must in asked:
        named.add(lang)
        if level == "not_needed":
            continue
        short = levels[level] - have.get(lang, 0)
        if short > 0:
            best = min(best, 12 if not must else 8 if short == 1 else 0)
    short = 4 - have.get(written, 0)
    if written and written not in named and short > 0:
        best = min(best, {1: 10, 2: 5}.get(short, 3))
    return best


def test_languages(spark):
    r, names, levels = random.Random(2), ["en", "de", "fr"], ["A1", "A2", "B1", "B2", "C1", "C2"]
    rows = []
    for i in range(200):
        asked = [(r.choice(names), r.choice([*levels, "not_needed"]), r.random() < 0.5) for _ in range(r.randint(0, 3))]
        spoken = [(n, r.choice(levels)) for n in r.sample(names, r.randint(0, 3))]
        rows.append((i, asked, spoken, r.choice([*names, None])))
    df = spark.createDataFrame(rows, "i int, asked array<struct<language:string,level:string,must_have:boolean>>, spoken array<struct<language:string,level:string>>, w string")
    got = {x[0]: x[1] for x in df.select("i", scoring.judge_languages(F.col("asked"), F.col("spoken"), F.col("w"))["points"]).collect()}
    assert got == {i: brute_score(a, s, w) for i, a, s, w in rows}


def test_locate_prefers_long_names(spark):
    towns = spark.createDataFrame([(1, ["Frankfurt"], "DE", 50.0, 8.0, 700000), (2, ["Frankfurt am Main"], "DE", 50.1, 8.6, 100), (3, ["Sachsen"], "DE", 51.0, 13.0, 900), (4, ["Ulm"], "DE", 48.4, 10.0, 120000)], "town_id long, names array<string>, country string, latitude double, longitude double, people long")
    regions = spark.createDataFrame([("SN", "region", "DE", ["Sachsen"])], "code string, level string, country string, names array<string>")
    texts = spark.createDataFrame([("Frankfurt am Main", "DE"), ("Sachsen", "DE"), ("Ulm, Landkreis Frankfurt", "DE"), (None, "DE"), ("", "DE")], "text string, country string")
    assert {r["text"]: r["town_id"] for r in places.locate(texts, towns, regions).collect()} == {"Frankfurt am Main": 2, "Ulm, Landkreis Frankfurt": 4}


def test_edits_are_checked(spark):
    own = spark.createDataFrame([(1, False, 10, 30, "car", True), (2, False, 10, 30, "car", True)], "condition_id int, switched_off boolean, min_people int, max_minutes int, travel_mode string, measured boolean")
    edits = spark.createDataFrame([(1, True, None, None, "train"), (2, None, -5, None, None), (9, True, None, None, None)], "condition_id int, switched_off boolean, min_people int, max_minutes int, travel_mode string")
    applied, refused = conditions.apply_edits(own, edits)
    got = {r["condition_id"]: (r["switched_off"], r["travel_mode"], r["measured"], r["changed_by_you"]) for r in applied.collect()}
    assert got == {1: (True, "train", False, True), 2: (False, "car", True, False)}
    assert {r["condition_id"]: r["why"] for r in refused.collect()} == {2: "size out of range", 9: "unknown condition"}


def test_normalisers_skip_what_they_cannot_read(spark):
    broken = spark.createDataFrame([("{not json",), (None,), ("{}",)], "payload string").withColumn("url", F.lit("https://a.example/1"))
    for run in NORMALISERS.values():
        assert run(broken).collect() == []


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.example/x/y",), ("https://a.example/x/z",), ("https://b.example/",)], "url string")
    robots = spark.createDataFrame([("a.example", "*", False, "/"), ("a.example", "us", False, "/x"), ("a.example", "us", True, "/x/z")], "host string, agent string, allow boolean, pattern string")
    assert {r["url"][-4:]: r["allowed"] for r in admitted(urls, robots, "us").collect()} == {"/x/y": False, "/x/z": True, "ple/": True}
