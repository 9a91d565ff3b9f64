"""Joins by index, grid or pointer against plain loops over all pairs."""

import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from adweave.functions.storage import materialise
from adweave.operators import components, containment, dedupe, memory, places, rules

TERM_KINDS = ("job_title", "field_or_skill")


def brute_hits(ads, terms):
    def has(words, text):
        text = " ".join((text or "").split())
        return all((f" {w} " in f" {text} ") if len(w) <= 3 else w in text for w in words)

    out = set()
    for ad, title, body, languages in ads:
        for text, language, kind in terms:
            words = (text or "").split()
            if words and language in (languages or []) and (has(words, title) or (kind == "field_or_skill" and has(words, body))):
                out.add((ad, text, language, kind))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_term_index_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abc", k=rng.choice([1, 2, 3, 4, 5, 6, 8])))
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    ads = [(k, text(4) or None, rng.choice([None, text(40), text(12)]), rng.choice([["en"], ["en", "de", "en"], [], None, ["fr"]])) for k in range(120)]
    ads += [(1000 + k, "hot word", "hot word here", ["en"]) for k in range(80)]
    terms = [(text(3), rng.choice(["en", "de", "fr", None]), rng.choice(TERM_KINDS)) for _ in range(150)] + [("hot word", "en", "job_title"), ("hot", "en", "field_or_skill"), (None, "en", "job_title"), ("", "en", "job_title")]
    terms += terms[:20]
    frame = spark.createDataFrame(ads, "ad_id long, title string, description string, languages array<string>")
    asked = spark.createDataFrame(terms, "text string, language string, kind string")
    got = [tuple(r) for r in rules.term_hits(frame, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_hits(ads, terms)
    matched = {r["ad_id"]: r["matched"] for r in rules.match_terms(frame, asked).collect()}
    assert matched == {a[0]: any(h[0] == a[0] for h in got) for a in ads}


@pytest.mark.parametrize("small", [False, True])
def test_term_counts_equal_all_pairs(spark, monkeypatch, small):
    """Hits are counted by bitmaps, in parts and slices of any size, and never made as rows."""
    if small:
        monkeypatch.setattr(rules, "PART_ADS", 16)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abc", k=rng.choice([1, 2, 3, 4, 5, 6, 8])))
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    ads = [(k, text(4) or None, rng.choice([None, text(40), text(12)]), rng.choice([["en"], ["en", "de", "en", None], [], None, ["fr"]])) for k in range(200)]
    ads += [(1000 + k, "hot word", "hot word here", ["en"]) for k in range(3000)]
    terms = [(text(3), rng.choice(["en", "de", "fr", None]), rng.choice(TERM_KINDS)) for _ in range(150)] + [("hot word", "en", "job_title"), ("hot here", "en", "field_or_skill"), ("hot", "en", None), (None, "en", "job_title"), ("", "en", "job_title")]
    terms += terms[:20]
    frame = spark.createDataFrame(ads, "ad_id long, title string, description string, languages array<string>")
    out = rules.term_counts(frame, spark.createDataFrame(terms, "text string, language string, kind string"))
    got = [tuple(r) for r in out.collect()]
    hits = brute_hits(ads, {t for t in terms if t[1]})
    assert sorted(got, key=str) == sorted(((*t, n) for t, n in Counter(h[1:] for h in hits).items()), key=str) and max(r[3] for r in got) >= 3000
    none = frame.where("ad_id < 0")
    assert rules.term_counts(none, out.select("text", "language", "kind")).count() == 0


def test_a_hundred_thousand_terms(spark):
    """Each ad meets the terms of its rarest words, not all of them."""
    ads = spark.range(2000).selectExpr("id AS ad_id", "concat('title of number', id) AS title", "'text' AS description", "array('en') AS languages")
    terms = spark.range(100_000).selectExpr("concat('number', id, ' title') AS text", "'en' AS language", "'job_title' AS kind")
    hits = rules.term_hits(ads, terms)
    # number12 stands in number120 and number1200 as well
    assert hits.count() == sum(str(t) in str(a) and str(a).startswith(str(t)) for a in range(2000) for t in {int(str(a)[:k]) for k in range(1, len(str(a)) + 1)})
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_words_inside_words(spark):
    words = lambda c, w: spark.createDataFrame([(x,) for x in w], f"{c} string")
    got = {tuple(r) for r in rules.words_with(words("v", ["ab", "abc", "abcd", "xabcdy", "abcabcd", "zzzz", "日本語文字"]), words("x", ["ab", "abc", "abcd", "bcdy", "zzzzz", "本語文字", "語文"])).collect()}
    assert got == {("ab", "ab"), ("abc", "abc"), ("abcd", "abcd"), ("xabcdy", "abcd"), ("abcabcd", "abcd"), ("xabcdy", "bcdy"), ("日本語文字", "本語文字")}


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def test_nearest_towns_over_poles_and_lines(spark):
    rng = random.Random(8)
    spot = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(88, 90), rng.uniform(-180, 180)), (rng.uniform(-20, 20), rng.choice([-1, 1]) * rng.uniform(178, 180))])
    towns = [(k, rng.choice("AB"), *spot()) for k in range(25)] + [(90, "C", 50.0, 10.0), (91, "C", 50.0, 10.0)]
    points = [(k, rng.choice("ABCD"), *spot()) for k in range(150)] + [(500, "A", None, 3.0), (501, "C", -50.0, -170.0), (502, None, 1.0, 1.0)]
    points += [(1000 + k, "B", 10.0, 10.0) for k in range(50)]
    got = places.nearest_by_rings(
        spark.createDataFrame(points, "point_id long, country string, latitude double, longitude double"),
        spark.createDataFrame(towns, "town_id long, country string, latitude double, longitude double"),
        50.0,
    )
    want = {}
    for k, country, lat, lon in points:
        own = [(distance((lat, lon), t[2:]), t[0]) for t in towns if t[1] == country] if lat is not None else []
        if own:
            want[k] = min(own)
    found = {r["point_id"]: (r["distance"], r["town_id"]) for r in got.collect()}
    assert found.keys() == want.keys()
    for k in want:
        assert found[k][1] == want[k][1] and abs(found[k][0] - want[k][0]) < 1e-6, k


def test_no_point_meets_all_towns(spark):
    towns = spark.range(4000).selectExpr("id AS town_id", "'A' AS country", "40 + (id % 100) * 0.05 AS latitude", "(id div 100) * 0.05 AS longitude", "1000L AS people", "array('t') AS names")
    points = spark.createDataFrame([(k, "A", 30.0 - k % 7, -8.0) for k in range(70)], "point_id long, country string, latitude double, longitude double")
    found = places.nearest_by_rings(points, towns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and found.count() == 70
    assert {r["town_id"] for r in found.collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_remember_with_long_chains_and_many_keys(spark, seed):
    from tests.test_sequences import remember_brute

    rng = random.Random(seed)
    if seed == 0:
        rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(400)]  # one chain
    elif seed == 1:
        rows = [(i, [f"k{i}", f"k{i + 1}", f"k{i + 2}", f"j{i // 3}"]) for i in range(200)]  # braided: pointers would grow
    else:
        rows = [(i, list({"hot", f"k{rng.randint(0, 300)}", f"k{rng.randint(0, 300)}"} if i > 5 else {f"k{i}"})) for i in range(500)]
    known = [("k150", 7)] if seed else [("k300", 9)]
    keyed, old = spark.createDataFrame(rows, "ordinal long, keys array<string>"), spark.createDataFrame(known, "key string, job_id long")
    before = len(memory.materialise.__globals__["_WRITTEN"])
    out = {x["ordinal"]: x["job_id"] for x in memory.remember(keyed, old, 1000).collect()}
    written = len(memory.materialise.__globals__["_WRITTEN"]) - before
    assert out == remember_brute(rows, known, 1000)[0]
    if seed == 0:
        assert written <= 3 + 2 * 10  # 2**9 > 400: a chain takes log n rounds


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("hot", [2, components.HOT])
def test_components_with_split_centres(spark, monkeypatch, hot):
    monkeypatch.setattr(components.meet_least, "__defaults__", (None, hot))
    rng = random.Random(4)
    edges = [(500, k) for k in range(100, 200)] + [(k, 1) for k in range(150, 230)] + [(k, k + 1) for k in range(600, 660)] + [(7, 7), (None, 3), (9, None), (800, 801), (801, 800)]
    edges += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(90)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges)


def test_no_task_reads_a_whole_star(spark):
    """A star with a million leaves: its centre's edges lie in many partitions."""
    edges = spark.range(1, 1_000_001, 1, 8).selectExpr("0L AS u", "id AS v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = components.meet_least(edges, least)
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1_000_000 and max(sizes) < 500_000
    got = components.connected_components(edges.where("v <= 200000"), "u", "v")
    assert got.where("component = 0").count() == 200_001


@pytest.mark.parametrize(("seed", "percent"), [(1, 50), (2, 80), (3, 100), (4, 1)])
def test_containment_loses_no_pair(spark, seed, percent):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(14)] + ["hot"] * 5

    def sets(n):
        return [(k, None if k == 3 else sorted({rng.choice(pool) for _ in range(rng.randint(0, 9))}, key=lambda w: rng.random()), rng.choice(["x", "x", "y", None])) for k in range(n)]

    left, right = sets(90), sets(70)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, words array<string>, block string")
    pairs, l_members, r_members = containment.containment_join(frame(left, "l"), frame(right, "r"), "l", "r", percent, block="block")
    l_rep, r_rep = ({tuple(r)[0]: tuple(r)[1] for r in m.collect()} for m in (l_members, r_members))
    got = {(r["l"], r["r"]): r["share"] for r in pairs.collect()}
    want = {}
    for a, x, u in left:
        for b, y, v in right:
            if x and y and (u or "") == (v or ""):
                n = len(set(x) & set(y))
                if 100 * n >= percent * min(len(x), len(y)):
                    want[a, b] = n / min(len(x), len(y))
    assert {(a, b): got[l_rep[a], r_rep[b]] for a, b in want} == want
    assert len(got) == len({(l_rep[a], r_rep[b]) for a, b in want})


def test_equal_agency_ads_cost_a_row_each(spark):
    text = " ".join(f"word{k}" for k in range(60))
    jobs = [(k, k, "Koch (m/w/d)", "Acme Recruiting" if k % 2 else "Acme", "de", text) for k in range(300)]
    jobs += [(900, 900, "Bäcker", "Acme Recruiting", None, text), (901, 901, "Baecker", "Backhaus", "at", text), (902, 902, "Koch", "Best Recruiting", None, text + " more")]
    frame = spark.createDataFrame(jobs, "job_key long, ordinal long, title string, company string, country string, description string")
    got = {r["job_key"]: r["repeats"] for r in dedupe.tag_agency_repeats(frame).collect()}
    assert got == {**{k: 0 for k in range(300) if k % 2}, 900: 901, 902: 0}
    _, members, _ = containment.containment_join(frame.select("job_key", F.split("description", " ").alias("words")), frame.selectExpr("job_key AS b", "split(description, ' ') AS words"), "job_key", "b", 50)
    assert members.select("rep").distinct().count() == 2


def test_containment_stores_and_shuffles_no_words_that_only_one_side_has(spark, monkeypatch):
    """Texts of their own are hashed, and neither written nor in the ranks: the disk follows what two sides share."""
    alone = [(k, list(range(1000 * k, 1000 * k + 200))) for k in range(40)]
    left = spark.createDataFrame([*alone, (90, [-1, -2, -3, -4])], "l long, words array<bigint>")
    right = spark.createDataFrame([(k, [w + 500_000 for w in words]) for k, words in alone] + [(91, [-4, -3, -9])], "r long, words array<bigint>")
    for few in (containment.FEW, 0):  # one side sent to every task, and both shuffled
        monkeypatch.setattr(containment, "FEW", few)
        written = {}
        monkeypatch.setattr(containment, "materialise", lambda df, label: written.setdefault(label, materialise(df, label)))
        pairs, _, _ = containment.containment_join(left, right, "l", "r", 50)
        assert {tuple(x) for x in pairs.collect()} == {(90, 91, 2 / 3)}
        ranks = written["containment-ranks"].collect()
        assert {(x["side"], x["rep"], x["size"], frozenset(x["h"])) for x in ranks} == {(0, 90, 4, frozenset({-3, -4})), (1, 91, 3, frozenset({-3, -4}))}
        assert not any(t.startswith("array") for label, df in written.items() if label != "containment-ranks" for _, t in df.dtypes)
