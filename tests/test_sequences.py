"""Operators whose answer depends on order, state or restarts, against plain loops."""

import html
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from html import entities

import pytest
from pyspark.sql import functions as F

from adweave.functions import sinks, storage
from adweave.operators import memory, rules
from adweave.sources.html import html_to_text, unescape
from adweave.sources.normalise import union_sources
from adweave.streaming import feeds, states


def remember_brute(rows, known, first_new_id):
    owner, ids, new = dict(known), {}, 0
    for ordinal, keys in sorted(rows):
        found = [owner[k] for k in keys if k in owner]
        if found:
            ids[ordinal] = min(found)
        else:
            ids[ordinal], new = first_new_id + new, new + 1
        for k in keys:
            owner.setdefault(k, ids[ordinal])
    return ids, owner


def test_remember_equals_a_loop(spark):
    for seed in range(4):
        r = random.Random(seed)
        rows = [(i, [f"k{r.randint(0, 40)}" for _ in range(r.randint(0, 3))]) for i in range(70)]
        known = [(f"k{i}", r.randint(1, 9)) for i in r.sample(range(41), 6)]
        if seed == 0:
            rows, known = [(1, ["a", "k1"]), (2, ["b", "k2"]), (3, ["k1", "k2"])], [("a", 5), ("b", 3)]
        keyed, old = spark.createDataFrame(rows, "ordinal long, keys array<string>"), spark.createDataFrame(known, "key string, job_id long")
        out = memory.remember(keyed, old, 1000)
        ids, owner = remember_brute(rows, known, 1000)
        assert {x["ordinal"]: x["job_id"] for x in out.collect()} == ids
        assert all(x["is_new"] == (x["job_id"] >= 1000) for x in out.collect())
        assert {x["key"]: x["job_id"] for x in memory.remembered_keys(keyed, old, out).collect()} == owner


def test_terms_are_normalised_like_texts(spark):
    ads = spark.createDataFrame([(1, "Programación web", "", ["es"]), (2, "Web developer", "we do programación", ["es", "en"]), (3, "art of it", None, ["en"]), (4, None, "IT", ["en"]), (5, "x", "y", [])], "ad_id long, title string, description string, languages array<string>")
    match = lambda *terms: {r["ad_id"] for r in rules.match_terms(ads, spark.createDataFrame(list(terms), "text string, language string, kind string")).where("matched").collect()}
    assert match(("Programación", "es", "job_title")) == {1}
    assert match(("programacion, WEB", "es", "field_or_skill")) == {1}
    assert match(("programación", "es", "field_or_skill")) == {1, 2}
    assert match(("it", "en", "field_or_skill")) == {3, 4}
    assert match(("", "en", "job_title"), ("?!", "es", "field_or_skill"), ("ar", "en", "job_title")) == set()
    assert len(rules.match_terms(ads, spark.createDataFrame([], "text string, language string, kind string")).collect()) == 5


def test_ordinals_are_unique_and_in_order_over_many_partitions(spark):
    a, b = spark.range(0, 1000, 1, 200).withColumnRenamed("id", "n"), spark.range(1000, 1300, 1, 150).withColumnRenamed("id", "n")
    rows = sorted((r["ordinal"], r["n"]) for r in union_sources([a, b]).collect())
    assert [n for _, n in rows] == list(range(1300)) and len({o for o, _ in rows}) == 1300


def test_entities_are_read_once(spark):
    """As the standard library of Python reads them, which follows the HTML standard."""
    rng = random.Random(2)
    texts = ["&ccedil;a &#8217;&#x27; &copy; &aacute;", "&amp;lt;b&amp;gt;", "a & b &nosuch; &#0; &#55296; &#x1F600;", "&&amp;&", "", None, "plain", "&lt;p&gt;x&lt;/p&gt; &NotAnEntity", "&check;&commat;&eacute &eacutex &notit; &not &#146;&#150;&#129;&#x80 &#13;&#1;&#xFDD0;&#99999999999;&#x110000;&#xfffe;"]
    texts += ["".join(f"&{n} " for n in list(entities.html5)[k : k + 100]) for k in range(0, len(entities.html5), 100)]
    parts = ["&", "#", "x", "X", ";", "1", "38", "a0", "96", " ", "amp", "lt", "eacute", "not", "in", "notin", "é", "\n", "<", "AElig", "frac12", "nbsp", "0"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(unescape(F.col("t"))).collect()]
    want = [html.unescape(t) if t else t for t in texts]
    assert {t: (g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w} == {}
    assert got == want
    page = "<p>A&eacute;&nbsp;b</p><ul><li>one<li>two &#169;</ul><script>x</script>&lt;b&gt;bold&lt;/b&gt;"
    got = spark.createDataFrame([(page,)], "t string").select(html_to_text(F.col("t"))).first()[0]
    assert [line for line in got.split("\n") if line] == ["Aé b", "• one", "• two ©", "bold"]


def write_feed(spark, folder, rows):
    spark.createDataFrame(rows, "user string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


SCHEMA = "user string, ts timestamp, value double"
START = datetime(2024, 1, 1)


def test_first_seen_goes_on_after_a_restart(spark, tmp_path):
    folder, at = str(tmp_path / "feed"), lambda s: START + timedelta(seconds=s)
    run = lambda: {r["user"]: r["first_seen"] for r in states.first_seen(feeds.read_feed(spark, folder, SCHEMA), "user", "ts", f"first-{tmp_path.name}").collect()}
    write_feed(spark, folder, [("u", at(1), 1.0), ("v", at(5), 1.0)])
    write_feed(spark, folder, [("v", at(2), 1.0)])
    assert run() == {"u": at(1), "v": at(2)}
    write_feed(spark, folder, [("u", at(9), 1.0), ("w", at(7), 1.0)])
    assert run() == {"u": at(1), "v": at(2), "w": at(7)}
    assert run() == {"u": at(1), "v": at(2), "w": at(7)}  # nothing new


def test_streams_carry_state_over_batches_and_runs(spark, tmp_path):
    folder, day = str(tmp_path / "feed"), lambda n, h=0: START + timedelta(days=n, hours=h)
    once = lambda: feeds.run_available(feeds.first_of_each(feeds.read_feed(spark, folder, SCHEMA), ["user"], "ts", "40 days"), f"once-{tmp_path.name}")
    daily = lambda: feeds.run_available(feeds.daily_counts(feeds.read_feed(spark, folder, SCHEMA), "user", "ts", "value"), f"daily-{tmp_path.name}")
    write_feed(spark, folder, [("a", day(0), 1.0), ("b", day(0, 3), 2.0), ("a", day(0, 9), 3.0)])
    write_feed(spark, folder, [("a", day(1), 1.0), ("c", day(1), 1.0)])
    assert sorted(r["user"] for r in once().collect()) == ["a", "b", "c"]
    assert daily().count() == 0  # the watermark hasn't passed a day's end by more than a day
    write_feed(spark, folder, [("b", day(5), 1.0), ("d", day(5), 1.0)])
    write_feed(spark, folder, [("a", day(0, 1), 100.0)])  # too late for the days
    write_feed(spark, folder, [("e", day(9), 1.0)])
    assert sorted(r["user"] for r in once().collect()) == ["a", "b", "c", "d", "e"]
    closed = {(r["day"], r["user"]): (r["n"], r["total"]) for r in daily().collect()}
    assert {k: v for k, v in closed.items() if k[0] == day(0) and k[1] == "b"} == {(day(0), "b"): (1, 2.0)} and closed[day(1), "c"] == (1, 1.0)
    assert closed[day(0), "a"] in ((2, 4.0), (3, 104.0))  # late rows count only while their batch's watermark hasn't moved


def by_hand(rows, days, upto):
    """What each row without a text recalls, going through all rows in order."""
    out, last = {}, {}
    for user, at, number, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if text:
            last[user] = (at, text)
        elif at <= upto:
            known = last.get(user)
            out[number] = known[1] if known and at - known[0] <= timedelta(days=days) else None
    return out


def state_rows(spark, folder, column):
    with states.state_store(spark):
        read = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", column)
        return read.load().count()


def test_recalled_texts_dont_depend_on_batches(spark, tmp_path):
    """Several files, a restart, late rows, and a state that empties."""
    rng, schema = random.Random(5), "user string, ts timestamp, number long, text string"
    rows = [(rng.choice("ab"), START + timedelta(minutes=rng.randrange(60 * 24 * 12)), k, rng.choice([None, "", None, "one", "two"])) for k in range(300)]
    rows.append((None, START + timedelta(days=1), 300, "null key"))
    rows.append((None, START + timedelta(days=2), 301, None))
    rows.sort(key=lambda r: r[1] + timedelta(hours=rng.randrange(20)))  # each at most 20 hours out of order
    folder, name = str(tmp_path / "feed"), f"recall-{tmp_path.name}"
    run = lambda: states.run_stateful(states.recall_stream(feeds.read_feed(spark, folder, schema), "user", "ts", "text", "number"), name)
    write = lambda some: spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
    for k in range(0, 150, 50):
        write(rows[k : k + 50])
    run()
    for k in range(150, len(rows), 80):
        write(rows[k : k + 80])
    run()
    late = ("a", START, 900, "much too late")
    write([late, ("z", START + timedelta(days=30), 901, None)])
    write([("z", START + timedelta(days=40), 902, None)])
    got = {r["number"]: r["recalled"] for r in run().collect()}
    assert got == by_hand([*rows, ("z", START + timedelta(days=30), 901, None)], 3, START + timedelta(days=39))
    assert len(set(got.values())) == 4 and got[301] == "null key"
    shared = states.shared_dir(spark)
    assert state_rows(spark, f"{shared}/{name}", "known") == 0  # all texts have run out
    assert state_rows(spark, f"{shared}/{name}", "waiting") == 1  # the newest row, which the watermark hasn't passed


def test_first_seen_state_has_one_row_for_each_key(spark, tmp_path):
    folder, name = str(tmp_path / "feed"), f"rows-{tmp_path.name}"
    for day in range(3):
        write_feed(spark, folder, [(f"u{k}", START + timedelta(days=3 - day, hours=k), 1.0) for k in range(40)])
        found = states.first_seen(feeds.read_feed(spark, folder, SCHEMA), "user", "ts", name)
    assert {r["user"]: r["first_seen"] for r in found.collect()} == {f"u{k}": START + timedelta(days=1, hours=k) for k in range(40)}
    assert state_rows(spark, f"{states.shared_dir(spark)}/{name}", "least") == 40


def test_changes_since_the_run_before(spark, tmp_path):
    rows = [("a", START, 1.0), ("b", START + timedelta(hours=1), 1.0), ("c", None, 1.0)]

    def since(x, fails=False):
        out, commit = feeds.changed_since(spark.createDataFrame(x, SCHEMA), "ts", f"since-{tmp_path.name}", "0 minutes")
        if not fails:
            found = sorted(r["user"] for r in out.collect())
            commit()
            return found

    since(rows, fails=True)  # a run that failed before it wrote anything
    assert since(rows) == ["a", "b", "c"]
    more = [*rows, ("d", START + timedelta(hours=2), 1.0)]
    since(more, fails=True)
    assert since(more) == ["c", "d"]
    assert since(rows) == ["c"]


def test_two_runs_from_one_mark(spark, tmp_path):
    feed = spark.createDataFrame([("a", START, 1.0)], SCHEMA)
    (_, one), (_, two) = (feeds.changed_since(feed, "ts", f"twice-{tmp_path.name}") for _ in range(2))
    one()
    with pytest.raises(sinks.VersionTaken):
        two()


def test_two_writers_lose_nothing(spark, tmp_path):
    """Each writer's rows are in the table, also where both started from one version."""
    folder = f"{storage.shared_dir(spark)}/writers-{tmp_path.name}"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    sinks.replace_by_key(rows((1, "a"), (2, "b")), folder, ["k"])
    calls = []

    def slow(old):
        calls.append(1)
        if len(calls) == 1:  # another writer comes in between
            sinks.replace_by_key(rows((2, "quick"), (3, "c")), folder, ["k"])
        new = rows((1, "slow"))
        return old.join(new.select("k"), "k", "left_anti").select("k", "v").unionByName(new)

    sinks.change(spark, folder, "k long, v string", slow)
    assert len(calls) == 2 and sinks.versions(spark, folder) == [1, 2, 3]
    assert sorted(map(tuple, sinks.read_newest(spark, folder, "k long, v string").collect())) == [(1, "slow"), (2, "quick"), (3, "c")]
    with pytest.raises(sinks.VersionTaken):
        sinks.write_version(rows((9, "z")), folder, 2)
    rows((7, "lost")).write.parquet(f"{folder}/rows-of-a-lost-writer")  # no claim: no version
    assert sinks.versions(spark, folder) == [1, 2, 3]


def test_writers_at_once(spark, tmp_path):
    folder = f"{storage.shared_dir(spark)}/threads-{tmp_path.name}"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: sinks.replace_by_key(spark.createDataFrame([(k, str(k))], "k long, v string"), folder, ["k"]), range(4)))
    assert sorted(r["k"] for r in sinks.read_newest(spark, folder, "k long, v string").collect()) == [0, 1, 2, 3]


def test_written_tables_can_be_released(spark):
    kept = storage.materialise(spark.range(3), "release-test")
    assert kept.count() == 3
    path = storage._WRITTEN[-1]
    before = storage._WRITTEN[:]
    storage._WRITTEN[:] = [path]
    storage.release(spark)
    storage._WRITTEN[:] = before[:-1]
    from pathlib import Path

    assert not Path(path.removeprefix("file:")).exists()
