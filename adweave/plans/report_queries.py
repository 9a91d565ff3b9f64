"""Queries over ledgers, rankings, score checks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adweave.operators import reports as R
from adweave.functions.storage import shared_dir
from adweave.operators import rules
from adweave.plans.adapters import COPIES, EVENTS, copies, events, table, utc
from adweave.plans.text_queries import NORMALISE
from adweave.streaming import feeds, states

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


@query("e4_unique_counts", f"WITH {COPIES} SELECT s AS source, count(*) AS only_here FROM (SELECT job_key, min(source) AS s FROM copies GROUP BY 1 HAVING min(source) = max(source)) GROUP BY 1")
def e4(spark, d):
    return R.unique_counts(copies(spark, d))


@query("e6_usage_by_step", f"WITH {EVENTS} SELECT source, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS calls FROM ledger GROUP BY 1, 2")
def e6(spark, d):
    return R.usage_by(events(spark, d), "source", "model")


PRICES = [("m0", 1.5, 6.0), ("m1", 0.25, 1.0), ("m2", 10.0, 30.0)]


@query("e7_estimate_cost", f"WITH {EVENTS}, prices AS (SELECT * FROM (VALUES ('m0', 1.5, 6.0), ('m1', 0.25, 1.0), ('m2', 10.0, 30.0)) v(model, i, o)) SELECT source, round(sum(coalesce(input_tokens / 1e6 * CAST(i AS DOUBLE) + output_tokens / 1e6 * CAST(o AS DOUBLE), 0.0)), 6) AS cost, bool_and(i IS NOT NULL) AS complete FROM ledger LEFT JOIN prices USING (model) GROUP BY 1")
def e7(spark, d):
    prices = spark.createDataFrame(PRICES, "model string, input_per_million double, output_per_million double")
    return R.estimate_cost(events(spark, d), prices, "source").withColumn("cost", F.round("cost", 6))


@query("e8_request_sums", f"WITH {EVENTS} SELECT source, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS requests FROM ledger GROUP BY 1, 2")
def e8(spark, d):
    return R.request_sums(events(spark, d)).select("source", F.unix_seconds("day").alias("day"), "requests")


@query("e9_share_of_month", f"WITH {EVENTS} SELECT source, CAST(least(greatest(25, least(60, CAST(floor(100000.0 / 14 / (count(*) / 14.0)) AS BIGINT))), count(*)) AS BIGINT) AS share FROM ledger GROUP BY 1")
def e9(spark, d):
    own = events(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return own.select("source", R.share_of_month(F.lit(100000.0), F.lit(14), F.col("n") / 14.0, F.col("n")).alias("share"))


@query("f7_admit", f"WITH {EVENTS} SELECT event_id, CAST(sum(input_tokens) OVER w AS BIGINT) AS so_far FROM ledger WINDOW w AS (PARTITION BY user_id, source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) QUALIFY so_far <= 30000")
def f7(spark, d):
    return R.admit(events(spark, d).withColumn("cost", F.col("input_tokens")), ["user_id", "source"], ["ts", "event_id"], 30000).select("event_id", "so_far")


RATED = "rated AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE CASE toxic WHEN 1 THEN 'poor' ELSE 'okay' END END AS rating, n_chars % 101 AS score FROM labels JOIN documents USING (doc_id))"


def _rated(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return j.select("doc_id", "source", F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "poor").otherwise("okay").alias("rating"), (F.col("n_chars") % 101).alias("score"))


@query("e11_score_check", f"WITH {RATED} SELECT rating, count(*) AS n, count(*) FILTER ((rating = 'good' AND score >= 70) OR (rating = 'okay' AND score BETWEEN 45 AND 85) OR (rating = 'poor' AND score <= 60)) AS in_band, min(score) AS least, median(score) AS middle, max(score) AS most FROM rated GROUP BY 1")
def e11(spark, d):
    return R.score_check(_rated(spark, d), {"good": (70, 100), "okay": (45, 85), "poor": (0, 60)})


@query(
    "f4_spread_by_score",
    """WITH b AS (SELECT source, doc_id, n_chars % 101 AS score, CASE WHEN n_chars % 101 <= 39 THEN 0 WHEN n_chars % 101 <= 59 THEN 1 WHEN n_chars % 101 <= 74 THEN 2 ELSE 3 END AS band FROM documents),
    i AS (SELECT *, row_number() OVER (PARTITION BY source, band ORDER BY doc_id) AS n FROM b)
    SELECT source, doc_id, CAST(band AS INTEGER) AS band FROM i QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n > 2 THEN 1 ELSE 0 END, doc_id) <= 8""",
)
def f4(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("ordinal"), (F.col("n_chars") % 101).alias("score"))
    return R.spread_by_score(rows, "source", 8).select("source", "doc_id", "band")


@query(
    "f2_cap_terms",
    """WITH t AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ordinal, p_name AS text, p_brand AS language, CASE WHEN l_returnflag = 'R' THEN 'field_or_skill' ELSE 'job_title' END AS kind FROM lineitem JOIN part ON p_partkey = l_partkey),
    f AS (SELECT language, kind, lower(text) AS l, min(ordinal) AS ordinal, arg_min(text, ordinal) AS text FROM t GROUP BY ALL)
    SELECT language, kind, ordinal, text, CAST(row_number() OVER (PARTITION BY language, kind ORDER BY ordinal) AS INTEGER) AS place FROM f QUALIFY place <= CASE kind WHEN 'job_title' THEN 16 ELSE 8 END""",
)
def f2(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    t = t.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("ordinal"), F.col("p_name").alias("text"), F.col("p_brand").alias("language"), F.when(F.col("l_returnflag") == "R", "field_or_skill").otherwise("job_title").alias("kind"))
    t = t.groupBy("ordinal", "text", "language", "kind").count().drop("count")
    return R.cap_terms(t, {"job_title": 16, "field_or_skill": 8})


@query("f6_batch_ids", "SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 40 AS INTEGER) AS batch FROM events")
def f6(spark, d):
    return R.batch_ids(table(spark, d, "events"), "user_id", ["event_id"], 40).select("event_id", "batch")


@query("f10_g1_cards", "SELECT o_orderkey AS job_key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P', CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 101 END DESC NULLS LAST, o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def f10(spark, d):
    cards = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_key"), "o_custkey", F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice") % 101).alias("score"), F.col("o_orderdate").alias("posted_at"))
    return R.rank_cards(cards, "o_custkey").select("job_key", "place")


@query("g3_scoring_cap", "SELECT o_custkey, greatest(count(*) - 5, 0) AS cut FROM orders GROUP BY 1")
def g3(spark, d):
    cards = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_key"), "o_custkey", F.lit(1).alias("score"), F.col("o_orderdate").alias("posted_at"))
    return R.top_scored(cards, "o_custkey", 5)[1]


@query("i9_reposted", "SELECT l_orderkey AS job_key, min(l_shipdate) < max(o_orderdate) - INTERVAL 1 DAY AS reposted FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def i9(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_key")).agg(F.min(utc("l_shipdate")).alias("first_seen"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_key"), utc("o_orderdate").alias("posted"))
    return i.join(o, "job_key").select("job_key", R.reposted(F.col("first_seen"), F.col("posted")).alias("reposted"))


@query("e21_feed_health", "SELECT source, count(*) AS n, CASE WHEN count(*) >= 50 AND min(doc_id) > 5 THEN 'partial' ELSE 'complete' END AS status FROM documents GROUP BY 1")
def e21(spark, d):
    a = table(spark, d, "documents").select("source", F.timestamp_seconds(F.col("doc_id") * 3600).alias("posted_at"))
    return R.feed_health(a, F.timestamp_seconds(F.lit(5 * 3600)), 50).select("source", "n", "status")


@query(
    "e13_coverage",
    "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'found' WHEN o_orderkey % 5 = 0 THEN 'place rule' WHEN o_orderkey % 7 = 0 THEN 'unrelated' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'unscored' WHEN o_orderstatus = 'F' THEN 'not shown' ELSE 'never collected' END AS stage, count(*) AS n FROM orders GROUP BY 1",
)
def e13(spark, d):
    k = F.col("o_orderkey")
    w = table(spark, d, "orders").select((k % 3 == 0).alias("found"), (k % 5 == 0).alias("place_rule"), (k % 7 == 0).alias("unrelated"), (F.col("o_orderstatus") == "F").alias("collected"), F.when(k % 2 == 1, F.lit(60)).alias("score"))
    return R.coverage(w)


NORMAL_WORDS = f"list_distinct(list_filter(string_split({NORMALISE.format('text')}, ' '), lambda x: x <> ''))"


@query(
    "e16_unmatched_names",
    f"""WITH n AS (SELECT lang, {NORMAL_WORDS} AS w FROM documents), t AS (SELECT {NORMAL_WORDS} AS t FROM benchmark)
    SELECT lang, count(*) AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE len(t) > 0 AND list_has_all(w, t)) GROUP BY 1""",
)
def e16(spark, d):
    """A term matches by all its words, anywhere in a text."""
    terms = table(spark, d, "benchmark").select(F.col("text").alias("term"))
    return rules.unmatched_names(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("name")), terms)


def _feed(spark, d):
    schema = table(spark, d, "events").schema.simpleString()[7:-1].replace(":", " ")
    return feeds.read_feed(spark, d, schema, pattern="events.parquet").withColumn("ts", utc("ts"))


@query("k1_stream_dedup", "SELECT user_id, event_type, count(DISTINCT CAST(floor(value * 100) AS BIGINT)) AS n FROM events GROUP BY 1, 2")
def k1(spark, d):
    feed = _feed(spark, d).withColumn("v", F.floor(F.col("value") * 100))
    rows = feeds.run_available(feeds.first_of_each(feed, ["user_id", "event_type", "v"], "ts", "40 days").select("user_id", "event_type", "v"), f"k1-{uuid.uuid4().hex}")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("k2_stream_first_seen", "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_seen FROM events GROUP BY 1")
def k2(spark, d):
    return states.first_seen(_feed(spark, d), "user_id", "ts", f"k2-{uuid.uuid4().hex}").select("user_id", F.unix_micros("first_seen").alias("first_seen"))


@query("k3_stream_daily", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def k3(spark, d):
    counts = feeds.daily_counts(_feed(spark, d), "event_type", "ts", "value")
    rows = feeds.run_available(counts, f"k3-{uuid.uuid4().hex}", "append")
    # the last days stay open until the watermark passes: the batch form closes them
    return _closed(spark, d, rows)


def _closed(spark, d, rows):
    """``rows`` and the days that the watermark hasn't passed; nothing else is added."""
    e = table(spark, d, "events").withColumn("ts", utc("ts")).withColumn("day", F.date_trunc("day", "ts"))
    last = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("mark"))
    still = e.join(last).where(F.col("day") + F.expr("INTERVAL 1 DAY") > F.col("mark"))
    rest = still.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).join(rows.select("day", "event_type"), ["day", "event_type"], "left_anti")
    return rows.unionByName(rest).select(F.unix_seconds("day").alias("day"), "event_type", "n", "total")


@query("k5_expire", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-28'")
def k5(spark, d):
    from adweave.operators.memory import expire

    return expire(table(spark, d, "events").withColumn("at", utc("ts")), "at", F.to_timestamp(F.lit("2024-01-31")), 3).select("event_id")


@query(
    "k5_recall_stream",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS moment, CASE WHEN event_type = 'purchase' THEN printf('%.2f', value) END AS text FROM events),
    w AS (SELECT *, last_value(CASE WHEN text IS NOT NULL THEN moment END IGNORE NULLS) OVER o AS since, last_value(text IGNORE NULLS) OVER o AS last
          FROM e WINDOW o AS (PARTITION BY user_id ORDER BY moment, event_id, text ROWS UNBOUNDED PRECEDING))
    SELECT event_id, moment AS at, CASE WHEN moment - since <= 259200000000 THEN last END AS recalled FROM w
    WHERE text IS NULL AND moment < (SELECT epoch_us(date_trunc('day', max(ts) - INTERVAL 1 DAY)) FROM events)""",
)
def k5_recall(spark, d):
    """The events as a feed that comes in three parts, each read by a run of its own: what a user bought last is recalled for three days."""
    folder, name = f"{shared_dir(spark)}/k5-{uuid.uuid4().hex}", f"k5-{uuid.uuid4().hex}"
    e = table(spark, d, "events").withColumn("ts", utc("ts")).withColumn("text", F.when(F.col("event_type") == "purchase", F.format_string("%.2f", "value")))
    schema = "user_id bigint, event_id bigint, ts timestamp, text string"
    parts = [e.where("ts < '2024-01-11'"), e.where("ts >= '2024-01-11' AND ts < '2024-01-21'"), e.where("ts >= '2024-01-21'")]
    run = lambda: states.run_stateful(states.recall_stream(feeds.read_feed(spark, folder, schema, 1_000_000), "user_id", "ts", "text", "event_id"), name)
    for part in parts:
        part.select("user_id", "event_id", "ts", "text").write.mode("append").parquet(folder)
        out = run()
    return out.join(e.agg(F.unix_micros(F.date_trunc("day", F.max("ts") - F.expr("INTERVAL 1 DAY"))).alias("mark")), F.col("at") < F.col("mark")).drop("mark")
