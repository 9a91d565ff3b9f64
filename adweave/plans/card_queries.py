"""Queries over cards, conditions, reports and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adweave.functions.sinks import keep_latest, replace_by_key
from adweave.functions.storage import materialise, shared_dir
from adweave.operators import cards as K
from adweave.operators import conditions as C
from adweave.plans.adapters import EVENTS, POINTS, TOWNS, by_key, by_key_sql, events, km_sql, points, reach_sql, table, towns, utc
from adweave.plans.adapters import MODES, TYPES
from adweave.plans.place_queries import regions
from adweave.sources.normalise import load_employers

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


def customer_name(key):
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


NAME = "'Customer#' || lpad(CAST({} AS VARCHAR), 9, '0')"
#: What an order says about its place: a town, a country's or a wider region's name, or both.
PLACE = f"CASE o_orderkey % 4 WHEN 0 THEN {NAME.format('o_custkey')} WHEN 1 THEN 'Northland' WHEN 2 THEN {NAME.format('o_custkey')} || ', Northland' ELSE 'Elsewhere' END"


@query(
    "b8_town_part",
    f"""SELECT o_orderkey AS job_key, CASE o_orderkey % 4 WHEN 1 THEN '' WHEN 3 THEN 'elsewhere' ELSE 'customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS town_part FROM orders""",
)
def b8(spark, d):
    k, name = F.col("o_orderkey") % 4, customer_name(F.col("o_custkey"))
    text = F.when(k == 0, name).when(k == 1, "Northland").when(k == 2, F.concat(name, F.lit(", Northland"))).otherwise("Elsewhere")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_key"), text.alias("location"), F.concat(F.lit("N"), (F.col("o_orderkey") % 3).cast("string")).alias("country"))
    wide = spark.createDataFrame([("Northland", "N1")], "name string, code string")
    return K.town_parts(rows, towns(spark, d), regions(spark), wide).select("job_key", "town_part")


@query(
    "b28_readable_place",
    f"""WITH {TOWNS}, {POINTS}, k AS (SELECT point_id, town_id, people, {km_sql('points', 'towns')} AS km FROM points JOIN towns USING (country)),
    i AS (SELECT point_id, arg_max(town_id, (people, -town_id)) AS town_id FROM k WHERE km <= {reach_sql('people')} GROUP BY 1), n AS (SELECT point_id, arg_min(town_id, (km, town_id)) AS town_id FROM k GROUP BY 1),
    t AS (SELECT n.point_id, coalesce(i.town_id, n.town_id) AS town_id FROM n LEFT JOIN i USING (point_id)), f AS (SELECT point_id, min(point_id) OVER (PARTITION BY point_id % 100, country) AS first FROM points)
    SELECT f.point_id, 'CB' || CAST(f.point_id % 100 AS VARCHAR) || ' ' || CAST(f.point_id // 100 % 10 AS VARCHAR) || 'QR, near ' || {NAME.format('town_id')} AS place FROM f JOIN t ON t.point_id = first""",
)
def b28(spark, d):
    """Postcodes of the points: a code is where the first point that has it is."""
    p, k = points(spark, d), F.col("point_id")
    code = F.concat(F.lit("CB"), (k % 100).cast("string"))
    rows = p.select("point_id", F.concat(code, F.lit(" "), F.floor(k / 100 % 10).cast("string"), F.lit("QR")).alias("location"), "country")
    known = p.groupBy(code.alias("code"), "country").agg(F.min_by(F.struct("latitude", "longitude"), "point_id").alias("at")).select("code", "country", "at.*")
    return K.readable_places(rows, towns(spark, d), known).select("point_id", "place")


@query(
    "b41_checked_by",
    f"""WITH c AS (SELECT l_orderkey AS job_key, l_linenumber AS line, l_partkey AS p, l_quantity AS q, {by_key_sql('l_partkey', ['near', 'town_size', 'towns_that_fit'])} AS kind, {by_key_sql('l_suppkey', ['applied', 'estimate'])} AS status, l_partkey % 5 = 0 AS edited,
      CASE l_suppkey % 7 WHEN 0 THEN 'estimate' WHEN 1 THEN 'route' END AS m FROM lineitem)
    SELECT who, count(*) AS n FROM (SELECT CASE WHEN m = 'estimate' THEN 'estimate' WHEN m = 'route' THEN 'route service' WHEN edited THEN 'edited' WHEN status = 'estimate' AND m IS NULL THEN 'estimate' WHEN kind IN ('near', 'town_size') THEN 'worked out' ELSE 'looked up' END AS who FROM c) GROUP BY 1""",
)
def b41(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    who = K.checked_by(by_key(p, ["near", "town_size", "towns_that_fit"]), by_key(s, ["applied", "estimate"]), p % 5 == 0, F.when(s % 7 == 0, "estimate").when(s % 7 == 1, "route"))
    return table(spark, d, "lineitem").groupBy(who.alias("who")).agg(F.count("*").alias("n"))


@query(
    "d13_home_town",
    f"""WITH {TOWNS}, {POINTS}, p AS (SELECT *, {NAME.format('point_id')} AS town FROM points), k AS (SELECT point_id, town_id, name = town AND km <= 30 AS same, km <= greatest(3.0, {reach_sql('people')}) AS inside, km
      FROM (SELECT p.point_id, p.town, t.town_id, t.name, t.people, {km_sql('p', 't')} AS km FROM p JOIN towns t USING (country)))
    SELECT point_id, coalesce(min(town_id) FILTER (same), arg_min(town_id, (km, town_id)) FILTER (inside)) AS town_id FROM k WHERE same OR inside GROUP BY 1""",
)
def d13(spark, d):
    return K.home_towns(points(spark, d).withColumn("town", customer_name(F.col("point_id"))), towns(spark, d))


@query("e13_loss_stages")
def e13_stages(spark, d):
    """Documents as jobs: what became of each one whose id has a letter less in its company's name on the list."""
    from adweave.operators.coverage import loss_stages

    k, w = F.col("doc_id"), F.split("text", " ", 10)  # the rest of a text stays one piece
    words = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    jobs = table(spark, d, "documents").select(k.alias("id"), words(2, 3).alias("company"), words(6, 3).alias("title"), F.col("lang").alias("language"), F.concat(F.lit("N"), (k % 3).cast("string")).alias("country"))
    jobs = materialise(jobs, "coverage-jobs")  # so the texts are read once
    near = jobs.withColumn("company", F.concat(F.substring("company", 1, 4), F.substring("company", 6, 200)))
    wanted = near.select(F.col("id").alias("wanted_id"), "company", "title", F.when(F.col("id") % 7 == 0, F.lit("Elsewhere")).alias("place"), F.lit(None).cast("string").alias("url"), "country")
    cards = jobs.select(F.col("id").alias("card_id"), "company", "title", F.lit(None).cast("string").alias("location"), "country", F.array().cast("array<string>").alias("urls"), (F.col("id") % 11 == 0).alias("unrelated"), F.when(F.col("id") % 2 == 0, F.lit(50)).alias("score"))
    part = lambda n: cards.where(F.pmod(F.xxhash64("card_id"), F.lit(4)) == n)
    terms = jobs.where("id % 3 > 0").select(F.element_at(F.split("title", " "), 1).alias("text"), "language", F.lit("job_title").alias("kind")).where("text <> ''")
    places = spark.sql("SELECT 'N1' AS country, 'Northland' AS name, 'region' AS kind, CAST(NULL AS BIGINT) AS town_id, CAST(NULL AS DOUBLE) AS radius_km")
    firms = jobs.where("id % 5 = 0").select("company").unionByName(near.where("id % 10 = 3").select("company"))
    stages = loss_stages(wanted, part(0), part(1), part(2), terms, places, firms, towns(spark, d), regions(spark))
    return stages.groupBy("stage").agg(F.count("*").alias("n"))


@query("d22_coverage_match")
def d22(spark, d):
    """Orders as cards, passages of two customers' names as wanted jobs."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("o_custkey"))
    cards = o.select(k.alias("card_id"), F.col("s_name").alias("company"), F.concat_ws(" ", "o_orderpriority", F.lit("clerk")).alias("title"), customer_name(F.col("o_custkey")).alias("location"), F.concat(F.lit("N"), (k % 3).cast("string")).alias("country"), F.array(F.concat(F.lit("https://jobs.example.org/"), k.cast("string"))).alias("urls"))
    s = F.col("s_suppkey")
    asked = table(spark, d, "supplier").select(
        s.alias("wanted_id"), F.concat(F.lit("Other / "), "s_name").alias("company"), F.concat_ws(" ", F.lit("clerk"), by_key(s, ["1-URGENT", "2-HIGH", "9-UNKNOWN"])).alias("title"), customer_name(s).alias("place"),
        F.when(s % 5 == 0, F.concat(F.lit("https://jobs.example.org/"), (s * 4).cast("string"))).alias("url"), F.concat(F.lit("N"), (s % 3).cast("string")).alias("country"),
    )
    return K.coverage_match(asked, cards, towns(spark, d), regions(spark))


@query(
    "e20_usage_report",
    f"""WITH {EVENTS}, s AS (SELECT max(user_id) AS last FROM ledger), r AS (SELECT 'this month' AS scope, model, input_tokens, output_tokens FROM ledger WHERE date_trunc('month', ts) = TIMESTAMP '2024-01-01' UNION ALL SELECT 'last search', model, input_tokens, output_tokens FROM ledger, s WHERE user_id = last)
    SELECT scope, model, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, round(sum(CASE WHEN model = 'm3' THEN 0.0 ELSE input_tokens / 1e6 * 2.5 + output_tokens / 1e6 * 8.0 END), 2) AS cost, bool_and(model <> 'm3') AS complete FROM r GROUP BY GROUPING SETS ((scope, model), (scope))""",
)
def e20(spark, d):
    used = events(spark, d).withColumnRenamed("user_id", "search_id")
    prices = used.select("model").where("model <> 'm3'").distinct().select("model", F.lit(2.5).alias("input_per_million"), F.lit(8.0).alias("output_per_million"))
    return K.usage_report(used, prices, F.to_timestamp(F.lit("2024-01-20 12:00:00")))


@query("e20_requests", "SELECT event_type AS source, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-20') AS today, count(*) FILTER (date_trunc('month', ts) = TIMESTAMP '2024-01-01') AS this_month FROM events GROUP BY 1")
def e20_requests(spark, d):
    return K.request_report(events(spark, d), F.to_timestamp(F.lit("2024-01-20 12:00:00")))


@query("g5_marked", "SELECT o_orderkey AS job_id, o_orderpriority AS title, o_custkey % 3 = 0 AS saved, o_custkey % 4 = 0 AS applied, o_custkey % 5 = 0 AS dismissed FROM orders WHERE o_custkey % 3 = 0")
def g5(spark, d):
    o, c = table(spark, d, "orders"), F.col("o_custkey")
    states = o.select(F.col("o_orderkey").alias("job_id"), (c % 3 == 0).alias("saved"), (c % 4 == 0).alias("applied"), (c % 5 == 0).alias("dismissed"), utc("o_orderdate").alias("updated_at"))
    return K.marked(o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title"), F.lit(True).alias("dismissed")), states, "saved").drop("updated_at")


@query("g6_latest", "SELECT o_custkey AS search_id, o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def g6(spark, d):
    return K.latest(table(spark, d, "orders").select(F.col("o_custkey").alias("search_id"), "o_orderkey"))


@query("g6_to_rate", "SELECT doc_id AS id, lang AS kind, quality AS rating FROM documents LEFT JOIN labels USING (doc_id)")
def g6_to_rate(spark, d):
    return K.to_rate(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("quality").alias("rating")))


@query("a31_load_employers", "SELECT s_name AS name, 'workday' AS system, CAST(s_suppkey AS VARCHAR) AS board, CASE WHEN s_suppkey % 2 = 0 THEN 'N' || CAST(s_nationkey AS VARCHAR) ELSE '' END AS countries, s_suppkey % 3 = 0 AS elsewhere, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS n_towns FROM supplier")
def a31(spark, d):
    k, c = F.col("s_suppkey"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    entry = F.struct(
        F.col("s_name").alias("name"), F.lit("workday").alias("system"), k.cast("string").alias("board"), F.when(k % 2 == 0, F.array(c)).alias("countries"), F.when(k % 3 == 0, True).alias("elsewhere"),
        F.when(k % 5 == 0, F.create_map(c, F.array(F.lit("Town")))).alias("towns"),
    )
    e = load_employers(table(spark, d, "supplier").select(F.to_json(entry, {"ignoreNullFields": "true"}).alias("value")))
    return e.select("name", "system", "board", F.array_join("countries", ",").alias("countries"), "elsewhere", F.size("towns").alias("n_towns"))


@query("a34_replace_by_key", "SELECT user_id, arg_max(event_id, (event_type = 'view', ts, event_id)) AS event_id FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def a34(spark, d):
    """The errors of all users, then their views: a view replaces what the user had."""
    e, folder = table(spark, d, "events"), f"{shared_dir(spark)}/a34-{uuid.uuid4().hex}"
    newest = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    replace_by_key(newest("error"), folder, ["user_id"])
    return replace_by_key(newest("view"), folder, ["user_id"])


@query("a34_keep_latest", "SELECT o_custkey AS search_id, o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def a34_latest(spark, d):
    o, folder = table(spark, d, "orders").select(F.col("o_custkey").alias("search_id"), "o_orderkey"), f"{shared_dir(spark)}/a34-{uuid.uuid4().hex}"
    keep_latest(o, folder, "search_id")
    return keep_latest(o, folder, "search_id")


@query(
    "i13_sample_for_quality",
    """WITH b AS (SELECT lang AS search_id, source, md5(text) AS source_job_id, doc_id AS ordinal, n_chars % 101 AS score, CASE WHEN n_chars % 101 <= 39 THEN 0 WHEN n_chars % 101 <= 59 THEN 1 WHEN n_chars % 101 <= 74 THEN 2 ELSE 3 END AS band FROM documents WHERE n_chars >= 500),
    i AS (SELECT *, row_number() OVER (PARTITION BY search_id, band ORDER BY ordinal) AS n FROM b), c AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY CASE WHEN n > 2 THEN 1 ELSE 0 END, ordinal) <= 8),
    have AS (SELECT DISTINCT source, md5(text) AS source_job_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
    f AS (SELECT * FROM c WHERE (source, source_job_id) NOT IN (SELECT source, source_job_id FROM have) QUALIFY row_number() OVER (PARTITION BY source, source_job_id ORDER BY search_id, band, ordinal) = 1)
    SELECT search_id, ordinal, score FROM f QUALIFY row_number() OVER (ORDER BY search_id, band, ordinal) <= greatest(0, (SELECT 30 + count(*) FROM labels) - (SELECT count(*) FROM have))""",
)
def i13(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    keyed = docs.select("doc_id", F.col("lang").alias("search_id"), "source", F.md5("text").alias("source_job_id"), F.col("doc_id").alias("ordinal"), (F.col("n_chars") % 101).alias("score"), (F.col("n_chars") >= 500).alias("complete"))
    have = keyed.join(labels.where("toxic = 1").select("doc_id"), "doc_id").select("source", "source_job_id")
    return K.sample_for_quality(keyed.drop("doc_id"), have, wanted=30 + labels.count()).select("search_id", "ordinal", "score")


@query(
    "i14_decide",
    """WITH c AS (SELECT l_orderkey AS job_key, bool_or(l_partkey % 40 = 0) AS no, min(l_quantity) AS minutes FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS job_key, CASE WHEN c.no THEN 'condition' WHEN o_custkey % 7 = 0 THEN 'unrelated' WHEN minutes > 20 THEN 'too_far' WHEN o_orderstatus = 'P' THEN 'late' END AS left_out FROM orders LEFT JOIN c ON job_key = o_orderkey""",
)
def i14(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_key"), "o_custkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_key"), "l_partkey", "l_quantity")
    stages = [
        ("condition", lambda left: left.join(lines.where("l_partkey % 40 = 0"), "job_key", "left_semi")),
        ("unrelated", lambda left: left.where("o_custkey % 7 = 0")),
        ("too_far", lambda left: C.near_minutes(left, lines.join(left, "job_key", "left_semi").withColumnRenamed("l_quantity", "minutes"), 20).where("answer = 'no'")),
        ("late", lambda left: left.where("o_orderstatus = 'P'")),
    ]
    return K.decide(jobs, stages).select("job_key", "left_out")


LINE_ORDER = "(l_linenumber * 100000 + l_partkey) * 1000 + CAST(l_quantity AS BIGINT)"


@query(
    "i9_build_cards",
    f"""WITH c AS (SELECT l_orderkey AS job_key, {LINE_ORDER} AS ordinal, 's' || CAST(l_suppkey % 7 AS VARCHAR) AS source, CASE WHEN l_partkey % 6 > 0 THEN 'u' || CAST(l_partkey AS VARCHAR) END AS url, CASE WHEN l_partkey % 9 = 0 THEN 'e' || CAST(l_partkey AS VARCHAR) END AS eu, l_suppkey % 2 = 0 AS agency,
      CASE WHEN l_suppkey % 4 > 0 THEN 'C' || CAST(l_suppkey % 5 AS VARCHAR) END AS country, nullif({by_key_sql('l_partkey', MODES)}, '') AS mode, nullif({by_key_sql('l_partkey', TYPES)}, '') AS kind FROM lineitem),
    f AS (SELECT job_key, arg_min(eu, ordinal) FILTER (eu IS NOT NULL AND NOT agency) AS eu, arg_min(country, ordinal) FILTER (country IS NOT NULL) AS cc, arg_min(mode, ordinal) FILTER (mode IS NOT NULL) AS mode, coalesce(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), []) AS kinds FROM c GROUP BY 1),
    j AS (SELECT o_orderkey AS job_key, o_custkey, o_orderdate, eu, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 'C' || CAST(o_orderkey % 5 AS VARCHAR) END, cc) AS country, 's' || CAST(o_orderkey % 7 AS VARCHAR) AS own, coalesce(eu, 'u' || CAST(o_orderkey % 200 AS VARCHAR)) AS main_url, mode, coalesce(kinds, []) AS kinds,
      o_orderkey % 4 > 0 AS known, o_orderkey % 17 = 0 AS ruled, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS a1, CASE o_orderkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'unknown' END AS a2, {by_key_sql('o_orderkey', TYPES)} AS read FROM orders LEFT JOIN f ON f.job_key = o_orderkey),
    o AS (SELECT c.job_key, source, min(ordinal) AS n, arg_min(url, ordinal) AS url FROM c JOIN j USING (job_key) WHERE url IS NOT NULL AND url <> main_url AND (j.eu IS NOT NULL OR source <> own) GROUP BY ALL),
    l AS (SELECT job_key, string_agg(source || ' ' || url, ',' ORDER BY n, source) AS also_on FROM o GROUP BY 1),
    k AS (SELECT *, CASE WHEN nullif(read, '') IS NOT NULL AND (len(kinds) = 0 OR (len(kinds) > 1 AND list_contains(kinds, read))) THEN [read] ELSE kinds END AS types FROM j)
    SELECT job_key, country, mode AS work_mode, array_to_string(types, ',') AS types, len(types) > 0 AND types <> kinds AS types_from_text, CASE WHEN eu IS NULL THEN own ELSE 'employer' END AS main_source, main_url, coalesce(also_on, '') AS also_on,
      o_custkey % 4 = 0 AS seen_before, array_to_string(list_filter([CASE WHEN ruled THEN NULL WHEN country IN ('C1', 'C2') THEN 'In ' || country || ' verified' WHEN country IS NULL THEN 'Location unclear unclear' END,
        CASE WHEN a1 = 'unknown' AND NOT known OR (ruled AND a1 <> 'no') THEN NULL ELSE 'one ' || CASE a1 WHEN 'yes' THEN 'verified' WHEN 'no' THEN 'fails' ELSE 'unclear' END END,
        CASE WHEN a2 = 'unknown' AND NOT known OR (ruled AND a2 <> 'no') THEN NULL ELSE 'two ' || CASE a2 WHEN 'yes' THEN 'verified' WHEN 'no' THEN 'fails' ELSE 'unclear' END END,
        CASE WHEN NOT ruled AND NOT known AND (a1 = 'unknown' OR a2 = 'unknown') THEN 'Town unknown, conditions not checked: ' || CAST(CAST(a1 = 'unknown' AS INTEGER) + CAST(a2 = 'unknown' AS INTEGER) AS VARCHAR) || ' unclear' END], lambda x: x IS NOT NULL), ';') AS checks FROM k LEFT JOIN l USING (job_key)""",
)
def i9(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    null = lambda kind: F.lit(None).cast(kind)
    jobs = o.select(
        k.alias("job_key"), F.col("o_orderpriority").alias("title"), F.lit("Acme").alias("company"), F.concat(F.lit("s"), (k % 7).cast("string")).alias("source"), F.concat(F.lit("u"), (k % 200).cast("string")).alias("url"),
        F.lit("Town").alias("place"), null("string").alias("found_place"), F.when(k % 3 > 0, F.concat(F.lit("C"), (k % 5).cast("string"))).alias("country"), utc("o_orderdate").alias("posted_at"), F.lit("exact").alias("date_precision"),
        null("timestamp").alias("closes_at"), F.lit(True).alias("complete"), null("string").alias("salary_text"), (k % 4 > 0).alias("town_known"), (k % 17 == 0).alias("ruled_out"),
    )
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kind, mode = by_key(p, TYPES), by_key(p, MODES)
    copies = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_key"), F.expr("(l_linenumber * 100000 + l_partkey) * 1000 + CAST(l_quantity AS BIGINT)").alias("ordinal"), F.concat(F.lit("s"), (s % 7).cast("string")).alias("source"), F.when(p % 6 > 0, F.concat(F.lit("u"), p.cast("string"))).alias("url"),
        F.when(p % 9 == 0, F.concat(F.lit("e"), p.cast("string"))).alias("employer_url"), F.when(s % 2 == 0, "Acme Staffing").otherwise("Acme").alias("company"), F.when(s % 4 > 0, F.concat(F.lit("C"), (s % 5).cast("string"))).alias("country"),
        F.when(mode != "", mode).alias("work_mode"), F.when(kind != "", F.array(kind)).alias("job_types"),
    )
    asked = F.array(F.struct(F.lit(1).alias("condition_id"), F.lit("one").alias("label"), by_key(k, ["yes", "no", "unknown"]).alias("answer")), F.struct(F.lit(2).alias("condition_id"), F.lit("two").alias("label"), by_key(k, ["no", "yes", "unknown", "unknown", "unknown"]).alias("answer")))
    answers = o.select(k.alias("job_key"), F.explode(asked).alias("x")).select("job_key", "x.*", F.lit("looked up").alias("checked_by"), null("string").alias("detail"))
    scores = o.select(k.alias("job_key"), F.lit(50).alias("score"), F.nullif(by_key(k, TYPES), F.lit("")).alias("read_type"), null("string").alias("read_mode"))
    days = F.when(F.col("o_custkey") % 4 == 0, 3).otherwise(0)
    memory = o.select(k.alias("job_key"), F.lit(False).alias("is_new"), F.lit(False).alias("saved"), F.lit(False).alias("applied"), F.lit(False).alias("dismissed"), (utc("o_orderdate") - F.make_dt_interval(days)).alias("first_seen_at"))
    out = K.build_cards(jobs, copies, answers, scores, memory, ("C1", "C2"), F.to_timestamp(F.lit("1995-01-01")))
    return out.select(
        "job_key", "country", "work_mode", F.array_join("job_types", ",").alias("types"), "types_from_text", "main_source", "main_url", F.array_join(F.transform("also_on", lambda x: F.concat_ws(" ", x["source"], x["url"])), ",").alias("also_on"),
        F.col("first_seen_at").isNotNull().alias("seen_before"), F.array_join(F.transform("location_checks", lambda x: F.concat_ws(" ", x["label"], x["status"])), ";").alias("checks"),
    )


KINDS = ["towns_that_fit", "towns_to_avoid", "town_size", "countries_that_fit", "town_size"]


@query(
    "i6_canonical_conditions",
    f"""WITH c AS (SELECT c_custkey AS k, c_name, 'N' || CAST(c_nationkey % 3 AS VARCHAR) AS country, {by_key_sql('c_custkey', KINDS)} AS kind0, c_nationkey % 3 < 2 AS here FROM customer),
    f AS (SELECT *, here AND k % 2 = 0 AS t, here AND k % 7 < 3 AS r, here AND k % 7 = 6 AS u FROM c),
    g AS (SELECT *, CASE WHEN kind0 IN ('towns_that_fit', 'towns_to_avoid') AND NOT t AND NOT r THEN 'could_not_check' WHEN kind0 = 'town_size' AND k % 3 = 0 THEN 'could_not_check' WHEN kind0 = 'countries_that_fit' AND k % 11 = 0 THEN 'could_not_check' ELSE kind0 END AS kind FROM f)
    SELECT k AS condition_id, kind, CASE WHEN kind = 'could_not_check' THEN 'not_checked' WHEN k % 4 = 0 THEN 'applied' ELSE 'estimate' END AS status, CASE WHEN t THEN c_name ELSE '' END AS towns,
      CASE WHEN kind IN ('towns_that_fit', 'towns_to_avoid') AND r THEN 'R' || CAST(k % 7 AS VARCHAR) ELSE '' END AS regions, CASE WHEN kind = 'countries_that_fit' AND here THEN country ELSE '' END AS countries, CASE WHEN u THEN 'Atlantis' ELSE '' END AS unknown FROM g""",
)
def i6(spark, d):
    """Regions come as regions or, for keys with rest 2, as towns; only countries N0 and N1 are searched."""
    k, country = F.col("c_custkey"), F.concat(F.lit("N"), (F.col("c_nationkey") % 3).cast("string"))
    one = lambda name: F.struct(name.alias("name"), country.alias("country"))
    state = F.concat(F.lit("State "), (k % 7).cast("string"))
    kept = lambda *pairs: F.filter(F.array(*(F.when(c, one(n)) for c, n in pairs)), lambda x: x.isNotNull())
    answers = table(spark, d, "customer").select(
        k.alias("condition_id"), F.lit("text").alias("text"), F.lit(None).cast("string").alias("understood_as"), by_key(k, KINDS).alias("kind"), F.when(k % 4 == 0, "checked").otherwise("likely").alias("confidence"), F.array(F.lit("N0"), F.lit("N1")).alias("searched"),
        F.when(k % 11 > 0, F.array(country)).alias("countries"), kept((k % 2 == 0, F.col("c_name")), (k % 7 == 2, state)).alias("towns"), kept((k % 7 < 2, state), (k % 7 == 6, F.lit("Atlantis"))).alias("regions"),
        F.lit(None).cast("array<struct<name:string,country:string>>").alias("exceptions"), F.when(k % 3 > 0, 5000).alias("min_people"), F.lit(None).cast("double").alias("share"), F.lit("").alias("note"),
    )
    out = C.canonical_conditions(answers, towns(spark, d), regions(spark))
    return out.select("condition_id", "kind", "status", F.array_join("towns.name", ",").alias("towns"), F.array_join("regions", ",").alias("regions"), F.array_join("countries", ",").alias("countries"), F.array_join("unknown_regions", ",").alias("unknown"))


FOUND = ["towns_that_fit", "towns_to_avoid", "town_size", "countries_that_fit", "countries_to_avoid", "could_not_check"]


@query(
    "i7_near_conditions",
    f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS looked, {by_key_sql('c_custkey // 2', FOUND)} AS f, CASE WHEN c_custkey % 5 = 0 THEN 9000 END AS asked, c_custkey % 7 = 0 AS named, c_custkey % 3 = 0 AS timed FROM customer),
    s AS (SELECT *, CASE WHEN looked AND f = 'town_size' THEN 7000 ELSE asked END AS least FROM c), t AS (SELECT *, least IS NOT NULL OR named AS sized, looked AND f IN ('towns_to_avoid', 'countries_that_fit', 'countries_to_avoid') AS rules_out FROM s),
    u AS (SELECT *, sized OR rules_out OR (looked AND f = 'towns_that_fit') AS usable FROM t)
    SELECT k AS condition_id, CASE WHEN usable THEN 'near' ELSE 'could_not_check' END AS kind, CASE WHEN NOT usable THEN 'not_checked' WHEN timed THEN 'estimate' ELSE 'applied' END AS status, CAST(CASE WHEN usable THEN CASE WHEN rules_out AND NOT sized THEN 20000 ELSE least END END AS BIGINT) AS min_people,
      CASE WHEN looked AND f = 'towns_that_fit' THEN 1 ELSE 0 END AS n_towns, CASE WHEN looked AND f = 'towns_to_avoid' THEN 1 ELSE 0 END AS n_avoided, usable AND looked AND f = 'could_not_check' AS fact_unused, CASE WHEN usable AND timed THEN 'transit' END AS travel_mode FROM u""",
)
def i7(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    kind = by_key(F.floor(k / 2), FOUND)
    asked = c.select(
        k.alias("condition_id"), F.lit("text").alias("text"), F.lit("").alias("understood_as"), F.when(k % 5 == 0, 9000).alias("min_people"), F.lit(None).cast("double").alias("share"), F.when(k % 7 == 0, F.array(k)).alias("named"),
        F.when(k % 2 == 0, "university towns").alias("look_up"), F.when(k % 3 == 0, 30).alias("max_minutes"), F.lit(15).alias("max_km"), F.lit(None).cast("string").alias("travel_mode"),
    )
    found = c.where("c_custkey % 2 = 0").select(
        k.alias("condition_id"), kind.alias("kind"), F.when(kind == "town_size", 7000).alias("min_people"), F.lit(None).cast("double").alias("share"), F.when(kind.startswith("towns_"), F.array(k)).alias("towns"),
        F.lit(None).cast("array<string>").alias("regions"), F.when(kind.startswith("countries_"), F.array(F.lit("N1"))).alias("countries"),
    )
    return C.near_conditions(asked, found).select("condition_id", "kind", "status", "min_people", F.size("towns").alias("n_towns"), F.size("avoided").alias("n_avoided"), "fact_unused", "travel_mode")
