"""What is remembered between searches: jobs, states, ad texts.

Memory tables are plain DataFrames: each operator takes the old version and
returns the new one, which is then written under a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.functions.storage import materialise
from adweave.functions.text import normal_city, normal_company, normal_title


def identity_keys(source: Column, source_job_id: Column, company: Column, title: Column, place: Column) -> Column:
    """The keys by which a job is known again: its copy's, and its own."""
    copy = F.concat_ws(":", F.lit("copy"), source, source_job_id)
    own = F.concat(F.lit("job:"), F.concat_ws("|", normal_company(company), normal_title(title), normal_city(place)))
    return F.array_distinct(F.array(copy, own))


def find_job_ids(keyed: DataFrame, job_keys: DataFrame) -> DataFrame:
    """``ordinal, job_id``: the least known id of a row's keys, null if none is known.

    ``keyed`` is (ordinal, keys), ``job_keys`` (key, job_id).
    """
    hits = keyed.select("ordinal", F.explode("keys").alias("key")).join(job_keys, "key").groupBy("ordinal").agg(F.min("job_id").alias("job_id"))
    return keyed.select("ordinal").join(hits, "ordinal", "left")


def remember(keyed: DataFrame, job_keys: DataFrame, first_new_id: int) -> DataFrame:
    """``ordinal, job_id, is_new`` of a batch, taken in the order of ``ordinal``.

    A row is the job with the least id that any of its keys has, by ``job_keys`` or by
    an earlier row of the batch; a row whose keys are all new is a new job.  A key
    stays with the job of the first row that holds it.  So a row's job is the
    least among the known ids and new jobs that lead to it over first holders,
    which are its parents.  This isn't a closure: a row that joins two jobs
    doesn't merge them.  Ordinals are unique; a row without keys is a new job.

    By pointer jumping: after each round a row knows the least value of all
    ancestors up to twice as far, and points at those exactly there, so a chain
    of n rows takes log n rounds.  A row that is a first holder by one of two keys
    has one parent at most, so its pointers don't grow in number; where more
    keys let them grow beyond twice those at the start, rounds go on with the
    distance reached until no value moves.
    """
    rows = materialise(find_job_ids(keyed, job_keys).join(keyed, "ordinal"), "memory-rows")
    fresh_keys = rows.select("ordinal", F.explode("keys").alias("key")).join(job_keys.select("key").distinct(), "key", "left_anti")
    holders = fresh_keys.groupBy("key").agg(F.min("ordinal").alias("parent"))
    edges = materialise(fresh_keys.join(holders, "key").where("parent < ordinal").select("ordinal", "parent").distinct(), "memory-edges")
    value = lambda new, number: F.struct(F.lit(new).alias("new"), F.col(number).cast("bigint").alias("id"))
    linked = edges.select("ordinal").distinct().withColumn("linked", F.lit(True))
    start = F.when(F.col("job_id").isNotNull(), value(1, "job_id").withField("new", F.lit(0))).when(F.col("linked").isNull(), value(1, "ordinal"))
    values = materialise(rows.select("ordinal", "job_id").join(linked, "ordinal", "left").select("ordinal", start.alias("value")), "memory-values")
    count = edges.count()
    most, jumps = 2 * count, True
    while count:
        above = values.where("value IS NOT NULL").select(F.col("ordinal").alias("parent"), F.col("value").alias("offer"))
        offers = edges.join(above, "parent").groupBy("ordinal").agg(F.min("offer").alias("offer"))
        moved = values.join(offers, "ordinal", "left").select("ordinal", F.least("value", "offer").alias("value"), (~F.least("value", "offer").eqNullSafe(F.col("value"))).alias("moved"))
        moved = materialise(moved, "memory-values")
        values = moved.drop("moved")
        if jumps:
            further = edges.join(edges.select(F.col("ordinal").alias("parent"), F.col("parent").alias("next")), "parent")
            further = materialise(further.select("ordinal", F.col("next").alias("parent")).distinct(), "memory-edges")
            grown = further.count()
            jumps = grown <= most
            if jumps:
                edges, count = further, grown
        elif moved.where("moved").isEmpty():
            break
    roots = values.where("value.new = 1 AND value.id = ordinal").select("ordinal")
    # numbers by order within range-dealt parts would do as well; roots are few next to the rows
    part = F.floor(F.col("ordinal") / 1_000_000)
    fresh = roots.select(F.col("ordinal").alias("root"), (F.row_number().over(Window.partitionBy(part).orderBy("ordinal")) + part * 1_000_000 + first_new_id - 1).alias("fresh_id"))
    out = values.join(fresh, (F.col("value.new") == 1) & (F.col("value.id") == F.col("root")), "left")
    return out.select("ordinal", F.coalesce("fresh_id", "value.id").alias("job_id"), (F.col("value.new") == 1).alias("is_new"))


def remembered_keys(keyed: DataFrame, job_keys: DataFrame, remembered: DataFrame) -> DataFrame:
    """The next version of ``job_keys`` (key, job_id): new keys go to the first row that holds them."""
    rows = keyed.join(remembered, "ordinal").select("ordinal", "job_id", F.explode("keys").alias("key"))
    new = rows.groupBy("key").agg(F.min_by("job_id", "ordinal").alias("job_id")).join(job_keys.select("key"), "key", "left_anti")
    return job_keys.select("key", "job_id").unionByName(new.select("key", "job_id"))


def set_states(states: DataFrame, changes: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (job_id, saved, applied, dismissed, updated_at) after the changes, and
    the changes to unknown jobs.  The latest stated value of each flag holds."""
    good = changes.join(jobs.select("job_id"), "job_id", "left_semi")
    rows = states.unionByName(good)
    last = lambda n: F.coalesce(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("updated_at"))), F.lit(False)).alias(n)
    merged = rows.groupBy("job_id").agg(last("saved"), last("applied"), last("dismissed"), F.max("updated_at").alias("updated_at"))
    return merged, changes.join(jobs.select("job_id"), "job_id", "left_anti")


def recall_ads(ads: DataFrame, texts: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """``ads`` with the description remembered for (source, source_job_id) in the
    last ``days``; what is remembered as empty changes nothing."""
    keys = ["source", "source_job_id"]
    fresh = texts.where(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(days))).groupBy(*keys).agg(F.max_by("description", "fetched_at").alias("_text"))
    out = ads.join(fresh, keys, "left")
    use = F.coalesce(F.col("_text"), F.lit("")) != ""
    return out.withColumn("description", F.when(use, F.col("_text")).otherwise(F.col("description"))).withColumn("recalled", use).drop("_text")


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def expire(df: DataFrame, stamp: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(stamp) >= now - F.make_dt_interval(F.lit(days)))


def overlay_states(results: DataFrame, states: DataFrame) -> DataFrame:
    """Saved results with the present flags instead of the stored ones."""
    flags = ("saved", "applied", "dismissed")
    now = states.select("job_id", *(F.col(f).alias(f"_{f}") for f in flags))
    out = results.join(now, "job_id", "left")
    for f in flags:
        out = out.withColumn(f, F.coalesce(f"_{f}", f, F.lit(False)))
    return out.drop(*(f"_{f}" for f in flags))
