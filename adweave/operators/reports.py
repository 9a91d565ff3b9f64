"""Reports: counts, ledgers, rankings, quality of scores, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_counts(copies: DataFrame) -> DataFrame:
    """``source, only_here``: jobs that no other source has."""
    single = copies.groupBy("job_key").agg(F.min("source").alias("source"), F.max("source").alias("other")).where("source = other")
    return single.groupBy("source").agg(F.count("*").alias("only_here"))


def usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))


def estimate_cost(usage: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """``keys, cost, complete``: tokens by price per million; complete if every model
    that was used has a price."""
    rows = usage.join(F.broadcast(prices), "model", "left")
    cost = F.col("input_tokens") / 1e6 * F.col("input_per_million") + F.col("output_tokens") / 1e6 * F.col("output_per_million")
    return rows.groupBy(*keys).agg(F.sum(F.coalesce(cost, F.lit(0.0))).alias("cost"), F.bool_and(F.col("input_per_million").isNotNull()).alias("complete"))


def request_sums(requests: DataFrame) -> DataFrame:
    """Requests of each source by day and by month, in one pass."""
    day = requests.select("source", F.date_trunc("day", "ts").alias("day"))
    return day.groupBy("source", "day").agg(F.count("*").alias("requests")).withColumn("month", F.date_trunc("month", "day"))


def share_of_month(left: Column, days: Column, rate: Column, rest_today: Column, low: int = 25, high: int = 60) -> Column:
    """Requests that one search may take: an equal share of what the month has left."""
    return F.least(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(left / days / rate))), rest_today).cast("bigint")


def admit(requests: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows until the running sum of ``cost`` passes the limit of a key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return requests.withColumn("so_far", F.sum("cost").over(w)).where(F.col("so_far") <= limit)


def score_check(rated: DataFrame, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """``rating, n, in_band, least, middle, most`` of scores against ratings."""
    inside = F.lit(False)
    for name, (low, high) in bands.items():
        inside = inside | ((F.col("rating") == name) & F.col("score").between(low, high))
    return rated.groupBy("rating").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("in_band"), F.min("score").alias("least"), F.median("score").alias("middle"), F.max("score").alias("most")
    )


BANDS = ((0, 39), (40, 59), (60, 74), (75, 100))


def band_of(score: Column) -> Column:
    return F.coalesce(*(F.when(score <= high, F.lit(i)) for i, (_, high) in enumerate(BANDS)), F.lit(len(BANDS) - 1))


def spread_by_score(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows for each ``key``: a quarter from each band, then the rest by order."""
    quota = max(1, n // len(BANDS))
    banded = rows.withColumn("band", band_of(F.col("score")))
    in_band = banded.withColumn("_in", F.row_number().over(Window.partitionBy(key, "band").orderBy("ordinal")))
    order = Window.partitionBy(key).orderBy((F.col("_in") > quota).cast("int"), "ordinal")
    return in_band.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).drop("_in", "_at")


def cap_terms(terms: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Terms of each language and kind up to a cap, without repeats in another case.

    ``terms`` is (ordinal, text, language, kind); the first spelling stays.
    """
    first = terms.groupBy("language", "kind", F.lower("text").alias("_l")).agg(F.min("ordinal").alias("ordinal"), F.min_by("text", "ordinal").alias("text")).drop("_l")
    place = F.row_number().over(Window.partitionBy("language", "kind").orderBy("ordinal"))
    cap = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in caps.items()))
    return first.withColumn("place", place).where(F.col("place") <= cap)


def batch_ids(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def sort_cards(cards: DataFrame) -> DataFrame:
    """Scored first, then by score, then newest; unknown times last; ties by key."""
    return cards.orderBy(F.col("score").isNull(), F.desc("score"), F.desc_nulls_last("posted_at"), "job_key")


def rank_cards(cards: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("score").isNull(), F.desc("score"), F.desc_nulls_last("posted_at"), "job_key")
    return cards.withColumn("place", F.row_number().over(w))


def top_scored(cards: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` of each key, and how many were cut."""
    ranked = rank_cards(cards, key)
    return ranked.where(F.col("place") <= n), ranked.groupBy(key).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("cut"))


def reposted(first_seen: Column, posted_from: Column) -> Column:
    """Seen over a day before it says that it was posted."""
    return F.coalesce(first_seen < posted_from - F.expr("INTERVAL 1 DAY"), F.lit(False))


def feed_health(ads: DataFrame, window_start: Column, full: int = 400) -> DataFrame:
    """A feed that is full and doesn't reach back to the window's start is partial."""
    own = ads.groupBy("source").agg(F.count("*").alias("n"), F.min("posted_at").alias("oldest"))
    return own.withColumn("status", F.when((F.col("n") >= full) & (F.col("oldest") > window_start), "partial").otherwise("complete"))


def coverage(wanted: DataFrame) -> DataFrame:
    """``stage, n``: where wanted jobs were lost, in the order of a search."""
    stage = F.when(F.col("found"), "found").when(F.col("place_rule"), "place rule").when(F.col("unrelated"), "unrelated").when(F.col("collected") & F.col("score").isNull(), "unscored").when(F.col("collected"), "not shown").otherwise("never collected")
    return wanted.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
