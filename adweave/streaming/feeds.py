"""Incremental versions: feeds as streams, with the batch result as their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adweave.functions.sinks import read_newest, versions, write_version
from adweave.functions.storage import materialise, shared_dir


def read_feed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def first_of_each(feed: DataFrame, keys: list[str], stamp: str, delay: str) -> DataFrame:
    """Each key once while the watermark covers it; feeds that overlap repeat rows."""
    return feed.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(feed: DataFrame, key: str, stamp: str, value: str, delay: str = "1 day") -> DataFrame:
    """Counts and sums of a key by tumbling days, closed when the watermark passes."""
    windows = feed.withWatermark(stamp, delay).groupBy(F.window(stamp, "1 day"), key)
    return windows.agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("window.start").alias("day"), key, "n", "total")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that a stream has now, as a table in the shared folder."""
    spark, folder = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def changed_since(feed: DataFrame, stamp: str, name: str, overlap: str = "5 minutes") -> tuple[DataFrame, Callable[[], None]]:
    """The rows of ``feed`` that are newer than all rows of the runs before, less ``overlap``,
    and a function that marks them as read.

    Call it after the rows were written: a run that fails before that leaves the
    mark, and the next one gets its rows again.  Sources list a change some time
    after its stamp, so each run takes the last minutes again; ``first_of_each``
    drops what comes twice.  The mark is the largest ``stamp`` at the time of the
    call, so a row that comes while the others are read isn't lost.  It is kept as
    a versioned table of one row in the shared folder; of two runs from one mark
    the second to finish gets ``VersionTaken``.  The first run takes all rows, and
    rows without a stamp always come.
    """
    spark, folder = feed.sparkSession, f"{shared_dir(feed.sparkSession)}/{name}"
    done = versions(spark, folder)
    schema = feed.select(F.col(stamp).alias("mark")).schema
    mark = read_newest(spark, folder, schema).first()["mark"] if done else None
    top = feed.agg(F.max(stamp).alias("mark"))
    if mark is not None:
        top = top.select(F.greatest("mark", F.lit(mark)).alias("mark"))
        feed = feed.where(F.col(stamp).isNull() | (F.col(stamp) > F.lit(mark) - F.expr(f"INTERVAL {overlap}")))
    top = materialise(top, "feed-mark")

    def commit() -> None:
        write_version(top, folder, (done[-1] if done else 0) + 1)

    return feed, commit
