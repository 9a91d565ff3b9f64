"""Keyed state with timers: what is known about a key lives in Spark's state store.

A batch reads and writes the state of its own keys only, and timers in event
time remove what has run out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from adweave.functions.storage import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_stateful(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream with keyed state has now, added to the table ``name`` in the shared
    folder; a later run on the same name goes on from its state.  Returns the whole table."""
    spark, folder = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}"
    with state_store(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


class _Earliest(StatefulProcessor):
    """One number for each key: the least stamp so far.  A row goes out where it falls."""

    def init(self, handle) -> None:
        self.least = handle.getValueState("least", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = min((r["at"] for r in rows if r["at"] is not None), default=None)
        known = self.least.get() if self.least.exists() else None
        if new is not None and (known is None or new < known[0]):
            self.least.update((new,))
            yield Row(key=key[0], at=new)

    def close(self) -> None:
        pass


def first_seen(feed: DataFrame, key: str, stamp: str, name: str) -> DataFrame:
    """``key, first_seen``: the first time of each key, over all runs under ``name``.

    The state is one number for each key; a batch touches only its own keys, and
    adds a row to the table only for a key that is new, or that a late row has
    made older.  Rows without a stamp are ignored; a null key is a key.
    """
    kind = feed.schema[key].dataType
    rows = feed.select(F.col(key).alias("key"), F.unix_micros(F.col(stamp).cast("timestamp")).alias("at"))
    out = rows.groupBy("key").transformWithState(_Earliest(), StructType().add("key", kind).add("at", "long"), "Append", "None")
    log = run_stateful(out, name)
    return log.groupBy(F.col("key").alias(key)).agg(F.timestamp_micros(F.min("at")).alias("first_seen"))


#: (what is known of a key or None, the row) to what is then known and the rows to put out.
Step = Callable[[tuple | None, Row], tuple[tuple | None, Iterable[Row]]]


class InOrder(StatefulProcessor):
    """Hands each key's rows to ``step`` in the order of event time, whatever order they came in.

    ``row_schema`` names the columns that wait, ``at`` first: microseconds, then
    what orders rows of one time.  Rows wait in the state until the watermark
    has passed them; a timer wakes the key then.  What the step knows of a key is dropped by a second timer,
    ``keep`` microseconds after ``since`` of the newest value.
    """

    def __init__(self, step: Step, row_schema: str, known_schema: str, keep: int, since: int = 0):
        self.step, self.row_schema, self.known_schema, self.keep, self.since = step, row_schema, known_schema, keep, since
        self.names = StructType.fromDDL(row_schema).names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.known = handle.getValueState("known", self.known_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = list(rows)
        if new:
            self.waiting.appendList([tuple(r[n] for n in self.names) for r in new])
            self._wake(min(r["at"] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [Row(*self.names)(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, rest = [r for r in rows if r["at"] <= mark], [r for r in rows if r["at"] > mark]
        known = tuple(self.known.get()) if self.known.exists() else None
        for row in sorted(due, key=lambda r: [(v is None, v) for v in r]):
            if known is not None and known[self.since] + self.keep < row["at"]:
                known = None
            known, out = self.step(known, row)
            yield from out
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put([tuple(r) for r in rest])
                self._wake(min(r["at"] for r in rest))
        if known is not None and known[self.since] + self.keep < mark:
            known = None  # and no row of before the mark can come any more
        if known is None:
            self.known.clear()
        else:
            self.known.update(known)
            self._wake(known[self.since] + self.keep + 1)

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))


def _recalled(known: tuple | None, row: Row) -> tuple[tuple | None, Iterable[Row]]:
    if row["text"]:
        return (row["at"], row["text"]), ()
    return known, (Row(at=row["at"], id=row["id"], recalled=known[1] if known else None),)


def recall_stream(feed: DataFrame, key: str, stamp: str, text: str, row_id: str, days: int = 3, delay: str = "1 day") -> DataFrame:
    """Each row of ``feed`` without a text, with the last text of its key.

    ``feed`` is a stream of ads: those with a text in ``text`` are remembered by
    ``key`` for ``days``, those with none (null or empty) ask for it.  Returns
    ``row_id, at, recalled`` (``at`` in microseconds; null where nothing is
    remembered), once the watermark, ``delay`` behind the newest stamp, has
    passed the row; so the answer doesn't depend on how rows were dealt into
    batches.  Rows that come after the watermark are dropped.  Rows of one
    stamp go by ``row_id``.  The state of a key is one text and the rows of the
    last ``delay``; it is empty ``days`` after its last text.
    """
    rows = feed.withWatermark(stamp, delay).select(F.col(key).alias("key"), stamp, F.unix_micros(F.col(stamp).cast("timestamp")).alias("at"), F.col(row_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where("at IS NOT NULL")
    processor = InOrder(_recalled, "at bigint, id bigint, text string", "at bigint, text string", days * 86_400_000_000)
    out = rows.select("key", stamp, "at", "id", "text").groupBy("key").transformWithState(processor, "at bigint, id bigint, recalled string", "Append", "EventTime")
    return out.select(F.col("id").alias(row_id), "at", "recalled")
