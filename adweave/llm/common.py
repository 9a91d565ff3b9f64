"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from adweave.functions.storage import materialise, materialise_dealt, shared_dir

__all__ = ["give_back", "held_out", "materialise", "materialise_dealt", "shared_dir", "small_frame", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """True for the fifth of the rows that nothing may be learnt from.

    A null key counts as the empty string, whose checksum is 0: held out.
    """
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def give_back() -> None:
    """Returns free memory of a Python worker to the machine.

    Workers are used again by later tasks, of other operators too, and keep
    what they once took.  Called where a task has held much.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of some rows that the driver holds, sent as one Arrow table, so that
    reading it takes no Python worker."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array(list(column), kind.type) for column, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], schema=kinds))
