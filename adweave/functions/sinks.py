"""Tables that keep the newest row of each key: every write is a new version beside the old ones.

A version is written whole under a name of its own, and then its number is
claimed by moving a small file there, which only one writer can do.  So a lost
job leaves the table as it was, and of two writers that started from one
version the second finds its number taken and starts again from the other's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How often a write starts again because another one was quicker.
TRIES = 20


class VersionTaken(RuntimeError):
    """Another writer has claimed the version."""


def _files(spark: SparkSession, folder: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, conf, path, path.getFileSystem(conf)


def _claims(spark: SparkSession, folder: str) -> dict[int, str]:
    """The claimed versions and the names of their folders; a claim is a file ``number=name``."""
    jvm, _, path, files = _files(spark, folder)
    root = jvm.org.apache.hadoop.fs.Path(path, "_versions")
    if not files.exists(root):
        return {}
    out = {}
    for entry in files.listStatus(root):
        number = entry.getPath().getName()
        if number.isdigit():
            inside = files.listStatus(entry.getPath())
            out[int(number)] = inside[0].getPath().getName()
    return out


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions of a table that are in ``folder``."""
    return sorted(_claims(spark, folder))


def read_newest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The newest version, or no rows where nothing was written."""
    known = _claims(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/{known[max(known)]}") if known else spark.createDataFrame([], schema)


def write_version(rows: DataFrame, folder: str, number: int) -> DataFrame:
    """``rows`` as version ``number``; ``VersionTaken`` if there is one of that number.

    The claim is a folder that holds one empty file, named like the version's
    rows.  It is filled before it is moved, and moving to a name that exists
    fails, so a claim is always whole and has one owner.
    """
    spark = rows.sparkSession
    jvm, conf, path, files = _files(spark, folder)
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((folder, *parts)))
    name = f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    files.mkdirs(at("_versions"))
    files.create(at("_claiming", name, name), False).close()
    whole = files.makeQualified(path).toUri()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole, conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(at("_claiming", name)), files.makeQualified(at("_versions", str(number))), none)
    except Exception as e:
        if number in _claims(spark, folder):
            raise VersionTaken(f"version {number} of {folder}") from e
        raise
    return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")


def change(spark: SparkSession, folder: str, schema, new: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes ``new(newest version)`` as the next one, again from the newest if another writer was quicker."""
    for _ in range(TRIES):
        known = versions(spark, folder)
        try:
            return write_version(new(read_newest(spark, folder, schema)), folder, known[-1] + 1 if known else 1)
        except VersionTaken:
            continue
    raise VersionTaken(f"{folder}: {TRIES} times")


def replace_by_key(rows: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Insert or replace: ``rows`` and the old rows whose key isn't among them.

    Keys are unique within ``rows``; rows with a null key are kept beside the
    old ones.  Returns the new version, which has what other writers added too.
    """
    return change(rows.sparkSession, folder, rows.schema, lambda old: old.join(rows.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows))


def keep_latest(rows: DataFrame, folder: str, key: str) -> DataFrame:
    """Insert or replace, and forget the rows of all keys but the largest."""

    def newest(old: DataFrame) -> DataFrame:
        both = old.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(rows)
        return both.join(F.broadcast(both.agg(F.max(key).alias(key))), key).select(*rows.columns)  # one row

    return change(rows.sparkSession, folder, rows.schema, newest)
