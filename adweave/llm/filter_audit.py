"""Audit of how text filters act on each other, in every order.

Each document's failures are one bit mask, and the counts of the masks add up,
so all orders of the filters follow from them: nothing is filtered 120 times.
The one filter that needs other documents, exact copies, has a prepass: a
counting Bloom sketch of all texts, summed in each task and merged by addition,
clears the texts that are surely unique.  Only what may repeat is shuffled as
text.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import materialise, table
from adweave.llm.line_cleaning import words_of

#: The filters' letters; letter i is bit i of a mask.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")

BUCKET = 32768  # cells of a bucket: one of Spark's bitmaps.  All cells of a text lie in one bucket
CELLS = 4  # of a text
CELLS_A_TEXT = 10  # of the whole sketch, for each text
#: A sketch's buckets at most: 65,536 bitmaps of 4 KB are 256 MB, which may be broadcast.
MOST_BUCKETS = 65536


def failures(text: Column) -> Column:
    """The bits of A to D for a text that isn't null: under 200 words; under half of the words
    distinct; over 2 % of the code points ``A-Z``; any of ``#$%&*|``."""
    bit = lambda letter, fails: F.when(fails, 1 << LETTERS.index(letter)).otherwise(0)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    of_words = lambda w: bit("A", F.size(w) < 200) + bit("B", 100 * F.size(F.array_distinct(w)) < 50 * F.size(w))
    return F.transform(F.array(words_of(text)), of_words)[0] + bit("C", 100 * upper > 2 * F.length(text)) + bit("D", text.rlike("[#$%&*|]"))


def _cells(code: Column) -> Column:
    """The cells of a text's code within its bucket, 15 bits of the code each."""
    return F.array_distinct(F.array(*(F.shiftrightunsigned(code, 15 * k).bitwiseAND(F.lit(BUCKET - 1)) for k in range(CELLS))))


def _bucket(code: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(buckets)).cast("int")


def counting_sketch(codes: DataFrame, code: str, texts: int, most_buckets: int = MOST_BUCKETS) -> tuple[DataFrame, int]:
    """The merged counting Bloom sketch of ``codes``, and its number of buckets.

    The sketch is the table (bucket, cell, count) without its empty cells: each
    task sums its own, the shuffle adds those of all tasks.  Returned is for
    each bucket the bitmap of the cells hit at least twice, which is all that a
    probe asks.  ``texts`` is the number of rows.  A sketch never has over
    ``most_buckets`` buckets; past that it gets fuller and clears fewer texts,
    never a wrong one.
    """
    buckets = min(most_buckets, texts * CELLS_A_TEXT // BUCKET + 1)
    hits = codes.select(_bucket(F.col(code), buckets).alias("bucket"), F.explode(_cells(F.col(code))).alias("cell"))
    counted = hits.groupBy("bucket", "cell").agg(F.count("*").alias("hits"))
    return counted.filter("hits > 1").groupBy("bucket").agg(F.bitmap_construct_agg("cell").alias("cells")), buckets


def with_repeat_flag(df: DataFrame, code: str, sketch: tuple[DataFrame, int], name: str) -> DataFrame:
    """``df`` with ``name``: false if the row's text is surely unique.  No shuffle: the sketch, of bounded size, is broadcast."""
    full, buckets = sketch
    bitmaps = full.select(F.col("bucket").alias("_bucket"), F.col("cells").alias("_bits"))
    hit = lambda cell: F.getbit(F.conv(F.hex(F.substring("_bits", F.shiftright(cell, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint"), cell.bitwiseAND(F.lit(7))) == 1
    met = df.withColumn("_bucket", _bucket(F.col(code), buckets)).join(F.broadcast(bitmaps), "_bucket", "left")
    return met.withColumn(name, F.col("_bits").isNotNull() & F.forall(_cells(F.col(code)), hit)).drop("_bucket", "_bits")


def first_holders(texts: DataFrame, key: str, code: str, text: str) -> DataFrame:
    """(``key``, ``code``) of the least key of each whole text.  Copies meet in their own task first, so a hot text is one row a task."""
    return texts.groupBy(code, text).agg(F.min(key).alias(key)).select(key, code)


def failure_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per document: ``part, mask, good, toxic``.

    ``mask`` has the bits of ``failures`` and, for a copy of a smaller key's
    whole text, of E.  A null text counts as the empty one, a null part as the
    empty string.  Rows of one key and text, and rows without a key, are no
    copies by themselves.  Of several labels of a document any 1 counts;
    a document without labels has neither.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marks = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), failures(body).alias("mask"), F.xxhash64(body).alias("code"))
    marks = materialise(marks, "audit-marks")
    full, buckets = counting_sketch(marks, "code", marks.count())
    sketch = materialise(full, "audit-sketch"), buckets
    coded = docs.select(F.col(key).alias("id"), body.alias("text"), F.xxhash64(body).alias("code"))
    firsts = first_holders(with_repeat_flag(coded, "code", sketch, "again").filter("again"), "id", "code", "text")
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    said = labels.groupBy(F.col(key).alias("id")).agg(one("quality"), one("toxic"))
    met = with_repeat_flag(marks, "code", sketch, "again").join(firsts.withColumn("first", F.lit(True)), ["id", "code"], "left").join(said, "id", "left")
    copy = F.when(F.col("again") & F.col("id").isNotNull() & F.col("first").isNull(), COPY).otherwise(0)
    flag = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    return met.select("part", (F.col("mask") + copy).alias("mask"), flag("quality").alias("good"), flag("toxic").alias("toxic"))


def audit_orders(masks: DataFrame) -> DataFrame:
    """The counts of every part, order and step, from the rows of ``failure_masks``.

    Only sums over the 32 masks are needed: a document is removed by the first
    of its failing filters in an order, and a filter comes first among s
    failing ones in 120 / s of the orders.  Without documents there are no rows.
    """
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most
    orders = F.array(*(F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*(F.lit(1 << LETTERS.index(c)) for c in p)).alias("bits")) for p in permutations(LETTERS)))
    rows = parts.select("part", "counts", F.explode(orders).alias("o")).select("part", "counts", "o.filter_order", "o.bits", F.posexplode("o.bits").alias("at", "own"))
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", 1, F.col("at")), F.lit(0), lambda m, b: m.bitwiseOR(b)))
    own, before = F.col("own"), F.col("before")
    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    total = lambda of, where: F.aggregate(F.filter("counts", where), F.lit(0).cast("long"), lambda s, c: s + of(c))
    n = lambda c: c["n"]
    removed = lambda c: fails(c) & ~gone(c)
    return rows.select(
        "part",
        "filter_order",
        (F.col("at") + 1).alias("step"),
        total(n, lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda c: fails(c) & gone(c)).alias("redundant"),
        total(n, lambda c: c["mask"] == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: c["n"] * F.floor(F.lit(math.factorial(len(LETTERS))) / F.bit_count(c["mask"])), fails).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_orders(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
    FROM documents
), marks AS (
    SELECT d.part, coalesce(l.quality = 1, FALSE)::INT AS good, coalesce(l.toxic = 1, FALSE)::INT AS toxic,
           {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
            'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body), 'D': regexp_matches(body, '[#$%&*|]'), 'E': d.doc_id > first} AS f
    FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), failing AS (
    SELECT part, good, toxic, array_to_string(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END), '') AS s
    FROM marks
), runs AS (
    SELECT part, filter_order, good, toxic, s, n, list_min(list_transform(string_split(s, ''), lambda x: CASE WHEN x = '' THEN 9 ELSE instr(filter_order, x) END)) AS fell
    FROM (SELECT part, good, toxic, s, count(*) AS n FROM failing GROUP BY ALL), orders
), steps AS (
    SELECT part, filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS own,
           sum(CASE WHEN fell > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fell = step THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN fell < step AND contains(s, substr(filter_order, step::INT, 1)) THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN s = substr(filter_order, step::INT, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN fell = step THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fell = step THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM runs, range(1, 6) AS r(step) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM steps
"""
