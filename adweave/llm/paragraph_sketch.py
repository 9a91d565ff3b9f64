"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Each paragraph digest is added to three cells that hold a count, the digests'
exclusive or and their checksums' exclusive or.  The cells of two versions are
subtracted; what both hold cancels, and peeling the cells left with a single
digest recovers every paragraph that differs.  Where peeling gets stuck, larger
sketches are taken.  Built-in functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.llm.common import materialise, materialise_dealt, table

#: A sentence without an end counts as pieces of this many characters.
PIECE_CHARS = 160
#: Parts of a sketch: a digest has one cell in each.
PARTS = 3
LEAST_CELLS = 8
#: Digests of all three texts of a row that a bucket holds, about, and the most buckets.
BUCKET_DIGESTS, MOST_BUCKETS = 600_000, 50_000
#: Places of a range that a look-up takes together: 2 ** this.
CHUNK_BITS = 9


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs, sorted.

    A paragraph is a line, cut after its sentence marks and at every 160
    characters without one, so that a change leaves the pieces before and after
    it alone.  Null and empty texts have none.
    """
    pattern = f"[^\n.!?]{{0,{PIECE_CHARS}}}+[.!?]+|[^\n.!?]{{1,{PIECE_CHARS}}}"
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def checksum(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def power_of_two(n: Column) -> Column:
    """The least power of two from ``n`` on."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("bigint")


def cells_for(n: Column) -> Column:
    """Cells in each part of the stored sketch of ``n`` digests: twice as many in all, or more.

    Always a power of two, so a sketch is folded to a smaller one by dropping
    high bits of its cells' places.
    """
    return F.greatest(F.lit(LEAST_CELLS), power_of_two(n * 2 / PARTS)).cast("bigint")


def place(digest: Column, part: Column, cells: Column) -> Column:
    return F.xxhash64(digest, part).bitwiseAND(cells - 1)


def sketch_cells(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """The cells that aren't empty: ``keys, carried, part, spot, c, k, h``.

    ``rows`` has ``digests`` (an array) and ``cells`` (of each part).  ``carried``
    are columns that depend on ``keys`` alone.
    """
    each = rows.select(*keys, *carried, "cells", F.explode("digests").alias("d"))
    each = each.select(*keys, *carried, "cells", "d", F.explode(F.array(*(F.lit(j) for j in range(PARTS)))).alias("part"))
    return each.groupBy(*keys, *carried, "part", place(F.col("d"), F.col("part"), F.col("cells")).alias("spot")).agg(
        F.count("*").alias("c"), F.bit_xor("d").alias("k"), F.bit_xor(checksum(F.col("d"))).alias("h")
    )


def _bind(value: Column, f) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def fingerprint(digests: Column) -> Column:
    """The stored sketch of a text's digests as a string.

    Its cells in each part, then ``cell:count:digests:checksums`` of each filled cell
    in order.  Made within the row: the digests are sorted by cell, and each run of
    the same cell is summed up.
    """

    def summed(s: Column, first: Column, end: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
        run = F.slice(s, first + 1, end - first)
        sums = F.aggregate(run, zero, lambda a, x: F.struct(a["k"].bitwiseXOR(x["d"]).alias("k"), a["h"].bitwiseXOR(checksum(x["d"])).alias("h")))
        return F.concat_ws(":", F.get(s, first)["cell"].cast("string"), (end - first).cast("string"), F.hex(sums["k"]), F.hex(sums["h"]))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when(F.get(s, i - 1)["cell"].eqNullSafe(x["cell"]), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
        return _bind(starts, lambda b: F.array_join(F.transform(b, lambda first, r: _bind(F.coalesce(F.get(b, r + 1), F.size(s)), lambda end: summed(s, first, end))), ","))

    def whole(cells: Column) -> Column:
        each = F.flatten(F.transform(digests, lambda d: F.array(*(F.struct((j * cells + place(d, F.lit(j), cells)).alias("cell"), d.alias("d")) for j in range(PARTS)))))
        return F.concat(cells.cast("string"), F.lit(";"), _bind(F.array_sort(each), runs))

    return _bind(cells_for(F.size(digests)), whole)


def peel(state: DataFrame, keys: list[str], steps: int = 9) -> DataFrame:
    """What subtracted cells give up: ``keys, stuck, only_a, only_b``.

    ``state`` has ``keys, m`` (cells of each part), ``cell`` (part * m + place) and
    ``c, k, h``, where ``c`` is the count of the one side less that of the other.
    Each step takes one part, in which a digest stands in one cell only.  Pairs
    without any difference have no row; ``stuck`` counts the cells left over.
    """
    state = state.withColumn("tag", F.lit(None).cast("bigint"))
    filled = (F.col("c") != 0) | (F.col("k") != 0) | (F.col("h") != 0)
    for step in range(steps):
        j = step % PARTS
        here = F.col("tag").isNull() & F.col("cell").between(j * F.col("m"), (j + 1) * F.col("m") - 1)
        single = here & (F.abs("c") == 1) & (F.col("h") == checksum(F.col("k"))) & (F.col("cell") == j * F.col("m") + place(F.col("k"), F.lit(j), F.col("m")))
        row = lambda cell, tag, c: F.struct(cell.cast("bigint").alias("cell"), tag.cast("bigint").alias("tag"), c.alias("c"), F.col("k").alias("k"), F.col("h").alias("h"))
        same = row(F.col("cell"), F.col("tag"), F.col("c"))
        others = [row(i * F.col("m") + place(F.col("k"), F.lit(i), F.col("m")), F.lit(None), -F.col("c")) for i in range(PARTS) if i != j]
        found = row(F.lit(-1), F.col("k"), F.col("c"))
        state = state.where(filled).select(*keys, "m", F.explode(F.when(single, F.array(*others, found)).otherwise(F.array(same))).alias("r")).select(*keys, "m", "r.*")
        state = state.groupBy(*keys, "m", "cell", "tag").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    tagged = F.col("tag").isNotNull()
    return state.where(filled).groupBy(*keys).agg(
        F.count_if(~tagged).alias("stuck"), F.count_if(tagged & (F.col("c") == 1)).alias("only_a"), F.count_if(tagged & (F.col("c") == -1)).alias("only_b")
    )


def subtract(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of both sides folded to ``m`` cells a part and subtracted by ``sign``."""
    cell = F.col("part") * F.col("m") + F.col("spot").bitwiseAND(F.col("m") - 1)
    return cells.groupBy(*keys, "m", cell.alias("cell")).agg(F.sum(F.col("sign") * F.col("c")).alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))


def retried(pairs: DataFrame, keys: list[str], times: int) -> DataFrame:
    """Like ``peel``, for pairs whose stored sketches were too small.

    ``pairs`` has the digest arrays ``a`` and ``b``; their sketches are made anew,
    4 ** ``times`` as large as the smaller stored one, and large enough for the
    difference that the counts alone show.
    """
    na, nb = F.size("a"), F.size("b")
    m = F.greatest(F.least(cells_for(na), cells_for(nb)) * 4**times, power_of_two(F.abs(na - nb) / 2))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("a").alias("d")), F.struct(F.lit(-1).alias("sign"), F.col("b").alias("d"))))
    rows = pairs.select(*keys, m.alias("m"), sides.alias("s")).select(*keys, "m", F.col("m").alias("cells"), "s.sign", F.col("s.d").alias("digests"))
    return peel(subtract(sketch_cells(rows, [*keys, "sign"], ["m"]), keys), keys)


def stored_sketches(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Cells of the stored sketch of each digest array that ``pairs`` names.

    ``keys, side`` (its place among the names), ``cells``, ``m0, m1, ...`` (the smaller
    sketch's cells of each pair) and ``part, spot, c, k, h``.
    """
    names = list(dict.fromkeys(n for p in pairs for n in p))
    size = {n: cells_for(F.size(n)) for n in names}
    least = [F.least(size[a], size[b]).alias(f"m{w}") for w, (a, b) in enumerate(pairs)]
    sides = F.array(*(F.struct(F.lit(i).alias("side"), size[n].alias("cells"), F.col(n).alias("digests")) for i, n in enumerate(names)))
    each = rows.select(*keys, *least, F.explode(sides).alias("s")).select(*keys, *(f"m{w}" for w in range(len(pairs))), "s.*")
    return sketch_cells(each, [*keys, "side"], ["cells", *(f"m{w}" for w in range(len(pairs)))])


def stored_differences(stored: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Each pair's stored sketches subtracted and peeled: ``keys, which, stuck, only_a, only_b``."""
    names = list(dict.fromkeys(n for p in pairs for n in p))
    use = lambda n: F.array(*(F.struct(F.lit(w).alias("which"), F.lit(1 if p[0] == n else -1).cast("bigint").alias("sign"), F.col(f"m{w}").alias("m")) for w, p in enumerate(pairs) if n in p))
    uses = F.lit(None)
    for i, n in enumerate(names):
        uses = F.when(F.col("side") == i, use(n)).otherwise(uses)
    halves = stored.select(*keys, F.explode(uses).alias("u"), "part", "spot", "c", "k", "h").select(*keys, "u.*", "part", "spot", "c", "k", "h")
    return peel(subtract(halves, [*keys, "which"]), [*keys, "which"])


def by_chunk(entries: DataFrame, value: Column, gather) -> DataFrame:
    """``range, found``: for each range a map from a chunk of places to its gathered values."""
    chunks = entries.groupBy("range", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(gather(F.collect_list(value)).alias("own"))
    return chunks.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "own"))).alias("found"))


def chunk_of(found: str) -> Column:
    return F.try_element_at(found, F.shiftright("pos", CHUNK_BITS))


def count_differences(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """How many digests differ: ``range, found``, a map from chunk and ``code`` to ``only_a, only_b, retries``.

    ``rows`` has one row for each ``range, pos`` (never null) with digest arrays
    (distinct values); ``pairs`` names the arrays to compare.  ``code`` is pos times
    the number of pairs plus the pair's number; equal arrays have no entry.  The
    stored sketches of a pair are subtracted and peeled; a pair that gets stuck is
    tried again with sketches four times as large, until none is: each digest has
    a cell of its own in one that is large enough.  Where ``rows`` is dealt by
    ``range``, only counts are shuffled; they meet the rows by range, in chunks of
    2 ** CHUNK_BITS places, so that a look-up stays short in a range of any length.
    """
    keys, n = ["range", "pos"], len(pairs)
    code = (F.col("pos") * n + F.col("which")).alias("code")
    found = materialise(stored_differences(stored_sketches(rows, keys, pairs), keys, pairs).select(*keys, code, "stuck", "only_a", "only_b"), "sketch-differences")
    done, times = found.where("stuck = 0").withColumn("retries", F.lit(0)), 0
    names = list(dict.fromkeys(x for p in pairs for x in p))
    every = F.array(*(F.struct(F.lit(w).alias("which"), F.col(a).alias("a"), F.col(b).alias("b")) for w, (a, b) in enumerate(pairs)))
    while not (stuck := found.where("stuck > 0")).isEmpty():
        times += 1
        left = F.filter(every, lambda p: F.array_contains(chunk_of("found"), F.col("pos") * n + p["which"]))
        todo = rows.select(*keys, *names).join(by_chunk(stuck, F.col("code"), lambda x: x), "range").select(*keys, F.explode(left).alias("p")).select(*keys, "p.*")
        found = materialise(retried(todo, [*keys, "which"], times).select(*keys, code, "stuck", "only_a", "only_b"), "sketch-differences")
        done = done.unionByName(found.where("stuck = 0").withColumn("retries", F.lit(times)))
    return by_chunk(done, F.struct("code", F.struct("only_a", "only_b", "retries")), F.map_from_entries)


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Shared digests over all digests of two texts; 1 for two empty ones."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differing) / (n_a + n_b + differing))


def with_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int, bool]:
    """Each distinct (key, text) with the text that follows in descending order; buckets; whether rows repeat.

    ``range, pos, key, th, text, own, next_text, next`` (digests); null keys come last, the last row is
    followed by the first.  The order is cut into ranges of some rows, and a
    range's first row goes to the range before it as well, so the texts are
    shuffled once and no window spans more than a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").desc_nulls_last(), F.col("th").desc()]
    ids = rows.groupBy("key", "th").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    ids = materialise(ids.repartitionByRange(own, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sketch-order")
    total, copies, chars = (x or 0 for x in ids.agg(F.count("*"), F.sum("copies"), F.sum("n")).first())
    buckets = min(own * (chars // 20 // BUCKET_DIGESTS // own + 1), max(own, MOST_BUCKETS))
    step = total // (4 * buckets) + 1
    # at most own + 4 * buckets rows: where the ranges begin, in order
    firsts = ids.where(F.col("at").bitwiseAND((1 << 33) - 1) % step == 0).select("key", "th").orderBy(*order).collect()
    if copies > total:  # the same row again: one of each is enough here
        rows = rows.groupBy("key", "th").agg(F.first("text").alias("text")).select("key", "text", "th")
    group = math.isqrt(len(firsts)) + 1
    pairs = [{"k": r[0], "t": r[1]} for r in firsts]
    kind = f"array<struct<k:{dict(rows.dtypes)['key']},t:bigint>>"
    upper = F.from_json(F.lit(json.dumps(pairs[::group], default=str)), kind)
    lower = F.from_json(F.lit(json.dumps([pairs[i : i + group] for i in range(0, len(pairs), group)], default=str)), f"array<{kind}>")
    here = F.struct(F.col("key").alias("k"), F.col("th").alias("t"))  # null keys are the smallest
    rows = rows.withColumn("_group", F.size(F.filter(upper, lambda f: f >= here)) - 1)
    rows = rows.withColumn("_own", F.get(lower, F.col("_group"))).withColumn("_in", F.size(F.filter("_own", lambda f: f >= here)) - 1)
    rows = rows.withColumn("range", (F.col("_group") * group + F.col("_in")).cast("bigint")).withColumn("_first", F.get("_own", F.col("_in")).eqNullSafe(here))
    mine = F.struct(F.col("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, len(firsts)))).alias("range"), F.lit(True).alias("guest"))
    rows = rows.select("key", "th", "text", F.explode(F.when(F.col("_first"), F.array(mine, guest)).otherwise(F.array(mine))).alias("r")).select("r.*", "key", "th", "text")
    rows = rows.repartition(buckets, "range").withColumn("own", paragraph_digests(F.col("text")))
    along = Window.partitionBy("range").orderBy("guest", *order)
    rows = rows.withColumns({"next_text": F.lead("text").over(along), "next": F.lead("own").over(along), "pos": F.row_number().over(along)})
    return rows.where(~F.col("guest")).drop("guest"), buckets, copies > total


def fingerprint_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and likenesses.

    The edited version keeps the first half (rounded up) of a text's code points
    and takes as many as went from the start of the next text in descending
    order of ``key``.  ``near_edited`` and ``near_next`` are the shared digests over
    all digests, from the peeled difference of the fingerprints; ``retries_edited``
    and ``retries_next`` tell how often larger sketches were needed.  A null text
    is an empty one; null keys come last; repeated rows get equal results; with
    one row, that row is its own next.  Whole texts are read.  Other columns of
    ``docs`` are left out.
    """
    placed, buckets, repeats = with_next(docs, key, text)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), F.length("text") - half), F.substr(F.col("next_text"), F.lit(1), half))
    placed = placed.withColumn("edited_text", edited)
    rows = materialise_dealt(
        placed.select("range", "pos", "key", "th", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), "own", paragraph_digests(F.col("edited_text")).alias("edited"), "next"),
        "sketch-digests",
        "range",
        buckets,
    )
    found = count_differences(rows, [("own", "edited"), ("own", "next")])
    out = rows.join(found, "range", "left").withColumns({f"_{w}": F.try_element_at(chunk_of("found"), F.col("pos") * 2 + w) for w in (0, 1)})
    differing = lambda w: F.coalesce(F.col(f"_{w}.only_a") + F.col(f"_{w}.only_b"), F.lit(0).cast("bigint"))
    out = out.select(
        "key",
        "th",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("edited"), differing(0)).alias("near_edited"),
        likeness(F.size("own"), F.size("next"), differing(1)).alias("near_next"),
        F.coalesce("_0.retries", F.lit(0)).alias("retries_edited"),
        F.coalesce("_1.retries", F.lit(0)).alias("retries_next"),
    )
    if repeats:  # each of the equal rows gets the result of its place
        every = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        out = every.join(out, every["k"].eqNullSafe(out["key"]) & (every["t"] == out["th"])).drop("k", "t")
    return out.withColumnRenamed("key", key).drop("th")


def op2_paragraph_sketch(spark, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
