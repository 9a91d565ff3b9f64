"""Sharding by best-fit-decreasing bin packing.

Groups that must stay together are packed into shards: sorted by size, each
enters the shard with the least room that still takes it, found in a balanced
tree.  With a fixed number of shards, the least capacity that needs no more is
searched for.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.llm.common import materialise, small_frame, table


class RoomTree:
    """A treap of (room, bin): insert, remove, and the least room from a size on."""

    def __init__(self, seed: int = 11):
        self.root, self.random = None, random.Random(seed)

    def insert(self, key: tuple[int, int]) -> None:
        def put(node, new):
            if node is None:
                return new
            side = 2 if new[0] > node[0] else 1
            node[side] = put(node[side], new)
            if node[side][3] > node[3]:  # rotate the heavier child up
                child = node[side]
                node[side], child[3 - side] = child[3 - side], node
                return child
            return node

        self.root = put(self.root, [key, None, None, self.random.random()])

    def remove(self, key: tuple[int, int]) -> None:
        def merge(a, b):
            if a is None or b is None:
                return a or b
            if a[3] > b[3]:
                a[2] = merge(a[2], b)
                return a
            b[1] = merge(a, b[1])
            return b

        def drop(node):
            if node[0] == key:
                return merge(node[1], node[2])
            side = 2 if key > node[0] else 1
            node[side] = drop(node[side])
            return node

        self.root = drop(self.root)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        return found


def best_fit_classes(classes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """For each class (size, count): the bins that take its items, as (bin, number).

    Best-fit-decreasing: the largest size first, each item into the bin with the
    least room that takes it.  A bin that took an item of a size is still the
    tightest one for the next of that size, so it takes as many at once as fit.
    An item over the capacity gets a bin of its own.  Ties go by place.
    """
    tree, out, number = RoomTree(), [[] for _ in classes], 0
    for i in sorted(range(len(classes)), key=lambda i: (-classes[i][0], i)):
        size, left = classes[i]
        while left:
            spot = tree.tightest(size)
            if spot is None:
                spot, number = (max(capacity, size), number), number + 1
            else:
                tree.remove(spot)
            fit = min(left, spot[0] // size) if size else left
            out[i].append((spot[1], fit))
            left -= fit
            tree.insert((spot[0] - fit * size, spot[1]))
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item."""
    return [bins[0][0] for bins in best_fit_classes([(size, 1) for size in sizes], capacity)]


def pack_into(classes: list[tuple[int, int]], shards: int, tries: int = 8) -> list[list[tuple[int, int]]]:
    """Bins 0 to ``shards`` - 1 with nearly equal loads, as (bin, number) for each class (size, count).

    An item larger than an equal share of what is left has a bin to itself.  The
    others are packed by best fit, with the least capacity found that needs no
    more bins, and then levelled.
    """
    order = sorted(range(len(classes)), key=lambda i: (-classes[i][0], i))
    out: list[list[tuple[int, int]]] = [[] for _ in classes]
    total, free, left = sum(size * count for size, count in classes), shards, [count for _, count in classes]
    for i in order:
        while left[i] and free > 1 and classes[i][0] * free > total:
            free -= 1
            out[i].append((free, 1))
            total, left[i] = total - classes[i][0], left[i] - 1
    rest = [(classes[i][0], left[i]) for i in order if left[i]]
    bins = level(rest, _least_capacity(rest, free, tries), free)
    for i, own in zip((i for i in order if left[i]), bins, strict=True):
        out[i] += own
    return out


def _least_capacity(classes: list[tuple[int, int]], shards: int, tries: int) -> list[list[tuple[int, int]]]:
    total = sum(size * count for size, count in classes)
    low = max(-(-total // shards), max((size for size, _ in classes), default=0))
    high, best = low, None
    while best is None:
        bins = best_fit_classes(classes, high)
        if max((b for own in bins for b, _ in own), default=-1) < shards:
            best = bins
        else:
            low, high = high + 1, high + max(1, high // 2000) * (1 if high < 1.02 * total / shards else 20)
    for _ in range(tries):
        if low >= high:
            break
        middle = (low + high) // 2
        bins = best_fit_classes(classes, middle)
        if max((b for own in bins for b, _ in own), default=-1) < shards:
            best, high = bins, middle
        else:
            low = middle + 1
    return best


def level(classes: list[tuple[int, int]], bins: list[list[tuple[int, int]]], shards: int) -> list[list[tuple[int, int]]]:
    """``bins`` with items moved from the fullest to the emptiest one as long as that brings them closer.

    Best fit fills one bin after the other, so the last ones may be left empty.
    Each step moves the items of one class that come closest to half the
    difference; it ends where no item is smaller than the difference.
    """
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for i, own in enumerate(bins):
        for b, number in own:
            held[b][i] = held[b].get(i, 0) + number
    loads = [sum(classes[i][0] * n for i, n in own.items()) for own in held]
    while shards > 1:
        top, low = max(range(shards), key=lambda b: (loads[b], -b)), min(range(shards), key=lambda b: (loads[b], b))
        gap = loads[top] - loads[low]
        moves = [(i, max(1, min(n, gap // 2 // classes[i][0]))) for i, n in held[top].items() if 0 < classes[i][0] < gap]
        if not moves:
            break
        i, number = min(moves, key=lambda m: (abs(gap - 2 * m[1] * classes[m[0]][0]), m[0]))
        held[top][i] -= number
        if not held[top][i]:
            del held[top][i]
        held[low][i] = held[low].get(i, 0) + number
        loads[top], loads[low] = loads[top] - number * classes[i][0], loads[low] + number * classes[i][0]
    out: list[list[tuple[int, int]]] = [[] for _ in classes]
    for b, own in enumerate(held):
        for i, number in sorted(own.items()):
            out[i].append((b, number))
    return out


#: Leading bits of a group's bytes that its size class keeps: classes differ by 1 in 2,048 at most.
CLASS_BITS = 12


def size_class(size: Column) -> Column:
    """``size`` rounded up to CLASS_BITS leading bits; exact up to 4,095 bytes."""
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)))) - (CLASS_BITS - 1))).cast("bigint")
    return (F.ceil(size / step) * step).cast("bigint")


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str, rows: int, rows_per_part: int = 100_000) -> DataFrame:
    """``df`` with the row's rank in its group, from 0, as ``name``; ``rows`` is its number of rows.

    A group of any size is split by a hash of ``order``, which tells all rows
    apart: rows are numbered in each split, and the splits before it are added.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(rows // rows_per_part + 1)))
    sizes = salted.groupBy(*group, "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_salt")) - F.col("_n")).drop("_n")
    own = salted.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order)) - 1)
    return own.join(before, [*group, "_salt"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_salt", "_own", "_before")


#: Groups with over this part of all rows, fewer than as many, find their shard without a shuffle.
HOT_GROUPS = 1000


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    The law is ``bytes``: sizes (UTF-8 bytes of the text and ``overhead``) of the
    shards come out nearly equal.  Rows with equal texts are a group and always
    share a shard: a group that alone is larger than an equal share has a shard to
    itself, and the other shards are equal among themselves.  The shards differ by the
    largest group's size at most, and by its class's rounding.

    What is packed is the histogram of the groups' size classes, at most 2 ** 11
    for each doubling of size.  A group finds its shard by its rank in the class.

    A null text is an empty one.  Null keys and repeated rows are placed like any
    others; other columns are left out; an empty table gives no rows.  ``slot``
    numbers a shard's rows from 0; ``grown_shard`` is null under this law.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("crc"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "shard-rows")
    group = ["h", "crc", "size"]
    groups = rows.groupBy(*group).agg(F.count("*").alias("n"))
    groups = materialise(groups.withColumn("class", size_class(F.col("n") * F.col("size"))), "shard-groups")
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("n").alias("rows")).orderBy("class").collect()
    count, many = sum(r["rows"] for r in histogram), sum(r["n"] for r in histogram)
    spans = []
    for r, own in zip(histogram, pack_into([(r["class"], r["n"]) for r in histogram], shards), strict=True):
        ends = [sum(n for _, n in own[:i]) for i in range(len(own))]
        spans.append((r["class"], [(first, b) for first, (b, _) in zip(ends, own, strict=True)]))
    shard = F.element_at(F.filter("spans", lambda p: p["first"] <= F.col("rank")), -1)["shard"]
    by_class = F.broadcast(small_frame(spark, spans, "class long, spans array<struct<first:long,shard:int>>"))  # as many as classes
    placed = rank_within(groups, ["class"], group, "rank", many).join(by_class, "class").select(*group, "n", shard.alias("shard"))
    placed = materialise(placed, "shard-places")
    hot = F.broadcast(placed.where(F.col("n") * HOT_GROUPS > count).select(*group, F.col("shard").alias("hot_shard")))
    met = rows.join(hot, group, "left")
    own = met.where("hot_shard IS NULL").join(placed, group).select("key", "size", "crc", "row", "shard")
    out = materialise(met.where("hot_shard IS NOT NULL").select("key", "size", "crc", "row", F.col("hot_shard").alias("shard")).unionByName(own), "shard-placed")
    out = rank_within(out, ["shard"], ["row"], "slot", count)
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
