"""Best-fit packing of token sequences by a configuration linear program.

The lengths of all pieces become a histogram.  Over it, the configuration
program (how often to use each way of filling a sequence) is solved by
multiplicative weights, where a knapsack dynamic program prices the next
configuration.  The solution is rounded down, and the program is solved again
in whole amounts for what that leaves.  Every piece is placed by its rank among
the pieces of its length.  Only the histogram reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adweave.llm.common import give_back, materialise, small_frame, table

CAPACITY = 2048
END_ID = 0
#: Bytes of words and ids that a worker remembers, about, in each of two generations.
REMEMBERED_BYTES = 64_000_000
#: What a word takes besides its own bytes and those of its ids.
ENTRY_BYTES = 170
#: Words that stay remembered from one task to the next, some 20 MB.
KEPT_WORDS = 100_000


#: Marks that end a word of letters or digits are a token of their own.  Left out
#: are the apostrophe, which may begin one, and the marks of special tokens.
ENDS = re.compile(rb"(?<=[a-z0-9])([!-&(-/:;=?@\[-`{}~]+)(?=[ \n])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit, found when first asked for.

    Two generations: when the younger holds REMEMBERED_BYTES it becomes the
    older, from which words that are asked for again are taken over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.older, self.held = Tokenizer.from_file(path), {}, 0
        words_apart(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = ids
        self.held += len(word) + len(ids) + ENTRY_BYTES
        return ids

    def end_task(self) -> None:
        """Keeps only the words met first, among which are the frequent ones."""
        first = dict(islice({**self.older, **self}.items(), KEPT_WORDS))
        self.clear()
        self.update(first)
        self.older, self.held = {}, sum(len(w) + len(ids) + ENTRY_BYTES for w, ids in first.items())

    def settle(self) -> None:
        if self.held > REMEMBERED_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()


def words_apart(tokenizer) -> None:
    """Refuses a tokenizer whose ids of a text aren't those of its lower-cased words."""
    sample = "Ab'c, (De) f-g.  \nH1 i's! ÄÖ ß,\tx"
    # the same split that ``token_bytes`` makes, compared with the whole text's ids
    words = ENDS.sub(rb" \1", sample.encode().lower()).split()
    apart = [i for w in words for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids]
    if apart != tokenizer.encode(sample, add_special_tokens=False).ids:
        raise ValueError("this tokenizer doesn't lower-case, or joins what white space parts: it can't be used word by word")


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Each whole text's ids as little-endian unsigned 32-bit, the end id last.

    The tokenizer lower-cases, and never joins what white space parts, so words
    are encoded one by one and remembered.
    """
    known, end = word_ids(path), np.array([END_ID], dtype="<u4").tobytes()
    out = [b"".join(map(known.__getitem__, ENDS.sub(rb" \1", (t or "").encode("utf-8", "surrogatepass").lower()).split())) + end for t in texts]
    known.settle()
    return out


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """``key, row, piece, start, length, ids_crc32``: documents cut into pieces.

    Only documents longer than ``capacity`` are cut.  ``row`` numbers the rows,
    so that rows with the same key stay apart.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):  # so that the ids of few texts are held at once
                own, out = pdf.iloc[k : k + 256], []
                for name, row, ids in zip(own["key"], own["row"], token_bytes(own["text"].tolist(), path), strict=True):
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((name, row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                frame = pd.DataFrame(out, columns=["key", "row", "piece", "start", "length", "ids_crc32"])
                frame["key"] = frame["key"].astype("Int64")
                yield frame
        word_ids(path).end_task()
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key long, row long, piece int, start long, length long, ids_crc32 long")


def price(values: np.ndarray, lengths: np.ndarray, limits: np.ndarray, capacity: int, tolerance: float) -> tuple[np.ndarray, float]:
    """A most valuable configuration, and a bound that no configuration's value exceeds.

    A bounded knapsack: of each length at most ``limits`` pieces.  The dynamic
    program takes the lengths in the order of value per token and ends where its
    value comes within ``tolerance`` of a sequence filled at the best value per
    token; otherwise it takes all, and the configuration is the best one.
    """
    open_ = np.flatnonzero((limits > 0) & (values > 0))
    density = values[open_] / lengths[open_]
    mixed = np.random.default_rng(5).permutation(len(lengths))[open_]  # ties in no order of length, so that few fill a sequence
    order, top = open_[np.lexsort((mixed, -density))], capacity * float(density.max(initial=0.0))
    best, taken = np.zeros(capacity + 1), []
    for at in range(0, len(order), 32):
        for i in order[at : at + 32].tolist():
            left, some, length, value = min(int(limits[i]), capacity // int(lengths[i])), 1, int(lengths[i]), float(values[i])
            while left > 0:  # numbers of pieces in powers of two make up any number
                number = min(some, left)
                with_it = best[: -number * length] + number * value
                better = with_it > best[number * length :]
                np.maximum(best[number * length :], with_it, out=best[number * length :])
                taken.append((i, number, number * length, better))
                left -= number
                some *= 2
        if best[-1] >= (1 - tolerance) * top:
            break
    else:
        top = float(best[-1])
    counts, room = np.zeros(len(lengths), dtype=np.int64), capacity
    for i, number, tokens, better in reversed(taken):
        if room >= tokens and better[room - tokens]:
            counts[i] += number
            room -= tokens
    return counts, top


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, whole: bool, tilt: float = 0.0, rate: float = 0.5, tolerance: float = 0.01) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations and amounts that cover ``counts`` exactly, and a lower bound on the amounts' sum.

    Multiplicative weights: a length's weight is its tokens (to the power of
    1 + ``tilt``, which favours long pieces) times exp(-rate * covered share).
    The knapsack finds the configuration that covers most weight, it is used
    until one of its lengths is covered, and the weights fall.  Covered
    lengths have no weight any more, so nothing is covered twice.  The weights
    of any round, divided by the price's bound, solve the dual program: the
    largest of their values bounds the program from below.  With ``whole`` all
    amounts are whole numbers.
    """
    left, used, bound = counts.astype(float), [], 0.0
    while (on := left > 1e-9).any():
        weight = np.where(on, (lengths / capacity) ** (1 + tilt) * np.exp(-rate * (1 - left / counts)), 0.0)
        limits = np.where(on, np.maximum(1.0, np.floor(left + 1e-9)), 0.0).astype(np.int64)
        config, top = price(weight, lengths, limits, capacity, tolerance)
        bound = max(bound, float((counts * weight).sum()) / top)
        has = config > 0
        amount = float((left[has] / config[has]).min())
        if whole:
            amount = max(1.0, np.floor(amount + 1e-9))
        left[has] = np.maximum(0.0, left[has] - amount * config[has])
        used.append((config, amount))
    return used, bound


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go, and how good that is.

    ``moves``: ``(length, rank, number, sequence, offset)``; the pieces of ``length``
    with ranks from ``rank`` on, ``number`` of them, go to the sequences from
    ``sequence`` on, each at ``offset``.  ``program`` is the value of the fractional
    solution, ``bound`` a lower bound on any packing (from the dual), ``rounded``
    the share of pieces that the rounded solution places; the rest is placed by
    the whole amounts of the second solution.
    """

    moves: list[tuple[int, int, int, int, int]]
    sequences: int
    program: float
    bound: float
    rounded: float


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = 0.002, tilts: tuple[float, ...] = (0.0, 0.03, 0.1, 0.3)) -> Plan:
    """The plan for a histogram of lengths from 1 to ``capacity``.

    The program is solved and rounded with one tilt of the weights after the
    other; the plan with the fewest sequences is taken, at once where it has as
    few as the bound allows any packing.  The first two are always tried, the
    costlier others only where the best plan is over ``gap`` above the bound.  The plan's
    size depends on the number of lengths, not on the pieces.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    if not len(lengths):
        return Plan([], 0, 0.0, 0.0, 1.0)
    best, bound, program = None, 0.0, float("inf")
    for k, tilt in enumerate(tilts):
        used, low = cover(lengths, counts, capacity, False, tilt)
        bound, program = max(bound, low), min(program, float(sum(x for _, x in used)))
        rounded = [(config, int(amount + 1e-9)) for config, amount in used]
        left = counts - sum(config * times for config, times in rounded)
        rest = np.flatnonzero(left)
        for config, amount in cover(lengths[rest], left[rest], capacity, True, tilt)[0]:
            full = np.zeros(len(lengths), dtype=np.int64)
            full[rest] = config
            rounded.append((full, int(amount)))
        sequences = sum(times for _, times in rounded)
        if best is None or sequences < best[0]:
            best = sequences, rounded, 1 - float(left.sum() / counts.sum())
        if best[0] <= np.ceil(bound - 1e-9) or (k > 0 and best[0] <= (1 + gap) * bound):
            break
    taken, moves, sequence = np.zeros(len(lengths), dtype=np.int64), [], 0
    for config, times in best[1]:
        if not times:
            continue
        offset = 0
        for i in np.flatnonzero(config)[::-1].tolist():
            for _ in range(int(config[i])):
                moves.append((int(lengths[i]), int(taken[i]), times, sequence, offset))
                taken[i] += times
                offset += int(lengths[i])
        sequence += times
    return Plan(moves, sequence, program, bound, best[2])


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_rank: int = 100_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``key, row, piece, length``.

    Ranks within a length come from windows over (length, salt), so that a
    length which most pieces have isn't one task's; the salts' counts are added
    up by length.  Lengths run from 1 to ``capacity``, so the plan is small.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(histogram, capacity)
    if not plan.moves:
        return pieces.withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint"))
    salts = small_frame(spark, [(k, n // rows_per_rank + 1) for k, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # at most some slots for each length and configuration
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, number, sequence, offset in plan.moves:
        slots.setdefault(length, []).append((rank, number, sequence, offset))
    places = small_frame(spark, [(k, v) for k, v in slots.items()], "length long, slots array<struct<rank:long,number:long,sequence:long,offset:long>>")
    picked = F.filter("slots", lambda s: (F.col("rank") >= s["rank"]) & (F.col("rank") < s["rank"] + s["number"]))[0]
    out = ranked.join(F.broadcast(places), "length").withColumn("_slot", picked)
    out = out.withColumn("sequence_id", F.col("_slot.sequence") + F.col("rank") - F.col("_slot.rank")).withColumn("offset", F.col("_slot.offset"))
    return out.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """One row for each piece of each document, with its place in a sequence.

    ``key, piece, start, length, ids_crc32, sequence_id, offset``.  A document is
    its ids and an end id, so a null or empty text is one piece of one token.
    Whole texts are tokenized.  Repeated rows and null keys are packed as rows of
    their own; other columns are left out; an empty table gives no pieces.
    """
    pieces = materialise(token_pieces(docs, key, text, capacity, tokenizer), "pack-pieces")
    out = pack(pieces, capacity)
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents that are left."""
    return pack_documents(docs)
