"""Groups of spelling variants: words one insertion, deletion or replacement apart.

Letters are dealt into a few groups, and a word's frequency vector counts its
letters by group.  One edit moves at most one count up and one down, so a trie
of the words by successive counts is walked depth first with a budget of one
surplus and one deficit; the words at the leaves that are reached are verified
letter by letter.  Spark deals the trie's upper branches out: a word is stored
in its own branch and asks for each branch that the budget reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import give_back, materialise, small_frame, table

GROUPS = 12  # of letters: the trie's levels
TOP = 4  # levels that Spark deals out
BITS = 12  # of a count in a branch's number; counts go modulo 4,096
BLOCK = 16_384  # stored words of a branch in one task's trie; a larger branch has several tries
CHUNK = 32_768  # asking words that walk down together
LEAF = 24  # words that are compared without more levels
ROOM = 2_000_000  # entries of a comparison table
WIDE = 64  # letters; longer words are verified one by one
PAD = np.uint32(0xFFFFFFFF)


def runs_of(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(``key``, run) for every maximal run of ``A-Za-z`` and U+00C0 to U+00FF with ``least`` letters or more, ``A-Z`` in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    runs = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    return runs.select(key, F.translate("run", upper, upper.lower()).alias("run"))


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[int, int]:
    """A group for each letter, so that all groups are about equally frequent.

    What is collected is a count for each different code point.
    """
    seen = words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").groupBy("c").agg(F.count("*").alias("n")).collect()
    loads, out = [0] * groups, {}
    for c, n in sorted(((r["c"], r["n"]) for r in seen), key=lambda x: (-x[1], x[0])):
        k = loads.index(min(loads))
        out[ord(c)] = k
        loads[k] += n
    return out


def branch_of(word: Column, of_group: dict[int, int]) -> Column:
    """The number of a word's branch: its counts of the first ``TOP`` groups."""
    number = F.lit(0).cast("long")
    for level in range(TOP):
        letters = "".join(chr(c) for c, k in of_group.items() if k == level)
        # all letters of the group become the first one, which then is counted
        count = F.length(word) - F.length(F.translate(word, letters, "")) if letters else F.lit(0)
        number += F.shiftleft(F.pmod(count, F.lit(1 << BITS)).cast("long"), BITS * level)
    return number


def asked_branches(branch: Column, length: Column) -> Column:
    """The branches where a word may have near words: its own; those with one less in a
    level; and with one more in a later level as well.  A surplus is spent first, so that
    each pair of different vectors is found from one side only."""
    own = lambda level: F.shiftright(branch, BITS * level).bitwiseAND(F.lit((1 << BITS) - 1))
    move = lambda at, level, by: at + F.shiftleft(F.pmod(own(level) + by, F.lit(1 << BITS)) - own(level), BITS * level)
    out = [branch]
    for i in range(TOP):
        less = F.when((own(i) > 0) | (length >= 1 << BITS), move(branch, i, -1))
        out += [less, *(move(less, j, 1) for j in range(i + 1, TOP))]
    return F.filter(F.array(*out), lambda b: b.isNotNull())


class Trie:
    """The stored words of one block, in the order of their vectors: a node is a range of rows and a level."""

    def __init__(self, words: list[str], counts: np.ndarray, of_group: np.ndarray):
        self.of_group = of_group
        vectors, codes, sizes = self.encode(words)
        order = np.lexsort(vectors.T[::-1])
        self.vectors, self.codes, self.sizes = vectors[order], codes[order], sizes[order]
        self.words, self.counts = [words[i] for i in order], counts[order]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, letters (the first ``WIDE``) and lengths."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        row = np.repeat(np.arange(len(words)), sizes)
        vectors = np.bincount(row * GROUPS + self.of_group[flat], minlength=len(words) * GROUPS).reshape(len(words), GROUPS).astype(np.int32)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = np.full((len(words), min(WIDE, int(sizes.max(initial=0))) + 1), PAD, dtype=np.uint32)
        inside = at < codes.shape[1]
        codes[row[inside], at[inside]] = flat[inside]
        return vectors, codes, sizes

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in ``words``, in the trie) of near words."""
        self.asked, self.asking = self.encode(words), words
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        for pairs in self.walk(0, len(self.words), 0, np.arange(len(words)), np.zeros(len(words), dtype=np.int8)):
            self.found.append(pairs)
            self.held += len(pairs[0])
            if self.held * WIDE >= ROOM:
                yield self.verified()
        yield self.verified()

    def walk(self, low: int, high: int, level: int, alive: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Goes down one node with the words that still have budget: ``spent`` is 0, then 1 after
        a surplus, then 2 after a deficit."""
        if high - low <= LEAF or level == GROUPS:
            yield from self.leaf(low, high, level, alive, spent)
            return
        column, own = self.vectors[low:high, level], self.asked[0][alive, level]
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
        for a, b in zip(cuts, cuts[1:], strict=False):
            over = own - column[a]
            stay = (over == 0) | ((over == 1) & (spent == 0)) | ((over == -1) & (spent == 1))
            if stay.any():
                yield from self.walk(low + a, low + b, level + 1, alive[stay], spent[stay] + (over[stay] != 0).astype(np.int8))

    def leaf(self, low: int, high: int, level: int, alive: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose remaining counts keep to the budget."""
        rest = GROUPS - level
        step = max(1, ROOM // 4 // max(1, (high - low) * max(rest, 1)))
        weights = 3 ** np.arange(rest)[::-1]
        for begin in range(0, len(alive), step):
            who, used = alive[begin : begin + step], spent[begin : begin + step, None]
            over = self.asked[0][who, None, level:] - self.vectors[None, low:high, level:]
            moves, total = np.abs(over).sum(2), over.sum(2)
            fits = moves == 0
            fits |= (moves == 1) & (((total == 1) & (used == 0)) | ((total == -1) & (used == 1)))
            # one up and one down, the surplus first
            fits |= (moves == 2) & (total == 0) & (used == 0) & ((over * weights).sum(2) > 0) & (np.abs(over).max(2, initial=0) == 1)
            q, w = np.nonzero(fits)
            if len(q):
                yield who[q], w + low

    def verified(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs kept back that are one edit apart, each pair of words once."""
        if not self.found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        q, w = (np.concatenate(side) for side in zip(*self.found, strict=True))
        self.found, self.held = [], 0
        size, keep = self.asked[2][q], np.zeros(len(q), dtype=bool)
        small = np.flatnonzero(size <= WIDE)
        for begin in range(0, len(small), ROOM // WIDE):
            part = small[begin : begin + ROOM // WIDE]
            keep[part] = self._one_edit(self.asked[1][q[part]], self.codes[w[part]], size[part] - self.sizes[w[part]])
        for k in np.flatnonzero(size > WIDE).tolist():
            keep[k] = one_edit(self.asking[q[k]], self.words[w[k]], self.of_group)
        return q[keep], w[keep]

    def _one_edit(self, ours: np.ndarray, theirs: np.ndarray, longer: np.ndarray) -> np.ndarray:
        wide = max(ours.shape[1], theirs.shape[1])
        fill = lambda m: m if m.shape[1] == wide else np.pad(m, ((0, 0), (0, wide - m.shape[1])), constant_values=PAD)
        ours, theirs = fill(ours), fill(theirs)
        other = ours != theirs
        first, rows = other.argmax(1), np.arange(len(ours))
        a, b = ours[rows, first], theirs[rows, first]
        # words of one vector meet twice: the one with the greater letter counts
        once = (self.of_group[np.where(a == PAD, 0, a)] != self.of_group[np.where(b == PAD, 0, b)]) | (a > b)
        replaced = (longer == 0) & (other.sum(1) == 1) & once
        after = np.arange(wide - 1) >= first[:, None]
        left_out = (longer == 1) & ~((ours[:, 1:] != theirs[:, :-1]) & after).any(1)
        return replaced | left_out


def one_edit(a: str, b: str, of_group: np.ndarray) -> bool:
    """Whether ``a`` is ``b`` with one letter inserted, or with one replaced: by one of another
    group, or by a greater one of its own.  For words too long for a table."""
    if len(a) not in (len(b), len(b) + 1):
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    if len(a) > len(b):
        return a[at + 1 :] == b[at:]
    return at < len(b) and a[at + 1 :] == b[at + 1 :] and (of_group[ord(a[at])] != of_group[ord(b[at])] or a[at] > b[at])


def near_words(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """Each pair of near words in both directions: ``word, near, near_n``.

    ``words`` has one row per word, without nulls or repeats, and its count
    ``n``.  A word has at most (letters + 1) x alphabet near words, so no group
    is all pairs.  A branch with over ``BLOCK`` stored words is split into
    blocks by hash, and its asking words go to each; those branches, of which
    there are at most 1 for each 16,384 words, are broadcast as (branch,
    blocks).  A task holds one block and ``CHUNK`` asking words at a time.
    """
    spark = words.sparkSession
    of_group = letter_groups(words.select(F.col(word).alias("word")))
    if not of_group:
        return small_frame(spark, [], "word string, near string, near_n long")
    table_of = np.zeros(0x110000, dtype=np.int8)
    table_of[list(of_group)] = list(of_group.values())
    shared = spark.sparkContext.broadcast(table_of)  # 1.1 MB: one entry for each code point
    placed = materialise(words.select(F.col(word).alias("word"), F.col(n).alias("n"), branch_of(F.col(word), of_group).alias("branch")), "spelling-words")
    large = placed.groupBy("branch").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    asks = placed.select("word", "n", F.explode(asked_branches(F.col("branch"), F.length("word"))).alias("branch"), F.lit(1).alias("asks"))
    dealt = placed.withColumn("asks", F.lit(0)).unionByName(asks).join(F.broadcast(large), "branch", "left")
    last = F.coalesce("blocks", F.lit(1)) - 1
    own = F.pmod(F.xxhash64("word"), last + 1).cast("int")
    dealt = dealt.select("branch", F.explode(F.when(F.col("asks") == 1, F.sequence(F.lit(0), last)).otherwise(F.array(own))).alias("block"), "asks", "word", "n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // 50_000 + 1)
    dealt = dealt.repartition(parts, "branch", "block").sortWithinPartitions("branch", "block", "asks")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        key, stored, asking, trie = None, ([], []), ([], []), None

        def ask():
            nonlocal trie
            if stored[0] and asking[0]:
                trie = trie or Trie(stored[0], np.array(stored[1], dtype=np.int64), of)
                mine, counts = asking[0], np.array(asking[1], dtype=np.int64)
                for q, w in trie.near(mine):
                    if len(q):
                        there = [trie.words[i] for i in w.tolist()]
                        here = [mine[i] for i in q.tolist()]
                        yield pa.record_batch({"word": pa.array(here + there, pa.string()), "near": pa.array(there + here, pa.string()), "near_n": pa.array(np.concatenate([trie.counts[w], counts[q]]))})
            asking[0].clear()
            asking[1].clear()

        for batch in batches:
            branch, block, asks = (batch.column(k).to_numpy() for k in (0, 1, 2))
            strings, counts = batch.column(3).to_pylist(), batch.column(4).to_numpy()
            cuts = np.flatnonzero((np.diff(branch) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(strings)], strict=True):
                if a == b:
                    continue
                if (branch[a], block[a]) != key:
                    yield from ask()
                    key, stored, trie = (branch[a], block[a]), ([], []), None
                into = asking if asks[a] else stored
                into[0].extend(strings[a:b])
                into[1].extend(counts[a:b].tolist())
                if len(asking[0]) >= CHUNK:
                    yield from ask()
        yield from ask()
        give_back()

    return dealt.mapInArrow(match, "word string, near string, near_n long")


def last_forms(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain, by doubling.

    ``steps`` doublings follow chains of up to 2**steps forms.
    """
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        at = materialise(at, "spelling-roots")
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return at


def group_spellings(words: DataFrame, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of different words and their counts ``n``.

    A word's form is its near word of the largest count, ties by code points,
    if that is at least ``times`` (2 or more) its own; the root is the end of
    the forms.  Words without near words stay, with themselves as root; an
    empty table gives none.  Null words are left out.
    """
    words = materialise(words.select("word", "n").filter("word IS NOT NULL"), "spelling-counts")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    nearest = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    met = words.join(nearest, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    met = materialise(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "spelling-forms")
    # counts grow by ``times`` along a chain, so the largest count bounds its length
    most = words.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log2(max(1, math.log(most) / math.log(times)) + 1))
    roots = last_forms(met.filter("form IS NOT NULL"), steps)
    return met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def planted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, repeats: int = 2) -> DataFrame:
    """The words of ``docs`` and their counts, with the misspellings of the query's contract put in.

    A run loses the letter ``h % length`` where 31 divides h, the checksum of
    ``<key>:<run>``.  A null text has no words; a null key is written as
    nothing.  Words under ``least`` letters or ``repeats`` occurrences go.
    """
    runs = runs_of(docs, key, text, least)
    h = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= repeats)


def op12_spelling_groups(spark, sf_dir: str) -> DataFrame:
    return group_spellings(planted_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), runs AS (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    GROUP BY ALL
), bytes AS (
    SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
                       lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
    FROM bytes, crc
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.d
    UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.d
), nearest AS (
    SELECT p.word, count(*) AS n_near, max(w.n) AS best_n, arg_min(p.near, {'a': -w.n, 'b': p.near}) AS best
    FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
), formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words w LEFT JOIN nearest USING (word)
), chains AS (
    WITH RECURSIVE c AS (
        SELECT word, word AS reached, form AS next, 0 AS depth FROM formed
        UNION ALL SELECT c.word, f.word, f.form, depth + 1 FROM c JOIN formed f ON f.word = c.next
    ) SELECT word, arg_max(reached, depth) AS root FROM c GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chains USING (word)
"""
