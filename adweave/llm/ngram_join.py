"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles.  Two link if the Jaccard similarity of
their sets reaches a threshold.  The join is exact:

1. every text becomes its shingle set; equal sets are one class;
2. an inverted index over all shingles tells which of them more than one class
   has.  A class can only link if enough of its shingles are shared, so few
   classes are left;
3. in the order from rare to frequent, two linked classes must share one of
   their first shingles; classes that do form clusters;
4. inside a cluster, T-occurrence search (DivideSkip) finds the links: short
   inverted lists are merged in sorted order, long ones probed by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from adweave.llm.common import give_back, materialise, table
from adweave.operators.components import connected_components

WORDS = 5
#: A link needs UP * shared >= DOWN * (all distinct shingles of both).
DOWN, UP = 75, 100
#: Order of a shingle that is too frequent to index: after all others.
FREQUENT = 65535
#: Shingles of a cluster that one task takes at most, and of an index bucket.
CLUSTER_TOKENS = 4_000_000
BUCKET_TOKENS = 1_500_000
#: Documents whose sets a task holds at once.
BLOCK_DOCUMENTS = 3_000


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit codes of a whole text's word shingles.

    A-Z are lower-cased; words stand between spaces and the controls 9 to 13.
    Fewer words than ``width`` make one shingle; none, or a null text, no set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(31)))


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def least_overlap(n: np.ndarray | int):
    """Shingles that a set of ``n`` must share with any set that it links with."""
    return -(-DOWN * n // UP)


def linked(shared: int, n: int, m: int) -> bool:
    return UP * shared >= DOWN * (n + m - shared) and shared > 0


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), BLOCK_DOCUMENTS):
            yield pdf.iloc[k : k + BLOCK_DOCUMENTS]


def _describe(docs: DataFrame) -> DataFrame:
    """``kind`` 0: each document with the size and class of its set; ``kind`` 1:
    shingles that a block of texts has often, with how many of its classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _blocks(batches):
            sets = [shingle_set(t) for t in pdf.text]
            classes = [class_of(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"kind": 0, "doc_id": pdf.doc_id.astype("Int64").array, "th": pdf.th.astype("Int64").array, "n": [len(s) for s in sets], "class": pd.array(classes, dtype="Int64")})
            own = {c: s for c, s in zip(classes, sets, strict=True) if c is not None}
            if own:
                tokens, counts = np.unique(np.concatenate(list(own.values())) >> np.uint64(16), return_counts=True)
                often = counts >= max(4, len(own) // 1000)
                none = pd.array([None] * int(often.sum()), dtype="Int64")
                yield pd.DataFrame({"kind": 1, "doc_id": none, "th": none, "n": counts[often], "class": pd.array(tokens[often].astype(np.int64), dtype="Int64")})
        give_back()

    return docs.mapInPandas(run, "kind int, doc_id long, th long, n long, class long")


def _postings(docs: DataFrame, frequent, buckets: int) -> DataFrame:
    """Blocks of inverted lists by bucket of the shingle code.

    A block holds, for the classes of some texts, the code's 48 bits in two
    arrays and the place of the class in ``classes`` and ``sizes``.  Codes that
    are ``frequent`` aren't indexed: they come as ready rows of one class
    (``kind`` 1), dealt out by the class.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = np.frombuffer(frequent.value, dtype=np.uint64)
        for pdf in _blocks(batches):
            own: dict[int, np.ndarray] = {}
            for t in pdf.text:
                s = shingle_set(t)
                if len(s):
                    own[class_of(s)] = s
            if not own:
                continue
            names, sizes = np.array(list(own), dtype=np.int64), np.array([len(s) for s in own.values()], dtype=np.int32)
            tokens, place = np.concatenate(list(own.values())) >> np.uint64(16), np.repeat(np.arange(len(names), dtype=np.uint16 if len(names) < 65536 else np.uint32), sizes)
            out = []
            if len(often):
                at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                is_often = often[at] == tokens
                keys, whose = tokens[is_often] | np.uint64(FREQUENT << 48), place[is_often]
                cuts = np.flatnonzero(np.diff(whose.astype(np.int64))) + 1
                for piece, k in zip(np.split(keys, cuts), np.split(whose, cuts), strict=True):
                    if len(piece):
                        c = int(names[k[0]])
                        out.append((c % buckets, 1, piece.tobytes(), b"", b"", names[k[:1]].tobytes(), sizes[k[:1]].tobytes(), 0))
                tokens, place = tokens[~is_often], place[~is_often]
            order = np.argsort(tokens, kind="stable")
            tokens, place = tokens[order], place[order]
            bounds = np.searchsorted(tokens, (np.arange(1, buckets, dtype=object) * (1 << 48) // buckets).astype(np.uint64)) if buckets > 1 else np.empty(0, dtype=np.int64)
            for b, (t, p) in enumerate(zip(np.split(tokens, bounds), np.split(place, bounds), strict=True)):
                if len(t):
                    out.append((b, 0, (t >> np.uint64(32)).astype(np.uint16).tobytes(), t.astype(np.uint32).tobytes(), p.tobytes(), names.tobytes(), sizes.tobytes(), p.itemsize))
            yield pd.DataFrame(out, columns=["bucket", "kind", "high", "low", "place", "classes", "sizes", "width"])
        give_back()

    return docs.mapInPandas(run, "bucket int, kind int, high binary, low binary, place binary, classes binary, sizes binary, width int")


def _shared(groups: int):
    """Of one bucket: each class with those of its shingles that another class has too.

    One row for each group of classes, its classes' keys one after the other.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, owners, sizes = [], [], []
        tokens, token_owners, token_sizes = [], [], []
        seen: set[int] = set()
        for r in pdf.itertuples():
            names, n = np.frombuffer(r.classes, dtype=np.int64), np.frombuffer(r.sizes, dtype=np.int32)
            if r.kind == 1:  # copies in several blocks bring equal rows
                if (c := int(names[0])) not in seen:
                    seen.add(c)
                    keys.append(np.frombuffer(r.high, dtype=np.uint64))
                    owners.append(np.repeat(names, len(keys[-1])))
                    sizes.append(np.repeat(n, len(keys[-1])))
                continue
            place = np.frombuffer(r.place, dtype=np.uint16 if r.width == 2 else np.uint32)
            tokens.append((np.frombuffer(r.high, dtype=np.uint16).astype(np.uint64) << np.uint64(32)) | np.frombuffer(r.low, dtype=np.uint32))
            token_owners.append(names[place])
            token_sizes.append(n[place])
        if tokens:
            t, c, n = np.concatenate(tokens), np.concatenate(token_owners), np.concatenate(token_sizes)
            del tokens, token_owners, token_sizes
            order = np.argsort(t, kind="stable")
            t, c, n = t[order], c[order], n[order]
            lengths = np.diff(np.r_[np.flatnonzero(np.r_[True, t[1:] != t[:-1]]), len(t)])
            many = np.repeat(lengths > 1, lengths)
            t, c, n = t[many], c[many], n[many]
            # copies come from several blocks: one posting of each class and shingle
            order = np.lexsort((c, t))
            t, c, n = t[order], c[order], n[order]
            first = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])][: len(t)]
            t, c, n = t[first], c[first], n[first]
            lengths = np.diff(np.r_[np.flatnonzero(np.r_[True, t[1:] != t[:-1]][: len(t)]), len(t)])
            df = np.repeat(lengths, lengths)
            t, c, n, df = t[df > 1], c[df > 1], n[df > 1], df[df > 1]
            keys.append(t | (np.minimum(df, FREQUENT - 1).astype(np.uint64) << np.uint64(48)))
            owners.append(c)
            sizes.append(n)
        out = []
        if keys:
            k, c, n = np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes)
            group = c % groups
            order = np.lexsort((c, group))
            k, c, n, group = k[order], c[order], n[order], group[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)]), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                starts = np.flatnonzero(np.r_[True, c[a + 1 : b] != c[a : b - 1]])
                counts = np.diff(np.r_[starts, b - a]).astype(np.int32)
                out.append((int(group[a]), c[a:b][starts].tobytes(), n[a:b][starts].tobytes(), counts.tobytes(), k[a:b].tobytes()))
        keys = owners = sizes = tokens = None
        give_back()
        return pd.DataFrame(out, columns=["group", "classes", "sizes", "counts", "keys"])

    return run


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one group: the classes that share enough shingles to link, their keys in order."""
    c = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(b, np.int32)) for a, b in zip(pdf.classes, pdf["counts"], strict=True)])
    n = np.concatenate([np.repeat(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(pdf.sizes, pdf["counts"], strict=True)])
    k = np.frombuffer(b"".join(pdf["keys"]), dtype=np.uint64)
    order = np.lexsort((k, c))
    c, n, k = c[order], n[order], k[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, c[1:] != c[:-1]]), len(c)]
    able = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a >= least_overlap(int(n[a]))]
    return pd.DataFrame([(int(c[a]), int(n[a]), b - a, k[a:b].tobytes()) for a, b in able], columns=["class", "n", "s", "keys"])


def _first_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = [np.frombuffer(k, dtype=np.int64)[: len(k) // 8 - least_overlap(n) + 1] for k, n in zip(pdf["keys"], pdf.n, strict=True)]
        yield pd.DataFrame({"key": np.concatenate(parts) if parts else np.empty(0, np.int64), "class": np.repeat(pdf["class"].to_numpy(), [len(p) for p in parts])})


class _Forest:
    def __init__(self, size: int):
        self.up = list(range(size))
        self.trees = size

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.trees -= 1
        return x != y


def divide_skip(keys: list[np.ndarray], sizes: list[int], queries: list[int], indexed: list[int], merge_cost: float = 0.0085) -> list[tuple[int, int]]:
    """Links between the sets ``queries`` and ``indexed`` (places in ``keys``).

    Each set is its shared shingles, rare ones first.  Returns links enough to
    connect all that any links connect: a search leaves out the sets that its
    query is connected with already.  For a query that needs T shingles in
    common, the L longest of its inverted lists are set aside; sets that occur
    T - L times in the short lists, merged in sorted order, are probed in the long
    ones.  L is T / (merge_cost * log2(longest list) + 1).  The merge is a natural
    merge sort of the sorted lists, which makes the same sequence as a heap, in
    arrays.
    """
    forest, links = _Forest(len(keys)), []
    flat = np.concatenate([keys[i] for i in indexed]) if indexed else np.empty(0, np.uint64)
    owner = np.repeat(np.array(indexed, dtype=np.int64), [len(keys[i]) for i in indexed])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def accept(x: int, y: int, shared: int) -> None:
        if linked(shared, sizes[x], sizes[y]) and forest.join(x, y):
            links.append((x, y))

    if indexed:
        # first each against the first one, by probes alone
        pivot = keys[indexed[0]]
        for x in {*queries, *indexed} - {indexed[0]}:
            accept(x, indexed[0], len(np.intersect1d(keys[x], pivot, assume_unique=True)))
        trees: dict[int, int] = {}
        for x in {*queries, *indexed}:
            trees[forest.root(x)] = trees.get(forest.root(x), 0) + 1
        largest = max(trees, key=trees.get)
        if {*indexed} <= {*queries}:  # a link is found from either end
            queries = [x for x in queries if forest.root(x) != largest]
    size_of = np.array(sizes, dtype=np.int64)
    for x in sorted(queries, key=lambda q: sizes[q]):
        if forest.trees == 1:
            break
        low, high = np.searchsorted(flat, keys[x], "left"), np.searchsorted(flat, keys[x], "right")
        lengths = high - low
        by_length = np.argsort(lengths, kind="stable")
        by_length = by_length[lengths[by_length] > 0]
        need = int(least_overlap(sizes[x]))
        if len(by_length) < need:
            continue
        longest = max(2, int(lengths[by_length[-1]]))
        aside = min(need - 1, int(need / (merge_cost * float(np.log2(longest)) + 1)))
        short, long = by_length[: len(by_length) - aside], by_length[len(by_length) - aside :]
        merged = np.sort(np.concatenate([owner[low[k] : high[k]] for k in short]), kind="stable")
        at = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        found, count = merged[at], np.diff(np.r_[at, len(merged)])
        # as many as both sizes ask for; a set that the long lists can't bring there is left out at once
        wanted = -(-DOWN * (sizes[x] + size_of[found]) // (UP + DOWN))
        able = (count >= need - aside) & (count + aside >= wanted) & (found != x) & (DOWN * sizes[x] <= UP * size_of[found]) & (DOWN * size_of[found] <= UP * sizes[x])
        found, count, wanted = found[able], count[able], wanted[able]
        for left, k in enumerate(long):
            if not len(found):
                break
            members = owner[low[k] : high[k]]
            place = np.minimum(np.searchsorted(members, found), len(members) - 1)
            count = count + (members[place] == found)
            able = count + (len(long) - left - 1) >= wanted
            found, count, wanted = found[able], count[able], wanted[able]
        for y, shared in zip(found.tolist(), count.tolist(), strict=True):
            if forest.root(y) != forest.root(x):
                accept(x, y, shared)
    return links


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["class", "is_query"], ascending=[True, False]).reset_index(drop=True)
    first = pdf.drop_duplicates("class")
    names = first["class"].tolist()
    place = {c: i for i, c in enumerate(names)}
    queries = sorted({place[c] for c in pdf["class"][pdf.is_query]})
    indexed = sorted({place[c] for c in pdf["class"][pdf.is_member]})
    links = divide_skip([np.frombuffer(k, dtype=np.uint64) for k in first["keys"]], first.n.tolist(), queries, indexed)
    return pd.DataFrame([(names[a], names[b]) for a, b in links], columns=["a", "b"]).astype("int64")


def _against_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [linked(len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)), n, m) for a, b, n, m in zip(pdf["keys"], pdf.pivot_keys, pdf.n, pdf.pivot_n, strict=True)]
        yield pd.DataFrame({"class": pdf["class"], "pivot": pdf["pivot"], "ok": ok})


def _cluster_links(rows: DataFrame) -> DataFrame:
    """Links among ``rows`` (cluster, class, n, s, keys), each cluster by itself.

    A cluster of up to CLUSTER_TOKENS shingles is one task's.  A larger one is
    split: its sets are compared with one of them (the pivot), and those that
    don't link with it are searched against blocks of all the others.
    """
    totals = rows.groupBy("cluster").agg(F.sum("s").alias("total"), F.min("class").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    rows = rows.join(totals, "cluster")
    yes = F.lit(True)
    small = rows.where(F.col("total") <= CLUSTER_TOKENS).select("cluster", F.lit(0).alias("block"), F.lit(0).alias("part"), "class", "n", "keys", yes.alias("is_query"), yes.alias("is_member"))
    links = "a long, b long"
    found = small.groupBy("cluster", "block", "part").applyInPandas(_search, links)
    large = rows.where(F.col("total") > CLUSTER_TOKENS)
    if large.isEmpty():
        return found
    pivots = large.where(F.col("class") == F.col("pivot")).select("cluster", F.col("keys").alias("pivot_keys"), F.col("n").alias("pivot_n"))
    checked = materialise(large.join(pivots, "cluster").select("class", "pivot", "n", "keys", "pivot_keys", "pivot_n").mapInPandas(_against_pivot, "class long, pivot long, ok boolean"), "join-pivots")
    to_pivot = checked.where(F.col("ok") & (F.col("class") != F.col("pivot"))).select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    asked = large.join(checked.where(~F.col("ok")).select("class"), "class", "left_semi")
    parts = asked.groupBy("cluster").agg((F.floor(F.sum("s") / CLUSTER_TOKENS) + 1).alias("parts"))
    blocks = (F.floor(F.col("total") / CLUSTER_TOKENS) + 1).cast("int")
    of = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), n).cast("int")
    members = large.join(parts, "cluster").select(
        "cluster", of(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), "class", "n", "keys", (~yes).alias("is_query"), yes.alias("is_member")
    )
    queries = asked.join(parts, "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), of(F.col("parts"), 2).alias("part"), "class", "n", "keys", yes.alias("is_query"), (~yes).alias("is_member")
    )
    rest = members.unionByName(queries).groupBy("cluster", "block", "part").applyInPandas(_search, links)
    return found.unionByName(to_pivot).unionByName(rest)


def grouped_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, th, n_shingles, component, component_id`` of every row of ``docs``.

    ``th`` is the text's hash; ``component`` names the group also where keys are
    null or repeat, and is null for texts without a set.  Otherwise as
    ``jaccard_components``.
    """
    return _components(docs, key, text)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` of every row of ``docs``.

    Documents link if their sets of 5-word shingles have a Jaccard similarity of
    0.75 or more; ``component_id`` is the smallest key that links lead to, the
    row's own included.  Null and empty texts have no set and are alone.  Equal
    sets are always together, so copies cost one class, however many there are.
    Rows with a null key take part, but don't name a component.  Repeated rows
    and other columns are fine; the latter are left out.

    Shingles and sets are told apart by 64-bit codes, the index by 48 bits of
    them; two of the same set's shingles falling together is a matter of
    about one document in 10**9.
    """
    return _components(docs, key, text).select(F.col("doc_id").alias(key), "n_shingles", "component_id")


def _components(docs: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    described = materialise(_describe(texts), "join-documents")
    documents = described.where("kind = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), "class")
    total = documents.select(F.sum("n_shingles"), F.count("*")).first()
    # at most some thousand shingles a document's own share times 1000: bounded, whatever the number of documents
    least = max(64, total[1] // 1000)
    often = described.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent = np.sort(np.array([r[0] for r in often.select("class").collect()], dtype=np.int64).astype(np.uint64))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total[0] or 0) // BUCKET_TOKENS + 1)
    index = _postings(texts.select("text"), spark.sparkContext.broadcast(frequent.tobytes()), buckets)
    shared = index.groupBy("bucket").applyInPandas(_shared(buckets), "group int, classes binary, sizes binary, counts binary, keys binary")
    able = shared.groupBy("group").applyInPandas(_gathered, "class long, n long, s long, keys binary")
    rows = materialise(able, "join-candidates")
    firsts = rows.mapInPandas(_first_keys, "key long, class long")
    named = firsts.groupBy("key").agg(F.min("class").alias("rep"), F.count("*").alias("size")).where("size > 1")
    stars = firsts.join(named, "key").select(F.col("class").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    clusters = connected_components(stars).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    links = materialise(_cluster_links(rows.join(clusters, "class")), "join-links")
    components = connected_components(links).select(F.col("node").alias("class"), "component")
    least_ids = documents.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    grouped = least_ids.join(components, "class", "left").withColumn("component", F.coalesce("component", "class"))
    roots = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    names = grouped.join(roots, "component").select(F.col("class").alias("c"), "component", "component_id")
    out = documents.join(names, F.col("class") == F.col("c"), "left")
    return out.select("doc_id", "th", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, the document with the smallest id stays.

    Ids may repeat or be null: of a component's rows the one with the smallest
    (id, text hash) stays, null ids last, and rows that are equal in both count as
    one.  Texts without a word belong to no component, so all of them stay.
    """
    found = materialise(grouped_documents(docs).where("component IS NOT NULL"), "join-kept")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r")).select("r.none", F.coalesce("r.doc_id", F.lit(0)).alias("k"), "r.th")
    keys = {"none": F.col("doc_id").isNull(), "k": F.coalesce(F.col("doc_id"), F.lit(0)), "th": F.xxhash64("text")}
    own = [f"_near_{c}" for c in keys]
    named = docs.withColumns({f"_near_{c}": v for c, v in keys.items()})
    kept = named.join(least.toDF(*own), own, "left_semi")
    rows = found.select(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "th")
    if rows.count() > rows.distinct().count():  # rows with the same id and text
        kept = kept.dropDuplicates(own)
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.drop(*own).unionByName(docs.where(~worded))
