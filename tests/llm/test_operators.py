"""The ten operators on small tables: brute force, round trips, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adweave.llm import chat_format, language_id, line_cleaning, mixing, ngram_join, packing, paragraph_sketch, secrets, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, pos int"
WORDS = "alpha beta gamma delta omega sigma lamda kappa zeta theta iota rho tau phi chi psi".split()


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randint(0, 40)) for _ in range(n)) + "."


def table(spark, texts):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 7) for i, t in texts], DOCS)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é ß 漢字 \U0001f600"), (6, prose(1, 300)), (7, prose(1, 300)), (8, prose(1, 300) + " more"), (None, prose(2, 60)), (9, "<turn> & \\ </turn>"), (9, "<turn> & \\ </turn>"), (10, prose(3, 4000)),
]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_language(spark):
    de = [(i, "der die und nicht mit " + prose(i, 60, ["und", "der", "schein", "keit", "lich"])) for i in range(100, 160)]
    en = [(i, "the and of with was " + prose(i, 60, ["the", "and", "thing", "ation", "with"])) for i in range(200, 260)]
    docs = spark.createDataFrame([(i, t, "de") for i, t in de] + [(i, t, "en") for i, t in en] + [(1, "x", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs, samples=32)
    assert model.languages == ("de", "en")
    out = {r["doc_id"]: r for r in rows(language_id.identify_language(docs, model))}
    assert all(out[i]["lang_pred"] == "de" and out[i]["lang_accepted"] for i, _ in de) and all(out[i]["lang_pred"] == "en" for i, _ in en)
    odd = rows(language_id.identify_language(table(spark, ODD), model))
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = language_id.fit_language_model(docs.limit(0))
    assert rows(language_id.identify_language(table(spark, ODD[3:4]), none))[0]["lang_pred"] == "und"


def sketch_brute(texts):
    order = sorted(set(texts), key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = {}
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[k] = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    return out


def test_sketch(spark):
    texts = [x for x in ODD if x != ODD[-2]]  # ties of equal keys and texts are one place
    out = rows(paragraph_sketch.fingerprint_versions(table(spark, texts)))
    want = sketch_brute(texts)
    assert len(out) == len(texts) and all(r["edited_sha256"] == want[r["doc_id"]] for r in out)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[6]["fingerprint"] == by[7]["fingerprint"] and by[7]["near_next"] == 1.0 and 0 < by[8]["near_next"] < 1
    assert by[10]["near_edited"] > 0.2
    repeated = rows(paragraph_sketch.fingerprint_versions(table(spark, ODD)))
    assert len(repeated) == len(ODD)


def pieces_of(t):
    return set(re.findall(r"[^\n.!?]{0,160}+[.!?]+|[^\n.!?]{1,160}", t or ""))


def test_sketch_likeness_is_that_of_the_digests(spark):
    texts = [(i, "\n".join(prose(r, random.Random(r).randint(1, 60)) for r in random.Random(i).sample(range(40), random.Random(i).randint(0, 25)))) for i in range(120)]
    out = {r["doc_id"]: r for r in rows(paragraph_sketch.fingerprint_versions(table(spark, texts)))}
    order = sorted(texts, reverse=True)
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        for name, other in (("near_edited", t[: len(t) - half] + nxt[:half]), ("near_next", nxt)):
            a, b = pieces_of(t), pieces_of(other)
            assert abs(out[k][name] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
        assert out[k]["n_chars"] == len(t)
    assert {r["retries_edited"] for r in out.values()} >= {0} and max(r["retries_next"] for r in out.values()) > 0
    assert rows(paragraph_sketch.fingerprint_versions(table(spark, ODD).limit(0))) == []


def test_stored_sketch_holds_what_it_says(spark):
    df = spark.createDataFrame([(k, random.Random(k).sample(range(-(10**9), 10**9), n)) for k, n in enumerate([0, 1, 5, 300])], "k int, d array<long>")
    df = df.select("d", paragraph_sketch.fingerprint(F.col("d")).alias("f"), F.transform("d", lambda d: paragraph_sketch.checksum(d)).alias("h"))
    for r in df.collect():
        cells, _, filled = r["f"].partition(";")
        parsed = [[int(x[0]), int(x[1]), int(x[2], 16), int(x[3], 16)] for x in (c.split(":") for c in filled.split(",") if c)]
        assert [c[0] for c in parsed] == sorted(c[0] for c in parsed) and 3 * int(cells) >= 2 * len(r["d"])
        for j in range(3):
            own = [c for c in parsed if c[0] // int(cells) == j]
            assert sum(c[1] for c in own) == len(r["d"])
            for at, values in ((2, r["d"]), (3, r["h"])):
                want = got = 0
                for v in values:
                    want ^= v & (2**64 - 1)
                for c in own:
                    got ^= c[at]
                assert want == got


def test_sketch_differences_are_exact(spark):
    r = random.Random(3)
    data = []
    for k in range(60):
        a = {r.getrandbits(62) for _ in range(r.choice([0, 1, 3, 20, 400]))}
        b = set(r.sample(sorted(a), len(a) // 2)) | {r.getrandbits(62) for _ in range(r.choice([0, 2, 30]))}
        data.append((k % 3, k, sorted(a), sorted(b)))
    df = spark.createDataFrame(data, "range long, pos int, a array<long>, b array<long>")
    got = {code: (v["only_a"], v["only_b"]) for x in rows(paragraph_sketch.count_differences(df, [("a", "b")])) for chunk in x["found"].values() for code, v in chunk.items()}
    assert all(got.get(k, (0, 0)) == (len(set(a) - set(b)), len(set(b) - set(a))) for _, k, a, b in data)


def test_toxicity(spark):
    docs = [(i, prose(i, 80) + (" you idiot " if i % 4 == 0 else " you friend ") + prose(-i, 50)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(table(spark, docs), labels)
    out = {r["doc_id"]: r for r in rows(toxicity.score_toxicity(table(spark, docs), model))}
    assert np.mean([out[i]["predicted"] == int(i % 4 == 0) for i in range(300, 400)]) > 0.95
    odd = rows(toxicity.score_toxicity(table(spark, ODD), model))
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    flat = toxicity.fit_toxicity(table(spark, docs), labels.where("toxic = 0"))
    assert rows(toxicity.score_toxicity(table(spark, docs[:1]), flat))[0]["predicted"] == 0


def check_shards(out, shards):
    for s in range(shards):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))


def shard_loads(out, shards):
    """Bytes of each shard, after checking that slots are gapless and equal texts together."""
    check_shards(out, shards)
    by = {}
    for r in out:
        by.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(v) == 1 for v in by.values())
    return np.bincount([r["shard"] for r in out], weights=[r["size"] for r in out], minlength=shards)


def test_sharding(spark):
    texts = [*ODD, *((i, prose(i, 40)) for i in range(1000, 1400)), *((i, "copy " * 50) for i in range(2000, 2900))]
    out = rows(sharding.shard_documents(table(spark, texts), shards=6))
    assert len(out) == len(texts) and {r["shard"] for r in out} == set(range(6))
    size = shard_loads(out, 6)
    copies = 900 * 266
    assert sorted(size)[-1] == copies  # a group over a share has a shard to itself, the others are level
    others = sorted(size)[:-1]
    assert others[-1] - others[0] <= max(r["size"] for r in out if r["size"] != 266)
    assert rows(sharding.shard_documents(table(spark, ODD).limit(0))) == []


@pytest.mark.parametrize("seed", range(4))
def test_shards_are_level_with_few_large_texts(spark, seed):
    """All shards are used where there are as many groups, and differ by the largest group at most."""
    r = random.Random(seed)
    lengths = [r.choice([5, 50, 500, 5000, 20_000 if seed else 100]) for _ in range(r.choice([45, 120, 400]))]
    texts = [(i, chr(97 + i % 26) * n + str(i)) for i, n in enumerate(lengths)] + [(5000 + i, "hot row") for i in range(300 if seed == 2 else 3)]
    out = rows(sharding.shard_documents(table(spark, texts), shards=40))
    size = shard_loads(out, 40)
    groups = {}
    for x in out:
        groups[x["text_crc32"]] = groups.get(x["text_crc32"], 0) + x["size"]
    assert size.min() > 0 and size.max() - size.min() <= max(groups.values())


def test_pack_into_levels():
    r = random.Random(6)
    for _ in range(60):
        classes = [(s, r.randint(1, 30)) for s in {r.choice([r.randint(1, 50), r.randint(1, 5000)]) for _ in range(r.randint(1, 25))}]
        shards = r.randint(1, 12)
        bins = sharding.pack_into(classes, shards)
        loads = [0] * shards
        for (size, count), own in zip(classes, bins, strict=True):
            assert sum(n for _, n in own) == count and len({b for b, _ in own}) == len(own)
            for b, n in own:
                loads[b] += n * size
        assert max(loads) - min(loads) <= max(s for s, _ in classes)
    assert sharding.pack_into([], 4) == []


def test_best_fit():
    r = random.Random(5)
    sizes = [r.randint(1, 60) for _ in range(400)]
    room, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(left, b) for b, left in enumerate(room) if left >= sizes[i]]
        if fits:
            _, b = min(fits)
        else:
            b = len(room)
            room.append(100)
        room[b] -= sizes[i]
        want.append((i, b))
    assert sharding.best_fit_decreasing(sizes, 100) == [b for _, b in sorted(want)]


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a <b> & \\ </turn>\n"), (1, 1, "assistant", "x\ny"), (1, 2, "assistant", None), (2, None, None, ""), (None, 3, "assistant", "&lt;"), (1, 1, "assistant", "x\ny")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")))
    for r in rows(out):
        own = sorted((t for t in turns if t[0] == r["conv_id"]), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in own]
        assert r["loss"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
    assert rows(chat_format.format_chats(df.limit(0).withColumn("parts", chat_format.text_part(F.col("text"))))) == []


def test_chat_parts(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", None), ("strange", "t", None, None)])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = rows(chat_format.format_chats(df))[0]
    assert r["formatted"] == "<turn user>see &lt;<image 0><audio 1>t</turn>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 768), ("audio", "b.wav", 25)] and r["expanded_tokens"] == 793


def test_mixing(spark):
    docs = [(i, prose(i, 60, ["good", "fine"] if i % 3 else ["bad", "ugly"])) for i in range(300)]
    labelled = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(200)] + [(None, "a"), (3, None)], "doc_id long, domain string")
    model = mixing.fit_domains(table(spark, docs), labelled)
    out = rows(mixing.mix(table(spark, docs), model, {"a": 0.5, "b": 0.5}))
    total = sum(r["rate"] * r["tokens"] * np.array(r["posterior"]) for r in out)
    assert all(r["rate"] >= 0 for r in out) and abs(total[0] / total.sum() - 0.5) < 0.01
    odd = rows(mixing.mix(table(spark, ODD), model, {"a": 1.0, "b": 0.0}))
    assert len(odd) == len(ODD)
    assert rows(mixing.mix(table(spark, ODD).limit(0), model, {"a": 1.0})) == []


def test_mixing_copies_meet_targets(spark):
    docs = table(spark, [(i, prose(i, 60, ["good", "fine"] if i % 2 else ["bad", "ugly"])) for i in range(4000)])
    labelled = spark.createDataFrame([(i, "ab"[i % 2 == 0]) for i in range(200)], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labelled)

    def share(out):
        total = sum(r["copies"] * r["tokens"] * np.array(r["posterior"]) for r in out)
        return total[1] / total.sum()

    for b in (0.04, 0.46):  # rates under 0.1, and rates within 0.1 of 1
        assert abs(share(rows(mixing.mix(docs, model, {"a": 1 - b, "b": b}))) - b) < 0.012
    # rates held at bounds: a stays whole, b keeps a share within the old snap
    out = rows(mixing.mix(docs, model, {"a": 1.0, "b": 0.08}, keep=1.0))
    assert all(r["copies"] == 1 for r in out if r["posterior"][0] > 0.5) and all(0 <= r["rate"] <= 1 for r in out)
    aim = sum(r["tokens"] * (1.0 if r["posterior"][0] > 0.5 else 0.08) * np.array(r["posterior"]) for r in out)
    assert np.allclose(sum(r["rate"] * r["tokens"] * np.array(r["posterior"]) for r in out), aim, atol=2e-4 * aim.sum())
    assert abs(share(out) - aim[1] / aim.sum()) < 0.012


def line_brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at, seen = {}, set()
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            seen |= {p + j for p in places for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(seen)


def test_lines(spark):
    r = random.Random(1)
    texts = [*ODD, *((i, "".join(r.choice(["a ", "b ", "c\n", "a b c ", "\x0b", "#", "| ", "é "]) for _ in range(r.randint(0, 90)))) for i in range(100, 200))]
    out = rows(line_cleaning.clean_lines(table(spark, texts)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(x["doc_id"]), *(x[n] for n in names), x["base_failed"]) for x in out)
    want = sorted((str(i), *(b := line_brute(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in texts)
    assert got == want and not any(x["kept"] and x["base_failed"] for x in out)
    bad = "\n".join(["home | about | help | more | next"] * 3 + [f"w{i}$$$ x{i}%%% y{i}*** z{i}&&& v{i}###" for i in range(30)])
    good = "\n".join([prose(i, 20) for i in range(5)] + ["All rights reserved."])
    out = {x["doc_id"]: x for x in rows(line_cleaning.clean_lines(table(spark, [(1, bad), (2, good)])))}
    assert not out[1]["kept"] and out[2]["kept"] and "rights" not in out[2]["cleaned_text"]


def test_packing(spark):
    texts = [*ODD, *((i, prose(i, random.Random(i).randint(1, 900))) for i in range(100, 200))]
    out = rows(packing.pack_documents(table(spark, texts)))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted((str(i), k, k * 2048, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, x in texts for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 0]] for k, p in enumerate(ids[j : j + 2048] for j in range(0, len(ids), 2048)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    fill = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(r["length"] for r in out) // 2048) + 1
    assert rows(packing.pack_documents(table(spark, ODD).limit(0))) == []


def test_packing_plan_comes_from_the_program():
    r = random.Random(4)
    for histogram in ({k: r.randint(1, 40) for k in r.sample(range(1, 2049), 300)}, {1500: 7, 1: 3}, {2048: 3}, {1: 10_000}, {700: 10, 701: 11, 647: 12}):
        plan = packing.plan_sequences(histogram)
        placed, fill = {}, {}
        for length, rank, number, sequence, offset in sorted(plan.moves, key=lambda m: (m[0], m[1])):
            assert rank == placed.get(length, 0)
            placed[length] = rank + number
            for s in range(sequence, sequence + number):
                fill.setdefault(s, []).append((offset, length))
        assert placed == histogram and sorted(fill) == list(range(plan.sequences))
        for own in fill.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        assert plan.bound <= plan.sequences + 1e-6 and plan.bound >= sum(k * n for k, n in histogram.items()) / 2048 - 1e-6
        if plan.sequences > plan.bound + 2:  # the bound isn't reached by any packing of long pieces, so a search over single pieces is the measure
            assert plan.sequences <= 1.005 * (max(sharding.best_fit_decreasing([k for k, n in histogram.items() for _ in range(n)], 2048)) + 1)
    assert packing.plan_sequences({k: 50 + k % 7 for k in range(20, 900, 3)}).rounded > 0.9
    assert packing.plan_sequences({}).moves == []


def test_packing_goes_on_until_the_bound_or_all_tilts():
    """Without a gap there is no stop above the bound: the best of the tilts is taken."""
    r = random.Random(12)
    histogram = {k: r.randint(1, 12) for k in r.sample(range(40, 1400), 250)}
    tilts = (0.0, 0.03, 0.1, 0.3)
    plans = [packing.plan_sequences(histogram, tilts=(t,)) for t in tilts]
    best = packing.plan_sequences(histogram, gap=0.0, tilts=tilts)
    assert best.sequences <= min(p.sequences for p in plans if p.bound <= best.sequences)
    assert best.sequences == min(p.sequences for p in plans) or best.sequences <= np.ceil(best.bound)


def test_price_is_a_best_configuration():
    r = random.Random(8)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 40), 8)))
        limits, values = np.array([r.randint(0, 4) for _ in lengths]), np.array([r.random() * n for n in lengths])
        best = {0: 0.0}
        for length, limit, value in zip(lengths.tolist(), limits.tolist(), values.tolist(), strict=True):
            best = _bounded(best, length, limit, value, 60)
        counts, top = packing.price(values, lengths, limits, 60, 0.0)
        assert (counts <= limits).all() and (counts * lengths).sum() <= 60 and abs((counts * values).sum() - max(best.values())) < 1e-9 and top >= max(best.values()) - 1e-9


def _bounded(best, length, limit, value, capacity):
    out = {}
    for k, v in best.items():
        for n in range(limit + 1):
            if k + n * length <= capacity:
                out[k + n * length] = max(out.get(k + n * length, 0.0), v + n * value)
    return out


def join_brute(texts):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((str(k), len(s), str(least.get(root(i)))) for i, ((k, _), s) in enumerate(zip(texts, sets, strict=True)))


def near_copies(seed, n, copies, change):
    r, words = random.Random(seed), prose(seed, n).split()
    out = []
    for _ in range(copies):
        own = words[:]
        for _ in range(r.randint(0, change)):
            own[r.randrange(len(own))] = f"x{r.random()}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit", [4_000_000, 3_000])
def test_join(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "CLUSTER_TOKENS", limit)
    texts, k = list(ODD), 100
    for seed in range(12):
        for t in near_copies(seed, 120, 8, 6):
            texts.append((k, t if k % 5 else t.upper()))
            k += 1
    for t in near_copies(99, 100, 90, 5):
        texts.append((k, t + " shared passage of seven plain words"))
        k += 1
    out = rows(ngram_join.jaccard_components(table(spark, texts)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == join_brute(texts)
    assert rows(ngram_join.jaccard_components(table(spark, ODD).limit(0))) == []


def test_divide_skip_finds_all_links():
    r = random.Random(2)
    for trial in range(30):
        base = [r.sample(range(60), 24) for _ in range(3)]
        sets = []
        for _ in range(r.randint(1, 60)):  # few and many sets, all with hot shingles
            own = set(r.choice(base))
            for _ in range(r.randint(0, 5)):
                own.discard(r.choice(sorted(own)))
                own.add(r.randint(0, 90))
            sets.append(np.array(sorted(own), dtype=np.uint64))
        sizes = [len(s) for s in sets]
        every = list(range(len(sets)))
        half = every if trial % 2 else every[::2]
        links = ngram_join.divide_skip(sets, sizes, every if trial % 2 else every[1::2], half)
        want = {(i, j) for i in every for j in half if i != j and (trial % 2 or i % 2) and ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j])}
        assert all(ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), sizes[a], sizes[b]) for a, b in links)
        forest, reached = ngram_join._Forest(len(sets)), ngram_join._Forest(len(sets))
        for a, b in links:
            forest.join(a, b)
        for a, b in want:
            reached.join(a, b)
            assert forest.root(a) == forest.root(b)


def test_near_duplicate_stage_with_repeated_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    texts = [(5, a), (5, b), (6, c), (7, a), (8, b), (None, c), (None, prose(4, 60)), (9, None), (9, None), (10, " "), (11, prose(5, 60)), (11, prose(5, 60))]
    out = ngram_join.near_duplicate_stage(spark, table(spark, texts), "")
    assert out.columns == table(spark, texts).columns
    kept = sorted(((r["doc_id"], r["text"]) for r in rows(out)), key=str)
    assert kept == sorted([(5, a), (5, b), (6, c), (None, prose(4, 60)), (9, None), (9, None), (10, " "), (11, prose(5, 60))], key=str)


def test_very_long_texts(spark):
    long = prose(7, 30_000)
    texts = [(1, long), (2, long + " end"), (3, "short text here")]
    df = table(spark, texts)
    assert {r["doc_id"]: r["component_id"] for r in rows(ngram_join.jaccard_components(df))} == {1: 1, 2: 1, 3: 3}
    assert all((r["n_words"], r["n_repeat_words"]) == (line_brute(t)[0], line_brute(t)[4]) for r in rows(line_cleaning.clean_lines(df)) for k, t in texts if k == r["doc_id"])
    out = rows(paragraph_sketch.fingerprint_versions(df))
    assert {r["doc_id"]: r["edited_sha256"] for r in out} == sketch_brute(texts)
    pieces = rows(packing.pack_documents(df))
    assert sum(r["length"] for r in pieces if r["doc_id"] == 2) > 20 * 2048


def test_size_classes_and_whole_histogram(spark):
    sizes = [0, 1, 2047, 4095, 4096, 4097, 10**6 + 1, 2**40 + 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "x long").select(sharding.size_class(F.col("x"))).collect()]
    assert got[:5] == sizes[:5] and all(a >= b and a - b <= b / 2048 for a, b in zip(got, sizes, strict=True))
    r = random.Random(6)
    classes = [(s, r.randint(1, 30)) for s in r.sample(range(1, 90), 20)]
    each = [s for s, n in classes for _ in range(n)]
    bins = sharding.best_fit_decreasing(each, 100)
    load = {}
    for s, b in zip(each, bins, strict=True):
        load[b] = load.get(b, 0) + s
    by_class = {}
    for (s, n), own in zip(classes, sharding.best_fit_classes(classes, 100), strict=True):
        assert sum(k for _, k in own) == n
        for b, k in own:
            by_class[b] = by_class.get(b, 0) + s * k
    assert by_class == load


def test_secrets(spark):
    scanner = secrets.compile_rules()
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def brute(t):
        found = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        return sorted(found, key=lambda x: (x[1], secrets.BASE_KINDS.index(x[0])))

    r = random.Random(9)
    bits = ["password", "ToKen", "api_key", "AKIA", "=", ":", " ", '"', "abc", "0123456789abcdef", "deadbeef" * 4, "ABCDEF012345", "é", ".", "-", "\n", "=="]
    texts = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 14)))) for i in range(3000)]
    for _, t in texts:
        assert [x for x in secrets.scan(t, scanner) if x[0] in secrets.BASE_KINDS] == brute(t)
    assert [x[0] for x in secrets.scan("ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----", scanner)] == ["github", "private_key"]
    out = rows(secrets.find_secrets(table(spark, ODD)))
    assert len(out) == len(ODD) and all(r["secret_spans"] == [] for r in out)
    red = rows(secrets.redact_secrets(table(spark, [(1, "é token: abcdefgh12 end"), (2, None)])))
    assert [x["text"] for x in red] == ["é [SECRET] end", None]
