"""op11 to op13 against plain recomputations, and their edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from adweave.llm import filter_audit, personal_data, spelling_groups
from adweave.llm.common import small_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter audit


def audit_rows(docs, labels):
    """All orders, filter by filter, one document at a time."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    said = {}
    for i, quality, toxic in labels:
        q, t = said.get(i, (0, 0))
        said[i] = (q or int(quality == 1), t or int(toxic == 1))
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            f.add("C")
        if re.search("[#$%&*|]", text):
            f.add("D")
        if i is not None and i > first[text]:
            f.add("E")
        fails.append((source or "", f, *(said.get(i, (0, 0)) if i is not None else (0, 0))))
    rows, shapley = {}, Counter()
    for part in {x[0] for x in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                cut = [x for x in left if letter in x[1]]
                redundant = sum(letter in x[1] for x in gone)
                unique = sum(x[1] == {letter} for x in left + gone)
                left = [x for x in left if letter not in x[1]]
                gone += cut
                shapley[part, letter] += len(cut)
                rows[part, order, step] = [len(left), len(cut), redundant, unique, sum(x[2] for x in cut), sum(x[3] for x in cut)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def random_docs(seed, n):
    rng = random.Random(seed)
    texts = ["", None, "one two", "A B C", "x " * 250, " ".join(f"w{k}" for k in range(220)), " ".join(f"w{k}" for k in range(220)) + " #", "W " * 300, "a|b\n\n\tc", "hot copy"]
    return [(k, rng.choice(texts), rng.choice(["s", None, "", "t"])) for k in range(n)]


def test_audit_equals_a_plain_run(spark):
    docs = [*random_docs(1, 80), (3, "hot copy", "s"), (None, "hot copy", "s"), (None, None, None), *((1000 + k, "hot copy", "s") for k in range(60))]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(70)] + [(5, 1, None), (5, None, 1), (None, 1, 1)]
    frame = small_frame(spark, [(*d, "clash", 1) for d in docs], "doc_id bigint, text string, source string, mask string, code int")
    said = small_frame(spark, labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit_orders(filter_audit.failure_masks(frame, said)).collect()
    want = audit_rows(docs, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert tuple(r)[3:] == want[r["part"], r["filter_order"], r["step"]], r


def test_audit_of_empty_tables(spark):
    docs = small_frame(spark, [], "doc_id bigint, text string, source string")
    said = small_frame(spark, [], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_orders(filter_audit.failure_masks(docs, said)).collect() == []


@pytest.mark.parametrize("most", [1, 65536])
def test_sketch_clears_only_unique_texts(spark, most):
    """Also where the sketch is far too small: then it clears little, but nothing that repeats."""
    rows = spark.range(40_000).selectExpr("xxhash64(IF(id % 10 = 0, id % 700, id)) AS code", "id")
    sketch = filter_audit.counting_sketch(rows, "code", 40_000, most)
    assert sketch[1] == min(most, 13)
    flagged = filter_audit.with_repeat_flag(rows, "code", sketch, "again")
    repeated = rows.groupBy("code").count().filter("count > 1").select("code")
    assert flagged.filter("NOT again").join(repeated, "code", "left_semi").count() == 0
    cleared = flagged.filter("NOT again").count()
    assert cleared > 35_000 if most > 1 else cleared < 35_000


def test_no_more_texts_are_shuffled_than_may_repeat(spark):
    rows = small_frame(spark, [(k, f"text {k // 2 if k < 20 else k}") for k in range(5000)], "id bigint, text string").selectExpr("id", "text", "xxhash64(text) AS code")
    sketch = filter_audit.counting_sketch(rows, "code", 5000)
    kept = filter_audit.with_repeat_flag(rows, "code", sketch, "again").filter("again")
    assert 20 <= kept.count() < 200
    firsts = filter_audit.first_holders(kept, "id", "code", "text").collect()
    assert {r["id"] for r in firsts if r["id"] < 20} == set(range(0, 20, 2))


# ---- spelling groups


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def groups_of(counts):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= 10 * n else None, n, len(close), counts[best] if best and counts[best] >= 10 * n else None)
    rows = {}
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, n_near, form_n)
    return rows


def random_words(seed, n, letters, most):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(7, 10))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]}
    return {w: int(10 ** rng.uniform(0.3, most)) for w in words}


@pytest.mark.parametrize(("seed", "letters"), [(1, "abc"), (2, "abcdefghijklmnopqrstuvwxyz"), (3, "aé×ÿ÷bc"), (4, "ab日本語𝒳")])
def test_groups_equal_all_pairs(spark, seed, letters):
    counts = random_words(seed, 150, letters, 6)
    got = spelling_groups.group_spellings(small_frame(spark, list(counts.items()), "word string, n bigint"))
    assert {r["word"]: tuple(r)[1:] for r in got.collect()} == groups_of(counts)


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    counts = {long: 5000, long[:100] + long[101:]: 2, long[:50] + "c" + long[51:]: 3, long + "b": 400, "z" * 5000: 3, "z" * 5001: 60}
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    counts |= {w: 3 * 10**k for k, w in enumerate(chain)}
    rows = {r["word"]: tuple(r)[1:] for r in spelling_groups.group_spellings(small_frame(spark, list(counts.items()), "word string, n bigint")).collect()}
    assert rows == groups_of(counts)
    assert rows["aaaaaaa"][1] == "aabbbbb"


def test_blocks_and_leaves_change_nothing(spark, monkeypatch):
    counts = random_words(7, 200, "abcd", 4)
    monkeypatch.setattr(spelling_groups, "BLOCK", 8)
    monkeypatch.setattr(spelling_groups, "CHUNK", 5)
    frame = small_frame(spark, list(counts.items()), "word string, n bigint")
    pairs = [(r["word"], r["near"]) for r in spelling_groups.near_words(frame).collect()]
    assert sorted(pairs) == sorted((a, b) for a in counts for b in counts if near(a, b))


def test_a_trie_with_small_leaves_and_rooms(monkeypatch):
    import numpy as np

    monkeypatch.setattr(spelling_groups, "LEAF", 1)
    monkeypatch.setattr(spelling_groups, "ROOM", 500)
    words = sorted(random_words(9, 150, "abcde", 2))
    of = np.arange(0x110000) % spelling_groups.GROUPS
    trie = spelling_groups.Trie(words, np.ones(len(words), dtype=np.int64), of)
    found = [frozenset((words[i], trie.words[j])) for q, w in trie.near(words) for i, j in zip(q.tolist(), w.tolist(), strict=True)]
    assert sorted(map(sorted, found)) == sorted([a, b] for a in words for b in words if a < b and near(a, b))


def test_planted_words(spark):
    docs = [(k, f"Geschwindigkeit, über×mütig÷{'Straßenbahn' if k % 3 else 'strassenbahn'} Übung-Übungen x1abcdefg {k}") for k in range(120)] + [(None, "Geschwindigkeit"), (7, None), (8, ""), (9, "short words")]
    frame = small_frame(spark, [(*d, 1) for d in docs], "doc_id bigint, text string, run int")
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    got = {r["word"]: r["n"] for r in spelling_groups.planted_words(frame).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 2}
    assert {"über×mütig÷straßenbahn", "Übungen"} <= set(got)


def test_groups_of_no_words(spark):
    assert spelling_groups.group_spellings(small_frame(spark, [], "word string, n bigint")).collect() == []
    got = spelling_groups.group_spellings(small_frame(spark, [(None, 3), ("", 2), ("alone", 1)], "word string, n bigint")).collect()
    assert sorted(tuple(r) for r in got) == [("", None, "", 2, 0, None), ("alone", None, "alone", 1, 0, None)]


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x", ".", "..", "-", " ", "+", "+4", "1", "12", "255", "256", "001", "(", ")", "4417744280351547", "4417 7442-8035 1547", "1.2.3.4", "+1 (017) 555-7713", "é", "日", "a@b.c", "%", "_", "\n"]
    finder = personal_data.Finder(personal_data.RULES)
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [s[:3] for s in finder.spans(text, 0.5) if s[0] in BASE] == base_spans(text), text


def test_validators():
    assert personal_data.is_iban("DE89 3704 0044 0532 0130 00") and personal_data.is_iban("GB82WEST12345698765432")
    assert not personal_data.is_iban("DE88 3704 0044 0532 0130 00")
    assert personal_data.luhn("4417744280351547") and not personal_data.luhn("4417744280351548")
    assert personal_data.is_spanish_number("12345678Z") and personal_data.is_spanish_number("X1234567L") and not personal_data.is_spanish_number("12345678A")
    assert personal_data.is_french_number("2 55 08 14 168 025 38") and not personal_data.is_french_number("2 55 08 14 168 025 39")
    assert not personal_data.is_social_number("000-12-3456") and personal_data.is_social_number("123-45-6789")
    assert personal_data.remainder("9" * 6000, 97) == (pow(10, 6000, 97) - 1) % 97


def test_context_adjusts_the_score(spark):
    rows = [
        (1, "My SSN is 123-45-6789."),
        (2, "Part 123-45-6789 fits."),
        (3, "Call me: 030 123 45 67"),
        (4, "Total 030 123 45 67"),
        (5, "For example a.b@c.de here"),
        (6, "Konto DE89 3704 0044 0532 0130 00, danke"),
        (7, "Amex card 378282246310005!"),
        (8, None),
        (9, ""),
        (10, "card 4417744280351547 card"),
    ]
    docs = small_frame(spark, [(*r, "old") for r in rows], "id bigint, text string, personal_spans string")
    got = {r["id"]: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["personal_spans"]] for r in personal_data.find_personal_data(docs).collect()}
    assert got == {
        1: [("social_number", 10, 21, 0.75)],
        2: [],
        3: [("local_phone", 9, 22, 0.65)],
        4: [],
        5: [("email", 12, 20, 0.6)],
        6: [("iban", 6, 33, 1.0)],
        7: [("short_card", 10, 25, 0.65)],
        8: [],
        9: [],
        10: [("card", 5, 21, 1.0)],
    }
    clean = {r["id"]: r["text"] for r in personal_data.redact_personal_data(docs).collect()}
    assert clean[6] == "Konto [IBAN], danke" and clean[8] is None and clean[9] == "" and clean[2] == rows[1][1]


def test_long_runs_are_read_once(spark):
    texts = ["a" * 400_000, "1" * 400_000, "1.2." * 100_000, "+" + "1 " * 200_000, "@" * 300_000, "a.b-" * 100_000 + "@", "x@y.zz " * 40_000, "A1" * 200_000]
    docs = small_frame(spark, [(k, t) for k, t in enumerate(texts)], "id bigint, text string")
    got = {r["id"]: r["n"] for r in personal_data.find_personal_data(docs).selectExpr("id", "size(personal_spans) AS n").collect()}
    assert got[6] == 40_000 and got[0] == got[4] == got[5] == 0


def test_query_equals_the_patterns_on_the_smallest_tables(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = personal_data.op13_personal_data(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        want = base_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) - {""} <= set(r["spans"].split(","))
