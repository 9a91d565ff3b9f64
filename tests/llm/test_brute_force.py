"""Language, toxicity and mixing against plain recomputations, and their query functions on the smallest tables."""

import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard

from adweave.llm import language_id, mixing, registry, toxicity

from .test_operators import ODD, prose, rows, table

DATA = "/root/testdata/sf0.001"


def coder(content, level):
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False), words


def test_language_is_the_smallest_encoding(spark):
    taught = [(i, prose(i, 40, w), lang) for lang, w in (("aa", ["mor", "tel", "sin"]), ("bb", ["kuu", "vel", "hja"]), ("cc", ["mor", "vel", "xon"])) for i in range(ord(lang[0]), ord(lang[0]) + 12)]
    model = language_id.fit_language_model(spark.createDataFrame(taught, "doc_id long, text string, lang string"), samples=8)
    texts = [*ODD, (20, prose(5, 900, ["mor", "tel"])), (21, prose(6, 2, ["vel"])), (22, prose(7, 3000, ["kuu", "mor", "xon"])), (23, "zzz qqq")]
    out = rows(language_id.identify_language(table(spark, texts), model))
    found = sorted((str(r["doc_id"]), r["text"] or "", r["lang_pred"], round(r["score"], 9), r["lang_accepted"]) for r in out)
    want = []
    for k, t in texts:
        if not t or not any(c.isalpha() for c in t):
            want.append((str(k), t or "", "und", 0.0, False))
            continue
        data, sizes = t.lower().encode(), {}
        for lang, content in zip(model.languages, model.dictionaries, strict=True):
            size, back = 0, b""
            for at in range(0, len(data), model.block_bytes):
                press, words = coder(content, model.level)  # a new one for each block: nothing is carried over
                packed = press.compress(data[at : at + model.block_bytes])
                back += zstandard.ZstdDecompressor(dict_data=words).decompress(packed, max_output_size=model.block_bytes)
                size += len(packed)
            assert back == data
            sizes[lang] = size
        (best, lang), (second, _) = sorted((s, x) for x, s in sizes.items())[:2]
        score = (second - best) / second
        want.append((str(k), t, lang, round(score, 9), second > best and score >= 0.004))
    assert found == sorted(want)


def test_features_are_the_hashed_grams():
    def plain(text):
        points, out, full = [ord(c) for c in f" {(text or '').lower()} "], set(), 2**64 - 1
        for n in toxicity.ORDERS:
            for i in range(len(points) - n + 1):
                h = 0
                for p in points[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + p) & full
                h = ((h + n) * 0xD6E8FEB86659FD93) & full
                h ^= h >> 32
                out.add((h * 0xD6E8FEB86659FD93 & full) >> (64 - toxicity.BITS))
        return sorted(out)

    for _, t in ODD:
        assert toxicity.features(t).tolist() == plain(t)


def test_regression_agrees_with_a_plain_fit():
    rng = np.random.default_rng(3)
    y = (rng.random(500) < 0.4).astype(float)
    # feature 1 to 20 lean to one class, 21 to 60 are noise
    sets = [np.unique(np.concatenate([rng.integers(1, 11, 4) if (label > 0) == (rng.random() < 0.9) else rng.integers(11, 21, 4), rng.integers(21, 61, 6)])).astype(np.int32) for label in y]
    fitted, asked = sets[:350], sets[350:]
    weights, bias = toxicity._regress(fitted, y[:350])
    pos, neg = np.ones(1 << toxicity.BITS), np.ones(1 << toxicity.BITS)
    for ids, label in zip(fitted, y[:350], strict=True):
        (pos if label else neg)[ids] += 1
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    dense = np.zeros((500, 61))
    for i, ids in enumerate(sets):
        dense[i, ids] = ratio[ids] / np.sqrt(len(ids))
    w, b = np.zeros(61), 0.0
    for _ in range(3000):
        e = 1 / (1 + np.exp(-(dense[:350] @ w + b))) - y[:350]
        w, b = w - 0.5 * (dense[:350].T @ e / 350), b - 0.5 * e.mean()
    mine = np.array([bias + weights[ids].sum() / np.sqrt(len(ids)) for ids in asked])
    plain = dense[350:] @ w + b
    assert ((mine > 0) == (plain > 0)).mean() >= 0.9
    assert ((mine > 0) == (y[350:] > 0)).mean() >= ((plain > 0) == (y[350:] > 0)).mean() - 0.03


@pytest.mark.parametrize("wanted", [(0.5, 0.3, 0.2), (0.9, 0.05, 0.05), (0.1, 0.1, 0.8)])
def test_rates_equal_dense_projected_gradient(spark, wanted):
    rng = np.random.default_rng(11)
    tokens = rng.integers(0, 400, 300)
    posterior = rng.dirichlet([0.6, 0.3, 0.2], 300)
    posterior[:, 2] = np.minimum(posterior[:, 2], 0.7)
    posterior /= posterior.sum(axis=1, keepdims=True)
    targets = np.array(wanted) * tokens.sum()
    members = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, posterior, strict=True)], "tokens long, posterior array<double>").repartition(5)
    rate = mixing.fit_rates(members, targets).of(tokens.astype(float), posterior)
    share = tokens[:, None] * posterior / tokens.max()
    aim = targets / tokens.max()
    dense, step = np.ones(300), 1 / np.linalg.norm(share.T @ share, 2)
    for _ in range(60_000):
        dense = np.maximum(0, dense - step * (share @ (share.T @ dense - aim)))
    loss = lambda r: float(np.abs(share.T @ r - aim).max() / aim.sum())
    assert rate.min() >= 0 and loss(rate) <= loss(dense) + 1e-3


given = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables aren't here")


@given
@pytest.mark.parametrize("name", ["op1_language_id", "op3_toxicity", "op7_line_cleaning", "op10_secrets"])
def test_queries_give_each_document_once(spark, name):
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    out = rows(registry.queries()[name](spark, DATA))
    assert sorted(r["doc_id"] for r in out) == sorted(ids)
    if "held_out" in out[0]:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    if "predicted" in out[0]:
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in out)
