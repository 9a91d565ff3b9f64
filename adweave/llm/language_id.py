"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from labelled
texts.  A text is encoded once with each dictionary; the language whose
dictionary makes it smallest wins, and a narrow win is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import give_back, held_out, small_frame, table

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, in the order of the language names.

    ``level`` is the compression level.  Texts are encoded in blocks of
    ``block_bytes``, so the dictionary stays in reach throughout.
    """

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 6
    block_bytes: int = 8192


def fit_language_model(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", samples: int = 512, sample_chars: int = 512, all_samples: int = 65536) -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled rows of ``docs``.

    Bound: ``samples`` texts of each label, ``sample_chars`` characters of each text.
    No label is left out: where there are many, each gets an equal part of
    ``all_samples`` texts (one at least).  For every label and each of
    ``samples`` hash buckets of the key, the text with the smallest key hash is
    taken, so the sample is spread over all rows and doesn't depend on their
    order.  Rows without text or label teach nothing; with no labelled row the
    model has no language and every text is undetermined.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("label"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"), F.col(text).alias("text")
    )
    samples = max(1, min(samples, all_samples // max(1, rows.select("label").distinct().count())))
    picked = rows.groupBy("label", F.pmod("h", F.lit(samples)).alias("b")).agg(F.min("h").alias("h")).select("label", "h").collect()
    if not picked:
        return LanguageModel((), ())
    # at most all_samples small rows (or one for each label), so this side may be broadcast
    chosen = F.broadcast(small_frame(spark, [tuple(r) for r in picked], "label string, h long"))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int") + 1
    cut = rows.join(chosen, ["label", "h"]).select("label", "h", F.col("text").substr(start, F.lit(sample_chars)).alias("cut"))
    parts: dict[str, dict[int, str]] = {}
    for lang, h, piece in cut.collect():
        own = parts.setdefault(lang, {})
        own[h] = max(own.get(h, ""), piece)
    languages = tuple(sorted(parts))
    return LanguageModel(languages, tuple("\n".join(parts[x][h] for h in sorted(parts[x])).lower().encode() for x in languages))


class Encoder:
    """Encodes texts with every dictionary of a model; made once for each task."""

    def __init__(self, model: LanguageModel):
        self.model, self.coders = model, []
        for content in model.dictionaries:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=model.level)
            self.coders.append(zstandard.ZstdCompressor(level=model.level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text under each language's dictionary."""
        data, step = text.lower().encode("utf-8", "replace"), self.model.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, int]:
        """Language, relative margin to the runner-up and the margin in bytes."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
        return self.model.languages[order[0]], (second - best) / second, second - best


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = 0.004) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin_bytes`` and ``lang_accepted``.

    ``score`` (0 to 1) is the share by which the best encoding is smaller than
    the second best.  A text is rejected (``lang_accepted`` false) if that is
    under ``min_margin``, or if it is null, empty or has no letter, when
    ``lang_pred`` is ``und``.  Ties go to the language first by name and are
    always rejected.  Whole texts are encoded.  Columns of these four names in
    ``docs`` are replaced; all others stay.
    """

    @F.pandas_udf("lang_pred string, score double, margin_bytes long")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model)
        for texts in batches:
            yield pd.DataFrame([encoder.classify(t) for t in texts], columns=["lang_pred", "score", "margin_bytes"])
        encoder.coders.clear()
        give_back()

    out = docs.drop("lang_pred", "score", "margin_bytes", "lang_accepted").withColumn("_decided", decide(F.col(text)))
    out = out.select("*", "_decided.*").drop("_decided")
    return out.withColumn("lang_accepted", (F.col("lang_pred") != UNDETERMINED) & (F.col("margin_bytes") > 0) & (F.col("score") >= min_margin))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    out = identify_language(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_accepted")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go."""
    model = fit_language_model(table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id"))))
    return identify_language(docs, model).where("lang_accepted").select(docs.columns)
