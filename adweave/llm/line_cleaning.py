"""Line-first cleaning with built-in functions only.

Each line of a text is judged by itself (punctuation, navigation, boilerplate);
lines that fail are removed, and a document that loses too much of its text is
rejected as a whole, as is one that fails the base measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import table

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"

#: Starts and phrases of lines that say nothing about a document's subject.
BOILERPLATE = (
    r"(?i)^\W*(licensed under|released under the|this work is licensed|all rights reserved|copyright \W{0,3}\s*\d{4}|©"
    r"|terms (of|and) (use|service|conditions)|privacy policy|cookie (policy|settings)|we use cookies|accept (all )?cookies"
    r"|please enable javascript|javascript (is )?(disabled|required)|powered by|subscribe to our newsletter)"
)
#: Lines that are nothing but a way to other pages.
NAVIGATION = (
    r"(?i)^\W*(home|menu|search|login|log in|sign in|sign up|register|next|previous|back( to top)?|share( this)?|print|read more|more"
    r"|skip to (main )?content|click here|sitemap|site map|contact( us)?|about( us)?|faq|help|top|comments?)\W*$"
)


def without(text: Column, chars: str) -> Column:
    """``text`` without any of ``chars``; plain replacements, which scan bytes."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(without(text, chars))


def flat(text: Column) -> Column:
    """``text`` with a space for each of the other space characters."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """The words: what stands between spaces and the controls 9 to 13."""
    return F.array_remove(F.split(flat(text), " "), "")


def repeated_word_count(words: Column, low: Column) -> Column:
    """How many words stand in a 3-word window that occurs at least twice.

    ``low`` is a power of two above the number of words, less one.  A window is
    one long: its hash in the high bits, its place in the low ones.  Sorted,
    the windows with a neighbour of the same hash are the repeated ones, and
    each adds the words that the one before it hasn't covered.  Places take no
    more bits than they need, which leaves 48 bits of hash at 30,000 words.
    """
    count = F.size(words)
    pack = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint"))
    windows = F.when(count < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 3, F.lit(0))), pack))

    def covered(s: Column) -> Column:
        same = lambda x, y: x.bitwiseXOR(y) <= low  # noqa: E731  # no high bit differs
        near = lambda x, y: same(x, y) & (x.bitwiseXOR(y) >= 0)
        repeated = F.filter(s, lambda x, j: near(x, F.get(s, j - 1)) | near(x, F.get(s, j + 1)))
        places = F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(low)))
        zero = F.struct(F.lit(-9).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(places, zero, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3).cast("bigint"), p - a["at"])).alias("n")), lambda a: a["n"])

    # the sorted windows are bound to a name, so that they are made once
    return F.transform(F.array(F.sort_array(windows)), covered)[0]


def line_fails(line: Column, max_symbols: float = 0.12, max_marks: float = 0.18) -> Column:
    """Whether one line breaks a rule.

    * punctuation: over ``max_symbols`` of its other characters than spaces are
      ``#*$%&|<>^~=_{}[]\\``, or over ``max_marks`` are exclamation, question or
      other sentence marks;
    * navigation: it is only a link's label, or parts between three or more
      bars, bullets or angle quotes;
    * boilerplate: licence, cookie and similar notices.

    Lines without a word never fail: they carry no text to lose.
    """
    separators = count_of(line, "|•»›·")
    judge = lambda bare: (bare > 0) & (
        (count_of(line, "#*$%&|<>^~=_{}[]\\") > max_symbols * bare)
        | ((bare > 12) & (count_of(line, "!?.,;:") > max_marks * bare))
        | ((bare < 40) & line.rlike(NAVIGATION))
        | ((separators >= 3) & (separators * 12 >= bare))
        | F.substring(line, 1, 200).rlike(BOILERPLATE)
    )
    return F.transform(F.array(F.length(without(line, SPACE))), judge)[0]  # binds the length, so that it is taken once


def clean_lines(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """``docs`` with the base measures, the verdict and the cleaned text.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed``, ``kept`` and ``cleaned_text``: the lines that pass, or null
    if the document isn't kept.  A document that loses over ``max_lost`` of its
    characters other than spaces is rejected.  A null text counts as an empty
    one: no words, so it fails the base.  Columns of ``docs`` with these names
    are replaced, all others stay; repeated rows are judged each by itself.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned_text")
    body = F.coalesce(F.col(text), F.lit(""))
    bare = lambda c: F.length(without(c, SPACE))
    out = docs.drop(*(n for n in names if n != text)).withColumn("_words", words_of(body)).withColumn("_lines", F.split(body, "\n"))
    worded = F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACE)) != "")
    low = F.pow(F.lit(2), F.ceil(F.log2(F.size("_words") + F.lit(2)))).cast("bigint") - 1
    out = out.withColumn("_low", low)
    out = out.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": bare(body).cast("long"),
            "n_symbols": count_of(body, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
            "n_repeat_words": repeated_word_count(F.col("_words"), F.col("_low")),
            "_left": F.array_join("_good", "\n"),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (bare(F.col("_left")) >= (1 - max_lost) * F.col("word_chars")))
    return out.withColumn("cleaned_text", F.when(F.col("kept"), F.col("_left"))).drop("_words", "_low", "_lines", "_good", "_left")


def op7_line_cleaning(spark, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
