"""Personal data: patterns propose spans, validators confirm them, words nearby adjust the score.

A rule's pattern proposes spans of one kind.  Its validator (Luhn, mod 97, a
check letter, number ranges) confirms or drops each; a confirmed span gets the
rule's score, which words in the text around it raise or lower.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import give_back, table

BEFORE, AFTER = 48, 24  # code points around a span whose words count
RAISED, LOWERED = 0.35, 0.3


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, less 9 if over 9; the sum ends in 0."""
    return sum(int(d) if k % 2 == 0 else 2 * int(d) - 9 * (d > "4") for k, d in enumerate(reversed(digits))) % 10 == 0


def remainder(digits: str, by: int) -> int:
    """The remainder of a number of any length, digit by digit."""
    out = 0
    for d in digits:
        out = (10 * out + int(d)) % by
    return out


def is_card(s: str, least: int = 16, most: int = 19) -> bool:
    d = digits_of(s)
    return least <= len(d) <= most and luhn(d)


def is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in s.split(".")))


def is_phone(s: str, least: int = 8, most: int = 15) -> bool:
    return least <= len(digits_of(s)) <= most


def is_iban(s: str) -> bool:
    """Country and check digits go to the end, letters become 10 to 35, and the remainder by 97 is 1."""
    t = s.replace(" ", "")
    return 15 <= len(t) <= 34 and remainder("".join(str(int(c, 36)) for c in t[4:] + t[:4]), 97) == 1


def is_social_number(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_spanish_number(s: str) -> bool:
    """The letter is fixed by the number's remainder by 23."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[remainder(str("XYZ".find(s[0])) + s[1:-1] if s[0] in "XYZ" else s[:-1], 23)] == s[-1]


def is_french_number(s: str) -> bool:
    """The last two digits are 97 less the remainder of the others; the departments of Corsica have letters."""
    t = s.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return t.isdigit() and remainder(t[:-2], 97) == 97 - int(t[-2:])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, from each @ to its left and right: long runs without an @ aren't tried at each letter."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


@dataclass(frozen=True)
class Rule:
    """A kind of personal data.

    ``find`` is a pattern, or a function that gives spans; ``score`` is that of
    a confirmed span without context.  ``words`` nearby raise it, ``against``
    lower it, but not under ``floor``.
    """

    kind: str
    find: str | Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool] | None
    score: float
    words: tuple[str, ...] = ()
    against: tuple[str, ...] = ()
    floor: float = 0.0


#: Words that speak for a kind, in the languages of the texts, and those against any.
PHONE_WORDS = ("tel", "telephone", "telefon", "téléphone", "teléfono", "phone", "call", "mobile", "mobil", "handy", "portable", "móvil", "fax", "contact")
CARD_WORDS = ("card", "karte", "kreditkarte", "carte", "tarjeta", "visa", "mastercard", "amex", "credit", "payment", "zahlung", "paiement", "pago")
BANK_WORDS = ("iban", "bank", "konto", "account", "compte", "cuenta", "bic", "swift", "transfer", "überweisung")
IDENTITY_WORDS = ("ssn", "social", "security", "sécurité", "sociale", "insee", "nir", "dni", "nie", "nif", "identity", "identidad", "documento", "ausweis")
AGAINST = ("example", "sample", "beispiel", "exemple", "ejemplo", "version", "isbn", "order", "invoice", "rechnung", "facture", "factura")

#: The base kinds first, whose spans always stay (their floor).  Patterns are possessive, so that long runs are read once.
RULES = (
    Rule("email", emails, None, 0.9, ("mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt", "contacto"), AGAINST, 0.5),
    Rule("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", is_ip, 0.6, ("ip", "address", "host", "server", "login", "adresse", "dirección"), AGAINST, 0.5),
    Rule("card", r"[0-9](?:[ -]?[0-9])++", is_card, 0.7, CARD_WORDS, AGAINST, 0.5),
    Rule("phone", r"\+[0-9][ ().0-9-]+[0-9]", is_phone, 0.6, PHONE_WORDS, AGAINST, 0.5),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", is_iban, 0.8, BANK_WORDS, AGAINST),
    Rule("short_card", r"(?<![0-9+.-])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])", lambda s: is_card(s, 13, 15), 0.3, CARD_WORDS, AGAINST),
    Rule("local_phone", r"(?<![0-9A-Za-z+.-])\(?0[0-9]{1,5}\)?(?:[ /.-]?[0-9]{2,4}){2,4}(?![0-9])", is_phone, 0.3, PHONE_WORDS, AGAINST),
    Rule("social_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", is_social_number, 0.4, IDENTITY_WORDS, AGAINST),
    Rule("french_number", r"(?<![0-9A-Za-z])[12] ?[0-9]{2} ?[01][0-9] ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9A-Za-z])", is_french_number, 0.6, IDENTITY_WORDS, AGAINST),
    Rule("spanish_number", r"(?<![0-9A-Za-z])[0-9XYZ][0-9]{7}[A-Z](?![0-9A-Za-z])", is_spanish_number, 0.6, IDENTITY_WORDS, AGAINST),
)
BASE_KINDS = ("email", "ip", "card", "phone")
WORD = re.compile(r"\w[\w-]*")
DIGIT = re.compile("[0-9]")


@dataclass
class Finder:
    rules: tuple[Rule, ...]

    def __post_init__(self):
        self.patterns = [re.compile(r.find) if isinstance(r.find, str) else None for r in self.rules]

    def proposed(self, k: int, text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.patterns[k].finditer(text)) if self.patterns[k] else self.rules[k].find(text)

    def spans(self, text: str | None, least: float) -> list[tuple[str, int, int, float]]:
        """``(kind, start, end, score)`` by kind and start.  Matches of a kind are leftmost and
        don't overlap; one that isn't confirmed is dropped, with what it covers.  The
        kinds after the base leave out what overlaps a span of an earlier kind."""
        if not text:
            return []
        out: list[tuple[str, int, int, float]] = []
        starts: list[int] = []  # of what is taken, sorted, with the furthest end up to each
        ends: list[int] = []
        any_digit = DIGIT.search(text) is not None
        for k, rule in enumerate(self.rules):
            if self.patterns[k] and not any_digit:
                continue  # every pattern has a digit
            base, own = rule.floor >= least, []
            for start, end in self.proposed(k, text):
                if rule.confirm and not rule.confirm(text[start:end]):
                    continue
                before = bisect_left(starts, end)
                if not base and before and ends[before - 1] > start:
                    continue
                score = self.score(rule, text, start, end)
                if score >= least:
                    own.append((rule.kind, start, end, score))
            out += own
            starts = sorted(s[1] for s in out)
            ends = list(accumulate((s[2] for s in sorted(out, key=lambda s: s[1])), max))
        return out

    def score(self, rule: Rule, text: str, start: int, end: int) -> float:
        near = {w.lower() for w in WORD.findall(text[max(0, start - BEFORE) : start]) + WORD.findall(text[end : end + AFTER])}
        score = rule.score + RAISED * any(w in near for w in rule.words) - LOWERED * any(w in near for w in rule.against)
        return round(min(1.0, max(rule.floor, score)), 3)


def find_personal_data(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_score: float = 0.5) -> DataFrame:
    """``docs`` with ``personal_spans``: array of (kind, start, end, score), by rule and start.

    Offsets are code points, the end exclusive.  Whole texts are read; null and
    empty ones have an empty list.  A column ``personal_spans`` in ``docs`` is
    replaced, others stay; repeated rows are judged each by itself.
    """

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(rules)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in finder.spans(t, min_score)] for t in texts])
        give_back()

    return docs.withColumn("personal_spans", run(F.col(text)))


def redact_personal_data(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_score: float = 0.5) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets, ``[EMAIL]``.

    Spans that overlap become one mark, of the one that starts first.  A null text stays null.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(rules)
        for texts in batches:
            yield pd.Series([_redacted(t, finder.spans(t, min_score)) for t in texts])
        give_back()

    return docs.withColumn(text, run(F.col(text)))


def _redacted(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("personal_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    number = lambda kind: F.size(F.filter("personal_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *(number(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(write(base), 256).alias("base_sha256"), write(F.col("personal_spans")).alias("spans"))
