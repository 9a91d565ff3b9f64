"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives each document's probability of
each domain.  A document's expected tokens in a domain are its tokens times that
probability; projected gradient steps on a least-squares objective find a
nonnegative rate for every document, so that the expected totals meet the
targets.  Copies are the rates rounded up or down by chance alone, so that their
totals meet the targets too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import give_back, materialise, table
from adweave.llm.toxicity import BITS, _regress, features


@dataclass(frozen=True)
class DomainModel:
    """One linear scorer for each domain, over hashed character n-grams."""

    domains: tuple[str, ...]
    weights: np.ndarray  # features x domains
    bias: np.ndarray
    slope: float = 1.0

    def posterior(self, text: str | None) -> np.ndarray:
        found = features(text)
        z = self.slope * (self.bias + self.weights[found].sum(axis=0) / max(1.0, float(np.sqrt(len(found)))))
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_domains(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", rows_per_domain: int = 1000, all_rows: int = 32_000) -> DomainModel:
    """A classifier from at most ``rows_per_domain`` labelled texts of each domain.

    Bound: of each domain and each of ``rows_per_domain`` buckets of the key's hash,
    the row with the smallest hash.  No domain is left out: where there are many,
    each gets an equal part of ``all_rows``.  A fifth of the rows sets how sharp the
    probabilities are.  Null keys, domains and unknown keys teach nothing.
    With no labelled row there is one domain, ``all``.
    """
    known = labelled.where(F.col(domain).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(domain).alias("domain"))
    known = known.withColumn("h", F.xxhash64(F.col("k").cast("string")))
    buckets = max(1, min(rows_per_domain, all_rows // max(1, known.select("domain").distinct().count())))
    chosen = known.groupBy("domain", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min(F.struct("h", "k")).alias("r")).select("r.h", "r.k", "domain")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")  # a bounded side

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf.h, "domain": pdf.domain, "ids": [features(t).tobytes() for t in pdf.text]})

    rows = sorted((r["h"], r["domain"], bytes(r["ids"])) for r in texts.mapInPandas(gather, "h long, domain string, ids binary").collect())
    found = tuple(sorted({r[1] for r in rows}))
    if len(found) < 2:
        return DomainModel(found or ("all",), np.zeros((1 << BITS, 1), dtype=np.float32), np.zeros(1))
    ids = [np.frombuffer(r[2], dtype=np.int32) for r in rows]
    truth = np.array([found.index(r[1]) for r in rows])
    check = np.arange(len(rows)) % 5 == 0
    fitted = np.flatnonzero(~check) if len(set(truth[~check])) == len(found) else np.arange(len(rows))
    fits = [_regress([ids[i] for i in fitted], (truth[fitted] == k).astype(float), epochs=15) for k in range(len(found))]
    weights, bias = np.stack([w for w, _ in fits], axis=1), np.array([b for _, b in fits])
    # the slope under which the fifth that wasn't fitted is likeliest
    z = np.array([bias + weights[ids[i]].sum(axis=0) / max(1.0, float(np.sqrt(len(ids[i])))) for i in np.flatnonzero(check)])
    losses = {}
    for slope in (0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0):
        own = slope * z - (slope * z).max(axis=1, keepdims=True)
        losses[slope] = float((np.log(np.exp(own).sum(axis=1)) - own[np.arange(len(own)), truth[check]]).mean())
    return DomainModel(found, weights, bias, min(losses, key=losses.get))


def soft_membership(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (words between spaces) and ``posterior`` (a value for each domain).

    Whole texts are read; a null text has no tokens.  Columns with these names
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("tokens long, posterior array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame({"tokens": [len((t or "").split()) for t in texts], "posterior": [shared.value.posterior(t) for t in texts]})
        give_back()

    out = docs.drop("tokens", "posterior").withColumn("_m", run(F.col(text)))
    return out.select("*", "_m.*").drop("_m")


@dataclass(frozen=True)
class Rates:
    """The gradient steps taken; a document's rate follows from them alone."""

    steps: np.ndarray  # steps x domains
    scale: float
    residual: float
    lower: np.ndarray  # a bound for each likeliest domain; at most 1
    upper: np.ndarray  # at least 1

    def of(self, tokens: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        return self.moved(tokens, posterior)[0]

    def moved(self, tokens: np.ndarray, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates, and which of them a bound neither fixes nor cut in the last step."""
        share = (tokens / self.scale)[:, None] * posterior
        likeliest = posterior.argmax(axis=1)
        low, high = self.lower[likeliest], self.upper[likeliest]
        rate = aim = np.ones(len(tokens))
        for u in self.steps:
            aim = rate - share @ u
            rate = np.clip(aim, low, high)
        return rate, (low < high) & (aim >= low) & (aim <= high)


def fit_rates(members: DataFrame, targets: np.ndarray, max_steps: int = 60, tolerance: float = 1e-4, lower: np.ndarray | None = None, upper: np.ndarray | None = None) -> Rates:
    """Rates whose expected token totals meet ``targets`` (tokens of each domain).

    ``members`` has ``tokens`` and ``posterior``.  From rate 1 on, each step moves
    every rate against the gradient of the squared residual, measured in the
    inverse Gram matrix of the documents whose rate isn't at a bound, and cuts it
    at its bounds: ``lower`` (0) and ``upper`` (none) of its likeliest domain.
    Each step is one distributed sum as long as there are domains squared; the
    steps, not the rates, are kept.  It stops when the largest residual is under
    ``tolerance`` of all targets, or after ``max_steps``, with the best so far.
    Targets that no rates reach are met as nearly as least squares can.
    """
    scale = max(1.0, float(members.agg(F.max("tokens")).first()[0] or 1))
    k = len(targets)

    def sums(batches: Iterator[pd.DataFrame], rates: Rates) -> Iterator[pd.DataFrame]:
        total, square = np.zeros(k), np.zeros((k, k))
        for pdf in batches:
            tokens, posterior = pdf.tokens.to_numpy(dtype=float), np.stack(pdf.posterior.to_numpy()) if len(pdf) else np.zeros((0, k))
            share = (tokens / scale)[:, None] * posterior
            rate, free = rates.moved(tokens, posterior)
            total += rate @ share
            moves = share[free]
            square += moves.T @ moves
        yield pd.DataFrame([[*total, *square.ravel()]], columns=[f"v{i}" for i in range(k + k * k)])

    def summed(rates: Rates) -> np.ndarray:
        schema = ", ".join(f"v{i} double" for i in range(k + k * k))
        rows = members.select("tokens", "posterior").mapInPandas(lambda b: sums(b, rates), schema)
        return np.array([x or 0.0 for x in rows.agg(*(F.sum(c).alias(c) for c in rows.columns)).first()])

    wanted = np.asarray(targets, dtype=float) / scale
    lower, upper = np.zeros(k) if lower is None else lower, np.full(k, np.inf) if upper is None else upper
    rates = Rates(np.zeros((0, k)), scale, 0.0, lower, upper)
    best = None
    for _ in range(max_steps):
        got = summed(rates)
        gram = got[k:].reshape(k, k)
        residual = got[:k] - wanted
        size = float(np.abs(residual).max() / max(wanted.sum(), 1e-12))
        if best is None or size < best.residual:
            best = Rates(rates.steps, scale, size, lower, upper)
        if size < tolerance:
            break
        rates = Rates(np.vstack([rates.steps, np.linalg.pinv(gram + 1e-9 * np.trace(gram) * np.eye(k)) @ residual]), scale, size, lower, upper)
    return best


def copies(rate: Column, *keys: Column) -> Column:
    """How often a document is taken: its rate, rounded by a hash of ``keys``.

    The part after the point is the chance of one more copy, however small it is.
    """
    chance = F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) / 1_000_000
    return F.floor(rate + chance).cast("int")


def rates_for(members: DataFrame, model: DomainModel, weights: dict[str, float], keep: float | None = None) -> Rates:
    """The rates of ``members`` (tokens, posterior) for the weights that ``mix`` describes."""
    k = len(model.domains)
    # with ``keep``, what each document should keep by its likeliest domain; else all of it
    kept = F.lit(1.0)
    if keep is not None:
        shares = F.array(*(F.lit(float(weights.get(d, keep))) for d in model.domains))
        kept = F.get(shares, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    now = np.array([x or 0.0 for x in members.agg(*(F.sum(F.col("tokens") * kept * F.col("posterior")[i]) for i in range(k))).first()])
    targets, lower, upper = now, None, None
    if keep is not None:
        # what each document should keep lies within these bounds, so they leave the targets in reach
        own = np.array([float(weights.get(d, keep)) for d in model.domains])
        lower, upper = np.where(own < 1, 0.0, 1.0), np.where(own > 1, np.inf, 1.0)
    else:
        share = np.array([weights.get(d, 0.0) for d in model.domains])
        targets = now.sum() * share / max(share.sum(), 1e-12)
    return fit_rates(members, targets, lower=lower, upper=upper)


def with_rates(members: DataFrame, rates: Rates, *keys: Column) -> DataFrame:
    """``members`` with ``rate`` and ``copies``."""
    shared = members.sparkSession.sparkContext.broadcast(rates)

    @F.pandas_udf("double")
    def rate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tokens, posterior in batches:
            yield pd.Series(shared.value.of(tokens.to_numpy(dtype=float), np.stack(posterior.to_numpy())) if len(tokens) else [], dtype="float64")

    # a filter on the copies isn't to work the rates out a second time
    return members.withColumn("rate", rate.asNondeterministic()("tokens", "posterior")).withColumn("copies", copies(F.col("rate"), *keys))


def mix(docs: DataFrame, model: DomainModel, weights: dict[str, float], key: str = "doc_id", text: str = "text", keep: float | None = None) -> DataFrame:
    """``docs`` with ``tokens``, ``posterior``, ``rate`` and ``copies``.

    ``weights`` gives each domain's target share of the tokens.  Where ``keep`` is
    given, the targets are instead what is left of the domains' expected tokens
    if documents kept the weight of their likeliest domain (``keep`` where it has
    none); a weight of 1 leaves these documents at rate 1, a smaller one at 0 to 1,
    a larger one at 1 or more.  Equal rows get equal rates; an empty table stays empty; null texts
    have no tokens and rate 1.  Columns with these four names are replaced.

    The texts are classified once: they are written with their membership, which
    is all that the fit reads.
    """
    docs = docs.drop("tokens", "posterior", "rate", "copies")
    members = materialise(soft_membership(docs, model, text), "mix-members")
    return with_rates(members, rates_for(members.select("tokens", "posterior"), model, weights, keep), F.col(key), F.xxhash64(text))


def quality_domains(labels: DataFrame) -> DataFrame:
    """The labelled table as ``doc_id, domain``: toxic, poor or good texts."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality") == 0, "poor").alias("domain"))


#: Shares of the tokens that the mixture aims at.
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_domains(docs, quality_domains(table(spark, sf_dir, "labels")))
    # the result has no text, so the documents' memberships are kept and nothing is classified twice
    members = materialise(soft_membership(docs, model).select("doc_id", F.xxhash64("text").alias("h"), "tokens", "posterior"), "mix-members")
    out = with_rates(members, rates_for(members, model, TARGETS), F.col("doc_id"), F.col("h"))
    return out.select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)), "rate", "copies")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: good texts stay as they are, others are taken less often."""
    model = fit_domains(docs, quality_domains(table(spark, sf_dir, "labels")))
    out = mix(docs, model, {"good": 1.0, "poor": 0.5, "toxic": 0.1}, keep=1.0)
    return out.where("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)
