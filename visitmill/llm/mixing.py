"""Mixing documents so that their domains reach target shares of the tokens; DataFrame functions only.

Method: soft membership. A naive Bayes classifier, learned from a labelled table, gives every document a posterior over the domains;
the priors are the domains' shares of the labelled tokens, so that words which tell little leave those shares as they are.
Projected-gradient least squares then finds a nonnegative rate for each document such that the expected tokens of each domain,
sum(rate * tokens * posterior), meet their targets in relative squared error. The gradient is preconditioned by the Gram matrix of
the rows whose rate is not 0, domains by domains, so that few steps are needed; where such a step gains too little, it is halved, then
replaced by a plain gradient step, which always gains. The descent ends when every target is met to CLOSE, or, where no rates meet
them, when a plain step gains nothing any more: the rates are then those of least error. A step needs one aggregation over the
documents. Rates are an expression of the posteriors and the latest steps, and are written out every few steps.

Defined cases: null or empty text has no tokens and rate 1. Labels with a null id, a null domain or no document are unused, a document
with several labels counts for each. A domain without labelled documents is unknown; without any, all documents get rate 1. Rows that
repeat doc_id and text get the same posterior and rate. Target weights are scaled to sum to 1, a domain without a target gets 0.
Output columns are those named below.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitmill.llm.shared import SPACE, saved, scratch

#: Buckets of hashed words.
WORDS = 8192
#: Largest relative error of a target that counts as met.
CLOSE = 0.001
#: Smallest relative gain of a plain step that is worth another one.
GAIN = 1e-7
#: Steps held in one expression before the rates are written out.
HELD = 6


def _tag() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def posteriors(docs: DataFrame, labels: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """(doc_id, tag, n_tokens, p0, p1, ...) for each row, and the domains in that order."""
    found = F.filter(F.split(F.coalesce("text", F.lit("")), f"{SPACE}+"), lambda w: w != "")
    features = saved(_plain(docs).select("doc_id", _tag().alias("tag"), F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int")).alias("f")), "features", folder)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna()
    counts = saved(features.join(known.distinct().hint("merge"), "doc_id").select("domain", F.explode("f").alias("w"))
                   .groupBy("domain", "w").agg(F.count(F.lit(1)).alias("n")), "counts", folder)
    totals = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted(totals)
    sized = features.select("doc_id", "tag", F.size("f").cast("long").alias("n_tokens"))
    if len(domains) < 2:
        return saved(sized.select("*", *[F.lit(1.0).alias(f"p{k}") for k in range(len(domains))]), "posteriors", folder), domains
    # One row per word bucket: the log likelihoods of all domains, less that of the first. At most WORDS rows.
    own = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) for d in domains]
    logs = [F.log((c + 1.0) / (totals[d] + WORDS)) for c, d in zip(own, domains)]
    table = counts.groupBy("w").agg(*[(x - logs[0]).alias(f"l{k}") for k, x in enumerate(logs)])
    means = (features.select("doc_id", "tag", F.explode("f").alias("w")).join(F.broadcast(table), "w")
             .groupBy("doc_id", "tag").agg(*[F.avg(f"l{k}").alias(f"m{k}") for k in range(len(domains))]))
    # A mean, not a sum, so that repeated rows change nothing; words of one text depend on each other, hence the root.
    scored = (sized.select(F.col("doc_id").alias("own_id"), F.col("tag").alias("own_tag"), "n_tokens")
              .join(means, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tag") == F.col("tag")), "left"))
    share = [totals[d] / sum(totals.values()) for d in domains]
    power = [F.coalesce(F.col(f"m{k}"), F.lit(0.0)) * F.sqrt("n_tokens") + F.log(F.lit(share[k])) for k in range(len(domains))]
    top = F.greatest(*power)
    weights = [F.exp(x - top) for x in power]
    return saved(scored.select(F.col("own_id").alias("doc_id"), F.col("own_tag").alias("tag"), "n_tokens",
                               *[(w / reduce(Column.__add__, weights)).alias(f"p{k}") for k, w in enumerate(weights)]), "posteriors", folder), domains


@dataclass
class _State:
    """Tokens per domain at a rate, and the Gram matrix of the posteriors of rows above 0, weighted by tokens."""

    rate: Column
    tokens: np.ndarray
    gram: np.ndarray


def _moved(rate: Column, step: np.ndarray) -> Column:
    """Against the gradient, staying at 0 or above."""
    return F.greatest(F.lit(0.0), rate - reduce(Column.__add__, [F.col(f"p{k}") * float(x) for k, x in enumerate(step)]))


def _state(table: DataFrame, rate: Column, count: int) -> _State:
    n, pairs = F.col("n_tokens"), [(a, b) for a in range(count) for b in range(a, count)]
    sums = [F.sum(n * F.col(f"p{k}") * rate) for k in range(count)]
    sums += [F.sum(F.when(rate > 0, n * F.col(f"p{a}") * F.col(f"p{b}"))) for a, b in pairs]
    found = [x or 0.0 for x in table.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]
    gram = np.zeros((count, count))
    for (a, b), x in zip(pairs, found[count:]):
        gram[a, b] = gram[b, a] = x
    return _State(rate, np.array(found[:count], dtype=float), gram)


def fit_rates(table: DataFrame, targets: list[float], folder: str) -> DataFrame:
    """table (n_tokens, p0, p1, ...) with a column rate. targets are tokens per domain."""
    table = table.withColumn("rate", F.lit(1.0))
    if not targets:
        return table
    want = np.array(targets, dtype=float)
    scale = np.maximum(want, max(want.sum(), 1.0) * 1e-4)

    def error(s: _State) -> float:
        return float((((s.tokens - want) / scale) ** 2).sum())

    now = _state(table, F.col("rate"), len(want))
    # The longest plain step that cannot overshoot, from two bounds of the Hessian's largest eigenvalue: its trace, and Gershgorin's.
    bound = max(min((np.diag(now.gram) / scale ** 2).sum(), (now.gram / np.outer(scale, scale)).sum(axis=1).max()), 1e-300)
    held = written = 0
    while np.abs((now.tokens - want) / scale).max() >= CLOSE:
        off = (now.tokens - want) / scale
        step = np.linalg.lstsq(now.gram / scale[:, None], off, rcond=1e-10)[0]
        for share in (1.0, 0.5, 0.25):
            new = _state(table, _moved(now.rate, share * step), len(want))
            if error(new) <= (1 - share / 2) * error(now):
                break
        else:
            new = _state(table, _moved(now.rate, off / scale / bound), len(want))
            if error(new) > (1 - GAIN) * error(now):
                break
        now, held = new, held + 1
        if held == HELD:
            table = saved(table.withColumn("rate", now.rate), f"rates-{written}", folder)
            now.rate, held, written = F.col("rate"), 0, written + 1
    return table.withColumn("rate", now.rate)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, tag, n_tokens, posterior, rate, copies): rate is the document's expected number of copies, copies a whole number
    with that expectation, drawn from a hash of doc_id and text. labels has doc_id and domain; posterior maps each domain."""
    folder = scratch(docs.sparkSession)
    table, domains = posteriors(docs, labels, folder)
    total = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    own = [max(0.0, weights.get(d, 0.0)) for d in domains]
    rated = fit_rates(table, [float(total) * w / sum(own) for w in own] if sum(own) > 0 and total else [], folder)
    rate = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("rate"))
    chance = F.pmod(F.xxhash64("tag", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    posterior = F.map_from_arrays(F.array(*[F.lit(d) for d in domains]).cast("array<string>"), F.array(*[F.col(f"p{k}") for k in range(len(domains))]).cast("array<double>"))
    return (rated.select("doc_id", "tag", "n_tokens", posterior.alias("posterior"), rate.alias("rate"))
            .withColumn("copies", F.floor(F.col("rate") + chance).cast("long")))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The rows of docs, each as often as its copies say."""
    copies = mix(docs, labels, weights).groupBy("doc_id", "tag").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_tag"))
    return (rows.join(copies, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tag") == F.col("tag"))).filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*"))
