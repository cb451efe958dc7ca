"""Mixing documents to target domain weights, with DataFrame operations only.

A naive Bayes classifier over hashed words and word shapes, fitted on labelled rows, gives every document soft memberships
in the domains.  Projected gradient descent then finds nonnegative document rates for which the expected tokens of
each domain match the targets, in the least-squares sense.  A step's direction comes from the gaps of the domains, and its
length from the curvature: the matrix of token-weighted products of memberships over the documents that are free to
move.  A document's rate follows from its own row and the few numbers of every step, so a step is one small aggregate and
no state moves; a handful of steps do.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# Slots of the hashed features; the bound on labelled rows; the evidence of n words counts like n * WORDS / (n + WORDS).
SLOTS, TRAIN_ROWS, WORDS, SMOOTH = 8192, 16_000, 60, 0.5
# Steps at most (more is an error); how near each target is to be met, as a share of it (of a thousandth of all tokens, if it is smaller).
STEPS, CLOSE = 40, 3e-4
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyzäöüßéèêçáíóúñà", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÁÍÓÚÑÀ"


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domains of the labelled table: toxic, low (quality 0) and clean."""
    return F.when(F.col(toxic) > 0, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) > 0, "clean")


def _words(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, word and slot: a row for each word of a text and one for its shape (letters and digits replaced by a, A and 0).

    word is 1 for a word and 0 for a shape, so that it sums to the tokens of a text; a text without words gives rows with slot null.
    """
    flat = F.translate(F.coalesce(F.col(text), F.lit("")), "\n\t\r", "   ")
    shape = F.translate("flat", _LOWER + _UPPER + "0123456789", "a" * len(_LOWER) + "A" * len(_UPPER) + "0" * 10)
    both = docs.select(*keep, flat.alias("flat")).select(*keep, F.explode(F.array(F.struct(F.lit(1).alias("word"), F.col("flat").alias("x")), F.struct(F.lit(0).alias("word"), shape.alias("x")))).alias("t"))
    each = both.select(*keep, F.col("t.word").alias("word"), F.explode(F.split("t.x", " ")).alias("w"))
    # a shape has its own slots, since its hash starts from another seed
    slot = F.when(F.col("w") == "", None).otherwise(F.pmod(F.xxhash64(F.col("word"), F.col("w")), F.lit(SLOTS)).cast("int"))
    return each.select(*keep, F.when(F.col("w") == "", 0).otherwise(F.col("word")).alias("word"), slot.alias("slot"))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> tuple[np.ndarray, np.ndarray]:
    """Log priors and log likelihoods (domain x slot), from about TRAIN_ROWS labelled rows with the smallest hashes of the id.

    An id with several labels takes the smallest of its domains; null ids, and domains that are null or not in
    `domains`, are not used.  Without labelled rows every domain is equally likely.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(domain_col).isin(domains)).groupBy(F.col(id_col).alias("id")).agg(F.min(domain_col).alias("domain"))
    rows = known.count()
    if rows > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / rows))
    # at most about TRAIN_ROWS short rows are broadcast; at most SLOTS x domains counts come back
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    counts = _words(sample, ["domain"], "text").where("slot IS NOT NULL").groupBy("domain", "slot").count().collect()
    table, sizes = np.full((len(domains), SLOTS), SMOOTH), np.ones(len(domains))
    for r in counts:
        table[domains.index(r["domain"]), r["slot"]] += r["count"]
    for r in known.groupBy("domain").count().collect():
        sizes[domains.index(r["domain"])] += r["count"]
    return np.log(sizes / sizes.sum()), np.log(table / table.sum(1, keepdims=True))


def memberships(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens (words) and p (posteriors in the order of `domains`) of every document."""
    prior, table = model
    # the rows of a text are together where it is read, so they are summed there
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sums = [F.sum(F.coalesce(F.get(F.lit(table[k]), F.col("slot")), F.lit(0.0))).alias(f"l{k}") for k in range(len(domains))]
    rows = _words(rows, ["row", "id"], "text").groupBy("row", "id").agg(F.sum("word").alias("tokens"), *sums)
    weight = F.lit(float(WORDS)) / (F.col("tokens") + F.lit(float(WORDS)))
    logs = rows.select("id", "tokens", F.array(*(F.col(f"l{k}") * weight + float(prior[k]) for k in range(len(domains)))).alias("logs"))
    powers = logs.withColumn("e", F.expr("transform(logs, x -> exp(x - array_max(logs)))"))
    return powers.select("id", "tokens", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))").alias("p"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], reference: str, low: float = 0.0, high: float | None = None, keep: str | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """id, tokens, p, domain (the likeliest) and rate of every document.

    weights: target shares of the domains' expected tokens; they are scaled so that the supply of domain `reference`, at
    rate 1, just meets its target.  Rates are at least `low` and, where it is given, at most `high`: a rate over 1 asks
    for a document more than once.  Documents whose likeliest domain is `keep` have a rate of 1 or more.
    Targets that the bounds or a domain without any supply put out of reach are met as nearly as they
    allow; targets in reach that STEPS steps do not meet are an error.  Ties of the likeliest
    domain go to the name that sorts first.  Null and empty texts have no tokens and the prior as memberships; rows with repeated or
    null ids each have their own rate; other columns are left out.  An empty table gives an empty table.
    """
    domains = sorted(weights)
    if any(w < 0 for w in weights.values()) or weights.get(reference, 0) <= 0 or low < 0 or (high is not None and high < low):
        raise ValueError("weights must not be negative, the reference needs one over 0, and 0 <= low <= high")
    rows = settle(memberships(docs, fit(docs, labels, domains, id_col, text_col, domain_col), domains, id_col, text_col))
    likeliest = F.get(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int") - 1)
    rows = rows.withColumn("domain", likeliest)
    most = math.inf if high is None else float(high)
    floor = F.when(F.col("domain") == keep, F.lit(max(low, min(1.0, most)))).otherwise(F.lit(float(low))) if keep else F.lit(float(low))
    p = [F.get("p", F.lit(k)) for k in range(len(domains))]
    supply = rows.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * x) for x in p)).first()
    total, supply = float(supply[0] or 0), np.array([x or 0.0 for x in supply[1:]], dtype=float)
    targets = np.array([weights[d] for d in domains]) * supply[domains.index(reference)] / weights[reference]

    def rate(steps: list[np.ndarray]) -> Column:
        def step(r: Column, g: Column) -> Column:
            for k, x in enumerate(p):
                r = r - x * F.get(g, F.lit(k))
            r = F.greatest(floor, r)
            return r if high is None else F.least(F.lit(most), r)

        start = F.lit(max(float(low), min(1.0, most)))
        return F.aggregate(F.array(*(F.lit(g) for g in steps)), start, step) if steps else start

    pairs = [(a, b) for a in range(len(domains)) for b in range(a, len(domains))]
    supplied = np.maximum(supply, 1e-9 * total)
    steps: list[np.ndarray] = []
    bold, past, least = True, None, math.inf  # bold: the last step's length came from the curvature
    for _ in range(STEPS if total else 0):
        r = rows.select("tokens", "p", "domain", rate(steps).alias("r")).withColumn("free", F.when((F.col("r") > floor) & (F.lit(high is None) | (F.col("r") < most)), F.col("tokens")).otherwise(0))
        got = r.agg(*(F.sum(F.col("r") * F.col("tokens") * x) for x in p), *(F.sum(F.col("free") * p[a] * p[b]) for a, b in pairs)).first()
        gap = np.array(got[: len(p)], dtype=float) - targets
        loss = float((gap * gap / supplied).sum()) / total
        if (np.abs(gap) < CLOSE * np.maximum(targets, total / 1000)).all():
            break
        if bold and loss > 0.999 * least:
            # too bold: a plain gradient step, whose length in the measure of the supplies is never too long, in its stead
            steps[-1], bold = past / supplied, False
            continue
        if not bold and loss > 0.999 * least:
            break  # as near as the bounds and the documents allow
        curve = np.zeros((len(p), len(p)))
        for (a, b), x in zip(pairs, got[len(p) :]):
            curve[a, b] = curve[b, a] = x
        # documents at a bound may have to leave it: a little of the whole supply keeps every direction open
        steps.append(np.linalg.lstsq(curve + 1e-3 * np.diag(supplied), gap, rcond=None)[0])
        bold, past, least = True, gap, loss
    else:
        if total:
            raise RuntimeError(f"the rates still move after {STEPS} steps: gaps {gap.tolist()} of {total} tokens")
    return rows.select(F.col("id").alias(id_col), "tokens", "p", "domain", rate(steps).alias("rate"))


def reached(mixed: DataFrame, domains: list[str]) -> DataFrame:
    """domain and tokens: the expected tokens of each domain under the rates of mix()."""
    sums = mixed.select(F.posexplode("p").alias("k", "x"), "rate", "tokens").groupBy("k").agg(F.sum(F.col("rate") * F.col("tokens") * F.col("x")).alias("tokens"))
    return sums.select(F.get(F.array(*map(F.lit, sorted(domains))), F.col("k")).alias("domain"), "tokens")
