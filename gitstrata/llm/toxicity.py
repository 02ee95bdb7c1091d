"""Toxicity: non-negative positive-unlabelled learning of a linear model.

Confirmed toxic documents are the positives, a sample of all documents the unlabelled side; labels of 0
are used for the class prior only. A document's features are its distinct words (letters, lower-cased)
and their beginnings of 4 to 6 letters. Those kept are more common among the positives than chance
allows, at a false discovery rate of ``rate``; where that leaves fewer than ``least_features``, the most
surprising ones that at least two positives have are kept, so that a few positives suffice. One positive
of each feature's is left out of account, as copies would make any word of theirs look telling.
The model minimises the class-prior-corrected logistic risk
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``, so ``1 / (1 + exp(-g))`` estimates the
probability of being toxic.

Fitting sees at most ``max_positive`` and ``max_unlabelled`` documents, those first in the order of the
md5 of doc_id, and none that is held out; the model has at most ``max_features`` features, and only those
reach the driver. Fitting counts features where the sampled texts lie. Scoring sees whole texts only, of
any length, never labels, lang, source or doc_id.

Nulls and edges: a null or empty text has no features and gets the score of the bias; labels other than
0 and 1 are ignored, a document labelled twice is toxic if one label is 1; rows that share a doc_id are
scored each by its own text; features of equal surprise are ordered by code point; without a positive
every score is 0; an empty table gives an empty result. Columns named as those added here are replaced.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from gitstrata.llm import store

WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (4, 5, 6)


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def word_features(word: str) -> list[str]:
    return [word + "$"] + [word[:n] for n in LENGTHS if len(word) >= n]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counts_of(text: str | None) -> Counter:
    """Feature -> how many distinct words of the text have it."""
    return Counter(f for w in distinct_words(text) for f in word_features(w))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    prior: float = 0.0


def nnpu(x_p: list[np.ndarray], x_u: list[np.ndarray], dim: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 3e-4) -> tuple[np.ndarray, float]:
    """Rows are arrays of feature numbers, repeated as often as they count. Adam on the whole risk; where
    the negative part falls below 0 the step is taken against it, as the method's authors propose."""

    def flat(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(xs) if xs else np.empty(0, int)).astype(int), np.repeat(np.arange(len(xs)), [len(x) for x in xs])

    sides = [flat(x_p), flat(x_u)]
    sizes = [max(1, len(x_p)), max(1, len(x_u))]
    w, m, v = (np.zeros(dim + 1) for _ in range(3))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def back(side: int, d: np.ndarray) -> np.ndarray:
        f, r = sides[side]
        return np.append(np.bincount(f, d[r], dim), d.sum())

    for t in range(1, steps + 1):
        g = [w[-1] + np.bincount(r, w[f], n) for (f, r), n in zip(sides, (len(x_p), len(x_u)))]
        negative = np.logaddexp(0, g[1]).sum() / sizes[1] - prior * np.logaddexp(0, g[0]).sum() / sizes[0]
        d_neg = [-prior * sigmoid(g[0]) / sizes[0], sigmoid(g[1]) / sizes[1]]
        if negative >= 0:
            grad = back(0, -prior * sigmoid(-g[0]) / sizes[0] + d_neg[0]) + back(1, d_neg[1])
        else:
            grad = -(back(0, d_neg[0]) + back(1, d_neg[1]))
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def tail(k: int, n: int, rate: float) -> float:
    """The logarithm of the chance that at least ``k`` of ``n`` documents have a feature that each has at ``rate``."""
    log_p, log_q = math.log(rate), math.log1p(-rate)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k, n + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in terms)))


def discoveries(log_p: list[float], tried: int, rate: float) -> int:
    """How many of the smallest of ``tried`` p-values, given in order, count at that false discovery rate (Benjamini and Hochberg)."""
    return max((i for i, p in enumerate(log_p, 1) if p <= math.log(rate * i / tried)), default=0)


def feature_counts(rows: DataFrame, keep: int = 300_000) -> DataFrame:
    """rows: text, p. (f, k, u): how many of the positives (p = 1) and of the others have a feature. A task sends on
    its counts whenever they are ``keep``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def sent() -> pd.DataFrame:
            return pd.DataFrame({"f": pd.Series([f for f, _ in c], dtype=object), "p": [p for _, p in c], "n": list(c.values())})

        for b in batches:
            for t, p in zip(b["text"], b["p"]):
                c.update((f, p) for f in counts_of(t))
                if len(c) >= keep:
                    yield sent()
                    c.clear()
        yield sent()

    got = rows.select("text", "p").mapInPandas(count, "f string, p int, n long")
    side = lambda p: F.coalesce(F.sum(F.when(F.col("p") == p, F.col("n"))), F.lit(0))
    return got.groupBy("f").agg(side(1).alias("k"), side(0).alias("u"))


def chosen_features(counts: DataFrame, n_p: int, n_u: int, prior: float, max_features: int, least_features: int, rate: float, least_docs: int = 2) -> list[str]:
    """The features, most surprising first; see the module's text. ``max_features`` rows at most are collected."""
    k, share = F.col("k") - 1, (F.col("u") + 1) / F.lit(n_u + 2.0)  # one positive less: it may be a copy of another
    a = F.least(k / F.lit(float(n_p)), F.lit(1 - 1e-9))
    surprise = a * F.log(a / share) + (1 - a) * F.log((1 - a) / (1 - share))  # Chernoff's bound orders them
    tried = counts.filter(F.col("k") >= least_docs)
    over = tried.withColumn("share", share).filter(a > F.greatest(share, 0.4 / prior * share)).select("f", k.alias("k"), "share", F.round(surprise, 9).alias("s"))
    rows = over.orderBy(F.desc("s"), "f").limit(max_features).collect()
    ordered = sorted((tail(r.k, n_p, r.share), r.f) for r in rows)
    found = discoveries([p for p, _ in ordered], max(1, tried.count()), rate)
    return [f for _, f in ordered[: max(found, least_features)]]


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12_000, max_features: int = 4000, least_features: int = 24, rate: float = 1e-3) -> Model:
    ids = F.col("doc_id").cast("long")
    lab = labels.select(ids.alias("id"), "toxic").filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, pos = lab.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    if not pos:
        return Model()
    prior = min(0.9, pos / n)
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    p = lab.filter("toxic = 1").select("id").orderBy(*order).limit(max_positive)
    u = docs.select(ids.alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id"))).orderBy(*order).limit(max_unlabelled)
    chosen = store.written(p.select("id", F.lit(1).alias("p")).unionByName(u.select("id", F.lit(0).alias("p"))), "chosen")
    # at most max_positive + max_unlabelled pairs of numbers are broadcast
    rows = store.written(docs.select(ids.alias("id"), "text").join(F.broadcast(chosen), "id").select("text", "p"), "sample")
    n_p, n_u = (rows.filter(f"p = {k}").count() for k in (1, 0))
    if not n_p:
        store.drop(rows, chosen)
        return Model()
    counts = store.written(feature_counts(rows), "features")
    names = chosen_features(counts, n_p, n_u, prior, max_features, least_features, rate)
    number = {f: i for i, f in enumerate(names)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": b["p"], "x": [[number[f] for f, n in counts_of(t).items() if f in number for _ in range(n)] for t in b["text"]]})

    # rows of the bounded sample, each with the numbers of its features
    got = rows.mapInPandas(vectors, "p int, x array<int>").toPandas()
    xs = [[np.asarray(sorted(x), int) for x in got.loc[got["p"] == k, "x"]] for k in (1, 0)]
    w, bias = nnpu(sorted(xs[0], key=tuple), sorted(xs[1], key=tuple), len(number), prior, l2=max(3e-4, 0.02 / n_p))
    store.drop(rows, chosen, counts)
    return Model({f: float(w[i]) for f, i in number.items()}, bias, prior)


def score(docs: DataFrame, model: Model, keep: int = 200_000) -> DataFrame:
    """All columns of ``docs``, score (double) and predicted (int). ``keep`` bounds a worker's memory of words."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            out = []
            for t in texts:
                g = bias
                for w in distinct_words(t):
                    x = known.get(w)
                    if x is None:
                        if len(known) >= keep:
                            known.clear()
                        x = known[w] = sum(weights.get(f, 0.0) for f in word_features(w))
                    g += x
                out.append(g)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.round(np.array(out, float), 9), -50, 50))), dtype=float)

    return docs.withColumn("score", probability(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
