"""Periodic run detection: stretches of words that repeat with a period, such as looped or stuttering text.

A run is a stretch of consecutive words with smallest period q, of at least ``min_exp`` periods and
``min_words`` words, that no neighbouring word extends. Words are runs of characters that aren't ASCII white space.

All-lag scan: a text's words become numbers, and the array is compared with itself shifted by every lag up to
n / min_exp; a stretch of equal places that is long enough is a run, unless a divisor of the lag is a period as well.
Texts of a batch lie one after another, longest first, so one comparison serves all texts that are long
enough for a lag. Work grows with n * lags: texts beyond ``WORK`` comparisons are cut into (text, lag range)
rows of that much work each, dealt over all machines, and their runs are put together afterwards.

Nulls and edges: a null, empty or blank text has no words and no runs; a null doc_id is kept as it is; rows that share a
doc_id are treated one by one; equal rows give equal rows; a run never spans two texts; an empty table gives an empty
result. Columns but doc_id and text are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from gitstrata.llm import store, text as T

#: Comparisons of one row of work; words of texts that are compared together.
WORK, TOGETHER = 1 << 27, 300_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def numbers(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and a number for each, equal for equal words. bytes.split knows the six white spaces and no others."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    known: dict[bytes, int] = {}
    return words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def scan(arrays: list[np.ndarray], low: int, high: int | None, min_exp: int, min_words: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each array with a period from ``low`` to ``high``."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in arrays]
    order = sorted(range(len(arrays)), key=lambda k: -len(arrays[k]))
    sizes = np.array([len(arrays[k]) for k in order], np.int64)
    starts = np.append(0, np.cumsum(sizes))
    # numbers of different texts differ, so no place equals one of another text
    kinds = np.append(0, np.cumsum([int(arrays[k].max()) + 1 if len(arrays[k]) else 0 for k in order]))
    x = np.concatenate([arrays[k].astype(np.int64) + kinds[j] for j, k in enumerate(order)] or [np.empty(0, np.int64)])
    x = x.astype(np.int32) if kinds[-1] < 2**31 else x
    for q in range(low, (high or int(sizes[0] // min_exp) if len(sizes) else 0) + 1):
        least = max(min_words, min_exp * q)
        n = int(starts[np.searchsorted(-sizes, -least, "right")])  # texts that are long enough come first
        if not n:
            break
        same = np.flatnonzero(x[: n - q] == x[q:n])
        if not len(same):
            continue
        cut = np.flatnonzero(np.diff(same) != 1)
        first, last = same[np.append(0, cut + 1)], same[np.append(cut, len(same) - 1)]
        for s, e in zip(first[(long_ := last - first + 1 + q >= least)].tolist(), last[long_].tolist()):
            if all((x[s : s + q] != x[s + q // f : s + q + q // f]).any() for f in prime_factors(q)):
                j = int(np.searchsorted(starts, s, "right")) - 1
                runs[order[j]].append((s - int(starts[j]), e - s + 1 + q, q))
    return runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by one space, without those that any run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    low = total = 0
    for k, s in enumerate(sizes):
        if total and total + s > TOGETHER:
            yield low, k
            low, total = k, 0
        total += s
    if sizes:
        yield low, len(sizes)


def _whole(docs: DataFrame, min_exp: int, min_words: int) -> DataFrame:
    """doc_id, n_words, runs, collapsed of texts that one row of work covers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"]
            for low, high in _together([len(t or "") // 6 for t in texts]):
                read = [numbers(t) for t in texts[low:high]]
                found = [sorted(r) for r in scan([x for _, x in read], 1, None, min_exp, min_words)]
                yield pd.DataFrame({
                    "doc_id": ids.iloc[low:high].to_numpy(), "n_words": [len(w) for w, _ in read],
                    "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], "collapsed": [collapsed(w, r) for (w, _), r in zip(read, found)],
                })

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id string, n_words bigint, runs array<{RUN}>, collapsed string")


def _ranges(parts: DataFrame, min_exp: int, min_words: int) -> DataFrame:
    """parts: key, text, low, high (lags). key and runs with those periods."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text, low, high in zip(b["key"], b["text"], b["low"], b["high"]):
                runs = scan([numbers(text)[1]], int(low), int(high), min_exp, min_words)[0]
                yield pd.DataFrame({"key": pd.Series([key] * len(runs), dtype=object), "start": [r[0] for r in runs], "length": [r[1] for r in runs], "period": [r[2] for r in runs]})

    return parts.mapInPandas(run, "key string, start bigint, length bigint, period bigint")


def _without(texts: DataFrame) -> DataFrame:
    """texts: doc_id, text, copies, n_words, runs. The same result as ``_whole``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text, copies, n, runs in zip(b["doc_id"], b["text"], b["copies"], b["n_words"], b["runs"]):
                runs = [] if runs is None else sorted((r["start"], r["length"], r["period"]) for r in runs)
                row = {"doc_id": doc, "n_words": n, "runs": [{"start": s, "length": k, "period": p} for s, k, p in runs], "collapsed": collapsed((text or "").encode("utf-8", "surrogatepass").split(), runs)}
                yield pd.DataFrame({c: pd.Series([v] * int(copies), dtype=object) for c, v in row.items()})

    return texts.mapInPandas(run, f"doc_id string, n_words bigint, runs array<{RUN}>, collapsed string")


def periodic_runs(docs: DataFrame, min_exp: int = 4, min_words: int = 6, work: int = WORK) -> DataFrame:
    """docs: doc_id, text. doc_id, n_words, runs (start and length in words, period; by start, then period), collapsed (the
    words without the repeats); a row for each row. ``work``: comparisons beyond which a text's lags are split."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    # a word and the space behind it take two characters at least, so few texts need to be counted
    heavy = (F.char_length(T.whole(F.col("text"))) / 2 + 1) ** 2 / min_exp > work
    lags = F.floor(F.col("n_words") / min_exp)
    counted = rows.filter(heavy).withColumn("n_words", T.n_words(F.col("text")))
    light = rows.filter(~heavy).unionByName(counted.filter(F.col("n_words") * lags <= work).drop("n_words"))
    out = _whole(light, min_exp, min_words)
    key = F.concat_ws(":", F.coalesce("doc_id", F.lit("")), F.sha2("text", 256))
    long_ = counted.filter(F.col("n_words") * lags > work).withColumn("key", key).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    long_ = store.written(long_, "long")
    if not long_.isEmpty():
        step = F.greatest(F.lit(1), F.floor(F.lit(work) / F.col("n_words"))).cast("long")
        parts = long_.withColumn("step", step).select("key", "text", "step", lags.cast("long").alias("top"), F.explode(F.sequence(F.lit(1).cast("long"), lags.cast("long"), step)).alias("low"))
        parts = parts.select("key", "text", "low", F.least("top", F.col("low") + F.col("step") - 1).alias("high"))
        found = store.written(_ranges(parts.repartition("key", "low"), min_exp, min_words), "runs")
        runs = found.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # fewer than the text has words
        out = out.unionByName(_without(long_.join(runs, "key", "left").select("doc_id", "text", "copies", "n_words", "runs")))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def planted(docs: DataFrame) -> DataFrame:
    """A test bed: in a tenth of the documents (crc32 of doc_id divisible by 10) the words from some place on repeat the first
    few from there. Null doc_ids have no number and stay as they are."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def looped(w: Column) -> Column:
        size = F.size(w)
        at = (g % size).cast("int")
        every = (1 + F.floor((size - at) / (3 + g % 8))).cast("int")
        return F.transform(w, lambda x, i: F.when(i < at, x).otherwise(F.get(w, at + (i - at) % every)))

    words = T.words(F.col("text"))
    damaged = T.let(words, lambda w: F.when(F.size(w) > 0, F.array_join(looped(w), " ")).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, damaged).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """Of runs the one with the greatest length / period; ties go to the smallest start, then period; null for none."""
    better = lambda a, b: F.when(a.isNull(), b).when(b.length * a.period > a.length * b.period, b).otherwise(a)  # noqa: E731  the first of equals stays
    return F.aggregate(runs, F.lit(None).cast(RUN), better)


# tasks get this code with their closures, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
