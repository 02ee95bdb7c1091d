"""MinHash near-dedup: bottom-k sketches from one hash function.

A document's set holds its distinct word shingles; its sketch the k smallest hashes. Documents with
equal sets form a class and are linked through it. Between classes, inverted lists of sketch values
give candidates: two sets that are similar enough share at least ``overlap`` sketch values, so it
suffices to list, for each sketch, all but ``overlap - 1`` of its values, the most frequent ones left
out. Values that occur once can't meet and only shorten the list.

Members of short lists are compared pair by pair. In a long list one member, the one whose values are
the most common, is compared with all others, so a group of n near copies costs about n pairs and not n
squared. Lists whose members are then all linked need no more; the documents of the others are joined
exactly, on their full sets: by the rarest shingles of each, with bounds from the sizes and from where
in that order the common shingle stands. Only documents that aren't linked yet are paired. So no pair
is left out that the lists would give. Pairs pass the estimate from the union's sketch, then the exact
Jaccard similarity of the full sets.

With k = 64 a pair at exactly the threshold 0.8 has fewer shared values than asked for with a
probability below 1e-6, a more similar pair far less; sets of at most 51 shingles are compared in full.

Nulls and edges: a null or empty text has the empty set and is linked with nothing; a null doc_id is
linked with nothing, its component is null and it is kept; rows that share a doc_id are one document: the
links of each of its texts are its links, and all its rows have one component; texts of any length are
compared whole; an empty table gives an empty result. Columns named as those added here are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from gitstrata.llm import components, shingles, store

# tasks get this code with their closures, so executors need no copy of the package
cloudpickle.register_pickle_by_value(shingles)

K = 64
#: Lists of at most so many members are compared pair by pair at once; for longer ones, see the module's text.
SHORT = 8
#: Bits of a set's parity.
BITS = 512


def _sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for low, high in shingles.chunks([len(t or "") for t in texts]):
                sets = shingles.shingle_sets(texts[low:high], width)
                with np.errstate(over="ignore"):
                    sums = [(int(shingles.mix(s.view(np.uint64)).sum().view(np.int64)), int(shingles.mix(s.view(np.uint64) ^ np.uint64(0x5555)).sum().view(np.int64))) if len(s) else (0, 0) for s in sets]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[low:high].to_numpy(), "n": [len(s) for s in sets], "s1": [x[0] for x in sums], "s2": [x[1] for x in sums], "sketch": [s[:k] for s in sets]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, members, parity) of the documents in ``ids``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for low, high in shingles.chunks([len(t or "") for t in texts], 500_000):
                sets = shingles.shingle_sets(texts[low:high], width)
                yield pd.DataFrame({"id": b["doc_id"].iloc[low:high].to_numpy(), "members": sets, "parity": [parity(s) for s in sets]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInPandas(run, "id bigint, members array<bigint>, parity array<bigint>")


def parity(members: np.ndarray) -> np.ndarray:
    """BITS bits: whether the number of members that fall to each is odd. Each member that only one of two sets holds turns
    one bit, so two sets differ in at least as many members as these differ in bits."""
    odd = np.bincount(members.view(np.uint64) % np.uint64(BITS), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _parity_bound(a: str, b: str) -> Column:
    """The least number of members that only one of the two sets holds."""
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)]
    return sum(bits[1:], bits[0])


def _overlap(n: Column, k: int, threshold: float) -> Column:
    """How many sketch values a set of size n shares at least with one similar enough: all of them are
    compared where both sketches are whole; else by the tails of the binomial distribution."""
    size = F.least(n, F.lit(k))
    wide = max(1, math.floor(k * threshold - 5 * math.sqrt(k * threshold * (1 - threshold))))
    part = F.greatest(F.lit(1), F.floor(0.35 / 0.8 * threshold * size))
    return F.when(n <= threshold * k, F.ceil(threshold * n - 1e-9)).when(n <= k / threshold, part).otherwise(wide).cast("int")


def _lists(reps: DataFrame, k: int, threshold: float) -> DataFrame:
    """(value, id, n, score): the inverted lists of the values that each sketch must list; score tells how common
    a sketch's values are."""
    values = reps.select("id", "n", F.explode("sketch").alias("value"))
    shared = store.written(values.groupBy("value").agg(F.count("*").alias("freq")).filter("freq > 1"), "shared")
    met = values.join(shared.hint("shuffle_hash"), "value")
    mine = met.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("v"), F.sum("freq").alias("score"))  # at most k of a sketch
    mine = mine.withColumn("take", F.size("v") - _overlap(F.col("n"), k, threshold) + 1).filter("take > 0")
    return mine.select("id", "n", "score", F.explode(F.slice("v", F.lit(1), F.col("take"))).alias("x")).select("x.value", "id", "n", "score")


def _near(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as edges (u, v)."""
    side = lambda t, x, what: t.select(F.col("id").alias(x), F.col(what).alias(f"s{x}"))
    est = pairs.join(side(reps, "a", "sketch"), "a").join(side(reps, "b", "sketch"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    est = est.withColumn("_u", union).filter(F.size(F.array_intersect(F.array_intersect("_u", "sa"), F.col("sb"))) >= F.lit(0.6 * threshold) * F.size("_u"))
    close = store.written(est.select("a", "b"), "close")
    exact = close.join(side(sets, "a", "members"), "a").join(side(sets, "b", "members"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    hundred = round(100 * threshold)
    return exact.filter(100 * both >= hundred * (F.size("sa") + F.size("sb") - both)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _still_open(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """(id, c): members, with their components, of the lists that hold more than one component."""
    now = store.written(lists.join(comp, F.col("id") == F.col("vertex"), "left").select("value", "id", F.coalesce("component", "id").alias("c")), "now")
    mixed = store.written(now.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("value"), "mixed")
    return now.join(mixed, "value").select("id", "c").distinct()


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _all_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """All pairs of lists with at most SHORT members, made inside a row for each list."""
    rows = lists.groupBy("value").agg(F.collect_list(F.struct("id", "n")).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice(F.col("l"), i + 2, F.size("l")), lambda y: F.struct(x.id.alias("x"), y.id.alias("y"), x.n.alias("n"), y.n.alias("nn")))))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").filter(_near("n", "nn", threshold)).select(*_pair("x", "y"))


def _star_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """For each list the member with the most common values, paired with all others."""
    centre = store.written(lists.groupBy("value").agg(F.max_by(F.struct("id", "n"), F.struct("score", -F.col("id"))).alias("m")), "centres")
    pairs = lists.join(centre, "value").select(F.col("id").alias("x"), F.col("m.id").alias("y"), "n", F.col("m.n").alias("nn"))
    return pairs.filter((F.col("x") != F.col("y")) & _near("n", "nn", threshold)).select(*_pair("x", "y"))


def _exact_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of documents (id, members, parity, c) of different components that may be similar enough: a prefix join.

    In each set, shingles are ordered by how many of the documents hold them. If two sets of sizes n <= m are
    similar enough they share share * (n + m) shingles, so the first of them in the order is among the first
    n - 2 share n + 1 of the smaller set and the first m - threshold * m + 1 of the larger, and from there on both
    have that many left. Documents that share a very common passage pass that in large numbers; the parities of
    their sets tell most of them apart, as they can't differ in more members than a pair at the threshold may."""
    share = threshold / (1 + threshold)
    rows = sets.select("id", "c", F.size("members").alias("n"), F.explode("members").alias("h"))
    parities = sets.select("id", "parity")
    shared = store.written(rows.groupBy("h").agg(F.count("*").alias("freq")).filter("freq > 1"), "shared")
    v = rows.join(shared.hint("shuffle_hash"), "h").groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "h"))).alias("v"))
    first = F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9) + 1
    last = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1
    alone = F.col("n") - F.size("v")  # shingles that no other document holds come first
    listed = v.select("id", "c", "n", first.alias("first"), alone.alias("alone"), F.slice("v", F.lit(1), F.greatest(F.lit(0), last - alone).cast("int")).alias("v"))
    listed = listed.select("id", "c", "n", "first", "alone", F.posexplode("v").alias("k", "x")).select("id", "c", "n", "first", "x.h", (F.col("alone") + F.col("k")).alias("p"))
    listed = store.written(listed, "listed")
    smaller = listed.filter("p < first").drop("first")
    stats = store.written(smaller.groupBy("h").agg(F.min("n").alias("least"), F.min("c").alias("lo"), F.max("c").alias("hi")), "stats")
    # a larger set with p shingles passed by has room for partners up to this size only
    room = F.floor((F.col("n") - F.col("p")) / share - F.col("n") + 1e-6)
    larger = store.written(listed.drop("first").join(stats, "h").filter((F.col("n") >= F.col("least")) & (room >= F.col("least"))), "larger")
    mixed = larger.groupBy("h").agg(F.least(F.min("lo"), F.min("c")).alias("lo"), F.greatest(F.max("hi"), F.max("c")).alias("hi")).filter("lo < hi").select("h")
    mixed = store.written(mixed, "mixed")
    a = store.written(smaller.join(mixed, "h").join(parities, "id"), "smaller").select("h", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("p").alias("px"), F.col("parity").alias("parity_x"))
    larger = store.written(larger.join(mixed, "h", "left_semi").join(parities, "id"), "larger")
    left = F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("p"))
    ordered = (F.col("nx") < F.col("n")) | ((F.col("nx") == F.col("n")) & (F.col("x") < F.col("id")))
    alike = _parity_bound("parity_x", "parity") <= (1 - 2 * share) * (F.col("nx") + F.col("n")) + 1e-6
    pairs = a.join(larger.select("h", "id", "c", "n", "p", "parity"), "h").filter(ordered & (F.col("cx") != F.col("c")) & (left >= share * (F.col("nx") + F.col("n")) - 1e-6) & alike)
    return pairs.select(*_pair("x", "id"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, k: int = K) -> DataFrame:
    """doc_id, n_shingles (long), component_id, kept for each row of ``docs``; see the module's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.filter("doc_id is not null")
    if ids.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").isEmpty():
        out = _grouped(ids, width, threshold, k)
    else:
        out = _by_row(ids, width, threshold, k)
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = _sketches(rows.filter("doc_id is null"), width, k).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def _by_row(rows: DataFrame, width: int, threshold: float, k: int) -> DataFrame:
    """For tables whose doc_ids repeat: rows are grouped under numbers of their own, then the groups that share a doc_id are joined."""
    own = store.written(rows.select(F.col("doc_id").alias("_own"), "text").withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    out = store.written(_grouped(own, width, threshold, k).join(own.select("doc_id", "_own"), "doc_id"), "rows")
    heads = store.written(out.groupBy("component_id").agg(F.min("_own").alias("_head")), "heads")
    edges = out.join(heads, "component_id").select(F.col("_own").alias("u"), F.col("_head").alias("v"))
    comp = store.written(components.components(edges), "components")
    return out.join(comp, F.col("_own") == F.col("vertex"), "left").select(F.col("_own").alias("doc_id"), "n_shingles", F.coalesce("component", "_own").alias("component_id"))


def _grouped(docs: DataFrame, width: int, threshold: float, k: int) -> DataFrame:
    """doc_id, n_shingles, component_id of the rows with a doc_id, which all differ."""
    sk = store.written(_sketches(docs, width, k), "sketches")
    classes = store.written(sk.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id")), "classes")
    reps = store.written(sk.select("doc_id", "sketch").join(classes.select("id", "n"), F.col("doc_id") == F.col("id")).select("id", "n", "sketch"), "reps")
    lists = store.written(_lists(reps, k, threshold), "lists")
    sizes = store.written(lists.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    lists = store.written(lists.join(sizes, "value"), "lists")
    sets = store.written(_sets(docs, lists.select("id").distinct(), width), "sets")
    long_lists = lists.filter(F.col("m") > SHORT).drop("m")
    pairs = _all_pairs(lists.filter(F.col("m") <= SHORT), threshold).unionByName(_star_pairs(long_lists, threshold)).distinct()
    links = store.written(_verified(store.written(pairs, "pairs"), reps, sets, k, threshold), "links")
    comp = store.written(components.components(links), "components")
    still = store.written(_still_open(long_lists, comp), "open")
    if not still.isEmpty():
        pairs = _exact_pairs(sets.join(still, "id"), threshold).distinct()
        links = links.unionByName(_verified(store.written(pairs, "pairs"), reps, sets, k, threshold))
        comp = store.written(components.components(links), "components")
    known = store.written(classes.join(comp, F.col("id") == F.col("vertex"), "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("_c")), "known")
    return sk.select("doc_id", "n", "s1", "s2").join(known, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))
