"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Texts are compared as words: lower-cased, with all but letters and digits removed. An item's windows in
a document have as many words as the item; one is laid at every start from which enough of the window's
shingles occur in items of that size for the threshold to be reached at all, in whatever order they
stand (the others' similarity is below it). Each window gets a 64-bit SimHash of its shingles. Windows
and items of one size meet in an index of Hamming blocks: they must agree on one of ``radius + 1``
blocks of bits, which all fingerprints within ``radius`` do. As blocks of that radius are 2 or 3 bits
wide, each entry of the index also carries a shingle: one of the item's rarest, of which a pair that
reaches the threshold shares at least one. So a window meets the items that it has such a shingle in
common with, not all of its size. The index holds ids, shingles and fingerprints only; shingles of the
pairs within the radius are fetched for the exact weighted Jaccard similarity, weighted by how often
each occurs. At similarity 0.8 two fingerprints differ in about 10 bits (standard deviation 2.9), so a
radius of 23 loses about 2 in a million pairs at the threshold itself and none at 1.

Nulls and edges: null or empty texts and items match nothing; items of fewer than ``width`` words have
their whole sequence as one shingle; a document shorter than an item is compared whole; rows with the
same doc_id and text are one, rows with the same doc_id and other texts give the doc_id's best window, and
so do items that share an item_id;
of windows of equal similarity the first counts; null ids are kept as they are; texts and items may be of
any length. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gitstrata.llm import store, text as T

WIDTH, THRESHOLD, RADIUS = 5, 0.8, 23
#: At most so many of the benchmark's shingles (three numbers each) are broadcast at once.
SMALL_ROWS = 500_000
#: Windows that are cut from one row at a time.
TOGETHER = 2048


def plain_words(text: Column) -> Column:
    return T.words(F.regexp_replace(F.lower(T.whole(text)), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def grams(words: Column, width: Column | int) -> Column:
    """The hashes of the shingles of ``width`` words, in order."""
    w = F.lit(width) if isinstance(width, int) else width
    return T.let(words, lambda ws: F.when(F.size(ws) < w, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(ws) - w + 1), lambda i: F.xxhash64(F.slice(ws, i, w)))))


def simhash(shingles: Column) -> Column:
    """Bit b is set if at least half of the shingles have it set."""
    bit = lambda s, b: F.call_function("getbit", s, b)
    votes = lambda b: F.aggregate(shingles, F.lit(0).cast("long"), lambda a, s: a + 2 * bit(s, b) - 1)
    word = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(votes(b) >= 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))
    return word


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that cover 64 bits."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_values(fingerprint: Column, radius: int) -> Column:
    return F.array(*(F.call_function("shiftright", fingerprint, F.lit(a)).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for a, n in blocks(radius)))


def repeated(sorted_values: Column) -> Column:
    """The values that a sorted array holds more than once, each once."""
    return F.array_distinct(F.filter(sorted_values, lambda x, k: (k > 0) & (x == F.get(sorted_values, k - 1))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two sorted arrays as multisets."""
    count = lambda arr, h: F.size(F.filter(arr, lambda x: x == h))
    more = F.aggregate(F.array_intersect(repeated(a), repeated(b)), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)) - 1)
    both = F.size(F.array_intersect(a, b)) + more
    return both / (F.size(a) + F.size(b) - both)


def prepared_items(benchmark: DataFrame, width: int, radius: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("_w")).distinct().withColumn("n_words", F.size("_w")).filter("n_words > 0")
    items = items.withColumn("width", F.least(F.lit(width), F.col("n_words"))).withColumn("grams", grams(F.col("_w"), F.col("width")))
    return items.withColumn("print", simhash(F.col("grams"))).select("item_id", F.xxhash64("_w").alias("item_key"), "n_words", "width", "grams", "print")


def starts(at: Column, n: Column, n_words: Column, width: Column, need: Column) -> Column:
    """The first words of all windows of ``n_words`` words in a document of ``n`` that hold at least ``need``
    of the places ``at`` (sorted, at least ``need`` of them)."""
    words = F.least(n, n_words)
    reach = words - width  # from a window's first shingle to its last
    # starts are dealt to the first place that is not before them, so none comes twice
    low = lambda j: F.greatest(F.lit(0), F.get(at, j + need - 1) - reach, F.coalesce(F.get(at, j - 1) + 1, F.lit(0)))
    high = lambda j: F.least(F.get(at, j), n - words)
    some = lambda j: F.when(low(j) <= high(j), F.sequence(low(j), high(j))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), some))


def least_shared(n: Column, n_words: Column, width: Column, threshold: float) -> Column:
    """How many shingles a window must share with an item of ``n_words`` words to be as similar as ``threshold``."""
    both = F.least(n, n_words) - width + 1 + n_words - width + 1
    return F.greatest(F.lit(1), F.ceil(both * threshold / (1 + threshold) - 1e-9).cast("int"))


def item_index(items: DataFrame, threshold: float, radius: int) -> DataFrame:
    """(n_words, h, block, bits, item_id, ip): each item's blocks beside each of its rarest shingles.

    A window as similar as ``threshold`` has ``threshold`` of the item's shingles at least, so it has one of the
    others' number plus one; which ones are taken is free, and the rarest meet fewest."""
    every = items.select("item_id", "item_key", "n_words", "print", F.size("grams").alias("m"), F.explode(F.array_distinct("grams")).alias("h"))
    freq = every.groupBy("n_words", "h").agg(F.count("*").alias("freq"))
    mine = every.join(freq, ["n_words", "h"]).groupBy("item_id", "item_key", "n_words", "print", "m").agg(F.sort_array(F.collect_list(F.struct("freq", "h"))).alias("v"))
    rare = mine.select("item_id", "n_words", F.col("print").alias("ip"), F.explode(F.slice("v", F.lit(1), (F.col("m") - F.ceil(F.col("m") * threshold - 1e-9) + 1).cast("int"))).alias("x"))
    return rare.select("item_id", "n_words", "ip", "x.h", F.posexplode(block_values(F.col("ip"), radius)).alias("block", "bits"))


def laid_windows(docs: DataFrame, items: DataFrame, threshold: float, small_rows: int) -> DataFrame:
    """(doc_id, _x, wins): for each document with any, its windows as structs start, n_words, width, an array by start for each size."""
    by_gram = store.written(items.select(F.explode("grams").alias("h"), "n_words", "width").distinct(), "grams")
    slices = max(1, -(-by_gram.count() // small_rows))
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most ``width`` numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(T.whole(F.col("text"))).alias("_x"), plain_words(F.col("text")).alias("_w"))
    laid = None
    for w in widths:
        each = rows.select("doc_id", "_x", F.size("_w").alias("_n"), F.posexplode(grams(F.col("_w"), w)).alias("_p", "h"))
        for part in range(slices):
            # of about small_rows rows
            some = by_gram.filter((F.col("width") == w) & (F.pmod(F.col("h"), F.lit(slices)) == part))
            one = each.join(F.broadcast(some), "h").select("doc_id", "_x", "_n", "n_words", "width", "_p")
            laid = one if laid is None else laid.unionByName(one)
    if laid is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, _x bigint, wins array<array<struct<start:int,n_words:int,width:int>>>")
    sizes = laid.groupBy("doc_id", "_x", "_n", "n_words", "width").agg(F.sort_array(F.collect_set("_p")).alias("at"))
    sizes = sizes.withColumn("need", least_shared(F.col("_n"), F.col("n_words"), F.col("width"), threshold)).filter(F.size("at") >= F.col("need"))
    win = F.transform(starts(*(F.col(c) for c in ("at", "_n", "n_words", "width", "need"))), lambda s: F.struct(s.alias("start"), F.col("n_words"), F.col("width")))
    places = sizes.withColumn("wins", win).filter(F.size("wins") > 0)
    return places.groupBy("doc_id", "_x").agg(F.collect_list("wins").alias("wins"))


def stretches(words: Column, sizes: Column) -> Column:
    """sizes: for each size of windows, its windows by start. Structs of TOGETHER windows each: low (the first start), n_words, width,
    starts and grams, the shingles at all places that the windows cover. Stretches of one size hardly overlap."""

    def of(x: Column) -> Column:
        low, last = F.element_at(x, 1).start, F.element_at(x, -1)
        covered = F.slice(words, low + 1, last.start + last.n_words - low)
        return F.struct(low.alias("low"), last.n_words.alias("n_words"), last.width.alias("width"), grams(covered, last.width).alias("grams"), F.transform(x, lambda w: w.start).alias("starts"))

    each = lambda wins: F.transform(F.sequence(F.lit(1), F.size(wins), F.lit(TOGETHER)), lambda i: T.let(F.slice(wins, i, TOGETHER), of))
    return F.flatten(F.transform(sizes, each))


def distinct_windows() -> Column:
    """Of a stretch the windows, as structs start and grams (sorted), the first of those that hold the same shingles equally often."""
    cut = lambda s: F.sort_array(F.slice("grams", s - F.col("low") + 1, F.col("n_words") - F.col("width") + 1))
    known = F.transform(F.transform("starts", lambda s: F.struct(s.alias("start"), cut(s).alias("grams"))), lambda w: F.struct(F.xxhash64(w.grams).alias("h"), w.start.alias("start"), w.grams.alias("grams")))
    return T.let(F.sort_array(known), lambda a: F.transform(F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1).h != x.h)), lambda x: F.struct(x.start.alias("start"), x.grams.alias("grams"))))


def candidates(windows: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """(doc_id, _x, start, item_id): the windows and items that meet in the index within ``radius``, each pair once.
    windows: doc_id, _x, start, n_words, grams, print."""
    known = index.select("n_words", "h").distinct()
    mine = windows.select("doc_id", "_x", "start", "n_words", "print", F.explode(F.array_distinct("grams")).alias("h")).join(known, ["n_words", "h"], "left_semi")
    mine = mine.select("*", F.posexplode(block_values(F.col("print"), radius)).alias("block", "bits"))
    apart = F.col("print").bitwiseXOR(F.col("ip"))
    earlier = F.exists(F.slice(block_values(apart, radius), F.lit(1), F.col("block")), lambda v: v == 0)
    met = mine.join(index, ["n_words", "h", "block", "bits"]).filter(~earlier & (F.bit_count(apart) <= radius))
    return met.select("doc_id", "_x", "start", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """doc_id, item_id, similarity (double), start (the window's first word, from 0), one row for each
    document and item with a window that is similar enough: the most similar one, the first of equals.

    The benchmark's shingles meet the documents' in broadcast joins of ``small_rows`` each, so a larger
    benchmark reads the documents once for each such slice. Nothing of the documents moves but the ids and
    places of shared shingles, and the texts of the documents with a window."""
    items = store.written(prepared_items(benchmark, width, radius), "items")
    places = store.written(laid_windows(docs, items, threshold, small_rows), "windows")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_y"))
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(T.whole(F.col("text"))).alias("_x"), "text").join(places.select(F.col("doc_id").alias("_id"), F.col("_x").alias("_y"), "wins"), same)
    few = here.select("doc_id", "_x", F.explode(T.let(plain_words(F.col("text")), lambda ws: stretches(ws, F.col("wins")))).alias("s")).select("doc_id", "_x", "s.*")
    wins = few.select("doc_id", "_x", "n_words", F.explode(distinct_windows()).alias("win")).select("doc_id", "_x", "n_words", "win.*")
    wins = store.written(wins.withColumn("print", simhash(F.col("grams"))), "prints")
    index = store.written(item_index(items, threshold, radius), "index")
    pairs = store.written(candidates(wins, index, radius), "pairs")
    mine = wins.select(F.col("doc_id").alias("_id"), F.col("_x").alias("_y"), F.col("start").alias("_s"), "n_words", F.col("grams").alias("wg"))
    at = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_y")) & (F.col("start") == F.col("_s"))
    theirs = items.select(F.col("item_id").alias("_item"), "n_words", F.sort_array("grams").alias("ig"))
    met = pairs.join(mine, at).join(theirs, F.col("item_id").eqNullSafe(F.col("_item")) & (mine["n_words"] == theirs["n_words"]))
    met = met.select("doc_id", "item_id", "start", weighted_jaccard(F.col("wg"), F.col("ig")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")
    return met.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.s")).alias("start"))
