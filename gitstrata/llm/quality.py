"""Quality rules: decision lists learned from labelled statistics by sequential covering.

Each rule is a conjunction of threshold tests on a document's statistics. A rule grows one test at a
time, the test that gains most (by FOIL's measure) over the labelled rows it still covers; it is then
pruned test by test while that helps on rows held out for pruning, and kept if those rows confirm it.
What it covers is removed and the next rule is learned. The list is emitted as one Spark conditional
expression. All counts are made by Spark; the driver sees a table of (statistic, bin, fold, label).

Nulls and edges: a null text has no words; labels other than 0 and 1 are ignored; a document labelled
twice counts once, with its least label; without both labels the list is empty and keeps everything.
Columns named as those added here are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from gitstrata.llm import store, text as T

SYMBOLS = r"[#*$%&|<>]"


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside ``width``-word windows that the text holds twice or more, the first included.

    Windows are compared by 64-bit hash. Texts without an equal pair, nearly all, end after one hash
    set; else windows are sorted with their places, and the places of equal neighbours are merged."""
    none = F.lit(0).cast("long")

    def count(ws: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: F.xxhash64(F.slice(ws, i, width)))

        def covered(g: Column) -> Column:
            places = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def merged(s: Column) -> Column:
                same = lambda e, k: (F.get(s, k + 1)["h"] == e.h) | ((k > 0) & (F.get(s, k - 1)["h"] == e.h))
                hit = F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e.i))
                return T.let(hit, lambda p: F.aggregate(
                    F.transform(p, lambda at, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - at, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x,
                ))

            return F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(T.let(places, merged))

        return F.when(F.size(ws) < 2, none).when(F.size(ws) <= width, none).otherwise(T.let(grams, covered))

    return T.let(words, count)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (boolean) and
    the ratios that rules test."""
    text = T.whole(F.col("text"))
    full = F.filter(T.lines(F.col("text")), lambda x: x.rlike(T.WORD_RE))
    out = docs.withColumns({
        "n_words": T.n_words(F.col("text")),
        "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(T.SPACE_RE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": T.let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeat_words(T.words(F.col("text"))),
        "n_lines": F.regexp_count(text, F.lit("\n")).cast("long") + 1,
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_marks": F.regexp_count(text, F.lit(r"[!?]")).cast("long"),
        "n_same_next": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+) (?=\1(?![^\x20\x09-\x0D]))")).cast("long"),
    })
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return out.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.col("n_lines"),
        "repeat_share": F.col("n_repeat_words") / words,
        "words_per_line": F.col("n_words") / F.col("n_lines"),
        "upper_share": F.col("n_upper") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "same_next_share": F.col("n_same_next") / words,
    })


#: The statistics that rules may test.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "upper_share", "marks_per_word", "same_next_share")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a document that some rule covers is rejected."""

    rules: list[list[Test]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1 for the first rule that covers the row, and so on; null for none."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(covers(rule), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(map(str, r)) for k, r in enumerate(self.rules, 1)) or "keep all"


def covers(rule: list[Test]) -> Column:
    out = F.lit(True)
    for t in rule:
        out = out & t.column()
    return out


def _bins(rows: DataFrame, cuts: dict[str, list[float]]) -> dict:
    """(feature, bin) -> [grow bad, grow good, prune bad, prune good]; bin b lies above b of the cuts."""
    below = lambda f, c: F.size(F.filter(F.array(*map(F.lit, c)), lambda x: x < F.col(f)))
    bins = F.array(*(F.struct(F.lit(f).alias("f"), below(f, c).alias("b")) for f, c in cuts.items()))
    got = rows.select("_fold", "_bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b", "_fold", "_bad").count().collect()
    out: dict = defaultdict(lambda: [0, 0, 0, 0])
    for f, b, fold, bad, n in got:
        out[f, b][2 * (fold == 0) + (1 - bad)] += n
    return out


def learn(stats: DataFrame, features=FEATURES, bins: int = 64, max_rules: int = 8, max_tests: int = 3, precision: float = 0.95, min_cover: int = 5) -> DecisionList:
    """stats: the features and ``_bad`` (1 reject, 0 keep) and ``_fold`` (0: for pruning, else for growing).
    A rule is kept if at least ``min_cover`` growing rows and ``precision`` of both folds' rows are bad."""
    q = stats.agg(*(F.percentile_approx(f, [i / bins for i in range(bins + 1)], 2000).alias(f) for f in features)).head()
    values = {f: sorted({float(x) for x in q[f]}) for f in features if q[f]}
    # cuts lie between the quantiles, so that a rule leaves the same room on either side
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items() if len(v) > 1}
    learned = DecisionList()
    left = stats
    while cuts and len(learned.rules) < max_rules:
        rule: list[Test] = []
        while len(rule) < max_tests:
            table = _bins(left.filter(covers(rule)), cuts)
            some = next(iter(cuts))
            bad, good = (sum(table[some, b][k] for b in range(len(cuts[some]) + 1)) for k in (0, 1))
            if not bad or not good:
                break
            best, gain = None, 1e-9
            for f, cs in cuts.items():
                for above in (True, False):
                    for b, cut in enumerate(cs):
                        side = range(b + 1, len(cs) + 1) if above else range(b + 1)
                        p, n = (sum(table[f, x][k] for x in side) for k in (0, 1))
                        if p >= min_cover and (g := p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))) > gain:
                            best, gain = Test(f, above, cut), g
            if best is None:
                break
            rule.append(best)
        if not rule:
            break

        def worth(tests: list[Test], left=left) -> tuple[float, int, int, int]:
            c = [F.count_if(covers(tests) & F.col("_bad").cast("boolean").eqNullSafe(k) & ((F.col("_fold") == 0) == z)) for z in (True, False) for k in (True, False)]
            p, n, p2, n2 = left.agg(*c).head()
            return ((p - n) / (p + n) if p + n else -1.0), p + p2, n + n2, p2

        now = worth(rule)
        while len(rule) > 1:  # reduced-error pruning, the last test first
            fewer = worth(rule[:-1])
            if fewer[0] < now[0]:
                break
            rule, now = rule[:-1], fewer
        if now[3] < min_cover or now[1] < precision * (now[1] + now[2]):
            break
        learned.rules.append(rule)
        left = left.filter(~covers(rule))
    return learned


def learn_from_labels(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DecisionList:
    """Learns which documents to reject from ``labels.quality`` = 0, on at most ``sample`` labelled
    documents, those first in the order of the md5 of doc_id. The bound holds for fitting only."""
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_lid"))
        .agg(F.min("quality").alias("_q")).orderBy(F.md5(F.col("_lid").cast("string")), "_lid").limit(sample)
    )
    chosen = store.written(chosen, "labelled")
    # at most ``sample`` rows of two numbers; written, so that statistics are taken of the chosen texts only
    rows = store.written(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_lid")), "sample")
    stats = with_statistics(rows).filter(~F.col("base_failed")).select(*FEATURES, (1 - F.col("_q")).cast("int").alias("_bad"), F.pmod(F.crc32(F.col("_lid").cast("string")), F.lit(3)).cast("int").alias("_fold"))
    stats = store.written(stats, "statistics")
    out = learn(stats)
    store.drop(stats, rows, chosen)
    return out


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """All columns of ``docs``, the statistics, rule (int, null for none) and kept (boolean)."""
    out = with_statistics(docs).withColumn("rule", rules.rule_number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
