"""Periodic runs, nearest neighbours and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gitstrata.llm import neighbours, periodic, queries, repair

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# periodic runs
def brute_runs(w, min_exp=4, min_words=6):
    n, out = len(w), []
    for q in range(1, n // min_exp + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(min_words, min_exp * q):
                stretch = w[s : s + length]
                if not any(all(stretch[i] == stretch[i + p] for i in range(length - p)) for p in range(1, q)):
                    out.append((s, length, q))
            s = e + 1
    return sorted(out)


def brute_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def loops(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = []
        while len(w) < r.randint(0, 60):
            unit = [r.choice("abé") for _ in range(r.randint(1, 5))]
            w += unit * r.randint(1, 6)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    return rows


@pytest.mark.parametrize("work", [1 << 27, 60])
def test_periodic_runs(spark, work):
    rows = loops(3, 150) + [(None, "a " * 9), (200, None), (201, ""), (202, " \n "), (5, "b " * 8), (5, "b " * 8), (203, "a b " * 7), (204, "a b c d e"), (205, "x" * 100_000 + " y" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    got = periodic.periodic_runs(df, work=work).collect()
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = brute_runs(w)
        want.append((i, len(w), runs, brute_collapsed(w, runs)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert any(len(r) > 1 for _, _, r, _ in want)
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_periodic_very_long(spark):
    """65,030 words, in some lag ranges; the loop has a period beyond every range but the last ones."""
    r = random.Random(5)
    unit = [f"w{r.randrange(10**6)}" for _ in range(9_000)]
    text = " ".join(["a"] * 30 + [f"v{r.randrange(10**6)}" for _ in range(20_000)] + unit * 5)
    got = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert [tuple(x) for x in got.runs] == [(0, 30, 1), (20_030, 45_000, 9_000)] and got.n_words == 65_030
    assert len(got.collapsed.split()) == 1 + 20_000 + 9_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_op11(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    some = 0
    for i, t in docs:
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None
        r = got[i]
        assert (r.n_runs, r.n_words) == (len(runs), n)
        assert ((r.start, r.length, r.period) if best else None) == best and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)) and r.collapsed_sha256 == sha(brute_collapsed(w, runs))
    assert len(got) == len(docs) and some > 5


# conversation repair
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}


def brute_repair(rows):
    """rows: (turn, role, text). All ways, layer by layer: the best (cost, audit, lines) for each sequence state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = lambda state, letter: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))

    def closed(layer):
        todo = list(layer.items())
        while todo:
            state, (c, audit, lines) = todo.pop()
            for role in ("user", "assistant"):
                to = step(state, role[0])
                new = (c + 5, audit + "I", [*lines, f"{role}:"])
                if to and (to not in layer or new[:2] < layer[to][:2]):
                    layer[to] = new
                    todo.append((to, new))
        return layer

    layer = closed({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        extra = 5 if fault == "truncated" else 0
        for state, (c, audit, lines) in layer.items():
            ways = [(state, (c + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                ways += [(step(state, role[:1]), (c + extra, audit + "K", [*lines, f"{role}:{text}"]))]
                ways += [(step(state, r[0]), (c + 1 + extra, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant")]
            for to, new in ways:
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        layer = closed(after)
    cost, audit, lines = min(layer[s] for s in ("", "a") if s in layer)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    n = faults.count
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, sha("\n".join(lines)))


def talks(seed, n, most):
    r = random.Random(seed)
    texts = ["Yes.", "No?", "Go on", "", " \n", "A longer answer that ends.", "cut o", "É!\n"]
    rows = []
    for c in [None, *range(n)]:
        for t in range(r.randint(1, most)):
            rows.append((c, r.choice([t, t, t, r.randint(0, most), None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(texts) + r.choice(["", f" {r.randint(0, 5)}."])))
    return rows


@pytest.mark.parametrize(("bits", "most"), [(8, 9), (1, 12), (0, 7)])
def test_repair(spark, monkeypatch, bits, most):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = talks(bits, 60, most)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash")).withColumn("_c", F.lit(1)).repartition(4)
    report, left = repair.repair(df)
    sums = {r.conv_id: r.repaired_sha256 for r in repair.digests(left).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sums[r.conv_id]) for r in report.collect()}
    want = {c: brute_repair([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    assert got == want
    assert any("D" in x[6] for x in want.values()) and any("R" in x[6] for x in want.values())


def test_repair_inserts(monkeypatch):
    """At their costs deleting is always cheaper than inserting; with other costs inserted rows are walked as well."""
    monkeypatch.setattr(repair, "INSERT", 1)
    repair.through.cache_clear()
    got = repair.cheapest([[x and dict(zip(("cost", "audit", "script"), x)) for e in range(4) for x in repair.through(r, e)] for r in ("u-u-", "a-")])
    repair.through.cache_clear()
    assert got == (1, "KIKK", ["k2k", "k"])


def test_repair_long_and_empty(spark):
    rows = [(1, k, ("user", "assistant")[k % 2 if k % 97 else 0], f"Text {k}.") for k in range(3_000)] + [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "Fine.")]
    report, left = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in report.collect()}
    want = brute_repair([x[1:] for x in rows if x[0] == 1])
    assert (got[1].cost, got[1].audit) == want[5:7] and got[2].audit == "KK"
    assert {r.conv_id: r.repaired_sha256 for r in repair.digests(left).collect()}[1] == want[7]
    report, left = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == left.count() == repair.digests(left).count() == 0


def brute_damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def op13_rows(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = brute_damage(rows)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.op13_conversation_repair(spark, sf).collect()}
    return got, {c: brute_repair([x[1:] for x in after if x[0] == c]) for c in {x[0] for x in rows}}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_op13(spark):
    got, want = op13_rows(spark, "/root/testdata/sf0.01")
    assert got == want and len(got) >= 100


def test_op13_awkward(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(30)]), r.choice([None, "user", "assistant", "system"]), r.choice([None, "", "Yes.", "No", "What?! Oh."])) for _ in range(160)]
    rows += [(1000 + k, 0, "user", "Alone.") for k in range(40)]  # some lose their only row
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = op13_rows(spark, str(tmp_path))
    assert got == want and (0, 0, 0, 0, 0, 0, "", sha("")) in got.values()


# nearest neighbours
def brute_near(rows, asks, k):
    """rows: (id, vector). Exact, scores summed in order."""
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if asks(i):
            s = np.zeros(len(x))
            for d in range(x.shape[1]):
                s += np.float64(v[d]) * x[:, d]
            other = ids != i
            order = np.lexsort((ids[other], -s[other]))[:k]
            out[i] = list(zip(ids[other][order].tolist(), s[other][order].tolist()))
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_pairs_below_the_best_so_far_are_left(monkeypatch):
    """200 queries against 40 batches of 250 rows: exact, and few pairs are ranked once each query has its best."""
    import pandas as pd

    rng, k = np.random.default_rng(3), 5
    x, y = rng.integers(-9, 10, (10_000, 8)).astype(np.float32), rng.integers(-9, 10, (200, 8)).astype(np.float32)
    x[rng.integers(0, 10_000, 2_000)] = x[:2_000]  # copies, so scores tie
    table = lambda v, first, j: pd.DataFrame({"g": 0, "s": 0, "t": 0, "j": j, "u": 0, "vec_id": np.arange(first, first + len(v)), "v": [r.tobytes() for r in v], "code": 0})
    ranked, best = [], neighbours._best
    monkeypatch.setattr(neighbours, "_best", lambda q, v, score, n: ranked.append(len(q)) or best(q, v, score, n))
    batches = [table(y, 10_000, -1), *(table(x[at : at + 250], at, 0) for at in range(0, 10_000, 250))]
    got = pd.concat(neighbours._searcher(np.float32, None, 64, k)(iter(batches)))
    score = y.astype(np.float64) @ x.astype(np.float64).T
    for q, near in got.groupby("query_id"):
        order = np.lexsort((np.arange(10_000), -score[q - 10_000]))[:k]
        assert list(zip(near["vec_id"], near["score"])) == list(zip(order, score[q - 10_000][order]))
    assert got["query_id"].nunique() == 200 and sum(ranked[:-1]) < 20_000


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_op12_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got, want = by_query(queries.op12_nearest_neighbours(spark, path)), brute_near(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in got.items():
        exact = dict(want[q])
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in near} & exact.keys())
        assert all(exact[v] == s for v, s in near if v in exact)
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_found_within_the_radius_are_all_found(spark, monkeypatch):
    """Groups, query blocks and splits of large buckets made small: every code within the radius must be met once."""
    monkeypatch.setattr(neighbours, "GROUP", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 16))
    x = np.concatenate([centres[k % 6] + 0.15 * r.normal(size=(70, 16)) for k in range(6)]) * r.uniform(0.5, 2, size=(420, 1))
    x[100:180] = x[100]  # equal vectors: ties, one bucket
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("clash")).repartition(5)
    model = neighbours.fit(neighbours._valid(df, "embedding"), 5, 0.97)._replace(radius=9)
    apart = np.bitwise_count(neighbours.codes(x, model, True)[:, None] ^ neighbours.codes(x, model, False)[None, :])
    exact = brute_near(rows, lambda i: i % 3 == 0, 420)
    got = by_query(neighbours.nearest(df, F.col("vec_id") % 3 == 0, 5, model=model))
    for q, near in exact.items():
        within = [(v, s) for v, s in near if apart[q, v] <= 9]
        assert got[q] == (within if len(within) >= 5 else near)[:5]


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.5]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(neighbours.nearest(df, F.col("vec_id").isin(0, 2, 3, 9)))
    assert got == {0: [(10, 2.0), (1, 1.0), (9, 1.0), (9, 1.0), (8, -1.0)], 9: [(10, 2.0), (0, 1.0), (1, 1.0), (8, -1.0)]}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(one, F.col("vec_id") % 20 == 0).count() == 0


# near duplicates and leaks in awkward sizes
def test_minhash_shared_passage(spark):
    """Hundreds of documents that share a long passage and little else: links as by brute force, from few pairs."""
    from gitstrata.llm import minhash, store
    from test_llm import brute_components

    r = random.Random(12)
    passage = [f"p{k}" for k in range(90)]
    rows = []
    for i in range(220):
        low, own = r.randint(0, 12), r.randint(2, 24)
        rows.append((i, " ".join([*passage[low : 90 - r.randint(0, 12)], *(f"o{i}_{k}" for k in range(own))])))
    df = spark.createDataFrame([*rows, (None, "six words make two sets here")], "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df).collect()}
    assert got.pop(None) == (2, None, True)
    assert got == brute_components(rows, 5) and len({c for _, c, _ in got.values()}) > 20
    sets = store.written(minhash._sets(df.filter("doc_id is not null"), df.filter("doc_id is not null").select(F.col("doc_id").alias("id")), 5).withColumn("c", F.col("id")))
    pairs = {(p.a, p.b) for p in minhash._exact_pairs(sets, 0.8).collect()}
    own = {r.id: set(r.members) for r in sets.collect()}
    near = {(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])}
    assert near <= pairs and len(pairs) < 1.6 * len(near)


def test_leak_in_a_very_long_document(spark):
    """60,000 words that repeat one item: windows at almost every start, cut in stretches."""
    from gitstrata.llm import decontamination

    item = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(item * 1_000)), (2, " ".join([f"x{k}" for k in range(3_000)] + item[:55] + ["y"] * 5)), (3, " ".join(item[:30]))]
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (round(x.similarity, 6), x.start) for x in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got[(1, 7)] == (1.0, 0) and got[(2, 7)][0] >= 0.8 and got[(2, 7)][1] in range(2_990, 3_001) and len(got) == 2


# pages with articles that aren't the story
STORY = "".join(f"<p>{' '.join(f's{j}w{k}' for k in range(40))}.</p>" for j in range(6))
TOLD = "\n\n".join(f"{' '.join(f's{j}w{k}' for k in range(40))}." for j in range(6))
NAV = '<nav><a href="/">Home</a> <a href="/b">News</a></nav>'
LEAD = "This lead stands in the article and sums up in two or three lines what the story below tells at length today."
PAGES = {
    "element whose name starts like a hidden one": ("<body><div>one two three <svg-icon></svg-icon> <select-menu>four</select-menu> " + "five " * 60 + "</div></body>", "one two three four " + ("five " * 60).strip()),
    "teaser article behind": (f"<body>{NAV}<div class='story'><h1>Title</h1>{STORY}</div><article><h2>Other news</h2><p>Short text here</p></article><footer>f</footer></body>", f"Title\n\n{TOLD}"),
    "teaser article before": (f"<body>{NAV}<article><h2><a href='x'>Other news</a></h2><p>{LEAD}</p></article><div class='story'><h1>Title</h1>{STORY}</div></body>", f"Title\n\n{TOLD}"),
    "lead in an article, story in a div": (f"<body>{NAV}<article><h1>Title</h1><p>{LEAD}</p></article><div class='body'>{STORY}</div></body>", f"Title\n\n{LEAD}\n\n{TOLD}"),
    "comments by other names": (f"<body>{NAV}<article><h1>T</h1>{STORY}</article><div class='reactions'><p>I think this is wrong.</p></div><div class='reader-opinions'><p>No way this is true.</p></div></body>", f"T\n\n{TOLD}"),
    "comments by other names, no article": (f"<body>{NAV}<div><h1>T</h1>{STORY}</div><div class='reactions'><p>I think this is wrong.</p><p>So do I.</p></div></body>", f"T\n\n{TOLD}"),
    "notice of the article": (f"<body>{NAV}<article><h1>T</h1>{STORY}<p class='notice'>Mind that this matters.</p><p>End.</p></article></body>", f"T\n\n{TOLD}\n\nMind that this matters.\n\nEnd."),
    "three teasers around": (f"<body>{NAV}<article><h3><a href='1'>One</a></h3></article><div><h1>T</h1>{STORY}</div><article><h3><a href='2'>Two</a></h3><p>{LEAD}</p></article><article><a href='3'>Three more to read</a></article></body>", f"T\n\n{TOLD}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_stories_and_teasers(name):
    from gitstrata.llm import html_text

    page, text = PAGES[name]
    assert html_text.extract(page, html_text.train()) == text


def test_html_columns_that_clash(spark):
    from gitstrata.llm import html_text

    df = spark.createDataFrame([(1, "<p>a &amp; b</p>", "x", "y"), (2, None, "x", "y")], "page_id long, html string, text string, n_chars string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).orderBy("page_id").collect()] == [(1, "a & b", 5), (2, "", 0)]


def test_op13_same_as_sql(spark, tmp_path):
    from test_llm import same_as_sql

    rows = [r for r in talks(5, 50, 9) if r[0] is not None] + [(None, 1, "user", "Alone."), (None, None, None, None)]
    same_as_sql(spark, tmp_path, "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "op13_conversation_repair")
