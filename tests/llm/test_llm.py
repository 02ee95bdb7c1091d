"""The text operators against brute force, on small tables that hold the awkward cases."""

from __future__ import annotations

import hashlib
import html
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gitstrata.llm import chat, components, decontamination, html_text, licenses, line_dedup, minhash, mixing, pii, quality, shingles, text as T, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string"


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def vocabulary(n=3000):
    return [f"w{k}" for k in range(n)]


# text
def test_words_and_folding(spark):
    df = docs(spark, [(1, " a\tB c \n"), (2, ""), (3, None), (4, "ÄZ Éa")])
    got = {r.doc_id: r for r in df.select("doc_id", T.words(F.col("text")).alias("w"), T.n_words(F.col("text")).alias("n"), T.ascii_lower(T.whole(F.col("text"))).alias("l")).collect()}
    assert got[1].w == ["a", "B c"] and got[2].w == [] and got[3].w == [] and got[3].n == 0
    assert got[4].l == "Äz Éa"


# line dedup
def brute_lines(rows, min_chars=40, min_docs=5):
    rows = [(-(2**63) if i is None else i, t) for i, t in rows]
    keys = [[ln.strip(" \t\n\x0b\x0c\r").translate(FOLD) for ln in (t or "").split("\n")] for _, t in rows]
    holders, keeper = {}, {}
    for (i, _), ks in zip(rows, keys):
        for k in {k for k in ks if len(k) >= min_chars}:
            holders.setdefault(k, set()).add(i)
            keeper[k] = max(keeper.get(k, i), i)
    n = Counter({k: len(v) for k, v in holders.items()})
    out = []
    for (i, t), ks in zip(rows, keys):
        keep = [ln for ln, k in zip((t or "").split("\n"), ks) if n[k] < min_docs or i >= keeper[k]]
        out.append((i, len(ks), len(ks) - len(keep), "\n".join(keep)))
    return sorted(out)


def line_rows(seed):
    r = random.Random(seed)
    long_ = [f"line number {k} that is long enough to count as a key É" for k in range(12)]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(r.choice([lambda: r.choice(long_), lambda: "  " + r.choice(long_).upper() + "\t", lambda: "short", lambda: ""])() for _ in range(r.randint(0, 9)))))
    return rows + [(60, None), (61, ""), (62, "\n\n"), (63, long_[0] + "\n" + long_[0]), (64, "x" * 39), (65, "x" * 40)]


@pytest.mark.parametrize(("seed", "batches", "fan_in"), [(1, 3, 2), (2, 1, 2), (3, 5, 2)])
def test_line_dedup(spark, seed, batches, fan_in):
    rows = line_rows(seed)
    df = docs(spark, rows).withColumn("n_lines", F.lit("clash")).withColumn("_H1", F.lit(1))
    got = line_dedup.dedup_lines(df, batches=batches, fan_in=fan_in).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    line = "the same long line in every one of these rows"
    dropped = lambda rows: Counter(map(tuple, line_dedup.dedup_lines(docs(spark, rows)).select("doc_id", "n_dropped").collect()))
    assert dropped([(None, line)] + [(k, line) for k in (1, 2, 3)] + [(4, line), (4, line)]) == Counter({(None, 1): 1, (1, 1): 1, (2, 1): 1, (3, 1): 1, (4, 0): 2})
    # rows of one doc_id are one document: here four documents hold the line
    assert dropped([(k, line) for k in (1, 2, 3)] + [(4, line), (4, line)]) == Counter({(1, 0): 1, (2, 0): 1, (3, 0): 1, (4, 0): 2})
    very_long = "a very long line " * 30_000
    assert dropped([(k, f"{very_long}\n{very_long}") for k in range(5)]) == Counter({(0, 2): 1, (1, 2): 1, (2, 2): 1, (3, 2): 1, (4, 0): 1})


def test_line_dedup_same_as_sql(spark, tmp_path):
    r = random.Random(17)
    rows = [(r.choice([None, *range(25)]), t) for _, t in line_rows(4)]
    same_as_sql(spark, tmp_path, "documents", docs(spark, rows), "op1_line_dedup")


def same_as_sql(spark, tmp_path, table, df, name):
    import duckdb

    import compare
    from gitstrata.llm import queries

    df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    rel, df = con.execute(queries.SQL[name]), queries.QUERIES[name](spark, str(tmp_path))
    assert compare.rows(df.columns, df.collect()) == compare.rows([d[0] for d in rel.description], rel.fetchall())


# decontamination
def plain(t):
    return WORD.findall(re.sub(r"[^\w\x20\x09-\x0D]|_", "", (t or "").lower()))


def brute_leaks(rows, items, width=5, threshold=0.8):
    out = {}
    for i, t in rows:
        x = plain(t)
        for item, s in items:
            w = plain(s)
            k = min(width, len(w))
            if not w:
                continue
            a = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
            g = [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
            best = 0.0
            if a.keys().isdisjoint(g):  # every window's similarity is 0
                continue
            for at in range(max(1, len(x) - len(w) + 1)):
                b = Counter(g[at : at + len(w) - k + 1])
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= threshold:
                out[i, item] = round(best, 9)
    return out


def leak_tables():
    r = random.Random(5)
    v = vocabulary(400)
    items = [(k, " ".join(r.choice(v) for _ in range(r.randint(12, 60)))) for k in range(12)] + [(90, "just three words"), (91, ""), (92, None), (93, "rep rep rep rep rep rep rep rep")]
    rows = []
    for i in range(120):
        body = [r.choice(v) for _ in range(r.randint(0, 80))]
        if i % 2:
            w = (items[r.randrange(12)][1]).split()
            for _ in range(r.randint(0, 2)):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = [r.choice(v)] if r.random() < 0.7 else []
            if r.random() < 0.3:
                w = [x.upper() + ",!" for x in w]
            at = r.randint(0, len(body))
            body[at:at] = w
        rows.append((i, " ".join(body)))
    rows += [(200, None), (201, ""), (202, "Just three words!"), (203, items[0][1]), (204, " ".join(["rep"] * 8)), (205, "rep rep rep"), (203, items[0][1])]
    return rows, [*items, items[3]]


@pytest.mark.parametrize("small_rows", [500_000, 97])
def test_decontamination(spark, small_rows):
    """Whole, and with a benchmark that is met in slices."""
    rows, items = leak_tables()
    df = docs(spark, rows).withColumn("item_id", F.lit("clash"))
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.leaks(df, docs(spark, items, "item_id long, text string"), small_rows=small_rows).collect()}
    assert got == brute_leaks(rows, items) and len(got) > 40
    assert decontamination.leaks(docs(spark, []), docs(spark, items, "item_id long, text string")).count() == 0
    assert decontamination.leaks(df, docs(spark, [], "item_id long, text string")).count() == 0


def test_decontamination_moved_parts(spark):
    r = random.Random(11)
    v = vocabulary(2000)
    a, b = ([r.choice(v) for _ in range(n)] for n in (60, 120))
    items = [(1, " ".join(a)), (2, " ".join(b))]
    around = lambda w: " ".join([r.choice(v) for _ in range(90)] + w + [r.choice(v) for _ in range(70)])
    rows = [
        (1, around(a[30:] + a[:30])), (2, around(b[70:] + b[:70])), (3, around(["x0"] + a[1:30] + ["x1", "x2"] + a[30:59] + ["x3"])), (4, around(a[20:40])),
        (5, " ".join(a[30:] + a[:30])), (6, " ".join(a[1:58])), (7, " ".join(a[30:] + a[:30] + a)), (8, around(b[80:] + b[40:80] + b[:40])), (None, around(a)),
    ]
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.leaks(docs(spark, rows), docs(spark, items, "item_id long, text string")).collect()}
    assert got == brute_leaks(rows, items) and {(1, 1), (2, 2), (3, 1), (5, 1), (8, 2)} <= got.keys()


def window_similarity(a, b, width=5):
    a, b = (Counter(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) for w in (a, b))
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_decontamination_recall_at_the_threshold(spark):
    """Items of 15 (11 shingles) to 120 words, and copies of them that are only just similar enough."""
    r, v = random.Random(23), vocabulary(5000)
    items, rows = [], []
    for size in (15, 17, 20, 25, 30, 45, 60, 90, 120):
        for _ in range(40):
            w = [r.choice(v) for _ in range(size)]
            x, now = list(w), 1.0
            for _ in range(60):  # one word after another changes while the copy stays similar enough
                y = list(x)
                y[r.randrange(size)] = r.choice(v)
                if window_similarity(w, y) >= 0.8:
                    x, now = y, window_similarity(w, y)
            items.append((len(items), " ".join(w)))
            if 0.8 <= now < 0.9:
                rows.append((len(items) - 1, " ".join([r.choice(v) for _ in range(30)] + x + [r.choice(v) for _ in range(30)])))
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs(spark, rows), docs(spark, items, "item_id long, text string")).collect()}
    assert len(rows) > 200 and sum((i, i) in got for i, _ in rows) >= 0.99 * len(rows)


def test_decontamination_meets_few_pairs(spark):
    """5,000 items of one length: the index gives no more pairs than share a shingle, and loses no leak."""
    r, v = random.Random(31), vocabulary(300)
    opening = [r.choice(v) for _ in range(9)]
    items = [(k, " ".join((opening if k % 5 == 0 else [r.choice(v) for _ in range(9)]) + [r.choice(v) for _ in range(15)])) for k in range(5000)]
    rows = []
    for i in range(12):
        w = items[r.randrange(5000)][1].split()
        w[r.randrange(24)] = "other"
        rows.append((i, " ".join([r.choice(v) for _ in range(r.randint(0, 40))] + w + opening)))
    table, bench = docs(spark, rows), docs(spark, items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.leaks(table, bench).collect()}
    assert got == brute_leaks(rows, items) and got
    its = decontamination.prepared_items(bench, 5, 23)
    ws = F.col("text")
    win = table.select("doc_id", F.col("doc_id").alias("_x"), F.lit(0).alias("start"), F.lit(24).alias("n_words"), decontamination.grams(decontamination.plain_words(ws), 5).alias("grams"))
    win = win.withColumn("print", decontamination.simhash(F.col("grams")))
    met = decontamination.candidates(win, decontamination.item_index(its, 0.8, 64 - 1), 63).count()
    both = win.select("doc_id", F.explode("grams").alias("h")).join(its.select("item_id", F.explode("grams").alias("h")), "h").select("doc_id", "item_id").distinct().count()
    assert 0 < met < both


def test_hamming_blocks_miss_nothing(spark):
    r = random.Random(3)
    for _ in range(200):
        a, radius = r.getrandbits(64), 23
        flips = r.sample(range(64), radius)
        b = a
        for f in flips:
            b ^= 1 << f
        assert any((a >> s) % (1 << n) == (b >> s) % (1 << n) for s, n in decontamination.blocks(radius))
    assert sum(n for _, n in decontamination.blocks(23)) == 64


# quality
def brute_repeat(t):
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            covered |= set(range(i, i + 8))
    return len(covered)


def test_statistics(spark):
    r = random.Random(9)
    texts = [None, "", "a", "a a a a a a a a", "a " * 9, "a b c d e f g h " * 2, " ".join(f"q{k % 11}" for k in range(60)), "x # y\n\nx # y\n \nz *%$&|<>", "A\nA\nA\n\n"]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randint(0, 70))) for _ in range(40)]
    got = {x.doc_id: x for x in quality.with_statistics(docs(spark, list(enumerate(texts))).withColumn("N_Words", F.lit(0))).collect()}
    for i, t in enumerate(texts):
        w, full = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), brute_repeat(t))
        x = got[i]
        assert (x.N_Words if "N_Words" in x else x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, t
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_rules_are_learned_and_pruned(spark):
    r = random.Random(4)
    good = [(k, " ".join(r.choice(vocabulary()) for _ in range(60)), 1) for k in range(400)]
    bad = [(k, " ".join(r.choice(vocabulary()) + "%%%" for _ in range(60)), 0) for k in range(400, 500)] + [(k, " ".join(r.choice(vocabulary()).upper() for _ in range(60)), 0) for k in range(500, 600)]
    df = spark.createDataFrame([x[:2] for x in good + bad], DOC)
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad] + [(None, 0), (1, None), (7, 9)], "doc_id long, quality int")
    rules = quality.learn_from_labels(df, labels)
    kept = {x.doc_id: x.kept for x in quality.apply_rules(df, rules).collect()}
    assert 1 <= len(rules.rules) <= 8
    assert all(kept[x[0]] for x in good) and not any(kept[x[0]] for x in bad)
    none = quality.learn_from_labels(df, labels.limit(0))
    assert str(none) == "keep all" and quality.apply_rules(df, none).filter("not kept").count() == 0


# mixing
def brute_mix(rows):
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2.0 * total[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        target = {s: 2.0 * total[s] if s in capped else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in capped and target[s] > 2.0 * total[s]}
        if not over:
            break
        capped |= over
    return total, target


def test_mixing(spark):
    r = random.Random(8)
    rows = [(k, "w " * r.randint(0, 40), r.choice(["a", "b", "c", "é", "z", None, ""])) for k in range(300)] + [(900, None, "empty"), (901, "", "empty"), (902, "x y z", "tiny")]
    df = docs(spark, rows, "doc_id long, text string, source string").withColumn("TARGET", F.lit("clash"))
    one = mixing.mix_sources(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix_sources(df.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, again), key=repr)
    total, target = brute_mix(rows)
    taken = Counter()
    for x in one:
        assert x.source_size == total[x.source] and x.target == pytest.approx(target[x.source]) and x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in total)
    assert mixing.mix_sources(docs(spark, [], "doc_id long, text string, source string")).count() == 0


# HTML
def content_words(page):
    text, spans = html_text.unmarked(page)
    return [w for kind, value, _, at in html_text.parse(text)[0] if kind == "text" and html_text.is_content(at, spans) for w in html.unescape(value).split()]


def test_html_labelled_pages():
    weights = html_text.train()
    assert len(html_text.LABELLED) >= 70 and min(weights.word[k] for k in ("plain", "link", "heading")) > 0 and max(weights.tag.values()) <= 0
    for page in html_text.LABELLED:
        assert html_text.extract(html_text.unmarked(page)[0], weights).split() == content_words(page), page


#: Pages that nothing was trained on: all of these articles in all of these frames.
HELD_ARTICLES = (
    "<h1>Why bridges hum</h1><p>On windy days the new bridge sings, and engineers have found the reason: the railings.</p><ol><li>Wind meets the rail.<li>The rail shakes.</ol><p>They will be changed in May.</p>",
    '<h2><a href="s">Soup for ten</a></h2><p>Take two onions and a lot of time. <em>Do not hurry.</em><p>Serve with bread from the day before.<pre>  2 onions\n  1 leek</pre>',
    '<header><h1>A letter</h1></header><p>Dear reader, this is the last letter that I shall write from the island.</p>⟪<aside><p>Subscribe to letters</p></aside>⟫<p>The boat leaves at noon.</p><dl><dt>Noon<dd>Boat<dt>One<dd>Train</dl>',
    '<h1>Measured</h1><p>We measured <math><mi>x</mi> <mo>=</mo> <mn>4</mn></math> at each of the sites.</p><figure><img src="f"><figcaption>Site two</figcaption></figure><p class="search-results">The search took nine days and found all of them.</p>⟪<div class="ad-slot">Cheap flights now</div>⟫<p>No site was lost.</p>',
)
HELD_FRAMES = (
    '<!DOCTYPE html><html><head><title>x</title></head><body><div id="top-nav"><a href="a">A</a> <a href="b">B</a></div><div class="no-sidebar page"><main>⟦{}⟧</main></div><footer><ul><li><a href="i">Imprint</a></ul></footer>',
    '<body class="menu-open"><nav><a href="h">Home</a></nav>⟦<article class="post">{}</article>⟧<div class="comment-list"><div class="comment"><p>I liked the part about the wind and the one after it.</p></div></div><div class="cookie-banner">This page sets cookies. Accept?</div></body>',
    '<body><header><div class="logo"><a href="/">Site</a></div><ul><li><a href="1">One</a><li><a href="2">Two</a></ul></header><div class="wrapper with-sidebar"><div class="entry">⟦{}⟧</div><div class="sidebar-right"><p>Most read today</p><a href="m">Most</a></div></div><div class="copyright">&copy; 2020 Site</div></body>',
    '<body><form method="post"><div class="page"><p class="alert">Old browser!<div class="text">⟦<article>{}</article>⟧</div><div class="share">Share: <a href="f">F</a></div></div></form></body>',
    '<body><table><tr><td class="sidebar"><a href="1">One</a><br><a href="2">Two</a><td>⟦{}⟧<td class="ads">Buy shoes</table></body>',
)


def test_html_held_out_pages():
    """Words of the articles found, and words found that are of the articles."""
    weights, found, wanted, right = html_text.train(), 0, 0, 0
    for frame in HELD_FRAMES:
        for article in HELD_ARTICLES:
            page = frame.replace("{}", article)
            got, want = Counter(html_text.extract(html_text.unmarked(page)[0], weights).split()), Counter(content_words(page))
            found, wanted, right = found + sum(got.values()), wanted + sum(want.values()), right + sum((got & want).values())
    print(f"recall {right / wanted:.4f}, precision {right / found:.4f}")
    assert right >= 0.98 * wanted and right >= 0.96 * found


STORY = "<h1>Big title here</h1><p>The article has a first paragraph with enough words to matter.</p><p>And a second one that goes on for a while too.</p>"
STORY_TEXT = "Big title here\n\nThe article has a first paragraph with enough words to matter.\n\nAnd a second one that goes on for a while too."


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p>a", "a"), ("<nav>only menu</nav>", ""), ("plain words", "plain words"), ("<p>a &amp; b&nbsp;&lt;c&gt; &#233;</p>", "a & b <c> é"), ("<p>one\n  two\t three</p><p>four</p>", "one two three\n\nfour"),
    ("<article><p>Keep these words here</p><aside><p>not these at all</p></aside><p>and these words too</p></article>", "Keep these words here\n\nand these words too"),
    ("<article><p>Body text of the story.</p><div class='comments'><p>First comment here</p></div></article>", "Body text of the story."), ("<p>text</p><!-- never closed <p>gone</p>", "text"), ("<p>text</p><script>var a = '<p>no</p>'", "text"),
    ("<p>cut off <b", "cut off"), ("<article><header><h1>Title</h1></header><p>Words of it.</p></article>", "Title\n\nWords of it."), ("<div class=cookie-notice>We use cookies</div><p>Real words here</p>", "Real words here"),
    (f"<body><div class='has-sidebar layout'>{STORY}</div></body>", STORY_TEXT), (f"<body><div class='with-banner'>{STORY}</div></body>", STORY_TEXT), ("<body><p class=ad>Buy<p>The article starts here and goes on.<p>And on.", "The article starts here and goes on.\n\nAnd on."),
    (f"<body><ul><li class=menu>Home</ul>{STORY}", STORY_TEXT), (f"<body><ul><li class=menu>Home<li class=menu>Away</ul><div>{STORY}", STORY_TEXT), (f"<html><head><title>t</title><meta name=x><body>{STORY}", STORY_TEXT),
    (f"<article>{STORY}<section class='related-work'><p>Others have tried it before.</p></section></article>", f"{STORY_TEXT}\n\nOthers have tried it before."), (f"<article>{STORY}<div class='ad-hoc'><p>Some text.</p></div></article>", f"{STORY_TEXT}\n\nSome text."),
    (f"<article>{STORY}<p id='comment-policy'>Our policy is this.</p></article>", f"{STORY_TEXT}\n\nOur policy is this."), (f"<div>{STORY}{'<div></div>' * 40}<p>Second part of it.</p></div>", f"{STORY_TEXT}\n\nSecond part of it."),
    (f"<div>{STORY}{'<figure><img src=x></figure>' * 15}<p>Second part of it.</p></div>", f"{STORY_TEXT}\n\nSecond part of it."), (f"<form id=all><div>{STORY}</div></form>", STORY_TEXT), (f"<div class='content has-sidebar'><div class='post comments-open'>{STORY}</div></div>", STORY_TEXT),
    ("<article><h1><a href=x>A title of five words</a></h1><p>Text.</p><p><a href=y>Closing words in a link</a></p></article>", "A title of five words\n\nText.\n\nClosing words in a link"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object>a drawing</object></p></article>", "so x=2 and a drawing"), (f"<article>{STORY}</article><div id=comments>{'<div class=comment><p>I disagree with every single word of this story.</p></div>' * 30}</div>", STORY_TEXT),
    ("<p>a<b>b<i>c</b>d</i>e</p></div></p><p>f", "abcde\n\nf"), ("<ul><li>one<ul><li>two</ul><li>three</ul>", "one\n\ntwo\n\nthree"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("word " * 200_000, ("word " * 200_000).strip()),
])
def test_html_cases(page, want):
    assert html_text.extract(page, html_text.train()) == want


def test_html_of_awkward_nesting_is_fast():
    for page in ("<div>" * 50_000 + "x", "<b>" * 50_000 + "x</p>" * 50_000, "<p><i>" * 30_000 + "x", "<a>x" * 30_000, "</div>x" * 50_000, "<li><p>x" * 30_000, "<table><tr>" * 20_000 + "x"):
        html_text.extract(page, html_text.train())


def test_html_operator(spark):
    df = spark.createDataFrame([(1, "u", "<p>ä b</p>"), (2, None, None)], "page_id long, url string, html string").withColumn("TEXT", F.lit("clash"))
    assert sorted((x.page_id, x["TEXT"] if "TEXT" in x else x["text"], x.n_chars) for x in html_text.extract_text(df).collect()) == [(1, "ä b", 3), (2, "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0 and html_text.extract_text(df.union(df)).count() == 4


def test_best_run_is_the_best():
    r = random.Random(2)
    for _ in range(300):
        s = [r.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(r.randint(0, 12))]
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)] + [0])


# PII
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_patterns():
    r = random.Random(1)
    texts = ["a@b.cc_x@y.z", "1.2.3.4.5.6.7.8", "300.1.1.1 01.002.0003.4", "+1 (555) 010-2345.", "4111 1111 1111 1111", "4111-1111-1111-1111 4111", "@@a@b.c", "a@b", "é@x.de"]
    texts += ["".join(r.choice("ab@.-+ 0123456789()%_") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == sorted(brute_base(t)), t


def test_crf_adds_and_keeps(spark):
    crf = pii.train()
    wrong = sum(list(pii.viterbi(crf, [crf.emissions(pii.labelled(x)[0])])[0]) != pii.labelled(x)[1] for x in pii.LABELLED)
    assert wrong <= 5
    held = ["ask (555) 321-4567 today", "write to max@brüning.example.de soon", "in 2021 about 14 people", "version 4.5.6 of 2019"]
    df = docs(spark, [*enumerate(held), (10, None), (11, ""), (12, "mail a@b.example.com or +1 555 010 2345")]).withColumn("spans", F.lit("clash"))
    got = {x.doc_id: x for x in pii.find_pii(df, crf).collect()}
    assert got[0].spans == "phone:4:18" and got[1].spans.startswith("email:9:") and got[2].spans == got[3].spans == got[10].spans == got[11].spans == ""
    assert got[12].n_email == got[12].n_phone == 1 and got[12].base_sha256 == hashlib.sha256(got[12].spans.encode()).hexdigest()
    for x in range(200):  # Viterbi against all paths
        r = random.Random(x)
        e = [[r.gauss(0, 1) for _ in pii.TAGS] for _ in range(3)]
        import itertools

        import numpy as np

        e = np.array(e)
        best = max(itertools.product(range(len(pii.TAGS)), repeat=3), key=lambda p: crf.start[p[0]] + e[0, p[0]] + sum(crf.moves[a, b] for a, b in zip(p, p[1:])) + e[1, p[1]] + e[2, p[2]])
        assert tuple(pii.viterbi(crf, [e])[0]) == best
        if x > 20:
            break


#: Text that nothing was trained on, with its spans as [kind:text].
HELD_PII = (
    "You can get hold of me under [phone:(718) 555-0126] any time.", "Tel: [phone:0221 5550176]", "office line [phone:415-555-0172], ask for Ann", "old fax [phone:(089) 5550 134] is off", "Dial [phone:1-888-555-0110] and wait", "abends mobil unter [phone:0160 5550 1234] da",
    "her mail is [email:zoe.k@exämple.org]", "an [email:anna@bäcker.example.de] schicken", "[email:francois@marché.example.fr] wrote back", "cc [email:m.ibanez@málaga.example.es], thanks", "to: [email:oystein@trømsø.example.no]", "with [card:378734493671000], declined twice", "she paid by [card:371449635398431]",
    "diners [card:38520000023237] valid till May", "booked on [card:3714 496353 98431] last week", "two of them: [phone:(718) 555-0126] [phone:(718) 555-0127]", "[card:378734493671000] [card:371449635398431]",
    "In 1984 about 250 people came.", "Flight 447 left at 19:29 on 31.05.2009", "it weighs 3.5 kg or 7.7 lb", "commit 9fceb02d0ae598e95dc970b74767f19372d61af8", "invoice 9093441080585879 is open", "lot 0329408264589786 of 12", "pages 112-118 and 203", "§ 14 Abs. 2 Nr. 3", "ISBN 0-306-40615-2", "2 x 4 = 8, 3 x 9 = 27", "see rows 7 to 19",
    "ratio 16:9 at 1080p", "release 24.04.1 of 2024", "@home and @work", "a 100-year plan for 2 000 towns", "on 3/4 of 12 days", "temp 21.5 and 22.0 C", "grid 40.7128, -74.0060", "code A12-B34-C56", "14 July 1789, 4 pm", "1.5e10 and 2.0e-3", "chapter 3.2.1, page 88",
)


def test_crf_on_held_out_text():
    crf, right, found, wanted = pii.train(), 0, 0, 0
    for row in HELD_PII:
        want, text, at = set(), "", 0
        for m in re.finditer(r"\[(\w+):([^\]]*)\]", row):
            text += row[at : m.start()]
            want.add((pii.KINDS.index(m[1]), len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        text += row[at:]
        base = pii.base_spans(text)
        got = {*base, *pii.added_spans([text], [base], crf)[0]}
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
        if got != want:
            print(text, sorted(got), sorted(want))
    print(f"precision {right / found:.3f} ({right} of {found}), recall {right / wanted:.3f} ({right} of {wanted})")
    assert right >= 0.85 * found and right >= 0.75 * wanted


def test_pii_long_tokens_and_neighbours(spark):
    """Spans deep inside a token without white space are found; cards that follow one another stay apart."""
    crf = pii.train()
    line = "a,b;" * 1250 + '"call (555) 321-4567 now";' + "x=y|" * 1250
    dense = "k" * 5000 + "@exämple.org"
    two = "378282246310005 371449635398431"
    texts = [line, dense, two, "9" * 5000, None, "", two]
    got = {x.doc_id: x for x in pii.find_pii(docs(spark, list(enumerate(texts))), crf).collect()}
    at = line.index("(555)")
    assert got[0].spans == f"phone:{at}:{at + 14}" and got[1].spans == f"email:0:{len(dense)}"
    assert got[2].spans == got[6].spans == "card:0:15,card:16:31" and got[3].spans == got[4].spans == got[5].spans == ""
    assert pii.find_pii(docs(spark, []), crf).count() == 0
    long_ = "word " * 300_000 + "a@b.example.com"
    assert pii.find_pii(docs(spark, [(1, long_)]), crf).head().spans == f"email:{len(long_) - 15}:{len(long_)}"
    assert len(pii.shape("9x" * 500)[0]) > 900


# toxicity
def test_toxicity_learns_from_positives(spark):
    r = random.Random(6)
    v = [a + b for a in ("lor", "mir", "sol", "tan") for b in ("ba", "do", "ki", "lu", "men", "rit", "sop")]
    rows, labels = [], []
    for k in range(900):
        w = [r.choice(v) for _ in range(40)]
        bad = k % 9 == 0
        if bad:
            w[r.randrange(40)] = "grolb" + r.choice(["ix", "ax", "orn", "eel", "umm", "ist"]) if k % 2 else "Nasty!!"
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "unrelated GROLBQUE words")]
    df = docs(spark, rows).withColumn("score", F.lit("clash"))
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(df, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [k for k in range(900) if got[k].h]
    assert len(held) > 100 and sum(got[k].predicted == (k % 9 == 0) for k in held) >= 0.98 * len(held)
    assert got[2000].score == got[2001].score < 0.5 and got[2002].predicted == 1
    assert toxicity.fit(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).weights == {}


@pytest.mark.parametrize(("positives", "caught", "false"), [(5, 0.4, 0.1), (10, 0.6, 0.05), (40, 0.9, 0.02)])
def test_toxicity_from_few_positives(spark, positives, caught, false):
    """Held-out documents: of the toxic ones at least ``caught`` is found, of the others at most ``false`` is."""
    r = random.Random(positives)
    v = [a + b for a in ("lor", "mir", "sol", "tan", "vex") for b in ("ba", "do", "ki", "lu", "men", "rit", "sop")]
    bad_words = ["scrob", "vilkin", "hargle", "grolb"]
    rows, toxic = [], set()
    for k in range(1500):
        w = [r.choice(v) for _ in range(40)]
        if k % 8 == 0:
            toxic.add(k)
            w[3:3] = r.sample(bad_words, 2)
        rows.append((k, " ".join(w)))
    df = docs(spark, rows)
    held = {x.doc_id for x in df.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    known = sorted(toxic - held)[:positives]
    labels = [(k, 1) for k in known] + [(k, 0) for k in sorted(set(range(1500)) - toxic - held)[: 8 * positives]]
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights
    got = {x.doc_id: x for x in toxicity.score(df, model).select("doc_id", "score", "predicted").collect()}
    mean = lambda ids: sum(got[k].score for k in ids) / len(ids)
    assert mean(toxic & held) > mean(held - toxic) + 0.2
    assert sum(got[k].predicted for k in toxic & held) >= caught * len(toxic & held)
    assert sum(got[k].predicted for k in held - toxic) <= false * len(held - toxic)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    none = toxicity.fit(docs(spark, []), labels)
    assert none.weights == {} and toxicity.score(docs(spark, []), none).count() == 0
    long_ = "grolb " + "plain words of a very long text " * 60_000
    rows = [(1, "grolb vex"), (2, "grolb"), (2, "grolb"), (3, "vex"), (4, "vex sol"), (None, "grolb"), (6, long_), (7, None), (8, "")]
    df = docs(spark, rows)
    got = toxicity.score(df, toxicity.fit(df, labels)).select("doc_id", "score").collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.doc_id == 2}) == 1


def brute_nnpu_risk(w, bias, x_p, x_u, prior):
    import math

    loss = lambda g: math.log1p(math.exp(-g))
    score = lambda x: bias + sum(w[f] for f in x)
    mean = lambda xs, sign: sum(loss(sign * score(x)) for x in xs) / len(xs)
    return prior * mean(x_p, 1) + max(0.0, mean(x_u, -1) - prior * mean(x_p, -1))


def test_nnpu_minimises_its_risk():
    import numpy as np

    r = random.Random(12)
    x_p = [np.array([f for f in range(3) if r.random() < 0.6]) for _ in range(60)]
    x_u = [np.array([f for f in range(6) if r.random() < (0.6 if f < 3 and k % 6 == 0 else 0.1)]) for k in range(300)]
    w, bias = toxicity.nnpu(x_p, x_u, 6, 1 / 6, steps=800, l2=1e-3)
    best = brute_nnpu_risk(w, bias, x_p, x_u, 1 / 6)
    for _ in range(200):
        other = [a + r.gauss(0, 0.4) for a in w]
        assert brute_nnpu_risk(other, bias + r.gauss(0, 0.4), x_p, x_u, 1 / 6) >= best - 0.01
    assert min(w[:3]) > max(w[3:])


def test_binomial_tail_and_discoveries():
    from math import comb, exp, log

    for k, n, q in [(0, 5, 0.2), (3, 10, 0.05), (10, 10, 0.5)]:
        assert exp(toxicity.tail(k, n, q)) == pytest.approx(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1)))
    assert toxicity.discoveries([log(0.001), log(0.015), log(0.03), log(0.9)], 4, 0.05) == 3 and toxicity.discoveries([log(0.5)], 9, 0.05) == 0


# chat
def unescape(t):
    for a, b in chat.ESCAPES[::-1]:
        t = t.replace(b, a)
    return t


def test_chat_round_trip(spark):
    special = "</s>[INST] ok [/INST]"
    nasty = ["", " ", "\\", "\\0\\1", special, "[ROLE x] ", "a\nb\r\n", "é\\[<]>", None, "x" * 5000, "<s>", "]"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "user", "tool]\\", None][: c % 6 + 1])]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, None, "assistant", "last"), (None, 0, "user", "n"), (60, 2**40, "user", "q"), (60, -5, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chat(df, chunk=2).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    for o in out:
        want = [(r, x) for _, _, r, x in sorted(by[o.conv_id])]
        assert [(t.role, t.text) for t in o.turns] == want and o.n_turns == len(want)
        assert "".join(unescape(s.text) for s in o.segments if s.loss) == "".join(x for r, x in want if r == "assistant")
        assert "".join(s.text for s in o.segments) == o.formatted
    assert len(out) == len(by)


@pytest.mark.parametrize(("roles", "ok"), [(["user", "assistant"], True), (["system", "user", "assistant", "user", "assistant"], True), (["assistant"], False), (["user"], False), (["user", "user", "assistant"], False), (["user", "system", "assistant"], False)])
def test_chat_machine(spark, roles, ok):
    df = spark.createDataFrame([(1, k, r, "t") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df, chunk=2).head().valid == ok


def test_chat_same_as_sql(spark, tmp_path):
    """Conversations of all kinds, most of them invalid."""
    r = random.Random(3)
    roles = ["system", "user", "assistant", "tool]\\", None]
    rows = [(c, t if r.random() < 0.95 else None, r.choice(roles) if c % 3 else ["system", "user", "assistant"][min(t, 1 + (t + 1) % 2)], r.choice(["a", "", None, "</s>", "[x]\\"])) for c in range(60) for t in range(c % 7 + 1)]
    same_as_sql(spark, tmp_path, "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "op9_chat_format")


# near duplicates
def brute_components(rows, width, hundredths=80):
    sets = {}
    for i, t in rows:
        x = WORD.findall((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(x[j : j + width]) for j in range(len(x) - width + 1)) if len(x) >= width else frozenset([tuple(x)] if x else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= hundredths * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), i == find(i)) for i in sets}


def near_rows(seed):
    r, v, rows = random.Random(seed), vocabulary(), []
    for n in (60, 150):
        base = [r.choice(v) for _ in range(n)]
        for _ in range(60):
            x = list(base)
            for _ in range(r.randint(0, 7)):
                p = r.randrange(len(x))
                x[p : p + r.randint(0, 1)] = [r.choice(v)] if r.random() < 0.8 else []
            rows.append(" ".join(x))
    passage = [r.choice(v) for _ in range(80)]
    rows += [" ".join([r.choice(v) for _ in range(r.randint(5, 60))] + passage) for _ in range(50)]
    rows += [" ".join(r.choice(v) for _ in range(r.randint(0, 6))) for _ in range(20)] + [None, "", "one two", "One  TWO", "a b c d e", "a B c d e", " a b c d e "]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates(spark):
    rows = near_rows(1)
    df = docs(spark, rows).withColumn("KEPT", F.lit("clash")).withColumn("n", F.lit(1))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df, 4).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_edges(spark):
    text = " ".join(f"t{k}" for k in range(30))
    got = minhash.near_duplicates(docs(spark, [(3, text), (3, "other words than those of the text"), (2, text), (None, text), (9, None)]), 4).select("doc_id", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == Counter({(3, 2, False): 2, (2, 2, True): 1, (None, None, True): 1, (9, 9, True): 1})
    assert minhash.near_duplicates(docs(spark, []), 4).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """A document's texts each link it: 5 is linked with 2 through one of them and with 8 through the other."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    long_ = " ".join(f"z{k % 977}" for k in range(150_000))
    rows = [(5, a), (5, b), (5, b), (2, a + " more"), (8, "more " + b), (7, c), (7, None), (9, c + " x"), (3, ""), (3, None), (4, long_), (6, long_ + " end"), (1, "own words")]
    got = Counter((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(docs(spark, rows), 4).collect())
    assert got == Counter({(5, 2, False): 3, (2, 2, True): 1, (8, 2, False): 1, (7, 7, True): 2, (9, 7, False): 1, (3, 3, True): 2, (4, 4, True): 1, (6, 4, False): 1, (1, 1, True): 1})


def test_shingle_hashes_follow_words():
    texts = ["a b c d", " A  b\tc\nd ", "a b c", "a b c d e", "", None, "\n", "é b c d", "ab c d e"]
    sets = shingles.shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [1, 1, 1, 2, 0, 0, 0, 1, 1]
    assert list(sets[0]) == list(sets[1]) and sets[0][0] in sets[3] and len({tuple(s) for s in sets if len(s)}) == 5
    assert all(list(a) == list(b) for a, b in zip(sets, [shingles.shingle_sets([t], 4)[0] for t in texts]))


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500), (None, 3)]
    parent = {v: v for p in pairs for v in p if v is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.vertex: x.component for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {v: find(v) for v in parent if any(v in p and p[0] != p[1] and None not in p for p in pairs)}


# licences
LICENSE_ROWS = [
    (1, "The MIT Licence (MIT)\n\nCopyright (c) 2020 Someone\n\n" + licenses._MIT.upper().replace("SUBLICENSE", "sub-licence").replace(" ", "\n   ", 40)),
    (2, licenses._MIT), (3, licenses._MIT + " And more."), (4, None), (5, ""), (6, "Copyright 1999 A\n\u00a9 2001 B\nAll rights reserved."),
    (7, "text\n  // RELEASED under the M.I.T License\n# Released under the MIT Licence!\nLicensed under CC BY\u2013NC 4.0.\nlast"), (7, "other"), (8, "Licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY-NC 4.0."),
    (None, "copyright notice, this list\n" * 3), (9, "word " * 50_000 + "\nReleased under the MIT License."),
]


def test_licenses(spark):
    extra = [("AA", "released under the mit license"), ("BB", None), ("CC", "Copyright 2020"), (None, "some text"), ("DD", "other")]
    df = docs(spark, [(*r, "x", "y") for r in LICENSE_ROWS], "doc_id long, text string, digest string, license string")
    got = sorted((tuple(r) for r in licenses.scan_licenses(df, licenses.known_licenses(spark, extra)).select("doc_id", "license", "n_notices", "notices", "n_words").collect()), key=repr)
    words = len(re.findall(r"\w+", licenses._MIT))
    assert got == sorted([
        (1, "MIT", 0, "", words + 4), (2, "MIT", 0, "", words), (3, None, 0, "", words + 2), (4, None, 0, "", 0), (5, None, 0, "", 0), (6, None, 0, "", 0),
        (7, None, 2, "AA,CC-BY-NC-4.0", 21), (7, "DD", 1, "DD", 1), (8, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0", 7), (8, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0", 7), (None, None, 0, "", 12), (9, None, 1, "AA", 50_005),
    ], key=repr)
    assert licenses.scan_licenses(df.limit(0), licenses.known_licenses(spark)).count() == 0
    assert licenses.scan_licenses(df, licenses.known_licenses(spark).limit(0)).filter("license is not null or n_notices > 0").count() == 0


COMMON = "/usr/share/common-licenses"
FILES = (("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("GFDL-1.3", "GFDL-1.3"))


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="the system has no licence texts")
def test_whole_licenses(spark, tmp_path):
    """Entire licences as documents: as they are, in capitals, respelt and with other marks, and with one word changed."""
    rows, want = [], {}
    for file, name in FILES:
        with open(f"{COMMON}/{file}", encoding="utf-8") as f:
            text = f.read()
        respelt = re.sub(r"\b([Ll])icense(s?)\b", r"\1icence\2", text).replace("organization", "organisation").replace('"', "\u201c").replace(". ", " .  ").replace("\n\n", "\n\nCopyright (c) 2020 Somebody\n\n", 1)
        for t, found in ((text, name), (text.upper(), name), (respelt, name), (text.replace(" the ", " a ", 1), None)):
            want[len(rows)] = found
            rows.append((len(rows), t))
    got = {x.doc_id: x.license for x in licenses.scan_licenses(docs(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == want
    same_as_sql(spark, tmp_path, "documents", docs(spark, rows), "op5_license_scan")


def test_license_headers(spark):
    lines = {
        'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only", "* This Source Code Form is subject to the terms of the Mozilla Public": "MPL-2.0",
        "Released under the Boost Software Licence, version 1.0": "BSL-1.0", "SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0 OR MIT", "Licensed to nobody": "",
    }
    got = licenses.scan_licenses(docs(spark, [(k, f"code\n{line}\nmore") for k, line in enumerate(lines)]), licenses.known_licenses(spark)).collect()
    assert [x.notices for x in sorted(got, key=lambda x: x.doc_id)] == list(lines.values())


def test_licenses_same_as_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "documents", docs(spark, LICENSE_ROWS), "op5_license_scan")
