"""The registered queries on the smallest tables: against their SQL, and the pipeline stage by stage."""

import hashlib
import math
import os
import re
from collections import defaultdict

import duckdb
import pytest

import compare
import corpus_pipeline
from gitstrata.llm import queries, store, toxicity
from test_llm import WORD, brute_components, brute_leaks, brute_lines, brute_mix

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.SQL[name])
    assert compare.rows(df.columns, df.collect()) == compare.rows([d[0] for d in rel.description], rel.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = store.written(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "mixing"]
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[5]


def brute_pipeline(rows, model, items):
    """rows: (doc_id, text, source). (doc_id, text, copy) of the mix; the model is given, all else is plain Python."""
    sources = {i: s for i, _, s in rows}

    def toxic(t):
        g = model.bias
        for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())):
            g += sum(model.weights.get(f, 0.0) for f in [w + "$", *(w[:n] for n in (4, 5, 6) if len(w) >= n)])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, round(g, 9))))) >= 0.5

    clean = [(i, t) for i, t, _ in rows if not toxic(t)]
    lines = [(i, kept) for i, _, _, kept in brute_lines(clean)]
    group = brute_components(lines, 5)
    alone = [(i, t) for i, t in lines if group[i][2]]
    leaked = {i for i, _ in brute_leaks(alone, items)}
    left = [(i, t, sources[i]) for i, t in alone if i not in leaked]
    counts = [len(clean), len(alone), len(left)]
    total, target = brute_mix(left)
    by_source = defaultdict(list)
    for i, t, s in left:
        by_source[s].append((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, t))
    out = []
    for s, members in by_source.items():
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        extra, upto = target[s] - whole * total[s], 0
        for _, i, t in sorted(members):
            n = len(WORD.findall(t))
            upto += n
            times = whole + (extra > 0 and upto - n / 2 <= extra)
            out += [(i, t, c + 1) for c in range(times)]
    return sorted(out), counts


def test_pipeline_against_brute_force(spark):
    """Whole tables of 1,000 documents; every stage must have something to do."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want, counts = brute_pipeline(rows, model, items)
    assert len(rows) > counts[0] > counts[1] > counts[2] > 0
    got = corpus_pipeline.run(spark, sf).select("doc_id", "text", "copy", "n_chars").collect()
    assert sorted((r.doc_id, r.text, r.copy) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
