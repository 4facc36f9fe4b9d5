import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash as M
from lodestone.llm.common import lower_ascii
from lodestone.llm.components import connected_components


def brute(rows, size, threshold=80):
    sets = {}
    for d, t in rows:
        w = lower_ascii((t or "").encode()).split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def rows_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.fixture(scope="module")
def copies(spark):
    """A group of near copies around one text, chains, exact copies, and unrelated texts."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows, i = [], 0
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        i += 1
    chain = [f"c{j}" for j in range(100)]
    for step in range(12):
        rows.append((i, " ".join(chain[step * 4 : step * 4 + 52])))
        i += 1
    for _ in range(60):
        rows.append((i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))))
        i += 1
    rows += [(i + j, rows[3][1].upper()) for j in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(copies, size):
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    assert rows_of(M.near_duplicates(copies, shingle=size)) == brute(rows, size)


@pytest.mark.parametrize("leaders", [0, 2, 16])
def test_large_groups(copies, monkeypatch, leaders):
    monkeypatch.setattr(M, "GROUP_DOCS", 25)
    monkeypatch.setattr(M, "LEADERS", leaders)
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    assert rows_of(M.near_duplicates(copies, shingle=2)) == brute(rows, 2)


def test_sample_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(M.near_duplicates(docs, shingle=2)) == brute(rows, 2)


def test_odd_rows(odd_docs, no_docs):
    got = M.near_duplicates(odd_docs, shingle=2).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == {(8, 1, True)} and by[8] == {(8, 1, False)}
    assert by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)} and by[7] == {(1, 7, True)} and by[None] == {(4, None, True)}
    assert M.near_duplicates(no_docs).collect() == []


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 62, 1500).astype(np.uint64)
    a, b, tiny = pool[:1200], pool[300:], pool[:3]
    s = M.sketch(np.concatenate((np.sort(a), np.sort(b), tiny, tiny)), np.array([0, 1200, 2400, 2403, 2406]), 160)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15 and (s[2] == s[3]).all() and (s != M._FULL).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 250), (250, 225)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200, 225: 200, 250: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_query(spark, sf):
    from lodestone.llm import queries

    assert queries.op9_near_dedup(spark, sf).where(F.col("kept")).count() > 0


def test_no_link_at_the_threshold_is_missed(spark):
    """200 pairs of similarity 0.80 to 0.85, by replacing words of a text."""
    rng, rows = random.Random(5), []
    for i in range(200):
        a = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        b = list(a)
        for j in rng.sample(range(5, 115, 2), 5 + i % 2):
            b[j] = f"x{rng.randrange(10**9)}"
        sets = [{(x, y) for x, y in zip(t, t[1:])} for t in (a, b)]
        assert 0.80 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.85
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
