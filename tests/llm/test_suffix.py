import hashlib
import random
import re

import pytest

from lodestone.llm import queries
from lodestone.llm import suffix as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    sizes = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    found |= wins[tuple(w[a : a + k])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    voc = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randrange(0, 25)))) for i in range(30)] + [(30, None), (31, "Solo!"), (2, "another row of item two"), (32, "—")]
    docs = [(i, " ".join(rng.choice([*voc, "z", "Solo"]) for _ in range(rng.randrange(0, 80)))) for i in range(120)]
    for i in range(0, 120, 7):
        docs.append((500 + i, f"Pre {items[i % 30][1].upper()}, post-{items[(i + 1) % 30][1]}"))
    docs += [(900, None), (901, ""), (None, items[3][1]), (902, items[4][1] * 3)]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(tables):
    docs, items, d, b = tables
    assert got(S.contamination(d, b)) == brute(docs, items)
    assert got(S.contamination(d, b, width=3)) == brute(docs, items, 3)


def test_benchmark_in_parts(tables, monkeypatch):
    docs, items, d, b = tables
    monkeypatch.setattr(S, "BENCHMARK_BYTES", 400)
    assert got(S.contamination(d, b)) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "quick brown fox"), (2, None)], "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(S.contamination(odd_docs, b)) == brute(rows, [(1, "quick brown fox")])
    assert got(S.contamination(odd_docs, b.limit(0))) == brute(rows, [])
    assert S.contamination(no_docs, b).collect() == []


def test_suffixes_are_sorted():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 400):
        words_ = np.r_[rng.integers(0, 4, n), np.tile([1, 2], n), 0]
        order = S.suffix_array(words_, 10_000)

        def suffix(i):
            return tuple(words_[i : i + int(np.flatnonzero(words_[i:] == 0)[0])])

        keys = [suffix(i) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == np.flatnonzero(words_).tolist()


def longest_brute(docs, items, least=1):
    out = set()
    for i, t in items:
        w = words(t)
        for a in range(len(w)):
            best = None
            for d, x in docs:
                x = words(x)
                for b in range(len(x)):
                    n = 0
                    while a + n < len(w) and b + n < len(x) and w[a + n] == x[b + n]:
                        n += 1
                    if n >= least and (best is None or (-n, d, b) < best):
                        best = (-n, d, b)
            if best:
                out.add((i, a, -best[0], best[1], best[2]))
    return out


def test_longest_matches(spark):
    rng = random.Random(6)
    voc = "abcd"
    docs = [(i, " ".join(rng.choice([*voc, "z"]) for _ in range(rng.randrange(0, 30)))) for i in range(12)]
    items = [(f"t{i}", " ".join(rng.choice(voc) for _ in range(rng.randrange(0, 12)))) for i in range(6)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([*items, ("none", None)], "item_id string, text string")
    for least in (1, 4):
        got_ = S.longest_matches(d, b, least).collect()
        want = longest_brute(docs, items, least)
        assert {(r["item_id"], r["offset"], r["n_words"]) for r in got_} == {x[:3] for x in want} and len(got_) == len(want)
        texts = dict(docs)
        for r in got_:
            own = words(dict(items)[r["item_id"]])[r["offset"] :][: r["n_words"]]
            assert words(texts[r["doc_id"]])[r["at"] :][: r["n_words"]] == own
    assert S.longest_matches(d, b.limit(0)).collect() == [] and S.longest_matches(d.limit(0), b).collect() == []


def test_a_very_long_item():
    """20,000 words, whole and in part in a document: memory in proportion to the words."""
    import pickle
    import tracemalloc

    long = [f"w{i % 9973}" for i in range(20_000)]
    tracemalloc.start()
    test = S.test_suffixes([(1, " ".join(long).encode()), (2, b"short item of words")], 10)
    shard = S.Shard([[x.encode() for x in long], [x.encode() for x in long[500:700]], [b"clean"]], test)
    at, size, window, items = shard.windows()
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and len(pickle.dumps(test)) < 4 << 20
    tracemalloc.stop()
    doc = (at[:, None] >= shard.begin[None, :-1]).sum(1) - 1
    assert set(doc.tolist()) == {0, 1} and {test.items[x] for i in items for x in i.tolist()} == {1}


def test_equal_windows_of_many_items(spark):
    """A passage that stands in all items is found once, whoever holds it."""
    passage = " ".join(f"p{i}" for i in range(12))
    items = [(i, f"{passage} own{i}") for i in range(200)]
    docs = [(i, f"x {passage} y" if i % 2 else "clean") for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert got(S.contamination(d, b)) == brute(docs, items)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(queries.op5_decontaminate(spark, sf)) == brute(docs, items)


def test_parts_judge_each_row(spark, tables, monkeypatch):
    _, items, _, b = tables
    rows = [(1, items[5][1]), (1, items[5][1]), (1, "clean words"), (None, items[6][1]), (None, "other clean words"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(S, "BENCHMARK_BYTES", 400)
    assert got(S.contamination(d, b)) == brute(rows, items)
