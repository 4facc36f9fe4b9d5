"""LM scoring and substring dedup against brute force, over one and over many blocks."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import blocks, ngram, superkmer
from lodestone.llm.common import lower_ascii


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def lm_brute(rows, order=3):
    """(held_out, n_tokens, n_known, base, score) per row, with the n-gram model spelt out."""
    seqs = [(d, lower_ascii((t or "").encode()).split() + ["END"]) for d, t in rows]
    grams = [Counter() for _ in range(order + 1)]
    for d, s in seqs:
        if not held_out(d):
            s = ["BOS", *s]
            for n in range(1, order + 1):
                grams[n].update(tuple(s[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(s)))
    uni = grams[1]
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    cut = (once + 1) / (once + 2 * twice + 2)
    ks = [1.0, 1.0]
    for m in range(2, order + 1):
        number, total = np.zeros(ngram.POWERS), np.zeros(ngram.POWERS)
        for c in grams[m - 1].values():
            number[c.bit_length() - 1] += 1
            total[c.bit_length() - 1] += c
        ks.append(ngram.damping(sum(c == 1 for c in grams[m].values()), number, total))
    after = Counter({("BOS",): uni["END",]}) + uni

    def p(history, w):
        if not history:
            c = uni[w,]
            return 1.0 if n == 0 else (c - cut if c else cut * v) / n
        ch = after[history] if len(history) == 1 else grams[len(history)][history]
        lower = p(history[1:], w)
        k = ks[len(history) + 1]
        return (grams[len(history) + 1][(*history, w)] + k * lower) / (ch + k) if ch else lower

    out = []
    for d, s in seqs:
        padded = ["BOS", *s]
        base = sum(math.log10((uni[w,] + 1) / (n + v + 1)) for w in s)
        score = sum(math.log10(p(tuple(padded[max(0, i - order + 1) : i]), padded[i])) for i in range(1, len(padded)))
        out.append((d, held_out(d), len(s), sum((w,) in uni for w in s), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def lm_rows(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect()), key=str)


def cut_brute(rows, k):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or ""))
    for i in order:
        d, t = rows[i]
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            if x in seen:
                gone[a : a + k] = [True] * k
            seen.add(x)
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def cut_rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sample(spark, sf):
    """Documents with a passage that stands in many of them, and a group of near copies, in several partitions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text"))
    passage = " ".join(f"p{i}" for i in range(45))
    mixed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" " + passage + " "), F.col("text"))).otherwise(F.col("text")))
    return mixed.repartition(3).persist()


@pytest.mark.parametrize(("block_bytes", "order", "lane"), [(5_000, 3, 1024), (1 << 23, 3, 7), (1 << 23, 1, 1024), (50_000, 2, 50), (1 << 23, 4, 100)])
def test_lm_against_brute_force(sample, block_bytes, order, lane, monkeypatch):
    monkeypatch.setattr(ngram, "LANE", lane)
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert lm_rows(ngram.score_documents(sample, order, block_bytes=block_bytes)) == lm_brute(rows, order)


@pytest.mark.parametrize("block_bytes", [5_000, 1 << 23])
def test_substrings_against_brute_force(sample, block_bytes):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert cut_rows(superkmer.remove_repeats(sample, keep="digest", block_bytes=block_bytes)) == cut_brute(rows, 20)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert lm_rows(ngram.score_documents(odd_docs)) == lm_brute(rows)
    assert cut_rows(superkmer.remove_repeats(odd_docs, k=4, m=2, keep="digest", block_bytes=50)) == cut_brute(rows, 4)
    assert ngram.score_documents(no_docs).collect() == [] and superkmer.remove_repeats(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    only = spark.createDataFrame([(d, "some text") for d in range(200) if held_out(d)], "doc_id bigint, text string")
    assert {(r["score"], r["base_score"], r["n_known"]) for r in ngram.score_documents(only).collect()} == {(0.0, 0.0, 0)}


def automaton_of(texts, order):
    """The automaton of one block that holds all of a corpus, and its block."""
    block = ngram.Block.of(ngram.seal_words([None] * len(texts), [x.encode() for x in texts], pa.int64()), 7, 2)
    keys = block.keys(order, 48)
    counts = [ngram._distinct(k, block.is_token & (k != 0), block.train) for k in keys]
    model = ngram.Model.of([blocks._figures(c) for _, c in counts])
    return ngram.BackoffAutomaton(block, keys, counts, model), block, model


@pytest.mark.parametrize("order", [2, 3, 4])
def test_a_state_sums_to_one(order):
    """Over all known words, and the class of unknown ones, from every state; failure arcs lead to shorter contexts."""
    fsa, block, model = automaton_of(["a b a c d a b", "a b b", "c a b a c", "a", "d d d a b a"], order)
    words = np.arange(1, fsa.width)  # all but the begin mark
    assert len(fsa.fail) == len(fsa.fail_weight) > 5 and (fsa.fail[1:] < np.arange(1, len(fsa.fail))).all()
    assert (fsa.arc[1:] > fsa.arc[:-1]).all() and (fsa.arc_next < len(fsa.fail)).all()
    cut = (model.once + 1) / (model.once + 2 * model.twice + 2)
    for state in range(len(fsa.fail)):
        reached, weight = fsa.step(np.full(len(words), state), words)
        unknown, at = np.log10(cut * model.distinct / model.tokens), state
        while at:
            unknown, at = unknown + fsa.fail_weight[at], fsa.fail[at]
        assert abs((10**weight).sum() + 10**unknown - 1) < 1e-9


def test_the_state_is_the_longest_known_context():
    fsa, block, _ = automaton_of(["a b c", "b c d"], 3)
    ids = {w: i for i, w in enumerate(["BOS", "END", "a", "b", "c", "d"])}
    state = np.array([fsa.root_next[ids["BOS"]]])
    for w, back in zip("abc", ("BOS", "a", "b"), strict=True):
        state, _ = fsa.step(state, np.array([ids[w]]))
        assert fsa.fail[state[0]] == fsa.root_next[ids[w]]  # a pair fails to its last word


def test_what_occurs_twice_scores_higher(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:20]]) if not held_out(i)]
    got = {r["doc_id"]: r["score"] for r in ngram.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    twice = [got[i] for i, t in rows if i < 20 and (120 + i) in got]
    once = [got[i] for i, _ in rows if 20 <= i < 120]
    assert min(twice) > max(once)


def test_kept_text(spark):
    a = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(2, f"new  {a} tail"), (1, a), (3, "two  blanks\nstay")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_text"] for r in superkmer.remove_repeats(docs).collect()}
    assert got == {1: a, 2: "new tail", 3: "two  blanks\nstay"}


def test_hash_collisions_are_settled_by_words(monkeypatch):
    monkeypatch.setattr(superkmer, "run_hashes", lambda h, size: np.zeros(len(h) - size + 1, np.uint64))
    words = superkmer.Words.of([b"a b c d a b c x b c d".split()], 3)
    assert words.repeats(3).tolist() == [False, False, False, False, True, False, False, False, True]


def test_squeezing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (blocks.unsqueeze_sorted(blocks.squeeze_sorted(keys)) == keys).all()
    assert blocks.unsqueeze_sorted(blocks.squeeze_sorted(keys[:0])).tolist() == []
