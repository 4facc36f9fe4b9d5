import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe_automaton as B
from lodestone.llm import queries
from lodestone.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_matches_the_library_on_odd_strings(library):
    rng = random.Random(1)
    kinds = ["abcdefghij '", "aab ", "éÉΣσİıßẞ á̧e", "".join(map(chr, range(1, 400))), "the ing'll've s t d re 0123 ½Ⅷ東京한글😀👍🏽"]
    for k in range(3000):
        s = "".join(rng.choice(kinds[k % 5]) for _ in range(rng.randint(0, 30)))
        if k % 50 == 0:
            s += "<|endoftext|> x<|startoftext|>" + s
        want = library.encode(s, add_special_tokens=False).ids
        ids, decoded = B.written_ids(VOCABULARY, s.encode())
        assert [*map(int, ids.split())] == want == B.automaton(VOCABULARY).encode(s)
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_arcs_forbid_merged_pairs():
    a = B.automaton(VOCABULARY)
    t, h, th = (next(i for i, s in a.labels.items() if s == x) for x in ("t", "h", "th"))
    assert not a.arc(t, h) and a.arc(th, t) and not a.arc(t, next(i for i, s in a.labels.items() if s == "he"))


def test_encoding_follows_the_table(library, monkeypatch):
    """A word's path through table[state][symbol] alone gives its ids; small tables, built anew again and again, too."""
    a = B.automaton(VOCABULARY)
    rng = random.Random(3)
    text = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    want = {w: tuple(library.encode(w, add_special_tokens=False).ids) for w in text}
    a.forget()
    assert len(a.table) == 1
    assert {w: a.encode_word(w) for w in text} == want
    for w in text:
        state, path = 0, []
        for c in (*w[:-1], w[-1] + B.END):
            state = a.table[state][c]
            path.append(state)
        ids, i = [], len(path)
        while i:
            ids.insert(0, a.token[path[i - 1]])
            i -= a.length[path[i - 1]]
        assert tuple(ids) == want[w]
    rows = sum(map(len, a.table))
    a._words.clear()
    assert {w: a.encode_word(w) for w in text} == want and sum(map(len, a.table)) == rows  # nothing is built twice
    monkeypatch.setattr(B, "TABLE_STATES", 20)
    a._words.clear()
    assert {w: a.encode_word(w) for w in text} == want


def test_new_words_take_their_steps_together(library, monkeypatch):
    """Chunks new to a group of texts are encoded without a walk of their own, each once; small tables and caches give the same."""
    rng = random.Random(5)
    kinds = ["abcdefghij ", "éÉΣσİıßẞ á̧e", "".join(map(chr, range(40, 400))), "the ing s t 0123 ½Ⅷ東京한글😀👍🏽\u00a0\u2003\u0301x.,"]
    texts = ["".join(rng.choice(kinds[k % 4]) for _ in range(rng.randint(0, 40))) for k in range(400)]
    texts = [t.replace("<", "") for t in texts] + ["", " \t", "\u00a0 \u0301a \u00a0b\u00a0"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    chunks = B._chunks(VOCABULARY, True)
    chunks.forget()
    with monkeypatch.context() as m:
        m.setattr(B, "LONG", 1000)
        m.setattr(B.MergeAutomaton, "encode_word", None)
        got = chunks.write([t.encode() for t in texts])
        steps = []
        m.setattr(B.MergeAutomaton, "encode_words", lambda *a: steps.append(a))
        assert chunks.write([t.encode() for t in texts]) == got and not steps
    assert [np.frombuffer(ids, "<i4").tolist() for ids, _ in got] == want
    assert [labels[:-1].decode() for _, labels in got] == [library.decode(ids, skip_special_tokens=False) for ids in want]
    for name, value in (("TABLE_STATES", 20), ("WORDS_TOGETHER", 7), ("CACHE_CHUNKS", 30), ("LONG", 3)):
        monkeypatch.setattr(B, name, value)
        chunks.forget_chunks()
        assert [x for i in range(0, len(texts), 9) for x in chunks.write([t.encode() for t in texts[i : i + 9]])] == got
    broken = [b"a\xe2\x82", b"\xff", b"\x82b \xf0\x9f\x98 c", None]
    assert [np.frombuffer(ids, "<i4").tolist() for ids, _ in chunks.write(broken)] == [library.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]


def test_pieces_follow_bytes(monkeypatch):
    """Documents are cut into pieces by their bytes, not only their number; none is lost and a long one stands alone."""
    monkeypatch.setattr(B, "TOGETHER_BYTES", 10)
    monkeypatch.setattr(B, "TOGETHER", 4)
    texts = [b"x" * n for n in (3, 7, 1, 40, 0, 0, 0, 0, 0, 6, 6)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    assert [p.column("doc_id").to_pylist() for p in B._pieces(batch)] == [[0, 1], [2], [3], [4, 5, 6, 7], [8, 9], [10, 11]]


def test_documents(spark, odd_docs, no_docs, library):
    rows = B.encode_documents(odd_docs, VOCABULARY).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["input_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert B.encode_documents(no_docs, VOCABULARY, keep="digests").collect() == []


def test_query(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op8_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
