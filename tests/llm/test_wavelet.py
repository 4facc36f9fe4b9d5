import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import queries
from lodestone.llm import wavelet as W
from lodestone.llm.queries import VOCABULARY


@pytest.mark.parametrize(("n", "k"), [(0, 3), (1, 1), (513, 5), (5000, 16), (3000, 18)])
def test_rank_select_access(n, k, monkeypatch):
    monkeypatch.setattr(W, "PAGE_BITS", 512)
    a = np.random.default_rng(n).integers(0, 1 << k, n).astype(np.uint32)
    a[: n // 2] %= 7
    m = W.TokenShard(W.to_payload([1], [n], a, k))
    assert (m.to_array() == a).all() and m.n == n
    for i in range(0, n, max(1, n // 40)):
        assert m.access(i) == a[i]
    for v in {*a[:5].tolist(), *a[-3:].tolist(), 0}:
        where = np.flatnonzero(a == v).tolist()
        assert list(m.occurrences(v)) == where and m.count(v) == len(where)
        assert m.rank(v, n // 2) == sum(p < n // 2 for p in where)
        assert m.select(v, len(where)) == -1
    assert m.count(1 << k) == 0


def test_payload_round_trip():
    ids = np.arange(1000, dtype=np.uint32) % 49408
    m = W.TokenShard(W.to_payload([None, 3], [400, 600], ids, 16))
    doc_ids, lengths = m.documents()
    assert doc_ids == [None, 3] and lengths.tolist() == [400, 600] and (m.to_array() == ids).all()


def test_a_lookup_unpacks_one_page_a_plane(monkeypatch):
    m = W.TokenShard(W.to_payload([1], [2_000_000], np.random.default_rng(0).integers(0, 1 << 16, 2_000_000).astype(np.uint16), 16))
    m.access(1_234_567)
    assert len(m._unpacked) == 16 and m.n_pages == 8


def test_files(spark, odd_docs, no_docs):
    files = W.write_token_files(odd_docs, VOCABULARY)
    rows = W.read_documents(files).collect()
    assert len(rows) == odd_docs.count() and min(r["n_tokens"] for r in rows) == 1
    spans = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert W.read_documents(W.write_token_files(no_docs, VOCABULARY)).collect() == []
    # one file and one row a shard
    assert files.select("shard").distinct().count() == files.count()


def test_lookups_over_the_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = Tokenizer.from_file(VOCABULARY)
    flat = [i for _, x in sorted((r["doc_id"], r["text"]) for r in docs.collect()) for i in [*t.encode(x or "", add_special_tokens=False).ids, 2]]
    files = W.write_token_files(docs, VOCABULARY)
    for token in (2, flat[5], 49_000):
        where = [i for i, x in enumerate(flat) if x == token]
        assert sum(r["n"] for r in W.token_count(files, token).collect()) == len(where)
        assert sorted(r["position"] for r in W.token_occurrences(files, token).collect()) == where
    ask = [0, 1, len(flat) // 2, len(flat) // 3, len(flat) - 1]
    got = {r["position"]: r["token"] for r in W.tokens_at(files, spark.createDataFrame([(x,) for x in [*ask, ask[0], -1, len(flat), None]], "p bigint")).collect()}
    assert got == {x: flat[x] for x in ask}


def test_planes_follow_from_the_vocabulary(spark):
    assert W.planes_for(VOCABULARY, 2) == 16 and W.planes_for(VOCABULARY, 70_000) == 17
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert W.TokenShard(W.write_token_files(docs, VOCABULARY, 70_000).first()["payload"]).to_array()[-1] == 70_000
    with pytest.raises(Exception, match="planes"):
        W.write_token_files(docs, VOCABULARY, 70_000, n_planes=16)


def test_repeated_and_missing_ids_spread(spark):
    docs = spark.createDataFrame([(7 if i % 3 else None, f"text number {i} " * 20) for i in range(400)], "doc_id bigint, text string")
    files = W.write_token_files(docs, VOCABULARY)
    assert W.read_documents(files).count() == 400 and files.count() > 2


def test_query(spark, sf):
    t = Tokenizer.from_file(VOCABULARY)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op6_token_files(spark, sf).collect()}
    start = 0
    for (d, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        assert got.pop(d) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not got


class _Spy:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_each_word_goes_to_the_library_once(monkeypatch):
    """However it is capitalised and whatever punctuation follows; and the ids are the library's."""
    library = Tokenizer.from_file(VOCABULARY)
    encoder = W._Encoder(VOCABULARY, 2)
    encoder.tokenizer = spy = _Spy(library)
    texts = ["Word word. WORD, word!!! (word) wörd Wörd. it's", "", "ǅ Ǆ ǆ. İi ÿŸ ſ ßẞ µΜμ 12% a1 ́a  b  Å Σσς <|endoftext|>. x<|endoftext|>", "... word? don't WÖRD; ½ 東京. 😀!"]
    ids, sizes = encoder.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    sent = " ".join(spy.texts).split()
    assert sent.count("word") == 1 and sent.count("wörd") == 1 and not {"Word", "word.", "Wörd", "WÖRD;"} & {*sent}
    for name, value in (("CACHE_PARTS", 2), ("CACHE_CHUNKS", 5)):
        monkeypatch.setattr(W, name, value)
        again = [encoder.encode([t.encode()])[0].tolist() for t in (*texts, *texts)]
        assert sum(again, []) == ids.tolist() * 2


def test_parts_of_other_vocabularies(tmp_path):
    """Case that counts, punctuation that is no word of its own, and added tokens are left to the library."""
    from tokenizers import AddedToken, models, pre_tokenizers

    symbols = [c + end for c in "abAB.,!" for end in ("", "</w>")]
    merges = [("a", "b</w>"), ("A", "b"), ("b", ".</w>")]
    t = Tokenizer(models.BPE({s: i for i, s in enumerate([*symbols, *map("".join, merges)])}, merges, end_of_word_suffix="</w>"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.add_tokens([AddedToken("BA!", normalized=False)])
    t.save(path := str(tmp_path / "small.json"))
    text = "ab Ab. ab. AB ab,. BA! aBA!b b. . ,, ab! aB"
    ids, _ = W._Encoder(path, 99).encode([text.encode()])
    assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 99]
