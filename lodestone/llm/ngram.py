"""Language-model scoring with a weighted backoff automaton.

States are contexts: the empty one, single words, pairs of words, and so on up to
``order - 1`` words, as far as training texts have them.  A state has an arc for each
word seen after it, and a failure arc to the state of the context without its first
word.  The automaton reads a text from left to right, one word a step: it takes the
word's arc if the state has it, else failure arcs until a state has, and adds the
log10 weights of all arcs taken.  Weights are interpolated and smoothed:

    P(w | h) = (c(h w) + k P(w | shorter h)) / (c(h) + k)

An arc carries log10 P(w | h), a failure arc log10 k / (c(h) + k), so each state's
probabilities sum to one.  k of each order is estimated from the data: it gives words
not seen after their context, over all contexts, the share that n-grams seen once have
(Good-Turing).  The empty context has discounted relative frequencies, the discount
coming from the numbers of words seen once and twice, and the discounted mass goes to
the class of unknown words.

Counts are exact sums over the corpus.  Documents are packed into blocks of word ids;
a block's automaton has the states and arcs that its own texts can reach, with the
corpus's counts.  Long texts go in lanes: a lane starts ``order - 1`` words early, which
brings it into the very state in which the lane before ends.

Defined results: null text is empty and consists of the end token; A-Z is
lower-cased; with no training text every probability is 1; rows with a null id
belong to training; repeated rows are counted and scored each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import POWERS, Ids, compress, decompress, key_ranges, look_up, pack, squeeze, totals, unsqueeze, with_answers
from .common import lower_ascii, mix64, release_memory

ORDER = 3
#: Text bytes of a block: its automaton takes some 50 times as much memory.
LM_BLOCK_BYTES = 4 << 20
#: Tokens of a lane.
LANE = 1024
#: Least bits of the key of an n-gram of several words; single words have 64.
KEY_BITS = 40
_BOS, _END = b" s", b" e"  # a blank can't be in a word
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out_of(doc_ids: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % modulus == remainder for x in doc_ids.to_pylist()], bool)


def key_bits(n_bytes: int) -> int:
    """Key width that keeps the share of n-grams with a foreign key's count under 2^-8 at any size."""
    return min(64, max(KEY_BITS, n_bytes.bit_length() + 8))


def seal_words(doc_ids: list, texts: list[bytes], kind: pa.DataType, _: pa.Array | None = None) -> bytes:
    """A block as word ids: document ids, words per document, ids (begin mark, words, end token), hashes of the block's words by id."""
    ids = Ids()
    bos, end = ids[_BOS], ids[_END]
    parts = []
    for text in texts:
        words = lower_ascii(text).split()
        parts.append(np.fromiter((bos, *map(ids.__getitem__, words), end), np.uint32, len(words) + 2))
    batch = pa.RecordBatch.from_arrays([pa.array(doc_ids, kind)], names=["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    hashes = mix64(ids.hashes())
    hashes[hashes == 0] = np.uint64(1)
    fields = [compress(sink.getvalue().to_pybytes()), squeeze(np.array([*map(len, parts)], np.uint32)), squeeze(np.concatenate(parts)), hashes.tobytes()]
    return struct.pack("<4Q", *map(len, fields)) + b"".join(fields)


@dataclass
class Block:
    doc_ids: pa.Array
    ids: np.ndarray  # of each position
    begin: np.ndarray  # position of each document's begin mark, and the end of all
    hashes: np.ndarray  # of each id
    is_token: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, payload: bytes, modulus: int, remainder: int) -> Block:
        sizes, at, fields = struct.unpack_from("<4Q", payload), 32, []
        for size in sizes:
            fields.append(payload[at : at + size])
            at += size
        doc_ids = pa.ipc.open_stream(decompress(fields[0])).read_next_batch().column("doc_id")
        lengths, ids = unsqueeze(fields[1], np.uint32).astype(np.int64), unsqueeze(fields[2], np.uint32).view(np.int32)
        begin = np.r_[0, np.cumsum(lengths)]
        is_token = np.ones(len(ids), bool)
        is_token[begin[:-1]] = False
        return cls(doc_ids, ids, begin, np.frombuffer(fields[3], np.uint64), is_token, np.repeat(~held_out_of(doc_ids, modulus, remainder), lengths))

    def keys(self, order: int, bits: int) -> list[np.ndarray]:
        """By n: the key of the n-gram that ends at each position; 0 where there is none. A key of several words has ``bits`` high bits."""
        place = np.arange(len(self.ids)) - np.repeat(self.begin[:-1], np.diff(self.begin))
        single = self.hashes[self.ids]
        out, whole, low = [single], single, np.uint64(64 - bits)
        for n in range(2, order + 1):
            grown = np.zeros(len(single), np.uint64)
            grown[1:] = mix64(whole[:-1] * _STEP + single[1:])
            grown[place < n - 1] = 0
            whole = grown
            key = (grown >> low) << low
            key[(key == 0) & (grown != 0)] = np.uint64(1) << low
            out.append(key)
        return out


def _distinct(key: np.ndarray, use: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts in training documents."""
    key, train = key[use], train[use]
    if not len(key):
        return key, np.zeros(0, np.int64)
    order = np.argsort(key)
    key, train = key[order], train[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(train, first)


def damping(once: int, contexts: np.ndarray, sums: np.ndarray) -> float:
    """k with sum over contexts of c k / (c + k) = n-grams seen once, contexts given by number and total per power of two."""
    c = sums / np.maximum(contexts, 1)
    if not once or not sums.sum():
        return 1.0
    low, high = 1e-3, 1e4
    for _ in range(80):
        k = (low * high) ** 0.5
        if (sums * k / (c + k)).sum() < once:
            low = k
        else:
            high = k
    return float(k)


@dataclass
class Model:
    """Figures of the whole corpus: training tokens, distinct ones, those seen once and twice, and k of each order from 2 on."""

    tokens: int
    distinct: int
    once: int
    twice: int
    k: list[float]

    @classmethod
    def of(cls, figures: list[list[int]]) -> Model:
        """From the figures of each order's n-grams."""
        power = [(np.array(f[4 : 4 + POWERS], float), np.array(f[4 + POWERS :], float)) for f in figures]
        return cls(figures[0][1], figures[0][0], figures[0][2], figures[0][3], [damping(figures[n][2], *power[n - 1]) for n in range(1, len(figures))])

    def probability(self, count: np.ndarray) -> np.ndarray:
        """Of a word in the empty context."""
        if not self.tokens:
            return np.ones(len(count))
        discount = (self.once + 1) / (self.once + 2 * self.twice + 2)
        return np.where(count > 0, count - discount, discount * self.distinct) / self.tokens

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))


class BackoffAutomaton:
    """States and arcs that a block's texts can reach. State 0 is the empty context; arcs are sorted by (state, word)."""

    def __init__(self, block: Block, keys: list[np.ndarray], counts: list[tuple[np.ndarray, np.ndarray]], model: Model):
        """``counts`` has the sorted keys of each order with their counts in the whole corpus."""
        order, ids = len(keys), block.ids
        self.width = len(block.hashes)
        count, self.word_count = [], np.zeros(self.width, np.int64)
        own, total = counts[0]
        at = np.searchsorted(own, block.hashes)
        known = at < len(own)
        known[known] = own[at[known]] == block.hashes[known]
        self.word_count[known] = total[at[known]]
        self.root_weight = np.log10(model.probability(self.word_count))
        p = model.probability(self.word_count)
        context = self.word_count.copy()
        context[0], context[1] = context[1], 0  # a begin mark for each end token, which nothing follows
        # words as contexts: one state each
        state = np.where(context > 0, np.cumsum(context > 0), 0) * (order > 1)
        self.root_next = state
        fail, fail_weight, n_states = [np.zeros(1, np.int64)], [np.zeros(1)], int((context > 0).sum()) + 1
        if order > 1:
            live = np.flatnonzero(context > 0)
            fail.append(np.zeros(len(live), np.int64))
            fail_weight.append(np.log10(model.k[0] / (context[live] + model.k[0])))
        gram, arcs = ids, []  # number of the n-gram that ends at each position
        for n in range(2, order + 1):
            at = np.flatnonzero(keys[n - 1])
            own, total = counts[n - 1]
            number = np.zeros(len(ids), np.int32)
            number[at] = np.searchsorted(own, keys[n - 1][at])
            one = np.zeros(len(own), np.int32)  # a position of each n-gram
            one[number[at]] = at
            keys[n - 1] = at = None
            before, lower = gram[one - 1], gram[one]
            k, c = model.k[n - 2], context[before]
            p = np.where(c > 0, (total + k * p[lower]) / (c + k), p[lower])
            seen = np.flatnonzero(total > 0)
            source = state[before[seen]].astype(np.int64)
            if n < order:  # n-grams as contexts
                grown = np.zeros(len(own), np.int32)
                inner = seen[ids[one[seen]] != 1]
                grown[inner] = n_states + np.arange(len(inner))
                n_states += len(inner)
                fail.append(state[lower[inner]])
                fail_weight.append(np.log10(model.k[n - 1] / (total[inner] + model.k[n - 1])))
            else:
                grown = state[lower]
            arcs.append((source * self.width + ids[one[seen]], np.log10(p[seen]), grown[seen]))
            gram, context, state = number, total.astype(np.float64), grown
            del own, total, one, before, lower, c
        del gram, context
        self.fail, self.fail_weight = np.concatenate(fail).astype(np.int32), np.concatenate(fail_weight)
        key = np.concatenate([a[0] for a in arcs]) if arcs else np.zeros(0, np.int64)
        by = np.argsort(key)
        self.arc = key[by]
        del key
        self.arc_weight = np.concatenate([a[1] for a in arcs])[by] if arcs else np.zeros(0)
        self.arc_next = np.concatenate([a[2] for a in arcs])[by].astype(np.int32) if arcs else np.zeros(0, np.int32)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states reached, log10 weights of the arcs taken) by reading one word in each state."""
        weight, reached = np.zeros(len(words)), np.zeros(len(words), np.int64)
        open_, at_state = np.arange(len(words)), states
        while len(open_):
            word = words[open_]
            key = at_state.astype(np.int64) * self.width + word
            place = np.searchsorted(self.arc, key)
            has = (place < len(self.arc)) & (at_state > 0)
            has[has] = self.arc[place[has]] == key[has]
            rows = open_[has]
            weight[rows] += self.arc_weight[place[has]]
            reached[rows] = self.arc_next[place[has]]
            root = at_state == 0
            rows = open_[root]
            weight[rows] += self.root_weight[word[root]]
            reached[rows] = self.root_next[word[root]]
            left = ~(has | root)
            open_, at_state = open_[left], at_state[left]
            weight[open_] += self.fail_weight[at_state]
            at_state = self.fail[at_state]
        return reached, weight

    def run(self, block: Block, order: int) -> np.ndarray:
        """log10 probability of each document: its tokens are read from left to right, the state carried along."""
        first, stop = block.begin[:-1] + 1, block.begin[1:]
        n = -(-(stop - first) // LANE)
        doc = np.repeat(np.arange(len(first)), n)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = first[doc] + LANE * inner
        length = np.minimum(stop[doc] - start, LANE)
        by = np.argsort(-length, kind="stable")
        doc, start, length, inner = doc[by], start[by], length[by], inner[by]
        state = np.full(len(doc), self.root_next[0], np.int64)  # after the begin mark
        later = np.flatnonzero(inner)
        state[later] = 0
        for back in range(order - 1, 0, -1):
            state[later] = self.step(state[later], block.ids[start[later] - back])[0]
        score = np.zeros(len(doc))
        for t in range(int(length.max(initial=0))):
            n_open = np.searchsorted(-length, -t)  # lanes longer than t come first
            state, weight = self.step(state[:n_open], block.ids[start[:n_open] + t])
            score[:n_open] += weight
        return np.bincount(doc, score, len(first))


def score_documents(docs: DataFrame, order: int = ORDER, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = LM_BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod ``modulus`` is not ``remainder``.  Two shuffles, of
    distinct n-gram keys per block and of the counts that a block can't know itself.
    """
    blocks = pack(docs, id_col, text_col, block_bytes, seal=seal_words)
    id_type = docs.schema[id_col].dataType.simpleString()
    bits = key_bits(blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    drop = [0, *[64 - bits] * (order - 1)]

    def counted(block: Block, keys: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_distinct(k, block.is_token & (k != 0), block.train) for k in keys]

    def keys_of(payload: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        block = Block.of(payload, modulus, remainder)
        return counted(block, block.keys(order, bits))

    ranges = key_ranges(blocks)
    answers = totals(blocks, keys_of, ranges, "ngrams", drop)
    width = 4 + 2 * POWERS
    sums = answers.where("block = -1").groupBy("kind").agg(F.array(*(F.sum(F.col("stats")[i]) for i in range(width))).alias("f")).collect()
    figures = {r["kind"]: r["f"] for r in sums}
    model = Model.of([figures.get(n, [0] * width) for n in range(order)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, replies in zip(batch.column("payload"), batch.column("answers"), strict=True):
                yield judge(payload.as_py(), replies.as_py() or [])
                release_memory()

    def judge(payload: bytes, replies: list[dict]) -> pa.RecordBatch:
        block = Block.of(payload, modulus, remainder)
        keys, counts = block.keys(order, bits), []
        for n, (own, count) in enumerate(counted(block, keys)):
            counts.append((own, look_up(own, count, [r for r in replies if r["kind"] == n], ranges)))
        fsa = BackoffAutomaton(block, keys, counts, model)
        del keys, counts
        edges = block.begin[:-1] - np.arange(len(block.begin) - 1)  # of the documents among tokens
        count = fsa.word_count[block.ids[block.is_token]]
        known, base = np.add.reduceat((count > 0).astype(np.int64), edges), np.add.reduceat(model.base(count), edges)
        held = held_out_of(block.doc_ids, modulus, remainder)
        columns = [block.doc_ids, pa.array(held), pa.array(np.diff(block.begin) - 1), pa.array(known), pa.array(np.full(len(held), model.tokens, np.int64)), pa.array(base), pa.array(fsa.run(block, order))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = with_answers(blocks, answers, "kind", "range", "which", "totals")
    return joined.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
