"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words.  Its minimiser is the smallest hash among
the runs of ``m`` words in it; consecutive windows that share a minimiser form a
super-k-mer and travel as one packed string to the minimiser's bucket, where
sorting brings equal windows together and the words themselves decide.

Before that, each block of documents settles repeats within itself, and asks
which of its minimisers stand in other blocks too: only super-k-mers of those
are sent, and each distinct window at most once a block.  So a passage that
stands in a third of all documents costs its bucket one row per block.

Order: smaller doc_id first, then earlier start; null ids come first, rows with
equal ids stand one after the other (by block, then text).  Defined results:
null text has no words; texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, Ids, about, compress, decompress, key_ranges, pack, partitions, squeeze, squeeze_sorted, totals, unseal, unseal_carried, unsqueeze, unsqueeze_sorted, with_answers
from .common import materialise, mix64, packed, release_memory

WINDOW, MINIMISER = 20, 10
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` values, by doubling."""
    out, have, want = None, 0, size
    power, length = h, 1
    while want:
        if want & 1:
            # runs of `have` followed by runs of `length`
            out = power if out is None else out[: len(out) - length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[have:]
            have += length
        want >>= 1
        if want:
            power = power[: len(power) - length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length:]
            length *= 2
    return mix64(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    length = 1
    while 2 * length <= size:
        x = np.minimum(x[: len(x) - length], x[length:])
        length *= 2
    rest = size - length
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Words:
    """Texts as one id sequence, with every window that lies within one text."""

    texts: list[list[bytes]]
    ids: np.ndarray
    begin: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # positions of windows, ascending

    @classmethod
    def of(cls, texts: list[list[bytes]], k: int) -> Words:
        vocabulary = Ids()
        parts = [np.fromiter(map(vocabulary.__getitem__, t), np.int32, len(t)) for t in texts]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lengths = np.array([*map(len, texts)], np.int64)
        begin = np.r_[0, np.cumsum(lengths)]
        n = np.maximum(lengths - k + 1, 0)
        starts = np.repeat(begin[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hashes = vocabulary.hashes()[ids] if len(ids) else np.zeros(0, np.uint64)
        return cls(texts, ids, begin, hashes, starts)

    def minimisers(self, k: int, m: int) -> np.ndarray:
        """Of each window."""
        return sliding_min(run_hashes(self.hashes, m), k - m + 1)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def repeats(self, k: int, rank: np.ndarray | None = None) -> np.ndarray:
        """For each window: does an equal one come before it (by ``rank``, else by position)?

        Windows are sorted by hash, then compared word by word with the first of their group;
        a window that only shares the hash is settled by its words in a dictionary.
        """
        out = np.zeros(len(self.starts), bool)
        if not len(out):
            return out
        h = run_hashes(self.hashes, k)[self.starts]
        order = np.argsort(h, kind="stable") if rank is None else np.lexsort((rank, h))
        h = h[order]
        new = np.r_[True, h[1:] != h[:-1]]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        later = np.flatnonzero(~new)
        step = np.arange(k)
        for i in range(0, len(later), 200_000):
            pick = later[i : i + 200_000]
            at, first = order[pick], head[pick]
            same = (self.ids[self.starts[at][:, None] + step] == self.ids[self.starts[first][:, None] + step]).all(1)
            out[at[same]] = True
            seen: set[bytes] = set()
            for j in at[~same].tolist():  # in order, so the first of each stays
                word = self.ids[self.starts[j] : self.starts[j] + k].tobytes()
                out[j] = word in seen
                seen.add(word)
        return out


def super_kmers(minimisers: np.ndarray, starts: np.ndarray, send: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first window, windows) of each maximal run of sent windows that follow each other and share their minimiser."""
    at = np.flatnonzero(send)
    if not len(at):
        return at, at
    new = np.r_[True, (starts[at[1:]] != starts[at[:-1]] + 1) | (minimisers[at[1:]] != minimisers[at[:-1]])]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.r_[first, len(at)])


def repeated_windows(blocks: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(block, places): which windows of a block (by number) also start earlier in another block."""
    ranges = key_ranges(blocks)
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def keys_of(payload: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        texts = unseal(payload)[1]
        keys = np.unique(Words.of([t.split() for t in texts], k).minimisers(k, m))
        return [(keys, np.ones(len(keys), np.int64))]

    shared = totals(blocks, keys_of, ranges, "minimisers")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, replies in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("answers"), strict=True):
                if replies.as_py():
                    yield from parcels(block, payload.as_py(), replies.as_py())
                    release_memory()

    def parcels(block: int, payload: bytes, replies: list[dict]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts = unseal(payload)
        words = Words.of([t.split() for t in texts], k)
        minimisers = words.minimisers(k, m)
        keys = np.unique(minimisers)
        wanted = keys[np.concatenate([about(keys, r, ranges)[0] for r in replies])]
        first, count = super_kmers(minimisers, words.starts, np.isin(minimisers, wanted) & ~words.repeats(k))
        if not len(first):
            return
        order = np.argsort(minimisers[first], kind="stable")
        first, count = first[order], count[order]
        bucket = (minimisers[first] >> shift).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(first)]
        doc = np.searchsorted(words.begin, words.starts[first], "right") - 1
        known = np.array([x is not None for x in doc_ids.to_pylist()], bool)
        numbers = np.array([x or 0 for x in doc_ids.to_pylist()], np.int64)
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            strings = []
            for d, s, c in zip(doc[a:b].tolist(), words.starts[first[a:b]].tolist(), count[a:b].tolist(), strict=True):
                at = s - int(words.begin[d])
                strings.append(b" ".join(words.texts[d][at : at + c + k - 1]))
            rows.append((int(bucket[a]), block, squeeze(numbers[doc[a:b]]), squeeze(known[doc[a:b]].astype(np.uint8)), squeeze(first[a:b].astype(np.uint64)), squeeze(count[a:b].astype(np.uint32)), compress(b"\n".join(strings))))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "docs", "known", "first", "count", "strings"])

    def compare(group: pa.Table) -> pa.Table:
        owner, docs, known, first, count, strings = [], [], [], [], [], []
        for r in group.to_pylist():
            n = unsqueeze(r["count"], np.uint32).astype(np.int64)
            owner.append(np.full(len(n), r["block"], np.int64))
            docs.append(unsqueeze(r["docs"], np.int64))
            known.append(unsqueeze(r["known"], np.uint8))
            first.append(unsqueeze(r["first"], np.uint64).astype(np.int64))
            count.append(n)
            strings += decompress(r["strings"]).split(b"\n")
        owner, docs, known, first, count = map(np.concatenate, (owner, docs, known, first, count))
        words = Words.of([s.split(b" ") for s in strings], k)
        which = np.repeat(np.arange(len(count)), count)
        place = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((place, owner[which], docs[which], known[which]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        again = words.repeats(k, rank)
        rows = [(int(b), squeeze_sorted(np.sort(place[again & (owner[which] == b)]).astype(np.uint64))) for b in np.unique(owner[which][again])]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "places"])

    sent = with_answers(blocks, shared, "range", "which", "totals").mapInArrow(send, "bucket int, block long, docs binary, known binary, first binary, count binary, strings binary")
    return materialise(sent.repartition(partitions(blocks), "bucket").groupBy("bucket").applyInArrow(compare, "block long, places binary"), "windows")


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text", keep: str = "text", block_bytes: int = BLOCK_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, and what is left: ``keep='text'`` gives kept_text (the text
    itself where nothing was removed, else the kept words joined by one space), ``keep='digest'`` kept_sha256 of the joined words.
    The row's columns named by ``carry`` come along as the struct ``carried``.
    """
    blocks = pack(docs, id_col, text_col, block_bytes, carry)
    found = repeated_windows(blocks, k, m)
    last = "kept_text" if keep == "text" else "kept_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, replies in zip(batch.column("payload"), batch.column("answers"), strict=True):
                yield cut(payload.as_py(), replies.as_py() or [])
                release_memory()

    def cut(payload: bytes, replies: list[dict]) -> pa.RecordBatch:
        doc_ids, texts = unseal(payload)
        words = Words.of([t.split() for t in texts], k)
        again = words.repeats(k)
        for r in replies:
            again[unsqueeze_sorted(r["places"]).astype(np.int64)] = True
        delta = np.zeros(len(words.ids) + 1, np.int32)
        at = words.starts[again]
        np.add.at(delta, at, 1)
        np.subtract.at(delta, at + k, 1)
        gone = np.cumsum(delta)[:-1] > 0
        before = np.r_[0, np.cumsum(gone)]
        removed = before[words.begin[1:]] - before[words.begin[:-1]]
        left = []
        for text, own, a, n in zip(texts, words.texts, words.begin[:-1].tolist(), removed.tolist(), strict=True):
            if n:
                own = [w for w, x in zip(own, gone[a : a + len(own)].tolist(), strict=True) if not x]
            left.append(hashlib.sha256(b" ".join(own)).hexdigest() if keep != "text" else (b" ".join(own) if n else text).decode("utf-8", "replace"))
        columns = {"doc_id": doc_ids, "n_words": pa.array(np.diff(words.begin)), "n_removed": pa.array(removed.astype(np.int64)), last: pa.array(left, pa.string())}
        return pa.RecordBatch.from_pydict(columns | ({"carried": unseal_carried(payload)} if carry else {}))

    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())]
    fields += docs.select(packed(carry)).schema.fields if carry else []
    return with_answers(blocks, found, "places").mapInArrow(run, T.StructType(fields))
