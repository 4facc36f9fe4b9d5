"""Documents packed into blocks, and exact totals of hashed keys over all blocks.

Corpus-wide counting without a row per word: documents are packed once into
blocks of bounded text size (a table bucketed by block, so later joins move only
the small side).  A block reports its distinct 64-bit keys with local counts as
sorted, delta-coded runs, one per key range; each range sums them and answers a
block only where the total differs from the block's own count.  A key that
stands in one block only costs one delta and no answer, and a hot key costs one
entry per block, however often it occurs.  Reports are one row a block and range,
so their number grows as blocks x ranges, as the segments of any shuffle do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, materialise, release_memory, shared_dir, written

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Text bytes per key range: keeps a range's keys, of all blocks together, in memory.
RANGE_BYTES = 16 << 20
#: Text bytes per bucket of the block table: what a task reads, whatever the input's size.
BUCKET_BYTES = 32 << 20


class Ids(dict):
    """Words -> consecutive ids, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


def seal_texts(doc_ids: list, texts: list[bytes], kind: pa.DataType, carried: pa.Array | None = None) -> bytes:
    """Rows in order of (doc_id, text), null ids first, as a compressed Arrow stream."""
    order = sorted(range(len(doc_ids)), key=lambda i: ((doc_ids[i] is not None, doc_ids[i]) if doc_ids[i] is not None else (False, 0), texts[i]))
    columns = {"doc_id": pa.array([doc_ids[i] for i in order], kind), "text": pa.array([texts[i] for i in order], pa.large_binary())}
    if carried is not None:
        columns["carried"] = carried.take(pa.array(order, pa.int64()))
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


#: Of a block's ids, texts, id type and carried rows: its payload.
Seal = Callable[[list, list[bytes], pa.DataType, pa.Array | None], bytes]


def unseal(payload: bytes) -> tuple[pa.Array, list[bytes]]:
    batch = pa.ipc.open_stream(payload).read_next_batch()
    return batch.column("doc_id"), batch.column("text").to_pylist()


def unseal_carried(payload: bytes) -> pa.Array:
    return pa.ipc.open_stream(payload).read_next_batch().column("carried")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: Sequence[str] = (), seal: Seal = seal_texts) -> DataFrame:
    """(block, n_bytes, payload), written once to the shared folder as a table bucketed by block. No shuffle; null text is empty.

    The columns named by ``carry`` travel with their rows, as one struct.  ``seal`` makes a block's payload.
    """
    source = id_and_bytes(docs, id_col, text_col, carry)
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, doc_ids, texts, carried, held, kind = 0, 0, [], [], [], 0, pa.int64()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + seq], pa.int64()), pa.array([held], pa.int64()), pa.array([seal(doc_ids, texts, kind, pa.concat_arrays(carried) if carry else None)], pa.binary())], names=["block", "n_bytes", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = batch.column("part")[0].as_py(), batch.schema.field("doc_id").type
            first = 0  # of the batch's rows in this block
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True), 1):
                doc_ids.append(doc_id)
                texts.append(text or b"")
                held += len(text or b"") + 8
                if held >= block_bytes:
                    if carry:
                        carried.append(batch.column("carried").slice(first, i - first))
                    yield flush()
                    first, seq, doc_ids, texts, carried, held = i, seq + 1, [], [], [], 0
                    release_memory()
            if carry and first < batch.num_rows:
                carried.append(batch.column("carried").slice(first))
        if doc_ids:
            yield flush()

    packed = source.withColumn("part", F.spark_partition_id()).mapInArrow(run, "block long, n_bytes long, payload binary")
    name = f"lodestone_blocks_{uuid.uuid4().hex}"
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    path = f"{shared_dir(spark)}/{name}"
    packed.write.bucketBy(min(buckets, 100_000), "block").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    written(spark, path, name)
    return spark.table(name)


def partitions(blocks: DataFrame) -> int:
    """Of a shuffle of what blocks report: so many that a task's share does not grow with the text."""
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * BUCKET_BYTES)))


def key_ranges(blocks: DataFrame) -> int:
    """Number of key ranges, a power of two that grows with the text."""
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    least = 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(least - 1, size // RANGE_BYTES).bit_length()


def compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, so that the empty high bytes vanish."""
    return compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes())


def unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def squeeze_sorted(keys: np.ndarray, drop: int = 0) -> bytes:
    """Sorted keys as deltas; ``drop`` low bits, which are 0 in all of them, are left out."""
    return squeeze(np.diff(keys >> keys.dtype.type(drop), prepend=np.zeros(1, keys.dtype)))


def unsqueeze_sorted(data: bytes, dtype: type = np.uint64, drop: int = 0) -> np.ndarray:
    return np.cumsum(unsqueeze(data, dtype), dtype=dtype) << dtype(drop)


#: Of a block's payload: one (distinct sorted keys, counts) per kind of key.
KeyFn = Callable[[bytes], list[tuple[np.ndarray, np.ndarray]]]
#: A range's figures: distinct keys, total, keys of total 1 and 2 (keys of total 0 don't count), then keys and their total per power of two.
POWERS = 48


def _figures(total: np.ndarray) -> list[int]:
    power = np.log2(np.maximum(total, 1)).astype(np.int64)
    seen = total > 0
    by_power = np.bincount(power[seen], minlength=POWERS), np.bincount(power[seen], total[seen], POWERS).astype(np.int64)
    return [int(seen.sum()), int(total.sum()), int((total == 1).sum()), int((total == 2).sum()), *by_power[0].tolist(), *by_power[1].tolist()]


def totals(blocks: DataFrame, keys_of: KeyFn, ranges: int, name: str, drop: Sequence[int] = ()) -> DataFrame:
    """(block, kind, range, which, totals, stats): answers per block and range, and per range one row with block = -1
    whose stats are the range's figures.  Written to the shared folder.  ``drop`` says per kind how many low bits of its keys are 0.

    An answer marks which of the block's keys in the range it is about, a bit a key, so keys travel one way only.
    """
    drop = [*drop, *[0] * 8]
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = []
                for kind, (keys, counts) in enumerate(keys_of(payload.as_py())):
                    edges = np.flatnonzero(np.diff(keys >> shift)) + 1
                    edges = [0, *edges.tolist(), len(keys)]
                    for a, b in zip(edges, edges[1:], strict=False):
                        if a < b:
                            rows.append((kind * ranges + int(keys[a] >> shift), block, squeeze_sorted(keys[a:b], drop[kind]), squeeze(counts[a:b].astype(np.uint32))))
                cols = [*zip(*rows, strict=True)] or [()] * 4
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["range", "block", "keys", "counts"])
                release_memory()

    def answer(group: pa.Table) -> pa.Table:
        owner = group["block"].to_pylist()
        kind = group["range"][0].as_py() // ranges
        keys = [unsqueeze_sorted(x.as_py(), drop=drop[kind]) for x in group["keys"]]
        counts = [unsqueeze(x.as_py(), np.uint32) for x in group["counts"]]
        key, own = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        total = np.add.reduceat(own[order], first)
        spread = np.empty(len(key), np.int64)
        spread[order] = np.repeat(total, np.diff(np.r_[first, len(key)]))
        part = group["range"][0].as_py() % ranges
        rows, at = [(-1, kind, part, None, None, _figures(total))], 0
        for block, k in zip(owner, keys, strict=True):
            piece = slice(at, at + len(k))
            at += len(k)
            differs = spread[piece] != own[piece]
            if differs.any():
                rows.append((block, kind, part, compress(np.packbits(differs).tobytes()), squeeze(spread[piece][differs].astype(np.uint64)), None))
        cols = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "kind", "range", "which", "totals", "stats"])

    reports = blocks.select("block", "payload").mapInArrow(report, "range int, block long, keys binary, counts binary")
    found = reports.repartition(partitions(blocks), "range").groupBy("range").applyInArrow(answer, "block long, kind int, range int, which binary, totals binary, stats array<long>")
    return materialise(found, name)


def with_answers(blocks: DataFrame, answers: DataFrame, *columns: str) -> DataFrame:
    """(block, payload, answers): each block with its answers; only the answers are shuffled."""
    own = answers.where(F.col("block") >= 0).groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("answers"))
    return blocks.select("block", "payload").join(own, "block", "left")


def look_up(keys: np.ndarray, counts: np.ndarray, replies: list[dict], ranges: int) -> np.ndarray:
    """Totals of a block's own sorted keys of one kind: the answer where there is one, else the local count."""
    out = counts.astype(np.int64)
    for r in replies:
        at, total = about(keys, r, ranges)
        out[at] = total
    return out


def about(keys: np.ndarray, reply: dict, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(places among a block's sorted keys, totals) of an answer."""
    first = int(np.searchsorted(keys, np.uint64(reply["range"]) << np.uint64(64 - ranges.bit_length() + 1)))
    which = np.unpackbits(np.frombuffer(decompress(reply["which"]), np.uint8))
    return first + np.flatnonzero(which), unsqueeze(reply["totals"], np.uint64).astype(np.int64)
