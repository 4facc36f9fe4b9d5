"""Token-id files: one wavelet matrix per shard, with access, counting and occurrence lookup.

File format.  A shard is one Parquet file with one row; its payload is (little-endian):

    magic "LWM2" | u64 tokens | u64 documents | u8 planes | u64 size of the id block
    | per plane: u64 zeros | per plane and page: u64 end of the page in the file, u64 ones before the page
    | zstd(document ids i64, lengths u32, known u8) | zstd(page bits) ...

Plane p holds bit (planes-1-p) of every id in the order that stable partitioning
by the higher planes leaves, in pages of PAGE_BITS bits, each compressed alone.
The stored directory gives the ones before each page, so a rank, a select or an
access reads one page a plane (a few for select) and nothing else is unpacked.

Texts: null counts as empty, so each document has at least its end id.  Rows
with equal doc_id stand next to each other, by a hash of the text, then the text;
null ids come first.  Ids are integers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, id_and_bytes, release_memory, shared_dir, written

MAGIC = b"LWM2"
#: Text bytes of a shard, before compression: bounds the memory of a task that builds or reads one. A longer document makes a longer shard.
SHARD_BYTES = 24 << 20
#: Bits of a page.
PAGE_BITS = 1 << 18
#: Distinct chunks that one worker remembers.
CACHE_CHUNKS = 1_000_000
#: Distinct words and punctuations of chunks that one worker remembers.
CACHE_PARTS = 600_000


class Planes:
    """Bit planes in memory, as they are built."""

    def __init__(self, ids: np.ndarray, n_planes: int):
        self.n, self.bits, self.zeros = len(ids), [], []
        for p in range(n_planes - 1, -1, -1):
            bit = ((ids >> ids.dtype.type(p)) & ids.dtype.type(1)).astype(bool)
            self.bits.append(np.packbits(bit, bitorder="little"))
            low = ids.compress(~bit)
            self.zeros.append(len(low))
            ids = np.concatenate((low, ids.compress(bit)))


def to_payload(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, n_planes: int) -> bytes:
    z = zstandard.ZstdCompressor(level=1)
    planes = Planes(ids.astype(np.uint16 if n_planes <= 16 else np.uint32, copy=False), n_planes)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    block = z.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + known.tobytes())
    directory, pages, at = [], [], 0
    for bits in planes.bits:
        ones = 0
        for i in range(0, len(bits), PAGE_BITS // 8):
            page = bits[i : i + PAGE_BITS // 8]
            pages.append(z.compress(page.tobytes()))
            at += len(pages[-1])
            directory += [at, ones]
            ones += int(np.bitwise_count(page).sum(dtype=np.int64))
    head = MAGIC + struct.pack("<QQBQ", len(ids), len(doc_ids), n_planes, len(block))
    return b"".join((head, np.array(planes.zeros, "<u8").tobytes(), np.array(directory, "<u8").tobytes(), block, *pages))


class TokenShard:
    """A shard's file: rank, select, access, counting and occurrences on the compressed bytes."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.payload = payload
        self.n, self.n_docs, self.n_planes, size = struct.unpack_from("<QQBQ", payload, 4)
        at = 4 + struct.calcsize("<QQBQ")
        self.zeros = np.frombuffer(payload, "<u8", self.n_planes, at).astype(np.int64).tolist()
        at += 8 * self.n_planes
        self.n_pages = -(-self.n // PAGE_BITS)
        directory = np.frombuffer(payload, "<u8", 2 * self.n_planes * self.n_pages, at).astype(np.int64).reshape(self.n_planes, self.n_pages, 2)
        at += 16 * self.n_planes * self.n_pages
        self._block = (at, size)
        self._stop, self.ones = directory[:, :, 0] + at + size, directory[:, :, 1]
        self._first = at + size
        self._unpacked: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(document ids, lengths)."""
        block = zstandard.ZstdDecompressor().decompress(self.payload[self._block[0] : sum(self._block)])
        ids, lengths, known = np.frombuffer(block, "<i8", self.n_docs), np.frombuffer(block, "<u4", self.n_docs, 8 * self.n_docs), np.frombuffer(block, np.uint8, self.n_docs, 12 * self.n_docs)
        return [x if y else None for x, y in zip(ids.tolist(), known.tolist(), strict=True)], lengths

    def _page(self, p: int, page: int) -> np.ndarray:
        """The bytes of one page, unpacked."""
        flat = p * self.n_pages + page
        stops = self._stop.reshape(-1)
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.payload[self._first if not flat else stops[flat - 1] : stops[flat]]), np.uint8)

    def _counted(self, p: int, page: int) -> tuple[np.ndarray, np.ndarray]:
        """A page and the ones before each of its bytes; the last 64 pages used are kept."""
        found = self._unpacked.pop((p, page), None)
        if found is None:
            bits = self._page(p, page)
            found = bits, np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
            if len(self._unpacked) >= 64:
                self._unpacked.pop(next(iter(self._unpacked)))
        self._unpacked[p, page] = found
        return found

    def _rank1(self, p: int, i: int) -> int:
        """Ones of plane p before position i."""
        if i >= self.n:
            return self.n - self.zeros[p]
        page, inner = divmod(i, PAGE_BITS)
        bits, before = self._counted(p, page)
        return int(self.ones[p, page]) + int(before[inner // 8]) + (int(bits[inner // 8]) & ((1 << inner % 8) - 1)).bit_count()

    def _select(self, p: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) given bit of plane p: its page by the directory, its byte by counts."""
        starts = np.arange(self.n_pages, dtype=np.int64) * PAGE_BITS
        before = self.ones[p] if bit else starts - self.ones[p]
        page = int(np.searchsorted(before, k, "right")) - 1
        bits, ones = self._counted(p, page)
        counts = ones if bit else np.arange(len(ones), dtype=np.int64) * 8 - ones
        byte = int(np.searchsorted(counts, k - int(before[page]), "right")) - 1
        left = k - int(before[page]) - int(counts[byte])
        for at in range(8):
            if (int(bits[byte]) >> at & 1) == bit:
                if not left:
                    return page * PAGE_BITS + byte * 8 + at
                left -= 1
        raise IndexError(k)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.n_planes):
            page, inner = divmod(i, PAGE_BITS)
            bit = int(self._counted(p, page)[0][inner // 8]) >> inner % 8 & 1
            ones = self._rank1(p, i)
            value = value * 2 + bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _bounds(self, value: int, start: int, stop: int) -> tuple[int, int]:
        if value < 0 or value >> self.n_planes:
            return 0, 0
        for p in range(self.n_planes):
            a, b = self._rank1(p, start), self._rank1(p, stop)
            start, stop = (self.zeros[p] + a, self.zeros[p] + b) if value >> (self.n_planes - 1 - p) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of value within [start, stop)."""
        a, b = self._bounds(value, start, self.n if stop is None else stop)
        return b - a

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of value; -1 if there is none."""
        a, b = self._bounds(value, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for p in range(self.n_planes - 1, -1, -1):
            bit = value >> (self.n_planes - 1 - p) & 1
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def occurrences(self, value: int) -> Iterator[int]:
        """Positions of value, ascending."""
        for k in range(self.count(value)):
            yield self.select(value, k)

    def to_array(self) -> np.ndarray:
        """All ids: partitions are undone from the lowest plane up, one scatter a plane."""
        dtype = np.uint16 if self.n_planes <= 16 else np.uint32
        out = np.zeros(self.n, dtype)
        for p in range(self.n_planes - 1, -1, -1):
            bits = np.concatenate([self._page(p, page) for page in range(self.n_pages)]) if self.n_pages else np.zeros(0, np.uint8)
            bit, back = np.unpackbits(bits, count=self.n, bitorder="little").view(bool), np.empty_like(out)
            back[np.flatnonzero(~bit)] = out[: self.zeros[p]]
            back[np.flatnonzero(bit)] = out[self.zeros[p] :] | dtype(1 << (self.n_planes - 1 - p))
            out = back
        return out


#: ASCII characters that a pre-tokenizer of words, digits and other runs joins into one run (no apostrophe).
_RUN = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(s: str) -> bool:
    """Latin letters only: one word for the pre-tokenizer, before and after lower-casing."""
    return s.isalpha() and (s.isascii() or max(s) < "\u0130" or max(s) < "\u0250" and s.lower().isalpha())


class _Ids:
    """Runs of ids by number."""

    def __init__(self) -> None:
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: list[np.ndarray], start: np.ndarray, size: np.ndarray) -> None:
        """More runs, which start at ``start`` within ``ids``."""
        self.start, self.size = np.concatenate((self.start, start + len(self.flat))), np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, *ids))

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """Their ids, end to end."""
        sizes = self.size[numbers]
        stops = np.cumsum(sizes)
        return self.flat.take(np.repeat(self.start[numbers] - (stops - sizes), sizes) + np.arange(int(stops[-1])))


class _Encoder(defaultdict):
    """White-space-free chunk -> number, and per number its ids by the tokenizers library.

    No token of a pre-splitting vocabulary spans ASCII white space, so a text's ids are its chunks'
    ids in order, and each distinct chunk is encoded once a worker.  Chunks of letters, perhaps with
    punctuation after them, have the ids of both parts (checked for each punctuation), and each
    distinct part goes to the library once, in lower case if the vocabulary ignores case.  Parts are
    encoded many at a time, as one text; the end marks of the last tokens tell them apart (and are
    counted, to make sure).  Number 0 stands for the end id.
    """

    #: Parts in one text: the library takes half as long again for a part in texts of 2,000.
    TOGETHER = 100

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for label, i in vocabulary.items() if label.endswith("</w>")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = " ".join(c for c in map(chr, range(0x130)) if c.isalpha())
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str(letters) == letters.lower() and not any(map(str.isalpha, self.added))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.default_factory = count(1).__next__  # numbers follow the order of the chunks
        self.chunks = _Ids()
        self.chunks.add([np.array([self.end_id], np.uint32)], np.zeros(1, np.int64), np.ones(1, np.int64))
        self._forget_parts()

    def _forget_parts(self) -> None:
        self.part_of: defaultdict[str, int] = defaultdict(count().__next__, {})
        self.part_of[""]
        self.parts = _Ids()
        self.parts.add([], np.zeros(1, np.int64), np.zeros(1, np.int64))
        self.apart: dict[str, bool] = {"": True}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stands_apart(self, run: str) -> bool:
        """Is a word with this punctuation after it encoded as the two parts are?"""
        both, word, end = self._ids(["a" + run, "a", run])
        return both.tolist() == [*word.tolist(), *end.tolist()]

    def _learn(self, fresh: list[bytes]) -> None:
        if len(self.part_of) > CACHE_PARTS:
            self._forget_parts()
        part_of, apart, known = self.part_of, self.apart, len(self.part_of)
        text = b"\n".join(fresh).decode("utf-8", "replace")
        chunks = text.split("\n")
        words = [s.rstrip(_RUN) for s in chunks]
        runs = [s[len(word) :] for s, word in zip(chunks, words, strict=True)]
        for run in set(runs).difference(apart):
            apart[run] = self._stands_apart(run)
        alone = {k for k, word in enumerate(words) if word and not (word.isalpha() and (word.isascii() or _plain(word)))}
        if not all(apart.values()):
            alone.update(k for k, run in enumerate(runs) if not apart[run])
        for special in self.added:
            if special in text:
                alone.update(k for k, s in enumerate(chunks) if special in s)
        for k in alone:
            words[k] = runs[k] = ""
        if self.folds:
            words = [word.lower() if word.isascii() or max(word) < "\u0130" else word for word in words]
        words, runs = ([*map(part_of.__getitem__, x)] for x in (words, runs))
        if len(part_of) > known:
            self._learn_parts(list(islice(reversed(part_of), len(part_of) - known))[::-1])
        parts = np.array((words, runs), np.int64).T
        sizes = self.parts.size[parts].sum(axis=1)
        ids, start = [self.parts.take(parts.ravel())], np.cumsum(sizes) - sizes
        at = int(sizes.sum())
        for k, found in zip(alone, self._ids([chunks[k] for k in alone]), strict=True):
            ids.append(found)
            start[k], sizes[k] = at, len(found)
            at += len(found)
        self.chunks.add(ids, start, sizes)

    def _learn_parts(self, texts: list[str]) -> None:
        ids, start, size, held = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        groups = [texts[at : at + self.TOGETHER] for at in range(0, len(texts), self.TOGETHER)]
        for n, found in enumerate(self._ids([" ".join(group) for group in groups])):
            at, group = n * self.TOGETHER, groups[n]
            edges = np.r_[0, np.flatnonzero(self.last[found]) + 1]
            if len(edges) == len(group) + 1:
                start[at : at + len(group)], size[at : at + len(group)] = held + edges[:-1], np.diff(edges)
            else:  # these go one by one
                single = self._ids(group)
                found, sizes = np.concatenate(single), np.array([*map(len, single)], np.int64)
                start[at : at + len(group)], size[at : at + len(group)] = held + np.cumsum(sizes) - sizes, sizes
            ids.append(found)
            held += len(found)
        self.parts.add(ids, start, size)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; ids per text)."""
        if len(self) > CACHE_CHUNKS:
            self.forget()
        parts, known = [], len(self)
        for text in texts:
            chunks = text.split()
            parts.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
        if len(self) > known:
            self._learn(list(islice(reversed(self), len(self) - known))[::-1])
        end = np.zeros(1, np.int64)
        numbers = np.concatenate([x for part in parts for x in (part, end)])
        ids, stops = self.chunks.take(numbers), np.cumsum(self.chunks.size[numbers])
        upto = stops[np.cumsum([len(part) + 1 for part in parts]) - 1]
        return ids, np.diff(upto, prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> _Encoder:
    return _Encoder(path, end_id)


def _groups(texts: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Documents in groups of about ``size`` text bytes."""
    group, n = [], 0
    for doc_id, text in texts:
        group.append((doc_id, text or b""))
        n += len(text or b"")
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def planes_for(vocabulary: str, end_id: int) -> int:
    """Planes that hold every id of a vocabulary file, and the end id."""
    from tokenizers import Tokenizer

    return max(1, max(*Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values(), end_id).bit_length())


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, n_planes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id`` to each document and write one file a shard; returns them as read back:
    (n_tokens, payload, shard), ids ascending over shards.  Planes follow from the vocabulary.

    One range shuffle by doc_id and a hash of the text, so that a repeated or missing id fills no single shard.
    """
    source = id_and_bytes(docs, id_col, text_col)
    spark = docs.sparkSession
    planes = planes_for(vocabulary, end_id) if n_planes is None else n_planes
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    ordered = source.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = 0

        def texts() -> Iterator[tuple]:
            nonlocal shard
            for batch in batches:
                if batch.num_rows:
                    shard = batch.column("shard")[0].as_py()
                yield from zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)

        encoder = _encoder(vocabulary, end_id)
        doc_ids, lengths, parts = [], [], []
        for group in _groups(texts(), 2 << 20):
            ids, sizes = encoder.encode([text for _, text in group])
            if int(ids.max()) >> planes:
                raise ValueError(f"id {int(ids.max())} needs more than {planes} planes")
            doc_ids += [doc_id for doc_id, _ in group]
            lengths += sizes.tolist()
            parts.append(ids.astype(np.uint16 if planes <= 16 else np.uint32))
        if doc_ids:
            payload = to_payload(doc_ids, lengths, np.concatenate(parts), planes)
            yield pa.RecordBatch.from_arrays([pa.array([sum(lengths)], pa.int64()), pa.array([payload], pa.binary()), pa.array([shard], pa.int32())], names=["n_tokens", "payload", "shard"])
            del payload, parts
            release_memory()

    schema = "n_tokens long, payload binary, shard int"
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ordered.mapInArrow(run, schema).write.partitionBy("shard").option("compression", "uncompressed").parquet(path)
    written(spark, path)
    return spark.read.schema(schema).parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """(shard, start): one row a shard, sums over one number a file, payloads unread."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _located(files: DataFrame) -> DataFrame:
    """(start, payload) of each shard; shard starts are broadcast while they are small."""
    starts = shard_starts(files)
    if files.select("shard").distinct().count() * 16 <= BROADCAST_LIMIT:
        starts = F.broadcast(starts)
    return files.join(starts, "shard").select("start", "payload")


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                shard = TokenShard(payload.as_py())
                doc_ids, lengths = shard.documents()
                stops = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(shard.to_array().astype("<u4").tobytes())
                edges = [0, *(4 * stops).tolist()]
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                out = [pa.array(doc_ids, pa.int64()), pa.array(start + stops - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                del raw, shard
                release_memory()

    return _located(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_count(files: DataFrame, token: int) -> DataFrame:
    """Occurrences of one id in each shard, from two rank queries a plane: (shard, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [TokenShard(p.as_py()).count(token) for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(n, pa.int64())], names=["shard", "n"])

    return files.select("shard", "payload").mapInArrow(run, "shard int, n long")


def token_occurrences(files: DataFrame, token: int) -> DataFrame:
    """(position) of every occurrence of one id in the corpus, by select queries, 10,000 a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                where = TokenShard(payload.as_py()).occurrences(token)
                while some := list(islice(where, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([start + x for x in some], pa.int64())], names=["position"])

    return _located(files).mapInArrow(run, "position long")


def tokens_at(files: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) of corpus positions, by access queries; positions beyond the corpus, and null, are left out.

    Positions meet their shards by a join of ranges of shard numbers, so files without a position are not unpacked.
    """
    starts = shard_starts(files).withColumn("stop", F.lead("start").over(Window.orderBy("shard")))
    total = files.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    bounds = F.broadcast(starts) if files.select("shard").distinct().count() * 24 <= BROADCAST_LIMIT else starts
    asked = positions.select(F.col(positions.columns[0]).cast("long").alias("position")).where(F.col("position").between(0, total - 1)).distinct()
    asked = asked.join(bounds, (F.col("position") >= F.col("start")) & (F.col("position") < F.coalesce("stop", F.lit(total))))
    per = asked.select("shard", (F.col("position") - F.col("start")).alias("at"), "start")
    per = per.groupBy("shard", "start", F.floor(F.col("at") / (4 * PAGE_BITS)).alias("part")).agg(F.array_sort(F.collect_list("at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, at, payload in zip(batch.column("start").to_pylist(), batch.column("at").to_pylist(), batch.column("payload"), strict=True):
                shard = TokenShard(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([start + x for x in at], pa.int64()), pa.array([shard.access(x) for x in at], pa.int64())], names=["position", "token"])

    return files.select("shard", "payload").join(per, "shard").select("start", "at", "payload").mapInArrow(run, "position long, token long")
