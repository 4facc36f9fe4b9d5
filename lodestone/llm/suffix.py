"""Benchmark decontamination with suffix arrays over the training shards.

Each shard of documents becomes one word sequence; its suffix array orders every
suffix that could match (runs of benchmark words that are long enough).  Every test
suffix is binary-searched in it: the neighbours of its place give its longest
verbatim match and a location.  Test suffixes that start a window and match at
least that many words are affected; the range of the array that begins with the
window gives all its occurrences, and those the documents' spans.

A window is ``width`` consecutive item words; an item of fewer, but not none, is
one window.  Defined results: null or wordless texts have no words, match
nothing and stay; repeated item rows count once per item_id; repeated document
rows are judged each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as schema_type

from .common import BROADCAST_LIMIT, id_and_bytes, materialise, release_memory

#: Text bytes of a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Benchmark text per pass over the documents: its vocabulary and suffixes travel with the tasks.
BENCHMARK_BYTES = BROADCAST_LIMIT // 4

# A-Z become a-z; other ASCII than letters and digits separates words; every non-ASCII byte is part of a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def _room(words: np.ndarray) -> np.ndarray:
    """Words from each place up to the next 0."""
    stops = np.flatnonzero(words == 0)
    at = np.arange(len(words))
    return stops[np.searchsorted(stops, at)] - at if len(stops) else at


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of all words (not of 0), sorted by the up to ``depth`` words from each on, ending at the first 0; the last word must be 0.

    Prefix doubling: a rank is the place of a suffix's group, groups share their first 2^i words.  A round splits
    the groups that still have several members by the ranks 2^i words on; groups that reach their 0 are equal.
    """
    order = np.flatnonzero(words)
    order = order[np.argsort(words[order], kind="stable")]
    rank, room = np.zeros(len(words), np.int64), _room(words)

    def groups(places: np.ndarray, changes: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first of each place's group, members of it); a group takes its first member's base."""
        first = np.flatnonzero(changes)
        size = np.diff(np.r_[first, len(places)])
        rank[places] = np.repeat(base[first], size)
        return first, np.repeat(size, size)

    if not len(order):
        return order
    slot = np.arange(1, len(order) + 1)  # rank 0 stands for the end
    _, size = groups(order, np.r_[True, words[order[1:]] != words[order[:-1]]], slot)
    reach = 1
    open_ = np.flatnonzero(size > 1)
    while len(open_) and reach < depth:
        places = order[open_]
        key = rank[places + reach]
        own = rank[places]
        by = np.lexsort((key, own))
        places, key, own = places[by], key[by], own[by]
        order[open_] = places
        _, size = groups(places, np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])], slot[open_])
        reach *= 2
        open_ = open_[(size > 1) & (room[places] >= reach)]  # a suffix that ends here goes before those that go on
    return order


@dataclass
class Suffixes:
    """The test suffixes of one benchmark part: places in one word sequence, a 0 after each item."""

    vocabulary: dict[bytes, int]
    items: list
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray  # words up to the item's end
    need: np.ndarray  # words of the window that starts it; 0: none does
    item: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.need[self.need > 0].min()) if len(self.need) else 0


def test_suffixes(rows: list[tuple], width: int) -> Suffixes:
    vocabulary: dict[bytes, int] = {}
    items, flat, item = [], [], []
    for item_id, text in rows:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text)]
        if words:
            items.append(item_id)
            item.append(len(words))
            flat += [*words, 0]
    words, sizes = np.array([*flat, 0], np.int32), np.array(item, np.int64)
    start = np.flatnonzero(words)
    length = _room(words)[start]
    size = np.minimum(width, np.repeat(sizes, sizes))
    return Suffixes(vocabulary, items, words, start, length, np.where(length >= size, size, 0), np.repeat(np.arange(len(items)), sizes))


class Shard:
    """Documents as one sequence of benchmark-word ids, with its suffix array; runs shorter than ``least`` words are left out."""

    def __init__(self, documents: list[list[bytes]], test: Suffixes, least: int | None = None):
        get = test.vocabulary.get
        flat: list[int] = []
        self.begin, self.test = [], test
        for words in documents:
            self.begin.append(len(flat))
            flat.extend([get(w, 0) for w in words])
            flat.append(0)  # no match crosses a document's end
        whole = np.array(flat, np.int32)
        self.begin = np.array([*self.begin, len(flat)], np.int64)
        # of the words only the runs that can hold a whole match are kept, with one 0 after each
        stops = np.flatnonzero(whole == 0)
        begins = np.r_[0, stops[:-1] + 1]
        run = stops - begins if len(stops) else np.zeros(0, np.int64)
        kept = run >= max(1, test.shortest if least is None else least)
        size = run[kept] + 1
        self.origin = np.repeat(begins[: len(run)][kept] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.words = whole[self.origin]
        self.array = suffix_array(self.words, int(test.length.max(initial=0)) + 1)

    def _common(self, at: np.ndarray, query: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``at`` share with the test suffixes at ``query``, of which ``known`` are known to be shared."""
        shared, alive, step = known.copy(), np.arange(len(at)), 1
        while len(alive):
            a, b = at[alive] + shared[alive], query[alive] + shared[alive]
            more = np.zeros(len(alive), np.int64)
            going = np.ones(len(alive), bool)
            for k in range(step):
                x, y = self.words[np.minimum(a + k, len(self.words) - 1)], self.test.words[np.minimum(b + k, len(self.test.words) - 1)]
                going &= (x == y) & (x != 0)
                if not going.any():
                    break
                more += going
            shared[alive] += more
            alive = alive[going]
            step = min(64, 2 * step)
        return shared

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, a place in the documents' sequence, its place in the array) of each test suffix's longest match; 0 words: none.

        The borders' shared words are remembered, so a search does not compare them again.
        """
        start, n = self.test.start, len(self.test.start)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.array), np.int64)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            at = self.array[mid]
            shared = self._common(at, start[open_], np.minimum(left[open_], right[open_]))
            better = shared > best[open_]
            best[open_[better]], where[open_[better]] = shared[better], mid[better]
            below = self.words[at + shared] < self.test.words[start[open_] + shared]
            low[open_[below]], left[open_[below]] = mid[below] + 1, shared[below]
            high[open_[~below]], right[open_[~below]] = mid[~below], shared[~below]
            open_ = open_[low[open_] < high[open_]]
        place = np.where(best > 0, self.origin[self.array[where]] if len(self.array) else -1, -1)
        return best, place, where

    def _edge(self, query: np.ndarray, need: np.ndarray, low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
        """Border of the places whose suffixes share ``need`` words with each test suffix; they lie between low and high, at one of its ends."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            inside = self._reaches(self.array[mid], query[open_], need[open_])
            right = inside if upper else ~inside
            low[open_[right]], high[open_[~right]] = mid[right] + 1, mid[~right]
            open_ = open_[low[open_] < high[open_]]
        return low

    def _reaches(self, at: np.ndarray, query: np.ndarray, need: np.ndarray) -> np.ndarray:
        ok = np.ones(len(at), bool)
        for k in range(int(need.max(initial=0))):
            rows = np.flatnonzero(ok & (k < need))
            if not len(rows):
                break
            ok[rows] = self.words[np.minimum(at[rows] + k, len(self.words) - 1)] == self.test.words[query[rows] + k]
        return ok

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(position, words, window) of every occurrence of every distinct window, and each window's items.

        Affected are the test suffixes whose longest match holds their window; equal windows share one range of the array.
        """
        best, _, where = self.longest()
        rows = np.flatnonzero((self.test.need > 0) & (best >= self.test.need))
        query, need, where = self.test.start[rows], self.test.need[rows], where[rows]
        low = self._edge(query, need, np.zeros(len(rows), np.int64), where, False)
        high = self._edge(query, need, where + 1, np.full(len(rows), len(self.array)), True)
        key, window = np.unique(np.stack((low, high, need), 1), axis=0, return_inverse=True)
        window = window.reshape(-1)
        order = np.argsort(window, kind="stable")
        items = np.split(self.test.item[rows][order], np.cumsum(np.bincount(window, minlength=len(key)))[:-1]) if len(key) else []
        n = key[:, 1] - key[:, 0]
        which = np.repeat(np.arange(len(key)), n)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = self.origin[self.array[key[which, 0] + inner]] if len(which) else np.zeros(0, np.int64)
        return at, key[which, 2] if len(which) else at, which, items


_FIELDS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def _search(docs: DataFrame, test: Suffixes) -> DataFrame:
    """(doc_id, n_words, spans, items, and carried if it is there) per document, in one pass without a shuffle."""
    carried = docs.schema.fields[2:]
    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", _FIELDS), T.StructField("items", T.ArrayType(T.StringType())), *carried])
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def judge(ids: list, documents: list[list[bytes]], kind: pa.DataType, rest: list[pa.Array]) -> pa.RecordBatch:
        shard = Shard(documents, test)
        at, size, window, names = shard.windows()
        spans: list[list] = [[] for _ in documents]
        items: list[set] = [set() for _ in documents]
        if len(at):
            doc = np.searchsorted(shard.begin, at, "right") - 1
            for d, i in np.unique(np.stack((doc, window), 1), axis=0).tolist():
                items[d].update(str(test.items[x]) for x in names[i].tolist())
            # union of the hit words, as intervals: +1 at a start, -1 at a stop
            order = np.lexsort((at + size, at, doc))
            doc, start, stop = doc[order], at[order], (at + size)[order]
            top = np.maximum.accumulate(stop)
            fresh = np.r_[True, (start[1:] > top[:-1]) | (doc[1:] != doc[:-1])]
            first = np.flatnonzero(fresh)
            last = np.r_[first[1:] - 1, len(start) - 1]
            for d, a, b in zip(doc[first].tolist(), start[first].tolist(), top[last].tolist(), strict=True):
                spans[d].append({"start": a - int(shard.begin[d]), "stop": b - int(shard.begin[d])})
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([*map(len, documents)], pa.int64()), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *([pa.concat_arrays(rest)] if carried else [])], names=fields.fieldNames())

    return docs.mapInArrow(lambda batches: (judge(*shard) for shard in _shards(batches)), fields)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]], pa.DataType, list[pa.Array]]]:
    """(ids, words, type of the ids, pieces of a third column) of a task's documents, SHARD_BYTES of text at a time."""
    ids, documents, rest, held, kind = [], [], [], 0, pa.int64()
    for batch in batches:
        kind, first = batch.schema.field("doc_id").type, 0
        for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True), 1):
            ids.append(doc_id)
            documents.append(split_words(text))
            held += len(text or b"")
            if held >= SHARD_BYTES:
                yield ids, documents, kind, [*rest, *(c.slice(first, i - first) for c in batch.columns[2:])]
                ids, documents, rest, held, first = [], [], [], 0, i
                release_memory()
        if first < batch.num_rows:
            rest += [c.slice(first) for c in batch.columns[2:]]
    if ids:
        yield ids, documents, kind, rest


def _parts(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> Iterator[tuple[int, Suffixes]]:
    """(number of parts, suffixes of one) of at most BENCHMARK_BYTES text each, fetched one after another."""
    tests = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[text_col].cast("binary").alias("text")).where(F.octet_length("text") > 0)
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // BENCHMARK_BYTES))
    for part in range(parts):
        rows = [(r["item_id"], bytes(r["text"])) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().collect()]
        yield parts, test_suffixes(sorted(rows, key=str), width)


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per document row: doc_id, n_words, spans (disjoint hit word ranges), items (ids as strings, sorted).
    The row's columns named by ``carry`` come along as the struct ``carried``.

    The benchmark travels to the documents in parts of at most BENCHMARK_BYTES text, one pass each, and
    the driver holds one part at a time; only if there is more than one part are documents written, once,
    with a number for each row, by which the parts' findings come together.
    """
    source, found = id_and_bytes(docs, id_col, text_col, carry), None
    for parts, test in _parts(benchmark, item_col, item_text_col, width):
        if parts == 1:
            return _search(source, test)
        if found is None:
            numbered = materialise(source.withColumn("row", F.monotonically_increasing_id()), "rows")
        # one part's findings are written before the next part is fetched; most rows have none
        one = materialise(_search(numbered.select(F.col("row").alias("doc_id"), "text"), test), "part")
        found = one if found is None else found.unionAll(one)
    whole = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = whole.withColumn("spans", merged(F.array_sort("spans"))).withColumnRenamed("doc_id", "row")
    rest = ["carried"] if carry else []
    return numbered.select("row", "doc_id", *rest).join(whole, "row").select("doc_id", "n_words", "spans", "items", *rest)


def merged(spans):
    """Sorted intervals -> disjoint ones."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, empty, add)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and carried where columns are; options as in find_matches."""
    found = find_matches(docs, benchmark, width, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), *(["carried"] if options.get("carry") else []))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, offset, n_words, doc_id, at): for each test suffix with a match of at least ``least`` words its longest
    verbatim match over all shards, and where: document and word number (of equal ones the smallest doc_id, then word).

    One row a suffix and shard is shuffled, by (item_id, offset).
    """
    source, found = id_and_bytes(docs, id_col, text_col), None
    item_type = benchmark.schema[item_col].dataType
    fields = T.StructType([T.StructField("item_id", item_type), T.StructField("offset", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("at", T.LongType())])

    def search(test: Suffixes):
        offset = np.arange(len(test.start)) - np.repeat(np.flatnonzero(np.diff(test.item, prepend=-1)), np.bincount(test.item)) if len(test.item) else np.zeros(0, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, documents, kind, _ in _shards(batches):
                shard = Shard(documents, test, least)
                words, place, _ = shard.longest()
                rows = np.flatnonzero((words >= least) & (place >= 0))
                doc = np.searchsorted(shard.begin, place[rows], "right") - 1
                names = pa.array([test.items[i] for i in test.item[rows].tolist()]).cast(schema_type(item_type)) if len(rows) else pa.array([], schema_type(item_type))
                yield pa.RecordBatch.from_arrays([names, pa.array(offset[rows]), pa.array(words[rows]), pa.array([ids[d] for d in doc.tolist()], kind), pa.array(place[rows] - shard.begin[doc])], names=fields.fieldNames())

        return run

    for parts, test in _parts(benchmark, item_col, item_text_col, 1):
        one = source.mapInArrow(search(test), fields)
        one = materialise(one, "longest") if parts > 1 else one
        found = one if found is None else found.unionAll(one)
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "doc_id", "at")).alias("b")
    return found.groupBy("item_id", "offset").agg(best).select("item_id", "offset", (-F.col("b.less")).alias("n_words"), "b.doc_id", "b.at")
