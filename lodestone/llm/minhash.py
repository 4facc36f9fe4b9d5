"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles.  Its sketch has BANDS x ROWS
coordinates that fill in rounds: in round i each element is hashed to one
coordinate and to a value in [i, i+1), and each coordinate keeps its minimum;
after as many rounds as coordinates, round i looks at coordinate i alone, so
every coordinate fills.  Equal coordinates estimate the Jaccard similarity with
Chernoff-like concentration.  Bands of equal coordinates give candidates.

Links are decided on full sets:

1. documents with equal sets are one class, at once linked (copies are never paired): equal sizes and equal sums, over the
   whole sets, of two digests made from independent 64-bit hashes of the words;
2. class representatives that share a band hang on the band's smallest member; the
   connected parts of these stars are candidate clusters;
3. a cluster is cut by set size (linked sets differ by less than the threshold's
   ratio, so neighbouring size classes suffice);
4. within a group, sets meet over an inverted index, one document at a time, until
   all pairs not yet connected have been compared;
5. no task holds an unbounded group: a large one is cut into parts, and the same few
   leaders join every part. Around a common text that connects nearly all of it, and
   what is left outside the group's largest component then meets every part;
6. verified links and classes give connected components.

A pair at the threshold shares no band with probability (1 - 0.8^5)^32 = 3e-6.

Defined results: null or wordless texts have an empty set and link to nothing;
a text with fewer words than a shingle is one shingle; repeated rows of a
document fall into one class; rows with a null id come out with a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Ids
from .common import BROADCAST_LIMIT, broadcast_if_small, id_and_bytes, lower_ascii, materialise, mix64, release_memory
from .components import connected_components

BANDS, ROWS = 32, 5
#: Documents, and set elements, of a part; leaders that join every part of a large group.
GROUP_DOCS, GROUP_ELEMENTS, LEADERS = 3_000, 3_000_000, 48
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _second_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0x10DE)


def shingle_ids(words: list[bytes], ids: Ids, size: int) -> np.ndarray:
    """One row of word ids per shingle; -1 pads a text shorter than a shingle."""
    flat = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    if len(flat) < size:
        return np.concatenate((flat, np.full(size - len(flat), -1))).reshape(1, size) if len(flat) else np.zeros((0, size), np.int64)
    return np.lib.stride_tricks.sliding_window_view(flat, size)


def sketch(elements: np.ndarray, begin: np.ndarray, t: int) -> np.ndarray:
    """(documents, t) fast similarity sketches of hashed sets; set d is elements[begin[d]:begin[d+1]], not empty."""
    n = len(begin) - 1
    out = np.full((n, t), _FULL, np.uint64)
    flat = out.reshape(-1)
    sizes = np.diff(begin)
    x, owner = elements, np.repeat(np.arange(n), sizes)
    bits = np.uint64(40)
    low = np.uint64((1 << 40) - 1)
    for i in range(2 * t):
        h = mix64(x + np.uint64((i + 1) * int(_STEP) & int(_FULL)))
        place = (h >> bits) % np.uint64(t) if i < t else np.full(len(x), i - t, np.uint64)
        np.minimum.at(flat, owner * t + place.astype(np.int64), (np.uint64(i) << bits) | (h & low))
        active = (out == _FULL).any(1)
        if not active.any():
            break
        keep = active[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sketches), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        h = mix64(h * _STEP + sketches[:, r::rows][:, :bands])
    return h


def features(docs: DataFrame, shingle: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): set_a and set_b are 128 bits of the set; bands is empty where no different set can link."""
    least = math.ceil(threshold / (100 - threshold)) if threshold < 100 else 1 << 62
    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def judge(doc_ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        ids, rows_ = Ids(), []
        for text in texts:
            rows_.append(shingle_ids(lower_ascii(text or b"").split(), ids, shingle))
        words = [np.r_[mix64(h), np.uint64(0x51ED)] for h in (ids.hashes(), np.fromiter(map(_second_hash, ids), np.uint64, len(ids)))]  # the last stands for -1
        sizes, sets, a, b = np.zeros(len(rows_), np.int64), [], np.zeros(len(rows_), np.uint64), np.zeros(len(rows_), np.uint64)
        for i, r in enumerate(rows_):
            g, h = np.full(len(r), shingle, np.uint64), np.full(len(r), shingle, np.uint64)
            for c in range(shingle):
                g, h = mix64(g * _STEP + words[0][r[:, c]]), mix64(h * _STEP + words[1][r[:, c]])
            distinct, at = np.unique(g, return_index=True)
            sets.append(distinct)
            sizes[i], a[i], b[i] = len(distinct), mix64(distinct).sum(dtype=np.uint64), mix64(h[at]).sum(dtype=np.uint64)
        big = np.flatnonzero(sizes >= max(least, 1))
        keys: list = [[]] * len(texts)
        if len(big):
            found = band_keys(sketch(np.concatenate([sets[i] for i in big]), np.r_[0, np.cumsum(sizes[big])], bands * rows), bands, rows).view(np.int64)
            for i, k in zip(big.tolist(), found, strict=True):
                keys[i] = k
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=fields.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                piece = batch.slice(at, 2_000)
                yield judge(piece.column("doc_id"), piece.column("text").to_pylist())
                release_memory()

    return docs.mapInArrow(run, fields)


def link_group(texts: list[bytes], shingle: int, threshold: int) -> np.ndarray:
    """For each text the first one (by position) of its component under exact links within the group."""
    ids, n = Ids(), len(texts)
    rows = [shingle_ids(lower_ascii(t).split(), ids, shingle) for t in texts]
    sizes = np.zeros(n, np.int64)
    flat = np.concatenate(rows)
    code = flat[:, 0] + 1
    for c in range(1, shingle):  # exact: codes are ranks of distinct prefixes, so they never overflow
        _, code = np.unique(code, return_inverse=True)
        code = code * (len(ids) + 1) + flat[:, c] + 1
    _, code = np.unique(code, return_inverse=True)
    edges = np.r_[0, np.cumsum([*map(len, rows)])]
    sets = []
    for i in range(n):
        sets.append(np.unique(code[edges[i] : edges[i + 1]]))
        sizes[i] = len(sets[i])
    element, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    first = np.searchsorted(element, np.arange(int(element[-1]) + 2)) if len(element) else np.zeros(1, np.int64)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    # Once every document outside the largest component has met all others, no unconnected pair is left to compare.
    done = np.zeros(n, bool)
    while True:
        label = np.array([root(i) for i in range(n)])
        count = np.bincount(label, minlength=n)
        rest = np.flatnonzero(~done & (label != count.argmax()))
        todo = rest[:64] if done.any() else np.zeros(1, np.int64)
        if not len(todo):
            return label
        for i in todo.tolist():
            done[i] = True
            s = sets[i]
            lengths = first[s + 1] - first[s]
            at = np.repeat(first[s] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            common = np.bincount(owner[at], minlength=n)
            for j in np.flatnonzero(100 * common >= threshold * (sizes[i] + sizes - common)).tolist():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)


def _spots(members: DataFrame, threshold: int) -> DataFrame:
    """(id, cluster, c, n, parts): the groups (cluster, size class) in which a representative meets those it may link to.

    A document stands in its own size class and the next one; a group counts if it owns a member. Groups beyond
    GROUP_DOCS documents or GROUP_ELEMENTS set elements have several parts. Works on ids and sizes alone.
    """
    ratio = math.log(100 / threshold) if threshold < 100 else 1e9
    own = members.withColumn("c", F.floor(F.log("n_shingles") / F.lit(ratio) + 1e-9).cast("int"))
    both = F.array(F.struct(F.col("c").alias("c"), F.lit(1).alias("own")), F.struct((F.col("c") + 1).alias("c"), F.lit(0).alias("own")))
    spots = own.select("id", "n_shingles", "cluster", F.explode(both).alias("s")).select("id", "n_shingles", "cluster", "s.*")
    parts = F.ceil(F.greatest(F.col("n") / GROUP_DOCS, F.col("elements") / GROUP_ELEMENTS)).cast("int")
    groups = spots.groupBy("cluster", "c").agg(F.count("*").alias("n"), F.sum("own").alias("owned"), F.sum("n_shingles").alias("elements")).where("owned > 0 and n > 1")
    groups = materialise(groups.select("cluster", "c", parts.alias("parts")), "groups")  # combined before their shuffle: a row a task and group
    return spots.join(broadcast_if_small(groups, 40), ["cluster", "c"]).select("id", "cluster", "c", "parts")


def _first_keys(spots: DataFrame) -> DataFrame:
    """(id, cluster, c, lo, hi) of the first meeting: whole small groups, and each part of a large one together with the group's leaders."""
    keys = spots.select("id", "cluster", "c", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("lo"), F.lit(-1).alias("hi"))
    place = F.row_number().over(Window.partitionBy("cluster", "c").orderBy(F.xxhash64("id", F.lit(7)), "id"))
    leaders = spots.where("parts > 1").withColumn("i", place).where(F.col("i") <= LEADERS)
    leaders = leaders.select("id", "cluster", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lo"), F.lit(-1).alias("hi"))
    return keys.unionByName(leaders).distinct()


def _rest_keys(spots: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, cluster, c, lo, hi) of the second meeting: in large groups, what is outside the largest component against every part."""
    hot = spots.where("parts > 1").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    counts = hot.groupBy("cluster", "c", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("cluster", "c").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("n"))
    slots = F.ceil(2 * (F.col("n") - F.col("m.k")) / GROUP_DOCS).cast("int")
    main = materialise(main.select("cluster", "c", F.col("m.label").alias("main"), slots.alias("slots")), "main")
    hot = hot.join(broadcast_if_small(main, 48), ["cluster", "c"]).where("slots > 0")
    every = hot.withColumn("parts", 2 * F.col("parts")).withColumn("sub", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    all_ = every.select("id", "cluster", "c", "sub", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    rest = every.where("label <> main").select("id", "cluster", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub"), F.pmod(F.xxhash64("id", F.lit(3)), "slots").cast("int").alias("slot"))
    return all_.unionByName(rest).select("id", "cluster", "c", F.col("slot").alias("lo"), F.col("sub").alias("hi")).distinct()


def _links(source: DataFrame, keys: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """(a, b): links that connect each group's components; texts travel once a group they stand in."""
    id_type = source.schema["doc_id"].dataType.simpleString()
    gathered = materialise(keys.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("cluster", "c", "lo", "hi")).alias("groups")), "keys")
    if (gathered.agg(F.sum(F.size("groups") * 40 + 40)).first()[0] or 0) <= BROADCAST_LIMIT:
        gathered = F.broadcast(gathered)  # else both sides are shuffled, texts too
    texts = source.join(gathered, "doc_id").select("doc_id", "text", F.explode("groups").alias("g")).select("doc_id", "text", "g.*")

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        ids = group["doc_id"].combine_chunks()
        label = link_group(group["text"].to_pylist(), shingle, threshold)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.table([ids.take(pa.array(label[at])), ids.take(pa.array(at))], names=["a", "b"])

    return materialise(texts.groupBy("cluster", "c", "lo", "hi").applyInArrow(link, f"a {id_type}, b {id_type}"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept.

    ``threshold`` is in per cent of the union; shuffled are band keys, ids, and the texts of candidates.
    """
    source = id_and_bytes(docs, id_col, text_col)
    feats = materialise(features(source, shingle, threshold, bands, rows), "features")
    same = ["n_shingles", "set_a", "set_b"]
    classes = feats.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialise(classes, "classes")
    spread = classes.select("id", F.explode("bands").alias("band"))
    leaders = spread.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    stars = spread.join(leaders, "band").where("id != leader").select("leader", "id")
    clusters = connected_components(stars)
    members = clusters.select("id", F.col("component").alias("cluster")).join(classes.select("id", "n_shingles"), "id")
    spots = materialise(_spots(members, threshold), "spots")
    links = _links(source, _first_keys(spots), shingle, threshold)
    linked = connected_components(links)
    if not spots.where("parts > 1").isEmpty():
        rest = materialise(_rest_keys(spots, linked), "rest")
        if not rest.isEmpty():
            linked = connected_components(links.unionByName(_links(source, rest, shingle, threshold)))
    final = classes.drop("bands").join(linked, "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    out = feats.drop("bands").join(final, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
