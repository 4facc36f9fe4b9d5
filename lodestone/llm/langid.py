"""Language ID with a byte convolutional network, trained in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over
a fixed-length window and classified by a softmax layer.  A text is cut into
consecutive windows (all of it, the last one padded); its score per language
is the windows' mean probability, weighted by their bytes.

Defined results: null text, or one without a letter (`\\p{L}`, in training and prediction alike), gives `und` with score 0;
with no labelled row to learn from every text is `und`.  Rows are judged one by
one, so repeated rows get the same result, and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_bytes, release_memory

UNKNOWN = "und"
#: Bytes of a window.
WINDOW = 192
#: Bounds of the training sample, which the driver holds: windows per language, windows in all (beyond it each language
#: gives an equal share, so none is left out), and languages (the most frequent; a label column with more is taken for broken).
TRAIN_WINDOWS, TRAIN_TOTAL, TRAIN_LANGUAGES = 2_000, 400_000, 4_096
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)


class ByteConvNet:
    """Embedding -> filters of widths 2, 3, 4 -> max pooling -> softmax."""

    WIDTHS = ((2, 12), (3, 16), (4, 20))
    DIM = 8

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.span = labels, max(w for w, _ in self.WIDTHS)
        n = sum(f for _, f in self.WIDTHS)
        self.emb = rng.normal(0, 0.5, (256, self.DIM)).astype(np.float32)
        self.emb[0] = 0
        # one matrix for all widths: a narrower filter is zero beyond its width, and stays so
        self.mask = np.zeros((self.span * self.DIM, n), np.float32)
        at = 0
        for width, filters in self.WIDTHS:
            self.mask[: width * self.DIM, at : at + filters] = 1
            at += filters
        self.conv = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, span*dim): the embedded bytes under each filter position."""
        flat = self.emb[windows].reshape(len(windows), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, self.span * self.DIM, axis=1)
        return view[:, :: self.DIM]

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(windows)
        n, positions, width = cols.shape
        maps = (np.ascontiguousarray(cols).reshape(-1, width) @ self.conv).reshape(n, positions, -1)
        best = maps.argmax(1)
        pooled = np.maximum(np.take_along_axis(maps, best[:, None], 1)[:, 0] + self.bias, 0)
        return cols, best, pooled

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        cols = self._columns(windows)
        n, positions, width = cols.shape
        maps = (np.ascontiguousarray(cols).reshape(-1, width) @ self.conv).reshape(n, positions, -1)
        pooled = np.maximum(maps.max(1) + self.bias, 0)
        logits = pooled @ self.out + self.out_bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def train(self, windows: np.ndarray, targets: np.ndarray, steps: int = 2_000, batch: int = 64, rate: float = 0.004, seed: int = 11) -> ByteConvNet:
        """Adam on cross-entropy; gradients flow through the pooled positions only. Some windows are cut short, so short texts are seen too."""
        rng = np.random.default_rng(seed)
        names = ("emb", "conv", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        while step < steps:
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, y = windows[pick].copy(), targets[pick]
                keep = rng.integers(6, WINDOW, len(x))
                x[(np.arange(WINDOW) >= keep[:, None]) & (rng.random(len(x)) < 0.5)[:, None]] = 0
                cols, best, pooled = self.forward(x)
                logits = pooled @ self.out + self.out_bias
                e = np.exp(logits - logits.max(1, keepdims=True))
                d = e / e.sum(1, keepdims=True)
                d[np.arange(len(y)), y] -= 1
                d /= len(y)
                dp = (d @ self.out.T) * (pooled > 0)
                rows = np.arange(len(x))[:, None]
                under = cols[rows, best]  # (windows, filters, span*dim)
                grads = {"out": pooled.T @ d, "out_bias": d.sum(0), "bias": dp.sum(0), "conv": np.einsum("nfk,nf->kf", under, dp) * self.mask}
                de = np.einsum("kf,nf->nfk", self.conv, dp).reshape(-1, self.DIM)
                at = (best[..., None] + np.arange(self.span)).reshape(len(x), -1)
                demb = np.zeros_like(self.emb)
                np.add.at(demb, x[rows, at].reshape(-1), de)
                demb[0] = 0
                grads["emb"] = demb
                step += 1
                for k in names:
                    m[k] += 0.1 * (grads[k] - m[k])
                    v[k] += 0.001 * (grads[k] ** 2 - v[k])
                    getattr(self, k)[...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
        return self


def windows_of(text: bytes) -> np.ndarray:
    """All of a text as rows of WINDOW bytes, the last one padded with zeros (zero bytes of the text count as padding)."""
    n = -(-len(text) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def train_on(labelled: DataFrame, text_col: str, label_col: str, key: Column, per_language: int = TRAIN_WINDOWS, total: int = TRAIN_TOTAL, languages: int = TRAIN_LANGUAGES) -> ByteConvNet | None:
    """Fit on a bounded sample: at most ``per_language`` windows of a language and ``total`` in all, from as many texts,
    spread by the hash of ``key``, of at most ``languages`` languages.

    A window starts at a pseudo-random place of its text.  Only the windows reach the driver:
    languages x per_language x WINDOW bytes, whatever the input's size.
    """
    rows = labelled.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key).alias("h"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return None
    labels = sorted(r["lang"] for r in sizes)
    number = {label: i for i, label in enumerate(labels)}
    per_language = max(1, min(per_language, total // len(labels)))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * per_language / r["count"]))))
    rows = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    piece = F.expr("octet_length(piece)")
    picked = rows.select("lang", F.col("text").substr(at, F.lit(WINDOW)).alias("piece"), "h").where(piece > 0).orderBy("h").collect()
    seen: dict[str, int] = {}
    xs, ys = [], []
    for r in picked:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_language:
            xs.append(windows_of(r["piece"].encode()[:WINDOW])[0])
            ys.append(number[r["lang"]])
    return ByteConvNet(labels).train(np.stack(xs), np.array(ys)) if xs else None


def identify(docs: DataFrame, model: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, n_windows) of every whole text; row-wise, no shuffle.

    The row's columns named by ``carry`` come along as the struct ``carried``.
    """
    source = id_and_bytes(docs, id_col, text_col, carry)
    fields = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType()), *source.schema.fields[2:]])

    def judge(texts: list[bytes | None]) -> tuple[list, list, list]:
        usable = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t.decode("utf-8", "replace"))]
        pred, score, count = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        group, size = [], 0
        for k, i in enumerate(usable):
            group.append(i)
            size += len(texts[i])
            if size < 1 << 20 and k + 1 < len(usable):
                continue
            windows = [windows_of(texts[j]) for j in group]
            edges = np.cumsum([0, *map(len, windows)])
            block = np.concatenate(windows)
            weight = np.maximum((block != 0).sum(1), 1)[:, None].astype(np.float32)
            probs = np.concatenate([model.probabilities(block[a : a + 256]) for a in range(0, len(block), 256)]) * weight
            sums = np.add.reduceat(probs, edges[:-1]) / np.add.reduceat(weight, edges[:-1])
            for j, p, n in zip(group, sums, np.diff(edges).tolist(), strict=True):
                best = int(p.argmax())
                pred[j], score[j], count[j] = model.labels[best], min(1.0, float(p[best])), n
            group, size = [], 0
        return pred, score, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                pred, score, count = judge(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64()), *batch.columns[2:]], names=fields.fieldNames())
            release_memory()

    return source.mapInArrow(run, fields)
