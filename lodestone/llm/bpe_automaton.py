"""BPE encoding and decoding with a tokenization automaton.

A deterministic automaton over *tokens* accepts exactly the canonical BPE
token sequences of pre-split words.  It starts as one state with a loop per
base symbol; each merge (u, v) -> w in rank order applies a gadget:

* the state reached by u loses its v-arc (u followed by v is no longer canonical),
* every state that still has a u-arc gains a w-arc,
* the state reached by w starts as a copy of the state reached by v.

Its state is therefore the last token read, and its arcs are kept as the
gadgets' edit history (`birth`, `left`, `right`, `cut`).

Composed with the tokens' spellings it becomes a deterministic automaton over
*characters*, and that one encodes: after each prefix of a word exactly one token
can end there, so a state is the node of the spelling automaton (the longest
suffix that may still grow into a token) and the last tokens of the prefixes which
that suffix spans.  `table[state][symbol]` is the next state; rows are built when
they are first needed, from the gadgets' arcs, and stay.  Each state carries its
label, the token that ends there: a word is encoded by one table step a symbol,
and its ids are the labels on the way back from the last state.  Words that are new
to a task take their steps together, a column of symbols at a time, over the same rows
kept as a hash table of arcs.

Decoding emits the labels of the ids' arcs.

Texts: null is empty; white space separates words and yields no token, so an
empty or blank text has no tokens.  Special tokens written out in a text are
kept whole, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_and_bytes, release_memory

#: The pre-tokenizer's pattern and the byte-to-character table's rule (printable bytes stand for themselves).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
END = "</w>"
#: Kinds of characters that PATTERN tells apart.
OTHER, LETTER, NUMBER, SPACE = range(4)

#: Chunks that one worker remembers, and the bytes of them and of their ids and labels; beyond either they are encoded anew as texts need them.
CACHE_CHUNKS = 600_000
CACHE_BYTES = 48 << 20
#: Chunks and words of so many bytes are not encoded together with others, and such words are not remembered.
LONG = 64
#: Words that take their steps together.
WORDS_TOGETHER = 20_000
#: Words that are remembered one by one.
CACHE_WORDS = 32_500
#: States of the character automaton that one worker keeps; beyond it the table is built anew as texts need it.
TABLE_STATES = 150_000
#: Documents whose ids and labels are held together, and their text bytes, but for a longer document.
TOGETHER = 500
TOGETHER_BYTES = 2 << 20


def byte_alphabet() -> str:
    """256 characters: byte b is written as the b-th; the other bytes take 256, 257, ... in order."""
    others = iter(range(256, 512))
    return "".join(chr(b) if b in PRINTABLE else chr(next(others)) for b in range(256))


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """The kind of each code point, by the classes of PATTERN."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    text = "".join(map(chr, range(sys.maxunicode + 1)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            kinds[m.start() : m.end()] = kind
    return kinds


class _Arcs:
    """(state, symbol number) -> state for whole arrays: open addressing, -1 where there is no arc."""

    def __init__(self) -> None:
        self.bits, self.n = 16, 0
        self._empty()

    def _empty(self) -> None:
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot, last = self._home(keys), (1 << self.bits) - 1
        there = self.keys.take(slot)
        out = self.to.take(slot)
        going = np.flatnonzero((there != keys) & (there >= 0))
        while len(going):
            slot[going] = at = (slot[going] + 1) & last
            there = self.keys.take(at)
            out[going] = self.to.take(at)
            going = going[(there != keys[going]) & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Add arcs, each new and given once."""
        self.n += len(keys)
        if 2 * self.n > 1 << self.bits:
            held = np.flatnonzero(self.keys >= 0)
            keys, to = np.r_[self.keys[held], keys], np.r_[self.to[held], to]
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self._empty()
        slot, last = self._home(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys  # of several for one place the last one has it
            self.to[slot[mine]] = to[mine]
            keys, to, slot = keys[~mine], to[~mine], (slot[~mine] + 1) & last


class MergeAutomaton:
    """The automaton of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels: dict[int, str] = {i: s for s, i in (*vocab.items(), *self.special.items())}
        size = max(self.labels) + 1
        self.birth, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.cut: dict[int, int] = {}
        self.size = size
        for rank, pair in enumerate(merges):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self._build_trie(vocab)
        self._reset_table()
        self._alphabet = dict(enumerate(byte_alphabet()))
        if missing := [c + e for c in self._alphabet.values() for e in ("", END) if c + e not in vocab]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single symbols")
        self._symbol = [c + e for e in ("", END) for c in self._alphabet.values()]
        self.kinds = character_kinds()
        self._words: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN)
        self._special_split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.birth[w] >= 0:
            raise ValueError(f"two merges make the token {self.labels[w]!r}")
        self.cut[u * self.size + v] = rank
        self.birth[w], self.left[w], self.right[w] = rank, u, v

    def arc(self, a: int, b: int) -> bool:
        """Has the state reached by token a an arc for token b? Walks back through the gadgets that made both."""
        before, birth, size, cut = 1 << 60, self.birth, self.size, self.cut.get
        while True:
            if cut(a * size + b, before) < before:
                return False
            x, y = birth[a], birth[b]
            if x < 0 and y < 0:
                return True
            if y >= x:  # b's arcs were added where its left part had one, after that gadget's own cut
                b, before = self.left[b], y + 1
            else:  # a's state was copied from its right part's, before that cut
                a, before = self.right[a], x

    def _build_trie(self, vocab: dict[str, int]) -> None:
        """Character automaton; a last symbol (with the end mark) is a character of its own."""
        nodes: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]
        for label, i in vocab.items():
            at, word = 0, self._symbols(label)
            for c in word:
                nxt = nodes[at].get(c)
                if nxt is None:
                    nxt = nodes[at][c] = len(nodes)
                    nodes.append({})
                    ends.append(None)
                at = nxt
            ends[at] = (i, len(word))
        fail, out, depth = [0] * len(nodes), [()] * len(nodes), [0] * len(nodes)
        queue = [0]
        for at in queue:
            for c, nxt in nodes[at].items():
                depth[nxt] = depth[at] + 1
                back = fail[at]
                while at and back and c not in nodes[back]:
                    back = fail[back]
                fail[nxt] = nodes[back].get(c, 0) if at else 0
                queue.append(nxt)
            out[at] = ((ends[at],) if ends[at] else ()) + (out[fail[at]] if at else ())
        self._goto, self._fail, self._out, self._depth = nodes, fail, out, depth

    def _reset_table(self) -> None:
        """The start state alone: the root node, and no token yet (-1, which every token may follow)."""
        self.table: list[dict[str, int]] = [{}]
        self.token, self.length = [-1], [0]  # each state's label and its symbols
        self._labels = np.zeros((2, 0), np.int32)  # the same of the first states, as an array
        self._arcs = _Arcs()
        self._allowed: dict[int, bool] = {}  # pairs of tokens whose arc was looked up
        self._meaning: list[tuple[int, tuple[int, ...]]] = [(0, (-1,))]
        self._state_of: dict[tuple[int, tuple[int, ...]], int] = {self._meaning[0]: 0}

    def _grow(self, state: int, symbol: str) -> int:
        """Build table[state][symbol]: step the spelling automaton, find the one token that ends here, name the state reached."""
        node, last = self._meaning[state]
        goto, fail = self._goto, self._fail
        step = goto[node].get(symbol)
        while step is None:  # the root has an arc for every symbol
            node = fail[node]
            step = goto[node].get(symbol)
        # last[-n] is the token that ends n - 1 symbols before this one; a token as long as all of it starts the word, or follows last[0]
        for token, length in self._out[step]:
            before = last[-length]
            if before < 0:
                break
            pair = before * self.size + token
            allowed = self._allowed.get(pair)
            if allowed is None:
                allowed = self._allowed[pair] = self.arc(before, token)
            if allowed:
                break
        # no symbol follows an end mark: states there differ by their labels alone
        meaning = (-1, (token,)) if symbol.endswith(END) else (step, (*last, token)[-1 - self._depth[step] :])
        reached = self._state_of.get(meaning)
        if reached is None:
            reached = self._state_of[meaning] = len(self.table)
            self.table.append({})
            self.token.append(token)
            self.length.append(length)
            self._meaning.append(meaning)
        self.table[state][symbol] = reached
        return reached

    @staticmethod
    def _symbols(label: str) -> list[str]:
        body, last = (label[: -len(END)], END) if label.endswith(END) and label != END else (label, "")
        return [*body[:-1], body[-1] + last]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-split word."""
        known = self._words.get(word)
        if known is not None:
            return known
        plain = word.isascii() and word.isalnum()  # such bytes stand for themselves
        mapped = word if plain else word.encode("utf-8").decode("latin-1").translate(self._alphabet)
        if len(self.table) > TABLE_STATES:
            self._reset_table()
        table, state, path = self.table, 0, []
        for c in (*mapped[:-1], mapped[-1] + END):
            step = table[state].get(c)
            state = self._grow(state, c) if step is None else step
            path.append(state)
        ids, i, token, length = [], len(path) - 1, self.token, self.length
        while i >= 0:
            state = path[i]
            ids.append(token[state])
            i -= length[state]
        found = tuple(reversed(ids))
        if len(word) < LONG:
            if len(self._words) > CACHE_WORDS:
                self._words.clear()
            self._words[word] = found
        return found

    def encode_words(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, each ``size`` bytes (one at least) of ``raw`` from ``start``: (ids of all words in order, ids per word)."""
        parts = [self._step_together(raw, start[i : i + WORDS_TOGETHER], size[i : i + WORDS_TOGETHER]) for i in range(0, len(start), WORDS_TOGETHER)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int32) for k in (0, 1))

    def _step_together(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.table) > TABLE_STATES:
            self._reset_table()
        order = np.argsort(-size, kind="stable")  # longer words first: those with a symbol in a column are its first ones
        begin, ends = start[order], size[order] - 1
        counts = np.searchsorted(-ends, -np.arange(int(ends[0]) + 1), "right")
        state, columns = np.zeros(len(order), np.int32), []
        for j, n in enumerate(counts.tolist()):
            keys = state[:n].astype(np.int64) * 512 + raw.take(begin[:n] + j) + 256 * (ends[:n] == j)
            state = self._arcs.get(keys)
            missing = np.flatnonzero(state < 0)
            if len(missing):
                new, which = np.unique(keys[missing], return_inverse=True)
                made = np.array([self._step(*divmod(k, 512)) for k in new.tolist()], np.int32)
                self._arcs.put(new, made)
                state[missing] = made[which]
            columns.append(state)
        path, column = np.concatenate(columns), np.cumsum(counts) - counts
        if (n := self._labels.shape[1]) < len(self.token):
            self._labels = np.concatenate((self._labels, np.array((self.token[n:], self.length[n:]), np.int32)), axis=1)
        token, length = self._labels[0].take(path), self._labels[1].take(path)
        ids, home = np.full(len(path), -1, np.int32), np.cumsum(size) - size  # by word and last symbol
        word, at = np.arange(len(order)), ends.copy()
        while len(word):
            here = column[at] + word
            ids[home[order[word]] + at] = token[here]
            at = at - length[here]
            word, at = word[at >= 0], at[at >= 0]
        return ids[ids >= 0], np.add.reduceat(ids >= 0, home, dtype=np.int64)

    def _step(self, state: int, symbol: int) -> int:
        found = self.table[state].get(self._symbol[symbol])
        return self._grow(state, self._symbol[symbol]) if found is None else found

    def forget(self) -> None:
        """Drop remembered words and the table's rows; the gadgets stay."""
        self._words.clear()
        self._reset_table()

    @staticmethod
    def lowered(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing looks at single characters
        return text.lower()

    def encode_plain(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in self._split.findall(self.lowered(text)):
            ids += self.encode_word(word)
        return ids

    def encode_lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lines without apostrophes, each closed by a line feed: (ids of all lines, ids per line). Words are found as PATTERN does, for all at once."""
        text = self.lowered(text)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kinds.take(code)
        edge = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)]
        first = np.flatnonzero(edge)
        stop = np.r_[first[1:], len(code)]
        word = kind[first] != SPACE
        first, stop = first[word], stop[word]
        before = np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]  # bytes before each character
        ids, sizes = self.encode_words(np.frombuffer(text.encode(), np.uint8), before[first], before[stop] - before[first])
        upto, at = np.r_[0, np.cumsum(sizes)], np.searchsorted(first, np.flatnonzero(code == 10))
        return ids, np.diff(upto[at], prepend=0)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library's encode(text, add_special_tokens=False)."""
        if self._special_split is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        ids, at = [], 0
        for m in self._special_split.finditer(text):
            ids += [*self.encode_plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return ids + self.encode_plain(text[at:])

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """Arc labels joined by a blank: the library's decode where a file names no decoder. Unknown ids are left out."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(path)


class _Chunks(dict):
    """White-space-free chunk of bytes -> number, and per number its ids and its labels as bytes, ready to be joined:
    each label is followed by a blank, each id is decimal and followed by a blank, or four bytes if ``binary``.

    Chunks that are new to a group of texts are encoded together.
    """

    def __init__(self, path: str, binary: bool):
        super().__init__()
        self.automaton, self.binary = automaton(path), binary
        self.marks = re.compile("|".join(re.escape(s[0]) for s in {"'", *self.automaton.special}).encode())
        labels = self.automaton.labels
        self.written = (_Spelled({i: i.to_bytes(4, "little") if binary else b"%d " % i for i in labels}), _Spelled({i: label.encode() + b" " for i, label in labels.items()}))
        self.forget_chunks()

    def forget_chunks(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.ids: list[bytes] = []
        self.labels: list[bytes] = []
        self.held = 0

    def forget(self) -> None:
        self.forget_chunks()
        self.automaton.forget()

    def __missing__(self, chunk: bytes) -> int:
        self.fresh.append(chunk)
        i = self[chunk] = len(self)
        return i

    def _learn(self) -> None:
        fresh, fsa, marks = self.fresh, self.automaton, self.marks.search
        alone = {k: fsa.encode(c.decode("utf-8", "replace")) for k, c in enumerate(fresh) if len(c) >= LONG or marks(c)}
        lines = [c for k, c in enumerate(fresh) if k not in alone] if alone else fresh
        ids, sizes = fsa.encode_lines((b"\n".join(lines) + b"\n").decode("utf-8", "replace")) if lines else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        for spelled, known in zip(self.written, (self.ids, self.labels), strict=True):
            found, at = spelled.write(ids, sizes), len(known)
            together = iter(found)
            known += [spelled.join(alone[k]) if k in alone else next(together) for k in range(len(fresh))] if alone else found
            self.held += sum(map(len, known[at:]))
        self.held += sum(map(len, fresh))
        self.fresh = []

    def write(self, texts: list[bytes | None]) -> list[tuple[bytes, bytes]]:
        """Each text's ids and labels, as bytes. No token spans ASCII white space, so chunks are encoded on their own."""
        if len(self) > CACHE_CHUNKS or self.held > CACHE_BYTES:
            self.forget_chunks()
        numbers = [list(map(self.__getitem__, (text or b"").split())) for text in texts]
        if self.fresh:
            self._learn()
        ids, labels = self.ids.__getitem__, self.labels.__getitem__
        return [(b"".join(map(ids, n)), b"".join(map(labels, n))) for n in numbers]


class _Spelled:
    """What each id is written as, end to end."""

    def __init__(self, forms: dict[int, bytes]):
        self.forms = forms
        self.size = np.zeros(max(forms) + 1, np.int64)
        self.size[[*forms]] = [len(x) for x in forms.values()]
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join([forms[i] for i in sorted(forms)]), np.uint8)

    def join(self, ids: list[int]) -> bytes:
        return b"".join([self.forms[i] for i in ids])

    def write(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """For each of ``sizes`` the next so many ids, written."""
        size = self.size[ids]
        stops = np.cumsum(size)
        raw = self.flat.take(np.repeat(self.start[ids] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)).tobytes()
        edges = np.r_[0, stops][np.r_[0, np.cumsum(sizes)]].tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def _chunks(path: str, binary: bool = False) -> _Chunks:
    return _Chunks(path, binary)


def written_ids(path: str, text: bytes | None) -> tuple[bytes, bytes]:
    """A text's ids and its decoded form, both as bytes."""
    ids, labels = _chunks(path).write([text])[0]
    return ids[:-1], labels[:-1]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in pieces of TOGETHER_BYTES of text and TOGETHER rows, or one longer row."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(upto, upto[at] - int(size[at]) + TOGETHER_BYTES, "right"))
        stop = max(at + 1, min(stop, at + TOGETHER))
        yield batch.slice(at, stop - at)
        at = stop


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "arrays") -> DataFrame:
    """One row per document: doc_id, n_tokens and either (``keep='arrays'``) input_ids array<int> and
    decoded string, or (``keep='digests'``) ids_sha256 and decoded_sha256.

    Null text counts as empty: no tokens, empty decoded text.  Row-wise, no shuffle; repeated rows stay.
    """
    source = id_and_bytes(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType())]
    arrays = keep == "arrays"
    fields += [T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if arrays else [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def judge(piece: pa.RecordBatch) -> pa.RecordBatch:
        written = _chunks(vocabulary, arrays).write(piece.column("text").to_pylist())
        if arrays:
            n = np.array([len(ids) // 4 for ids, _ in written], np.int64)
            flat = np.frombuffer(b"".join([ids for ids, _ in written]), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat))
            decoded = pa.array([d[:-1] for _, d in written], pa.binary()).cast(pa.string())
        else:
            n = np.array([ids.count(b" ") for ids, _ in written], np.int64)
            ids, decoded = (pa.array([hashlib.sha256(memoryview(w[i])[:-1]).hexdigest() for w in written], pa.string()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), ids, decoded], names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(judge, _pieces(batch))
        # a reused worker must not hold this task's chunks while other stages run in it
        _chunks(vocabulary, arrays).forget()
        release_memory()

    return source.mapInArrow(run, T.StructType(fields))
