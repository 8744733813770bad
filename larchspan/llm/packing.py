"""Packing: sum-of-squares online placement of documents into windows of 2048 tokens, tracked in a level array.

Each partition packs its own documents in their order.  Full windows are cut off a long document; its rest, of size s,
goes whole to the fill level h that minimises the sum over levels of the squared number of windows at that level: the
change is computed for all levels at once from the level array (windows closed by an exact fit leave it).  A new window
is one of the choices while the open ones are at most `spare` of those closed so far (`least_open` at least).  At that
bound a rest without room is cut where it fills a window, whose level is again the one that minimises the sum of
squares, and what is left of it opens the window that is now allowed.  So what is still open at the end of a partition
is a small share of it; that is re-cut into full windows, and the last remainder into lengths that are powers of two,
which need no padding (`recut` marks these pieces).  No shuffle; memory holds one partition's open windows: at most
`least_open` of them, or `spare` of the windows that it has closed.

Tokens come from a public tokenizer whose file is a parameter.  Its pieces never cross ASCII white space, so ids of
each distinct word are computed once and looked up (`most_known` bounds the table); tests hold this against encoding
whole texts.

Defined cases: a null or empty text is its end token alone (one piece of length 1); repeated rows are packed each for
itself (their pieces carry the same doc_id and different places); an empty table gives no pieces.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larchspan.llm.common import id_and_text, rows

WINDOW = 2048
#: ASCII characters that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, recut boolean"


class _Words(dict):
    """Word -> number; new words are numbered in order and noted."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """Token ids of UTF-8 texts by way of a bounded table of words: each word's ids are a slice of one array."""

    def __init__(self, path: str, end_id: int | None = 1, most_known: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.end_id, self.most_known = end_id, most_known
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        self.words, self.tails = _Words(), {}
        self.pool, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slow(self, some: list[str]) -> list[np.ndarray]:
        got = self.tok.encode_batch_fast(some, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def _encode(self, some: list[str]) -> list[np.ndarray]:
        """Words of letters only are one piece each: many are encoded in one go and parted at their end-of-word ids."""
        low = [s.lower() for s in some]
        plain = [i for i, (s, t) in enumerate(zip(some, low, strict=True)) if t.isalpha() and s.isalpha() and len(t) == len(s) and (s.isascii() or unicodedata.is_normalized("NFC", s))]
        out: list = [None] * len(some)
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = np.array(self.tok.encode_batch_fast([" ".join([some[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(part) and len(ids) == stops[-1]:
                a = 0
                for i, b in zip(part, stops, strict=True):
                    out[i] = ids[a:b]
                    a = b
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 1024):
            part = rest[at : at + 1024]
            for i, x in zip(part, self._slow([some[i] for i in part]), strict=True):
                out[i] = x
        return out

    def _learn(self) -> None:
        """Ids of the new words.  ASCII marks after a letter or digit at a word's end are a piece of their own."""
        new = self.words.new
        texts = [w.decode("utf-8", "replace") for w in new]
        cores = [s.rstrip(MARKS) for s in texts]
        cores = [c if c and (c[-1].isalpha() or c[-1] in "0123456789") else s for c, s in zip(cores, texts, strict=True)]
        tails = [s[len(c) :] for c, s in zip(cores, texts, strict=True)]
        fresh = [x for x in dict.fromkeys(tails) if x and x not in self.tails]
        self.tails.update(zip(fresh, self._slow(fresh), strict=True))
        known = {}
        old, n_old = dict.get, len(self.at)
        for w, c, t in zip(new, cores, tails, strict=True):
            if t and (k := old(self.words, w[: -len(t)])) is not None and k < n_old:
                known[c] = self.pool[self.at[k] : self.at[k] + self.size[k]]
        wanted = [c for c in dict.fromkeys(cores) if c not in known]
        known.update(zip(wanted, self._encode(wanted), strict=True))
        parts, size = [], np.empty(len(new), np.int64)
        for i, (c, t) in enumerate(zip(cores, tails, strict=True)):
            x = known[c]
            parts.append(x)
            if t:
                y = self.tails[t]
                parts.append(y)
                size[i] = len(x) + len(y)
            else:
                size[i] = len(x)
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, *parts])
        new.clear()

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        if len(self.words) > self.most_known:
            self._reset()
        split = [t.lower().split() if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        number = self.words
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if number.new:
            self._learn()
        n = self.size[ids]
        ends = np.cumsum(n)
        flat = self.pool[np.repeat(self.at[ids] - (ends - n), n) + np.arange(int(n.sum()))] if len(ids) else np.zeros(0, np.uint32)
        stops = np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum(counts)].tolist()
        if self.end_id is None:
            return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        end = np.array([self.end_id], np.uint32)
        return [np.concatenate([flat[a:b], end]) for a, b in zip([0, *stops], stops, strict=False)]


class Packer:
    """Places rests of 1 to window-1 tokens; `levels[h]` is the number of open windows filled to h."""

    def __init__(self, window: int = WINDOW, spare: float = 1 / 16, least_open: int = 8) -> None:
        self.window, self.spare, self.least_open = window, spare, least_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = self.n_closed = 0

    def closed(self, n: int = 1) -> None:
        """Counts full windows, so that more may be open."""
        self.n_closed += n

    def choose(self, size: int) -> tuple[int, int]:
        """(level, part): part of a rest of this size goes to a window at the level; level 0 is a new window."""
        b, n, none = self.window, self.levels, np.iinfo(np.int64).max
        top = b - size
        if top >= 1:
            old = n[1 : top + 1]  # windows at level h would move to h + size
            change = 2 * (n[1 + size : top + size + 1] - old) + 2  # (N[h]-1)^2 - N[h]^2 + (N[h+s]+1)^2 - N[h+s]^2
            change[-1] = 1 - 2 * n[top]  # filled up: it leaves the array
            change = np.where(old > 0, change, none)
            h = int(change.argmin()) + 1
            least = int(change[h - 1])
        else:
            h, least = 0, none
        may_open = self.n_open < max(self.least_open, self.spare * self.n_closed)
        if least < none and (not may_open or least <= 2 * int(n[size]) + 1):
            return h, size
        if may_open:
            return 0, size
        old = n[top + 1 : b]  # filled up by b - h tokens, while size - (b - h) open a window
        h = top + 1 + int(np.where(old > 0, 2 * (n[1:size] - old) + 2, none).argmin())
        return h, b - h

    def place(self, piece: tuple, size: int) -> list | None:
        """Adds a piece (document, start, ids, total); returns the window's pieces if one is now full."""
        h, part = self.choose(size)
        if part < size:
            doc, start, ids, total = piece
            full = self._put(h, (doc, start, ids[:part], total), part)
            self._put(0, (doc, start + part, ids[part:], total), size - part)
            return full
        return self._put(h, piece, size)

    def _put(self, h: int, piece: tuple, size: int) -> list | None:
        held = []
        if h:
            held = self.open[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        held.append(piece)
        if h + size == self.window:
            self.n_closed += 1
            return held
        self.levels[h + size] += 1
        self.n_open += 1
        self.open[h + size].append(held)
        return None

    def rest(self) -> list[list]:
        """Contents of all windows still open, fullest first."""
        return [w for h in range(self.window - 1, 0, -1) for w in self.open[h]]


@cache
def _tokens(path: str, end_id: int, most_known: int) -> WordTokens:
    return WordTokens(path, end_id, most_known)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = 1, most_known: int = 300_000, spare: float = 1 / 16, least_open: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, recut."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = _tokens(tokenizer, end_id, most_known), Packer(window, spare, least_open)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        number = part << 33
        out: list[tuple] = []

        def emit(pieces: list, recut: bool = False) -> None:
            nonlocal number
            at = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at, recut))
                at += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if name == "recut" else pa.int64()) for name, c in zip(names, columns, strict=True)], names)

        for ids, texts in rows(batches, 2 << 20):
            for doc, got in zip(ids, tok.encode(texts), strict=True):
                total = len(got)
                full = total - total % window
                for at in range(0, full, window):
                    emit([(doc, at, got[at : at + window], total)])
                packer.closed(full // window)
                if full < total and (done := packer.place((doc, full, got[full:].copy(), total), total - full)):
                    emit(done)
            if len(out) > 20_000:
                yield flush()
        held, size = [], 0
        for pieces in packer.rest():  # re-cut what is left: full windows first, then powers of two
            for doc, start, ids, total in pieces:
                while len(ids):
                    k = min(window - size, len(ids))
                    held.append((doc, start, ids[:k], total))
                    start, ids, size = start + k, ids[k:], size + k
                    if size == window:
                        emit(held, True)
                        held, size = [], 0
        while size:
            want, take, got = 1 << (size.bit_length() - 1), [], 0
            while got < want:
                doc, start, ids, total = held.pop(0)
                k = min(want - got, len(ids))
                take.append((doc, start, ids[:k], total))
                if k < len(ids):
                    held.insert(0, (doc, start + k, ids[k:], total))
                got += k
            emit(take, True)
            size -= want
        yield flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
