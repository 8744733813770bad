"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it.  Each rule's cost (seconds a document) and which documents it rejects are
measured on a bounded sample (`sample_rows`, a documented parameter; it decides only the order).  The next rule is then
always the one with the most rejections per second among the documents that the rules before it leave; splitting a
text into words is charged to the first rule that needs it.  A rule sees only the documents that no earlier rule has
rejected.  The verdict is the conjunction of all rules, so it does not depend on the order.  `judge` must return the
base measures of every document, so there the base rules come first, for free.

Defined cases: a null or empty text has no words, fails `too_few_words` and is not kept; repeated rows are judged
alike; an empty table gives an empty result (the rules then keep their listed order).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchspan.llm.common import WHITE, Numbering, id_and_text, mix64, per_row, rows, small_batches, words

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Texts:
    """UTF-8 texts of a batch with their words; what a rule needs is computed for the asked rows when asked."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.texts = [t or b"" for t in texts]

    @cached_property
    def words(self) -> list[list[bytes]]:
        return [words(t) for t in self.texts]

    @cached_property
    def n(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    def take(self, which: np.ndarray) -> Texts:
        some = Texts([self.texts[i] for i in which])
        if "words" in self.__dict__:
            some.words, some.n = [self.words[i] for i in which], self.n[which]
        return some

    def symbols(self) -> np.ndarray:
        return np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in self.texts], np.int64)

    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes that begin a character, less white space."""
        return np.array([len(t.decode("utf-8", "replace")) - (len(t) - len(t.translate(None, WHITE))) for t in self.texts], np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those among them equal to an earlier one."""
        total, again = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64)
        for i, t in enumerate(self.texts):
            own = [x for x in t.split(b"\n") if x.strip(WHITE)]
            total[i], again[i] = len(own), len(own) - len(set(own))
        return total, again

    def repeats(self) -> np.ndarray:
        """Words inside 8-word windows that occur twice or more in their text."""
        ids, starts = Numbering().ids(self.words)
        return repeat_words(ids, starts)

    def upper(self) -> tuple[np.ndarray, np.ndarray]:
        """ASCII capitals and ASCII letters."""
        low, up = bytes(range(97, 123)), bytes(range(65, 91))
        caps = np.array([len(t) - len(t.translate(None, up)) for t in self.texts], np.int64)
        return caps, caps + np.array([len(t) - len(t.translate(None, low)) for t in self.texts], np.int64)

    def doubled(self) -> np.ndarray:
        """Words equal to the word before them."""
        return np.array([sum(a == b for a, b in zip(w, w[1:], strict=False)) for w in self.words], np.int64)


def repeat_words(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`ids`: word numbers of all texts one after another; see Texts.repeats()."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(starts) - 1, np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = row[:n] == row[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    h = mix64(row[at].astype(np.uint64) + np.uint64(1 << 40))
    mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
    for j in range(WINDOW):
        h = (h + mixed[at + j]) * np.uint64(0x9E3779B97F4A7C15 | 1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():
        a, b = at[order[1:][same]], at[order[:-1][same]]
        if any((ids[a + j] != ids[b + j]).any() for j in range(WINDOW)) or (row[a] != row[b]).any():  # two windows share a hash
            keys = np.stack([row[at], *(ids[at + j] for j in range(WINDOW))], 1)
            _, inverse, counts = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
            twice = at[counts[inverse.ravel()] > 1]
        else:
            twice = np.unique(np.concatenate([a, b]))
    else:
        twice = np.zeros(0, np.int64)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[twice] += 1
    np.subtract.at(edge, twice + WINDOW, 1)
    return per_row((np.cumsum(edge[:-1]) > 0).astype(np.int64), starts)


#: name -> which of the given texts the rule rejects.  The first two are the base rules.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "too_few_words": lambda t: t.n < 20,
    "repeated_windows": lambda t: 100 * t.repeats() > 30 * t.n,
    "symbols": lambda t: 10 * t.symbols() > 3 * t.n,
    "capitals": lambda t: (lambda x: (10 * x[0] > 7 * x[1]) & (x[1] >= 50))(t.upper()),
    "duplicate_lines": lambda t: (lambda x: (2 * x[1] > x[0]) & (x[0] >= 4))(t.lines()),
    "doubled_words": lambda t: 5 * t.doubled() > t.n,
    "word_length": lambda t: (lambda c: (c < 2 * t.n) | (c > 20 * t.n))(t.word_chars()),
}
BASE = ("too_few_words", "repeated_windows")
#: The rules that read no words.
WORDLESS = ("capitals", "duplicate_lines")


def cascade(texts: Texts, order: list[str], rejected: np.ndarray | None = None) -> np.ndarray:
    """Which texts some rule of `order` rejects; a rule sees only what the rules before it let through."""
    out = np.zeros(len(texts.texts), bool) if rejected is None else rejected.copy()
    for name in order:
        left = np.flatnonzero(~out)
        if not len(left):
            break
        out[left[RULES[name](texts.take(left))]] = True
    return out


def ordered(seconds: dict[str, float], patterns: dict[int, float], splitting: float = 0.0) -> list[dict]:
    """Rules with their cost and the share that each rejects of what is left to it, by the greedy rule.

    `patterns` counts the sample's documents by the set of rules that reject them (bit i for the i-th rule).
    """
    names, left, split, out = list(RULES), dict(patterns), False, []
    bit = {r: 1 << i for i, r in enumerate(names)}
    while len(out) < len(names):
        total = sum(left.values())
        options = []
        for r in names:
            if not any(x["rule"] == r for x in out):
                cost = seconds.get(r, 0.0) + (0.0 if split or r in WORDLESS else splitting)
                share = sum(c for p, c in left.items() if p & bit[r]) / total if total else 0.0
                options.append((-share / max(cost, 1e-9), cost, names.index(r), share))
        _, cost, at, share = min(options)
        out.append({"rule": names[at], "seconds": cost, "rejected": share})
        split = split or names[at] not in WORDLESS
        left = {p: c for p, c in left.items() if not p & bit[names[at]]}
    return out


def plan(docs: DataFrame, sample_rows: int = 2000, seed: int = 7) -> list[dict]:
    """The rules in their order, with cost and rejected share, from at most about `sample_rows` rows of all of `docs`."""
    chosen = id_and_text(docs) if "text" in docs.columns else docs
    total = chosen.count()
    if not total:
        return [{"rule": r, "seconds": 0.0, "rejected": 0.0} for r in RULES]
    share = min(1.0, sample_rows / total)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, sets, n = {"": 0.0} | dict.fromkeys(RULES, 0.0), Counter(), 0
        for _, texts in rows(batches):
            batch = Texts(texts)
            began = time.perf_counter()
            n += len(batch.n)
            spent[""] += time.perf_counter() - began
            code = np.zeros(len(texts), np.int64)
            for i, (name, rule) in enumerate(RULES.items()):
                began = time.perf_counter()
                hit = rule(batch)
                spent[name] += time.perf_counter() - began
                code |= hit.astype(np.int64) << i
            sets.update(code.tolist())
        yield pa.RecordBatch.from_pydict({"rule": [*spent, *[None] * len(sets)], "code": [*[0] * len(spent), *sets], "value": [*spent.values(), *map(float, sets.values())], "n": [*[float(n)] * len(spent), *[0.0] * len(sets)]}, pa.schema([("rule", pa.string()), ("code", pa.int64()), ("value", pa.float64()), ("n", pa.float64())]))

    got = chosen.sample(share, seed).mapInArrow(measure, "rule string, code long, value double, n double").groupBy("rule", "code").agg(F.sum("value"), F.sum("n")).collect()
    seconds = {r: v / max(n, 1) for r, _, v, n in got if r is not None}
    return ordered(seconds, {c: v for r, c, v, _ in got if r is None}, seconds.get("", 0.0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """The base measures of every document and the cascade's verdict; no shuffle."""
    chosen = id_and_text(docs, id_col, text_col)
    order = [r for r in order or [x["rule"] for x in plan(chosen, sample_rows)] if r not in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            t = Texts(texts)
            repeated = t.repeats()
            failed = (t.n < 20) | (100 * repeated > 30 * t.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x) for x in (t.n, t.word_chars(), t.symbols(), t.lines()[1], repeated, failed, ~cascade(t, order, failed)))],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return chosen.mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """The rows of `docs` that pass all rules, with all their columns; the whole cascade short-circuits here."""
    order = order or [x["rule"] for x in plan(id_and_text(docs, id_col, text_col), sample_rows)]
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [~cascade(Texts(texts), order) for _, texts in rows(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at).cast(pa.string())], ["i", "t"])]))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return small_batches(docs).mapInArrow(run, schema)
