"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A word is the bag of its hashed character n-grams (2 to 4, with end marks) and of itself; a text is the average over its
words' vectors.  Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, drawn over the whole table by a hash: of each language its share of `fit_rows`, but `fit_each` at least
(or all it has), and of each such text at most `fit_words` words, drawn over the whole text.  Afterwards both layers are
linear, so a word's share of the class scores is one small vector, computed once per distinct word; prediction runs
over every word of the whole text.  A temperature and a rejection threshold are calibrated on a held-back fifth of the
sample: `rejected` marks texts whose score is below the threshold that keeps `keep_share` of that fifth.

Defined cases: a null text and a text without a letter give `und` with score 0 and are rejected; with no labelled rows
everything is `und`; ties go to the first language in sorted order; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.llm.common import Numbering, crc_of_id, id_and_text, lower_words, mix64, per_row, rows

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
LOWEST, HIGHEST = 2, 4


def grams(some: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For all words at once: bucket numbers of each word's n-grams (over code points, ends marked by a space) and of
    the word as a whole, with the number of the word that each belongs to; in the words' order."""
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = " " + b" ".join(some).decode("utf-8", "replace").lower() + " "
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    space = points == 32
    word = np.cumsum(space) - 1  # a space belongs to the word after it
    begin = np.flatnonzero(space)[:-1]
    place = np.arange(len(points)) - begin[np.minimum(word, len(begin) - 1)]
    with np.errstate(over="ignore"):
        hashes = [np.add.reduceat(mix64(points[:-1] * np.uint64(0x9E3779B97F4A7C15) + place[:-1].astype(np.uint64)), begin)]
        owners = [np.arange(len(begin))]
        for n in range(LOWEST, HIGHEST + 1):
            m = len(points) - n + 1
            if m <= 0:
                break
            h, ok = np.full(m, np.uint64(n)), np.ones(m, bool)
            for j in range(n):
                h = h * np.uint64(1_000_003) + points[j : m + j]
                if 0 < j < n - 1:
                    ok &= ~space[j : m + j]
            ok[-1] &= word[m - 1] < len(begin)
            hashes.append(h[ok])
            owners.append(word[:m][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mix64(np.concatenate(hashes)) % np.uint64(buckets)).astype(np.int64)[order], owner[order]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def word_scores(self, some: list[bytes]) -> np.ndarray:
        """Class scores of words: the mean over their n-grams."""
        g, owner = grams(some, len(self.table))
        n = np.maximum(np.bincount(owner, minlength=len(some)), 1)
        return np.stack([np.bincount(owner, weights=self.table[g, k], minlength=len(some)) / n for k in range(len(self.languages))], 1)

    def scores(self, texts: list[bytes], known: WordScores | None = None) -> np.ndarray:
        """Class scores of each text before the temperature."""
        known = known or WordScores()
        ids, starts = known.number.ids([lower_words(t) for t in texts])
        each = known.upto(self)
        n = np.maximum(np.diff(starts), 1)
        return np.stack([per_row(each[ids, k], starts) for k in range(len(self.languages))], 1) / n[:, None] + self.bias

    def probabilities(self, texts: list[bytes], known: WordScores | None = None) -> np.ndarray:
        z = self.scores(texts, known) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


class WordScores:
    """Scores of the words met so far."""

    def __init__(self) -> None:
        self.number, self.table = Numbering(), np.zeros((0, 0))

    def upto(self, model: LanguageModel) -> np.ndarray:
        if (done := len(self.table)) < len(self.number):
            new = model.word_scores(list(islice(self.number, done, None)))
            self.table = np.concatenate([self.table, new]) if done else new
        return self.table if len(self.table) else np.zeros((1, len(model.languages)))


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(texts: list[bytes], langs: list[str], buckets: int = 1 << 14, width: int = 12, epochs: int = 6, least_steps: int = 360, batch: int = 64, rate: float = 0.8, seed: int = 3, keep_share: float = 0.999, words_each: int = 60) -> LanguageModel | None:
    """Stochastic gradient descent over texts; each step sees `words_each` random words of each text of the batch."""
    languages = sorted(set(langs))
    if not languages:
        return None
    r = np.random.default_rng(seed)
    number = Numbering()
    ids, starts = number.ids([lower_words(t) for t in texts])
    bucket, owner = grams(list(number), buckets)
    sizes = np.bincount(owner, minlength=len(number))
    first = np.cumsum(sizes) - sizes
    y = np.array([languages.index(x) for x in langs])
    order = r.permutation(len(texts))
    rank, n_of, seen = np.zeros(len(texts), np.int64), np.bincount(y, minlength=len(languages)), np.zeros(len(languages), np.int64)
    for i in order.tolist():
        rank[i] = seen[y[i]]
        seen[y[i]] += 1
    aside = (rank < n_of[y] // 5)[order]  # of each language, so that none is held back whole
    held, fit = order[aside], order[~aside]
    epochs = max(epochs, -(-least_steps // max(1, -(-len(fit) // batch))))
    n_l = len(languages)
    emb, w, b = r.normal(0, 0.1, (buckets, width)), r.normal(0, 0.1, (width, n_l)), np.zeros(n_l)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            take = fit[at : at + batch]
            chosen = [ids[starts[i] : starts[i + 1]] for i in take]
            chosen = [c[r.integers(0, len(c), words_each)] if len(c) > words_each else c for c in chosen]
            word = np.concatenate(chosen)
            if not len(word):
                continue
            text_of = np.repeat(np.arange(len(take)), [len(c) for c in chosen])
            share = np.repeat([1.0 / max(len(c), 1) for c in chosen], [len(c) for c in chosen]) / sizes[word]
            n = sizes[word]
            flat = bucket[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            doc, weight = np.repeat(text_of, n), np.repeat(share, n)
            mean = np.stack([np.bincount(doc, weights=emb[flat, k] * weight, minlength=len(take)) for k in range(width)], 1)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(take)), y[take]] -= 1
            back = (p @ w.T) * (step * 40 / len(take))
            w -= step * 4 * mean.T @ p / len(take)
            b -= step * p.mean(0)
            for k in range(width):
                emb[:, k] -= np.bincount(flat, weights=back[doc, k] * weight, minlength=buckets)
    model = LanguageModel(languages, emb @ w, b)
    check = held if len(held) else fit
    z = model.scores([texts[i] for i in check])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 5, 41):
        q = z / t
        q = q - q.max(1, keepdims=True)
        loss = -(q[np.arange(len(check)), y[check]] - np.log(np.exp(q).sum(1))).mean()
        best = min(best, (float(loss), float(t)))
    model.temperature = best[1]
    top = model.probabilities([texts[i] for i in check]).max(1)
    model.threshold = float(np.quantile(top, 1 - keep_share))
    return model


def _some_words(most: int):  # noqa: ANN202
    """(text, lang, mark): of longer texts `most` words, drawn over the whole text by the row's mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, mark in zip(b.column(0), b.column(2).to_pylist(), strict=True):
                words = t.as_py().split()
                if len(words) > most:
                    take = np.sort(np.random.default_rng(mark % (1 << 63)).choice(len(words), most, replace=False))
                    words = [words[i] for i in take.tolist()]
                texts.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(1), b.column(2)], ["text", "lang", "mark"])

    return run


def fit(docs: DataFrame, fit_rows: int = 3000, fit_each: int = 200, fit_words: int = 1000) -> LanguageModel | None:
    """A model from labelled training rows of `docs` (doc_id, text, lang): about `fit_rows` in all, but `fit_each` of each
    language at least.  Repeated rows count once."""
    able = docs.where((crc_of_id() % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("mark"))
    counts = {r[0]: r[1] for r in able.groupBy("lang").count().collect()}
    total = sum(counts.values())
    if not total:
        return None
    bounds = [(k, -(-n // max(fit_each, -(-n * fit_rows // total)))) for k, n in counts.items()]
    once = lambda some: some.mapInArrow(_some_words(fit_words), "text string, lang string, mark long").groupBy("lang", "mark").agg(F.min("text").alias("text"))
    step = docs.sparkSession.createDataFrame(bounds, "lang string, step long")  # one row a language
    got = once(able.join(F.broadcast(step), "lang").where(F.pmod("mark", "step") == 0).select("text", "lang", "mark")).select("lang", "text").collect()
    left = sorted(set(counts) - {r[0] for r in got})
    if left:  # languages of few distinct rows, none of them drawn
        w = W.partitionBy("lang").orderBy("mark")
        got += once(able.where(F.col("lang").isin(left))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= fit_each).select("lang", "text").collect()
    pairs = [(t.encode(), lang) for lang, t in sorted((r[0], r[1]) for r in got) if has_letter(t.encode())]
    return train([t for t, _ in pairs], [lang for _, lang in pairs])


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 3000, model: LanguageModel | None = None, most_known: int = 200_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; no shuffle.  `most_known` bounds a worker's word table."""
    if model is None:
        model = fit(id_and_text(docs, id_col, text_col).withColumn("lang", F.lit(None).cast("string")) if lang_col not in docs.columns else docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")), fit_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, known = held.value, WordScores()
        flags = []

        def split(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in source:
                flags.extend(b.column(2).to_pylist())
                yield b

        for ids, texts in rows(split(batches)):
            out, flags[:] = flags[: len(ids)], flags[len(ids) :]
            good = np.array([lm is not None and has_letter(t) for t in texts], bool)
            lang, score = ["und"] * len(ids), np.zeros(len(ids))
            at = np.flatnonzero(good)
            if len(at):
                if len(known.number) > most_known:
                    known = WordScores()
                p = lm.probabilities([texts[i] for i in at], known)
                best = p.argmax(1)
                score[at] = np.clip(p[np.arange(len(at)), best], 0, 1)
                for i, k in zip(at, best, strict=True):
                    lang[i] = lm.languages[k]
            limit = lm.threshold if lm else 1.0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(lang, pa.string()), pa.array(score), pa.array(~good | (score < limit))], [x.split()[0] for x in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).withColumn("held_out", crc_of_id() % 5 == 0).mapInArrow(run, SCHEMA)
