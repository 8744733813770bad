"""Personal data: a linear-chain conditional random field over word-shape features, decoded by batched Viterbi.

The base spans are those of fixed patterns; the model adds spans that the patterns miss (a phone number without "+", an
address with spaces around "@", a card number with other separators).  An added span must touch no base span and pass
a plausibility check of its kind, so clean text stays clean.  Every span holds a digit or "@", so the model decodes the
windows around these characters in the whole text and nothing else.  A long window is decoded in overlapping parts that
are joined where both have the same label, so no span is cut.

The model is trained on the driver from `labelled()`, a small table of made-up lines with marked spans.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larchspan.llm.common import id_and_text, rows
from larchspan.llm.crf import ChainCRF

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 outside, then begin and inside of each kind.
N_LABELS = 1 + 2 * len(KINDS)
#: The base patterns.  A digit before the start is excluded, which changes no match but keeps scans linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\S")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out = []
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            past = m.end()
        else:
            past = at + 1
        at = text.find("@", past)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def windows(text: str, reach: int = 40) -> list[tuple[int, int]]:
    """Stretches around digits and "@", wider by `reach` characters and then up to white space; they do not overlap."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = m.start() - reach, m.end() + reach
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    done: list[tuple[int, int]] = []
    for a, b in out:
        past = done[-1][1] if done else 0
        a, b = max(a, past), min(b, len(text))
        while a > past and not text[a - 1].isspace():
            a -= 1
        if done and a == past and not text[a - 1].isspace():  # one word reaches from stretch to stretch
            done[-1] = (done[-1][0], b)
        elif a < b:
            done.append((a, b))
    return done


def _shape(token: str) -> str:
    if token.isdigit() and token.isascii():
        return f"d{min(len(token), 20)}"
    if token.isalpha():
        return "com" if token in ("com", "org", "net", "de", "fr", "es", "io") else f"a{min(len(token), 4)}{'U' if token[0].isupper() else ''}"
    return token if token in "@.+-()/,:;=#_%" else "?"


def tokens(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]


def parts(text: str, a: int, b: int, most: int, shared: int) -> Iterator[list[tuple[str, int, int]]]:
    """The tokens of a stretch, at most `most` at a time; each part begins with the last `shared` of the one before."""
    source = ((m[0], m.start(), m.end()) for m in TOKEN.finditer(text, a, b))
    held = list(islice(source, most))
    while held:
        yield held
        new = list(islice(source, most - shared))
        held = held[-shared:] + new if new else []


def _features(toks: list[tuple[str, int, int]]) -> list[list[str]]:
    """Word-shape features of each token: its own shape, those around it, and whether space stands between."""
    shapes = [_shape(t) for t, *_ in toks]
    n, out = len(toks), []
    gap = [toks[i][1] > toks[i - 1][2] for i in range(1, n)]
    for i, s in enumerate(shapes):
        before, after = shapes[i - 1] if i else "^", shapes[i + 1] if i + 1 < n else "$"
        g0, g1 = (gap[i - 1] if i else True), (gap[i] if i + 1 < n else True)
        out.append([f"0{s}", f"-{before}{g0:d}", f"+{after}{g1:d}", f"-0{before}{g0:d}{s}", f"0+{s}{g1:d}{after}", f"-2{shapes[i - 2] if i > 1 else '^'}{before}{s}", f"+2{s}{after}{shapes[i + 2] if i + 2 < n else '$'}", f"-3{shapes[i - 3] if i > 2 else '^'}", f"+3{shapes[i + 3] if i + 3 < n else '$'}"])
    return out


#: Syllables of the made-up words around the labelled spans.
SYLLABLES = "ka lo mi ren tas ul bre no vi der sta pom li qua ze fro el gan dit or pes ha mun ti rel so wen cho ér ße ón".split()


def labelled(n: int = 500, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The training table: lines with marked spans, and lines with numbers that are no personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        return r.choice([w, w, w, w.capitalize(), w + ",", w + ".", w.capitalize() + "."])

    def email() -> str:
        name = r.choice([word().strip(".,").lower() + r.choice([".", "_", ""]) + d(r.randint(0, 3)), "".join(r.choice("abcdefghij") for _ in range(5)) + "." + d(2)]).strip(".")
        host = r.choice(["mail", "post", "box"]) + r.choice(["", d(1)]) + ".example." + r.choice(["com", "org", "net"])
        return r.choice(["{}@{}", "{}@{}", "{} @ {}", "{}@ {}"]).format(name, host)

    def phone() -> str:
        return r.choice(["+1 ({}) {}-{}", "+1 {} {} {}", "({}) {}-{}", "{}-{}-{}", "({}) {} {}", "1-{}-{}-{}"]).format(d(3), d(3), d(4))

    def card() -> str:
        body = "4" + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        s = r.choice(["", " ", "-", ".", "/"])
        return s.join(body[i : i + 4] for i in range(0, 16, 4))

    make = {"email": email, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    noise = [lambda: d(r.randint(1, 4)) + r.choice(["", ".", ","]), lambda: f"{d(1)}.{d(1)}", lambda: f"CC BY-NC {d(1)}.0.", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: "AKIA" + "".join(r.choice("ABCDEFG234567") for _ in range(16)), lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}", lambda: d(r.randint(5, 12)), lambda: f"{d(2)},{d(3)}", lambda: f"{d(2)}%", lambda: f"@{word()}", lambda: f"v{d(1)}.{d(1)}.{d(1)}"]
    out = []
    for _ in range(n):
        line, marks = "", []
        for _ in range(r.randint(1, 4)):
            line += " ".join(word() for _ in range(r.randint(1, 6))) + " "
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                s = make[kind]()
                marks.append((kind, len(line), len(line) + len(s)))
                line += s + r.choice([" ", " ", ". ", ", "])
            else:
                line += r.choice(noise)() + " "
        out.append((line, marks))
    return out


@cache
def model(n: int = 500, seed: int = 5) -> tuple[ChainCRF, dict[str, int]]:
    vocabulary: dict[str, int] = {}
    sequences, labels = [], []
    for text, marks in labelled(n, seed):
        toks = tokens(text, 0, len(text))
        y = [0] * len(toks)
        for kind, a, b in marks:
            inside = [i for i, (_, s, e) in enumerate(toks) if a <= s and e <= b]
            for j, i in enumerate(inside):
                y[i] = 1 + 2 * KINDS.index(kind) + (j > 0)
        sequences.append([[vocabulary.setdefault(f, len(vocabulary)) for f in fs] for fs in _features(toks)])
        labels.append(y)
    bans = [(i, j) for i in range(N_LABELS) for j in range(2, N_LABELS, 2) if i not in (j, j - 1)]
    return ChainCRF.train(sequences, labels, len(vocabulary), N_LABELS, epochs=45, forbidden=bans, not_first=list(range(2, N_LABELS, 2))), vocabulary


def plausible(kind: str, s: str) -> bool:
    """The check that an added span must pass."""
    digits = _digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9-]+(?:\s?\.\s?[A-Za-z0-9-]+)+", s))
    if kind == "ip":
        parts = re.split(r"\s*[.,]\s*", s)
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9\s./-]", s)
    return 10 <= len(digits) <= 15 and not re.search(r"[^0-9\s().+/-]", s) and bool(re.search(r"[()+-]", s))


class _Joint:
    """Plausible spans that the labels of the parts of stretches mark; parts come in order, with their labels."""

    def __init__(self, label, shared: int) -> None:  # noqa: ANN001
        self.label, self.shared = label, shared
        self.toks: list[tuple[str, int, int]] = []  # of the last part, from where it holds
        self.path = np.zeros(0, np.int64)
        self.text, self.out = "", []
        self.span: tuple[str, int, int] | None = None
        self.last, self.n = -1, 0  # the span's last token, tokens read

    def add(self, first: bool, toks: list[tuple[str, int, int]], path: np.ndarray, text: str, out: list[tuple[str, int, int]]) -> None:
        if first:
            self.close()
            self.text, self.out, self.toks, self.path = text, out, toks, path
            return
        before, k = len(self.toks) - self.shared, self.meet(self.path[-self.shared :], path[: self.shared])
        if k is None:  # the parts disagree all over what they share: as one
            self.toks = self.toks + toks[self.shared :]
            self.path = self.label([self.toks])[0]
            return
        self.read(before + k)
        self.toks, self.path = toks[k:], path[k:]

    def meet(self, a: np.ndarray, b: np.ndarray) -> int | None:
        """Where to go from one part to the next: at equal labels, outside spans if possible, about the middle."""
        edge = self.shared // 4  # near its ends a part knows too little of what is around
        same = edge + np.flatnonzero((a == b)[edge : self.shared - edge])
        if not len(same):
            return None
        outside = same[a[same] == 0]
        same = outside if len(outside) else same
        return int(same[np.abs(same - self.shared // 2).argmin()])

    def read(self, stop: int) -> None:
        """Takes the labels before `stop`; a span may go on after it."""
        path = self.path[:stop]
        for at in np.flatnonzero(path).tolist():
            y, (_, a, b) = int(path[at]), self.toks[at]
            if y % 2 == 1:
                self.end()
                self.span, self.last = (KINDS[(y - 1) // 2], a, b), self.n + at
            elif self.span and self.last == self.n + at - 1 and self.span[0] == KINDS[(y - 2) // 2]:
                self.span, self.last = (self.span[0], self.span[1], b), self.n + at
        self.n += stop

    def end(self) -> None:
        if self.span and plausible(self.span[0], self.text[self.span[1] : self.span[2]]):
            self.out.append(self.span)
        self.span = None

    def close(self) -> None:
        self.read(len(self.toks))
        self.end()
        self.toks, self.path = [], np.zeros(0, np.int64)


def added_spans(crf: ChainCRF, vocabulary: dict[str, int], texts: list[str], base: list[list[tuple[str, int, int]]], group: int = 100_000, most: int = 1024, shared: int = 256) -> list[list[tuple[str, int, int]]]:
    """Spans of the model for each text, without those that touch a base span or fail their check.

    `group` tokens are labelled at once; a stretch over `most` tokens is labelled in parts that share `shared` tokens.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    where: list[tuple[int, bool]] = []
    held: list[list[tuple[str, int, int]]] = []

    def label(some: list[list[tuple[str, int, int]]]) -> list[np.ndarray]:
        return crf.viterbi([[[vocabulary[f] for f in fs if f in vocabulary] for fs in _features(toks)] for toks in some])

    joint = _Joint(label, shared)

    def decode() -> None:
        for (i, first), toks, path in zip(where, held, label(held), strict=True):
            joint.add(first, toks, path, texts[i], out[i])
        where.clear()
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for a, b in windows(t):
            for j, toks in enumerate(parts(t, a, b, most, shared)):
                where.append((i, j == 0))
                held.append(toks)
                size += len(toks)
                if size > group:  # bounds the memory of the features
                    decode()
                    size = 0
    decode()
    joint.close()
    for i, found in enumerate(out):
        if found:
            taken = sorted((a, b) for _, a, b in base[i])
            starts = [a for a, _ in taken]
            longest = [b for _, b in taken]
            for j in range(1, len(longest)):
                longest[j] = max(longest[j], longest[j - 1])
            out[i] = [x for x in found if not ((j := bisect_left(starts, x[2])) and longest[j - 1] > x[1])]
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained: tuple[ChainCRF, dict[str, int]] | None = None) -> DataFrame:
    """Per document the base counts, the digest of the base spans and all spans; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(trained or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in rows(batches):
            texts = [(t or b"").decode("utf-8", "replace") for t in raw]
            base = [base_spans(t) for t in texts]
            more = added_spans(*held.value, texts, base)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64())]
                + [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in KINDS]
                + [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string()), pa.array([len(m) for m in more], pa.int64())],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
