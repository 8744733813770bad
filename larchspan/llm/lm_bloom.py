"""N-gram language-model scores from a log-frequency Bloom filter.

Learning (documents whose crc32(doc_id) mod 10 is not 0): words and word pairs of whole texts are counted per block of
text first, then summed by hash bucket.  A count c is quantised to 1 + floor(log_base c) levels, and the n-gram goes
into the filter once with each level up to its own, so reading a count back is a run of membership probes that ends at
the first miss.  The filter is built bucket by bucket as segments; a bucket is one task's work.

The model is absolute discounting by 1 (leave one out) of the quantised counts q: a pair keeps k(vw) = q(vw) - 1, and
P(w|v) = (k(vw) + r(v) P(w)) / (K(v) + r(v)), P(w) = (q(w) + 0.1) / (sum of all + 0.1), with K(v) the sum of k(vw) over
all w and r(v) = max(q(v) - K(v), 1).  K(v) and the sum of all are taken from the counts as the finished filter reads
them back, so the probabilities of all words after a word sum to 1 but for false reads of pairs that never occurred;
the number of hash functions follows from the corpus' size such that these add at most about `slack`.  A pair that
occurs once keeps nothing, so it need not be in the filter, and where K(v) is 0 no pair is probed.

Scoring: each block sends all its distinct words and pairs to their buckets, with their training counts.  A bucket that
has built its segment reads all n-grams that it was sent back from it, once however many blocks have them, and returns
the levels; K is added to the words' answers, as words and K are dealt alike.  A block is met again as the numbers of its
tokens, so the texts are read once, and nothing goes through the driver.  Segments and K are broadcast instead while they
are at most `broadcast_bytes` together, with the same results.

The exact base score needs the exact count of every token, over a vocabulary that grows with the corpus: it comes back
with the levels of the words.  Pieces that blocks and buckets exchange would grow with the square of the corpus; buckets
grow with its square root, to four times their size at most.

Defined cases: a null or empty text is its end token alone; repeated rows are scored alike (and counted each); with no
training rows all counts are 0; an empty table gives an empty result; a null doc_id hashes as an empty text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchspan.llm.common import Numbering, checkpointed_alone, crc_of_id, lower_words, mix64, rows, small_batches
from larchspan.session import checkpointed

END = b"\n"  # no word holds a line feed
KEY_BITS = 45
#: Bits of a pair's key that name its first and its second word (words that share them count as one).
FIRST_BITS, SECOND_BITS = 30, 34
U64 = np.uint64


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(t, 7) for t in tokens]), ">u8").astype(U64)


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ U64(0x5851F42D4C957F2D)) >> U64(64 - KEY_BITS)


def first_keys(h: np.ndarray) -> np.ndarray:
    """What names a word as the first of a pair: the upper bits of its key."""
    return word_keys(h) >> U64(KEY_BITS - FIRST_BITS)


def second_keys(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - SECOND_BITS)


def _range(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of first_keys, so sorted keys lie bucket by bucket."""
    return ((keys * U64(buckets)) >> U64(FIRST_BITS)).astype(np.int64)


def bucket_of(order: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Of words (order 0) the range; of pairs (1) a hash of the whole key, so the pairs of a frequent word are spread."""
    return _range(keys >> U64(KEY_BITS - FIRST_BITS), buckets) if order == 0 else _range(mix64(keys) >> U64(64 - FIRST_BITS), buckets)


def mixed(pairs: np.ndarray) -> np.ndarray:
    """Pairs' keys as they are sorted when sent: by a hash, so that a bucket is a range of it, see bucket_of()."""
    return mix64(pairs)


def unmixed(x: np.ndarray) -> np.ndarray:
    """The keys that mixed() came from."""
    back = U64(pow(0xD6E8FEB86659FD93, -1, 2**64))
    for _ in range(2):
        x = (x ^ (x >> U64(32))) * back
    return x ^ (x >> U64(32))


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base c) for c >= 1."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def expected(base: float, most: int = 128) -> np.ndarray:
    """The mean count that a level stands for; 0 for level 0."""
    out = [0.0]
    for q in range(1, most):
        low, high = math.ceil(base ** (q - 1) - 1e-9), math.ceil(base**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


def _spread(keys: np.ndarray, level: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the hash functions i to i + 15 at a level."""
    h = mix64(keys + U64((1 + level * 0x9E3779B97F4A7C15 + (i >> 4) * 0xBF58476D1CE4E5B9) & (2**64 - 1)))
    return h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)


def pair_hashes(words: float, slack: float) -> int:
    """Hash functions of a pair's first level such that of `words` absent pairs about `slack` are read at all."""
    return max(8, math.ceil(math.log2(max(words, 1.0) / slack)))


@dataclass(frozen=True)
class Depth:
    """Levels from `first` up, with `entry` hash functions at that and `more` at each further one."""

    first: int
    entry: int
    more: int

    def at(self, level: int) -> int:
        return self.entry if level == self.first else self.more


def build_segment(keys: np.ndarray, counts: np.ndarray, base: float, depth: Depth) -> bytes:
    """The filter of one bucket: every key with each of its levels from the first up; half of its bits are set."""
    q = levels(counts, base)
    keys, q = keys[q >= depth.first], q[q >= depth.first]
    if not len(keys):
        return b""
    probes = len(keys) * depth.entry + int((q - depth.first).sum()) * depth.more
    size = int(-(-math.ceil(probes / math.log(2)) // 8) * 8)
    flags = np.zeros(size, bool)
    level = depth.first
    while len(keys):
        for i in range(depth.at(level)):
            if i % 16 == 0:
                a, b = _spread(keys, level, i)
            flags[((a + U64(i % 16) * b) % U64(size)).astype(np.int64)] = True
        level += 1
        go = q >= level
        keys, q = keys[go], q[go]
    return np.packbits(flags).tobytes()


def probe(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, keys: np.ndarray, depth: Depth, most: int = 127) -> np.ndarray:
    """Levels of the keys, 0 for absent ones, by probing level after level until the first miss.  `starts`: first byte
    of each bucket's segment; `sizes`: its bits."""
    out = np.zeros(len(keys), np.uint8)
    if not len(starts):
        return out
    start, size = starts[bucket] * 8, sizes[bucket]
    live = np.flatnonzero(size > 0)
    for level in range(depth.first, most + 1):
        if not len(live):
            break
        k, s, z = keys[live], start[live], size[live].astype(U64)
        at = None
        for i in range(depth.at(level)):
            if i % 16 == 0:
                a, b = _spread(k, level, i)
            p = ((a + U64(i % 16) * b) % z).astype(np.int64) + s
            ok = (data[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
            if not ok.all():
                at = np.flatnonzero(ok) if at is None else at[ok]
                k, s, z, a, b = k[ok], s[ok], z[ok], a[ok], b[ok]
            if not len(k):
                break
        live = live if at is None else live[at]
        out[live] = level
    return out


def read_back(segment: bytes, keys: np.ndarray, depth: Depth) -> np.ndarray:
    """Levels of keys as one segment reads them."""
    data = np.frombuffer(segment, np.uint8)
    return probe(data, np.zeros(1, np.int64), np.array([8 * len(data)]), np.zeros(len(keys), np.int64), keys, depth)


@cache
def _zstd() -> tuple:
    """Compressing and decompressing functions, made once a worker: pieces are many and small."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys of one bucket as differences, with counts: lengths and the first key, then the two streams."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.copy()  # plane by plane; only the last two repeat enough to be worth compressing
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<u4")
    head = np.array([len(keys), len(large), width], "<u4").tobytes() + keys[:1].astype("<u8").tobytes()
    raw = max(width - 2, 0)
    return head + planes[:raw].tobytes() + _zstd()[0](planes[raw:].tobytes() + small.tobytes() + large.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not blob:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n, n_large, width = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    raw = max(width - 2, 0)
    rest = _zstd()[1](blob[20 + n * raw :])
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :raw] = np.frombuffer(blob, np.uint8, n * raw, 20).reshape(raw, n).T
    wide[:, raw:width] = np.frombuffer(rest, np.uint8, n * (width - raw)).reshape(width - raw, n).T
    counts = np.frombuffer(rest, np.uint8, n, n * (width - raw)).astype(np.int64)
    counts[counts == 255] = np.frombuffer(rest, "<u4", n_large, n * (width - raw + 1))
    return np.cumsum(wide.reshape(-1).view("<u8")).astype(U64) + np.frombuffer(blob, "<u8", 1, 12), counts


def _zip(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<u4").tobytes()
    return _zstd()[0](head + b"".join(a.tobytes() for a in arrays))


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _zstd()[1](blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", n, 4)
    at, out = 4 + 4 * n, []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _planes(ids: np.ndarray) -> np.ndarray:
    """Numbers byte by byte: first the lowest byte of all, then the next; no more bytes than the largest needs."""
    width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.ravel()


def _from_planes(planes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if n:
        out[:, : len(planes) // n] = planes.reshape(-1, n).T
    return out.reshape(-1).view("<u4").astype(np.int64)


def pair_keys(hashes: np.ndarray, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of pairs of tokens, given by number."""
    return (first_keys(hashes)[before] << U64(SECOND_BITS)) | second_keys(hashes)[ids]


def before_in_texts(ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Number of the token before each place; a text's first token follows its start, written as the end token."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[starts[:-1]] = end
    return out


class _Block:
    """Rows of one block of text: token numbers of all texts one after another, each text's end token last."""

    def __init__(self, keys: list[tuple], texts: list[bytes | None]) -> None:
        self.keys = keys
        self.number = Numbering()
        split = [lower_words(t) for t in texts]
        for s in split:
            s.append(END)
        self.ids, self.starts = self.number.ids(split)
        del split
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        self.tokens = list(self.number)
        self.hashes = token_hashes(self.tokens)

    def before(self) -> np.ndarray:
        return before_in_texts(self.ids, self.starts, self.number[END])

    def pairs(self) -> np.ndarray:
        """Keys of (token before, token) at every place."""
        return pair_keys(self.hashes, self.before(), self.ids)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Block]:
    """Blocks of about `size` bytes of text; columns doc_id, text, fingerprint of the row, held_out."""
    keys, texts, total, extra = [], [], 0, []

    def tap(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            extra.extend(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            yield b

    for ids, some in rows(tap(batches), 1 << 20):
        keys += [(i, *e) for i, e in zip(ids, extra[: len(ids)], strict=True)]
        del extra[: len(ids)]
        texts += some
        total += sum(len(t) for t in some if t)
        if total >= size:
            yield _Block(keys, texts)
            keys, texts, total = [], [], 0
    if keys:
        yield _Block(keys, texts)


@dataclass(frozen=True)
class Settings:
    base: float = 1.5
    word_hashes: int = 10
    more_hashes: int = 4
    slack: float = 1e-3
    block_bytes: int = 6 << 20
    score_bytes: int = 2 << 20
    bucket_tokens: int = 800_000
    broadcast_bytes: int = 2 << 20

    def buckets(self, words: float) -> int:
        """Tasks' worths of a corpus of `words` words; beyond 1000 they are fewer and larger."""
        many = words / self.bucket_tokens
        return max(1, math.ceil(many / min(max(many / 1000, 1.0) ** 0.5, 4.0)))

    def depths(self, words: float) -> tuple[Depth, Depth]:
        """Of words and of pairs in a corpus of `words` words."""
        return Depth(1, self.word_hashes, self.more_hashes), Depth(2, pair_hashes(words, self.slack), self.more_hashes)


_COUNTED = "kind int, bucket int, block string, body binary"


def _by_bucket(order: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any of the sorted keys, and the places of its keys in their order."""
    bucket = bucket_of(order, keys, buckets)
    by = np.argsort(bucket.astype(np.uint16) if buckets <= 65_536 else bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    return ((k, by[a:b]) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < b)


def _count(settings: Settings, buckets: int):  # noqa: ANN202
    """Per block its rows and their tokens by number (kind 2, sent along in any bucket); per bucket its distinct words
    (kind 0) and pairs (kind 1) with their training counts, 0 if they occur in held out rows only.  A word sends one entry
    a block, however often it occurs, so frequent words do not fill a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for serial, b in enumerate(blocks(batches, settings.block_bytes)):
            name = f"{part}.{serial}"
            train_row = np.array([not k[2] for k in b.keys], bool)
            train = train_row[b.row]
            out: list[tuple] = []
            total = np.bincount(b.ids[train], minlength=len(b.tokens))
            number, at = np.empty(len(b.tokens), np.int64), 0  # tokens anew, by bucket: so their answers come in this order
            for k, own in _by_bucket(0, word_keys(b.hashes), buckets):
                out.append((0, k, name, _zip(np.frombuffer(b" ".join([b.tokens[i] for i in own.tolist()]), np.uint8), total[own].astype("<u4"))))
                number[own] = np.arange(at, at + len(own))
                at += len(own)
            keys, counts = _distinct(mixed(b.pairs()), train)
            edges = np.searchsorted(_range(keys >> U64(64 - FIRST_BITS), buckets), np.arange(buckets + 1)).tolist()
            out += [(1, k, name, _pack(keys[i:j], counts[i:j])) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i < j]
            doc, null, mark = _rows_of(b)
            body = _zip(doc, null, mark, (~train_row).astype(np.uint8), np.diff(b.starts).astype("<i8"), _planes(number[b.ids]))
            out.append((2, (part + serial) % buckets, name, body))
            del b, keys, counts, train
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["kind", "bucket", "block", "body"])

    return run


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs where `train` is set."""
    order = np.argsort(keys)
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], np.add.reduceat(train[order].astype(np.int64), edge)


_REDUCED = "kind int, bucket int, block string, body binary, n_train long, n_distinct long, mass double"


def _reduce(settings: Settings, words: float):  # noqa: ANN202
    """Of a words' bucket: each block's words' totals, levels and hashes (kind 0) and the words' segment (kind 10).  Of
    a pairs' bucket: each block's pairs' levels (kind 1), the pairs' segment (kind 11) and what the pairs of each first word
    keep in it (kind 12).  Blocks' rows pass through."""
    for_words, for_pairs = settings.depths(words)
    mean = expected(settings.base)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        bodies = table.column("body")
        out: list[tuple] = []
        if kind == 2:
            out = [(2, bucket, name, body.as_py(), 0, 0, 0.0) for name, body in zip(table.column("block").to_pylist(), bodies, strict=True)]
        elif kind == 1:
            got = [_unpack(b.as_py()) for b in bodies]
            edges = np.cumsum([0, *(len(g[0]) for g in got)])
            keys, counts = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            del got
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            keys, counts = keys[new], np.add.reduceat(counts, np.flatnonzero(new))
            keys, stored = unmixed(keys), counts > 1
            segment = build_segment(keys[stored], counts[stored], settings.base, for_pairs)
            level = read_back(segment, keys, for_pairs)
            out.append((11, bucket, "", segment, 0, 0, 0.0))
            if stored.any():
                first, inverse = np.unique(keys[stored] >> U64(SECOND_BITS), return_inverse=True)
                out.append((12, bucket, "", _zip(first.astype("<u8"), np.bincount(inverse, weights=kept(level[stored], mean))), 0, 0, 0.0))
            sent = np.empty(len(order), np.uint8)
            sent[order] = level[np.cumsum(new) - 1]
            out += [(1, bucket, name, _zip(sent[a:b]), 0, 0, 0.0) for name, a, b in zip(table.column("block").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        else:
            number, totals, held = Numbering(), np.zeros(0, np.int64), []
            for name, body in zip(table.column("block").to_pylist(), bodies, strict=True):
                names, total = _unzip(body.as_py(), "u1", "<u4")
                ids = np.fromiter(map(number.__getitem__, names.tobytes().split(b" ")), np.int64, len(total))
                if len(number) > len(totals):
                    totals = np.concatenate([totals, np.zeros(max(len(number) - len(totals), len(totals)), np.int64)])
                totals[ids] += total
                held.append((name, ids))
            totals = totals[: len(number)]
            met, hashes = totals > 0, token_hashes(list(number))
            keys = word_keys(hashes)
            segment = build_segment(keys[met], totals[met], settings.base, for_words)
            level = read_back(segment, keys, for_words)
            out += [(0, bucket, name, _zip(totals[ids].astype("<i8"), level[ids], hashes[ids].astype("<u8")), 0, 0, 0.0) for name, ids in held]
            out.append((10, bucket, "", segment, int(totals.sum()), int(met.sum()), float((mean[level[met]] + 0.1).sum())))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "bucket", "block", "body", "n_train", "n_distinct", "mass"), zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def kept(level: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """What a pair's count keeps of itself after the discount."""
    return np.maximum(mean[level] - 1.0, 0.0)


def _firsts(reduced: DataFrame, buckets: int) -> DataFrame:
    """kind (12), bucket, body: per bucket of words the sorted first_keys of pairs with all that these pairs keep."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                first, keep = _unzip(body.as_py(), "<u8", "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(_range(first, buckets).astype(np.int32)), pa.array(first.astype(np.int64)), pa.array(keep)], ["bucket", "first", "keep"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        first, inverse = np.unique(table.column("first").to_numpy(), return_inverse=True)
        body = _zip(first.astype("<u8"), np.bincount(inverse, weights=table.column("keep").to_numpy()))
        return pa.table({"kind": pa.array([12], pa.int32()), "bucket": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([body], pa.binary())})

    rows_ = reduced.where("kind = 12").select("body").mapInArrow(opened, "bucket int, first long, keep double")
    return rows_.groupBy("bucket").applyInArrow(summed, "kind int, bucket int, body binary")


def _with_kept(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket's answers to words (kind 0), each with K behind it; left: the bucket's K."""
    if not right.num_rows:
        return right
    first, keep = _unzip(left.column("body")[0].as_py(), "<u8", "<f8") if left.num_rows else (np.zeros(0, "<u8"), np.zeros(0))
    got = []
    for body in right.column("body"):
        totals, level, hashes = _unzip(body.as_py(), "<i8", "u1", "<u8")
        got.append(_zip(totals, level, hashes, look_up(first, keep, first_keys(hashes))))
    return right.set_column(right.schema.get_field_index("body"), "body", pa.array(got, pa.binary()))


_BASE = "doc_id long, fingerprint long, held_out boolean, n_tokens long, n_known long, log_sum double"


def _gather(mass: float, mean: np.ndarray, scored: bool):  # noqa: ANN202
    """The rows of one block, which meets the answers of all buckets; `scored`: with the score, for which words must have K
    and the pairs must have been answered."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, words, pairs = None, [], []
        for kind, bucket, body in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("body"), strict=True):
            if kind == 2:
                own = _unzip(body.as_py(), "<i8", "u1", "<i8", "u1", "<i8", "u1")
            elif kind == 1:
                pairs.append((bucket, body.as_py()))
            else:
                words.append((bucket, body.as_py()))
        doc, null, mark, held, n, planes = own
        starts = np.concatenate([[0], np.cumsum(n)])
        ids = _from_planes(planes, int(starts[-1]))
        opened = [_unzip(x, "<i8", "u1", "<u8", *(["<f8"] if scored else [])) for _, x in sorted(words, key=lambda w: w[0])]
        total, level, hashes, *after = (np.concatenate(x) for x in zip(*opened, strict=True))
        sums = lambda x: np.add.reduceat(x[ids], starts[:-1])  # noqa: E731  every text has a token
        out = {"doc_id": pa.array(doc, mask=null.astype(bool)), "fingerprint": mark, "held_out": pa.array(held.astype(bool)), "n_tokens": n, "n_known": sums((total > 0).astype(np.int64)), "log_sum": sums(np.log10(total + 0.1))}
        if scored:
            (after,), before = after, before_in_texts(ids, starts, ids[-1])
            inverse = np.unique(mixed(pair_keys(hashes, before, ids)), return_inverse=True)[1]
            pair = np.concatenate([_unzip(x, "u1")[0] for _, x in sorted(pairs, key=lambda p: p[0])])
            keep = np.where((after > 0)[before] & (level > 0)[ids], kept(pair, mean)[inverse], 0.0)
            out["score"] = np.add.reduceat(np.log10(probabilities(level, before, ids, after, keep, mass, mean)), starts[:-1])
        return pa.table(out)

    return run


@dataclass
class Model:
    """The whole filter (`data`, with first byte and bits of each bucket's segment, per order) and K by first_key."""

    data: np.ndarray  # uint8
    starts: list[np.ndarray]
    sizes: list[np.ndarray]
    first: np.ndarray  # sorted
    keep: np.ndarray
    mass: float
    settings: Settings
    words: float

    def levels(self, order: int, keys: np.ndarray) -> np.ndarray:
        return probe(self.data, self.starts[order], self.sizes[order], bucket_of(order, keys, len(self.starts[order])), keys, self.settings.depths(self.words)[order])

    def kept_after(self, first: np.ndarray) -> np.ndarray:
        return look_up(self.first, self.keep, first)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 where a key is absent."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def assemble(segments: Iterable, total: int, buckets: int, mass: float, settings: Settings, words: float) -> Model:
    """The model from its parts (kind, bucket, body), `total` bytes of segments, each part gone before the next comes."""
    starts, sizes = [np.zeros(buckets, np.int64) for _ in range(2)], [np.zeros(buckets, np.int64) for _ in range(2)]
    data, at, tables = np.zeros(total, np.uint8), 0, []
    for kind, bucket, body in segments:
        if kind == 12:
            tables.append((bucket, _unzip(body, "<u8", "<f8")))
            continue
        data[at : at + len(body)] = np.frombuffer(body, np.uint8)
        starts[kind - 10][bucket], sizes[kind - 10][bucket] = at, 8 * len(body)
        at += len(body)
    tables.sort(key=lambda x: x[0])
    first, keep = (np.concatenate([np.zeros(0, kind), *(t[i] for _, t in tables)]) for i, kind in enumerate(("<u8", "<f8")))
    return Model(data, starts, sizes, first, keep, mass, settings, words)


def probabilities(word: np.ndarray, before: np.ndarray, ids: np.ndarray, after: np.ndarray, keep: np.ndarray, mass: float, mean: np.ndarray) -> np.ndarray:
    """P(token | token before) at places: `word` levels and `after` K of each token, `keep` of the pair at each place."""
    single = (mean[word] + 0.1) / (mass + 0.1)
    rest = np.maximum(mean[word] - after, 1.0)
    after, rest = after[before], rest[before]
    return (np.minimum(keep, after) + rest * single[ids]) / (after + rest)


def _summed(b: _Block, word: np.ndarray, after: np.ndarray, keep: np.ndarray, mass: float, mean: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a block."""
    return np.add.reduceat(np.log10(probabilities(word, b.before(), b.ids, after, keep, mass, mean)), b.starts[:-1])


_SCORED = "fingerprint long, doc_id long, score double"


def _rows_of(b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, null, fingerprint of a block's rows."""
    return np.array([k[0] if k[0] is not None else 0 for k in b.keys], "<i8"), np.array([k[0] is None for k in b.keys], np.uint8), np.array([k[1] for k in b.keys], "<i8")


def _out(doc: np.ndarray, null: np.ndarray, mark: np.ndarray, got: np.ndarray) -> dict:
    return {"fingerprint": pa.array(mark, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool)), "score": pa.array(got)}


def _scorer(held):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        mean = expected(model.settings.base)
        for b in blocks(batches, model.settings.score_bytes):
            word = model.levels(0, word_keys(b.hashes))
            after = model.kept_after(first_keys(b.hashes))
            keep = np.zeros(len(b.ids))
            at = np.flatnonzero((after > 0)[b.before()] & (word > 0)[b.ids])
            keys, inverse = np.unique(b.pairs()[at], return_inverse=True)
            keep[at] = kept(model.levels(1, keys), mean)[inverse]
            yield pa.RecordBatch.from_pydict(_out(*_rows_of(b), _summed(b, word, after, keep, model.mass, mean)))

    return run


@dataclass
class _Learned:
    rows: DataFrame
    reduced: DataFrame
    parts: DataFrame  # kind 10 to 12, bucket, body
    n_train: int
    n_distinct: int
    mass: float
    n_bytes: int
    n_segments: int
    buckets: int
    words: float

    def model(self, settings: Settings) -> Model:
        """The whole model on the driver; n_bytes says how large it is."""
        return assemble(self.parts.coalesce(8).toLocalIterator(), self.n_segments, self.buckets, self.mass, settings, self.words)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> _Learned:  # noqa: B008
    """Counts, filter and K of the training rows, left in the shared folder."""
    docs = small_batches(docs)
    all_rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    all_rows = all_rows.withColumn("fingerprint", F.xxhash64("doc_id", "text")).withColumn("held_out", crc_of_id() % 10 == 0)
    n_rows, n_bytes = all_rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    words = n_bytes / 6 + n_rows  # a corpus has fewer distinct words than that
    buckets = settings.buckets(words)
    counted = all_rows.mapInArrow(_count(settings, buckets), _COUNTED)
    reduced = checkpointed_alone(counted.groupBy("kind", "bucket").applyInArrow(_reduce(settings, words), _REDUCED))
    parts = reduced.where("kind in (10, 11)").select("kind", "bucket", "body").unionByName(checkpointed(_firsts(reduced, buckets)))
    none = F.lit(0)
    n_train, n_distinct, mass = reduced.where("kind = 10").agg(F.coalesce(F.sum("n_train"), none), F.coalesce(F.sum("n_distinct"), none), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
    size, n_segments = parts.agg(F.coalesce(F.sum(F.octet_length("body")), none), F.coalesce(F.sum(F.when(F.col("kind") < 12, F.octet_length("body"))), none)).first()
    return _Learned(all_rows, reduced, parts, int(n_train), int(n_distinct), float(mass), int(size), int(n_segments), buckets, words)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`."""
    got = learn(docs, id_col, text_col, settings)
    answers = got.reduced.where("kind in (0, 1, 2)").select("kind", "bucket", "block", "body")
    mean, by_shuffle = expected(settings.base), got.n_bytes > settings.broadcast_bytes
    if by_shuffle:
        kept_after = got.parts.where("kind = 12").groupBy("bucket").cogroup(answers.where("kind = 0").groupBy("bucket"))
        joined = answers.where("kind > 0").unionByName(kept_after.applyInArrow(_with_kept, _COUNTED)).groupBy("block").applyInArrow(_gather(got.mass, mean, True), f"{_BASE}, score double")
    else:
        base = answers.where("kind <> 1").groupBy("block").applyInArrow(_gather(got.mass, mean, False), _BASE)
        held = got.rows.sparkSession.sparkContext.broadcast(got.model(settings))
        scored = got.rows.select("doc_id", "text", "fingerprint", "held_out").mapInArrow(_scorer(held), _SCORED)
        scored = scored.groupBy("fingerprint", "doc_id").agg(F.max("score").alias("score"))  # repeated rows have one score
        joined = base.join(scored.withColumnRenamed("doc_id", "_doc").withColumnRenamed("fingerprint", "_mark"), (F.col("fingerprint") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    norm = math.log10(got.n_train + 0.1 * (got.n_distinct + 1))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(got.n_train).cast("long").alias("train_tokens"), (F.col("log_sum") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
