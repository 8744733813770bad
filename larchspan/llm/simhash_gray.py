"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits, each 1 if set in over half of the XXH64 values of the text's word shingles, over the whole text.
Equal fingerprints are one node from the start (a partial aggregate), so groups of copies of any size stay one row.

Search: of three parts of the 64 bits, two fingerprints that differ in at most 2 bits agree on at least one.  All
fingerprints are dealt three times, by some bits of each part: as many bits as make buckets of about `fill` fingerprints,
so a bucket is a large set at any size of the corpus (few fingerprints are a single bucket).  In a bucket they are sorted
by Gray rank, and runs of 16 share an upper node, that holds the bits on which they agree (mask and pattern), level over
level.  All fingerprints of a bucket are searched at once, from the root down: a node whose pattern differs from the
query in over 2 masked bits is pruned with all below it, and the differences found on the way carry over
(`search_report` counts the nodes).  A bucket hands on a spanning forest of its links, so never more rows than
fingerprints.  A bucket over `hot` fingerprints is dealt again, by all bits of its part, and then by thirds of the bits
that are still free, until no bucket is hot or `LEAST_FREE` bits are left, which bounds it.

Components of the forest are found by joins (`graph`); nothing is collected.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links like any other; one with fewer
words than a shingle is one shingle; repeated rows are repeated in the result; null identifiers take part but are
smaller than none (a component of null identifiers only has a null component); an empty table gives an empty result;
columns of any name pass through `keep_first` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchspan.llm.common import lower_words, rows, small_batches
from larchspan.llm.exact_dedup import BROADCAST_ROWS, located, without
from larchspan.operators.graph import components
from larchspan.session import checkpointed, scratch

FANOUT = 16
LEAST_FREE = 20


def fingerprint(words: list[bytes], size: int = 3) -> int:
    """The fingerprint of a word sequence, unsigned."""
    import xxhash

    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    if n <= size:
        return xxhash.xxh64_intdigest(text, 42)
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    begins = (ends - length)[: n - size + 1].tolist()
    digest, ends = xxhash.xxh64_digest, ends[size - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(begins), 1 << 16):
        h = b"".join([digest(text[a:b], 42) for a, b in zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)  # bits from the highest down
    return int.from_bytes(np.packbits(2 * counts > n - size + 1).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row, and the columns named in `carry`; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in rows(iter([batch])):
                got = np.array([fingerprint(lower_words(t), shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got), *(batch.column(2 + i).slice(at, len(ids)) for i in range(len(carry)))], ["doc_id", "fp", *carry])
                at += len(ids)

    docs = small_batches(docs)
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c] for c in carry])
    kinds = dict(docs.dtypes)
    return chosen.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} {kinds[c]}" for c in carry)]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchy over distinct fingerprints: level 0 holds the fingerprints in Gray order, each upper level one
    (mask, pattern) per run of FANOUT nodes; an upper node keeps only bits that no node above it holds already."""

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order].astype(np.uint64)
        masks, patterns = [np.full(len(codes), ~np.uint64(0))], [self.codes]
        while len(masks[-1]) > 1:
            starts = np.arange(0, len(masks[-1]), FANOUT)
            both = np.bitwise_and.reduceat(masks[-1], starts)
            ones = np.bitwise_and.reduceat(patterns[-1], starts)
            zeros = np.bitwise_and.reduceat(~patterns[-1], starts)
            mask = both & (ones | zeros)
            masks.append(mask)
            patterns.append(ones & mask)
        for i in range(len(masks) - 1):  # a bit that is factored into an upper node is not compared again below it
            masks[i] = masks[i] & ~np.repeat(masks[i + 1], FANOUT)[: len(masks[i])]
        self.masks, self.patterns = masks, patterns
        self.visited = self.pruned = 0  # nodes that a search has met, and those of them that it went no further from

    def search(self, queries: np.ndarray, most: int, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, numbers of indexed codes) within `most` bits; a block of queries that could meet `cells` codes at a time."""
        block = max(1, cells // max(1, len(self.codes)))
        for at in range(0, len(queries), block):
            q = queries[at : at + block].astype(np.uint64)
            who = np.repeat(np.arange(len(q)), len(self.masks[-1]))
            node = np.tile(np.arange(len(self.masks[-1])), len(q))
            spent = np.bitwise_count((q[who] ^ self.patterns[-1][node]) & self.masks[-1][node])
            ok = spent <= most
            self.visited, self.pruned = self.visited + len(ok), self.pruned + int((~ok).sum())
            who, node, spent = who[ok].astype(np.int32), node[ok].astype(np.int32), spent[ok]
            for level in range(len(self.masks) - 2, -1, -1):
                n = len(self.masks[level])
                first = node * FANOUT
                count = np.minimum(first + FANOUT, n) - first
                who, spent = np.repeat(who, count), np.repeat(spent, count)
                node = np.repeat(first - (np.cumsum(count, dtype=np.int32) - count), count) + np.arange(int(count.sum()), dtype=np.int32)
                spent = spent + np.bitwise_count((q[who] ^ self.patterns[level][node]) & self.masks[level][node])
                ok = spent <= most
                self.visited, self.pruned = self.visited + len(ok), self.pruned + int((~ok).sum())
                who, node, spent = who[ok], node[ok], spent[ok]
            yield who + at, self.order[node]


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number reachable from each of n nodes over edges a-b, and nothing else: hooking and shortcutting."""
    root = np.arange(n) if parent is None else parent
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        live = low != high
        if not live.any():
            return root
        np.minimum.at(root, high[live], low[live])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def bucket_links(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, GrayIndex]:
    """A spanning forest of the links among distinct codes: each code but its group's first, and that first; and the
    index that found it."""
    index = GrayIndex(codes)
    root = np.arange(len(codes))
    for who, other in index.search(codes, most):
        up = who < other
        if up.any():
            root = forest(len(codes), who[up], other[up], root)
    at = np.flatnonzero(root != np.arange(len(codes)))
    return codes[at], codes[root[at]], index


def _parts(bits: list[int]) -> list[list[int]]:
    """Three parts of like size."""
    k, over = divmod(len(bits), 3)
    edges = [0, k + (over > 0), 2 * k + over, len(bits)]
    return [bits[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _mask(bits: list[int]) -> int:
    """The mask of some bits, as a signed long."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _dealt(df: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, mask, key): each fingerprint once for every mask."""
    return df.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def buckets(nodes: DataFrame, fill: int = 4096, hot: int = 65_536) -> DataFrame:
    """(fp, mask, key): distinct fingerprints in buckets such that any two within 2 bits share one."""
    n = nodes.count()
    if n <= fill:
        return _dealt(nodes, [0])
    parts = _parts(list(range(64)))
    wide = min(min(map(len, parts)), (n // fill).bit_length())
    now = _dealt(nodes, [_mask(p[:wide]) for p in parts])
    # the bits on which a bucket's fingerprints may be taken to agree, and the masks that a hot one is dealt by next
    level = {_mask(p[:wide]): [p] for p in parts}
    out = None
    while level:
        sizes = checkpointed(now.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > hot) & F.col("mask").isin(*level)).select("mask", "key"))
        n_hot = sizes.count()
        if not n_hot:
            break
        sizes = F.broadcast(sizes) if n_hot <= BROADCAST_ROWS else sizes
        cool = now.join(sizes, ["mask", "key"], "left_anti").select("fp", "mask", "key")
        out = cool if out is None else out.unionByName(cool)
        held, following, again = now.join(sizes, ["mask", "key"], "left_semi"), {}, []
        for mask, choices in level.items():
            for agreed in choices:
                free = [b for b in range(64) if b not in agreed]
                following[_mask(agreed)] = [agreed + p for p in _parts(free)] if len(free) > LEAST_FREE else []
            again.append(_dealt(held.where(F.col("mask") == mask).select("fp"), [_mask(c) for c in choices]))
        now = again[0]
        for x in again[1:]:
            now = now.unionByName(x)
        level = {m: c for m, c in following.items() if c}
    return now if out is None else out.unionByName(now)


_FOUND = "a long, b long"
_REPORT = "mask long, key long, n long, visited long, pruned long"


def _searched(dealt: DataFrame, most: int, report: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may span batches."""
        held: list[np.ndarray] = []
        last = None
        out: list[tuple] = []

        def close() -> None:
            if held:
                codes = np.unique(np.concatenate(held))
                held.clear()
                if len(codes) > 1:
                    a, b, index = bucket_links(codes, most)
                    out.append(tuple(np.array([x], np.int64) for x in (*last, len(codes), index.visited, index.pruned)) if report else (a.view(np.int64), b.view(np.int64)))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in (_REPORT if report else _FOUND).split(", ")])

        for batch in batches:
            fp, mask, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            edge = np.ones(len(fp), bool)
            edge[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
            begins = np.flatnonzero(edge).tolist()
            for a, b in zip(begins, [*begins[1:], len(fp)], strict=True):
                if (int(mask[a]), int(key[a])) != last:
                    close()
                    last = (int(mask[a]), int(key[a]))
                held.append(fp[a:b].view(np.uint64))
            if sum(len(x[0]) for x in out) > 50_000:
                yield flush()
        close()
        if out:
            yield flush()

    return dealt.select("fp", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, _REPORT if report else _FOUND)


def links(nodes: DataFrame, most: int = 2, fill: int = 4096, hot: int = 65_536) -> DataFrame:
    """(a, b): edges that join just the fingerprints (`fp`, distinct) within `most` <= 2 bits of each other."""
    if most > 2:
        raise ValueError("buckets of a third of the bits find differences of at most 2 bits")
    return _searched(buckets(nodes, fill, hot), most, False)


def search_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2, fill: int = 4096, hot: int = 65_536) -> DataFrame:
    """mask, key, n, visited, pruned: per bucket its fingerprints, the nodes that its search met, and those it pruned."""
    return _searched(buckets(checkpointed(fingerprints(docs, id_col, text_col, shingle).select("fp").distinct()), fill, hot), most, True)


def _roots(prints: DataFrame, most: int, fill: int, hot: int) -> DataFrame:
    """fp, least (smallest doc_id), n, root (the fingerprint that stands for the component)."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp"), most, fill, hot))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2, fill: int = 4096, hot: int = 65_536) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, component_size of every row of `docs`."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    placed = _roots(prints, most, fill, hot)
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    classes = placed.join(heads, "root").select("fp", "component_id", "component_size")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2, fill: int = 4096, hot: int = 65_536) -> DataFrame:
    """One row of each component, with all columns of `docs`: that of the smallest identifier (a null one is larger
    than any; of rows that repeat it, the first in its file)."""
    placed, file, row = located(docs, text_col)
    prints = checkpointed(fingerprints(placed, id_col, text_col, shingle, (file, row)).toDF("doc_id", "fp", "file", "row"))
    with_root = prints.join(_roots(prints, most, fill, hot).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    heads = with_root.groupBy("root").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = with_root.join(heads, "root").where((F.col("file") != F.col("head.file")) | (F.col("row") != F.col("head.row")))
    return without(placed, file, row, several.select("file", "row"), scratch(docs.sparkSession, "near-gone")).select(*[placed[c] for c in docs.columns])
