"""op2 without a broadcast: what blocks and buckets exchange stays small, and the texts are read once."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from larchspan.llm import lm_bloom


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(i % 40))) for i in range(400)]
    return spark.createDataFrame([*rows, (400, None), (None, "W1 w2 w3"), (7, rows[7][1])], "doc_id long, text string").repartition(3)


def test_buckets_answer_what_they_are_sent(documents):
    """Every block's pairs come back with levels from the tasks that build the segments, with no second reading."""
    settings = replace(lm_bloom.Settings(), block_bytes=3000, bucket_tokens=500)
    got = lm_bloom.learn(documents, settings=settings).reduced.where("kind in (0, 1, 2)").select("kind", "block", "body").collect()
    assert len({r.block for r in got if r.kind == 2}) == 3
    assert {r.block for r in got if r.kind == 1} == {r.block for r in got if r.kind == 2}
    level = np.concatenate([lm_bloom._unzip(bytes(r.body), "u1")[0] for r in got if r.kind == 1])
    assert (level == 0).any() and (level >= 2).any() and not (level == 1).any()


def test_scores_of_both_ways_and_of_any_blocks(documents):
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6), round(r.score, 6))
    for tokens in (500, 800_000):
        cast = replace(lm_bloom.Settings(), bucket_tokens=tokens, broadcast_bytes=1 << 30)
        want = sorted(map(key, lm_bloom.score(documents, settings=cast).collect()))
        assert len(want) == 403
        for n in (1, 9):
            assert sorted(map(key, lm_bloom.score(documents.repartition(n), settings=replace(cast, broadcast_bytes=0)).collect())) == want


def test_what_is_sent_a_pair():
    """Below 6.5 bytes a pair of a block, of 64 bits, whatever the number of buckets."""
    keys = np.sort(np.random.default_rng(5).integers(0, 2**64, 600_000, np.uint64))
    for buckets in (1, 200, 2000):
        edges = np.searchsorted(lm_bloom._range(keys >> np.uint64(34), buckets), np.arange(buckets + 1))
        parts = [lm_bloom._pack(keys[a:b], np.ones(b - a, np.int64)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert sum(map(len, parts)) < 6.5 * len(keys)
        assert (np.concatenate([lm_bloom._unpack(p)[0] for p in parts]) == keys).all()
    assert (lm_bloom.unmixed(lm_bloom.mixed(keys)) == keys).all()


def test_pieces_grow_less_than_the_square():
    one, five = (lm_bloom.Settings().buckets(w) for w in (1.7e9, 8.5e9))
    assert five < 3 * one and lm_bloom.Settings().buckets(0) == 1
