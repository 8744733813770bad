"""The corpus pipeline: stage contracts, and the kept documents against brute force."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from larchspan.llm import quality_cascade
from tests.llm.test_operators import ODD, SCHEMA, fingerprint_by_hand

SF = "/root/testdata/sf0.001"


def stages(spark, docs, tmp_path, upto=None):
    out = []
    for name, stage in corpus_pipeline.STAGES[:upto]:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, exact, near, mixed, packed = stages(spark, docs, tmp_path)
    for d in (quality, exact, near, mixed):
        assert d.columns == docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    t = quality_cascade.Texts([x.encode() if x else None for x in rows.values()])
    bad = quality_cascade.cascade(t, list(quality_cascade.RULES))
    want = {i: x for (i, x), b in zip(rows.items(), bad, strict=True) if not b}
    assert {r.doc_id for r in quality.collect()} == set(want)
    groups: dict = {}
    for i, x in sorted(want.items()):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", x or ""), []).append((-len(x or ""), i))
    want = {min(g)[1]: want[min(g)[1]] for g in groups.values()}
    assert {r.doc_id for r in exact.collect()} == set(want)
    ids = sorted(want)
    f = np.array([fingerprint_by_hand(want[i]) for i in ids], np.uint64)
    link, comp = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, np.array(ids)
    while (new := np.array([comp[link[k]].min() for k in range(len(ids))])).tolist() != comp.tolist():
        comp = new
    assert {r.doc_id for r in near.collect()} == set(comp.tolist())
    assert {r.doc_id for r in mixed.collect()} <= set(comp.tolist())
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    pieces = {r.doc_id: (r.s, r.t) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("s"), F.max("doc_tokens").alias("t")).collect()}
    assert {i: s // t for i, (s, t) in pieces.items()} == copies


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    odd = spark.createDataFrame([*ODD, *[(100 + i, "clean words in a plain sentence that goes on for long enough to pass rules, number %d of them all, and more." % i, "en", "a", 90) for i in range(5)]], SCHEMA)
    (tmp_path / "a").mkdir()
    assert stages(spark, odd, tmp_path / "a")[-1].count() > 0
    (tmp_path / "b").mkdir()
    assert [d.count() for d in stages(spark, spark.createDataFrame([], SCHEMA), tmp_path / "b")] == [0] * 5
