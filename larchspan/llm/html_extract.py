"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks (`html_blocks`); the model labels each as main text or not from its ancestors
and its looks, with the best labelling of the whole page found by Viterbi.  It is trained on the driver, from the
labelled pages of `labelled_pages`, and sent to the workers as a broadcast of a few kilobytes.

Defined cases: a null or empty page gives an empty text; so does a page without text or without main text.  Repeated
rows give repeated rows.  White space is what Unicode calls so (a no-break space too becomes one space); the content of
script, style, template, object, svg, canvas and the like is no text.  A page is held by one task at a time, whatever its length; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from larchspan.llm import html_blocks, labelled_pages
from larchspan.llm.common import rows, small_batches
from larchspan.llm.crf import ChainCRF

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_main int"


@cache
def model(n_pages: int = 400, seed: int = 11) -> ChainCRF:
    """Label 1 is main text."""
    sequences, labels = [], []
    for i in range(n_pages):
        html, main = labelled_pages.page(seed * 100_003 + i)
        found = html_blocks.blocks(html)
        sequences.append(html_blocks.features(found))
        labels.append([int(any(a <= begin < b for a, b in main)) for *_, begin in found])
    return ChainCRF.train(sequences, labels, html_blocks.N_FEATURES, 2, epochs=80, l2=1e-4)


def main_blocks(crf: ChainCRF, pages: list[str]) -> list[tuple[int, list[str]]]:
    """For each page the number of its blocks and the texts of those that are main text."""
    found = [html_blocks.blocks(p) for p in pages]
    paths = crf.viterbi([html_blocks.features(f) for f in found])
    return [(len(f), [b[0] for b, y in zip(f, path, strict=True) if y]) for f, path in zip(found, paths, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", crf: ChainCRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks, n_main for each row of `pages`; no shuffle."""
    held = pages.sparkSession.sparkContext.broadcast(crf or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(2).to_pylist()
            done = 0
            for ids, html in rows(iter([batch]), 2 << 20):
                got = main_blocks(held.value, [(h or b"").decode("utf-8", "replace") for h in html])
                texts = ["\n".join(t) for _, t in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(urls[done : done + len(ids)], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for n, _ in got], pa.int32()), pa.array([len(t) for _, t in got], pa.int32())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )
                done += len(ids)

    pages = small_batches(pages)
    chosen = pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].cast("string").alias("html"), pages[url_col].cast("string").alias("url"))
    return chosen.mapInArrow(run, SCHEMA)
