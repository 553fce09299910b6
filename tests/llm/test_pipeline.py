"""The registered corpus queries and the pipeline on the smallest data, and each stage against brute force."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

import __spark_entry__
import corpus_pipeline
from leafmill.llm import QUERIES
from leafmill.session import stored

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "byte-level BPE"]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op9")])
def test_whole_table(spark, name):
    t = "pages" if name.startswith(("op3", "op4")) else "documents"
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{t}.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for stage, f in corpus_pipeline.STAGES:
        before, docs = texts, stored(f(spark, docs, DATA), "stage")
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        texts = {r.doc_id: r.text for r in rows}
        kept[stage] = (before, texts)
        assert docs.columns[: len(names)] == names and all(r.n_chars == len(r.text) for r in rows)
    before, after = kept["quality rules"]
    assert all(not H.quality(before[d])[-1] for d in after)
    before, after = kept["n-gram Jaccard join"]
    assert sorted(after) == sorted({c for _, _, c in H.groups(list(before.items()))})
    before, after = kept["substring dedup"]
    removed = {d: (n, gone) for d, n, gone, _ in H.substring(list(before.items()))}
    assert sorted(after) == [d for d in sorted(before) if removed[d][1] == 0 or removed[d][1] < removed[d][0]]
    assert all((after[d] == before[d]) == (removed[d][1] == 0) for d in after)
    before, after = kept["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = {d: (n, hit) for d, n, hit, *_ in H.decontam(list(before.items()), items)}
    assert sorted(after) == [d for d in sorted(before) if not hits[d][1] or hits[d][1] < 0.5 * hits[d][0]]
    assert all((after[d] == before[d]) == (hits[d][1] == 0) for d in after)
    assert "ids" in docs.columns and all(r.ids for r in rows if r.text)
    assert H.ordered(tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "text").collect()) == H.ordered(texts.items())


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, ties, clashing columns and an empty table go through all stages."""
    words = lambda k: ". ".join(f"word{k}x{i} and more{i * k}" for i in range(60)) + "."
    rows = [(1, words(1)), (1, words(1)), (2, words(2)), (3, words(2)), (None, words(3)), (None, None), (4, None), (5, ""), (6, " \n "), (7, words(7) + "\n" + "x" * 5000 + "."), (8, "short text.")]
    data = [(d, t, "en", 1, "k", None if t is None else len(t), [7]) for d, t in rows]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, chunk int, rh string, n_chars bigint, ids array<int>")
    none = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs, none = stored(f(spark, docs, DATA), "odd"), stored(f(spark, none, DATA), "none")
        assert none.count() == 0 and none.columns == docs.columns
    out = docs.collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "7", "None"] and all(r.ids and r.lang == "en" and r.chunk == 1 and r.rh == "k" and r.n_chars == len(r.text) for r in out)
