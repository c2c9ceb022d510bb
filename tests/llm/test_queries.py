"""What must hold of the queries that SQL can't express, over whole tables."""

from __future__ import annotations

from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from bytegrove.llm.leakage import passage
from bytegrove.llm.queries import QUERIES
from bytegrove.llm.textnorm import tokens


@pytest.fixture(scope="module")
def docs(sf_dir):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def test_leaks_are_those_of_aligning_everything(spark, sf_dir, docs):
    items = {r["item_id"]: tokens(r["text"]) for r in pq.read_table(f"{sf_dir}/eval_items.parquet", columns=["item_id", "text"]).to_pylist()}
    want = {(d, i): hit for d, t in docs.items() if t for b in [tokens(t)] for i, a in items.items() for hit in [passage(a, b, 0.4, 0.75)] if hit}
    got = {(r.doc_id, r.item_id): (r.span_tokens, r.matched_tokens) for r in QUERIES["p7_documents"](spark, sf_dir).collect()}
    assert want and got.keys() == want.keys()
    assert {tuple(r) for r in QUERIES["p7_found"](spark, sf_dir).collect()} == set(got)


def test_sentences_cover_each_text_in_order(spark, sf_dir, docs):
    by = defaultdict(list)
    for r in QUERIES["p8_sentences"](spark, sf_dir).collect():
        assert docs[r.doc_id][r.start_pos : r.end_pos] == r.sentence and r.sentence == r.sentence.strip() != ""
        by[r.doc_id].append((r.ord, r.start_pos, r.end_pos))
    for d, t in docs.items():
        spans = [x[1:] for x in sorted(by[d])]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        covered = {i for a, b in spans for i in range(a, b)}
        assert all(i in covered or c.isspace() for i, c in enumerate(t or ""))
    found = {tuple(r) for r in QUERIES["p8_found"](spark, sf_dir).collect()}
    assert found == {(d, a, b) for d, xs in by.items() for _, a, b in xs}


def test_oversized_documents_are_those_that_were_cut(spark, sf_dir):
    parts = defaultdict(int)
    for r in QUERIES["p6_packing"](spark, sf_dir).collect():
        parts[r.doc_id] += 1
    assert {r.doc_id for r in QUERIES["p6_found"](spark, sf_dir).collect()} == {d for d, n in parts.items() if n > 1}
