"""Winnowing against its definition."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from cohortloom.llm import fingerprints as f
from tests.llm.plain import EDGE_TEXTS, edge_docs, empty_docs


def test_picks_are_the_rightmost_least_of_every_window():
    draw = np.random.Generator(np.random.PCG64(1))
    for n, w in [(0, 4), (1, 4), (3, 4), (50, 4), (500, 40), (500, 1)]:
        hashes = draw.integers(0, 9, n).astype(np.uint64) << np.uint64(40)
        want = set()
        for at in range(max(1, n - w + 1) if n else 0):
            window = hashes[at : at + w].tolist()
            want.add(at + max(i for i, h in enumerate(window) if h == min(window)))
        assert set(f.winnow(hashes, w).tolist()) == want


def test_segments_give_the_same_picks(monkeypatch):
    hashes = np.random.Generator(np.random.PCG64(2)).integers(0, 1 << 63, 5000).astype(np.uint64)
    whole = f.winnow(hashes, 40)
    monkeypatch.setattr(f, "_SEGMENT", 64)
    assert np.array_equal(f.winnow(hashes, 40), whole)


def test_a_shared_passage_shares_a_hash_at_the_same_place():
    draw = random.Random(3)
    passage = "".join(chr(draw.randrange(97, 123)) for _ in range(f.K + f.WINDOW - 1))
    for _ in range(50):
        texts = ["".join(chr(draw.randrange(97, 123)) for _ in range(draw.randint(0, 200))) for _ in range(4)]
        a, b = texts[0] + passage + texts[1], texts[2] + passage + texts[3]
        (ha, pa), (hb, pb) = f.fingerprint(a), f.fingerprint(b)
        places = {(h, p - len(texts[0])) for h, p in zip(ha.tolist(), pa.tolist())}
        assert places & {(h, p - len(texts[2])) for h, p in zip(hb.tolist(), pb.tolist())}


def test_edge_rows(spark):
    rows = f.edit_and_next(edge_docs(spark)).collect()
    order = sorted(EDGE_TEXTS, key=lambda row: row[1] or "")
    order.sort(key=lambda row: -(1 << 63) if row[0] is None else row[0], reverse=True)
    # Rows with equal ids are alike here, so their order does not matter.
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == sorted(want, key=repr)
    by_text = {}
    for row in rows:
        text = dict(EDGE_TEXTS)[row.doc_id] or ""
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert f.edit_and_next(empty_docs(spark)).collect() == []
    single = f.edit_and_next(edge_docs(spark, [(7, "abcd")])).collect()
    assert [(r.edited_sha256, r.near_next) for r in single] == [(hashlib.sha256(b"abab").hexdigest(), 1.0)]


def test_documents(spark):
    rows = {r.doc_id: r for r in f.document_fingerprints(edge_docs(spark)).collect()}
    assert rows[1].hashes == rows[2].hashes == []
    assert len(rows[3].hashes) == 1 and rows[4].hashes == rows[5].hashes
    assert len(rows[6].positions) > len(EDGE_TEXTS[5][1]) / f.WINDOW
