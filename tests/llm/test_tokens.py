"""Token files, prefix encoding, counts and packing against the libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from cohortloom.llm import packing, prefix_bpe, token_counts, token_files
from cohortloom.llm.common import ByteMemo
from cohortloom.llm.library_tokens import LibraryEncoder, _laid
from cohortloom.session import tuned
from tests.llm.plain import EDGE_TEXTS, edge_docs, empty_docs

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def scripts():
    """Texts that hold every code point of the lower planes once, and runs of spaces of all kinds."""
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 97]) for i in range(0, len(points), 97)]
    draw = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\xa0", " ", "\x1d", "a", "É", "'s", "'", "9", "!", "…", "日", "́"]
    return texts + ["".join(draw.choice(alphabet) for _ in range(60)) for _ in range(300)]


@pytest.mark.parametrize("path, drops_space", [(BYTES, False), (WORDS, True)])
def test_library_encoder_equals_the_library(path, drops_space):
    encoder, whole = LibraryEncoder(path, drops_space), Tokenizer.from_file(path)
    for text in scripts() + [text or "" for _, text in EDGE_TEXTS]:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want, text


def test_counts_equal_the_library(spark):
    counter = token_counts.counter_for(BYTES, PATTERN)
    whole = Tokenizer.from_file(BYTES)
    for text in scripts():
        assert counter.count(text) == len(whole.encode(text, add_special_tokens=False).ids), text
    got = token_counts.token_counts(edge_docs(spark), BYTES, PATTERN).collect()
    want = [(i, len((t or "").encode()), len(library(BYTES, t)), len(library(BYTES, t)) > 512) for i, t in EDGE_TEXTS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(empty_docs(spark), BYTES, PATTERN).collect() == []


def test_prefix_table(ranks):
    encoder, draw = prefix_bpe.PrefixEncoder(ranks), random.Random(7)
    tokens = list(ranks)
    for _ in range(200):
        data = b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 12)))
        table = encoder.extend(data, [])
        assert [encoder.bytes_of[t] for t in encoder.tokens(table)] == encoder._merged(data)
        cut = draw.randint(0, len(data))
        assert encoder.extend(data, encoder.extend(data[:cut], [])) == table  # appended
        a = draw.randint(0, len(data))
        b = draw.randint(a, len(data))
        changed, fresh = encoder.replace(data, list(table), a, b, draw.choice(tokens))
        assert fresh == encoder.extend(changed, [])


def test_prefix_encoding_equals_the_library(spark, ranks):
    own = prefix_bpe.TextEncoder(ranks, PATTERN)
    library_ = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in scripts():
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library_.encode_ordinary(text), text
        assert own.decode(ids).decode() == text

    def want(text):
        ids = np.array(library_.encode_ordinary(text), "<u4").tobytes()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    got = prefix_bpe.round_trip(edge_docs(spark), RANKS, PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *want(t or "")) for i, t in EDGE_TEXTS), key=repr)
    encoded = prefix_bpe.encoded_texts(edge_docs(spark), RANKS, PATTERN)
    back = prefix_bpe.decoded_texts(encoded, RANKS, PATTERN).collect()
    assert sorted(bytes(row.data) for row in back) == sorted((t or "").encode() for _, t in EDGE_TEXTS)
    assert prefix_bpe.round_trip(empty_docs(spark), RANKS, PATTERN).collect() == []


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(edge_docs(spark), path, BYTES, end_id=0, files=3)
    rows = token_files.token_file_report(spark, path).collect()
    order = sorted(EDGE_TEXTS, key=lambda row: (row[0] is not None, row[0] or 0, row[1] or ""))
    at, want = 0, []
    for doc_id, text in order:
        ids = [*library(BYTES, text), 0]
        want.append((doc_id, at, len(ids), ids_crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda row: row[1]) == want
    found = token_files.read_documents(spark, path, [13, 99])
    assert [row.doc_id for row in found.collect()] == [13]
    assert "In(doc_id" in found._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [In(doc_id", "In(doc_id")
    token_files.write_token_files(empty_docs(spark), path, BYTES, end_id=0, files=3)
    assert token_files.token_file_report(spark, path).collect() == []


def test_packing(spark):
    pieces = packing.piece_digests(packing.packed_pieces(edge_docs(spark), WORDS, size=256)).collect()
    tokens = sorted((i, len(library(WORDS, t)) + 1) for i, t in EDGE_TEXTS if i is not None)
    by_document = defaultdict(list)
    by_sequence = defaultdict(list)
    for row in pieces:
        by_document[row.doc_id].append(row)
        by_sequence[row.sequence_id].append((row.offset, row.length))
    assert sorted((i, n) for i, rows in by_document.items() if i is not None for n in [row.doc_tokens for row in rows if row.start == 0]) == tokens
    texts = dict(EDGE_TEXTS)
    for doc_id, rows in by_document.items():
        ids = [*library(WORDS, texts[doc_id]), 1]
        for row in rows:
            assert row.ids_crc32 == ids_crc(ids[row.start : row.start + row.length])
        copies = sum(i == doc_id for i, _ in EDGE_TEXTS)
        assert sorted(x for row in rows for x in range(row.start, row.start + row.length)) == sorted(list(range(len(ids))) * copies)
    lengths = []
    for number in sorted(by_sequence):
        at = 0
        for offset, length in sorted(by_sequence[number]):
            assert offset == at
            at += length
        lengths.append(at)
    assert sorted(by_sequence) == list(range(len(lengths))) and set(lengths[:-1]) == {256}
    assert packing.packed_pieces(empty_docs(spark), WORDS).collect() == []


def test_hilbert_curve_visits_every_point_by_steps_of_one():
    bits = 3
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    along = points[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_one_id_on_a_third_of_the_rows_is_parted(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = [(None if i % 3 == 0 else i, f"text {i % 700} of some words") for i in range(6000)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), path, BYTES, 0, files=12)
    sizes = sorted(r["count"] for r in token_files.read_token_files(spark, path).groupBy("part").count().collect())
    assert sum(sizes) == 6000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    report = token_files.token_file_report(spark, path).orderBy("start").collect()
    assert [r.start for r in report] == np.cumsum([0, *[r.n_tokens for r in report]])[:-1].tolist()
    ids = [r.doc_id for r in report]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_memo_is_bounded_by_bytes(spark):
    from cohortloom.llm.common import ByteMemo

    memo, asked = ByteMemo(room=100_000), []

    def compute(names):
        asked.extend(names)
        return [name.encode() for name in names]

    draw = random.Random(3)
    for _ in range(300):
        names = [f"word {draw.randrange(3000)}" for _ in range(50)] + ["x" * 1000]
        assert memo.values(names, compute) == [name.encode() for name in names]
        held = [*memo.new.items(), *memo.old.items()]
        assert sum(200 + len(k) + len(v) for k, v in held) <= 150_000 and all(len(k) <= 64 for k, _ in held)
    assert len(asked) < 300 * 50


def test_memo_asks_for_missing_texts_once_and_in_their_order():
    """Texts lie in memory in their order: hundreds of thousands of them are not to be visited in that of a set."""
    asked = []

    def compute(names):
        asked.append(list(names))
        return [name.encode() for name in names]

    memo = ByteMemo(room=100_000, longest=6)
    names = [f"w{i}" for i in range(1000)]  # enough to be set aside as the older generation
    assert memo.values(names, compute) == [name.encode() for name in names] and asked == [names]
    again = ["new", "w7", "longer than kept", "new", "w3", "w999", "last"]
    assert memo.values(again, compute) == [name.encode() for name in again]
    assert asked[1:] == [["new", "longer than kept", "last"]]
    assert memo.values(["longer than kept", "w7", "last"], compute) == [b"longer than kept", b"w7", b"last"]
    assert asked[2:] == [["longer than kept"]]


def test_ids_are_laid_out_in_little_more_than_their_own_memory():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 9, 1000)
    values = rng.integers(0, 50_000, sizes.sum()).astype("<u4")
    which = rng.integers(0, 1000, 400_000)
    tracemalloc.start()
    ids, edges = _laid(values, sizes, which)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * (ids.nbytes + edges.nbytes)
    starts = np.cumsum(sizes) - sizes
    expected = [values[starts[i] : starts[i] + sizes[i]] for i in which]
    assert np.array_equal(ids, np.concatenate(expected))
    assert np.array_equal(edges, np.cumsum([0] + [len(part) for part in expected]))
    ids, edges = _laid(values, sizes, which[:0])
    assert ids.tolist() == [] and edges.tolist() == [0]


def test_encoding_keeps_no_batch_beside_the_next(monkeypatch):
    monkeypatch.setattr("cohortloom.llm.library_tokens.BATCH_BYTES", 1 << 20)
    encoder = LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"), True)
    texts = pa.array(["a b c d " * 50_000] * 5)
    left, sizes = [], []
    tracemalloc.start()
    for _, ids, cuts in encoder.encode_with_end(texts, 1):
        sizes.append(ids.nbytes)
        del ids, cuts
        left.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert len(left) == 3 and max(left) < 0.1 * max(sizes)


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    texts = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('0123456789', 1000) AS text")
    tuned(spark)
    found = [row["size"] for row in texts.mapInArrow(sizes, "size bigint").collect()]
    assert sum(found) > 40_000_000 and max(found) < 20_000_000
