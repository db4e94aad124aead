"""Token counts without tokens: byte pairs are merged and only the merges are counted."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe_pieces import ChunkMemo
from .common import Memo, map_batches, texts_of


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


class MergeCounter:
    """Counts the tokens of a text by its merges.

    The symbols of a piece form a linked list; a heap holds the ranks of neighbouring pairs. The lowest rank, and of
    equal ranks the leftmost pair, is merged until no pair is left. Every merge removes one symbol, so the count is the
    symbols minus the merges and no identifier is ever made.
    """

    def __init__(self, merges: Sequence[tuple[str, str]], pattern: str, special: Sequence[str] = ()):
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(merges)}
        self.letters = dict(enumerate(byte_letters()))
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = Memo(self._piece, 500_000)
        self.chunks = ChunkMemo(self._chunk)

    def _piece(self, piece: str) -> int:
        symbols: list[str | None] = list(piece.encode().decode("latin-1").translate(self.letters))
        n = len(symbols)
        ranks = self.ranks
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, width = heappop(heap)
            left = symbols[i]
            # An entry is out of date if either side has been merged since: the pair is then wider, or i is gone.
            if left is None or (k := after[i]) >= n or len(left) + len(symbols[k]) != width:
                continue
            merges += 1
            joined = left + symbols[k]
            symbols[i], symbols[k] = joined, None
            k = after[i] = after[k]
            if k < n:
                before[k] = i
                if (r := ranks.get((joined, symbols[k]))) is not None:
                    heappush(heap, (r, i, len(joined) + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], joined))) is not None:
                heappush(heap, (r, h, len(symbols[h]) + len(joined)))
        return n - merges

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, self.split(chunk)))

    def count(self, text: str) -> int:
        """Tokens of the whole text; each special string is one token and parts the text."""
        parts = self.special.split(text) if self.special else [text]
        return sum(sum(self.chunks.values(part)) for part in parts) + len(parts) - 1


@lru_cache(maxsize=4)
def counter_for(path: str, pattern: str) -> MergeCounter:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = [token["content"] for token in spec["added_tokens"]]
    return MergeCounter(merges, pattern, special)


def token_counts(
    docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, by the merges of a byte-level vocabulary file.

    The file must be at ``path`` on every executor. A map over rows: nothing is shuffled, repeated rows and null ids
    stay as they are, and a null text counts as empty (0 bytes, 0 tokens). Other columns are not read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = counter_for(path, pattern)
        text = batch.column(1)
        counts = [counter.count(value) for value in text.to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pc.cast(pc.binary_length(text), pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_batches(texts_of(docs, id_col, text_col), step, schema)
