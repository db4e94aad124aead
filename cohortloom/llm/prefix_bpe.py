"""Byte-level BPE through the last token of every prefix.

For each prefix of a piece there is exactly one token that can end its encoding: the one whose pair with the last token
of the shorter prefix would not have been merged otherwise. A table of these last tokens encodes by walking back from
the end, and it can be continued: appending bytes only adds entries, and after an edit the table is rebuilt from the
edit until it runs alike with the old one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe_pieces import ChunkMemo
from .common import Memo, map_batches, texts_of


class PrefixEncoder:
    """Encodes byte strings by the ranks of a vocabulary; every single byte must be in it."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = dict(ranks)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.fits = Memo(self._fits, 500_000)

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging of a short string: the lowest rank first, of equal ranks the leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Is the encoding of the two tokens' bytes these two tokens? -1 as the first: of the second alone."""
        left = self.bytes_of[pair[0]] if pair[0] >= 0 else b""
        right = self.bytes_of[pair[1]]
        return self._merged(left + right) == [part for part in (left, right) if part]

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Continue the table ``last`` (one token per prefix so far) over ``data[:stop]``; the list is changed."""
        ranks, fits = self.ranks, self.fits
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and fits[(last[start - 1] if start else -1, token)]:
                    last.append(token)
                    break
        return last

    def replace(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The data with [start, end) replaced, and its table; only entries near the edit are computed.

        An entry depends on at most ``longest`` entries and bytes before it: once that many agree with the old table
        behind the edit, all later ones do.
        """
        edited = data[:start] + new + data[end:]
        shift = len(edited) - len(data)
        table, alike = last[:start], 0
        while len(table) < len(edited):
            self.extend(edited, table, len(table) + 1)
            old = len(table) - shift
            if old > end and last[old - 1] == table[-1]:
                alike += 1
                if alike >= self.longest:
                    return edited, table + last[old:]
            else:
                alike = 0
        return edited, table

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding, from the table of last tokens."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.tokens(self.extend(data, []))


class TextEncoder:
    """Whole texts: every match of the pattern is encoded for itself; a match that is a token stays whole."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        self.prefix = PrefixEncoder(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = Memo(self._piece, 400_000)
        self.chunks = ChunkMemo(self._chunk)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.prefix.ranks.get(data)
        return np.array([whole] if whole is not None else self.prefix.encode(data), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(chunk)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(self.chunks.values(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.prefix.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def encoder_for(path: str, pattern: str) -> TextEncoder:
    """The encoder of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return TextEncoder(ranks, pattern)


def encoded_texts(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): the tokens of every whole text, packed as little-endian unsigned 32-bit numbers.

    A map over rows. A null text is empty and has no tokens; repeated rows and null ids stay; other columns are not
    read. The rank file must be at ``path`` on every executor.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder_for(path, pattern).encode
        ids = [encode(text) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(texts_of(docs, id_col, text_col), step, "doc_id bigint, ids binary")


def decoded_texts(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes of packed tokens."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = encoder_for(path, pattern).decode
        data = [decode(ids) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return map_batches(encoded.select("doc_id", "ids"), step, "doc_id bigint, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, decoded again, and both hashed in one pass."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_for(path, pattern)
        rows = []
        for text in batch.column(1).to_pylist():
            ids = encoder.encode(text)
            digests = (hashlib.sha256(part).hexdigest() for part in (ids, encoder.decode(ids)))
            rows.append((len(ids) // 4, *digests))
        n, of_ids, of_data = zip(*rows)
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_data)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(texts_of(docs, id_col, text_col), step, schema)
