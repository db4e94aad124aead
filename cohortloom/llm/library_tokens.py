"""Texts encoded by a vocabulary file of the tokenizers library, the distinct pieces of a batch once."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import ByteMemo, text_chunks
from .token_counts import byte_letters

# White space for Python that is none for the library's patterns; texts with it are given to the library as a whole, and
# three of the characters mark how a part was cut off.
_UNCOMMON = "[\x1c-\x1f]"
_START, _LINE = "\x1d", "\x1e"
# A run of plain letters and a mark behind it: pieces of their own for any of the vocabularies, and no letter that a
# normaliser would change but for its case.
_PLAIN = f"^(?P<lead>[{_START}{_LINE}]?)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,]?)$"
_CUT = re.compile(r" (?=\S)")
BATCH_BYTES = 16 << 20
LAID = 1 << 16


def _laid(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ones of the ranges that follow each other in ``values``, one behind the other, and their edges.

    Places are worked out for ``LAID`` ranges at a time, as those of a whole batch take several times its ids.
    """
    edges = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes[which], out=edges[1:])
    starts = np.cumsum(sizes) - sizes
    out = np.empty(edges[-1], values.dtype)
    for low in range(0, len(which), LAID):
        some = which[low : low + LAID]
        first, last = edges[low], edges[low + len(some)]
        kind = np.int32 if max(last - first, len(values)) < 1 << 31 else np.int64
        places = np.repeat((starts[some] - (edges[low : low + len(some)] - first)).astype(kind), sizes[some])
        places += np.arange(last - first, dtype=kind)
        out[first:last] = values[places]
    return out, edges


class LibraryEncoder:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False)``, many texts at a time.

    Texts are cut where no piece of the library's patterns crosses: before a space that is followed by something else
    than white space, and before and behind a line end between two such characters. The distinct parts of a batch are
    encoded once by the library's own normaliser, splitter and model, and a memo of bounded bytes keeps them for the
    batches after it. Texts with a special string, or with characters for which a text may not be cut, go through the
    library as a whole. ``words`` is set for vocabularies in lower case that drop white space: such texts are cut there.
    """

    def __init__(self, path: str, words: bool = False):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.words = words
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = dict(enumerate(byte_letters()))
        # Byte-level vocabularies spell a plain word by its bytes; asked of the library, not assumed.
        probe = "aé" if words else " aé"
        self.by_bytes = [piece for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(probe)] == [self._letters(probe)]
        self.known = ByteMemo()
        marks = ["", ".", ",", "\n"]
        self.marks = dict(zip(marks, self._spelled(marks)))

    def _letters(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _each(self, pieces: list[list[str]]) -> list[bytes]:
        """The ids of every list of pieces."""
        tokenize = self.whole.model.tokenize
        return self._bytes([[token.id for piece in one for token in tokenize(piece)] for one in pieces])

    def _bytes(self, found: list[list[int]]) -> list[bytes]:
        width = self.kind.itemsize
        data = np.fromiter(chain.from_iterable(found), self.kind).tobytes()
        ends = [width * end for end in accumulate(map(len, found), initial=0)]
        return [data[a:b] for a, b in pairwise(ends)]

    def _plain(self, words: list[str]) -> list[bytes]:
        if not self.by_bytes:
            return self._spelled(words)
        tokenize = self.whole.model.tokenize
        pieces = self._letters("\n".join(words)).split(self.letters[10])
        return self._bytes([[token.id for token in tokenize(piece)] for piece in pieces])

    def _spelled(self, chunks: list[str]) -> list[bytes]:
        if self.whole.normalizer is not None:
            chunks = list(map(self.whole.normalizer.normalize_str, chunks))
        split = self.whole.pre_tokenizer.pre_tokenize_str
        return self._each([[piece for piece, _ in split(chunk)] for chunk in chunks])

    def _values(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the distinct parts of a batch, one behind the other.

        A plain word is looked up without its mark or line end; all three are then laid behind each other.
        """
        found = pc.extract_regex(keys, _PLAIN)
        plain = found.is_valid()
        lead, word, mark = (pc.drop_null(pc.struct_field(found, name)) for name in ("lead", "word", "mark"))
        if self.words:
            word = pc.utf8_lower(word)
        else:
            word = pc.if_else(pc.equal(lead, ""), pc.binary_join_element_wise(" ", word, ""), word)
        word = word.dictionary_encode()
        rest = keys.filter(pc.invert(plain)).to_pylist()
        if not self.words:
            cuts = {_START: "", _LINE: "\n"}
            rest = [cuts[key[0]] + key[1:] if key[:1] in cuts else " " + key for key in rest]
        pool = [
            *self.marks.values(),
            *self.known.values(word.dictionary.to_pylist(), self._plain),
            *self.known.values(rest, self._spelled),
        ]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // self.kind.itemsize
        marks = list(self.marks)
        segments = np.zeros((len(keys), 3), np.int64)  # entries of the pool; the first one is empty
        at = plain.to_numpy(zero_copy_only=False)
        segments[at, 0] = np.where(pc.equal(lead, _LINE).to_numpy(zero_copy_only=False), marks.index("\n"), 0)
        segments[at, 1] = word.indices.to_numpy() + len(marks)
        segments[at, 2] = pc.index_in(mark, pa.array(marks)).to_numpy(zero_copy_only=False)
        segments[~at, 1] = np.arange(len(rest)) + len(pool) - len(rest)
        ids, _ = _laid(np.frombuffer(b"".join(pool), self.kind).astype("<u4"), sizes, segments.ravel())
        return ids, sizes[segments].sum(axis=1)

    def _whole(self, text: str) -> np.ndarray:
        """A text that may not be cut like the others."""
        if any(string in text for string in self.special) or re.search(_UNCOMMON, text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        head, *rest = _CUT.split(text)
        chunks = [head, *[" " + part for part in rest]]
        return np.frombuffer(b"".join(self.known.values(chunks, self._spelled)), self.kind).astype("<u4")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): the ids of all texts one behind the other as unsigned 32-bit numbers; text i has cuts[i:i + 2]."""
        odd = pc.match_substring_regex(texts, _UNCOMMON)
        searched = pc.ascii_lower(texts) if self.words else texts  # a special string may appear by it, so look behind it
        for string in self.special:
            odd = pc.or_(odd, pc.match_substring(searched, string))
        odd = odd.to_numpy(zero_copy_only=False)
        if self.words:
            parts = pc.utf8_split_whitespace(searched)
        else:
            searched = pc.binary_join_element_wise(_START, pc.replace_substring(texts, "\n", " " + _LINE), "")
            parts = pc.split_pattern(searched, " ")
        coded = parts.flatten().dictionary_encode()
        keys = coded.dictionary
        index, edges = coded.indices.to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        del searched, parts, coded  # the texts cut up, not needed beside the ids
        if not self.words:
            # White space that meets white space, or ends a text, belongs to pieces that cross the cuts.
            ends = pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(pc.utf8_ltrim(keys, _LINE), 0, 1))
            loose = pc.and_(pc.equal(ends, ""), pc.invert(pc.starts_with(keys, _START))).to_numpy(zero_copy_only=False)
            if loose.any():
                bad = np.concatenate([[0], np.cumsum(loose[index])])
                odd = odd | (bad[edges[1:]] > bad[edges[:-1]])
        values, lengths = self._values(keys)
        if odd.any():  # the parts of these texts become none
            index = np.where(np.repeat(odd, np.diff(edges)), len(lengths), index)
            lengths = np.append(lengths, 0)
        ids, cuts = _laid(values, lengths, index)
        cuts = cuts[edges]
        if odd.any():
            pieces = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            for i in np.flatnonzero(odd).tolist():
                pieces[i] = self._whole(texts[i].as_py())
            ids = np.concatenate(pieces)
            cuts = np.concatenate([[0], np.cumsum([len(piece) for piece in pieces])])
        return ids, cuts

    def _ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        collecting = gc.isenabled()
        gc.disable()  # a batch makes millions of small lists and no cycles
        try:
            ids, cuts = self.encode_batch(texts)
        finally:
            if collecting:
                gc.enable()
        return np.insert(ids, cuts[1:], np.uint32(end_id)), cuts + np.arange(len(cuts))

    def encode_with_end(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, cuts) of some megabytes of texts at a time, ``end_id`` behind every text.

        No name here holds what is handed out, which would last beside the next batch.
        """
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for low, high in text_chunks(sizes, BATCH_BYTES):
            yield low, *self._ended(texts.slice(low, high - low), end_id)


@lru_cache(maxsize=4)
def library_encoder(path: str, words: bool = False) -> LibraryEncoder:
    return LibraryEncoder(path, words)
