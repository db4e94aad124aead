"""Many keywords at once: an Aho-Corasick automaton in flat arrays, run over all texts of a batch in step.

The automaton is a table of moves by state and class of byte, so the time for a text depends on its length alone,
not on the number of keywords. Long texts are cut into pieces that overlap by the longest keyword, and one step moves
all pieces of a batch by one byte. Patterns with a literal part are tested only on rows where that part was found.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

PIECE = 2048
BATCH_BYTES = 4 << 20


class KeywordAutomaton:
    """All keywords that occur in a text, ignoring the case of ASCII letters; blanks around a keyword do not count."""

    def __init__(self, keywords: Sequence[str]):
        words = [keyword.strip().encode().lower() for keyword in keywords]
        if not words or not all(words):
            raise ValueError("at least one keyword is needed, and none may be empty")
        used = sorted(set(b"".join(words)))
        classes = np.zeros(256, np.int32)  # 0: a byte that no keyword has
        classes[used] = np.arange(1, len(used) + 1)
        classes[ord("A") : ord("Z") + 1] = classes[ord("a") : ord("z") + 1]
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, word in enumerate(words):
            state = 0
            for step in classes[np.frombuffer(word, np.uint8)].tolist():
                following = children[state].get(step)
                if following is None:
                    following = children[state][step] = len(children)
                    children.append({})
                    ends.append([])
                state = following
            ends[state].append(number)
        self.classes, self.longest, self.width = classes, max(map(len, words)), len(used) + 1
        moves = np.zeros((len(children), self.width), np.int32)
        fall = np.zeros(len(children), np.int32)  # the state of the longest proper ending that is a beginning too
        shorter = np.zeros(len(children), np.int32)  # of those the next one at which a keyword ends; 0: none
        queue = [0]
        for state in queue:
            if state:
                moves[state] = moves[fall[state]]
            for step, following in children[state].items():
                fall[following] = moves[fall[state], step] if state else 0
                shorter[following] = fall[following] if ends[fall[following]] else shorter[fall[following]]
                queue.append(following)
            for step, following in children[state].items():
                moves[state, step] = following
        self.moves = moves.ravel()
        self.ends, self.shorter = ends, shorter
        self.stops = np.array([bool(found) for found in ends]) | (shorter > 0)

    def _numbers(self, state: int) -> list[int]:
        found = []
        while state:
            found += self.ends[state]
            state = int(self.shorter[state])
        return found

    def search(self, texts: Sequence[bytes]) -> list[list[int]]:
        """The numbers of the keywords in every text, rising."""
        sizes = np.array([len(text) for text in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        counts = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), counts)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * PIECE
        starts = np.maximum(0, inside - (self.longest - 1))
        lengths = np.minimum(inside + PIECE, sizes[owner]) - starts
        order = np.argsort(-lengths, kind="stable")
        owner, starts, lengths = owner[order], (begins[owner] + starts)[order], lengths[order]
        # How many pieces, the longest first, have a byte at each step.
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        state = np.zeros(len(owner), np.int64)
        total = len(self.ends)
        found = np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        for step, n in enumerate(active.tolist()):
            moved = self.moves[state[:n] * self.width + self.classes[data[starts[:n] + step]]]
            state[:n] = moved
            hits = np.flatnonzero(self.stops[moved])
            if len(hits):
                fresh.append(owner[hits] * total + moved[hits])
            if len(fresh) >= 256:
                found, fresh = np.unique(np.concatenate([found, *fresh])), []
        found = np.unique(np.concatenate([found, *fresh])) if fresh else found
        out: list[set[int]] = [set() for _ in texts]
        for text, at in zip((found // total).tolist(), (found % total).tolist()):
            out[text].update(self._numbers(at))
        return [sorted(numbers) for numbers in out]


def keyword_hits(spark: SparkSession, text: Column, keywords: Sequence[str]) -> Column:
    """An array with the numbers of the keywords in a text; a null text holds none. Only the text goes to Python."""
    automaton = ship_package(spark).sparkContext.broadcast(KeywordAutomaton(keywords))  # as large as the keywords make it

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[list[int]] = []
            group: list[bytes] = []
            size = 0
            for value in batch:
                group.append(value.encode() if value is not None else b"")
                size += len(group[-1])
                if size > BATCH_BYTES:
                    found += automaton.value.search(group)
                    group, size = [], 0
            yield pd.Series(found + automaton.value.search(group), index=batch.index, dtype=object)

    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, "array<int>")(text)


def automaton_cohort(df: DataFrame, text_col: str, keywords: Sequence[str]) -> DataFrame:
    """Rows whose text holds any of the keywords: ``notes.keyword_cohort`` for lists of any length."""
    return df.filter(F.size(keyword_hits(df.sparkSession, F.col(text_col), keywords)) > 0)


def clued_patterns(df: DataFrame, text_col: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows that match any pattern, ignoring case. ``patterns`` maps each to literals of which a match has at least one.

    All literals are found in one pass; a pattern is tried on the rows that hold one of its own.
    """
    clues = list(dict.fromkeys(clue for found in patterns.values() for clue in found))
    hits = keyword_hits(df.sparkSession, F.col(text_col), clues)
    name = "_clues"
    while name in df.columns:
        name = f"_{name}"
    tests = F.lit(False)
    for pattern, own in patterns.items():
        numbers = F.array(*[F.lit(clues.index(clue)) for clue in own])
        tests = tests | F.when(F.arrays_overlap(name, numbers), F.col(text_col).rlike("(?i)" + pattern)).otherwise(F.lit(False))
    return df.withColumn(name, hits).filter(tests).drop(name)
