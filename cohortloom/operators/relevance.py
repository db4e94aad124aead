"""Relevance of phrase hits from the statistics of the corpus.

A phrase weighs as much as its tokens are rare; its weight in a document grows with the hits and levels off, the sooner
the shorter the document is beside the mean:

    sum over tokens of ln(1 + (N - df + 0.5) / (df + 0.5)) * f / (f + k1 * (1 - b + b * length / mean))

with f the sum of 1 / (1 + spread) over the windows, as ``phrase_search`` gives it. Weights are rounded to nine decimals,
so that they are the same number on every machine; documents of equal weight are in the order of their ids.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase_tokens, tokens_of

K1, B = 1.2, 0.75


def corpus_statistics(docs: DataFrame, text_col: str, phrases: Sequence[str]) -> tuple[int, float, dict[str, int]]:
    """(number of documents, mean length in tokens, documents per token of the phrases), from one pass.

    Every document counts, also one without a token. The driver sees a row per token of the phrases.
    """
    vocabulary = sorted({token for phrase in phrases for token in phrase_tokens(phrase)})
    known = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
    rows = docs.select(F.coalesce(tokens_of(F.col(text_col)), F.array().cast("array<string>")).alias("toks"))
    marked = rows.select(F.size("toks").alias("length"), F.array_intersect("toks", known).alias("present"))
    counted = marked.select("length", F.explode(F.concat(F.array(F.lit("")), "present")).alias("token"))
    found = {r["token"]: r for r in counted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).collect()}
    if "" not in found:
        return 0, 0.0, {}
    n = found[""]["n"]
    return n, found[""]["length"] / n, {token: found[token]["n"] for token in vocabulary if token in found}


def relevance(
    hits: DataFrame, docs: DataFrame, id_col: str, text_col: str, phrases: Sequence[str], k1: float = K1, b: float = B
) -> DataFrame:
    """``hits`` of ``phrase_search`` with ``score`` replaced by the weight above. Ids are unique."""
    n, mean, counts = corpus_statistics(docs, text_col, phrases)

    def rarity(phrase: str) -> float:
        seen = [counts.get(token, 0) for token in sorted(set(phrase_tokens(phrase)))]
        return sum(log(1 + (n - df + 0.5) / (df + 0.5)) for df in seen)

    weights = F.create_map(*[F.lit(x) for phrase in dict.fromkeys(phrases) for x in (phrase, rarity(phrase))])
    lengths = docs.select(F.col(id_col).alias("doc_id"), F.size(tokens_of(F.col(text_col))).alias("_length"))
    damping = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_length") / F.lit(mean or 1.0))
    score = F.element_at(weights, F.col("phrase")) * F.col("score") / (F.col("score") + damping)
    joined = hits.join(lengths, "doc_id")
    return joined.select(*[F.round(score, 9).alias("score") if name == "score" else F.col(name) for name in hits.columns])
