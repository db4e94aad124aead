"""Quality rules: document statistics, fixed limits, and gradient-boosted trees trained on labelled documents.

The trees are complete and of one depth, so a model is three arrays (feature, threshold, leaf value) and scoring is a
few gathers per level for all documents and trees at once. Chosen features are monotonic: more symbols, repeated lines
or repeated words can never raise a document's score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hashed_words, map_batches, texts_of

FEATURES = (
    "log_words", "mean_word_bytes", "symbol_share", "duplicate_line_share", "repeat_word_share", "distinct_word_share",
    "upper_share", "digit_share", "mark_share", "exclamation_share", "log_lines", "words_per_line", "common_word_share",
    "long_word_share", "bar_share",
)
# -1: a larger value never raises the score.
MONOTONIC = {"symbol_share": -1, "duplicate_line_share": -1, "repeat_word_share": -1, "exclamation_share": -1}

_WHITE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?\"'()-"
_CONTINUED = bytes(range(0x80, 0xC0))


def _count(data: bytes, which: bytes) -> int:
    return len(data) - len(data.translate(None, which))


def _repeated_words(words: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more."""
    grams = gram_hashes(words, 3)
    _, place, times = np.unique(grams, return_inverse=True, return_counts=True)
    twice = times[place] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(grams)] |= twice
    return int(covered.sum())


def statistics(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the model's features, a row per text."""
    base = np.zeros((len(texts), 5), np.int64)
    features = np.zeros((len(texts), len(FEATURES)))
    encoded = [text.encode() for text in texts]
    for i, words in hashed_words(encoded):
        data = encoded[i]
        n, white = len(words), _count(data, _WHITE)
        lines = [line for line in data.split(b"\n") if line.strip(_WHITE)]
        chars = len(texts[i]) - white
        symbols = _count(data, _SYMBOLS)
        repeats = _repeated_words(words) if n > 3 else 0
        copies = len(lines) - len(set(lines))
        base[i] = n, chars, symbols, copies, repeats
        if not n:
            continue
        times = np.unique(words, return_counts=True)[1]
        solid = len(data) - white
        features[i] = (
            np.log1p(n),
            solid / n,
            symbols / chars,
            copies / len(lines),
            repeats / n,
            len(times) / n,
            _count(data, _UPPER) / chars,
            _count(data, _DIGITS) / chars,
            _count(data, _MARKS) / chars,
            data.count(b"!") / chars,
            np.log1p(len(lines)),
            n / len(lines),
            times.max() / n,
            max(map(len, data.split())) / solid,
            data.count(b"|") / chars,
        )
    return base, features


# --- boosted trees ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, nodes)
    threshold: np.ndarray  # (trees, nodes); larger values go right
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return out + self.leaf[trees, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document, for each row of x."""
        return np.concatenate([1 / (1 + np.exp(-self.raw(x[i : i + 4096]))) for i in range(0, len(x), 4096)] or [np.zeros(0)])


def train_trees(
    x: np.ndarray,
    y: np.ndarray,
    monotonic: Mapping[int, int],
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 5.0,
    least: float = 5.0,
) -> Trees:
    """Second-order boosting of the logistic loss over histograms of the features.

    ``monotonic`` maps a feature to -1 or 1. A split against its direction is not made, and the values below either
    side of such a split are kept on their side of the middle, so the whole model is monotonic.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    raw = np.full(n, start)
    flat = binned + np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                low, high = bounds[node]
                inside = np.flatnonzero(at == node)
                split = _best_split(flat[inside], gradient[inside], weight[inside], width, bins, monotonic, low, high, ridge, least)
                bounds[2 * node + 1] = bounds[2 * node + 2] = (low, high)
                if split is None:
                    at[inside] = 2 * node + 1
                    continue
                f, cut, left, right = split
                feature[t, node], threshold[t, node] = f, edges[f][cut]
                at[inside] = 2 * node + 1 + (binned[inside, f] > cut)
                if direction := monotonic.get(f, 0):
                    middle = (left + right) / 2
                    below, above = ((low, middle), (middle, high))
                    bounds[2 * node + 1], bounds[2 * node + 2] = (below, above) if direction > 0 else (above, below)
        sums = np.bincount(at - inner, gradient, leaves)
        weights = np.bincount(at - inner, weight, leaves)
        values = sums / (weights + ridge)
        leaf[t] = rate * np.array([np.clip(v, *bounds[inner + i]) for i, v in enumerate(values)])
        raw += leaf[t][at - inner]
    return Trees(feature, threshold, leaf, start)


def _best_split(flat, gradient, weight, width, bins, monotonic, low, high, ridge, least):
    """(feature, bin, value left, value right) with the greatest gain, or None."""
    if not len(flat):
        return None
    sums = np.bincount(flat.ravel(), np.repeat(gradient, width), width * bins).reshape(width, bins)
    weights = np.bincount(flat.ravel(), np.repeat(weight, width), width * bins).reshape(width, bins)
    g_left, w_left = sums.cumsum(axis=1)[:, :-1], weights.cumsum(axis=1)[:, :-1]
    g, w = gradient.sum(), weight.sum()
    left = np.clip(g_left / (w_left + ridge), low, high)
    right = np.clip((g - g_left) / (w - w_left + ridge), low, high)

    def gain(value, gradients, weights_):
        return 2 * value * gradients - value**2 * (weights_ + ridge)

    gains = gain(left, g_left, w_left) + gain(right, g - g_left, w - w_left) - gain(np.clip(g / (w + ridge), low, high), g, w)
    gains[(w_left < least) | (w - w_left < least)] = -1
    for f, direction in monotonic.items():
        gains[f, (right[f] - left[f]) * direction < 0] = -1
    best = int(gains.argmax())
    f, cut = divmod(best, bins - 1)
    return (f, cut, left[f, cut], right[f, cut]) if gains[f, cut] > 1e-6 else None


# --- the rules --------------------------------------------------------------------------------------------------

SAMPLE = 20_000


def train_on_labels(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> Trees | None:
    """Trees fitted to at most ``sample`` labelled documents, those with the least hash of their id.

    The bound is what the driver gets: ``sample`` rows of statistics. None if both classes do not occur.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most ``sample`` rows of two numbers are broadcast.
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, features = statistics(batch.column(1).to_pylist())
        values = pa.ListArray.from_arrays(
            pa.array(np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES)), pa.array(features.ravel())
        )
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], ["doc_id", "quality", "x"])

    found = map_batches(rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")), step, "doc_id bigint, quality int, x array<double>")
    # A repeated document counts once, so the sample keeps its bound: of its rows the one with the greatest statistics.
    single = found.groupBy("doc_id").agg(F.max(F.struct("quality", "x")).alias("row")).select("doc_id", "row.*")
    kept = sorted((r.doc_id, r.quality, tuple(r.x)) for r in single.collect())
    y = np.array([quality for _, quality, _ in kept], float)
    if len(kept) < 20 or y.min() == y.max():
        return None
    monotonic = {FEATURES.index(name): direction for name, direction in MONOTONIC.items()}
    return train_trees(np.array([x for _, _, x in kept]), y, monotonic)


def _verdicts(texts, model, least_words, repeat_percent, least_score):
    base, features = statistics(texts)
    failed = (base[:, 0] < least_words) | (100 * base[:, 4] > repeat_percent * base[:, 0])
    score = model.score(features) if model is not None else np.ones(len(texts))
    return base, failed, score, ~failed & (score >= least_score)


def quality_verdicts(
    docs: DataFrame,
    model: Trees | None,
    least_words: int = 50,
    repeat_percent: int = 50,
    least_score: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, the five counts, base_failed, score, kept) of every whole text.

    A map over rows. ``base_failed``: too few words, or too many of them in repeated windows. Without a model every
    document that has not failed is kept. A null or empty text has no words and fails. Repeated rows stay.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, failed, score, kept = _verdicts(batch.column(1).to_pylist(), model, least_words, repeat_percent, least_score)
        arrays = [batch.column(0), *[pa.array(column) for column in base.T], pa.array(failed), pa.array(score), pa.array(kept)]
        return pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    schema = ", ".join(f"{name} bigint" for name in names[:6]) + ", base_failed boolean, score double, kept boolean"
    return map_batches(texts_of(docs, id_col, text_col), step, schema)


def keep_good(
    docs: DataFrame,
    model: Trees | None,
    least_words: int = 50,
    repeat_percent: int = 50,
    least_score: float = 0.5,
    text_col: str = "text",
) -> DataFrame:
    """The documents that pass, with all their columns: the same rules, as a filter inside the map."""
    at = docs.columns.index(text_col)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column(at).to_pylist()]
        kept = _verdicts(texts, model, least_words, repeat_percent, least_score)[3]
        return batch.filter(pa.array(kept))

    return map_batches(docs, step, docs.schema)
