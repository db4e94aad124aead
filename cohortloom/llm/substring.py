"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the short word runs inside every window of ``length`` words the one with the least hash
is picked, so two equal windows have their anchor at the same place. Occurrences of an anchor are extended both ways
against the earliest one, word window by word window; what does not match there is compared among the rest. The union
of a document's matched windows gives its maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import gram_hashes, hashed_words, list_array, map_batches, signed, stored, texts_of, window_minima

LENGTH, SEED = 20, 6
_U = np.uint64
_LOW = _U((1 << 20) - 1)


def anchors(words: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the seeds that stand for some window of ``length`` words; rightmost of equal ones.

    Every window holds length - seed + 1 seeds, the least of which stands for it.
    """
    grams = gram_hashes(words, seed)
    span = length - seed + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    places = np.unique(_anchor_places(grams, span))
    return places, grams[places]


def _anchor_places(grams: np.ndarray, span: int) -> np.ndarray:
    """For every window the place of its anchor."""
    found, step = [], 1 << 19
    for at in range(0, len(grams) - span + 1, step):
        part = grams[at : at + step + span - 1]
        place = np.arange(len(part) - 1, -1, -1, dtype=_U)
        least = window_minima((part & ~_LOW) | place, span) & _LOW
        found.append(at + len(part) - 1 - least.astype(np.int64))
    return np.concatenate(found)


def _windows_of(words: np.ndarray, wanted: np.ndarray, length: int, seed: int):
    """(starts, hashes, numbers) of the windows whose anchor is at one of the wanted places, by rising start.

    ``numbers`` tells which wanted place (sorted) each belongs to.
    """
    grams = gram_hashes(words, seed)
    owner = _anchor_places(grams, length - seed + 1)
    number = np.searchsorted(wanted, owner)
    number[number == len(wanted)] = 0
    starts = np.flatnonzero(wanted[number] == owner)
    return starts, gram_hashes(words, length)[starts], number[starts]


# --- steps ------------------------------------------------------------------------------------------------------


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key that tells rows apart by id and text; a null text counts as empty."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, text): ``id`` orders null ids first."""
    rows = texts_of(docs, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), row_key("doc_id", "text").alias("rid"), "text")


def _sequences(rows: DataFrame) -> DataFrame:
    """(id, rid, n_words, sequence): a digest of the whole word sequence of each text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [words for _, words in hashed_words([text.encode() for text in batch.column(2).to_pylist()])]
        digests = [hashlib.blake2b(words.tobytes(), digest_size=16).digest() for words in found]
        n = pa.array([len(words) for words in found], pa.int64())
        arrays = [batch.column(0), batch.column(1), n, pa.array(digests, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "rid", "n_words", "sequence"])

    return map_batches(rows.select("id", "rid", "text"), step, "id bigint, rid bigint, n_words bigint, sequence binary")


def _seed_rows(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, id, place) of the anchors of every text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text.encode() for text in batch.column(1).to_pylist()]
        found = [(np.full(len(places), i), places, hashes) for i, places, hashes in _all_anchors(texts, length, seed)]
        rows_of, places, hashes = (np.concatenate(column) for column in zip(*found))
        arrays = [pa.array(signed(hashes)), batch.column(0).take(pa.array(rows_of)), pa.array(places.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["seed", "id", "place"])

    return map_batches(rows.select("id", "text"), step, "seed bigint, id bigint, place int")


def _all_anchors(texts: list[bytes], length: int, seed: int):
    for i, words in hashed_words(texts):
        yield i, *anchors(words, length, seed)


def _anchor_windows(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, id, rid, place, first, windows, leads) for each wanted anchor of (id, rid, text, wanted).

    The windows an anchor stands for begin at neighbouring words: ``first`` is the first of them, ``windows`` holds
    their hashes in order. ``wanted`` lists (place, mine): mine where no document with a smaller id has the seed; the
    first of those in the text leads all occurrences of the seed.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text.encode() for text in batch.column(2).to_pylist()]
        wanted = batch.column(3).to_pylist()
        parts: list[tuple] = []
        hashes: list[np.ndarray] = []
        for i, words in hashed_words(texts):
            grams = gram_hashes(words, seed)
            mine = {item["place"]: item["mine"] for item in wanted[i] if item["place"] < len(grams)}
            at = np.array(sorted(mine), np.int64)
            if not len(at):
                continue
            starts, window, number = _windows_of(words, at, length, seed)
            cuts = np.searchsorted(number, np.arange(len(at) + 1))
            seen: set[int] = set()
            leads = []
            for place, gram in zip(at.tolist(), grams[at].tolist()):
                leads.append(mine[place] and gram not in seen)
                if mine[place]:
                    seen.add(gram)
            used = np.flatnonzero(np.diff(cuts))  # of rows with one id, a place may be no anchor of this one
            parts.append((np.full(len(used), i), grams[at[used]], at[used], starts[cuts[used]], np.array(leads)[used]))
            hashes += [signed(window[cuts[u] : cuts[u + 1]]) for u in used]
        if not hashes:
            return None
        rows_of, grams, places, firsts, leads = (np.concatenate(column) for column in zip(*parts))
        number = pa.array(rows_of)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(signed(grams)),
                batch.column(0).take(number),
                batch.column(1).take(number),
                pa.array(places.astype(np.int32)),
                pa.array(firsts.astype(np.int32)),
                list_array(hashes, pa.int64()),
                pa.array(leads),
            ],
            ["seed", "id", "rid", "place", "first", "windows", "leads"],
        )

    schema = "seed bigint, id bigint, rid bigint, place int, first int, windows array<bigint>, leads boolean"
    return map_batches(rows.select("id", "rid", "text", "wanted"), step, schema, 500)


def _later(windows: DataFrame, length: int) -> DataFrame:
    """(id, rid, low, high): runs of words covered by windows that also start earlier.

    The leading occurrence of a seed, the earliest, meets all others; of those, the windows that agree with it are later
    copies. Windows that do not agree cannot be in it, and are compared among themselves by seed and hash.
    """
    leading = windows.filter("leads").select(
        "seed", (F.col("first") - F.col("place")).alias("e_from"), F.col("windows").alias("e_windows")
    )
    beside = windows.filter(~F.col("leads")).drop("leads").join(leading, "seed")
    shift = F.col("first") - F.col("place") - F.col("e_from")

    def window(w, i):
        other = F.when(i + shift >= 0, F.get("e_windows", i + shift))
        return F.struct((F.col("first") + i).alias("start"), w.alias("w"), F.coalesce(other == w, F.lit(False)).alias("same"))

    def covered(all_: Column) -> Column:
        # Extending both ways from the seed, the windows that agree are neighbours: one run, and sure.
        starts = F.transform(F.filter(all_, lambda x: x.same), lambda x: x.start)
        run = F.struct(
            F.lit(True).alias("sure"), F.array_min(starts).alias("low"), F.array_max(starts).alias("last"), F.lit(0).cast("bigint").alias("w")
        )
        rest = F.transform(
            F.filter(all_, lambda x: ~x.same),
            lambda x: F.struct(F.lit(False).alias("sure"), x.start.alias("low"), x.start.alias("last"), F.xxhash64("seed", x.w).alias("w")),
        )
        return F.when(F.size(starts) > 0, F.concat(F.array(run), rest)).otherwise(rest)

    marked = beside.select("seed", "id", "rid", F.transform("windows", window).alias("all"))
    rows = marked.select("id", "rid", "seed", F.explode(F.array("all")).alias("all")).select("id", "rid", F.inline(covered(F.col("all"))))
    # One pass for both sorts of rows: runs that are sure are spread by their place, windows meet by their hash.
    key = F.when(F.col("sure"), F.xxhash64("rid", "low")).otherwise(F.col("w"))
    spread = rows.select("id", "rid", "sure", "low", (F.col("last") + length).alias("high"), key.alias("key"))
    earliest = F.min(F.struct("id", "low")).over(W.partitionBy("key", "sure"))
    later = spread.withColumn("_e", earliest).filter(F.col("sure") | (F.struct("id", "low") != F.col("_e")))
    return later.select("id", "rid", "low", "high")


def repeat_runs(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): the repeated passages of the documents that have some.

    ``found`` lists (rid, low, high): words [low, high) of the row ``rid`` are covered by windows of ``length`` words
    that also start earlier, in a document with a smaller id or further ahead in the same one. A document that repeats
    the word sequence of an earlier one from end to end has one run of all its words.

    Copies from end to end are found by a digest, and make no windows. Seeds that stand in one place only are dropped
    by a count before any window is made. A null text is empty. Rows with the same id count as the same document, and
    null ids as one id before all others; repeated rows get the same result.
    """
    keyed = _keyed(docs, id_col, text_col)
    light = stored(_sequences(keyed), "sequences")
    first = light.groupBy("sequence").agg(F.min("id").alias("first"))
    copied = lookup_join(light, first, ["sequence"]).filter((F.col("first") < F.col("id")) & (F.col("n_words") >= length))
    copied = stored(copied.select("id", "rid", "n_words").distinct(), "copies")

    seeds = _seed_rows(keyed, length, seed)
    counts = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    shared = seeds.join(counts.filter(F.col("n") > 1).select("seed", "least"), "seed")
    item = F.struct("place", (F.col("id") == F.col("least")).alias("mine"))
    wanted = shared.groupBy("id").agg(F.collect_set(item).alias("wanted"))
    # An id that two texts share stays, even if one of them is a copy.
    single = light.groupBy("id").agg((F.min("sequence") == F.max("sequence")).alias("one")).filter("one")
    wanted = wanted.join(copied.join(single, "id", "left_semi").select("id"), "id", "left_anti")
    windows = _anchor_windows(keyed.join(wanted, "id").select("id", "rid", "text", "wanted"), length, seed)
    whole = copied.select("id", "rid", F.lit(0).alias("low"), F.col("n_words").cast("int").alias("high"))
    return _later(windows, length).unionByName(whole).groupBy("id").agg(F.collect_list(F.struct("rid", "low", "high")).alias("found"))


def _kept(text: bytes, rid: int, found) -> tuple[int, list[bytes]]:
    """(number of words, the words that stay)."""
    words = text.split()
    runs = [run for run in found or () if run["rid"] == rid]
    if not runs:
        return len(words), words
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, [run["low"] for run in runs], 1)
    np.add.at(covered, [run["high"] for run in runs], -1)
    stays = np.cumsum(covered[:-1]) == 0
    return len(words), [word for word, stay in zip(words, stays.tolist()) if stay]


def removal_report(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, with the runs found by ``repeat_runs``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for rid, text, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            n, kept = _kept(text.encode(), rid, found)
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, digest = zip(*rows)
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    # The same columns by the same key as in repeat_runs: the texts are shuffled once for both.
    joined = _keyed(docs, id_col, text_col).join(runs, "id", "left").select("id", "rid", "text", "found")
    report = map_batches(joined, step, schema)
    return report.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))


def without_repeats(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out, all columns kept.

    The words that stay of a text that loses some are joined by one space; texts that lose all go.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        texts, stays = columns[at].to_pylist(), []
        for i, (rid, found) in enumerate(zip(*(batch.column(len(names) + j).to_pylist() for j in (0, 1)))):
            n, kept = _kept((texts[i] or "").encode(), rid, found) if found else (0, [])
            if len(kept) < n:
                texts[i] = b" ".join(kept).decode()
            stays.append(bool(kept) or not n)
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays))

    # The columns of the runs get names of their own, whatever the documents' are called.
    mine = [f"_run_{i}_{len(names)}" for i in range(3)]
    keyed = docs.withColumns(
        {mine[0]: F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))), mine[1]: row_key(id_col, text_col)}
    )
    joined = keyed.join(runs.toDF(mine[0], mine[2]), mine[0], "left")
    return map_batches(joined.select(*names, *mine[1:]), step, docs.schema)
