"""Running counts and sums along groups of rows that may be larger than a task.

Rows are sorted by ranges of (group, order), so a large group lies in several neighbouring partitions. One pass counts
and sums inside each partition; the groups cut by a border get what came before from one small row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _power_tables, map_batches, partitions, stored

_P, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1  # the base of the power tables


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def prefix_scan(rows: DataFrame, group: str, order: Sequence[Column], purpose: str) -> DataFrame:
    """``rows`` with ``idx``, ``s1``, ``s2`` and ``last``, for rows with numbers ``t1`` and ``t2``.

    Inside its group, in the given order, a row has place ``idx`` (from 0), the sums ``s`` of t * p^idx modulo 2^64 over
    the rows up to it, and ``last`` if no row comes after it. Equal sums mean equal sequences if the t are hashes. Rows
    that the order does not tell apart must be equal. The groups are integers, not null. The driver sees one row per
    partition.
    """
    key = [F.col(group), *order, F.monotonically_increasing_id()]  # the last one parts equal rows
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *key).sortWithinPartitions(group, *order)
    names = rows.columns
    at, t1, t2 = (names.index(name) for name in (group, "t1", "t2"))
    added = "idx bigint, s1 bigint, s2 bigint, last boolean, part int, place bigint, open boolean"
    out_names = [*names, *[field.split()[0] for field in added.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = current = None  # the group of the partition's first row, of the row before
        n, sums, place, held = 0, [np.uint64(0)] * 2, 0, None

        def given(held: tuple, end: bool | None) -> pa.RecordBatch:
            batch, columns, last = held
            values = pa.array([*last, end], pa.bool_())
            return pa.RecordBatch.from_arrays([*batch.columns, *columns[:3], values, *columns[3:]], out_names)

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            groups = batch.column(at).to_numpy(zero_copy_only=False)
            if held is not None:
                yield given(held, bool(groups[0] != current))
            if first is None:
                first = groups[0]
            new = np.ones(size, bool)
            new[1:] = groups[1:] != groups[:-1]
            new[0] = groups[0] != current
            if new[0]:
                n, sums = 0, [np.uint64(0)] * 2
            starts = np.maximum.accumulate(np.where(new, np.arange(size), -1))  # -1: began before this batch
            idx = np.where(starts >= 0, np.arange(size) - starts, np.arange(size) + n)
            powers = _power_tables(int(idx.max()) + 1)[0]
            found = []
            for k, column in enumerate((t1, t2)):
                weighted = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64) * powers[idx]
                run_sums = np.concatenate([[np.uint64(0)], np.cumsum(weighted, dtype=np.uint64)])
                total = run_sums[1:] - np.where(starts >= 0, run_sums[np.maximum(starts, 0)], np.uint64(0))
                found.append(np.where(starts >= 0, total, total + sums[k]))
            n, sums, current = int(idx[-1]) + 1, [found[0][-1], found[1][-1]], groups[-1]
            columns = [
                pa.array(idx, pa.int64()),
                *[pa.array(total.view(np.int64)) for total in found],
                pa.array(np.full(size, part, np.int32)),
                pa.array(np.arange(place, place + size)),
                pa.array(groups == first),
            ]
            place += size
            held = (batch, columns, (groups[1:] != groups[:-1]).tolist())
        if held is not None:
            yield given(held, None)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    local = stored(ordered.mapInArrow(run, f"{schema}, {added}"), purpose)

    end = F.max_by(F.struct("idx", "s1", "s2", "open"), "place").alias("end")
    borders = local.groupBy("part").agg(F.min(group).alias("first"), F.max(group).alias("final"), end).collect()
    before: dict[int, tuple[int, int, int]] = {}
    ends: dict[int, bool] = {}
    previous = None
    for row in sorted(borders, key=lambda row: row["part"]):
        goes_on = previous is not None and previous[1] == row["first"]
        carried = previous[2] if goes_on else (0, 0, 0)
        if previous is not None:
            ends[previous[0]] = not goes_on
        before[row["part"]] = carried
        state = (row["end"]["idx"] + 1, row["end"]["s1"], row["end"]["s2"])
        if row["end"]["open"]:
            scale = pow(_P, carried[0], 1 << 64)
            state = (state[0] + carried[0], *[_signed((a + scale * b) & _ALL) for a, b in zip(carried[1:], state[1:])])
        previous = (row["part"], row["final"], state)
    if previous is not None:
        ends[previous[0]] = True

    wanted = [*names, "idx", "s1", "s2", "last"]
    spots = {name: i for i, name in enumerate(out_names)}

    def mend(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = batch.column(spots["part"]).to_numpy()
        opened = batch.column(spots["open"]).to_numpy(zero_copy_only=False)
        idx = batch.column(spots["idx"]).to_numpy().copy()
        sums = [batch.column(spots[name]).to_numpy().view(np.uint64).copy() for name in ("s1", "s2")]
        last = batch.column(spots["last"]).to_pylist()
        for part in np.unique(parts):
            n, *carried = before[int(part)]
            if n:
                rows_of = opened & (parts == part)
                idx[rows_of] += n
                scale = np.uint64(pow(_P, n, 1 << 64))
                for total, earlier in zip(sums, carried):
                    total[rows_of] = total[rows_of] * scale + np.uint64(earlier & _ALL)
        last = [ends[int(part)] if flag is None else flag for flag, part in zip(last, parts)]
        columns = {"idx": pa.array(idx), "s1": pa.array(sums[0].view(np.int64)), "s2": pa.array(sums[1].view(np.int64)), "last": pa.array(last, pa.bool_())}
        return pa.RecordBatch.from_arrays([columns.get(name, batch.column(spots[name])) for name in wanted], wanted)

    return map_batches(local, mend, f"{schema}, idx bigint, s1 bigint, s2 bigint, last boolean", 20_000)
