"""Best-fit packing into fixed-length sequences, by hierarchical residuals.

Every document becomes pieces: full-length ones are sequences of their own, and
at most one shorter piece is left. Each partition packs its short pieces by
best fit, largest first, and emits the nearly full bins. The underfull bins are
items of the next round, in which a few partitions merge into one and best fit
runs again, up a tree.

A round leaves out the bins that even the smallest item would not fit into: they
are final. The tree ends at one partition, or when a round lowers the number of
bins by less than one in a hundred. Rounds are dealt by the number of items, so
none brings more than AT_ONCE bins or MEMBERS_AT_ONCE pieces to a task, however
many bins stay underfull.

A bin that travels carries its members' descriptions (not their ids), at most as
many as its length, so a round's data are the underfull bins alone.

Defined results: a null text is an empty document (its end id alone); repeated
rows and null ids are packed each for itself; an empty table gives an empty
result; extra columns do not take part; ties go to the fuller bin, then to the
bin opened last.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .tokens import MEMO, encoder

#: A bin with so few places free is final.
SPARE = 2
#: Partitions that merge into one in a round.
FAN_IN = 8
#: Bins, and pieces in them, that one best fit sees at most.
AT_ONCE, MEMBERS_AT_ONCE = 100_000, 1_000_000
MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: best fit, largest first.

    Open bins are kept by free space; the smallest one that takes the item is the
    lowest set bit of a mask over free spaces."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        fits = mask >> sizes[i]
        if fits:
            free = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if left := free - sizes[i]:
            by_free[left].append(b)
            mask |= 1 << left
    return bins


def pieces_of(raw: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """piece, start, length, crc32 for ids of 4 bytes each; a short piece comes first."""
    n, out, at = len(raw) // 4, [], 0
    size = n % length or length
    while at < n:
        out.append((len(out), at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
        at, size = at + size, length
    return out


def _sent(fills: np.ndarray, members: pa.ListArray, chunk: int = 5000):
    batch = pa.RecordBatch.from_arrays([pa.array(fills, pa.int32()), members], ["fill", "members"])
    for at in range(0, len(batch), chunk):
        yield batch.slice(at, chunk)


class _Items:
    """Bins that wait to be packed together: their fills and lists of members."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self._clear()

    def _clear(self) -> None:
        self.fills, self.members, self.n, self.n_members = [], [], 0, 0

    def add(self, fills: np.ndarray, members: pa.ListArray):
        """Take in bins; yields what is packed when there are enough."""
        self.fills.append(fills)
        self.members.append(members)
        self.n += len(fills)
        self.n_members += len(members.flatten())
        if self.n >= AT_ONCE or self.n_members >= MEMBERS_AT_ONCE:
            yield from self.packed()

    def packed(self):
        if not self.n:
            return
        fills, lists = np.concatenate(self.fills), pa.concat_arrays(self.members)
        self._clear()
        bins = best_fit(fills.tolist(), self.capacity)
        order = np.fromiter(itertools.chain.from_iterable(bins), np.int64)
        ends = np.cumsum(np.fromiter(map(len, bins), np.int64, len(bins)))
        taken = lists.take(pa.array(order))
        edges = np.append(0, np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False)))
        merged = pa.ListArray.from_arrays(pa.array(edges[np.append(0, ends)], pa.int32()), taken.flatten())
        yield from _sent(np.add.reduceat(fills[order], np.append(0, ends[:-1])), merged)


def pack(docs: DataFrame, path: str, blanks_drop: bool, end_id: int, capacity: int = 1024, spare: int = SPARE, fan_in: int = FAN_IN) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    end = struct.pack("<I", end_id)

    def first(batches):
        enc, items = encoder(path, blanks_drop, 3 * MEMO // 2), _Items(capacity)
        for b in batches:
            owner, found = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                own = pieces_of(enc.raw(t or "") + end, capacity)
                found += own
                owner += [k] * len(own)
            if not found:
                continue
            columns = np.array(found, np.int64).T
            arrays = [b.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS[1:], strict=True))]
            rows = pa.StructArray.from_arrays(arrays, fields=[pa.field(*f) for f in _FIELDS])
            lists, sizes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), rows), columns[2]
            full = sizes == capacity
            yield from _sent(sizes[full], lists.filter(pa.array(full)))
            yield from items.add(sizes[~full], lists.filter(pa.array(~full)))
        yield from items.packed()

    def again(batches):
        items = _Items(capacity)
        for b in batches:
            yield from items.add(b.column(0).to_numpy().astype(np.int64), b.column(1))
        yield from items.packed()

    spec = f"fill int, members array<{MEMBER}>"
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    level = written(rows.mapInArrow(lean(first), spec), "pack")
    done, parts, before, fill = [], max(1, level.rdd.getNumPartitions()), 0, F.col("fill")
    while True:
        total, least = level.agg(F.count("*"), F.min(F.when(fill < capacity - spare, fill))).first()
        open_bin = (fill < capacity - spare) & (fill <= capacity - (least or capacity))
        live = level.where(open_bin)
        n, members = live.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        if n < 2 or (before and (parts == 1 or 100 * total > 99 * before)):
            done.append(level)
            break
        done.append(level.where(~open_bin))
        before, parts = n, max(1, parts // fan_in, -(-n // AT_ONCE), -(-members // MEMBERS_AT_ONCE))
        # Any deal will do, another one each round; by a hash of the first member, so that a retried task deals alike.
        first_one = F.xxhash64(F.element_at("members", 1)["doc_id"], F.element_at("members", 1)["piece"], F.element_at("members", 1)["ids_crc32"], F.lit(len(done)))
        level = written(live.repartition(parts, first_one).mapInArrow(lean(again), spec), "pack")

    def placed(batches):
        for b in batches:
            rows, counts = b.column(1).flatten(), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            length = rows.field("length").to_numpy(zero_copy_only=False)
            at = np.cumsum(length) - length
            opens = np.cumsum(counts) - counts
            offset = at - np.repeat(at[opens], counts) if len(at) else at
            ids = np.repeat(b.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(ids, pa.int64()), pa.array(offset, pa.int64())], [*(n for n, _ in _FIELDS), "sequence_id", "offset"])

    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.mapInArrow(lean(placed), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
