"""Packing documents into sequences by minimum bin slack over the histogram of lengths.

1. Documents become ids (`wordcodes`). Those over the capacity are cut into full pieces and a remainder. Pieces are written
   to the shared folder with their rank among the pieces of equal length of their block.
2. The plan is made from the histogram of lengths, `capacity` numbers at most whatever the corpus. For the longest length
   left, a subset-sum over bitsets finds which lengths left fill the rest of a sequence closest to capacity; how many of
   each comes from walking the bitsets back. The pattern is used as often as its lengths last.
3. A piece's rank among all pieces of its length (ranks of its block plus the pieces of blocks before) says which use of which
   pattern takes it. The plan is broadcast: patterns are bounded by the capacity, since each use up to exhaustion leaves
   a length with fewer pieces than a pattern takes of it (`Plan.entries` is checked against `max_entries`).

Contract of `pack_documents`: every id of every row lies in exactly one piece.
* null text counts as empty: a piece of the end id alone; repeated rows and equal ids each have pieces of their own.
* pieces of a sequence lie side by side from offset 0; which of two equally long pieces goes where is arbitrary but fixed
  once the pieces are written; an empty table gives empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table
from .wordcodes import Vocabulary, encode, unpack
from .wordcodes import pack as pack_ids


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is the largest up to `room`: counts by length."""
    items = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            items.append((length, take))
            left -= take
            take *= 2
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length, take in items:
        layers.append(reach)
        reach |= (reach << (length * take)) & mask
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for (length, take), before in reversed(list(zip(items, layers))):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


class Plan:
    """Which ranks of each length go to which sequences, as sorted arrays."""

    def __init__(self, histogram: dict[int, int], capacity: int, max_entries: int = 500_000):
        left = {k: n for k, n in histogram.items() if n > 0}
        taken, rows, sequences, self.padding = dict.fromkeys(left, 0), [], 0, 0
        while left:
            longest = max(left)
            left[longest] -= 1
            use = fill({k: n for k, n in left.items() if n > 0}, capacity - longest)
            left[longest] += 1
            use[longest] = use.get(longest, 0) + 1
            times = min(left[k] // n for k, n in use.items())
            offset = 0
            for length in sorted(use, reverse=True):
                rows.append((length, taken[length], use[length], sequences, offset))
                taken[length] += use[length] * times
                left[length] -= use[length] * times
                offset += use[length] * length
                if not left[length]:
                    del left[length]
            self.padding += (capacity - offset) * times
            sequences += times
        if len(rows) > max_entries:
            raise ValueError(f"a plan of {len(rows)} entries is too large to broadcast")
        self.sequences, self.entries = sequences, len(rows)
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, by its length and its rank among all of that length."""
        key = self.table[:, 0] << 48 | self.table[:, 1]
        at = np.searchsorted(key, length << 48 | rank, side="right") - 1
        _, first, use, sequence, offset = self.table[at].T
        return sequence + (rank - first) // use, offset + (rank - first) % use * length


class Packed:
    """pieces: part, piece, doc_id, start, length, doc_tokens, ids_crc32, ids (packed). placements: part, piece, sequence_id, offset."""

    def __init__(self, pieces: DataFrame, placements: DataFrame, plan: Plan, capacity: int):
        self.pieces, self.placements, self.plan, self.capacity = pieces, placements, plan, capacity

    def placed(self) -> DataFrame:
        """The pieces in their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
        rows = self.pieces.select("part", "piece", "doc_id", "start", "length", "doc_tokens", "ids_crc32")
        return rows.join(self.placements, ["part", "piece"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def sequences(self, pad_id: int = 0) -> DataFrame:
        """sequence_id, filled, ids (array): pieces in order, padded to the capacity unless the length is a power of two."""
        capacity = self.capacity
        listed = self.pieces.select("part", "piece", "ids").join(self.placements, ["part", "piece"])
        grouped = listed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # up to `capacity` ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, filled = [], []
                for parts in b.column("p").to_pylist():
                    ids = np.concatenate([unpack(p["ids"]) for p in parts]).astype(np.int32)
                    filled.append(len(ids))
                    out.append(ids if len(ids) & (len(ids) - 1) == 0 else np.pad(ids, (0, capacity - len(ids)), constant_values=pad_id))
                yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(filled, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["sequence_id", "filled", "ids"])

        return grouped.select("sequence_id", "p").mapInArrow(run, "sequence_id long, filled long, ids array<int>")


_PIECE = "part long, piece long, start long, length long, rank long, doc_tokens long, ids_crc32 long, ids binary"


def cut_pieces(capacity: int) -> Callable[[pa.Array, list[np.ndarray]], pa.Table]:
    """Documents of a block as pieces of at most `capacity` ids, with `rank` among the block's pieces of equal length.

    A block is known by its `part`: the task's partition and a number within it.
    """
    made: dict[int, int] = {}

    def finish(doc_ids: pa.Array, documents: list[np.ndarray]) -> pa.Table:
        task = TaskContext.get()
        number = made.get(task.taskAttemptId(), 0)
        made.clear()
        made[task.taskAttemptId()] = number + 1
        ranks = np.zeros(capacity + 1, np.int64)
        row, start, length, rank, total, crc, ids = [], [], [], [], [], [], []
        for r, own in enumerate(documents):
            for a in range(0, len(own), capacity):
                part = own[a : a + capacity]
                n = len(part)
                row.append(r)
                start.append(a)
                length.append(n)
                rank.append(int(ranks[n]))
                ranks[n] += 1
                total.append(len(own))
                crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                ids.append(pack_ids(part, 2 if part.max() < 65536 else 4))
        long = lambda x: pa.array(x, pa.int64())
        part = np.full(len(row), task.partitionId() << 20 | number)
        return pa.table({"doc_id": doc_ids.take(long(row)), "part": long(part), "piece": long(np.arange(len(row))), "start": long(start), "length": long(length), "rank": long(rank), "doc_tokens": long(total), "ids_crc32": long(crc), "ids": pa.array(ids, pa.binary())})

    return finish


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> Packed:
    pieces = stage_table(encode(docs, vocabulary, id_col, text_col, end_id, finish=cut_pieces(capacity), columns=_PIECE), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    plan = Plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    ranked = pieces.select("part", "piece", "length", "rank").join(bases, ["part", "length"])
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = shared.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("piece"), pa.array(sequence), pa.array(offset)], names=["part", "piece", "sequence_id", "offset"])

    placements = ranked.select("part", "piece", "length", "rank", "base").mapInArrow(run, "part long, piece long, sequence_id long, offset long")
    return Packed(pieces, placements, plan, capacity)

