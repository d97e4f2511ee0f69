"""Many patterns against many texts in one pass over the text: a bitmap of anchors, a hash join, and the exact test last.

A pattern is known by its anchor: its first eight words (all, if fewer), or its first 16, 8, 4, 2 or 1 bytes, whichever is the most it
has. Every place of a text at which an anchor may begin gets the hash of the span there - differences of one running sum, so that costs
the same for spans of any length - and is held against a bitmap of the anchors' hashes. The bitmap has a fixed size, whatever
the number of patterns; when it fills up, more places pass. Those join the patterns by hash, and a pair counts if
the text contains the pattern. Cost is linear in the text, and neither patterns nor texts meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.scratch import Scratch

_BITS = 1 << 24
_WORDS = 8
_BYTES = (16, 8, 4, 2, 1)
_PIECE = 1 << 20
_RUN = 1 << 16  # places whose hashes a core's cache holds
_FACTOR = 0xD6E8FEB86659FD93
_STEPS = np.multiply.accumulate(np.full(_PIECE + 1, _FACTOR, np.uint64))
_BACK = np.multiply.accumulate(np.full(_PIECE + 1, pow(_FACTOR, -1, 1 << 64), np.uint64))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of each; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, of its first megabyte if it is longer. Spans come in order of start and end."""
    end, out = np.minimum(end, start + _PIECE), np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        low = start[done]
        upto = done + int(np.searchsorted(end[done:], low + _PIECE, side="right"))
        upto = max(upto, done + 1)
        high = int(end[done:upto].max())
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _STEPS[: high - low], out=sums[1:])
        s, e = start[done:upto] - low, end[done:upto] - low
        out[done:upto] = (sums[e] - sums[s]) * _BACK[s]
        done = upto
    return _mixed(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _byte_hashes(data: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Size, first place and hashes of the spans of each size that begin at a run of places: `_hashes` of them, from one running sum for all sizes."""
    for at in range(0, len(data), _RUN):
        part = data[at : at + _RUN + max(sizes) - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _STEPS[: len(part)], out=sums[1:])
        for n in sizes:
            count = min(_RUN, len(part) - n + 1)
            if count > 0:
                yield n, at, _mixed((sums[n : n + count] - sums[:count]) * _BACK[:count])


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word, words being parted by one space."""
    inside = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
    end = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def anchors(texts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Size (words or bytes) and hash of each pattern's anchor; size 0 for an empty one."""
    data, offsets = flat_bytes(texts)
    size, start, end = np.zeros(len(texts), np.int32), offsets[:-1].copy(), offsets[:-1].copy()
    if words:
        s, e, owner = _word_spans(data, offsets)
        first = np.searchsorted(owner, np.arange(len(texts)))
        count = np.minimum(np.bincount(owner, minlength=len(texts)), _WORDS)
        has = count > 0
        size, start[has], end[has] = count.astype(np.int32), s[first[has]], e[first[has] + count[has] - 1]
    else:
        length = np.diff(offsets)
        for n in _BYTES[::-1]:
            size[length >= n] = n
        end = start + size
    return size, _hashes(data, start, end)


def places(texts: pa.Array, words: bool, sizes: Sequence[int], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each span of the given sizes whose hash is in the bitmap, once for each text."""
    data, offsets = flat_bytes(texts)
    rows, found = [], []

    def keep(h: np.ndarray, start: np.ndarray | int, end: np.ndarray | int) -> None:
        bit = h & np.uint64(_BITS - 1)
        hit = np.flatnonzero((wanted[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
        first, last = (hit + start, hit + end) if isinstance(start, int) else (start[hit], end[hit])
        owner = np.searchsorted(offsets, first, side="right") - 1
        inside = last <= offsets[owner + 1]  # a span of two texts is none
        rows.append(owner[inside])
        found.append(h[hit[inside]])

    if words:
        s, e, _ = _word_spans(data, offsets)
        for n in sizes:
            count = len(s) - n + 1
            for at in range(0, count, _PIECE):
                start = s[at : min(count, at + _PIECE)]
                end = e[at + n - 1 : at + n - 1 + len(start)]
                keep(_hashes(data, start, end), start, end)
    elif sizes:
        for n, at, h in _byte_hashes(data, sizes):
            keep(h, at, at + n)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, known = pd.factorize(np.concatenate(found).view(np.int64))  # by hashing: a place in two may be a hit, and few differ
    both = np.sort(pd.unique(np.concatenate(rows) * max(1, len(known)) + code))
    return both // max(1, len(known)), known[both % max(1, len(known))]


def _bitmap(marks: DataFrame) -> np.ndarray:
    at = F.pmod(F.col("_h"), F.lit(_BITS)) + 1
    parts = marks.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(_BITS // 8, np.uint8)
    for r in parts:
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def found_in(texts: DataFrame, body: str, patterns: DataFrame, pattern: str, words: bool = False) -> DataFrame:
    """Columns of `texts` but for `body`, and of `patterns` but for `pattern`, a row for each row of texts whose body contains the pattern
    of a row of patterns: as a substring, or as whole words where both have their words parted by one space and no space at the ends.

    Null texts contain nothing, null and empty patterns are contained in nothing. The other columns of both sides must differ in name.
    """
    own = [c for c in texts.columns if c != body]
    named = [c for c in patterns.columns if c != pattern]
    left = texts.select(*own, F.col(body).alias("_body"))
    right = patterns.select(*named, F.col(pattern).alias("_pattern")).where("_pattern <> ''")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, h = anchors(b.column("_pattern"), words)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(h.view(np.int64))], names=[*b.schema.names, "_n", "_h"])

    with Scratch(texts.sparkSession) as scratch:
        marks = scratch.staged(right.mapInArrow(mark, f"{_ddl(right)}, _n int, _h long"), "patterns").where("_n > 0")
        sizes = sorted(r["_n"] for r in marks.select("_n").distinct().collect())  # eight at most
        wanted = _bitmap(marks)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = TaskContext.get().partitionId() << 40
            for whole in batches:
                _, offsets = flat_bytes(whole.column("_body"))
                cuts = [0]
                while cuts[-1] < whole.num_rows:  # a few MB of text at a time; a longer text on its own
                    cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + 4 * _PIECE, side="right")) - 1))
                for a, z in zip(cuts, cuts[1:]):
                    b = whole.slice(a, z - a)
                    at, h = places(b.column("_body"), words, sizes, wanted)
                    if len(at):
                        rows, begin = np.unique(at, return_index=True)
                        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array(h))
                        kept = b.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(row + a + rows), lists], names=[*b.schema.names, "_row", "_hits"])
                row += whole.num_rows

        met = scratch.staged(left.mapInArrow(scan, f"{_ddl(left)}, _row long, _hits array<long>"), "texts")
        pairs = met.select("_row", F.explode("_hits").alias("_h")).join(marks.drop("_n"), "_h").drop("_h")
        pad = lambda c: F.concat(F.lit(" "), c, F.lit(" ")) if words else c
        # A text's candidates, at most as many as it has places, meet it in one row: its body is moved once.
        may = pairs.groupBy("_row").agg(F.collect_list(F.struct(*[F.col(c) for c in named], "_pattern")).alias("_may"))
        padded = met.drop("_hits").join(may, "_row").withColumn("_body", pad(F.col("_body")))
        found = padded.select(*own, F.explode(F.filter("_may", lambda x: F.contains(F.col("_body"), pad(x["_pattern"])))).alias("_found"))
        return scratch.kept(found.select(*own, *[F.col("_found")[c].alias(c) for c in named]), "matches")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
