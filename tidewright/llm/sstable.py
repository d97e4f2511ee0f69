"""Token ids in sorted-string-table shards, looked up by binary search.

A shard holds documents of one range of ids, in ascending order; shards of a range follow each other:

    data blocks    entries (shared, unshared, value lengths as varints; unshared key bytes; value), about `block_bytes`
                   each; the first key of a block is whole, later ones share a prefix with the key before
    index          for each block: last key, place, size; entries as in a block
    Bloom filter   ten bits a key, seven probes
    footer         places and sizes of index and filter, entries, tokens, magic; 56 bytes at the end

A key is 0 for a null id, else 1 and the id in eight big-endian bytes with the sign bit turned, so bytes sort as ids do,
nulls first. A value is the document's ids as compressed byte planes (`wordcodes.pack`).

Shards are written where Spark's tasks run, under names of their own for each attempt, straight to the output folder's file
system; the manifest, a Parquet table, lists those of the attempts that succeeded. A repeated or lost task leaves at most a
file that no manifest names.

Contract of `write`/`read`: one entry per input row.
* null text counts as empty and has the end id alone; rows of equal id each have an entry, ordered by a hash of their ids.
* a text of any length is one entry; it may exceed a block and the size at which a shard ends.
* an empty table gives an empty manifest and an empty result; other columns are ignored; ids must be integers.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, spread, stage_table, text_or_empty
from .wordcodes import Vocabulary, encode, packed_rows, unpack

_MAGIC = b"TWSST001"
_PROBES, _BITS_A_KEY = 7, 10
_NULL = -(1 << 63)  # where null ids stand among bounds


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class _BlockBuilder:
    def __init__(self):
        self.parts, self.size, self.last = [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.last = key


def block_entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    at, key = 0, b""
    while at < len(block):
        shared, at = _read_varint(block, at)
        own, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + block[at : at + own]
        yield key, block[at + own : at + own + size]
        at += own + size


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(_PROBES)]


class ShardWriter:
    def __init__(self, sink, block_bytes: int = 64 << 10):
        self.sink, self.block_bytes = sink, block_bytes
        self.at, self.entries, self.tokens = 0, 0, 0
        self.block, self.index, self.keys = _BlockBuilder(), _BlockBuilder(), []

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        self.block.add(key, value)
        self.keys.append(key)
        self.entries += 1
        self.tokens += tokens
        if self.block.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block.parts:
            self.sink.write(b"".join(self.block.parts))
            self.index.add(self.block.last, self.at.to_bytes(8, "big") + self.block.size.to_bytes(8, "big"))
            self.at += self.block.size
            self.block = _BlockBuilder()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index.parts)
        bits = max(64, len(self.keys) * _BITS_A_KEY)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = bits.to_bytes(8, "big") + np.packbits(bloom).tobytes()
        numbers = (self.at, len(index), self.at + len(index), len(packed), self.entries, self.tokens)
        self.sink.write(index + packed + b"".join(n.to_bytes(8, "big") for n in numbers) + _MAGIC)


class Shard:
    """One shard, open for lookups and scans; index and filter are read once."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        footer = source.read_at(56, size - 56) if size >= 56 else b""
        if footer[48:] != _MAGIC:
            raise ValueError("not a shard, or a file cut short")
        index_at, index_size, bloom_at, bloom_size, self.entries, self.tokens = (int.from_bytes(footer[8 * i : 8 * i + 8], "big") for i in range(6))
        self.index = [(k, int.from_bytes(v[:8], "big"), int.from_bytes(v[8:], "big")) for k, v in block_entries(source.read_at(index_size, index_at))]
        self.last_keys = [k for k, _, _ in self.index]
        bloom = source.read_at(bloom_size, bloom_at)
        self.bits = int.from_bytes(bloom[:8], "big")
        self.bloom = np.frombuffer(bloom, np.uint8, offset=8)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each entry of `doc_id`: filter first, then binary search of the block index."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return []
        found = []
        for last, at, size in self.index[bisect_left(self.last_keys, key) :]:
            found += [unpack(v) for k, v in block_entries(self.source.read_at(size, at)) if k == key]
            if last > key:
                break
        return found

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, size in self.index:
            for key, value in block_entries(self.source.read_at(size, at)):
                yield id_of(key), unpack(value)


def open_shard(path: str) -> Shard:
    files, name = pyarrow.fs.FileSystem.from_uri(path)
    return Shard(files.open_input_file(name))


def range_bounds(docs: DataFrame, id_col: str, text_col: str, range_bytes: int, most: int = 1 << 14, a_range: int = 8) -> np.ndarray:
    """Largest ids of all ranges but the last, ranges having about `range_bytes` of text; an id that fills several is there as often.

    Text sizes of about `a_range` rows a range, chosen by hash, come to the driver: 131,072 rows at the default limits,
    whatever the corpus. They steer sizes alone.
    """
    size = F.octet_length(text_or_empty(text_col)) + 1
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("i"), size.alias("n"), F.xxhash64(id_col, text_col).alias("h"))
    total = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    ranges = min(most, -(-(total["n"] or 0) // range_bytes))
    if ranges < 2:
        return np.zeros(0, np.int64)
    stride = max(1, total["rows"] // (a_range * ranges))
    sample = np.array(sorted((r["i"], r["n"]) for r in rows.where(F.pmod("h", F.lit(stride)) == 0).select("i", "n").collect()), np.int64).reshape(-1, 2)
    before = np.cumsum(sample[:, 1])
    return sample[np.searchsorted(before, before[-1:] * np.arange(1, ranges) // ranges), 0] if len(sample) else np.zeros(0, np.int64)


def ranges_of(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The range of each row by its id; rows of an id that fills several are dealt out by hash, in ascending order."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return low + ((hashes >> 31) * np.maximum(high - low, 1) >> 32)


def write(docs: DataFrame, vocabulary: Vocabulary, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16 << 20, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write all documents' ids as shards; the manifest: shard, path, entries, tokens, start (ids of all shards before).

    Ranges of ids are dealt to tasks by their bytes of text; a task begins another shard when one holds `shard_bytes`.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sst")
    bounds = range_bounds(docs, id_col, text_col, range_bytes)

    def ranged(ids: pa.Array, tokens: list[np.ndarray]) -> pa.Table:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.tobytes()) >> 1 for t in tokens), np.int64, len(tokens))
        own = ranges_of(bounds, ids.fill_null(_NULL).to_numpy(zero_copy_only=False), hashes)
        return packed_rows(ids, tokens).append_column("range", pa.array(own, pa.int32())).append_column("hash", pa.array(hashes))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = encode(source, vocabulary, "doc_id", "text", end_id, finish=ranged, columns="n_tokens long, ids binary, range int, hash long")
    dealt = encoded.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "hash", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        shard, writer, sink, path, made = None, None, None, None, []

        def close():
            writer.close()
            sink.close()
            made.append({"shard": shard, "path": f"{folder}/{path}", "entries": writer.entries, "tokens": writer.tokens})

        for b in batches:
            for own, doc_id, n, ids in zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "n_tokens", "ids"))):
                first = own << 32
                if writer is None or shard < first or writer.at >= shard_bytes:
                    if writer:
                        close()
                    shard = first if shard is None or shard < first else shard + 1
                    path = f"shard-{shard:016x}-{uuid.uuid4().hex}.sst"
                    sink = files.open_output_stream(f"{base}/{path}")
                    writer = ShardWriter(sink)
                writer.add(key_of(doc_id), ids, n)
        if writer:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64())]))

    manifest = stage_table(dealt.mapInArrow(run, "shard long, path string, entries long, tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _scanned(manifest: DataFrame, last: str, finish: Callable[[list[np.ndarray]], pa.Array], held_tokens: int = 1 << 19) -> DataFrame:
    """doc_id, start (ids before it in all shards), n_tokens and what `finish` makes of the ids, from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                doc_ids, starts, lists, held = [], [], [], 0
                for doc_id, ids in open_shard(path).scan():
                    doc_ids.append(doc_id)
                    starts.append(start)
                    lists.append(ids)
                    start, held = start + len(ids), held + len(ids)
                    if held > held_tokens:
                        yield rows(doc_ids, starts, lists)
                        doc_ids, starts, lists, held = [], [], [], 0
                if doc_ids:
                    yield rows(doc_ids, starts, lists)

    def rows(doc_ids: list, starts: list, lists: list) -> pa.RecordBatch:
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([long(doc_ids), long(starts), long([len(x) for x in lists]), finish(lists)], names=["doc_id", "start", "n_tokens", last.split()[0]])

    shards = spread(manifest.select("path", "start"), manifest.count(), "path")
    return shards.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all shards), n_tokens, ids (array of int) from the files of a manifest."""

    def arrays(lists: list[np.ndarray]) -> pa.Array:
        edges = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(lists).astype(np.int32)))

    return _scanned(manifest, "ids array<int>", arrays)


def digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) from the files of a manifest."""
    return _scanned(manifest, "ids_crc32 long", lambda lists: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in lists], pa.int64()))
