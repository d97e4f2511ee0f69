"""Array arithmetic over the bytes of a whole batch of texts: words, hashes and hashed n-grams, nearly without loops per word.

Every function takes plain numpy arrays of one Arrow batch, so memory is bounded by the batch. `chunks` cuts batches to
a bounded number of bytes; a text longer than that forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEPS = 8  # 8-byte steps by which words are hashed together; the rest of longer words goes through XXH3


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column` and at most `rows` rows, joined or cut as needed."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        _, offsets = text_bytes(batch.column(column))
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit - size, side="right")) - 1
            end = min(batch.num_rows, max(end, start + (not held)), start + rows - sum(len(h) for h in held))
            if end > start:
                held.append(batch.slice(start, end - start))
                size += int(offsets[end] - offsets[start])
                start = end
            if start < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole value."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbours from theirs. Mixing comes before and after the sum, so no algebraic identity of sums or products carries over."""
    return mixed(mixed(left) * np.uint64(0x9E3779B97F4A7C15) + right)


def window_hashes(codes: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, a 64-bit hash of the codes of every window of that many neighbours: doubled lengths, two of which overlap to the size."""
    tables, have = [codes], 1
    while 2 * have <= max(sizes):
        tables.append(joined_hash(tables[-1][: len(tables[-1]) - have], tables[-1][have:]) if len(tables[-1]) > have else codes[:0])
        have *= 2
    out = []
    for size in sizes:
        half = tables[size.bit_length() - 1]
        rest = size - (1 << size.bit_length() - 1)
        out.append(joined_hash(half[: len(half) - rest], half[rest:]) if rest and len(half) > rest else half[: len(half) * (not rest)])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, words being the runs of bytes that aren't white space."""
    inside = ~_IS_WHITE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: 8 bytes a step, mixed after each."""
    length = end - start
    out = mixed(length.astype(np.uint64) + np.uint64(seed << 32))
    if not len(start):
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    for step in range(_STEPS):
        left = length - 8 * step
        own = slice(None) if not step else np.flatnonzero(left > 0)
        if step and not len(own):
            break
        value = np.ascontiguousarray(eight[start[own] + 8 * step]).view("<u8").ravel() & _LOW_BYTES[np.minimum(left[own], 8)]
        out[own] = joined_hash(out[own], value)
    view = memoryview(np.ascontiguousarray(data))
    for w in np.flatnonzero(length > 8 * _STEPS).tolist():
        out[w] ^= np.uint64(xxhash.xxh3_64_intdigest(view[start[w] : end[w]], seed))
    return out


def spaced_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and where each word begins there (one place more than words)."""
    length = end - start
    at = np.append(0, np.cumsum(length + 1))
    out = np.full(int(at[-1]), 32, np.uint8)
    source = ranges(start, length)
    out[np.repeat(at[:-1] - start, length) + source] = data[source]
    return out, at


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., of length[0] numbers, then the same of each next pair."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def span_digests(spaced: np.ndarray, at: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of XXH3-128 over the bytes of `words` words from word `first`, joined by one space."""
    view, digest = memoryview(spaced), xxhash.xxh3_128_digest
    whole = b"".join([digest(view[a : b - 1]) for a, b in zip(at[first].tolist(), at[first + words].tolist())])
    halves = np.frombuffer(whole, "<i8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def gram_buckets(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed bucket of each byte n-gram that lies within one text."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(count, n, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) ^ data[k : k + count]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[:count] == owner[n - 1 :]
    return owner[:count][whole], (h[whole] % np.uint32(buckets)).astype(np.int64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
