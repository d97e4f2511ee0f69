"""Encoding documents by a global shuffle of distinct words: each distinct word is encoded once.

1. Blocks of documents (`block_bytes` of text) are cut into words such that no pre-token of the encoder crosses a cut.
   For every position a block keeps the number of the word there, packed in a file in the shared folder, and sends out its
   distinct words. (Exploding positions to rows would move each of them three times at forty bytes.)
2. The words of all blocks shuffle by hash into buckets. A bucket streams past one table of the words seen so far there;
   new words are encoded, and the ids of a block's words go back to the block.
3. Blocks meet their words' ids and put them together by position.

Memory: a task holds one block, or the distinct words of one bucket. Buckets follow the session's shuffle partitions, up
to 4,096. A frequent word costs one entry a block, not one an occurrence, so none is hot.

Contract of `encode`: one row per input row, in no order.
* null and blank text is encoded as it is: null and empty give no ids; repeated rows each give a row.
* texts of any length are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, spread, stage_table
from .textarrays import chunks, text_bytes

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_LETTER


class Vocabulary:
    """How to encode words: a vocabulary file, its library, and the rule by which words are cut.

    kind "tiktoken": ranks of a byte-level BPE and its split pattern. kind "bytes": a tokenizers file of byte-level BPE.
    kind "words": a tokenizers file that drops white space and lower-cases. The file is read where tasks run.
    With `added`, strings of added tokens in a text are those tokens, as the library has it by default; without, they are
    ordinary text.
    """

    def __init__(self, kind: str, path: str, pattern: str = "", added: bool = False):
        self.kind, self.path, self.pattern, self.added = kind, path, pattern, added

    def whole(self) -> list[bytes]:
        """The strings that stay whole as words of their own."""
        if not self.added:
            return []
        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(self.path).get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens):
            raise ValueError("added tokens that take in white space or are normalized can't be cut out as words")
        return [t.content.encode() for t in tokens]

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        if self.kind == "tiktoken":
            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encode = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return lambda words: [encode(w) for w in words]
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = not self.added
        return lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _spans(data: np.ndarray, offsets: np.ndarray, whole: Sequence[bytes]) -> list[tuple[int, int]]:
    """Where texts hold these strings: leftmost first, the longest at one place, never across two texts."""
    joined = data.tobytes()
    if not any(w in joined for w in whole):
        return []
    found = re.compile(b"|".join(re.escape(w) for w in sorted(whole, key=len, reverse=True)))
    return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in found.finditer(joined, a, b)]


def cut_words(data: np.ndarray, offsets: np.ndarray, drop_white: bool, whole: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word edges (one more than words) and number of words of each text.

    A word is a run of white space and what follows up to the next; marks after a letter begin a word of their own. The
    patterns of both kinds of vocabulary begin a match there in any case. With `drop_white`, white space is left out and
    capitals before an ASCII byte are lower-cased, which such vocabularies do themselves. Strings of `whole` are words of
    their own, and what follows one begins a word.
    """
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    white = _WHITE[data]
    edge = np.zeros(len(data), bool)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    spans = _spans(data, offsets, whole)
    if drop_white:
        edge[1:] = ~white[1:] & (white[:-1] | (_LETTER[data[:-1]] & _MARK[data[1:]]))
        edge[begins] = ~white[begins]
        _hold(edge, spans, ~white)
        kept = ~white
        place = np.cumsum(kept) - kept
        capital = (data >= 65) & (data <= 90)
        capital[:-1] &= data[1:] < 128
        for a, b in spans:
            capital[a:b] = False
        edges = np.append(place[edge], int(kept.sum()))
        data = (data + np.where(capital, 32, 0).astype(np.uint8))[kept]
    else:
        edge[1:] = (white[1:] & ~white[:-1] & ~_wide_white_end(data)[:-1]) | (_LETTER[data[:-1]] & _MARK[data[1:]])
        edge[begins] = True
        _hold(edge, spans, np.ones(len(data), bool))
        edges = np.append(np.flatnonzero(edge), len(data))
    # In either case a text's words are those whose edges lie among its bytes.
    count = np.add.reduceat(np.append(edge, False).astype(np.int64), np.minimum(offsets[:-1], len(edge)))
    return data, edges, np.where(offsets[:-1] < offsets[1:], count, 0)


def _hold(edge: np.ndarray, spans: list[tuple[int, int]], may_begin: np.ndarray) -> None:
    """Makes each span one word, and lets a word begin behind it where one may."""
    for a, b in spans:
        edge[a], edge[a + 1 : b] = True, False
        if b < len(edge):
            edge[b] = may_begin[b]


def _wide_white_end(data: np.ndarray) -> np.ndarray:
    """Where a byte ends white space beyond ASCII, or a control character that some libraries count as white space."""
    end = (data >= 0x1C) & (data <= 0x1F)
    end[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    a, b, c = data[:-2], data[1:-1], data[2:]
    end[2:] |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    end[2:] |= (a == 0xE2) & (b == 0x81) & ((c == 0x9F) | (c == 0xA0))
    end[2:] |= ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) & ((c == 0x80) | (c == 0x8E))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))
    return end


def distinct_words(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.Array]:
    """The number of the word at each position, and the distinct words, most frequent first, of (bytes, edges) parts."""
    arrays = [pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]) for data, edges in parts]
    coded = pa.chunked_array(arrays, pa.binary()).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    number, known = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(-np.bincount(number, minlength=len(known)), kind="stable")
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(len(known), dtype=np.int32)
    return rank[number], known.take(pa.array(order))


def words_of(texts: pa.Array, drop_white: bool, part_bytes: int = 2 << 20, whole: Sequence[bytes] = ()) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers and distinct words of all texts, and the number of words of each; cut in parts, to hold less at once."""
    data, offsets = text_bytes(texts)
    parts, counts, row = [], [], 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + part_bytes, side="right")) - 1)
        own, edges, count = cut_words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], drop_white, whole)
        parts.append((own, edges))
        counts.append(count)
        row = end
    number, words = distinct_words(parts)
    return number, words, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each pair, one after another."""
    return flat[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]


def pack(values: np.ndarray, planes: int) -> bytes:
    """Unsigned numbers as compressed byte planes, low bytes first."""
    split = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T)
    return len(values).to_bytes(8, "little") + planes.to_bytes(1, "little") + pa.compress(split.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, planes = int.from_bytes(blob[:8], "little"), blob[8]
    if not n:
        return np.zeros(0, np.uint32)
    out = np.zeros((n, 4), np.uint8)
    out[:, :planes] = np.frombuffer(pa.decompress(blob[9:], n * planes, codec="zstd"), np.uint8).reshape(planes, n).T
    return out.view("<u4").ravel()


def _planes(values: np.ndarray) -> int:
    return max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)


def _join(*blobs: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in blobs)


def _split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _pack_words(words: pa.Array) -> bytes:
    edges = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    lengths = pack(np.diff(edges), _planes(np.diff(edges)))
    text = words.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes() if len(words) and edges[-1] > edges[0] else b""
    return _join(lengths, len(text).to_bytes(8, "little"), pa.compress(text, codec="zstd", asbytes=True))


def _unpack_words(blob: bytes) -> list[bytes]:
    lengths, size, packed = _split(blob)
    edges = np.append(0, np.cumsum(unpack(lengths).astype(np.int64)))
    text = pa.decompress(packed, int.from_bytes(size, "little"), codec="zstd", asbytes=True)
    return [text[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


class WordTable:
    """Ids of words seen so far; new ones are encoded in one call."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode, self.known = encode, {}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and number of ids of each word."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            new = list(dict.fromkeys(new))
            lists = self.encode([w.decode() for w in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            length = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(length.sum()))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(length) - length)
            self.length, self.flat = np.append(self.length, length), np.append(self.flat, flat)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return gather(self.flat, self.start[at], self.length[at]), self.length[at]


_BLOCKS = "block long, bucket int, path string, payload binary"


def _blocks(docs: DataFrame, vocabulary: Vocabulary, buckets: int, block_bytes: int, folder: str) -> DataFrame:
    """(block, bucket, path, payload): the distinct words of each block by bucket; what the block keeps is in the file `path`.

    The file holds document ids, words of each, word numbers by position and the order in which the words went out. Its
    name belongs to one attempt of a task, and the rows, once written, name the attempt that succeeded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        drop_white, whole = vocabulary.kind == "words", vocabulary.whole()
        block = TaskContext.get().partitionId() << 32
        for b in chunks(batches, "text", block_bytes, 1 << 20):
            number, words, count = words_of(b.column("text"), drop_white, whole=whole)
            hashed = np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int32, len(words))
            # Words go out in order of bucket and bytes, which packs well; the block keeps that order of its numbers.
            order = pc.sort_indices(pa.table({"b": hashed, "w": words}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
            words, parts = words.take(pa.array(order)), np.searchsorted(hashed[order], np.arange(buckets + 1))
            name = f"block-{uuid.uuid4().hex}"
            with files.open_output_stream(f"{base}/{name}") as sink:
                sink.write(_join(_table_bytes(pa.table({"doc_id": b.column("doc_id"), "words": pa.array(count, pa.int64())})), pack(number, _planes(number)), pack(order, _planes(order))))
            used = [k for k in range(buckets) if parts[k] < parts[k + 1]] or [0]
            payload = [_pack_words(words.slice(int(parts[k]), int(parts[k + 1] - parts[k]))) for k in used]
            columns = [pa.array([block] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([f"{folder}/{name}"] * len(used)), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "path", "payload"])
            block += 1

    return docs.mapInArrow(run, _BLOCKS)


def _table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read_block(path: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    files, name = pyarrow.fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as source:
        table, number, order = _split(source.read())
    return pa.ipc.open_stream(table).read_all(), unpack(number), unpack(order)


def _encode_buckets(words: DataFrame, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """(block, bucket, path, payload): the ids of a block's words, a row for each block and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table, bucket = vocabulary.encoder(), None, None
        for b in batches:
            out = []
            for own, blob in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist()):
                if own != bucket:
                    table, bucket = WordTable(encode), own
                flat, length = table.ids_of(_unpack_words(blob))
                out.append(_join(pack(length, _planes(length)), pack(flat, _planes(flat))))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), b.column("path"), pa.array(out, pa.binary())], names=["block", "bucket", "path", "payload"])

    return words.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, _BLOCKS)


def packed_rows(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.Table:
    """doc_id, n_tokens, ids (packed numbers: `unpack`), a row for each document."""
    packed = [pack(x, 2 if len(x) and x.max() < 65536 else _planes(x)) for x in ids]
    return pa.table({"doc_id": doc_ids, "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(packed, pa.binary())})


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, block_bytes: int = 32 << 20, finish: Callable[[pa.Array, list[np.ndarray]], pa.Table] = packed_rows, columns: str = "n_tokens long, ids binary") -> DataFrame:
    """doc_id, n_tokens, ids (packed), one row per input row; `end_id` is added to each document.

    `finish` makes other rows of a block's document ids and their token ids, in the task that put them together; `columns`
    are its columns after doc_id. One Python process then serves a task, where a second step behind would take another.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    buckets = min(4096, max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    folder = scratch_path(docs.sparkSession, "sequences")
    blocks = stage_table(_blocks(rows, vocabulary, buckets, block_bytes, folder), "blocks")
    coded = _encode_buckets(blocks, vocabulary, buckets)

    def assemble(key, ids):
        by_bucket = sorted(zip(ids.column("bucket").to_pylist(), ids.column("payload").to_pylist()))
        fields = [[unpack(x) for x in _split(blob)] for _, blob in by_bucket]
        length = np.concatenate([f[0] for f in fields]).astype(np.int64)
        flat = np.concatenate([f[1] for f in fields])
        kept, number, order = _read_block(ids.column("path")[0].as_py())
        sizes, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        sizes[order], starts[order] = length, np.cumsum(length) - length
        edges = np.append(0, np.cumsum(kept.column("words").to_numpy()))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = number[a:b]
            got = gather(flat, starts[own], sizes[own])
            out.append(got if end_id is None else np.append(got, np.uint32(end_id)))
        return finish(kept.column("doc_id").combine_chunks(), out)

    return spread(coded, blocks.select("block").distinct().count(), "block").groupBy("block").applyInArrow(assemble, f"doc_id {kind}, {columns}")
