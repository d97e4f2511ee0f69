"""Line dedup: hashes of lines in range partitions, sorted by document and position, streamed once.

1. Each line that has a key becomes a row of its key's digest, document and position. No text moves.
2. The rows are range-partitioned by digest, then document, then position, and sorted so within partitions. Ranges are drawn
   over the whole order, so a line that a third of all documents carry spans as many partitions as its rows fill.
3. A partition is one stream. Along each run of equal digests it counts documents; it holds the run's rows until the
   count is reached, and passes them on from there. Runs that lie whole within the partition are settled there.
4. A partition's first and last runs may go on in its neighbours. Their rows stay pending beside one summary row each - documents, first and
   last document, place of the partition - and the summaries of a digest, at most two a partition, settle them.
5. Dropped positions gather by document into a keep bitmap: bits of lines, least significant first, zlib-compressed.
   `cut` applies bitmaps to texts; whoever only needs the decisions never moves a text.

A key is the line without white space (U+0020, U+0009 to U+000D) at both ends and with A-Z lower-cased; a key shorter than
`min_points` code points takes no part. Keys are compared by XXH3-128.

Contract: one row per input row.
* a document is a distinct pair of id and text: rows repeated with equal id and text count once, rows of equal id and other
  texts are documents of their own; rows of null id are known by their text alone and come first in order.
* null counts as empty, and an empty text is one empty line. Texts of any length are read whole; a long text is a batch of its own.
* a line repeated within a document counts once toward its documents; where its key is to go, all of its lines go.
* `keep_first` leaves each such key's first line: smallest document, first position.
* an empty table gives an empty result; other columns are ignored by `bitmaps` and kept by `cut`, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, fresh, stage_table, text_or_empty
from .textarrays import chunks

_CHUNK = 1 << 22
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_KEYS = ("h1", "h2", "doc_id", "text_key", "pos", "copy")


def pack_keep(lines: int, dropped: np.ndarray) -> bytes:
    """The keep bitmap of a document of `lines` lines: bits, least significant first, zlib-compressed."""
    keep = np.ones(lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_keep(lines: int, packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=lines, bitorder="little").astype(bool)


def line_rows(docs: DataFrame, min_points: int) -> DataFrame:
    """h1, h2, doc_id, text_key, pos, copy, lines: a row for each line with a key, and one of pos -1 for the document.

    `copy` tells equal rows apart, so that ranges can part them.
    """
    white = WHITE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, copy = xxhash.xxh3_128_digest, TaskContext.get().partitionId() << 40
        for b in chunks(batches, "text", _CHUNK):
            digests, owner, pos, lines = [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                parts = text.encode().translate(_LOWER).split(b"\n")
                lines.append(len(parts))
                digests.append(bytes(16))
                owner.append(r)
                pos.append(-1)
                for p, line in enumerate(parts):
                    key = line.strip(white)
                    if key and (len(key) >= 4 * min_points or len(key.decode()) >= min_points):
                        digests.append(digest(key))
                        owner.append(r)
                        pos.append(p)
            halves, own = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), np.array(owner, np.int64)
            row = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]), b.column("doc_id").take(row), b.column("text_key").take(row),
                    pa.array(pos, pa.int32()), pa.array(copy + np.arange(len(own))), pa.array(np.array(lines, np.int32)[own]),
                ],
                names=[*_KEYS, "lines"],
            )
            copy += len(own)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, text_key long, pos int, copy long, lines int")


def _differs(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it, nulls being equal to each other; the first is compared with `before`."""
    shifted = pa.concat_arrays([pa.array([None if before is None else before.as_py()], column.type), column.slice(0, len(column) - 1)])
    unequal = pc.fill_null(pc.not_equal(column, shifted), False).to_numpy(zero_copy_only=False)
    return unequal | (column.is_null().to_numpy(zero_copy_only=False) != shifted.is_null().to_numpy(zero_copy_only=False))


class _Open:
    """The run that a partition's stream is in: documents so far, rows whose fate is open, its first and last row."""

    def __init__(self, rows: pa.RecordBatch, edge: bool):
        self.head, self.tail, self.edge = rows.slice(0, 1), rows.slice(0, 1), edge
        self.docs, self.held, self.begun = 0, [], False


def _stream(batches: Iterator[pa.RecordBatch], least: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows to go, pending rows and summaries of one sorted partition.

    kind 0: goes. kind 1: goes if its digest does. kind 2: as 1, and its run's first row here. kind 3: summary of an edge
    run: `docs` documents, `doc_id` and `text_key` of the first, `last_id` and `last_key` of the last.
    """
    part = TaskContext.get().partitionId()
    run: _Open | None = None

    def out(rows: pa.RecordBatch, kinds: np.ndarray, docs: int = 0, tail: pa.RecordBatch | None = None) -> pa.RecordBatch:
        n, tail = rows.num_rows, tail or rows
        columns = [*(rows.column(c) for c in _KEYS[:5]), pa.array(kinds.astype(np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, docs)), tail.column("doc_id"), tail.column("text_key")]
        return pa.RecordBatch.from_arrays(columns, names=[*_KEYS[:5], "kind", "part", "docs", "last_id", "last_key"])

    def add(rows: pa.RecordBatch, docs: int) -> Iterator[pa.RecordBatch]:
        """Rows of the open run; once it has documents enough, they pass."""
        run.docs += docs
        run.tail = rows.slice(rows.num_rows - 1, 1)
        run.held.append(rows)
        if run.docs >= least:
            yield from release(0)

    def release(kind: int) -> Iterator[pa.RecordBatch]:
        for rows in run.held:
            kinds = np.full(rows.num_rows, kind)
            if not run.begun and (kind or keep_first):
                kinds[0] = 2 if kind or run.edge else -1
            run.begun = True
            if (kinds >= 0).any():
                yield out(rows.slice(int(kinds[0] < 0)), kinds[kinds >= 0])
        run.held = []

    def close(edge: bool) -> Iterator[pa.RecordBatch]:
        if edge:
            yield from release(1)
            yield out(run.head, np.array([3]), run.docs, run.tail)

    for b in batches:
        if not b.num_rows:
            continue
        before = (lambda c: run.tail.column(c)[0]) if run else (lambda c: None)
        starts = _differs(b.column("h1"), before("h1")) | _differs(b.column("h2"), before("h2"))
        starts[0] |= run is None
        new = starts | _differs(b.column("text_key"), before("text_key")) | _differs(b.column("doc_id"), before("doc_id"))
        at = np.append(np.flatnonzero(starts), b.num_rows)
        if at[0]:
            yield from add(b.slice(0, int(at[0])), int(new[: at[0]].sum()))
        if len(at) == 1:
            continue
        first = run is None
        if run:
            yield from close(run.edge)
        whole = 0  # runs before the batch's last are whole; but the partition's first is an edge all the same
        if first and len(at) > 2:
            run, whole = _Open(b, True), 1
            yield from add(b.slice(0, int(at[1])), int(new[: at[1]].sum()))
            yield from close(True)
        if len(at) - 2 > whole:
            begin, end = int(at[whole]), int(at[-2])
            goes = np.repeat(np.add.reduceat(new[begin:end], at[whole:-2] - begin, dtype=np.int64) >= least, np.diff(at[whole:-1]))
            if keep_first:
                goes[at[whole:-2] - begin] = False
            if goes.any():
                rows = b.slice(begin, end - begin).filter(pa.array(goes))
                yield out(rows, np.zeros(rows.num_rows))
        rows = b.slice(int(at[-2]))
        run = _Open(rows, first and len(at) == 2)
        yield from add(rows, int(new[at[-2] :].sum()))
    if run:
        yield from close(True)


def _dropped(lines: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """(doc_id, text_key, pos): the lines that go."""
    kind = lines.schema["doc_id"].dataType.simpleString()
    schema = f"h1 long, h2 long, doc_id {kind}, text_key long, pos int, kind int, part int, docs long, last_id {kind}, last_key long"
    dealt = lines.where("pos >= 0").select(*_KEYS).repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
    found = stage_table(dealt.mapInArrow(lambda batches: _stream(batches, least, keep_first), schema), "lines_streamed")
    # Summaries of a digest follow each other by partition; a document that a border cuts counts on both sides.
    beside = Window.partitionBy("h1", "h2").orderBy("part")
    cut = F.lag("last_id").over(beside).eqNullSafe(F.col("doc_id")) & (F.lag("last_key").over(beside) == F.col("text_key"))
    edges = found.where("kind = 3").select("h1", "h2", "part", (F.col("docs") - F.coalesce(cut.cast("int"), F.lit(0))).alias("docs"))
    common = edges.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("part").alias("first_part")).where(F.col("docs") >= least).drop("docs")
    pending = found.where("kind in (1, 2)").join(F.broadcast(common), ["h1", "h2"])  # at most two rows a partition
    if keep_first:
        pending = pending.where("kind = 1 or part > first_part")
    return found.where("kind = 0").select("doc_id", "text_key", "pos").unionByName(pending.select("doc_id", "text_key", "pos"))


def _with_lists(docs: DataFrame, min_documents: int, min_points: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Lines of all documents, and the sorted dropped positions (doc_id, text_key, gone) of those that lose any."""
    if min_documents < 1 or min_points < 1:
        raise ValueError("min_documents and min_points are 1 at least")
    lines = stage_table(line_rows(docs, min_points), "lines")
    gone = _dropped(lines, min_documents, keep_first).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    return lines, gone


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10, min_points: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped, keep (bitmap), one row per input row."""
    lines, gone = _with_lists(_keyed(docs, id_col, text_col), min_documents, min_points, keep_first)
    documents = lines.where("pos = -1").select("doc_id", "text_key", "lines").alias("d")
    joined = documents.join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id and d.text_key = g.text_key"), "left").select("d.doc_id", "d.text_key", "lines", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dropped = [np.array(x or [], np.int64) for x in b.column("gone").to_pylist()]
            count = b.column("lines").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(count, pa.int64()), pa.array([len(x) for x in dropped], pa.int64()), pa.array([pack_keep(n, x) for n, x in zip(count, dropped)], pa.binary())],
                names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"],
            )

    kind = lines.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text_key long, n_lines long, n_dropped long, keep binary")


def _with_keeps(docs: DataFrame, keeps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with the bitmap of each text that loses lines as last columns: lines and bits. Repeated rows share one."""
    key, own_id, own_key, lines, bits = fresh(docs.columns, "text_key", "marked_id", "marked_key", "n_lines", "keep")
    marked = keeps.where("n_dropped > 0").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("n_lines").alias(lines), F.col("keep").alias(bits))
    marked = marked.groupBy(own_id, own_key).agg(F.first(lines).alias(lines), F.first(bits).alias(bits))
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty(text_col)))
    return keyed.join(marked, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left").drop(own_id, own_key, key)


def _cut(text: str, lines: int, packed: bytes) -> tuple[str, int]:
    """The kept lines of a text, and how many went."""
    parts = text.split("\n")
    kept = [parts[p] for p in np.flatnonzero(unpack_keep(lines, packed)).tolist()]
    return "\n".join(kept), len(parts) - len(kept)


def cut(docs: DataFrame, keeps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`; texts lose the lines that `keeps` (of `bitmaps`) drops."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns[:-2]
            if b.columns[-1].null_count < b.num_rows:
                texts = columns[place].to_pylist()
                for r, (n, packed) in enumerate(zip(b.columns[-2].to_pylist(), b.columns[-1].to_pylist())):
                    if packed is not None:
                        texts[r] = _cut(texts[r], n, packed)[0]
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2])

    return _with_keeps(docs, keeps, id_col, text_col).mapInArrow(run, docs.schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10, min_points: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, one row per input row."""
    rows = _keyed(docs, id_col, text_col)
    keeps = stage_table(bitmaps(rows, min_documents=min_documents, min_points=min_points, keep_first=keep_first), "keeps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(iter([whole]), "text", _CHUNK):
                texts, count, gone = [], [], []
                for text, n, packed in zip(*(b.column(c).to_pylist() for c in ("text", "n_lines", "keep"))):
                    kept, less = (text, 0) if packed is None else _cut(text, n, packed)
                    texts.append(kept)
                    count.append(text.count("\n") + 1)
                    gone.append(less)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return _with_keeps(rows.drop("text_key"), keeps, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")
