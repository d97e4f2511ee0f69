"""Substring dedup by level-wise doubling over word windows.

A window is `window` consecutive words. Candidates start as windows of a quarter of that length; those repeated in a second
document are extended to twice the length, those repeated there to twice that again, and so on up to `window` words or until
no candidates survive. For 50 words the levels are 13, 26 and 50. A longer window can repeat only where its parts do.

The first level is thinned without loss: of the short windows within a long one, the one with the least hash stands for it
(its *anchor*). Equal long windows hold equal short ones, so they choose the same. Neighbouring long windows mostly share
their anchor and the side to which it is extended at the second level; such a row of windows is a *run*, known by the digest
of all its words, and one row stands for it.

1. Level 1: the anchors of each document. Those in two or more documents survive (partial aggregates).
2. Level 2: runs of surviving anchors, by the hash of the doubled anchor. What occurs in one document alone goes again.
3. Last level: a run that begins whole in a smaller document is settled. Where a doubled anchor has several runs - the edges of
   a repeat - each distinct run is extended to its full windows, once, from the smallest document that holds it. Windows meet
   by digest; each learns the smallest document that it starts in, and from that its run's rows follow.
4. Marks gather by document, which cuts its covered words.

Hashes of levels 1 and 2 only choose candidates: a collision costs work. What decides is XXH3-128 over the bytes of a run or
window. Survivors of a level are written to the shared folder before they meet the rows, so both sides of such a join are
plain shuffles and adaptive execution splits a passage that very many documents carry.

Contract of `remove_repeated`: one row per input row.
* null and blank texts have no words and lose nothing; a text shorter than a window loses nothing.
* texts of any length are read whole; a long text is a batch of its own.
* a document never loses words to itself, nor to rows of equal id; a row with a null id loses nothing and takes nothing.
* windows are judged on the input, so removed words still count as seen elsewhere.
* an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage_table, text_or_empty
from .textarrays import chunks, sliding_min, spaced_words, span_digests, text_bytes, window_hashes, word_hashes, word_spans

_CHUNK = 1 << 19
_SIDES = (np.uint64(0), np.uint64(0x6A09E667F3BCC909))


def levels(window: int) -> list[int]:
    """Lengths of the levels: a quarter of the window, then doubled up to it."""
    sizes = [-(-window // 4)]
    while sizes[-1] < window:
        sizes.append(min(window, 2 * sizes[-1]))
    return sizes


class Words:
    """The words of a batch of texts: a hash of each, the text of each, and the first word of each text."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = text_bytes(texts)
        self.start, self.end, self.owner = word_spans(self.data, offsets)
        self.first = np.searchsorted(self.owner, np.arange(len(offsets)))
        self.codes = word_hashes(self.data, self.start, self.end)

    def digests(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return span_digests(*spaced_words(self.data, self.start, self.end), first, words)


def runs_of(codes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of each run: hash of its anchor, hash of the doubled anchor, first word, number of windows."""
    none = np.zeros(0, np.int64)
    empty = none.view(np.uint64), none.view(np.uint64), none, none
    size, double, *_ = levels(window)
    whole = np.flatnonzero(owner[: len(codes) - window + 1] == owner[window - 1 :]) if len(codes) >= window else none
    if not len(whole):
        return empty
    anchors, doubled = window_hashes(codes, (size, double))
    low = np.uint64(max(26, int(len(codes)).bit_length()))
    ranked = ((anchors >> low) << low) | np.arange(len(anchors), dtype=np.uint64)  # least hash; of equal ones the first
    chosen = (sliding_min(ranked, window - size + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)[whole]
    # An anchor near the end of its window has no room to its right there and is doubled to its left.
    left = (chosen + double > whole + window).astype(np.int64)
    begin = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (left[1:] != left[:-1])))
    count = np.diff(np.append(begin, len(whole)))
    anchor, side = chosen[begin], left[begin]
    return anchors[anchor], doubled[anchor - side * (double - size)] ^ np.array(_SIDES)[side], whole[begin], count


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, anchor): the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", _CHUNK):
            words = Words(b.column("text"))
            anchor, _, first, _ = runs_of(words.codes, words.owner, window)
            row = words.owner[first]
            order = np.lexsort((anchor, row))
            row, anchor = row[order], anchor[order]
            new = np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]))[: len(row)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[new])), pa.array(anchor[new].view(np.int64))], names=["doc_id", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, anchor long")


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, anchor, double, run, run2, starts, n): each distinct run of a text with all its places."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", _CHUNK):
            words = Words(b.column("text"))
            anchor, double, first, count = runs_of(words.codes, words.owner, window)
            run1, run2 = words.digests(first, count - 1 + window)
            row = words.owner[first]
            # A text that repeats itself has the same run many times over: one row with all its places.
            order = np.lexsort((first, run2, run1, row))
            row, run1, run2, anchor, double, first, count = (x[order] for x in (row, run1, run2, anchor, double, first, count))
            new = np.append(True, (row[1:] != row[:-1]) | (run1[1:] != run1[:-1]) | (run2[1:] != run2[:-1]))[: len(row)]
            one = np.flatnonzero(new)
            starts = pa.ListArray.from_arrays(pa.array(np.append(one, len(row)).astype(np.int32)), pa.array((first - words.first[row]).astype(np.int32)))
            ids = pa.array(row[one])
            hashes = [pa.array(x[one].view(np.int64)) for x in (anchor, double, run1, run2)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(ids), b.column("text_key").take(ids), *hashes, starts, pa.array(count[one].astype(np.int32))],
                names=["doc_id", "text_key", "anchor", "double", "run", "run2", "starts", "n"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, anchor long, double long, run long, run2 long, starts array<int>, n int")


def _windows(firsts: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(run, run2, k, win, win2, doc_id): each window of the given runs, read from the text of one document each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = firsts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("run", "run2", "start", "n")).alias("runs"))
    with_text = wanted.join(docs, ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", _CHUNK):
            words = Words(b.column("text"))
            listed = b.column("runs")
            sizes = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            run1, run2, start, n = (flat.field(k).to_numpy() for k in ("run", "run2", "start", "n"))
            row = np.repeat(np.arange(b.num_rows), sizes)
            each = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            at = (words.first[row] + start)[each] + k
            win1, win2 = words.digests(at, np.full(len(at), window))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run1[each]), pa.array(run2[each]), pa.array(k.astype(np.int32)), pa.array(win1), pa.array(win2), b.column("doc_id").take(pa.array(row[each]))],
                names=["run", "run2", "k", "win", "win2", "doc_id"],
            )

    return with_text.select("doc_id", "text", "runs").mapInArrow(run, f"run long, run2 long, k int, win long, win2 long, doc_id {kind}")


def _in_two(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """The values of `key` that occur in two documents or more, in the shared folder."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *more).where("lo < hi")
    return stage_table(ends.drop("lo", "hi"), key)


def marks(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, starts, bits): bit k says that the windows at words start + k go. docs: doc_id, text_key, text."""
    known = docs.where("doc_id is not null")
    anchors = _in_two(_anchors(known, window), "anchor")
    first = stage_table(_runs(known, window).join(anchors, "anchor", "left_semi").drop("anchor"), "level_1")
    span = [f(c).alias(f"{n}_{c}") for c in ("run", "run2") for n, f in (("min", F.min), ("max", F.max))]
    doubles = _in_two(first, "double", *span)
    doubles = doubles.select("double", ((F.col("min_run") != F.col("max_run")) | (F.col("min_run2") != F.col("max_run2"))).alias("several"))
    found = stage_table(first.join(doubles, "double").drop("double"), "level_2")
    least = stage_table(found.groupBy("run", "run2").agg(F.min("doc_id").alias("lo"), F.first("several").alias("several")), "least")
    edges = least.where("several").select("run", "run2", F.col("lo").alias("doc_id"))
    firsts = found.where("several").join(edges, ["run", "run2", "doc_id"], "left_semi")
    firsts = firsts.groupBy("run", "run2", "doc_id").agg(F.min(F.struct("text_key", F.get("starts", 0).alias("start"), "n")).alias("at")).select("run", "run2", "doc_id", "at.*")
    windows = stage_table(_windows(firsts, known, window), "windows")
    smallest = windows.groupBy("win", "win2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    late = windows.join(smallest, ["win", "win2"]).where("lo < doc_id")
    late = late.groupBy("run", "run2").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("late_bits"))
    settled = stage_table(least.join(late, ["run", "run2"], "left").select("run", "run2", "lo", "late_bits"), "settled")
    bits = F.when(F.col("lo") < F.col("doc_id"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.coalesce("late_bits", F.lit(0).cast("bigint")))
    return found.join(settled, ["run", "run2"]).select("doc_id", "text_key", "starts", bits.alias("bits")).where("bits <> 0")


def covered(words: int, start: np.ndarray, bits: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's words lie in a marked window."""
    deep = np.zeros(words + 1, np.int64)
    for k in range(max((int(b).bit_length() for b in bits.tolist()), default=0)):
        at = start[(bits >> k) & 1 == 1] + k
        np.add.at(deep, at, 1)
        np.add.at(deep, at + window, -1)
    return np.cumsum(deep[:-1]) > 0


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc_id, text_key, marks): the marks of each document that loses words."""
    if not 8 <= window <= 80:
        raise ValueError("a run's windows are one long of bits: window must be 8 to 80 words")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return marks(rows, window).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("starts", "bits")).alias("marks"))


def cut_texts(texts: pa.Array, listed: pa.ListArray, window: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words and removed words of each text, and the kept words joined by one space."""
    data, offsets = text_bytes(texts)
    start, end, owner = word_spans(data, offsets)
    rows = len(offsets) - 1
    begin = np.searchsorted(owner, np.arange(rows + 1))
    gone = np.zeros(len(start), bool)
    edges, flat = listed.offsets.to_numpy(), listed.flatten()
    first = edges[0] if len(edges) else 0
    places = flat.field("starts")
    at, ends = places.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(np.diff(places.offsets.to_numpy())))
    bits = np.repeat(flat.field("bits").to_numpy(), np.diff(ends))
    for r in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)).tolist():
        own = slice(ends[edges[r] - first], ends[edges[r + 1] - first])
        gone[begin[r] : begin[r + 1]] = covered(begin[r + 1] - begin[r], at[own], bits[own], window)
    kept = ~gone
    s, e, o = start[kept], end[kept], owner[kept]
    last = np.append(o[1:] != o[:-1], True) if len(o) else np.zeros(0, bool)
    length = e - s + 1 - last  # each kept word and the space after it; the last of a text has none
    source = np.repeat(s - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    out = data[np.minimum(source, max(0, len(data) - 1))].copy()
    out[(np.cumsum(length) - 1)[~last]] = 32
    size = np.append(0, np.cumsum(np.bincount(o, length, rows).astype(np.int64)))
    text = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(size), pa.py_buffer(out)])
    n = np.diff(begin)
    return n, n - np.bincount(o, minlength=rows), text.cast(pa.string())


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_text (kept words joined by one space), one row per input row.

    A word goes if a window of `window` words around it also starts in a document of smaller id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", _CHUNK):
            n, removed, text = cut_texts(b.column("text"), b.column("marks"), window)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n), pa.array(removed), text], names=["doc_id", "text_key", "n_words", "n_removed", "kept_text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    joined = rows.join(_marked(docs, id_col, text_col, window), ["doc_id", "text_key"], "left").select("doc_id", "text_key", "text", "marks")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, text_key long, n_words long, n_removed long, kept_text string")


def strip_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """All rows and columns of `docs`; a text that loses words becomes its kept words joined by one space."""
    key, own_id, own_key, marked = fresh(docs.columns, "text_key", "marked_id", "marked_key", "marks")
    found = _marked(docs, id_col, text_col, window).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("marks").alias(marked))
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty(text_col)))
    joined = keyed.join(found, (F.col(id_col) == F.col(own_id)) & (F.col(key) == F.col(own_key)), "left").drop(own_id, own_key, key)
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col, _CHUNK):
            listed, columns = b.column(len(b.columns) - 1), b.columns[:-1]
            loses = listed.is_valid()
            if listed.null_count < b.num_rows:
                kept = cut_texts(columns[place].filter(loses), listed.filter(loses), window)[2]
                columns[place] = pc.replace_with_mask(columns[place], loses, kept.cast(columns[place].type))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return joined.mapInArrow(cut, docs.schema)
