"""Token counts from flat, unindexed token files by a scan for separators.

A token file is nothing but ids of 2 bytes (4, where the vocabulary needs them), documents parted by an end id. `write_flat`
makes such files, one or more for each task, and notes the order of the documents. `scan` reads any such files: they are
cut into blocks of `block_tokens` wherever that falls, each block is searched for the end id in one vector operation, and
a prefix scan over the blocks of a file (the number of ends before a block, the place of the last one) stitches documents
that cross blocks.

Contract: one row per input row.
* null text counts as empty: its count is 1, the end id alone; repeated rows each give a row.
* `scan` gives a last document without end id, if a file has one, with closed = false; empty files give no rows.
* an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, spread, stage_table
from .textarrays import chunks
from .wordcodes import Vocabulary, WordTable, gather, words_of

_CHUNK, _CACHE_WORDS = 16 << 20, 400_000


def write_flat(docs: DataFrame, vocabulary: Vocabulary, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Write token files where the tasks run; (path, bytes, ordinal, doc_id): the place of each document in its file.

    Nothing is shuffled. Names are unique to an attempt, and only those of successful tasks reach the table.
    """
    folder = folder or scratch_path(docs.sparkSession, "flat")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        encode = vocabulary.encoder()
        words = WordTable(encode)
        for b in chunks(batches, "text", _CHUNK, 1 << 20):
            path = f"tokens-{uuid.uuid4().hex}.bin"
            if len(words.known) > _CACHE_WORDS:
                words = WordTable(encode)
            number, distinct, count = words_of(b.column("text"), vocabulary.kind == "words")
            flat, length = words.ids_of(distinct.to_pylist())
            start = np.cumsum(length) - length
            own = length[number]
            ends = np.append(0, np.cumsum(own))[np.cumsum(count)]
            tokens = np.insert(gather(flat, start[number], own), ends, end_id)
            if width == 2 and len(tokens) and tokens.max() >= 1 << 16:
                raise ValueError("ids of this vocabulary need width=4")
            with files.open_output_stream(f"{base}/{path}") as sink:
                sink.write(tokens.astype(f"<u{width}").tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{path}"] * n), pa.array(np.full(n, len(tokens) * width)), pa.array(np.arange(n)), b.column("doc_id")],
                names=["path", "bytes", "ordinal", "doc_id"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage_table(rows.mapInArrow(run, f"path string, bytes long, ordinal long, doc_id {kind}"), "order")


def blocks_of(files: DataFrame, width: int, block_tokens: int) -> DataFrame:
    """(path, tokens, first): the blocks of files (path, bytes), each for a task of its own."""
    tokens = F.floor(F.col("bytes") / width).cast("long")
    blocks = files.where(tokens > 0).select("path", tokens.alias("tokens"), F.explode(F.sequence(F.lit(0).cast("long"), tokens - 1, F.lit(block_tokens).cast("long"))).alias("first"))
    return spread(blocks, blocks.count(), "path", "first")


def scan(files: DataFrame, end_id: int, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """path, ordinal, start (token of the file), n_tokens (with the end id), closed, for files (path, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, total, first in zip(*(b.column(c).to_pylist() for c in ("path", "tokens", "first"))):
                system, name = pyarrow.fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as source:
                    ids = np.frombuffer(source.read_at(min(block_tokens, total - first) * width, first * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + first
                one = lambda x, t: pa.array([x], t)
                yield pa.RecordBatch.from_arrays([one(path, pa.string()), one(total, pa.int64()), one(first, pa.int64()), one(ends, pa.list_(pa.int64()))], names=["path", "tokens", "first", "ends"])

    found = blocks_of(files, width, block_tokens).mapInArrow(run, "path string, tokens long, first long, ends array<bigint>")
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    stitched = found.withColumns({
        "ordinal": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"),
        "carried": F.coalesce(F.max(last).over(before), F.lit(-1).cast("long")),
        "open": F.when(F.col("first") + block_tokens >= F.col("tokens"), F.greatest(F.coalesce(last, F.lit(-1).cast("long")), F.coalesce(F.max(last).over(before), F.lit(-1).cast("long")))),
    })
    # Documents that end in a block: each begins after the end before it, the first after the one carried in.
    starts = F.concat(F.array("carried"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    closed = stitched.where(F.size("ends") > 0).select("path", "ordinal", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("k", "p"))
    closed = closed.select("path", (F.col("ordinal") + F.col("k")).alias("ordinal"), (F.col("p.s") + 1).alias("start"), (F.col("p.e") - F.col("p.s")).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = stitched.where(F.col("open") < F.col("tokens") - 1)
    rest = rest.select("path", (F.col("ordinal") + F.size("ends")).alias("ordinal"), (F.col("open") + 1).alias("start"), (F.col("tokens") - 1 - F.col("open")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """doc_id and n_tokens (with the end id) of each row: token files written, then counted by the scan."""
    order = write_flat(docs, vocabulary, end_id, None, id_col, text_col, width)
    counted = scan(stage_table(order.select("path", "bytes").distinct(), "files"), end_id, width)
    # Paths repeat and pack well, so the order table's files look small enough to broadcast while its rows aren't.
    return order.join(counted.where("closed").hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens")
