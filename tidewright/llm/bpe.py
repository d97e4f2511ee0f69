"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

`encode` sends distinct words through `wordcodes` (see there); `decode` joins ids with the token-byte table, which has as
many rows as the vocabulary has tokens and is therefore broadcast.

Contract: one row per input row; null counts as empty, empty texts have no ids and decode to no bytes; repeated rows each
give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordcodes import Vocabulary, encode, gather, unpack

__all__ = ["Vocabulary", "decode", "digests", "encode", "token_bytes"]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table of a ranks file: all bytes, and start and length by id."""
    with open(path, "rb") as lines:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    size = max(table) + 1
    length = np.fromiter((len(table.get(i, b"")) for i in range(size)), np.int64, size)
    return np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8), np.cumsum(length) - length, length


def decoded_rows(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: list[np.ndarray]) -> pa.Array:
    """The bytes of each document's ids, by a join with the token-byte table."""
    data, start, length = table
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    size = np.append(0, np.cumsum(length[flat]))[np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)]
    out = gather(data, start[flat], length[flat])
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (binary) of rows with packed ids."""
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                ids = [unpack(x) for x in part.column("ids").to_pylist()]
                lists = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), lists, decoded_rows(table.value, ids)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, vocabulary: Vocabulary, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256: encoded, decoded and hashed in one
    pass where documents are put together, so that neither ids nor bytes leave the task."""
    table = docs.sparkSession.sparkContext.broadcast(token_bytes(path))

    def finish(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.Table:
        listed = [hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
        decoded = [hashlib.sha256(x).hexdigest() for a in range(0, len(ids), 256) for x in decoded_rows(table.value, ids[a : a + 256]).to_pylist()]
        return pa.table({"doc_id": doc_ids, "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(listed, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    return encode(docs, vocabulary, id_col, text_col, finish=finish, columns="n_tokens long, ids_sha256 string, decoded_sha256 string")
