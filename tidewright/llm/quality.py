"""Quality classifier: similarity-weighted voting of labelled neighbours in a latent-semantic space.

Texts become hashed term frequencies: byte 3-grams, and word patterns (a word that repeats the one before or the one two
before, marks within or after words, bars, capitals, word lengths). Weighted by inverse document frequency, they are
projected by a truncated singular value decomposition fitted on at most `sample_rows` labelled texts, the labelled set.
Each text's vector is compared with every labelled vector, block by block, exactly; the labels of its `neighbours` most
similar vote with weights that grow with similarity.

Broadcast: the labelled vectors and the projection. Both are bounded by `sample_rows`, `TERMS` and `dims` whatever the
corpus: 3,000 x 64 and 3,072 x 64 numbers of 8 bytes, 3 MB.

Contract of `score`: one row per input row.
* texts of any length are counted whole; a long text is a batch of its own.
* null and empty texts have no terms, are like no labelled text, and score the labelled set's mean label.
* scores lie in 0 to 1; equal texts score equally; ties among neighbours go to the labelled text whose id comes first as text.
* labels of null value or id, or outside 0 and 1, don't train; of several labels of an id the least counts; without any labelled text every score is 0.5.
* repeated rows each give a row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import chunks, gram_buckets, text_bytes, word_hashes, word_spans

GRAMS, PATTERNS = 2560, 512
TERMS = GRAMS + PATTERNS
_CHUNK = 1 << 19


def _kinds() -> np.ndarray:
    """0 letter or other, 1 capital, 2 digit, 3 sentence mark, 4 other mark."""
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[48:58] = 1, 2
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
    kind[[ord(c) for c in ".,;:?"]] = 3
    return kind


_KIND = _kinds()


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of each hashed term for each text, as a dense block; callers pass bounded batches."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    owner, bucket = gram_buckets(data, offsets, 3, GRAMS)
    out[:, :GRAMS] = np.bincount(owner * GRAMS + bucket, minlength=n * GRAMS).reshape(n, GRAMS)
    start, end, owner = word_spans(data, offsets)
    if not len(start):
        return out
    words = word_hashes(data, start, end)
    lag = lambda k: np.append(np.zeros(min(k, len(words)), bool), (words[k:] == words[:-k]) & (owner[k:] == owner[:-k]))
    kinds = _KIND[data]
    first, last = kinds[start], kinds[end - 1]
    marks = np.add.reduceat(np.append((kinds == 4), False).astype(np.int64), start)
    capitals = np.add.reduceat(np.append((kinds == 1), False).astype(np.int64), start)
    length = np.minimum(end - start, 15)
    same, same2 = lag(1), lag(2)
    shape = (np.minimum(marks, 3) * 4 + np.minimum(capitals, 3)) * 5 + last  # up to 80
    for base, value in ((0, shape), (80, 16 * (first == 1) + length), (112, same + 2 * same2), (116, np.minimum(marks, 7))):
        out[:, GRAMS : GRAMS + 256] += np.bincount(owner * 256 + base + value, minlength=n * 256).reshape(n, 256).astype(np.float32)
    follows = np.append(False, owner[1:] == owner[:-1])  # the word before is of the same text
    pair = np.where(follows, np.append(0, shape[:-1]), 0) * 31 + shape
    hashed = 256 + (pair * 2654435761 >> 7) % 256
    out[:, GRAMS + 256 :] += np.bincount(owner * 256 + hashed - 256, minlength=n * 256).reshape(n, 256).astype(np.float32)
    return out


class LatentVotes:
    """The projection, and the labelled vectors with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dims: int = 64, neighbours: int = 15, sharpness: float = 12.0):
        self.neighbours, self.sharpness = neighbours, sharpness
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            self.space = self.vectors = None
            return
        self.weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.3
        x = self._weighted(counts)
        random = np.random.default_rng(11).standard_normal((TERMS, min(dims + 16, *x.shape))).astype(np.float32)
        basis = x @ random
        for _ in range(2):
            basis, _ = np.linalg.qr(x @ (x.T @ np.linalg.qr(basis)[0]))
        _, _, vt = np.linalg.svd(basis.T @ x, full_matrices=False)
        self.space = np.ascontiguousarray(vt[:dims].T, np.float64)
        self.vectors = self._unit(x @ self.space)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        shares = [np.sqrt(c / np.maximum(1, c.sum(axis=1, keepdims=True))) for c in (counts[:, :GRAMS], counts[:, GRAMS:])]
        return np.hstack(shares) * self.weight

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if self.space is None:
            return out
        has = np.flatnonzero(counts.any(axis=1))
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(has), block):
            rows = has[a : a + block]
            # Rounded, so that a text's neighbours don't depend on the texts beside it in a batch.
            cosine = np.round(self._unit(self._weighted(counts[rows]) @ self.space) @ self.vectors.T, 9)
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            over, even = cosine > least, cosine == least
            # All that lie over the k-th, and of those equal to it the first.
            taken = over | (even & (np.cumsum(even, axis=1) <= k - over.sum(axis=1, keepdims=True)))
            best = np.nonzero(taken)[1].reshape(-1, k)
            near = np.take_along_axis(cosine, best, axis=1).astype(float)
            weight = np.exp(self.sharpness * (near - near.max(axis=1, keepdims=True)))
            out[rows] = np.round((weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1), 9)
        return np.clip(out, 0, 1)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows of 0 are held out from training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> LatentVotes:
    """Fits on at most `sample_rows` labelled rows outside the held-out fold, of each label half if there are so many.

    Sampling goes by a hash of the id. Only the sample's term counts come to the driver (37 MB at 3,000 rows). A labelled id
    that several rows have trains once, by the text with the least hash.
    """
    train = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(fold() != 0)
    train = train.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = [train.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for v in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # sample_rows rows of two numbers at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", _CHUNK):
            packed = pa.array([r.tobytes() for r in term_counts(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("label"), packed], names=["doc_id", "label", "counts"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(sample, "doc_id")
    # Rows of one id would train as often as they are repeated: the one with the least hash of its text stands for all.
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    rows = texts.select("doc_id", "label", "text").mapInArrow(count, "doc_id string, label int, counts binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return LatentVotes(counts, np.array([r["label"] for r in rows], float), **options)


def score(docs: DataFrame, model: LatentVotes, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", _CHUNK):
            values = shared.value.score(term_counts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: LatentVotes, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text_col, _CHUNK):
            yield b.filter(pa.array(shared.value.score(term_counts(b.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
