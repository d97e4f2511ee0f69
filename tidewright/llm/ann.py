"""Nearest neighbours by largest inner product: randomly rotated one-bit codes, error bounds, exact reranking.

A vector minus the centre of a sample is rotated at random and reduced to the signs of its coordinates, packed
into bits, with its length and the cosine between it and its signs. From these an inner product with a query has an
estimate and an error bound; candidates whose upper bound reaches the k-th largest lower bound are scored exactly.

`build` packs codes, correction scalars and original vectors into blocks of `block_rows` rows, as a table in the shared
folder. `search` sends each block of queries to every group of blocks of codes, where it meets them one pair of blocks a
row - the work a scan of all codes for a stated query set takes. A group is `group_blocks` blocks at most, and fewer while
groups are fewer than four a core: what queries are sent grows with the groups, so with the table until groups are full. A
block of queries keeps the best k a query of a group; Spark's limited window keeps k a query after the shuffle.

The centre is the mean of some `sample_rows` vectors whose ids hash low (the origin where none does), summed where they are; it
affects how tight the bounds are, not which rows are indexed.
The bounds hold with high probability (`epsilon` deviations), so recall is measured against brute force in the tests.

Contract of `search`:
* null vectors, zero vectors, vectors with a null or non-finite component, or not of the table's commonest length take no
  part, as query or candidate; neither do null ids.
* ties go to the smaller vec_id; a query never finds the row it is; rows of equal id are one row's copies and never find
  each other.
* fewer candidates than k: all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stage_table

_BLOCK = "block long, dim int, ids binary, codes binary, scalars binary, vectors binary"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): rows that take part, of any length."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).where(F.exists("vec", lambda x: x != 0))


def _packed(x: np.ndarray) -> bytes:
    """Vectors in single precision where that changes none of them, else in double."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return (single if (single == x).all() else x.astype(np.float64)).tobytes()


def _unpacked(vectors: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(vectors, np.float32 if len(vectors) == 4 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)


def _pack(rows: DataFrame, blocks: int, encode) -> DataFrame:
    """Rows dealt by id into `blocks` blocks, each at most `block_rows` or so long, each packed into one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("vec_id").to_numpy()
            x = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            out = {"block": table.column("block")[0].as_py(), "dim": x.shape[1], "ids": ids.astype(np.int64).tobytes(), **encode(x)}
            return pa.RecordBatch.from_pylist([out], schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), *((k, pa.binary()) for k in ("ids", "codes", "scalars", "vectors"))]))

        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if held and len(part) and held[0].column("block")[0] != part.column("block")[0]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield packed(pa.Table.from_batches(held))

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "vec")
    return dealt.repartition("block").sortWithinPartitions("block", "vec_id").mapInArrow(run, _BLOCK)


class OneBitIndex:
    """Codes of all usable vectors of a table, in blocks."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, sample_rows: int = 2000, seed: int = 7):
        rows = usable(vectors, id_col, vec_col)
        lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.dim, self.rows = (lengths[0]["n"], lengths[0]["count"]) if lengths else (0, 0)
        self.vectors = rows.where(F.size("vec") == self.dim)
        self.block_rows, self.spark = block_rows, vectors.sparkSession
        if not self.rows:
            self.blocks = None
            return
        # An ordered limit would send `sample_rows` vectors of every task to the driver; sums by component are `dim` rows, whatever the tasks.
        sample = self.vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(self.rows)) < sample_rows)
        means = sample.select(F.posexplode("vec").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("mean")).collect()
        centre, turn, dim = np.zeros(self.dim), rotation(self.dim, seed), self.dim
        for r in means:
            centre[r["place"]] = r["mean"]
        self.centre, self.turn = centre, turn

        def encode(x: np.ndarray) -> dict:
            away = x - centre
            length = np.linalg.norm(away, axis=1)
            turned = (away / np.where(length > 0, length, 1)[:, None]) @ turn
            aligned = np.abs(turned).sum(axis=1) / np.sqrt(dim)  # cosine between a vector and its signs
            scalars = np.stack([length, np.where(length > 0, aligned, 1.0), x @ centre]).astype(np.float64)
            return {"codes": np.packbits(turned > 0, axis=1).tobytes(), "scalars": scalars.tobytes(), "vectors": _packed(x)}

        self.n_blocks = max(1, -(-self.rows // block_rows))
        self.blocks = stage_table(_pack(self.vectors, self.n_blocks, encode), "codes")

    def search(self, queries: DataFrame, k: int = 20, epsilon: float = 2.4, query_rows: int = 1024, group_blocks: int = 64) -> DataFrame:
        """query_id, rank, vec_id, score for usable `queries` (vec_id, vec) of the index's dimension."""
        if self.blocks is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        queries = queries.where(F.size("vec") == self.dim)
        count = queries.count()
        n_queries = max(1, -(-count // query_rows))
        asked = _pack(queries, n_queries, lambda x: {"codes": b"", "scalars": b"", "vectors": _packed(x)})
        # A stated query set against all blocks: a row for each pair of blocks, keyed by the group of blocks of codes.
        groups = max(-(-self.n_blocks // group_blocks), min(self.n_blocks, 4 * self.spark.sparkContext.defaultParallelism))
        to = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
        sent = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), to.alias("group"))
        coded = self.blocks.withColumn("group", F.col("block") % groups)
        # Merged, since a broadcast would go through the driver; more partitions than groups, so that few hold two.
        pairs = spread(sent, 4 * groups, "group").join(spread(coded, 4 * groups, "group").hint("merge"), "group")
        centre, turn, dim = self.centre, self.turn, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, best = None, []
            for batch in batches:
                for r in range(batch.num_rows):
                    blob = lambda name: batch.column(name)[r].as_py()  # noqa: E731, B023
                    found = _scan(blob("q_ids"), blob("q_vectors"), blob("ids"), blob("codes"), blob("scalars"), blob("vectors"), centre, turn, dim, k, epsilon)
                    if at == (blob("group"), blob("q_block")):
                        best = _best(best, found, k)
                        continue
                    if at:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])
                    at, best = (blob("group"), blob("q_block")), found
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])

        best = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(some: tuple, more: tuple, k: int) -> tuple:
    """The best k a query of both: query ids, ids, scores."""
    q, cand, score = (np.concatenate(x) for x in zip(some, more))
    order = np.lexsort((cand, -score, q))
    first = np.flatnonzero(np.diff(q[order], prepend=q[order[:1]] - 1))
    taken = order[np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < k]
    return q[taken], cand[taken], score[taken]


def _scan(q_ids: bytes, q_vectors: bytes, ids: bytes, codes: bytes, scalars: bytes, vectors: bytes, centre: np.ndarray, turn: np.ndarray, dim: int, k: int, epsilon: float):
    """The best k candidates of one block for each query of one block: query ids, ids, scores."""
    q_id, cand = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
    q, x = _unpacked(q_vectors, len(q_id), dim), _unpacked(vectors, len(cand), dim)
    length, aligned, with_centre = np.frombuffer(scalars, np.float64).reshape(3, -1)
    bits = np.unpackbits(np.frombuffer(codes, np.uint8).reshape(len(cand), -1), axis=1, count=dim)
    signs = ((2.0 * bits - 1) / np.sqrt(dim)).astype(np.float32)
    away = q - centre
    q_length = np.linalg.norm(away, axis=1)
    turned = (away @ turn).astype(np.float32)
    # <x, q> = <x, c> + <c, q - c> + |x - c| <u, q - c>, where u is estimated from its signs.
    base = with_centre[None, :] + (away @ centre)[:, None]
    estimate = base + length * (turned @ signs.T) / aligned
    spread = length * np.sqrt(np.maximum(0, 1 - aligned**2)) / aligned / np.sqrt(max(1, dim - 1))
    bound = epsilon * q_length[:, None] * spread[None, :] + 1e-6 * (1 + np.abs(estimate))
    estimate[cand[None, :] == q_id[:, None]] = -np.inf
    low = estimate - bound
    take = min(k, len(cand))
    floor = np.partition(low, len(cand) - take, axis=1)[:, len(cand) - take]
    out_q, out_id, out_score = [], [], []
    for i in range(len(q)):
        maybe = np.flatnonzero((estimate[i] + bound[i] >= floor[i]) & (cand != q_id[i]))
        score = (x[maybe] * q[i]).sum(axis=1)
        if len(maybe) > take:  # ids of ties go in order, so keep all that equal the last score taken
            keep = score >= np.partition(score, len(score) - take)[len(score) - take]
            maybe, score = maybe[keep], score[keep]
        order = np.lexsort((cand[maybe], -score))[:take]
        out_q.append(np.full(len(order), q_id[i]))
        out_id.append(cand[maybe[order]])
        out_score.append(score[order])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Searches for each row whose id is divisible by `every`, among all rows."""
    index = OneBitIndex(vectors, id_col, vec_col)
    return index.search(index.vectors.where(F.col("vec_id") % every == 0), k)
