"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, connected components.

1. `fingerprints`: 64-bit SimHash of word shingles for each row; nothing is shuffled.
2. Equal fingerprints fold into one (partial aggregates first), so copies cost nothing further.
3. `links`: a fingerprint is cut into `bits + 2` blocks. Two fingerprints within `bits` differing bits agree on at least
   two blocks, so each is sent out under every pair of blocks; fingerprints that share a pair meet and are compared.
   Of a bucket only the edges of a spanning forest leave: the walk from a fingerprint compares it with those that no
   earlier walk has reached, so no bucket emits all its pairs and every connection stays.
   Buckets of more than `bucket_rows` fingerprints are cut into parts, and each pair of parts is a task of its own.
4. `components`: least-label spreading with pointer jumping over the edges, written to the shared folder between rounds.

Contract of `near_duplicates`: one row per input row.
* null text counts as empty; no words: fingerprint zero, linked like any other; fewer words than a shingle: one shingle.
* a null id links like any other but is never the smallest of a component, unless all ids there are null.
* texts of any length are hashed whole; a long text is a batch of its own.
* repeated rows and equal ids each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage_table, text_or_empty
from .textarrays import chunks, spaced_words, text_bytes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle and the number of shingles of each text."""
    start, end, owner = word_spans(data, offsets)
    texts = len(offsets) - 1
    words = np.bincount(owner, minlength=texts)
    joined, at = spaced_words(_LOWER[data], start, end)
    first_word = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    first = np.repeat(first_word - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = np.minimum(first + size, np.repeat(first_word + words, count)) - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(at[first].tolist(), (at[last + 1] - 1).tolist())), np.uint64, len(first))
    return hashes, count


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text, the bits set in more than half of its hashes, as an unsigned number."""
    out = np.zeros(len(count), np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        begin = (np.cumsum(count) - count)[has]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * ones > count[has, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key, fp (the 64 bits as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 19):
            data, offsets = text_bytes(b.column("text"))
            fp = majority_bits(*shingle_hashes(data, offsets, shingle, seed))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def block_pairs(bits: int) -> list[tuple[int, int]]:
    """(mask, number) of every pair of the bits + 2 blocks; masks as signed longs."""
    edges = [round(64 * k / (bits + 2)) for k in range(bits + 3)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [(m - (1 << 64) if m >> 63 else m, k) for k, m in enumerate(x | y for x, y in combinations(masks, 2))]


def forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links (`bits` differing bits or fewer) between these fingerprints."""
    left, one, other = np.arange(len(fp)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= bits
            if near.any():
                reached = left[near]
                one.append(np.full(len(reached), u))
                other.append(reached)
                queue.extend(reached.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(one), np.concatenate(other)) if one else (none, none)


def _bucket_edges(keys: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal keys; runs of two at once, larger ones by `forest`."""
    begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    size = np.diff(np.append(begin, len(fp)))
    two = begin[size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
    a, b = [fp[two]], [fp[two + 1]]
    for s, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        own = fp[s : s + n]
        i, j = forest(own, bits)
        a.append(own[i])
        b.append(own[j])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, bits: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(a, b): edges that connect whatever distinct fingerprints within `bits` bits connect; each at most `bits` bits long."""
    pairs = F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(k).alias("slot")) for m, k in block_pairs(bits)])
    sent = distinct.select("fp", F.explode(pairs).alias("p")).select("fp", F.col("p.slot").alias("slot"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("block"))
    # Parts of large buckets: with n parts, part i meets part j under the key (i, j); a bucket of usual size has one part.
    sizes = sent.groupBy("slot", "block").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    met = sent.join(sizes.select("slot", "block", parts.alias("parts")), ["slot", "block"])
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = met.select("fp", "slot", "block", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("slot", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    keys = ["slot", "block", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in [*keys, "fp"]], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last key may go on in the next batch
            held = rows[cut:]
            if cut:
                yield edges(rows[:cut])
        if held is not None and len(held):
            yield edges(held)

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        a, b = _bucket_edges(rows[:, :4], np.ascontiguousarray(rows[:, 4]).view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of an edge reaches; nodes without edges don't occur.

    Alternates large-star and small-star steps: all that a node knows is linked to the least of it. Neighbour lists are
    never gathered, only their minimum, which has partial aggregates.
    """
    now = stage_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before they meet the edges: both sides of the join are then plain shuffles, and a hub's can be split.
        low = stage_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage_table(large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        least = stage_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = stage_table(small, "edges")
        # Settled when every node has one edge and no node is both above and below another: all point at roots.
        stars = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0
        many = after.groupBy("u").count().where("count > 1").limit(1).count() == 0
        now = after
        if stars and many:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key, fp, fingerprint (16 hexadecimal digits), root, component_id (smallest doc_id reachable over links)."""
    rows = stage_table(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    found = components(links(distinct.select("fp"), bits))
    of = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    of = stage_table(of, "roots")
    least = stage_table(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = stage_table(of.join(least, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that have the smallest id of their root in `found` (doc_id, text_key, root), one for each root.

    Of rows repeated with equal id and text, one stays; only such rows are grouped after the join.
    """
    key, stay_id, stay_key, copies, whole = fresh(docs.columns, "text_key", "stay_id", "stay_key", "copies", "whole_row")
    counted = found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")).alias("first")
    stay = counted.groupBy("root").agg(best).select(F.col("first.doc_id").alias(stay_id), F.col("first.text_key").alias(stay_key), F.col("first.n").alias(copies))
    stay = stage_table(stay, "stay")
    hit = F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(key) == F.col(stay_key))
    kept = docs.withColumn(key, F.xxhash64(text_or_empty(text_col))).join(stay, hit)
    once = kept.where(F.col(copies) == 1).select(*docs.columns)
    own = F.first(F.struct(*[F.col(c) for c in docs.columns])).alias(whole)
    repeated = kept.where(F.col(copies) > 1).groupBy(stay_id, stay_key).agg(own).select(f"{whole}.*")
    return once.unionByName(repeated)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 4) -> DataFrame:
    """The rows of `docs` that have the smallest id of their component (one, if several have it), with all their columns."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, shingle, bits), id_col, text_col)
