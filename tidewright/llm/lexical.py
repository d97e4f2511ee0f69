"""Ranked lexical search over term-partitioned postings by three-phase uniform thresholds (TPUT).

`Postings` numbers documents within blocks of a bounded number of documents and bytes. A term's list is cut by block, so the list of a term that every
document holds is as many rows as there are blocks, dealt over as many tasks. A row has the documents of its cut in descending order of impact, and its
first entries once more in columns of their own, the head.

`search` scores documents for each query by the sum of weight times impact over the query's terms:

1. Heads. The k entries of largest impact of each list give partial sums; the k-th largest of a query is a lower bound, t.
2. Uniform threshold. A query of m lists fetches from each the entries that are worth t / m or more: a prefix. A document in none of these prefixes is
   worth less than t. Sums of prefixes give a larger lower bound; a document whose sum, with just under t / m for each list it wasn't met in, stays
   below that is dropped.
3. Exact scores. What is left is looked up in all lists of its query, and the k best stay.

No phase leaves out a document that could be among the k best, ties included. Partial sums, candidates and exact scores go by query and block, as packed arrays;
a task holds one such group, or one cut of a list, at a time.

A bitmap of the terms asked for, of fixed size, keeps most other terms out of the postings of one search; what its collisions let in, the join on terms
drops. Counts of documents, lengths and holders of a term cover all documents.

Terms are maximal runs of ASCII letters and digits and of characters from U+0080 on, with A-Z lower-cased.

Contract:
* null texts have no terms; a document without terms doesn't count and is never found. Texts of any length are read whole.
* rows of equal id are documents of their own; rows of null id take part and go last among equal scores.
* queries without a term that scores give no rows; a query row is a query of its own, also where ids repeat.
* fewer documents that score than k: all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, text_or_empty
from .textarrays import chunks

_TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BITS = 1 << 22  # of the bitmap of terms asked for
_PIECE = 1 << 20
_BROADCAST_TERMS = 200_000  # query terms that are sent to every task; more meet the lists in a shuffle join


def term_counts(text: str) -> Counter[bytes]:
    """Occurrences of each term of a text."""
    data = text.encode().translate(_TERM_BYTES)
    if len(data) <= _PIECE:
        return Counter(data.split())
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """(1e9 * tf) div (1000 * tf + 12 * m), with m = 75 + (25 * n * documents) div terms."""
    sizes, at = np.unique(n, return_inverse=True)
    m = np.array([75 + 25 * s * documents // max(1, terms) for s in sizes.tolist()], np.int64)[at]
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows of sorted batches as dicts, by equal values of `keys`."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


def _batched(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of about `limit` bytes of binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= limit:
            yield _rows(held, schema)
            held, size = [], 0
    if held:
        yield _rows(held, schema)


_SUMS = [("q", pa.int64()), ("block", pa.int64()), ("idx", pa.binary()), ("worth", pa.binary())]


def _added(group: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a query and block, the sum of what each is worth and in how many lists it was met."""
    idx = np.concatenate([np.frombuffer(r["idx"], "<u2") for r in group])
    worth = np.concatenate([np.frombuffer(r["worth"], "<i8") for r in group])
    order = np.argsort(idx, kind="stable")
    own, starts = np.unique(idx[order], return_index=True)
    return own, np.add.reduceat(worth[order], starts), np.diff(np.append(starts, len(idx)))


def _kth(values: DataFrame, k: int, alias: str) -> DataFrame:
    """(q, alias): the k-th largest `worth` of each query that has k."""
    best = Window.partitionBy("q").orderBy(F.desc("worth"))
    return values.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).where(F.col("rank") == k).select("q", F.col("worth").alias(alias))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, item_id, term, times): the terms of each query row, q being its number."""
    rows = queries.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = TaskContext.get().partitionId() << 32
        for b in batches:
            counts = [term_counts(t) for t in b.column("text").to_pylist()]
            row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q + row), b.column("item_id").take(pa.array(row)), pa.array([t for c in counts for t in c], pa.binary()), pa.array([x for c in counts for x in c.values()], pa.int64())],
                names=["q", "item_id", "term", "times"],
            )
            q += len(counts)

    kind = rows.schema["item_id"].dataType.simpleString()
    return stage_table(rows.mapInArrow(run, f"q long, item_id {kind}, term binary, times long"), "query_terms")


def _bitmap(terms: DataFrame) -> bytes:
    """Bits of the hashes of all terms, `_BITS` in all."""
    at = F.pmod(F.xxhash64("term"), F.lit(_BITS)) + 1
    parts = terms.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    size = 4096  # bytes of each of Spark's bitmaps
    out = bytearray(_BITS // 8)
    for r in parts:
        out[(r["part"] - 1) * size : r["part"] * size] = r["bits"]
    return bytes(out)


class Postings:
    """Lists of the terms of all documents, or of the terms asked for: a table (term binary), repeats allowed."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, head: int = 32, block_docs: int = 1 << 14, block_bytes: int = 16 << 20):
        if not 0 < block_docs <= 1 << 16:
            raise ValueError("documents of a block are numbered in two bytes")
        rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
        self.kind = rows.schema["doc_id"].dataType.simpleString()
        raw = stage_table(self._blocks(rows, _bitmap(terms) if terms is not None else None, block_docs, block_bytes), "blocks")
        self.blocks = raw.where("term is null").select("block", "ids")
        totals = raw.where("term is null").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
        self.documents, self.terms = totals["documents"], totals["terms"]
        cuts = raw.where("term is not null").select("term", "block", "idx", "tf", "n")
        if terms is not None:
            cuts = cuts.join(terms.select("term").distinct(), "term", "left_semi")
        self.lists = stage_table(self._lists(cuts, head), "lists")
        self.holders = stage_table(self.lists.groupBy("term").agg(F.sum("holders").alias("df")), "holders")

    def _blocks(self, rows: DataFrame, wanted: bytes | None, block_docs: int, block_bytes: int) -> DataFrame:
        """A row of null term for each block - ids in order, documents with terms, their terms - and one for each of its terms: idx, tf and length of each holder."""
        kind = rows.schema["doc_id"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, known = TaskContext.get().partitionId() << 32, {}
            for b in chunks(batches, "text", block_bytes, block_docs):
                order = pc.sort_indices(b.column("doc_id"), null_placement="at_end")
                ids, texts = b.column("doc_id").take(order), b.column("text").take(order)
                at: dict[bytes, list[int]] = {}
                tf: dict[bytes, list[int]] = {}
                lengths = np.zeros(b.num_rows, np.int64)
                for d in range(b.num_rows):
                    counts = term_counts(texts[d].as_py())
                    lengths[d] = counts.total()
                    for term, times in counts.items():
                        if wanted is not None:
                            asked = known.get(term)
                            if asked is None:
                                bit = xxhash.xxh64_intdigest(term, 42) % _BITS
                                asked = known[term] = wanted[bit >> 3] >> (bit & 7) & 1
                            if not asked:
                                continue
                        if term in at:
                            at[term].append(d)
                            tf[term].append(times)
                        else:
                            at[term], tf[term] = [d], [times]
                if len(known) > 1_000_000:
                    known.clear()
                names = ["block", "term", "documents", "terms", "ids", "idx", "tf", "n"]
                one, none = lambda x, t: pa.array([x], t), lambda n, t: pa.nulls(n, t)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([one(block, pa.int64()), none(1, pa.binary()), one(int((lengths > 0).sum()), pa.int64()), one(int(lengths.sum()), pa.int64()), lists, *(none(1, pa.binary()) for _ in range(3))], names=names)
                found = sorted(at)
                for i in range(0, len(found), 4096):
                    own = found[i : i + 4096]
                    places = [np.array(at[t], np.int64) for t in own]
                    count = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(count, block)), pa.array(own, pa.binary()), none(count, pa.int64()), none(count, pa.int64()), none(count, lists.type),
                            pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()), pa.array([np.array(tf[t], "<i8").tobytes() for t in own], pa.binary()), pa.array([lengths[p].astype("<i8").tobytes() for p in places], pa.binary()),
                        ],
                        names=names,
                    )
                block += 1

        return rows.mapInArrow(run, f"block long, term binary, documents long, terms long, ids array<{kind.simpleString()}>, idx binary, tf binary, n binary")

    def _lists(self, cuts: DataFrame, head: int) -> DataFrame:
        """(term, block, holders, head_idx, head_impact, idx, impact), dealt by term, and by block within the lists of frequent terms."""
        documents, terms = self.documents, self.terms
        schema = [("term", pa.binary()), ("block", pa.int64()), ("holders", pa.int64()), ("head_idx", pa.binary()), ("head_impact", pa.binary()), ("idx", pa.binary()), ("impact", pa.binary())]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for term, block, idx, tf, n in zip(*(b.column(c).to_pylist() for c in ("term", "block", "idx", "tf", "n"))):
                    idx = np.frombuffer(idx, "<u2")
                    impact = impacts(np.frombuffer(tf, "<i8"), np.frombuffer(n, "<i8"), documents, terms)
                    order = np.lexsort((idx, -impact))
                    idx, impact = idx[order], impact[order].astype("<u4")
                    yield term, block, len(idx), idx[:head].tobytes(), impact[:head].tobytes(), idx.tobytes(), impact.tobytes()

        dealt = cuts.repartition("term", F.pmod(F.xxhash64("block"), F.lit(64))).sortWithinPartitions("term", "block")
        return dealt.mapInArrow(lambda batches: _batched(rows(batches), schema), "term binary, block long, holders long, head_idx binary, head_impact binary, idx binary, impact binary")

    def _weights(self, asked: DataFrame) -> DataFrame:
        """(q, term, weight, lists): the lists that score for each query; weight counts repeats in the query."""
        weight = F.floor(1000 * F.log((2.0 * F.lit(self.documents) + 2) / (2.0 * F.col("df") + 1))) * F.col("times")
        found = asked.join(self.holders, "term").select("q", "term", weight.cast("long").alias("weight")).where("weight > 0")
        return stage_table(found.withColumn("lists", F.count("*").over(Window.partitionBy("q"))), "weights")

    def search(self, asked: DataFrame, k: int = 20) -> DataFrame:
        """item_id, rank, doc_id, score for the queries of `query_terms`."""
        weights = self._weights(asked)
        few = weights.count() <= _BROADCAST_TERMS
        low = stage_table(self._heads(weights, k), "heads")
        due = weights.join(low, "q", "left").withColumn("low", F.coalesce("low", F.lit(0)).cast("long"))
        sums = stage_table(self._fetched(due, few, k), "sums")
        bounds = due.groupBy("q").agg(F.first("lists").alias("lists"), F.first("low").alias("low"))
        bounds = bounds.join(_kth(sums.select("q", F.explode("best").alias("worth")), k, "high"), "q", "left")
        bounds = bounds.withColumn("high", F.greatest("low", F.coalesce("high", F.lit(0)).cast("long")))
        candidates = stage_table(self._candidates(sums, bounds), "candidates")
        return self._ranked(self._exact(candidates, weights, k), asked, k)

    def _heads(self, weights: DataFrame, k: int) -> DataFrame:
        """Phase 1. (q, low): the k-th largest sum over heads."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                idx = [np.frombuffer(x, "<u2") for x in b.column("head_idx").to_pylist()]
                if not idx:
                    continue
                row = pa.array(np.repeat(np.arange(len(idx)), [len(x) for x in idx]))
                impact = np.concatenate([np.frombuffer(x, "<u4") for x in b.column("head_impact").to_pylist()]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("term").take(row), b.column("block").take(row), pa.array(np.concatenate(idx).astype(np.int32)), pa.array(impact)], names=["term", "block", "idx", "impact"])

        heads = self.lists.select("term", "block", "head_idx", "head_impact").mapInArrow(rows, "term binary, block long, idx int, impact long")
        top = Window.partitionBy("term").orderBy(F.desc("impact"), "block", "idx")
        heads = stage_table(heads.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank"), "list_heads")
        worth = heads.join(weights, "term").groupBy("q", "block", "idx").agg(F.sum(F.col("weight") * F.col("impact")).alias("worth"))
        return _kth(worth, k, "low")

    def _fetched(self, due: DataFrame, few: bool, k: int) -> DataFrame:
        """Phase 2. (q, block, idx, worth, met, best): sums over the prefixes that reach the threshold, and the k largest of them."""
        least = F.greatest(F.lit(1), F.ceil(F.col("low") / (F.col("lists") * F.col("weight"))) - 1)  # a double may be off by one; the task compares whole numbers
        due = due.select("term", F.struct("q", "weight", "lists", "low", least.cast("long").alias("least")).alias("ask"), F.pmod(F.xxhash64("q"), F.lit(1 + due.select("q").distinct().count() // 256)).alias("part"))
        asks = due.groupBy("term", "part").agg(F.collect_list("ask").alias("asks")).drop("part")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for block, idx, impact, asks in zip(*(b.column(c).to_pylist() for c in ("block", "idx", "impact", "asks"))):
                    idx, impact = np.frombuffer(idx, "<u2"), np.frombuffer(impact, "<u4").astype(np.int64)
                    rising = -impact
                    for ask in asks:
                        end = int(np.searchsorted(rising, -ask["least"], side="right"))
                        while end and ask["lists"] * ask["weight"] * int(impact[end - 1]) < ask["low"]:
                            end -= 1
                        if end:
                            yield ask["q"], block, idx[:end].tobytes(), (impact[:end] * ask["weight"]).tobytes()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for group in _runs(batches, "q", "block"):
                idx, worth, met = _added(group)
                yield group[0]["q"], group[0]["block"], idx.astype("<u2").tobytes(), worth.tobytes(), met.astype("<i4").tobytes(), np.sort(worth)[::-1][:k].tolist()

        met = self.lists.select("term", "block", "idx", "impact").join(F.broadcast(asks) if few else asks, "term")
        parts = met.mapInArrow(lambda x: _batched(fetch(x), _SUMS), "q long, block long, idx binary, worth binary")
        dealt = parts.repartition("q", "block").sortWithinPartitions("q", "block")
        schema = [*_SUMS, ("met", pa.binary()), ("best", pa.list_(pa.int64()))]
        return dealt.mapInArrow(lambda x: _batched(add(x), schema), "q long, block long, idx binary, worth binary, met binary, best array<long>")

    def _candidates(self, sums: DataFrame, bounds: DataFrame) -> DataFrame:
        """(q, block, idx): documents that may still be among the k best."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for r in b.to_pylist():
                    idx, worth, met = np.frombuffer(r["idx"], "<u2"), np.frombuffer(r["worth"], "<i8"), np.frombuffer(r["met"], "<i4")
                    most = worth + (r["lists"] - met) * (r["low"] / r["lists"])  # in doubles, whose rounding only keeps more
                    left = idx[most * (1 + 1e-9) >= r["high"]]
                    if len(left):
                        yield r["q"], r["block"], left.tobytes()

        return sums.drop("best").join(bounds, "q").mapInArrow(lambda x: _batched(run(x), _SUMS[:3]), "q long, block long, idx binary")

    def _exact(self, candidates: DataFrame, weights: DataFrame, k: int) -> DataFrame:
        """Phase 3. (q, block, idx, score): the k best of each query and block by exact score."""
        asked = candidates.join(weights, "q").select("term", "block", F.lit(1).alias("kind"), "q", "weight", "idx", F.lit(None).cast("binary").alias("impact"))
        held = self.lists.select("term", "block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("weight"), "idx", "impact")
        held = held.join(candidates.select("block").distinct(), "block", "left_semi").select(asked.columns)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            term, block, idx, impact = None, None, None, None
            for b in batches:
                for r in b.to_pylist():
                    own = np.frombuffer(r["idx"], "<u2")
                    if not r["kind"]:
                        order = np.argsort(own)
                        term, block, idx, impact = r["term"], r["block"], own[order], np.frombuffer(r["impact"], "<u4")[order].astype(np.int64)
                    elif r["term"] == term and r["block"] == block:
                        at = np.minimum(np.searchsorted(idx, own), len(idx) - 1)
                        hit = idx[at] == own
                        if hit.any():
                            yield r["q"], block, own[hit].tobytes(), (impact[at[hit]] * r["weight"]).tobytes()

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for group in _runs(batches, "q", "block"):
                idx, score, _ = _added(group)
                for at in np.lexsort((idx, -score))[:k].tolist():
                    yield group[0]["q"], group[0]["block"], int(idx[at]), int(score[at])

        met = asked.unionByName(held).repartition("term", "block").sortWithinPartitions("term", "block", "kind")
        parts = met.mapInArrow(lambda x: _batched(look_up(x), _SUMS), "q long, block long, idx binary, worth binary")
        dealt = parts.repartition("q", "block").sortWithinPartitions("q", "block")
        schema = [("q", pa.int64()), ("block", pa.int64()), ("idx", pa.int32()), ("score", pa.int64())]
        return dealt.mapInArrow(lambda x: _batched(best(x), schema), "q long, block long, idx int, score long").where("score > 0")

    def _ranked(self, scored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """Ids of the documents that reach the k-th score, then ranks."""
        reach = Window.partitionBy("q").orderBy(F.desc("score"))
        near = scored.withColumn("rank", F.rank().over(reach)).where(F.col("rank") <= k)
        by_block = near.groupBy("block").agg(F.collect_list(F.struct("q", "idx", "score")).alias("found"))
        named = by_block.join(self.blocks, "block").select("block", F.explode(F.transform("found", lambda x: F.struct(x["q"].alias("q"), x["idx"].alias("idx"), x["score"].alias("score"), F.get("ids", x["idx"]).alias("doc_id")))).alias("x"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "idx")
        ranked = named.select("block", "x.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.join(asked.select("q", "item_id").distinct(), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of each query row; lists are built for the terms asked for."""
    asked = query_terms(queries, query_id, query_text)
    return Postings(docs, id_col, text_col, terms=asked, head=max(32, k)).search(asked, k)
