"""Near-duplicates by the exact Jaccard similarity of shingle sets, with connected components.

1. `sketches`: for each row a hash of its set of shingle hashes (its *node*), the set's size, MinHash keys of `BANDS` bands of
   `BAND_ROWS` minima, and two bits of each minimum. Nothing is shuffled. Rows of equal sets are one node from here on.
2. SimHash names pairs first: nodes whose fingerprints lie within four bits, by `simhash.links` (`by_fingerprint`). What lies further apart
   and is alike still comes from the bands: nodes that share a band meet in its bucket. There each is paired with the least node there; near copies have that in common
   in most of their buckets, so a group of them makes a few pairs a member.
3. `likely` pairs - whose sizes and sketches don't rule the similarity out - are compared: the whole texts of these nodes alone
   are read again, and a pair is an edge only if its whole sets have the similarity asked for.
4. Where that left members of a bucket in different components, a walk over sketches finds which components likely pairs
   connect: their *families*. No bucket emits more edges than it has components.
5. Within a family the nodes that aren't of its largest component are compared with all, by whole sets, in pairs of parts of
   bounded size, each a group of its own. A pair of parts emits the edges that join components, never all pairs.

Fingerprints, bands and sketches decide only which pairs are compared. At similarity 0.8 a pair shares no band with probability 5e-8
((1 - 0.8**4)**32), and differs in more than 40 of 128 two-bit minima (19 are expected) with one of about 5e-6; less above.
64-bit fingerprints alone can't do this: at 0.8 they lie about 10 bits apart, so they name the closest pairs and the bands the rest.

Contract of `near_duplicates`: one row per input row.
* null text counts as empty; rows without words are alike; fewer words than a shingle: one shingle of all words.
* texts of any length are compared whole; a long text is a batch of its own.
* a null id links like any other but is never the smallest of a component, unless all ids there are null.
* repeated rows and equal ids each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, text_or_empty
from .simhash import components, keep_least, majority_bits, shingle_hashes
from .simhash import links as simhash_links
from .textarrays import chunks, mixed, text_bytes

BANDS, BAND_ROWS = 32, 4
MISMATCHES = 40
_SKETCH = ("s0", "s1", "s2", "s3")  # 32 two-bit values in each
_draw = np.random.default_rng(20240301)
_FLIP = _draw.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)
_TIMES = _draw.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and their number."""
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(count))


def minima(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of BANDS keys and one of four sketch words for each set; `begin` has where each begins, and none is empty."""
    keys, sketch = np.zeros((len(begin), BANDS), np.uint64), np.zeros((len(begin), len(_SKETCH)), np.uint64)
    if len(begin):
        for k, (flip, times) in enumerate(zip(_FLIP, _TIMES)):
            band = k // BAND_ROWS
            own = keys[:, band] if k % BAND_ROWS else np.full(len(begin), band, np.uint64)
            least = mixed(np.minimum.reduceat((hashes ^ flip) * times, begin))
            keys[:, band] = mixed(own * np.uint64(0x9E3779B97F4A7C15) ^ least)
            sketch[:, k // 32] |= (least & np.uint64(3)) << np.uint64(2 * (k % 32))
    return keys, sketch


class Sets:
    """The shingle sets of a batch of texts, one after another, and the node of each."""

    def __init__(self, texts: pa.Array, shingle: int, seed: int, simhash: bool = False):
        every, n = shingle_hashes(*text_bytes(texts), shingle, seed)
        self.fp = majority_bits(every, n) if simhash else None
        self.hashes, self.count = shingle_sets(every, n)
        self.edges = np.append(0, np.cumsum(self.count))
        view = memoryview(np.ascontiguousarray(self.hashes)).cast("B")
        self.bytes = [view[8 * x : 8 * y] for x, y in zip(self.edges[:-1].tolist(), self.edges[1:].tolist())]
        self.nodes = np.fromiter((xxhash.xxh64_intdigest(s) for s in self.bytes), np.uint64, len(self.bytes)).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, text_key, node (hash of the set), n (its size), keys, s0 to s3, fp (SimHash fingerprint), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 19):
            sets = Sets(b.column("text"), shingle, seed, simhash=True)
            has = sets.count > 0
            keys, own = minima(sets.hashes, sets.edges[:-1][has])
            sketch = np.zeros((len(has), len(_SKETCH)), np.uint64)
            sketch[has] = own
            offsets = pa.array(np.append(0, np.cumsum(has * BANDS)).astype(np.int32))
            columns = [b.column("doc_id"), b.column("text_key"), pa.array(sets.nodes), pa.array(sets.count.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))]
            columns += [pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(len(_SKETCH))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets.fp.view(np.int64))], names=["doc_id", "text_key", "node", "n", "keys", *_SKETCH, "fp"])

    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, node long, n long, keys array<bigint>, " + ", ".join(f"{s} long" for s in _SKETCH) + ", fp long")


def _suffixed(nodes: DataFrame, suffix: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(c + suffix) for c in nodes.columns])


def _likely(threshold: float) -> Column:
    """Whether sizes and sketches of x and y leave the similarity open."""
    size = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * threshold
    differ = [F.col(f"{s}_x").bitwiseXOR(F.col(f"{s}_y")) for s in _SKETCH]
    lanes = [F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555))) for d in differ]
    return size & (lanes[0] + lanes[1] + lanes[2] + lanes[3] <= MISMATCHES)


def _sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, in the shared folder: the text of one row of each is read again."""
    places = nodes.join(stage_table(wanted.distinct(), "wanted"), "node", "left_semi")
    places = stage_table(places.select(F.col("doc_id").alias("rep_id"), F.col("text_key").alias("rep_key")), "places")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 19):
            own = Sets(b.column("text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([pa.array(own.nodes), pa.array([bytes(s) for s in own.bytes], pa.binary())], names=["node", "shingles"])

    hit = (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    found = texts.join(places, hit, "left_semi").select("text").mapInArrow(sets, "node long, shingles binary")
    return stage_table(found.dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, shingle: int, seed: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have this Jaccard similarity at least, in the shared folder."""
    found = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), nodes, texts, shingle, seed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, other = b.column("one"), b.column("other")
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (one, other))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = shared / (len(both) - shared) >= threshold
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    met = pairs.join(found.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    met = met.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("other")), "b")
    return stage_table(met.select("a", "b", "one", "other").mapInArrow(compare, "a long, b long"), "edges")


def by_fingerprint(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b), a < b: pairs of nodes that SimHash links: each with the least of its fingerprint, and those least along the links of `simhash.links`."""
    least = stage_table(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprints")
    same = nodes.join(least, "fp").select(F.col("lead").alias("one"), F.col("node").alias("other"))
    linked = simhash_links(least.select("fp"), bits).distinct()
    linked = linked.join(least.select(F.col("fp").alias("a"), F.col("lead").alias("one")), "a").join(least.select(F.col("fp").alias("b"), F.col("lead").alias("other")), "b")
    pairs = same.unionByName(linked.select("one", "other")).where("one <> other")
    return pairs.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))


def links(rows: DataFrame, texts: DataFrame, threshold: float, shingle: int, seed: int) -> DataFrame:
    """(node, root) of the components that pairs of this similarity connect; nodes without a pair don't occur."""
    nodes = stage_table(rows.dropDuplicates(["node"]), "nodes")
    light = nodes.select("node", "n", *_SKETCH)
    x, y = _suffixed(light, "_x"), _suffixed(light, "_y")
    sent = nodes.select("node", F.explode("keys").alias("key"))
    buckets = stage_table(sent.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").drop("last"), "buckets")
    met = stage_table(sent.join(buckets, "key"), "met")
    banded = met.where("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    first = stage_table(by_fingerprint(nodes).unionByName(banded).distinct(), "pairs")
    likely = first.join(x, F.col("a") == F.col("node_x")).join(y, F.col("b") == F.col("node_y")).where(_likely(threshold)).select("a", "b")
    edges = verified(stage_table(likely, "likely"), nodes, texts, threshold, shingle, seed)
    found = components(edges)

    roots = stage_table(light.join(found, "node", "left").select("node", "n", *_SKETCH, F.coalesce("root", "node").alias("root")), "roots")
    of = met.select("key", "node").join(roots, "node")
    mixed_keys = stage_table(of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "split")
    of = stage_table(of.join(mixed_keys, "key").select("key", "node", "root", "n", *_SKETCH), "members")
    families = components(_families(of, threshold)).select(F.col("node").alias("root"), F.col("root").alias("family"))
    families = stage_table(families.union(families.select(F.col("family").alias("root"), "family")).distinct(), "families")
    if not families.limit(1).count():
        return found
    rest = roots.join(families, "root").withColumn("bytes", 8 * F.col("n"))
    more = stage_table(_compared(rest, nodes, texts, threshold, shingle, seed), "edges")
    return components(edges.union(more)) if more.limit(1).count() else found


def _likely_to(x: int, n: np.ndarray, sketch: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows sizes and sketches leave open for row x."""
    differ = sketch ^ sketch[x]
    lanes = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)
    return (lanes <= MISMATCHES) & (np.minimum(n, n[x]) >= np.maximum(n, n[x]) * threshold)


def _sketch_rows(t: pa.Table) -> tuple[np.ndarray, ...]:
    sketch = np.stack([t.column(s).to_numpy() for s in _SKETCH], axis=1).astype(np.int64).view(np.uint64)
    return t.column("node").to_numpy(), t.column("root").to_numpy(), t.column("n").to_numpy(), sketch


def _families(members: DataFrame, threshold: float, bucket_rows: int = 2048) -> DataFrame:
    """(a, b) of roots: edges of a spanning forest of what likely pairs connect within each bucket; at most its roots less one.

    Buckets of more than `bucket_rows` members are cut into parts, and each pair of parts is a group of its own.
    """
    sizes = stage_table(members.groupBy("key").agg(F.count("*").alias("rows")).select("key", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("parts")), "parts")
    met = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("key", "i", "j", "node", "root", "n", *_SKETCH)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("key", "i", "j")):
            _, root, n, sketch = _sketch_rows(t)
            left, one, other = np.arange(len(root)), [], []
            while len(left):
                queue = [int(left[0])]
                left = left[root[left] != root[queue[0]]]
                queue = np.flatnonzero(root == root[queue[0]]).tolist()
                while queue and len(left):
                    u = queue.pop()
                    near = left[_likely_to(u, n, sketch, threshold)[left]]
                    for r in np.unique(root[near]).tolist():
                        one.append(int(root[u]))
                        other.append(r)
                        queue += np.flatnonzero(root == r).tolist()
                    left = left[~np.isin(root[left], root[near])]
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])

    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(walk, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows as one table for each key; a key that a batch cuts is put together."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        held = None
        if not t.num_rows:
            continue
        values = np.stack([t.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
        begin = np.append(0, np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()
        for x, y in zip(begin, begin[1:]):
            yield t.slice(x, y - x).combine_chunks()
        held = t.slice(begin[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _compared(rest: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, shingle: int, seed: int, part_bytes: int = 2 << 20) -> DataFrame:
    """Edges between components of one family, by their whole sets.

    All nodes of a family but those of its largest component (the *minor* ones) meet all nodes, in pairs of parts of about
    `part_bytes` of sets. A pair of parts emits a spanning forest of what it finds: no family emits its pairs.
    """
    sizes = rest.groupBy("family", "root").agg(F.count("*").alias("members"))
    top = sizes.groupBy("family").agg(F.max(F.struct("members", "root")).alias("most")).select("family", F.col("most.root").alias("top"))
    weight = rest.groupBy("family").agg(F.sum("bytes").alias("w"))
    plan = stage_table(top.join(weight, "family").select("family", "top", F.greatest(F.lit(1), F.ceil(F.col("w") / part_bytes)).cast("int").alias("parts")), "plan")
    placed = rest.join(plan, "family").withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "minor": F.col("root") != F.col("top")})
    placed = stage_table(placed.select("family", "node", "root", "n", *_SKETCH, "part", "parts", "minor"), "placed")
    sets = _sets(placed.select("node"), nodes, texts, shingle, seed)
    # Part i of the minor nodes meets part j of all; a minor pair of parts is looked at once, by the smaller i.
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    as_minor = placed.where("minor").select("*", F.col("part").alias("i"), F.explode(each).alias("j"), F.lit(0).alias("side"))
    as_any = placed.select("*", F.explode(each).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"))
    met = as_minor.unionByName(as_any).join(sets, "node").select("family", "i", "j", "side", "node", "root", "n", *_SKETCH, "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("family", "i", "j")):
            node, root, n, sketch = _sketch_rows(t)
            side = t.column("side").to_numpy()
            column = t.column("shingles")
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
            parent = {r: r for r in root.tolist()}

            def find(r: int, parent: dict[int, int] = parent) -> int:
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            a, b = [], []
            for x in np.flatnonzero(side == 0).tolist():
                for y in np.flatnonzero(_likely_to(x, n, sketch, threshold) & (side == 1) & (root != root[x])).tolist():
                    if find(int(root[x])) == find(int(root[y])):
                        continue
                    both = np.sort(np.concatenate([sets_[x], sets_[y]]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if shared / (len(both) - shared) >= threshold:
                        parent[find(int(root[x]))] = find(int(root[y]))
                        a.append(int(node[x]))
                        b.append(int(node[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, text_key, root (of the component); rows have one root where pairs of this similarity connect them."""
    rows = stage_table(sketches(docs, id_col, text_col, shingle, seed), "sketches")
    found = links(rows, _texts(docs, id_col, text_col), threshold, shingle, seed)
    return rows.select("doc_id", "text_key", "node").join(found, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` that have the smallest id of their component (one, if several have it), with all their columns."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, shingle, threshold), id_col, text_col)
