import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, simhash, substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_substring(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone, reach = [False] * len(w), 0
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                for j in range(max(i, reach), i + window):
                    gone[j] = True
                reach = i + window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), kept))
    return Counter(out)


@pytest.mark.parametrize("window", [50, 12])
def test_substring_matches_brute_force(odd_docs, odd_rows, window):
    got = substring_dedup.remove_repeated(odd_docs, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substring(odd_rows, window)


def test_substring_of_nothing(no_docs):
    assert substring_dedup.remove_repeated(no_docs).count() == 0


def test_strip_keeps_columns_and_untouched_texts(odd_docs, odd_rows):
    got = substring_dedup.strip_repeated(odd_docs)
    assert got.columns == odd_docs.columns
    brute = brute_substring(odd_rows, 50)
    want = Counter()
    for d, t in odd_rows:
        kept = next(k for k in brute if k[0] == d and k[1] == len(words(t)) and (k[2] or k[3] == " ".join(words(t))))
        want[(d, kept[3] if kept[2] else t)] += 1
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=90), st.integers(8, 20))
def test_runs_cover_each_window_once(codes, window):
    codes = np.array(codes, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, _, first, count = substring_dedup.runs_of(codes, np.zeros(len(codes), np.int64), window)
    seen = [a + k for a, n in zip(first, count) for k in range(n)]
    assert sorted(seen) == list(range(max(0, len(codes) - window + 1)))
    assert not len(count) or count.max() < 64


def thue_morse(flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024))


def test_windows_that_only_a_weak_hash_calls_equal(spark):
    """Words, and sequences of words, whose polynomial hashes modulo 2**64 agree, differ in one place or in order alone."""
    start = [f"w{i}" for i in range(49)]
    long = [" ".join([*start, thue_morse(k)]) for k in (0, 1)]
    orders = [" ".join(["x", "y"][(i.bit_count() + k) % 2] for i in range(64)) for k in (0, 1)]
    rows = list(enumerate([*long, *orders]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated(docs, window=50).collect()} == {d: gone for d, _, gone, _ in brute_substring(rows, 50)} == dict.fromkeys(range(4), 0)


def test_levels_double():
    assert substring_dedup.levels(50) == [13, 26, 50] and substring_dedup.levels(12) == [3, 6, 12] and substring_dedup.levels(80) == [20, 40, 80]


@pytest.mark.parametrize("window", [50, 12])
def test_substring_of_the_given_tables(spark, sf, window):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeated(spark.read.parquet(f"{sf}/documents.parquet"), window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substring(rows, window)


@pytest.mark.parametrize("filter_bytes", [32 << 20, 0])
def test_exact_matches_brute_force(odd_docs, odd_rows, filter_bytes):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in odd_rows:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    got = exact_dedup.dedup(odd_docs, filter_bytes=filter_bytes).collect()
    want, kept_groups = Counter(), set()
    for d, t in odd_rows:
        own = groups[norm(t)]
        want[(d, min(own)[3], len(own), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    for r in got:
        if r.kept:
            assert r.doc_id == r.keep_id and r.text_sha256 not in kept_groups
            kept_groups.add(r.text_sha256)
    assert len(kept_groups) == len(groups)


@pytest.mark.parametrize("filter_bytes", [32 << 20, 0])
def test_exact_keep_one(odd_docs, no_docs, filter_bytes):
    kept = exact_dedup.keep_one(odd_docs, filter_bytes=filter_bytes)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    want = exact_dedup.dedup(odd_docs).where("kept").select("doc_id", "n_points")
    got = kept.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"))
    assert Counter(got.collect()) == Counter(want.collect())
    assert exact_dedup.dedup(no_docs).count() == 0 and exact_dedup.keep_one(no_docs).count() == 0


def test_filter_of_hits_moves_few_others(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(4000 + i, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.MergeIndex(spark)
    index.flush(docs)
    index.compact()
    marked = index.filtered(docs.withColumn("d", exact_dedup.digest_of()), "d", "maybe").where("maybe").select("doc_id").collect()
    ids = {r.doc_id for r in marked}
    assert ids >= {*range(200), *range(4000, 4200)} and len(ids) < 400 + 4000 // 8


def test_exact_index_merges_runs(spark, odd_docs):
    index = exact_dedup.MergeIndex(spark)
    index.flush(odd_docs.where("doc_id < 100"))
    index.flush(odd_docs.where("doc_id >= 100 or doc_id is null"))
    both = index.compact()
    whole = exact_dedup.MergeIndex(spark)
    whole.flush(odd_docs)
    assert Counter((r.digest, r.group_size, r.keep.doc_id) for r in both.collect()) == Counter((r.digest, r.group_size, r.keep.doc_id) for r in whole.compact().collect())


def brute_fingerprint(text, size=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(items, bits):
    """items: (id, fingerprint); least id reachable of each."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(items):
        least[find(i)].append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(items))]


def test_simhash_matches_brute_force(odd_docs, odd_rows):
    items = [(d, brute_fingerprint(t)) for d, t in odd_rows]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(items, brute_components(items, 4)))
    got = simhash.near_duplicates(odd_docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_of_nothing_and_keep_one(odd_docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs, shingle=4)
    assert kept.columns == odd_docs.columns
    assert kept.count() == simhash.near_duplicates(odd_docs).select("root").distinct().count()


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_links_keep_every_connection(spark, bucket_rows):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        at = int(c)
        for _ in range(25):  # chains and clusters round each centre
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(b)
            fps.add(at)
            if rng.random() < 0.6:
                at = int(c)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, 4, bucket_rows)
    rows = edges.collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in rows)
    found = dict((r.node, r.root) for r in simhash.components(edges).collect())
    items = [(signed(f), f) for f in fps]
    assert [found.get(d, d) for d, _ in items] == brute_components(items, 4)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), min_size=1, max_size=40, unique=True), st.integers(1, 4))
def test_forest_spans(fps, bits):
    a, b = simhash.forest(np.array(fps, np.uint64), bits)
    assert len(a) < len(fps)
    items = [(i, f) for i, f in enumerate(fps)]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(a.tolist(), b.tolist()):
        assert (fps[i] ^ fps[j]).bit_count() <= bits
        parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least.setdefault(find(i), i)
    assert [least[find(i)] for i in range(len(fps))] == brute_components(items, bits)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(500, 500)]
    found = dict((r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}} or found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}}
