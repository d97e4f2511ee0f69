import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import bpe, packing, queries, sstable, token_counts
from tidewright.llm.textarrays import text_bytes
from tidewright.llm.wordcodes import Vocabulary, cut_words, pack, unpack

RANKS, BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


BYTES_OF, WORDS_OF = library(BYTES), library(WORDS)

AWKWARD = st.text(st.sampled_from(list("abZ é'\"sdt.,!12 \n\r\t  　\x1c\x85́̌̈JHß|<>-😀")), max_size=40)


def parts(texts, drop_white):
    data, edges, count = cut_words(*text_bytes(pa.array(texts, pa.string())), drop_white)
    words = [bytes(data[a:b]).decode() for a, b in zip(edges[:-1], edges[1:])]
    ends = np.cumsum(count)
    return [words[e - n : e] for e, n in zip(ends, count)]


@settings(max_examples=300, deadline=None)
@given(st.lists(AWKWARD, min_size=1, max_size=5))
def test_words_encode_as_whole_texts(tik, texts):
    for text, cut in zip(texts, parts(texts, False)):
        assert "".join(cut) == text
        assert [i for w in cut for i in tik.encode_ordinary(w)] == tik.encode_ordinary(text)
        assert [i for w in cut for i in BYTES_OF(w)] == BYTES_OF(text)
    for text, cut in zip(texts, parts(texts, True)):
        assert [i for w in cut for i in WORDS_OF(w)] == WORDS_OF(text)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_numbers(values):
    x = np.array(values, np.uint32)
    assert unpack(pack(x, 4)).tolist() == values


def test_bpe_round_trip(odd_docs, odd_rows, no_docs, tik):
    v = Vocabulary("tiktoken", RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(bpe.encode(odd_docs, v, block_bytes=50_000), RANKS).collect()
    want = Counter((d, tuple(tik.encode_ordinary(t or "")), (t or "").encode()) for d, t in odd_rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.decode(bpe.encode(no_docs, v), RANKS).count() == 0


def test_shards(spark, odd_docs, odd_rows, no_docs):
    v = Vocabulary("bytes", BYTES)
    manifest = sstable.write(odd_docs, v, end_id=0, range_bytes=4_000, shard_bytes=3_000)
    assert manifest.count() > 5
    got = sorted(sstable.read(manifest).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(BYTES_OF(t or "")) + (0,)) for d, t in odd_rows)
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    hits = misses = 0
    for row in manifest.collect():
        shard = sstable.open_shard(row.path)
        assert shard.entries == row.entries and shard.tokens == row.tokens
        own = [d for d, _ in shard.scan()]
        for d in set(own):
            assert len(shard.get(d)) == own.count(d)
            hits += 1
        for d in range(10_000, 10_400):
            assert shard.get(d) == []
            misses += all(shard.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in sstable._probes(sstable.key_of(d), shard.bits))
    assert hits and misses < 0.05 * 400 * manifest.count()
    crcs = {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.digests(manifest).collect()}
    assert crcs == {r.start: (r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    assert sstable.read(sstable.write(no_docs, v, end_id=0)).count() == 0


def test_an_id_that_fills_ranges_is_dealt_out(spark):
    rows = [(i, f"few words {i}") for i in range(50)] + [(7, f"{'many words ' * 20}{i}") for i in range(300)] + [(None, "none")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bounds = sstable.range_bounds(docs, "doc_id", "text", 4000)
    assert (bounds == 7).sum() > 3 and (np.diff(bounds) >= 0).all()
    manifest = sstable.write(docs, Vocabulary("bytes", BYTES), end_id=0, range_bytes=4000)
    files = [sstable.open_shard(r.path) for r in manifest.orderBy("shard").collect()]
    assert sum(f.entries for f in files) == len(rows) and max(f.entries for f in files) < 150
    assert sum(len(f.get(7)) for f in files) == 301
    got = sorted(sstable.read(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()


def test_files_are_read_by_many_tasks(spark, odd_docs):
    """A task for each file or block, though rows that name them are small and adaptive execution is on."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    tasks = lambda df: df.withColumn("t", F.spark_partition_id()).select("t").distinct().count()
    manifest = sstable.write(odd_docs, Vocabulary("bytes", BYTES), end_id=0, range_bytes=2_000)
    assert manifest.count() > 5 and tasks(sstable.read(manifest)) > manifest.count() // 3
    order = token_counts.write_flat(odd_docs, Vocabulary("bytes", BYTES), 50256)
    blocks = order.select(F.ceil(F.col("bytes") / 2000).alias("n")).distinct().agg(F.sum("n")).first()[0]
    assert blocks > 20 and tasks(token_counts.scan(order.select("path", "bytes").distinct(), 50256, block_tokens=1000).where("ordinal >= 0")) >= 1
    read = token_counts.blocks_of(order.select("path", "bytes").distinct(), 2, 1000)
    assert tasks(read) > blocks // 3


def test_shard_of_many_blocks(tmp_path):
    sink = pyarrow.fs.LocalFileSystem().open_output_stream(str(tmp_path / "x.sst"))
    writer = sstable.ShardWriter(sink, block_bytes=200)
    for i in range(-500, 500):
        writer.add(sstable.key_of(i), pack(np.arange(i % 7), 1), i % 7)
    writer.close()
    sink.close()
    shard = sstable.open_shard(str(tmp_path / "x.sst"))
    assert len(shard.index) > 20
    assert all(shard.get(i)[0].tolist() == list(range(i % 7)) for i in range(-500, 500))
    assert [d for d, _ in shard.scan()] == list(range(-500, 500))
    (tmp_path / "y.sst").write_bytes((tmp_path / "x.sst").read_bytes()[:-1])
    with pytest.raises(ValueError):
        sstable.open_shard(str(tmp_path / "y.sst"))


def test_token_counts(odd_docs, odd_rows, no_docs):
    v = Vocabulary("bytes", BYTES)
    got = token_counts.count_tokens(odd_docs, v, end_id=50256).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(BYTES_OF(t or "")) + 1) for d, t in odd_rows)
    assert token_counts.count_tokens(no_docs, v, end_id=50256).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, want = [], []
    for k in range(6):
        tokens = rng.choice([0, 0, 5, 6, 9], rng.integers(0, 40)).astype("<u2") if k else np.zeros(0, "<u2")
        path = str(tmp_path / f"{k}.bin")
        tokens.tofile(path)
        files.append((path, tokens.nbytes))
        start = ordinal = 0
        for i, t in enumerate(tokens.tolist()):
            if t == 0:
                want.append((path, ordinal, start, i + 1 - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(tokens):
            want.append((path, ordinal, start, len(tokens) - start, False))
    got = token_counts.scan(spark.createDataFrame(files, "path string, bytes long"), 0, 2, block).collect()
    assert sorted((r.path, r.ordinal, r.start, r.n_tokens, r.closed) for r in got) == sorted(want)


def test_packing_of_the_given_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokenizer = Tokenizer.from_file(WORDS)
    want, total = Counter(), 0
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for a in range(0, len(ids), 2048):
            want[(d, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids))] += 1
    rows = queries.op2_packing(spark, sf).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048 and len(by) * 2048 < 1.03 * total + 2048


def test_packing(odd_docs, odd_rows, no_docs):
    v = Vocabulary("words", WORDS)
    packed = packing.pack_documents(odd_docs, v, end_id=1, capacity=256)
    pieces = packed.placed().collect()
    want = Counter((d, tuple(WORDS_OF(t or "")) + (1,)) for d, t in odd_rows)
    assert Counter(sum(([r.doc_tokens] if not r.start else [] for r in pieces), [])) == Counter(len(ids) for (_, ids), n in want.items() for _ in range(n))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    cut = Counter((d, a, len(ids[a : a + 256]), crc(ids[a : a + 256]), len(ids)) for (d, ids), n in want.items() for _ in range(n) for a in range(0, len(ids), 256))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == cut
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.append(0, np.cumsum([n for _, n in own]))[:-1].tolist() and sum(n for _, n in own) <= 256
    total = sum(n for _, n in (x for own in by.values() for x in own))
    assert len(by) * 256 - total == packed.plan.padding < 0.05 * total
    whole = packed.sequences().collect()
    assert sum(r.filled for r in whole) == total and len(whole) == len(by)
    assert all(len(r.ids) == 256 or len(r.ids) & (len(r.ids) - 1) == 0 for r in whole)
    assert packing.pack_documents(no_docs, v).placed().count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8), st.integers(0, 60))
def test_fill_is_the_largest_sum(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    used = packing.fill(counts, room)
    assert all(used[k] <= counts[k] for k in used)
    assert sum(k * n for k, n in used.items()) == max(sums)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(histogram):
    plan = packing.Plan(histogram, 64)
    spans = []
    for length, n in histogram.items():
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        spans += [(int(s), int(o), length) for s, o in zip(sequence, offset)]
    spans.sort()
    by = {}
    for s, o, n in spans:
        assert o == by.get(s, 0)
        by[s] = o + n
    assert all(v <= 64 for v in by.values()) and sorted(by) == list(range(plan.sequences))


def test_digest_of_decoded_bytes():
    data, start, length = bpe.token_bytes(RANKS)
    assert hashlib.sha256(data.tobytes()).hexdigest() and len(start) == len(length) == 50256
