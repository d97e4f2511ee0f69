import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, keep_first=False, min_points=1):
    """(doc_id, n_lines, n_dropped, kept text) of each row, by a plain loop."""
    docs = {}
    for d, t in rows:
        docs.setdefault((d is not None, d or 0, t or ""), (t or "").split("\n"))
    holders, first = {}, {}

    def key(line):
        k = line.strip(WHITE).translate(LOWER)
        return k if len(k) >= min_points else None

    for doc, lines in docs.items():
        for line in lines:
            if key(line):
                holders.setdefault(key(line), set()).add(doc)
    gone = {k for k, v in holders.items() if len(v) >= least}
    return docs, key, gone


def expected(rows, least, min_points=1):
    _, key, gone = brute(rows, least, min_points=min_points)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def liney(odd_rows):
    rng = random.Random(3)
    pool = [f"line number {i}" for i in range(30)] + ["  Shared LINE  ", "shared line", "\tShared Line\r", "ÉTÉ", "été", "x" * 5000, "", "   "]
    rows = [(1000 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(2000, "\n".join(["again and again"] * 3000)), (2001, "again and again"), (2002, "\n\n\n"), (2003, None), (2003, "shared line\nown"), (2003, "shared line\nown"), (None, "shared line\nmine"), (None, None)]
    rows += [(3000 + i, "everywhere\nown " + str(i)) for i in range(200)]
    return rows + odd_rows


@pytest.mark.parametrize("least", [1, 2, 5, 10])
def test_lines_against_a_plain_loop(spark, liney, least):
    docs = spark.createDataFrame(liney, "doc_id long, text string").repartition(5)
    got = sorted([tuple(r) for r in line_dedup.dedup(docs, min_documents=least).collect()], key=repr)
    assert got == expected(liney, least)


def test_short_keys_take_no_part(spark, liney):
    docs = spark.createDataFrame(liney, "doc_id long, text string").repartition(3)
    got = sorted([tuple(r) for r in line_dedup.dedup(docs, min_documents=2, min_points=4).collect()], key=repr)
    assert got == expected(liney, 2, min_points=4)


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("first", [False, True])
def test_ranges_that_cut_a_run(spark, liney, parts, first):
    """A line of nearly all documents lies over many ranges; borders neither double nor lose documents."""
    ids = [(d, t) for d, t in liney if d is not None and d >= 1000]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(ids, "doc_id long, text string").repartition(4)
        keeps = {(r.doc_id, r.text_key): r for r in line_dedup.bitmaps(docs, min_documents=5, keep_first=first).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs, key, gone = brute(ids, 5)
    keyed = {(r.doc_id, r.text): r.text_key for r in spark.createDataFrame([(d, t) for _, d, t in docs], "doc_id long, text string").withColumn("text_key", F.xxhash64("text")).collect()}
    order = sorted(docs, key=lambda x: (x[1], keyed[x[1], x[2]]))
    seen = set()
    for _, d, t in order:
        want = []
        for line in docs[True, d, t]:
            k = key(line)
            want.append(k not in gone or first and k not in seen)
            seen.add(k)
        row = keeps[d, keyed[d, t]]
        assert row.n_lines == len(want) and row.n_dropped == want.count(False)
        assert line_dedup.unpack_keep(row.n_lines, row.keep).tolist() == want


def test_batches_of_one_row_stream_alike(spark, liney):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = spark.createDataFrame(liney, "doc_id long, text string").repartition(2)
        got = sorted([tuple(r) for r in line_dedup.dedup(docs, min_documents=4).collect()], key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(liney, 4)


def test_cut_keeps_rows_and_columns(spark, odd_docs, odd_rows, no_docs):
    keeps = line_dedup.bitmaps(odd_docs, min_documents=2)
    got = line_dedup.cut(odd_docs, keeps)
    assert got.schema == odd_docs.schema
    want = [(d, k if t is not None else None) for (d, t), k in zip(odd_rows, [None] * len(odd_rows))]
    _, key, gone = brute(odd_rows, 2)
    want = sorted([(d, None if t is None else "\n".join(x for x in t.split("\n") if key(x) not in gone)) for d, t in odd_rows], key=repr)
    assert sorted([(r.doc_id, r.text) for r in got.select("doc_id", "text").collect()], key=repr) == want
    assert line_dedup.dedup(no_docs).count() == 0 and line_dedup.bitmaps(no_docs).count() == 0


def test_other_names_and_kinds_of_ids(spark):
    rows = [("a", "x\ny"), ("b", "X \nz"), (None, "x")]
    docs = spark.createDataFrame(rows, "id string, body string")
    got = {(r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.dedup(docs, "id", "body", min_documents=3).collect()}
    assert got == {("a", 1, "y"), ("b", 1, "z"), (None, 1, "")}
    with pytest.raises(ValueError):
        line_dedup.bitmaps(docs, "id", "body", min_documents=0)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000, 100_000):
        gone = np.flatnonzero(rng.random(n) < 0.3)
        keep = line_dedup.unpack_keep(n, line_dedup.pack_keep(n, gone))
        assert (np.flatnonzero(~keep) == gone).all() and len(keep) == n
    assert len(line_dedup.pack_keep(1_000_000, np.arange(0))) < 1000


def test_differing_neighbours_know_nulls():
    column = pa.array([None, None, 1, 1, 2, None])
    assert line_dedup._differs(column, pa.scalar(None, pa.int64())).tolist() == [False, False, True, False, True, True]
    assert line_dedup._differs(column, pa.scalar(3)).tolist()[0] is True


def test_query_on_the_given_table(spark, sf):
    from tidewright.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in expected(rows, 10)}
    got = queries.op11_line_dedup(spark, sf)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert {tuple(r) for r in got.collect()} == want
