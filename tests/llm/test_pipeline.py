"""The pipeline's stages against brute force on documents with planted cases."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import brute_substring, words
from tests.llm.test_jaccard import kept_ids


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """Whole tables of a small size, with an exact copy, a near copy and a shared passage added."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = docs.where("n_chars between 1500 and 4000").orderBy("doc_id").limit(3).collect()
    passage = " ".join(words(long[0].text)[20:90])
    extra = [(9001, "\n" + long[0].text, "en", "x", 0), (9002, long[1].text + " extra", "en", "x", 0), (9003, "A new beginning. " + passage + " and its own end.", "en", "x", 0)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    state, outputs = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, state, small).collect()
        outputs[name] = rows
        if name != "packing":
            assert [c for c in rows[0].asDict()] == names
            state = spark.createDataFrame(rows, docs.schema)
    texts = lambda n: {r.doc_id: r.text for r in outputs[n]}
    good, exact, near, cut = (texts(n) for n in ("quality_classifier", "exact_dedup", "simhash_near_dedup", "substring_dedup"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept_clean = [d in good for d, q in labels.items() if q == 1]
    dropped_junk = [d not in good for d, q in labels.items() if q == 0]
    assert np.mean(kept_clean) > 0.95 and np.mean(dropped_junk) > 0.8
    groups = {}
    for d, t in good.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    assert exact.keys() == {min(g)[1] for g in groups.values()}
    assert near.keys() == kept_ids(exact.items(), 0.8)  # five-word shingles, similarity of 0.8 or more
    brute = {d: (gone, kept) for d, _, gone, kept in brute_substring(list(near.items()), 50)}
    assert cut == {d: brute[d][1] if brute[d][0] else t for d, t in near.items()}
    source = docs.where("n_chars between 1500 and 4000").orderBy("doc_id").first().doc_id
    if {9003, source} <= near.keys():
        assert brute[9003][0] >= 50
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in outputs["packing"])
    want = Counter()
    for d, t in cut.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[(d, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert pieces == want


def test_run_is_the_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.groupBy("doc_id", "start").count().where("count > 1").count() == 0
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_take_odd_rows_and_columns(spark, odd_docs, odd_rows, no_docs, small):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns through every stage; and an empty table."""
    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    names, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes)
            docs = spark.createDataFrame(out.collect(), docs.schema)
            sizes.append(docs.count())
        else:
            assert out.where("start = 0").count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < len(odd_rows)
    empty = no_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, small)
        assert out.count() == 0
        empty = spark.createDataFrame([], out.schema)


def test_run_leaves_only_its_result(spark, small):
    import os

    from tidewright.llm import common

    base = common.shared_dir(spark).removeprefix("file:")
    before = {d for d in os.listdir(base) if d.startswith("tidewright-")}
    assert corpus_pipeline.run(spark, small).count() > 0
    made = [d for d in os.listdir(base) if d.startswith("tidewright-") and d not in before]
    assert [sorted(os.listdir(f"{base}/{d}")) for d in made if os.listdir(f"{base}/{d}")] == [["packing"]]
