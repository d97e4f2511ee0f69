"""The near-dedup stage against brute force on planted edits of every degree."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_dedup import words
from tidewright.llm import jaccard


def shingles(text, size=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(rows, threshold=0.8):
    """The smallest id of each component of pairs at or over the threshold."""
    sets, root = [(d, shingles(t)) for d, t in sorted(rows)], {}
    for i, (d, s) in enumerate(sets):
        near = {root[e] for e, x in sets[:i] if similarity(s, x) >= threshold}
        low = min(near, default=d)
        root[d] = low
        root = {e: low if r in near else r for e, r in root.items()}
    return set(root.values())


@pytest.fixture(scope="module")
def edited():
    """(doc_id, text): 40 texts, each with copies in which 1 to 12 words are replaced; and texts that repeat one line."""
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 2, 3, 5, 8, 12):
            other = list(base)
            for at in rng.sample(range(len(base)), edits):
                other[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(other)))
    line = "the same few words again and again "
    rows += [(len(rows) + k, line * 40 + " ".join(f"y{k}z{i}" for i in range(9))) for k in range(3)]
    return rows


def test_stage_keeps_what_exact_similarity_keeps(spark, edited):
    pairs = [similarity(shingles(a), shingles(b)) for (i, a) in edited[::7] for (_, b) in edited[i + 1 : i + 7]]
    assert all(sum(low <= s < low + 0.05 for s in pairs) > 5 for low in (0.7, 0.75, 0.8, 0.85, 0.9, 0.95))
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near(spark, docs, "")
    assert {r.doc_id for r in got.collect()} == kept_ids(edited)


def test_chains_of_edits(spark):
    """A chain of edits, neighbours alike and ends not, joins whichever member the others are paired with first."""
    rng = random.Random(3)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(w)))
        w = list(w)
        for at in rng.sample(range(120), 2):
            w[at] = f"v{k}_{at}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == kept_ids(rows)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0
    found = jaccard.near_duplicates(odd_docs).collect()
    assert len(found) == len(odd_rows)
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({r.root for r in found})
    assert 180 in ids and not {181, 182, 183} & set(ids)
