import math
import random
import re

import pytest

from tidewright.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """item_id, rank, doc_id, score by scoring every document for every item."""
    counted = [(d, {}, terms(t)) for d, t in docs]
    for _, tf, words in counted:
        for w in words:
            tf[w] = tf.get(w, 0) + 1
    counted = [c for c in counted if c[2]]
    n, length = len(counted), sum(len(c[2]) for c in counted)
    df = {}
    for _, tf, _ in counted:
        for w in tf:
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, tf, words in counted:
            m = 75 + (25 * len(words) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in terms(text) if w in tf)
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0, d))
        found.sort()
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(odd_rows):
    rng = random.Random(4)
    words = [w for _, t in odd_rows for w in (t or "").split()[:50]]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    out += [(30, odd_rows[3][1]), (31, "the THE The x1"), (32, None), (33, ""), (34, "nowhere-to-be-found"), (35, "?!"), (36, "zürich été  "), (30, "stone"), (None, "river of stone"), (37, odd_rows[-3][1])]
    return out


@pytest.mark.parametrize("block_docs,head,k", [(7, 3, 5), (1, 1, 20), (1 << 14, 32, 20), (5, 32, 500)])
def test_search_against_scoring_everything(spark, odd_rows, items, block_docs, head, k):
    docs = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    asked = lexical.query_terms(table, "item_id", "text")
    for wanted in (asked, None):
        index = lexical.Postings(docs, terms=wanted, head=head, block_docs=block_docs)
        got = sorted([tuple(r) for r in index.search(asked, k).collect()], key=repr)
        assert got == brute(odd_rows, items, k)


def test_many_copies_of_the_best_text(spark):
    """Ties at every rank, over blocks: smaller ids first."""
    rows = [(i, "one two three four") for i in range(300)] + [(1000 + i, f"one {i}") for i in range(300)] + [(-1, "one two three four five"), (None, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    items = [(1, "two four"), (2, "one five"), (3, "one one one 17")]
    asked = lexical.query_terms(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    got = sorted([tuple(r) for r in lexical.Postings(docs, terms=asked, block_docs=40).search(asked, 20).collect()], key=repr)
    assert got == brute(rows, items, 20)


def test_thresholds_leave_most_entries_unread(spark):
    """A frequent term of little weight is not fetched beyond its threshold."""
    rng = random.Random(9)
    rows = [(i, " ".join(["common"] + [f"w{rng.randrange(3000)}" for _ in range(30)])) for i in range(2000)] + [(5000 + i, "common rare1 rare2 rare3 rare4") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = lexical.query_terms(spark.createDataFrame([(1, "common rare1 rare2 rare3 rare4")], "item_id long, text string"), "item_id", "text")
    index = lexical.Postings(docs, terms=asked, block_docs=500)
    weights = index._weights(asked)
    low = index._heads(weights, 20)
    from pyspark.sql import functions as F

    sums = index._fetched(weights.join(low, "q", "left").withColumn("low", F.coalesce("low", F.lit(0)).cast("long")), True, 20)
    assert sums.agg(F.sum(F.length("idx") / 2)).first()[0] == 30
    assert [tuple(r) for r in index.search(asked, 20).orderBy("rank").collect()] == sorted(brute(rows, [(1, "common rare1 rare2 rare3 rare4")], 20), key=lambda r: r[1])


def test_counts_of_long_texts_and_impacts(monkeypatch):
    text = "Aa_b " * 4000 + "é" * 50 + " x1"
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "_PIECE", 37)
    assert lexical.term_counts(text) == whole == {b"aa": 4000, b"b": 4000, ("é" * 50).encode(): 1, b"x1": 1}
    import numpy as np

    tf, n = np.array([1, 5, 10**6]), np.array([1, 10**6, 10**9])
    assert lexical.impacts(tf, n, 10**10, 10**13).tolist() == [10**9 * t // (1000 * t + 12 * (75 + 25 * x * 10**10 // 10**13)) for t, x in zip(tf.tolist(), n.tolist())]


def test_edges(spark, no_docs, odd_docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(no_docs, table).count() == 0
    assert lexical.search(odd_docs, table.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "x y", 1), ("b", "y", 2)], "id string, body string, rank int")
    asks = spark.createDataFrame([("q", "X", 0)], "name string, words string, score int")
    got = lexical.search(named, asks, "id", "body", "name", "words").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("q", 1, "a")]
    with pytest.raises(ValueError):
        lexical.Postings(named, "id", "body", block_docs=1 << 17)


def test_query_on_the_given_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op12_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(docs, items, 20)
