import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ann, queries, quality, url_filter


def test_quality_on_held_out_rows(spark, sf):
    got = queries.op5_quality_classifier(spark, sf.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert len(rows) > 50
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95


def test_quality_edges(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id long, quality int")
    empty = quality.fit(odd_docs, none)
    assert {r.score for r in quality.score(odd_docs, empty).collect()} == {0.5}
    some = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(odd_rows) if d is not None and d < 30], "doc_id long, quality int")
    model = quality.fit(odd_docs, some)
    got = quality.score(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    blank = [r.score for r in got if r.doc_id in (180, 181, 183)]
    assert blank == [pytest.approx(model.prior)] * 3
    assert quality.score(no_docs, model).count() == 0
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in got)


def test_terms_of_a_text_do_not_depend_on_its_neighbours(odd_rows):
    texts = [t for _, t in odd_rows]
    together = quality.term_counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert (quality.term_counts(pa.array([t], pa.string()))[0] == together[i]).all()


def test_quality_votes_match_a_plain_loop():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["aa", "bb", "cc dd", "E!!", "ff.", "|"], 12)) for _ in range(80)]
    counts = quality.term_counts(pa.array(texts))
    model = quality.LatentVotes(counts, (np.arange(80) % 3 == 0).astype(float), dims=20)
    got = model.score(counts, block=7)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    for i in range(80):
        v = unit(model._weighted(counts[i : i + 1])[0] @ model.space)
        sims = sorted(((float(v @ w), l) for w, l in zip(model.vectors, model.labels)), reverse=True)[:15]
        weights = [math.exp(model.sharpness * (s - sims[0][0])) for s, _ in sims]
        assert got[i] == pytest.approx(sum(w * l for w, (_, l) in zip(weights, sims)) / sum(weights), abs=0.05)


def test_equal_similarities_go_to_the_first_labelled_texts():
    """Copies of few texts under other labels: the k-th place is contested, and smaller places win."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc dd", "E!!", "ff.", "|"], 12)) for _ in range(6)]
    copies = [texts[i % 6] for i in range(300)]
    labels = rng.integers(0, 2, 300).astype(float)
    model = quality.LatentVotes(quality.term_counts(pa.array(copies)), labels, dims=20)
    for n, text in enumerate(texts):
        counts = quality.term_counts(pa.array([text]))
        own = np.flatnonzero([c == text for c in copies])[:15]  # fifty equal copies, of which the first fifteen vote alike
        others = [c for c in texts if c != text]
        assert len(others) == 5 and model.score(counts)[0] == pytest.approx(labels[own].mean(), abs=1e-9)


def test_votes_are_those_of_a_stable_sort():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc"], 3)) for _ in range(400)]
    counts = quality.term_counts(pa.array(texts))
    model = quality.LatentVotes(counts, (np.arange(400) % 3 == 0).astype(float), dims=8)
    vectors = np.round(model._unit(model._weighted(counts) @ model.space) @ model.vectors.T, 9)
    got = model.score(counts, block=400)
    for i in range(0, 400, 7):
        best = np.argsort(-vectors[i], kind="stable")[:15]
        weight = np.exp(model.sharpness * (vectors[i][best] - vectors[i].max()))
        assert got[i] == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), abs=1e-8)


def brute_nearest(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in usable:
        if i % every == 0:
            found = sorted(((-float((v * q).sum()), j) for j, v in usable if j != i))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


@pytest.mark.parametrize("n,block", [(400, 64), (9, 4096)])
def test_nearest_neighbours(spark, n, block):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * rng.uniform(0.2, 3))]) for i in range(n)]
    rows += [(1000 + i, rows[i % n][1]) for i in range(40)]  # copies, for ties
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [1.0]), (None, rows[0][1]), (2006, [])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, block int")
    index = ann.OneBitIndex(df, block_rows=block)
    got = index.search(index.vectors.where("vec_id % 5 = 0"), k=20, query_rows=16).orderBy("query_id", "rank").collect()
    want = brute_nearest(rows, 5, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(by[r.query_id])
    assert by.keys() == want.keys()
    recall = np.mean([len({j for j, _ in by[q]} & {j for j, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.98
    for q in want:
        if [j for j, _ in by[q]] == [j for j, _ in want[q]]:
            assert [s for _, s in by[q]] == pytest.approx([s for _, s in want[q]], rel=1e-12)


def test_nearest_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_index_sends_the_driver_no_vectors(spark, monkeypatch):
    """With more tasks the driver gets no more: results of all tasks stay under a limit that vectors of a few would pass."""
    n, dim = 3000, 32
    item = lambda i: F.sin(F.col("id") * 7 + i).cast("float")
    df = spark.range(0, n, 1, 24).select(F.col("id").alias("vec_id"), F.array(*[item(i) for i in range(dim)]).alias("embedding"))
    got = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(rows := collect(self)) or rows)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "512k")
    try:
        index = ann.OneBitIndex(df, sample_rows=1000)
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert sum(len(x) for x in got) <= dim + 1
    x = np.float32(np.sin(np.arange(n)[:, None] * 7 + np.arange(dim)[None, :])).astype(float)
    assert index.rows == n and np.abs(index.centre - x.mean(axis=0)).max() < 0.15
    whole = ann.OneBitIndex(df, sample_rows=n)
    assert whole.centre == pytest.approx(x.mean(axis=0), abs=1e-12)


def test_centre_of_few_or_equal_ids(spark):
    """Ids that the sample misses leave the origin, and the neighbours stay those of brute force."""
    rng = np.random.default_rng(3)
    rows = [(i // 40, [float(x) for x in np.float32(rng.normal(size=6) + 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for sample in (0, 1, 200):
        index = ann.OneBitIndex(df, sample_rows=sample, block_rows=64)
        assert np.isfinite(index.centre).all() and (sample or not index.centre.any())
        got = index.search(index.vectors.where("vec_id = 0"), k=200)
        assert got.select("vec_id").distinct().count() == 4 and got.count() > 0


def test_queries_meet_groups_of_blocks(spark, monkeypatch):
    """Blocks of queries are sent to groups of blocks, without a broadcast, and full groups of any size find the same."""
    rng = np.random.default_rng(4)
    rows = [(i % 570, [float(x) for x in (np.float32(v) if i % 2 else v)]) for i, v in enumerate(rng.normal(size=(600, 5)))]  # some need double precision, and some ids two rows
    rows += [(1000 + i, rows[i][1]) for i in range(60)]
    index = ann.OneBitIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=16)
    dealt, spread = [], ann.spread
    monkeypatch.setattr(ann, "spread", lambda df, *a: dealt.append(df) or spread(df, *a))
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    want = None
    for size, groups in ((1, 42), (4, 11), (64, 4)):
        dealt.clear()
        found = index.search(index.vectors.where("vec_id % 5 = 0"), k=7, epsilon=50.0, query_rows=40, group_blocks=size)
        plan = found._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert dealt[0].count() == groups * dealt[0].select("q_block").distinct().count()
        got = sorted(map(tuple, found.collect()))
        assert got == (want := want or got)
    of = {}
    for i, v in rows:
        of.setdefault(i, []).append(np.array(v))
    assert {r[0] for r in got} == {i for i in of if i % 5 == 0}
    for q in {r[0] for r in got if len(of[r[0]]) == 1}:
        best = sorted((-float((v * of[q][0]).sum()), i) for i in of if i != q for v in of[i])[:7]
        assert [(r[2], -r[3]) for r in got if r[0] == q] == [(i, s) for s, i in best]


@pytest.mark.parametrize("dim", [1, 3])
def test_vectors_are_packed_without_loss(dim):
    for x in (np.float32([[0.1] * dim, [-3.0] * dim]).astype(float), np.array([[0.1] * dim, [2.0] * dim]), np.array([[1e300] * dim, [1e-300] * dim])):
        assert (ann._unpacked(ann._packed(x), 2, dim) == x).all()


def test_recall_on_the_table(spark, sf):
    got = queries.op7_nearest_neighbours(spark, sf).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for q in by:
        s = (x * rows[q]).sum(axis=1)
        s[ids == q] = -np.inf
        hits += len(by[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20
    assert hits / len(by) >= 0.9


URLS = [
    ("http://Example.COM/en/a?x#y", "example.com", "/en/a", "example.com/en/", "block"),
    ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/1", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("https://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
    ("https://x.net/fr", "x.net", "/fr", None, None),
    ("https://x.com", "x.com", "", None, None),
    ("https://x.com?q=http://y.net/es/", "x.com", "", None, None),
    ("http://É.ORG/É", "É.org", "/É", None, None),
    ("no scheme/at/all", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("://", "", "", None, None),
    ("http://www.casino-win.example.org/en/14", "www.casino-win.example.org", "/en/14", None, "block"),
    ("http://blog.thering.example.org/en/14", "blog.thering.example.org", "/en/14", None, "allow"),
    ("http://h\nx.org/a\nb?c", "h\nx.org", "/a\nb", None, None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "h", "r")], "page_id long, url string, host string, rule string")
    got = sorted(url_filter.judge(df).collect(), key=lambda r: r.page_id)
    assert len(got) == len(URLS) + 1 and got[0] == got[1]
    for r in got:
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict == ("block" if r.p_block >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_tells_unseen_hosts():
    weights = url_filter.train(url_filter.labelled_urls())
    hosts = ["m.casino-win.example.org", "the-free-bets.net", "cheap-pills-now.info", "library.city.org", "garden-news.net", "museum.example.org"]
    p = url_filter.probability(weights, pa.array(hosts), pa.array(["/en/5"] * 6))
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all()
    with pytest.raises(ValueError):
        url_filter.train(pd.DataFrame({"host": ["a"] * 10_001, "path": [""] * 10_001, "label": [0] * 10_001}))


def plain_bucket(gram, half):
    h = len(gram)
    for c in gram:
        h = h * 0x01000193 % 2**32 ^ c
    h ^= h >> 15
    h = h * 0x2C1B3C6D % 2**32
    h ^= h >> 13
    return half * 2**14 + h % 2**14


def plain_features(host, path):
    found = {}
    for half, text in enumerate((host, path)):
        framed = f"^{text}$".encode() if text else b""
        for n in (2, 3, 4, 5):
            for i in range(len(framed) - n + 1):
                b = plain_bucket(framed[i : i + n], half)
                found[b] = found.get(b, 0) + 1
    norm = max(1.0, math.sqrt(sum(v * v for v in found.values())))
    return {b: v / norm for b, v in found.items()}


def test_url_model_matches_a_plain_loop():
    """Features, fit and probabilities against loops over characters and labels."""
    table = url_filter.labelled_urls("1 win-casino.example/slots\n0 library.example/books\n0 é.example/a/b\n1 pills.example/\n")
    weights = url_filter.train(table, rounds=40)
    rows = [plain_features(h, p) for h, p in zip(table.host, table.path)]
    w, bias, m, v = {}, 0.0, {}, {}
    names = sorted({b for r in rows for b in r})
    w = dict.fromkeys([*names, "bias"], 0.0)
    m, v = dict(w), dict(w)
    rows_with_bias = [{**r, "bias": 1.0} for r in rows]
    for t in range(1, 41):
        g = dict.fromkeys(w, 0.0)
        for r, y in zip(rows_with_bias, table.label):
            p = 1 / (1 + math.exp(-sum(w[b] * x for b, x in r.items())))
            for b, x in r.items():
                g[b] += (p - y) * x / len(rows)
        for b in w:
            g[b] += 1e-3 * w[b]
            m[b], v[b] = 0.9 * m[b] + 0.1 * g[b], 0.999 * v[b] + 0.001 * g[b] ** 2
            w[b] -= 0.1 * (m[b] / (1 - 0.9**t)) / (math.sqrt(v[b] / (1 - 0.999**t)) + 1e-8)
    hosts, paths = ["win-casino.example", "books.example", "", "new.example"], ["/slots", "/", "", "/pills/" + "x" * 300]
    want = [1 / (1 + math.exp(-(sum(w.get(b, 0.0) * x for b, x in plain_features(h, p).items()) + w["bias"]))) for h, p in zip(hosts, paths)]
    assert url_filter.probability(weights, pa.array(hosts), pa.array(paths)) == pytest.approx(want, abs=1e-6)


def test_url_table_may_be_given(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x"), (2, "http://b.example/y")], "page_id long, url string")
    table = spark.createDataFrame([("a.example", "/x", 1), ("b.example", "/y", 0)], "host string, path string, label int")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, labelled=table).collect()} == {1: "block", 2: "allow"}


def test_fit_does_not_depend_on_repeats(spark, odd_docs, odd_rows):
    """Rows repeated under a labelled id, however many, neither push others out of the sample nor train more than once."""
    some = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(odd_rows) if d is not None and d < 30], "doc_id long, quality int")
    once = quality.fit(odd_docs, some, sample_rows=10)
    hot = odd_docs.unionByName(odd_docs.where("doc_id < 30").crossJoin(spark.range(50)).drop("id"))
    again = quality.fit(hot, some, sample_rows=10)
    assert np.array_equal(once.vectors, again.vectors) and np.array_equal(once.labels, again.labels)


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 123456789)], "doc_id long")
    assert [r[0] for r in df.select(quality.fold()).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, -3, 123456789)]
