import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import accumulate, folds, joins, matching, patterns, selection, sweep, windows


def spans(rng, n, top=500.0):
    out = []
    for i in range(n):
        s = round(rng.uniform(0, top), 1)
        out.append((i, rng.choice("ab"), s, round(s + rng.uniform(0, 60), 1)))
    return out


@pytest.mark.parametrize("width", [7.0, 50.0, 1000.0])
def test_range_join_is_the_nested_loop(spark, width):
    rng = random.Random(1)
    left, right = spans(rng, 60), [(i + 1000, k, s, e) for i, k, s, e in spans(rng, 60)]
    l = spark.createDataFrame(left, "l int, k string, ls double, le double")  # noqa: E741
    r = spark.createDataFrame(right, "r int, k string, rs double, re double")
    got = sorted((x.l, x.r) for x in joins.range_join(l, r, ("ls", "le"), ("rs", "re"), width, ["k"], 5, 9).collect())
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and b[2] <= a[3] + 9 and b[3] >= a[2] - 5)
    assert got == want
    outer = joins.range_join(l, r.limit(0), ("ls", "le"), ("rs", "re"), width, ["k"], how="left")
    assert outer.count() == 60 and outer.where("r is null").count() == 60


def test_asof_join(spark):
    asks = spark.createDataFrame([("p", 5.0), ("p", 10.0), ("p", 0.5), ("q", 3.0)], "k string, t double")
    snaps = spark.createDataFrame([("p", 1.0, "a"), ("p", 5.0, "b"), ("p", 5.0, "c"), ("p", 10.0000005, "d")], "k string, c double, name string")
    got = {(r.k, r.t): r.name for r in joins.asof_join(asks, snaps, "t", "c", ["k"], order=["name"]).collect()}
    assert got == {("p", 5.0): "b", ("p", 10.0): "d", ("p", 0.5): None, ("q", 3.0): None}


def test_nearest_interval(spark):
    rng = random.Random(4)
    rows = spans(rng, 40)
    points = [(i, rng.choice("abz"), round(rng.uniform(-50, 650), 1)) for i in range(80)]
    got = joins.nearest_interval(spark.createDataFrame(points, "p int, k string, t double"), spark.createDataFrame(rows, "i int, k string, s double, e double"), "t", ("s", "e"), ["k"], "p", ["i"]).collect()
    assert len(got) == 80
    for r in got:
        own = [max(s - r.t, r.t - e, 0.0) for _, k, s, e in rows if k == r.k]
        assert (r.distance is None and not own) or r.distance == pytest.approx(min(own))


def test_lookup_overlay_remap(spark):
    right = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "z", 2)], "id int, v string, seq int")
    assert {r.id: r.v for r in joins.lookup(spark.createDataFrame([(1,), (3,)], "id int"), right, ["id"], ["seq"]).collect()} == {1: "y", 3: None}
    rows = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "id string, text string, fixed int")
    patched = joins.overlay(rows, spark.createDataFrame([("a", "new")], "id string, text string"), "id", ["text"])
    assert {(r.id, r.text, r.fixed) for r in patched.collect()} == {("a", "new", 1), ("b", "keep", 2)}
    moved = joins.remap(spark.createDataFrame([("g1", "g1_A"), ("g9", "g9_A")], "g string, p string"), spark.createDataFrame([("g1", "h1")], "g string, n string"), "g", "n", "p")
    assert [(r.g, r.p) for r in moved.collect()] == [("h1", "h1_A")]
    for most in (10_000, 3):  # broadcast whole, or in blocks
        assert sorted((r.id, r.n) for r in joins.grid(rows.select("id"), spark.range(10).withColumnRenamed("id", "n"), most=most).collect()) == [(i, n) for i in "ab" for n in range(10)]


def test_subtract_and_tiles(spark):
    df = spark.createDataFrame([(0.0, 10.0, [(2.0, 3.0), (5.0, 20.0)]), (0.0, 10.0, []), (4.0, 4.0, []), (0.0, 5.0, [(0.0, 5.0)])], "s double, e double, x array<struct<start: double, end: double>>")
    got = [[tuple(p) for p in r[0]] for r in df.select(windows.subtract(F.col("s"), F.col("e"), F.col("x"))).collect()]
    assert got == [[(0.0, 2.0), (3.0, 5.0)], [(0.0, 10.0)], [], []]
    span = spark.createDataFrame([(2140.0, 2230.0)], "s double, e double")
    assert [(r.start_sec, r.end_sec) for r in windows.tiles(span, "s", "e", 30.0).collect()] == [(2140.0, 2170.0), (2170.0, 2200.0), (2200.0, 2230.0)]
    plan = spark.createDataFrame([(0.0, 180.0)], "s double, e double")
    assert [(r.start_sec, r.end_sec) for r in windows.sliding(plan, "s", "e", 90.0, 10.0).collect()] == [(0.0, 90.0), (80.0, 170.0), (160.0, 180.0)]
    cut = windows.phase_chunks(span, "s", "e", F.array(F.struct(F.lit(2168.0).alias("start"), F.lit(2172.0).alias("end"))), 30.0)
    assert all(r.end_sec - r.start_sec <= 30 and (r.end_sec <= 2168 or r.start_sec >= 2172) for r in cut.collect())


def test_consensus_is_chained_and_keeps_numbers(spark):
    rows = [("start", 10.0, "a", "e1"), ("start", 12.5, "b", "e2"), ("start", 15.0, "a", "e3"), ("end", 11.0, "a", "e4"), ("start", 100.0, "a", "e5"), ("start", 101.0, "b", "e6")]
    got = windows.consensus(spark.createDataFrame(rows, "kind string, t double, player string, ev string"), "kind", "t", "player", "ev").orderBy("abs_sec").collect()
    assert [(r.kind, r.abs_sec, r.source_povs, r["index"]) for r in got] == [("start", 12.5, ["a", "b"], 0), ("start", 100.5, ["a", "b"], 2)]


def test_episodes(spark):
    rows = [("g", 0.0, "start"), ("g", 50.0, "end"), ("g", 60.0, "end"), ("g", 100.0, "start"), ("g", 200.0, "start")]
    got = windows.episodes(spark.createDataFrame(rows, "g string, t double, kind string"), ["g"], "kind", "t", ["start"], ["end"], F.lit(300.0)).orderBy("abs_start_sec").collect()
    assert [(r.abs_start_sec, r.abs_end_sec) for r in got] == [(0.0, 50.0), (100.0, 200.0), (200.0, 300.0)]


def plain_merge(rows, edge=3.0, iou=0.5):
    """The fold, spelled out: all kept rows of equal key in order."""
    kept, out = [], {}
    for i, k, s, e in sorted(rows, key=lambda r: (r[2], r[0])):
        for c in kept:
            hull = max(c["e"], e) - min(c["s"], s)
            overlap = max(0.0, min(c["e"], e) - max(c["s"], s))
            if c["k"] == k and ((hull > 0 and overlap / hull > iou) or (abs(c["s"] - s) <= edge and abs(c["e"] - e) <= edge)):
                c["s"], c["e"], out[i] = min(c["s"], s), max(c["e"], e), c["i"]
                break
        else:
            kept.append({"i": i, "k": k, "s": s, "e": e})
            out[i] = i
    return out


@pytest.mark.parametrize("partitions", [1, 8])
def test_merge_events_is_the_plain_fold(spark, partitions):
    rng = random.Random(2)
    rows = spans(rng, 150, 900.0)
    df = spark.createDataFrame(rows, "i int, k string, s double, e double").repartition(partitions)
    assert {r.i: r.kept_id for r in folds.merge_events(df, ["k"], "s", "e", "i", ["s", "i"]).collect()} == plain_merge(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 20)), max_size=25))
def test_merge_step(pairs):
    rows = sorted(((s, s + d) for s, d in pairs), key=lambda p: p[0])
    out = folds.Merge()(list(range(len(rows))), [float(s) for s, _ in rows], [float(e) for _, e in rows])
    want = plain_merge([(i, "k", float(s), float(e)) for i, (s, e) in enumerate(rows)])
    assert out == [want[i] for i in range(len(rows))]


def dense(rng, n, long):
    """Intervals that never pause: each key is one chain of live ones from first to last."""
    return [(i, rng.choice("aab"), s, s + rng.randrange(*long)) for i in range(n) for s in [float(i // 3)]]


@pytest.mark.parametrize("block_rows,partitions", [(7, 1), (16, 5), (1, 3), (4096, 2)])
def test_merge_over_blocks_is_the_plain_fold(spark, block_rows, partitions):
    rng = random.Random(block_rows)
    rows = dense(rng, 240, (8, 40))
    df = spark.createDataFrame(rows, "i int, k string, s double, e double").repartition(partitions)
    assert {r.i: r.kept_id for r in folds.merge_events(df, ["k"], "s", "e", "i", ["s", "i"], block_rows=block_rows).collect()} == plain_merge(rows)


def test_merge_keys_and_times_may_be_null(spark):
    rows = [(0, None, 0.0, 9.0), (1, None, 1.0, 9.0), (2, "a", 1.0, 9.0), (3, "a", None, 9.0), (4, "a", 1.0, None), (5, "a", float("nan"), 1.0), (6, "a", 2.0, 9.0)]
    df = spark.createDataFrame(rows, "i int, k string, s double, e double")
    assert {r.i: r.kept_id for r in folds.merge_events(df, ["k"], "s", "e", "i", ["s", "i"], block_rows=2).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 2}
    assert {r.i: r.kept_id for r in folds.merge_claims(df, ["k"], "s", "i", ["s", "i"], block_rows=2).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2, 5: 5, 6: 2}
    assert folds.merge_events(df.limit(0), ["k"], "s", "e", "i", ["s", "i"]).count() == 0 and folds.merge_claims(df.limit(0), ["k"], "s", "i", ["s", "i"]).count() == 0


def plain_first(rows, within):
    """The fold, spelled out, for rows (i, key, time)."""
    open_, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in open_ or t - open_[k][0] > within:
            open_[k] = (t, i)
        out[i] = open_[k][1]
    return out


@pytest.mark.parametrize("block_rows,within", [(1, 3.0), (5, 3.0), (5, 40.0), (16, 0.3), (64, 1000.0)])
@pytest.mark.parametrize("even", [True, False])
def test_claims_over_blocks_are_the_plain_fold(spark, block_rows, within, even):
    """Evenly spaced rows never forget where their groups began, so all maps have to be composed."""
    rng = random.Random(3)
    rows = [(i, "a" if i % 11 else "b", i * 0.1 if even else round(rng.uniform(0, 30), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, t double").repartition(3)
    assert {r.i: r.kept_id for r in folds.merge_claims(df, ["k"], "t", "i", ["t", "i"], within, block_rows=block_rows).collect()} == plain_first(rows, within)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 8), st.sampled_from([0.1, 0.3, 0.7, 1.0, 2.5]), st.integers(0, 12))
def test_composed_maps_give_the_open_group(times, size, within, earlier):
    """Maps of neighbouring runs, composed in pairs, from any group open before them."""
    s = sorted(t / 10 for t in times)
    parts = [list(range(a, min(a + size, len(s)))) for a in range(0, len(s), size)]
    maps = [folds.FirstMap.of([s[i] for i in p], p, within) for p in parts]
    whole = maps[0]
    for m in maps[1:]:
        whole = m.after(whole)
    tree = list(maps)
    while len(tree) > 1:
        tree = [b.after(a) if b else a for a, b in zip(tree[::2], [*tree[1::2], *[None] * (len(tree) % 2)])]
    first = s[0] - earlier / 10
    fold = folds.FromFirst(within)
    fold.first, fold.id = first, -1
    fold(list(range(len(s))), s)
    assert whole(first, -1) == tree[0](first, -1) == (fold.first, fold.id)


def test_claims_and_anchors_measure_from_the_first(spark):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0.0, 2.0, 3.0, 4.0, 7.5])], "i int, k string, t double")
    assert {r.i: r.kept_id for r in folds.merge_claims(df, ["k"], "t", "i", ["t", "i"]).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert {r.i: r.kept_id for r in folds.fuse_by_anchor(df, ["k"], "t", "i", ["t", "i"], 2.0).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def plain_smooth(labels, least):
    out = list(labels)
    while True:
        runs, start = [], 0
        for i in range(1, len(out) + 1):
            if i == len(out) or out[i] != out[start]:
                runs.append((start, i, out[start]))
                start = i
        for n, (a, b, label) in enumerate(runs):
            before, after = (runs[n - 1][2] if n else None), (runs[n + 1][2] if n + 1 < len(runs) else None)
            if b - a < least and label != "unknown" and (before or after):
                out[a:b] = [before or after] * (b - a)
                break
        else:
            return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x", "y", "unknown"]), max_size=14), st.integers(1, 4))
def test_smoothing(labels, least):
    rows = SMOOTH.setdefault(least, [])
    rows.append(labels)


SMOOTH: dict = {}


def test_smoothing_closed_form(spark):
    """All sequences that were drawn, one key each, against the rule spelled out."""
    rng = random.Random(4)
    for least in (1, 2, 3, 4):
        cases = [c for c in SMOOTH.get(least, []) if c] + [[rng.choice(["x", "y", "z", "unknown"]) for _ in range(rng.randrange(1, 20))] for _ in range(150)]
        df = spark.createDataFrame([(k, i, x) for k, c in enumerate(cases) for i, x in enumerate(c)], "k int, i int, x string")
        got = {}
        for r in folds.smooth_runs(df, ["k"], "i", "x", least).orderBy("k", "i").collect():
            got.setdefault(r.k, []).append(r.smoothed)
        assert got == {k: plain_smooth(c, least) for k, c in enumerate(cases)}


def test_folds_do_not_depend_on_batches(spark):
    """Keys that batches and blocks of time cut give what they give whole."""
    rng = random.Random(9)
    rows = [(i, "k" if rng.random() < 0.8 else None, float(rng.randrange(4000))) for i in range(700)]
    rows = [(i, k, s, s + rng.randrange(0, 90)) for i, k, s in rows]
    df = spark.createDataFrame(rows, "i int, k string, s double, e double").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
        assert {r.i: r.kept_id for r in folds.merge_events(df, ["k"], "s", "e", "i", ["s", "i"]).collect()} == plain_merge(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_affine_fit_is_the_plain_fit(spark):
    rng = random.Random(12)
    rows = []
    for k in range(5):
        for i in range(40):
            x = rng.uniform(0, 3000)
            rows.append((k, x, 1.01 * x + 7 + rng.uniform(-1.5, 1.5) if rng.random() < 0.7 else rng.uniform(0, 3000), 100 * k + i))
    df = spark.createDataFrame(rows, "k int, x double, y double, i int").repartition(4)
    hashes = {r.i: r.h for r in df.select("i", F.xxhash64("i").alias("h")).collect()}
    got = {r.k: r for r in folds.affine_fit(df, "k", "x", "y", "i").collect()}
    for k in range(5):
        own = [r for r in rows if r[0] == k]
        ranks = folds.draw_order(np.array([hashes[r[3]] for r in own]), 200, 0)
        pairs = [tuple(np.argsort(ranks[:, t], kind="stable")[:2]) for t in range(200)]
        want = folds.inlier_fit([r[1] for r in own], [r[2] for r in own], pairs)
        assert want and {c: pytest.approx(got[k][c]) for c in want} == want


def test_matching_and_leftovers(spark):
    anchor = spark.createDataFrame([("a", "win", 100.0, 0), ("a", "win", 105.0, 1), ("a", "loss", 50.0, 2)], "p string, label string, d double, idx int")
    clips = spark.createDataFrame([("b", "win", 104.0, 0), ("b", "win", 101.0, 1), ("b", "loss", 90.0, 2), ("c", "win", 99.0, 0), ("c", "win", 250.0, 1), ("b", "win", 251.0, 3)], "p string, label string, d double, idx int")
    got = {(r.p, r.idx): r.anchor_idx for r in matching.match_to_anchor(clips, anchor, "p", "label", "d", "idx").collect()}
    assert got == {("b", 0): 1, ("b", 1): 0, ("c", 0): 0}
    rest = clips.join(spark.createDataFrame(list(got), "p string, idx int"), ["p", "idx"], "left_anti")
    assert sorted((r.p, r.idx) for r in matching.cluster_leftovers(rest, "p", "label", "d", "idx").collect()) == [("b", 3), ("c", 1)]
    games = spark.createDataFrame([(True, 0), (True, 4), (False, 9), (False, 2)], "anchored boolean, idx int")
    assert sorted((r.anchored, r.idx, r.timeline_index) for r in folds.timeline(games, "anchored", "idx").collect()) == [(False, 2, 5), (False, 9, 6), (True, 0, 0), (True, 4, 4)]


def clip_rows(rng, n):
    seen = {}
    out = []
    for _ in range(n):
        g, p = rng.randrange(2), rng.choice("abcd")
        seen[g, p] = seen.get((g, p), -1) + 1
        out.append((g, p, rng.choice(["win", "loss"]), float(rng.randrange(100)), seen[g, p]))
    return out


@pytest.mark.parametrize("seed,n,tolerance", [(0, 120, 15.0), (1, 60, 40.0), (2, 40, 200.0), (3, 30, 0.0)])
def test_matching_in_rounds_is_the_pass_in_order(spark, seed, n, tolerance):
    rows = clip_rows(random.Random(seed), n)
    anchors, clips = [r for r in rows if r[1] == "a"], [r for r in rows if r[1] != "a"]
    schema = "g int, p string, label string, d double, idx int"
    got = matching.match_to_anchor(spark.createDataFrame(clips, schema), spark.createDataFrame(anchors, schema), "p", "label", "d", "idx", tolerance, on=["g"])
    pairs = sorted((abs(c[3] - a[3]), abs(c[4] - a[4]), c[4], a[4], c[0], c[1]) for c in clips for a in anchors if c[0] == a[0] and c[2] == a[2] and abs(c[3] - a[3]) <= tolerance)
    clip_taken, anchor_taken, want = set(), set(), set()
    for _, _, i, j, g, p in pairs:
        if (g, p, i) not in clip_taken and (g, p, j) not in anchor_taken:
            clip_taken.add((g, p, i))
            anchor_taken.add((g, p, j))
            want.add((g, p, i, j))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("seed,n,tolerance,least", [(0, 80, 10.0, 2), (1, 60, 4.0, 3), (2, 50, 30.0, 4), (3, 25, 5.0, 1)])
def test_seed_clusters_in_rounds_are_the_pass_in_order(spark, seed, n, tolerance, least):
    rows = clip_rows(random.Random(seed), n)
    used, want = set(), set()
    order = sorted(rows, key=lambda r: (r[1], r[4]))
    for s in order:
        near = [o for o in order if (o[0], o[2]) == (s[0], s[2]) and o not in used and o[1] != s[1] and abs(o[3] - s[3]) <= tolerance]
        if s not in used and len(near) + 1 >= least:
            for o in [s, *near]:
                used.add(o)
                want.add((o[0], o[2], o[1], o[4], s[1], s[4]))
    got = matching.cluster_leftovers(spark.createDataFrame(rows, "g int, p string, label string, d double, idx int"), "p", "label", "d", "idx", tolerance, least, on=["g"])
    assert got.columns == ["g", "label", "p", "idx", "seed_p", "seed_idx"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_ransac(spark):
    x = [0.0, 100.0, 200.0, 300.0]
    y = [10.0, 110.1, 210.2, 900.0]
    fit = folds.ransac(x, y)
    assert fit["inlier_count"] == 3 and fit["scale"] == pytest.approx(1.001) and fit["anchor_count"] == 4
    assert folds.ransac(x[:2], y[:2]) is None and folds.ransac([1.0] * 5, [1.0] * 5) is None
    df = spark.createDataFrame([("p", a, b, i) for i, (a, b) in enumerate(zip(x, y))] + [("q", 1.0, 1.0, 0)], "k string, x double, y double, i int")
    assert [r.k for r in folds.affine_fit(df, "k", "x", "y", "i").collect()] == ["p"]


def test_boundary_scan(spark):
    rows = [("p", t, k) for t, k in [(0.0, "end"), (10.0, "start"), (50.0, "end"), (400.0, "end"), (450.0, "start"), (600.0, "start"), (1000.0, "end")]]
    got = folds.boundary_scan(spark.createDataFrame(rows, "p string, t double, k string"), "p", "t", "k", ["start"], ["end"]).collect()
    assert [(r.start_sec, r.end_sec) for r in got] == [(10.0, 400.0), (600.0, 1000.0)]


def test_selection(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k"))
    assert [r.id for r in selection.slice_rows(df, ["id"], 5, 10, 3).orderBy("id").collect()] == [5, 15, 25]
    with pytest.raises(ValueError):
        selection.slice_rows(df, ["id"], stride=0)
    assert selection.shards(df, ["id"], 30).groupBy("shard").count().orderBy("shard").collect() == [(0, 30), (1, 30), (2, 30), (3, 10)]
    quota = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "z"), ("b", 5, "w")], "t string, o int, key string")
    got = selection.quota_then_fill(quota, "t", ["a", "b"], {"a": 0.5, "b": 0.25}, 4, ["o"], ["t", "key"]).collect()
    assert [r.o for r in got] == [1, 4, 3, 5]  # the duplicate in a's quota is wasted
    assert [r.o for r in selection.round_robin(quota, "t", ["b", "a"], "o", 3, ["o"]).orderBy("position").collect()] == [5, 3, 4]
    items = spark.createDataFrame([([(0.5, 1), (0.9, 2), (0.9, 3)],)], "v array<struct<c: double, n: int>>")
    assert [x.n for x in items.select(selection.top_items(F.col("v"), ["c"], 2)).first()[0]] == [2, 3]
    attempts = spark.createDataFrame([("t", "ok", 1), ("t", "error", 2), ("u", "error", 1), ("u", "error", 3)], "key string, status string, seq int")
    assert {(r.key, r.seq) for r in selection.latest_attempt(attempts, "key", "status", "seq").collect()} == {("t", 1), ("u", 3)}
    a = spark.createDataFrame([("g1", "x"), ("g2", "y")], "id string, sem string")
    b = spark.createDataFrame([("g1", "z"), ("g3", "x")], "id string, sem string")
    assert sorted((r.id, r.original_id) for r in selection.union_passes([a, b], ["sem"], "id", ["sem"]).collect()) == [("g1", "g1"), ("g1_2", "g1"), ("g2", "g2")]
    same = selection.safe_ids(spark.createDataFrame([(i, x, "s") for i, x in enumerate("aaab")], "o int, id string, s string"), "id", ["o"], "s")
    assert [r.id for r in same.orderBy("o").collect()] == ["a", "a_s", "a_s_2", "b"]
    opts = spark.createDataFrame([(["x", "y", "x", "z"], "z")], "o array<string>, c string")
    assert tuple(opts.select(selection.options_without_repeats(F.col("o"), F.col("c"))).first()[0]) == (["x", "y", "z"], "C")


def test_select_distinct_capped(spark):
    rows = [(1, "e", "p", "x"), (2, "e", "p", "x"), (3, "e", "q", "x"), (4, "e", "r", "x"), (5, "f", "p", "x")]
    got = folds.select_distinct_capped(spark.createDataFrame(rows, "o int, ev string, who string, s string"), ["ev", "who"], ["o"], ["ev"], 2, 10)
    assert sorted(r.o for r in got.collect()) == [1, 3, 5]


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_running_sets_are_all_that_came_before(spark, chunk):
    rng = random.Random(chunk)
    states = [(g, k, float(rng.randrange(40))) for g in "ab" for k in "xyz" for _ in range(8)]
    changes = [(rng.choice("abc"), rng.choice("xyw"), float(rng.randrange(50)), [rng.randrange(9) for _ in range(rng.randrange(3))], [i]) for i in range(150)] + [("a", "x", None, [99], [99])]
    got = accumulate.running_sets(spark.createDataFrame(states, "g string, k string, t double"), spark.createDataFrame(changes, "g string, k string, t double, u array<int>, v array<int>"), ["g"], ["k"], "t", ["u", "v"], chunk)
    rows = {(r.g, r.k, r.t): (r.u, r.v) for r in got.collect()}
    assert rows == {(g, k, t): tuple(sorted({x for c in changes if c[:2] == (g, k) and c[2] is not None and c[2] <= t for x in c[i]}) for i in (3, 4)) for g, k, t in states} and got.count() == len(rows)


WORDY = ["a b", "a", "b a b", "the end of the day and the beginning of it all", "the end of the day and the beginning", "ü é", "z" * 40, "nowhere", "a b a b a b a b a b a b", "x" * 2_200_000]


def pattern_texts(rng):
    texts = [" ".join(rng.choice(["a", "b", "c", "ü", "é", "the", "end"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    texts += ["say the end of the day and the beginning of it all again", "the end of the day and the beginning of it all", "the end of the day and the beginning of it", None, "", "a", "zz " + "z" * 40 + "z", "z" * 40, "a b " * 200 + "a", "y " + "x" * 2_200_000]
    return list(enumerate(texts)) + [(0, "a b"), (None, "ü é")]


@pytest.mark.parametrize("words", [True, False])
def test_patterns_are_found_as_by_looking_for_each(spark, words):
    rng = random.Random(6)
    texts = pattern_texts(rng)
    marks = [(i, p) for i, p in enumerate([*WORDY, None, "", "a b"])] + [(50 + i, "".join(rng.choice("ab ü") for _ in range(n)).strip() or "b") for i, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31])]
    got = patterns.found_in(spark.createDataFrame(texts, "id int, body string").repartition(3), "body", spark.createDataFrame(marks, "mark int, p string"), "p", words=words)
    pad = (lambda t: f" {t} ") if words else str
    want = sorted((repr(i), m) for i, t in texts for m, p in marks if t is not None and p and pad(p) in pad(t))
    assert sorted((repr(r.id), r.mark) for r in got.collect()) == want


def test_a_full_bitmap_passes_more_and_finds_the_same(spark, monkeypatch):
    """Spans that share a bit with an anchor are told apart by hash and text."""
    texts, marks = [(i, f"t{i} and t{i + 1} or {i * 7}") for i in range(300)], [(i, f"t{i} and t{i + 1}") for i in range(0, 300, 3)]
    wanted = np.full(patterns._BITS // 8, 255, np.uint8)
    monkeypatch.setattr(patterns, "_bitmap", lambda marks: wanted)
    got = patterns.found_in(spark.createDataFrame(texts, "id int, body string"), "body", spark.createDataFrame(marks, "mark int, p string"), "p", words=True)
    assert sorted((r.id, r.mark) for r in got.collect()) == [(i, i) for i in range(0, 300, 3)]
    none = patterns.found_in(spark.createDataFrame(texts, "id int, body string"), "body", spark.createDataFrame([], "mark int, p string"), "p")
    assert none.count() == 0 and none.columns == ["id", "mark"]


@pytest.mark.parametrize("block_rows,beyond", [(1, False), (7, True), (16, False), (4096, True)])
def test_containment_by_sweep_is_the_nested_loop(spark, block_rows, beyond):
    rng = random.Random(block_rows)
    spans_ = [(i, rng.choice(["a", "a", "b", None]), float(s), float(s + rng.choice([0, 1, 3, 10, 90]))) for i in range(160) for s in [rng.randrange(60)]]
    spans_ += [(900, "a", None, 5.0), (901, "a", 5.0, None), (902, "a", 9.0, 3.0), (903, "a", float("nan"), float("nan"))]
    kids, parents = spans_[::2], spans_[1::2]
    c, p = spark.createDataFrame(kids, "c int, k string, cs double, ce double").repartition(3), spark.createDataFrame(parents, "p int, k string, ps double, pe double").repartition(2)
    got = {r.c: r.p for r in sweep.first_containing(c, p, ("cs", "ce"), ("ps", "pe"), ["k"], "c", "p", [F.col("pe") - F.col("ps"), F.col("ps")], beyond, block_rows).collect()}
    whole = lambda s, e: s is not None and e is not None and s <= e
    want = {}
    for i, k, s, e in kids:
        inside = [(pe - ps, ps, q) for q, pk, ps, pe in parents if pk == k and whole(ps, pe) and whole(s, e) and ps <= s and (pe > e if beyond else pe >= e)]
        if inside:
            want[i] = min(inside)[2]
    assert got == want


def test_ten_thousand_parents_over_one_child(spark):
    """All parents of a key are open at once, over many blocks; rows stay parents and children."""
    parents = spark.range(10_000).select(F.col("id").alias("p"), F.lit("k").alias("k"), (F.col("id") % 97).cast("double").alias("ps"), (F.lit(20_000.0) + F.col("id") % 991).alias("pe"))
    kids = spark.createDataFrame([(1, "k", 500.0, 600.0), (2, "k", 96.0, 20_990.0), (3, "k", 95.0, 20_991.0), (4, "j", 1.0, 2.0)], "c int, k string, cs double, ce double")
    got = joins.containment_join(kids, parents, ("cs", "ce"), ("ps", "pe"), ["k"], "c", "p", [F.col("pe") - F.col("ps")])
    rows = [(r["p"], r["ps"], r["pe"]) for r in parents.collect()]
    best = lambda s, e: min(((pe - ps, p) for p, ps, pe in rows if ps <= s and pe >= e), default=(None, None))[1]
    assert {r.c: r.p for r in got.collect()} == {1: best(500.0, 600.0), 2: best(96.0, 20_990.0), 3: None, 4: None}


@pytest.mark.parametrize("horizon", [0.5, 3.0, 50.0])
def test_next_of_another_owner_is_the_nested_loop(spark, horizon):
    rng = random.Random(int(horizon))
    asks = [(i, rng.choice("gh"), float(rng.randrange(40)), rng.choice(["a", "b", None])) for i in range(60)] + [(99, "g", None, "a")]
    later = [(i, rng.choice("gh"), float(rng.randrange(45)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(80)] + [(98, "g", None, "b")]
    l, r = spark.createDataFrame(asks, "i int, g string, t double, who string"), spark.createDataFrame(later, "j int, g string, u double, whose string")  # noqa: E741
    got = {x.i: x.j for x in joins.next_other(l, r, "t", "u", "who", "whose", horizon, ["g"], ["j"]).collect()}
    want = {}
    for i, g, t, who in asks:
        near = [(u, j) for j, h, u, whose in later if h == g and t is not None and u is not None and t < u <= t + horizon and whose != who]
        if near:
            want[i] = min(near)[1]
    assert got == want


def test_next_join_is_the_nested_loop(spark):
    rng = random.Random(8)
    asks = [(i, rng.choice("ghz"), float(rng.randrange(30))) for i in range(50)] + [(99, "g", None)]
    later = [(i, rng.choice("gh"), float(rng.randrange(30))) for i in range(40)] + [(98, "g", None)]
    l, r = spark.createDataFrame(asks, "i int, g string, t double"), spark.createDataFrame(later, "j int, g string, u double")  # noqa: E741
    got = {x.i: x.j for x in joins.next_join(l, r, "t", "u", ["g"], ["j"]).collect()}
    assert got == {i: min(((u, j) for j, h, u in later if h == g and t is not None and u is not None and u > t), default=(None, None))[1] for i, g, t in asks}


def plain_ids(rows):
    """The pass, spelled out, for rows (order, scope, id, suffix)."""
    used, out = {}, {}
    for o, scope, one, suffix in sorted(rows):
        known = used.setdefault(scope, set())
        base, n, name = (one if suffix is None else f"{one}_{suffix}"), 2, one
        if name in known and suffix is not None:
            name = base
        while name in known:
            name, n = f"{base}_{n}", n + 1
        known.add(name)
        out[o] = name
    return out


@pytest.mark.parametrize("suffixes", [["s"], ["s", "2", "s_2"], [None], [None, "2"]])
def test_safe_ids_are_those_of_the_pass_in_order(spark, suffixes):
    """Given ids look like names that are made: a_2, a_s, a_s_2."""
    rng = random.Random(len(suffixes))
    rows = [(i, rng.choice("pq"), rng.choice(["a", "a", "a", "a_s", "a_2", "a_s_2", "a_2_2", "b"]), rng.choice(suffixes)) for i in range(160)]
    df = spark.createDataFrame(rows, "o int, scope string, id string, s string").repartition(3)
    got = {r.o: r.id for r in selection.safe_ids(df, "id", ["o"], "s", ["scope"]).collect()}
    assert got == plain_ids(rows)


@pytest.mark.parametrize("limit", [1, 7, 40, 500])
def test_quotas_and_turns_by_plain_loops(spark, limit):
    rng = random.Random(limit)
    rows = [(i, rng.choice("abcz"), rng.randrange(12), rng.randrange(50)) for i in range(200)]
    df = spark.createDataFrame(rows, "o int, t string, key int, score int").repartition(4)
    strata, shares = ["b", "a", "c"], {"a": 0.1, "b": 0.3, "c": 0.02}
    seq, turns = {}, []
    for o, t, key, score in rows:
        if t in strata:
            seq[t] = seq.get(t, 0) + 1
            turns.append((seq[t] > max(1, int(limit * shares[t])), strata.index(t), seq[t], o, key))
    once, seen = [], set()
    for *_, o, key in sorted(turns):
        if key not in seen:
            seen.add(key)
            once.append(o)
    assert [r.o for r in selection.quota_then_fill(df, "t", strata, shares, limit, ["o"], ["key"]).collect()] == once[:limit]
    k = max(1, min(8, limit // 5))
    best = sorted(rows, key=lambda r: (-r[3], r[0]))
    first = sorted((n, strata.index(t), r[0]) for t in strata for n, r in enumerate([r for r in best if r[1] == t][:k]))
    heads = [o for _, _, o in first]
    assert [r.o for r in selection.round_robin(df, "t", strata, "score", limit, ["o"]).orderBy("position").collect()] == (heads + [r[0] for r in best if r[0] not in heads])[:limit]
