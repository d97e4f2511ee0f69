"""Steps that only larger tables or odd ids bring out: plans, counts and twins."""

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidewright.functions import numbers
from tidewright.llm import jaccard
from tidewright.operators import blocks, folds, joins, matching, patterns, selection, windows
from tidewright.plans import evaluation, event_queries, ledger, payload_queries, seed_queries, seeds, table_queries, trajectory
from tidewright.scratch import Scratch


def _events(folder, rows):
    """An events table of (event_id, second, user_id, event_type, value, k) in a folder."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(second) AS ts, user_id, event_type, value, '{{\"k\": ' || k || '}}' AS props FROM ({rows}) AS r(event_id, second, user_id, event_type, value, k)) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


def test_vote_ticks_join_nothing(spark):
    df = spark.createDataFrame([("g", "a", 0.0, 40.0, 0.5, 1), ("g", "b", 12.0, 26.0, 0.5, 0), ("g", "b", 30.0, 35.0, 9.0, 2), ("h", "a", -30.0, 5.0, 0.0, 3), ("h", "c", -9.0, 5.1, 0.0, 4), (None, "a", 0.0, 40.0, 1.0, 5), ("g", "a", None, 40.0, 1.0, 6), ("g", "c", 3.0, 3.0, 1.0, 7)], "k string, l string, s double, e double, w double, i int")
    got = windows.vote_ticks(df, ["k"], "l", df.w, ("s", "e"), 10.0, ["i"])
    assert {(r.k, r.tick): (r.l, r.share) for r in got.collect()} == {("g", 0): ("a", 1.0), ("g", 1): ("b", 0.5), ("g", 2): ("b", 0.5), ("g", 3): ("a", 1.0), ("h", 0): ("c", 1.0)}
    assert "Join" not in got._jdf.queryExecution().toString()


def test_global_ids_of_more_than_six_digits(tmp_path):
    con = _events(tmp_path, "SELECT i, i // 10, i % 60, 'click', 1.0, i % 100 FROM range(1000005) AS t(i)")
    found = con.sql(f"SELECT count(*), count(DISTINCT global_event_id), max(global_event_id) FILTER (length(global_event_id) > 9) FROM ({payload_queries.ORACLE_SQL['global_fold_rows']})").fetchall()
    assert found == [(1000005, 1000005, "ge_1000005")]


def test_timed_events_that_are_local_and_absolute(spark, tmp_path):
    con = _events(tmp_path, "SELECT i, i // 3, i % 5, 'view', 1.0, i % 7 FROM range(400) AS t(i)")
    got = [tuple(r) for r in event_queries.timed_event_repair(spark, str(tmp_path)).collect()]
    want = con.sql(event_queries.ORACLE_SQL["timed_event_repair"]).fetchall()
    assert sorted(got) == sorted(want) and len({r[2] for r in got if r[0] % 8 == 1}) == 2


def test_affine_fit_in_blocks(spark):
    """Blocks that cut keys, keys of one and two rows, and lines that no pair gives."""
    rng = random.Random(5)
    rows = [(k, x, 1.002 * x + 3 + rng.uniform(-1.9, 1.9) if rng.random() < 0.8 else rng.uniform(0, 900), 1000 * j + i) for j, (k, n) in enumerate([("a", 230), ("b", 1), ("c", 2), ("d", 3), ("e", 61)]) for i in range(n) for x in [rng.uniform(0, 900)]]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 7), (None, 1.0, 1.0, 8), *[("f", 2.0, float(i), 9000 + i) for i in range(9)]], "k string, x double, y double, i int").repartition(5)
    whole = {r.k: r for r in folds.affine_fit(df, "k", "x", "y", "i").collect()}
    cut = {r.k: r for r in folds.affine_fit(df, "k", "x", "y", "i", block_rows=7).collect()}
    hashes = {r.i: r.h for r in df.select("i", F.xxhash64("i").alias("h")).collect()}
    for k in "abcdef":
        own = [r for r in rows if r[0] == k]
        ranks = folds.draw_order(np.array([hashes[r[3]] for r in own], np.int64), 200, 0)
        want = folds.inlier_fit([r[1] for r in own], [r[2] for r in own], [tuple(np.argsort(ranks[:, t], kind="stable")[:2]) for t in range(200)] if len(own) > 1 else [])
        assert (k in whole) == (k in cut) == (want is not None)
        for got in (whole, cut) if want else ():
            assert {c: pytest.approx(got[k][c]) for c in want} == want


def test_snapshots_are_counted_without_being_made(spark, sf):
    events = spark.createDataFrame([("g", 40.0), ("g", 3.0), ("h", 40.5), ("i", -20.0), ("j", -25.0), ("l", 0.0), ("m", None), (None, 9.0)], "game_id string, abs_end_sec double").withColumns({"world_event_id": F.lit("w"), "source_povs": F.array(F.lit("p"))})
    said = events.select("game_id", "abs_end_sec", F.lit("c").alias("claim_id"))
    for players in (spark.createDataFrame([(g, p) for g in "ghijlm" for p in "pq"] + [("g", "p"), ("x", "p")], "game_id string, player_id string"), spark.createDataFrame([("p",), ("q",), ("p",)], "player_id string")):
        made = {r.game_id: r["count"] for r in seeds.snapshots(events, said, players).groupBy("game_id").count().collect()}
        assert {r.game_id: r.n_rows for r in seeds.snapshot_counts(events, players).collect()} == made and made["h"] == 14
    assert "Generate" not in seed_queries.seed_ledger_counts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_simhash_names_pairs_of_the_pipelines_near_dedup(spark):
    """Texts whose fingerprints lie within four bits are pairs before any band is looked at; copies of a set are one node."""
    rng = random.Random(3)
    long = [f"w{rng.randrange(900)}" for _ in range(700)]
    texts = [" ".join(long), " ".join([*long[:350], "new", *long[351:]]), " ".join(f"v{rng.randrange(900)}" for _ in range(700)), " ".join(long)]
    rows = jaccard.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    of = {r.doc_id: (r.node, r.fp) for r in rows.collect()}
    assert (of[0][1] ^ of[1][1]).bit_count() <= 4 and of[0] == of[3]
    pairs = jaccard.by_fingerprint(rows.dropDuplicates(["node"])).collect()
    assert {tuple(r) for r in pairs} == {tuple(sorted((of[0][0], of[1][0])))}
    assert pairs and {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()} == {0, 2}


def test_numbers_come_without_a_second_shuffle(spark):
    """The rows of a numbered table are shuffled by its order alone; keys' first positions are a small table."""
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 5000).alias("at"), F.lit("wide").alias("text"))
    got = selection.numbered(df, ["k"], ["at"], "n")
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" not in plan and "SortMergeJoin" not in plan
    for k in range(7):
        own = sorted((r.at, r.n) for r in rows if r.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_long_events_lie_in_few_buckets_of_truth_links(spark, monkeypatch):
    widths, join = [], joins.range_join
    monkeypatch.setattr(joins, "range_join", lambda *a, **k: widths.append(a[4]) or join(*a, **k))
    events = spark.createDataFrame([("g", "ge_1", ["ana"], "hall", "walks", 0.0, 14400.0, 0.9), ("g", "ge_2", ["bo"], "hall", "walks", 20000.0, 20010.0, 0.9)], "game_id string, world_event_id string, actors array<string>, location string, description string, abs_start_sec double, abs_end_sec double, certainty double")
    claims = spark.createDataFrame([("g", f"c{i}", "ana", ["bo"], "I was there", "i was there", at, at + 5, 0.8, []) for i, at in enumerate((100.0, 14570.0, 14590.0, 20005.0))], "game_id string, claim_id string, speaker string, heard_by array<string>, content string, normalized_content string, abs_start_sec double, abs_end_sec double, certainty double, target_entities array<string>")
    edges = spark.createDataFrame([("g", "ge_1", "bo", "direct_visual")], "game_id string, event_id string, player_id string, visibility string")
    got = ledger.claim_truth_links(claims, events, edges, spark.createDataFrame([("g", "ana"), ("g", "bo")], "game_id string, player_id string"))
    assert {(r.claim_id, tuple(r.world_event_ids)) for r in got.collect()} == {("c0", ("ge_1",)), ("c1", ("ge_1",))}
    assert 14400 / widths[0] <= 4


def test_numbered_items_leave_their_lists_behind(spark, monkeypatch):
    """A file of a whole day holds many items; none of them carries the others along when it is numbered."""
    seen, numbered = [], selection.numbered
    monkeypatch.setattr(selection, "numbered", lambda df, *a: seen.append(df.columns) or numbered(df, *a))
    observed = [(float(i), i + 1.0, "task", "ana", "hall", "works", ["direct_visual_observation"], "e", "", "", "0.9", False) for i in range(3)]
    uttered = [(float(i), i + 1.0, "ana", "I saw bo", None, None, None, "0.9", False) for i in range(3)]
    rows = spark.createDataFrame([("g", "e", "p_0_9", "gameplay", 0, v, 0.0, 9.0, observed, uttered, f"g/{v}") for v in ("ana", "bo")], ledger.ANNOTATION + ", path string")
    players = spark.createDataFrame([("g", "ana"), ("g", "bo")], "game_id string, player_id string")
    events, claims = ledger.candidate_events(rows, players).collect(), ledger.candidate_claims(rows, players).collect()
    assert sorted(r.seq for r in events) == sorted(r.seq for r in claims) == [1, 2, 3, 4, 5, 6]
    assert all(r.actors == ["ana"] for r in events) and all(r.target_entities == ["bo"] for r in claims)
    assert len(seen) == 2 and not {"observations", "utterances", "_roster"} & {c for cs in seen for c in cs}


def test_snapshot_sets_come_together_where_rows_meet(spark):
    events = spark.createDataFrame([("g", "ge_1", 5.0), ("g", "ge_2", 20.0)], "game_id string, world_event_id string, abs_start_sec double")
    claims = spark.createDataFrame([("g", "c1", 6.0)], "game_id string, claim_id string, abs_start_sec double")
    edges = spark.createDataFrame([("g", "ge_1", "ana", "direct_visual"), ("g", "ge_2", "ana", "public_ui"), ("g", "c1", "ana", "heard_claim"), ("g", "ge_1", "bo", "not_visible")], "game_id string, event_id string, player_id string, visibility string")
    cutoffs = spark.createDataFrame([("g", "ana", 1.0), ("g", "ana", 6.0), ("g", "ana", 30.0), ("g", "bo", 30.0), ("g", "bo", 30.0), ("h", "cy", 3.0)], "game_id string, target_player string, cutoff_abs_sec double")
    got = ledger.belief_snapshots(events, claims, edges, cutoffs)
    rows = {(r.target_player, r.cutoff_abs_sec): (r.private_observations, r.public_history, r.heard_claims, r.forbidden_event_ids, r.available_evidence_ids) for r in got.collect()}
    assert got.count() == 5 and rows["ana", 1.0] == rows["cy", 3.0] == ([], [], [], [], []) and rows["bo", 30.0] == ([], [], [], ["ge_1"], [])
    assert rows["ana", 6.0] == (["obs_ana_ge_1"], ["c1"], ["c1"], [], ["c1", "obs_ana_ge_1"])
    assert rows["ana", 30.0] == (["obs_ana_ge_1", "obs_ana_ge_2"], ["c1", "obs_ana_ge_2"], ["c1"], [], ["c1", "obs_ana_ge_1", "obs_ana_ge_2"])
    keys = [p.split(")")[0] for p in got._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert keys and not any("cutoff_abs_sec" in k for k in keys)


def test_dense_events_take_few_rounds(spark, monkeypatch):
    """Events that outlast thousands of rows: each block waits for the one before, so blocks are long; a round reads changed blocks alone."""
    names, stage = [], Scratch.staged
    monkeypatch.setattr(Scratch, "staged", lambda self, df, name: names.append(name) or stage(self, df, name))
    df = spark.range(50000).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 0.36).alias("s"), (F.col("id") * 0.36 + 3700 + F.col("id") % 90).alias("e"))
    rows = [(r.i, r.s, r.e) for r in df.orderBy("s").collect()]
    got = {r.i: r.kept_id for r in folds.merge_events(df, ["k"], "s", "e", "i", ["s", "i"], edge_sec=60).collect()}
    assert got == dict(zip([r[0] for r in rows], folds.Merge(60)(*map(list, zip(*rows)))))
    assert 1 < len(set(got.values())) and sum(n.startswith("states_") for n in names) <= 4


def test_dots_of_blocks_are_those_of_pairs(spark, sf):
    rng = random.Random(8)
    rows = [(i, [None, [1.0, None], [], [0.5] * 5][i] if i < 4 else [rng.uniform(-9, 9) for _ in range(7)]) for i in range(40)]
    a = spark.createDataFrame(rows, "a int, v array<float>")
    b = a.select(F.col("a").alias("b"), F.col("v").alias("w"))
    got = joins.dots(a, b, "a", "b", "v", "w", block_rows=9)
    want = {(r.a, r.b): r.dot for r in joins.grid(a, b).select("a", "b", numbers.dot(F.col("v"), F.col("w")).alias("dot")).collect()}
    assert {(r.a, r.b): r.dot for r in got.collect()} == want and len(want) == 1600
    assert "MapInArrow" in table_queries.vector_dot(spark, sf)._jdf.queryExecution().executedPlan().toString()


def _nodes(spark):
    """Nodes of two episodes with sights, words and public facts, some without a time or after the last cutoff; players; cutoffs."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        who, audio = rng.choice("abc"), rng.random() < 0.4
        at = None if i == 7 else 500.0 if i % 20 == 19 else float(rng.randrange(40))
        rows.append(("xy"[i % 2], f"n{i:03d}", at, [who], rng.random() < 0.1, False, "audio" if audio else "visual", None, [rng.choice("abc")], True, [f"e{rng.randrange(9)}"], who, rng.choice(["task", "vote", "claim", "kill"]), [rng.choice("abcz")], [], who if audio else None))
    nodes = spark.createDataFrame(rows, "episode_id string, trajectory_node_id string, abs_start_sec double, source_povs array<string>, public_ui boolean, global_fact boolean, modality string, utterance string, heard_by array<string>, audio_admissible boolean, evidence_asset_ids array<string>, player_id string, event_type string, visible_players array<string>, mentioned_players array<string>, speaker_id string")
    players = spark.createDataFrame([(e, p) for e in "xy" for p in "abc"], "episode_id string, player_id string")
    return rows, nodes, players, spark.createDataFrame([(e, float(t)) for e in "xy" for t in range(0, 45, 3)], "episode_id string, cutoff_abs_sec double")


def test_layer_evidence_is_made_where_it_comes_out(spark):
    """As by a plain loop, where a node without a time leaves it to the other side's; states are made of lists, which alone are shuffled."""
    rows, nodes, players, cutoffs = _nodes(spark)
    found = trajectory.layer_evidence(trajectory.state_keys(players, cutoffs), nodes, players, chunk=2)
    got = {(r.information_state_id, r.target, r.layer): r.evidence_ids for r in found.collect()}
    want = {}
    for e, subject, target, (layer, types) in [(e, s, p, x) for e in "xy" for s in "abc" for p in "abc" if p != s for x in trajectory.LAYERS.items()]:
        has = [(r[10][0], r[2]) for r in rows if r[0] == e and (r[4] or subject in r[3] or subject in r[8])]
        bears = [(r[10][0], r[2]) for r in rows if r[0] == e and r[12] in types and target in {*r[13], r[15], r[11] if r[12] in trajectory.PLAYER_CENTRIC else None}]
        since = {}
        for one in {i for i, _ in has} & {i for i, _ in bears}:
            times = [min(own) for side in (has, bears) if (own := [at for i, at in side if i == one and at is not None])]
            if times:
                since[one] = max(times)
        for t in range(0, 45, 3):
            if ids := sorted(i for i, at in since.items() if at <= t):
                want[f"{e}:{subject}:{t:.3f}", target, layer] = ids
    assert got == want and got
    keys = [p.split(")")[0] for p in found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert keys and not any("target" in k and "cutoff_abs_sec" in k for k in keys) and "evidence_id_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_states_of_evidence_are_those_of_information_states(spark):
    _, nodes, players, cutoffs = _nodes(spark)
    full = trajectory.information_states(nodes, players, cutoffs)
    slim = trajectory.evidence_states(nodes, players, cutoffs, chunk=4)
    as_dict = lambda df: {r.information_state_id: (r.player_id, r.cutoff_abs_sec, r.available_evidence_ids) for r in df.collect()}
    assert as_dict(slim) == as_dict(full) and len(as_dict(slim)) == 90
    evidence = trajectory.layer_evidence(full, nodes, players)
    rows = lambda df: sorted((r.trial_id, r.evidence_ids) for r in df.collect())
    assert rows(trajectory.trials(evidence, slim)) == rows(trajectory.trials(evidence, full)) != []


def test_snapshots_are_sorted_in_many_parts_and_numbered_before_they_hold_lists(spark):
    events = spark.createDataFrame([("g", ["a"], 5.0, "w1"), ("g", ["b"], 12.0, "w2"), ("g", ["a", "b"], 25.0, "w3")], "game_id string, source_povs array<string>, abs_end_sec double, world_event_id string")
    said = spark.createDataFrame([("g", 11.0, "c1")], "game_id string, abs_end_sec double, claim_id string")
    found = seeds.snapshots(events, said, spark.createDataFrame([("g", "a"), ("g", "b")], "game_id string, player_id string"))
    got = {r.snapshot_id: (r.cutoff_abs_sec, r.private_observations, r.forbidden_event_ids, r.heard_claims, r.available_evidence_ids) for r in found.collect()}
    assert len(got) == 10 and got["seed_mem_a_000003"] == (20.0, ["w1"], ["w2"], ["c1"], ["w1", "c1"])
    assert got["seed_mem_b_000004"] == (25.0, ["w2", "w3"], ["w1"], ["c1"], ["w2", "w3", "c1"]) and got["seed_mem_a_000001"] == (0.0, [], [], [], [])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("target_player#") and plan.count(", 256), REPARTITION_BY_NUM") >= 2
    assert not any("target_player" in line for line in plan.splitlines() if "row_number()" in line)


def test_clips_are_asked_once_and_by_many_tasks(spark, tmp_path):
    log = str(tmp_path / "asked")

    def client(prompt):
        with open(log, "a") as f:
            f.write(f"{prompt} {TaskContext.get().partitionId()}\n")
        return "[]" if prompt.endswith("3") else '[{"a": 1}, {"a": 2'

    clips = spark.range(40).coalesce(1).select(F.format_string("c%d", "id").alias("clip_id"), F.format_string("p%d", "id").alias("prompt"))
    events, errors = evaluation.annotate(clips, client)
    assert (events.count(), errors.count()) == (36, 4)
    asked = [line.split() for line in open(log)]
    assert sorted(p for p, _ in asked) == sorted(f"p{i}" for i in range(40)) and len({n for _, n in asked}) > 4


def test_fallback_events_make_an_annotation_once_a_row(spark, sf):
    """A filter on the item was moved below it, and made it and its numbers some forty times."""
    plan = payload_queries.fallback_events(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1 and plan.count("parseJson") == 1


def _rounds(monkeypatch):
    """Plans of the tables that `matching` writes round by round, by name."""
    plans, write = {}, Scratch.staged
    monkeypatch.setattr(Scratch, "staged", lambda self, df, name: plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}) or write(self, df, name))
    return plans


def test_a_round_of_greedy_matches_moves_its_edges_without_joins(spark, monkeypatch):
    """Equal edges count once, null ends not at all; each round read its edges five times, for minima of both ends and joins with them."""
    plans, rng = _rounds(monkeypatch), random.Random(4)
    edges = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(5))) for _ in range(90)]
    rows = spark.createDataFrame([*edges, *edges[:9], (None, 1, 0.0), (1, None, 0.0)], "l int, r int, d double")
    want, left, right = set(), set(), set()
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    got = [tuple(r) for r in matching.greedy_match(rows, ["l"], ["r"], ["d"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert "edges_2" in plans and not any("Join" in p for p in plans.values())


@pytest.mark.parametrize("least", [1, 2, 3])
def test_a_round_of_seed_clusters_moves_its_links_without_joins(spark, monkeypatch, least):
    """What items know of their neighbours and what leaves was joined to the links some seven times a round."""
    plans, rng = _rounds(monkeypatch), random.Random(least)
    pairs = {tuple(sorted(rng.sample(range(70), 2))) for _ in range(95)}
    near = {i: {b for p in pairs if i in p for b in p if b != i} for i in range(70)}
    want = {}
    for i in range(70):
        free = near[i] - want.keys()
        if i not in want and len(free) + 1 >= least:
            want |= {j: i for j in (i, *free)}
    items = spark.createDataFrame([(i,) for i in range(70)], "i int")
    edges = spark.createDataFrame([(a, b) for p in pairs for a, b in (p, p[::-1])], "i int, _i int")
    got = [tuple(r) for r in matching.seed_clusters(items, ["i"], edges, least).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert "links_2" in plans and not any("Join" in p for name, p in plans.items() if name != "found")


def test_bytes_are_scanned_in_runs_that_a_cache_holds():
    """Places near the ends of runs and texts; a scan took a megabyte of places at a time, each with a start, an end and a sum of its own for each size."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in (patterns._RUN - 3, 7, 0, 2 * patterns._RUN + 5, 1_000_000)]
    marks = ["ab", texts[0][-5:], texts[3][patterns._RUN - 4 : patterns._RUN + 12], texts[4][-16:], "nowhere at all..", "q"]
    size, h = patterns.anchors(pa.array(marks), False)
    wanted = np.zeros(patterns._BITS // 8, np.uint8)
    for bit in (h % np.uint64(patterns._BITS)).tolist():
        wanted[bit >> 3] |= 1 << (bit & 7)
    tracemalloc.start()
    row, found = patterns.places(pa.array(texts), False, sorted(set(size.tolist())), wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    code = dict(zip(h.view(np.int64).tolist(), zip(marks, size.tolist())))
    got = {(i, code[v][0]) for i, v in zip(row.tolist(), found.tolist()) if v in code}
    assert got == {(i, m) for i, t in enumerate(texts) for m, n in code.values() if m.encode()[:n].decode() in t}
    assert peak < 20e6


def test_blocks_are_dealt_to_tasks_however_few_files_hold_them(spark):
    """All blocks of a split of the files, or of a partition of their size, came to Python in one batch."""
    df = spark.range(9000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("s"), "id")
    with Scratch(spark) as scratch:
        packed = blocks.Blocks(scratch, df, ["k"], ["s"], ["s"], "id", block_rows=4)
        held = packed.rows.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
        assert held[2] == packed.chain.count() >= 2250 and held[0] >= 64 and held[1] <= 3 * blocks._SHARE
