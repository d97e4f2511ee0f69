"""Queries of review candidates, probe groups and review records over the `events` table, each with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans import groups, ledger
from tidewright.plans.event_queries import EV, GAMES, LINKS, games, ledger_tables

PLAYERS = ("Gemini", "baile", "saoyi")


def _k() -> Column:
    return F.col("k")


def _pick(*values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (_k() % len(values) + 1).cast("int"))


def _names() -> Column:
    return F.array(*[F.lit(p) for p in PLAYERS])


def route_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    rows = ev.select(
        "event_id", _pick("gameplay", "gameplay", "meeting").alias("phase_type"), _pick("movement", "task", "kill", "gameplay").alias("event_type"), F.when(_k() % 5 == 0, F.array("user_id", F.col("user_id") + 1)).otherwise(F.array("user_id")).alias("source_povs"), (_k() % 11 == 0).alias("needs_human_review"),
        (0.75 + (_k() % 4) / 8).alias("certainty"), _pick("baile 经过街道", "Gemini 在大厅 投票", "saoyi 去学校 声称", "nobody 街道", "saoyi 在公园").alias("description"), F.array(F.format_string("g_%06d_x", F.floor("s").cast("int") + 1000 - (_k() % 40).cast("int"))).alias("source_segment_ids"), (F.col("s") + 1000).alias("abs_start_sec"),
    )
    return rows.select("event_id", groups.is_route_event(_names()).alias("is_route"), ledger.phase_local_start(F.col("source_segment_ids"), F.col("abs_start_sec")).alias("local_start"), ledger.after_warmup().alias("warm"))


def claim_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a claim's speaker grounds an event, a hearer knows in time, and the claim can be about the event."""
    ev = games(spark, sf_dir)
    event = F.struct(F.concat(_pick("baile 被", "room", "Gemini 走"), F.lit(" x")).alias("description"), _pick("hall", None).alias("location"), F.array(_pick("baile", None)).alias("actors"), F.array().cast("array<string>").alias("patients"), F.array(_pick(None, "saoyi", None, None)).alias("source_povs"))
    claim = F.struct(_pick("我杀了", "尸体 saoyi", "hello", "death here", "baile 刀人").alias("content"), F.lit("").alias("normalized_content"), _pick("baile", "saoyi", None).alias("speaker"))
    rows = ev.select("event_id", "k", "e", event.alias("event"), claim.alias("claim"), F.array(_pick("a", "b")).alias("heard_by"), F.col("e").alias("abs_end_sec"))
    described = F.concat(F.col("claim.speaker"), _pick(" 被杀", " 走了", "的尸体", "."))
    return rows.select("event_id", groups.reveals("event", "claim", _names()).alias("reveals"), groups.heard_before_cutoff(F.lit("a"), F.col("e") + 1 - _k() % 3).alias("heard"), groups.speaker_grounds(F.coalesce("claim.speaker", F.lit("z")), F.array(_pick("baile", "x", "y")), F.array(F.lit("saoyi"), F.lit("baile")), described).alias("grounds"))


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    events, claims, players = ledger_tables(games(spark, sf_dir))
    edges = ledger.visibility_edges(events, claims, players)
    claims = claims.withColumn("claim_type", F.when(F.col("content") == "投票", "accusation").otherwise("location"))
    return events, claims, edges, ledger.claim_truth_links(claims, events, edges, players, within=1800.0)


def claim_truth_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, claims, edges, links = _ledger(spark, sf_dir)
    out = groups.claim_truth_candidates(links, claims, events, edges, longest=1800.0)
    return out.select("world_event_id", "claim_id", "target", "source", "gap_sec", F.round("score", 6).alias("score"), "truth_status_global")


def hidden_event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, claims, edges, links = _ledger(spark, sf_dir)
    used = groups.skip_list(links.select(F.get("world_event_ids", 0).alias("event_id")), events.where("location = 'room3'").select(F.concat_ws(":", "world_event_id", F.lit("x")).alias("cluster_key")))
    out = groups.hidden_event_candidates(events, edges, used)
    return out.select("world_event_id", "target", "source", F.round("score", 6).alias("score"), "template_suggestion")


def reveal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    said = F.concat(_pick("saoyi ", "x "), _pick("尸体", "nothing", "刀"))
    return ev.select("event_id", groups.reveal_score((_k() * 3).cast("double"), _pick("baile", "x"), _pick("accusation", "role", "sighting"), said, _names()).alias("score"))


def _groups(ev: DataFrame) -> DataFrame:
    """Groups with templates, claims and flags that turn on `k`."""
    return ev.select(
        F.format_string("pg%08d", "event_id").alias("probe_group_id"), "game_id", F.col("user_id").alias("target_player"), _pick(*groups.TEMPLATE_PRIORITY, "other").alias("template"), F.array(F.concat(F.lit("e"), _k() % 50)).alias("anchor_event_ids"), F.lit("q").alias("query_type"),
        F.when(_k() % 3 == 0, F.array(*[F.concat(F.lit("c"), (_k() + i) % 20) for i in range(3)])).otherwise(F.array().cast("array<string>")).alias("related_claim_ids"), F.when(_k() % 2 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("hidden_event_ids_for_target"),
        F.when(_k() % 4 == 0, F.array(F.lit("v"))).alias("available_evidence_ids_for_target"), (_k() % 5 == 0).alias("needs_human_review"),
    )


def review_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    links = ev.where("event_type = 'error'").select(F.concat(F.lit("c"), _k() % 20).alias("claim_id"), _pick("contradicted", "ambiguous", "supported", "unverified").alias("truth_status_global"), (_k() % 7 == 0).alias("needs_human_review"))
    return groups.review_scores(_groups(ev), links).select("probe_group_id", "score", F.array_join(groups.drop_reasons(), ",").alias("drop_reasons"))


def group_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups ask the same, with and without their template."""
    rows = _groups(games(spark, sf_dir)).withColumns({"full_key": F.sha2(F.to_json(groups.semantic_key()), 256), "key": F.sha2(F.to_json(groups.semantic_key(False)), 256)})
    return rows.agg(F.count("*").alias("n_groups"), F.count_distinct("full_key").alias("n_with_template"), F.count_distinct("key").alias("n_questions"))


def accepted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = games(spark, sf_dir).select("event_id", F.concat(F.lit("r"), _k() % 30).alias("review_record_id"), F.col("user_id").alias("probe_group_id"), _pick("accept_human_verified", "reject", "accept_human_verified").alias("gate_decision"))
    return groups.accepted_records(rows, ["event_id"]).select("review_record_id", "probe_group_id", "event_id")


def built_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each event and a target, of every template in turn."""
    ev = games(spark, sf_dir)
    template = _pick("private_witness", "vote_influence", "delayed_public_reveal", "claim_backed_hidden_event", "route_hidden_event", "hidden_event_awareness")
    claim = F.struct(F.format_string("c%d", "event_id").alias("claim_id"), (F.col("s") + 60).alias("abs_start_sec"), (F.col("e") + 60).alias("abs_end_sec"), F.when(_k() % 5 > 0, 0.5).alias("certainty"))
    rows = ev.select("event_id", "game_id", F.col("user_id").alias("target_player"), F.struct(F.format_string("e%d", "event_id").alias("world_event_id"), F.col("e").alias("abs_end_sec"), F.lit("d").alias("description"), F.when(_k() % 4 > 0, 0.75).alias("certainty"), F.array(F.lit("seg")).alias("source_segment_ids")).alias("event"), F.when((_k() % 6).isin(1, 2, 3), F.array(claim)).otherwise(F.array().cast("array<struct<claim_id:string,abs_start_sec:double,abs_end_sec:double,certainty:double>>")).alias("claims"), _pick("supported", "unverified").alias("truth"), template.alias("t"))
    out = groups.build_groups(rows, F.col("t"), "g001", ["event_id"])
    j = lambda c: F.array_join(c, ",").alias(c)
    return out.select("probe_group_id", "template", "cutoff_abs_sec", "query_type", j("anchor_event_ids"), j("related_claim_ids"), j("later_public_claim_ids"), "reveal_start_sec", j("hidden_event_ids_for_target"), j("available_evidence_ids_for_target"), j("diagnostic_families"), "claim_truth_confidence", "timestamp_confidence")


def static_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).withColumn("trial_id", F.format_string("t%d", "event_id"))
    ids = lambda p: F.array(F.lit(f"{p}1"), F.concat(F.lit(p), _k() % 3)).alias("acceptable_evidence_ids")
    out = groups.static_review_rows(ev.where("k % 7 > 0").select("trial_id"), ev.where("k % 5 > 0").select("trial_id", ids("a")), ev.where("k % 3 > 0").select("trial_id", ids("b")))
    return out.select("trial_id", F.array_join("available_evidence_ids", ",").alias("evidence"), "complete")


def promoted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).select(F.col("event_id").alias("probe_group_id"), "k")
    out = groups.promote(ev.where("k % 3 = 0"), [ev.where("k % 2 = 0"), ev.where("k % 5 = 0")], ev.where("k % 4 < 3"), ev.where("k % 7 > 0"))
    kept = groups.kept_of({"probes": ev}, out.where("promoted"), "probe_group_id")["probes"]
    return out.select("probe_group_id", "promoted").join(kept.select("probe_group_id", F.lit(True).alias("kept")), "probe_group_id", "left").select("probe_group_id", "promoted", F.coalesce("kept", F.lit(False)).alias("kept"))


def decided_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).withColumn("trial_id", F.format_string("t%d", "event_id"))
    trials = ev.where("k % 9 > 0").select("trial_id", F.concat(F.lit("v"), _k()).alias("value"))
    decisions = ev.select("trial_id", _pick("accept", "reject", "repair", "accept").alias("decision"), F.when((_k() % 4 == 2) & (_k() % 3 > 0), F.concat(F.lit("f"), _k())).alias("final_value"), F.when((_k() % 4 == 2) & (_k() % 5 == 0), F.lit("other")).alias("final_id"))
    return groups.decided_rows(trials, decisions).select("trial_id", "decision", "value", "issue")


def phase_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = games(spark, sf_dir).select(F.concat_ws("_", "game_id", F.floor(F.col("s") / 86400).cast("string")).alias("phase_id"), (F.col("user_id") % 6).cast("string").alias("player_id"))
    out = groups.phase_tasks(rows, F.array(F.lit("4"), F.lit("1")))
    return out.select("phase_id", "primary_player", F.array_join("context_players", ",").alias("context_players"))


def filled_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    phases = ev.where("event_type = 'signup'").select("game_id", F.col("event_id").alias("phase_id"))
    povs = ev.select("game_id", F.col("user_id").alias("player_id")).distinct()
    have = ev.where("event_type = 'signup' and k % 2 = 0").select(F.col("event_id").alias("phase_id"), F.col("user_id").alias("player_id"), F.lit("seen").alias("status"), F.col("k").alias("n_items"))
    return groups.filled_annotations(phases, povs, have, {"status": F.lit("missing_annotation"), "n_items": F.lit(0).cast("bigint")}).select("phase_id", "player_id", "status", "n_items", "missing")


def meeting_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir).withColumn("stop", F.col("s") + 1 + F.col("event_id") % 200)
    return groups.meeting_windows(ev, "s", "stop", 60.0, 5.0).select("event_id", F.col("window").cast("bigint").alias("window_no"), "start_sec", "end_sec")


def audio_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = games(spark, sf_dir).select("event_id", "s", _pick("needs_audio", "accept", "needs_review").alias("decision"))
    return groups.queue(rows, ["needs_audio", "needs_review"], ["s", "event_id"], ["event_id", "decision"])


QUERIES = {f.__name__: f for f in (
    route_predicate, claim_predicates, claim_truth_candidates, hidden_event_candidates, reveal_scores, review_group_scores, group_duplicates, accepted_records, built_groups, static_review, promoted_groups, decided_rows, phase_tasks, filled_annotations, meeting_windows, audio_queue,
)}

_G = f"WITH {EV}, {GAMES}"
_CANDIDATES = LINKS + """, tt AS (SELECT t.*, c.e AS ce, c.heard AS hb, CASE WHEN c.k % 4 = 2 THEN 'accusation' ELSE 'location' END AS ct FROM t JOIN claims c ON c.event_id = t.claim_id),
    dh AS (SELECT event_id, list(player_id ORDER BY player_id) FILTER (visibility = 'direct_visual') AS direct, list(player_id ORDER BY player_id) FILTER (visibility = 'not_visible') AS hidden FROM edges GROUP BY event_id)"""

ORACLE_SQL = {
    "route_predicate": _G + """ SELECT event_id, k % 3 < 2 AND k % 4 <> 2 AND k % 5 <> 0 AND k % 11 <> 0 AND 0.75 + (k % 4) / 8 >= 0.8 AND k % 5 = 4 AND k % 40 >= 15 AS is_route, CAST(k % 40 AS DOUBLE) AS local_start, k % 3 = 2 OR k % 40 >= 15 AS warm FROM gv""",
    "claim_predicates": _G + """, v AS (SELECT *, ['我杀了', '尸体 saoyi', 'hello', 'death here', 'baile 刀人'][k % 5 + 1] AS said, ['baile', 'saoyi', NULL][k % 3 + 1] AS sp, ['baile 被 x', 'room x', 'Gemini 走 x'][k % 3 + 1] || CASE WHEN k % 2 = 0 THEN ' hall' ELSE '' END AS told FROM gv),
        n AS (SELECT *, list_filter(['baile', 'saoyi', 'Gemini'], lambda p: (p = 'baile' AND k % 2 = 0) OR (p = 'saoyi' AND k % 4 = 1) OR contains(told, p)) AS names FROM v)
        SELECT event_id, NOT (k % 3 = 0 AND k % 5 = 0) AND k % 5 <> 2 AND CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda p: contains(said, p))) > 0 OR (sp IS NOT NULL AND list_contains(names, sp) AND k % 5 = 0) ELSE k % 5 IN (1, 3) END AS reveals,
            k % 2 = 0 AND k % 3 <= 1 AS heard, coalesce(sp, 'z') = ['baile', 'x', 'y'][k % 3 + 1] OR (sp IS NOT NULL AND k % 4 IN (1, 3)) AS grounds FROM n""",
    "claim_truth_candidates": _CANDIDATES + """, p AS (SELECT claim_id, tt.truth_status_global AS truth, ce, hb, ct, confidence, unnest(ids) AS w FROM tt),
        q AS (SELECT p.*, f.e AS fe, ce - f.e AS gap, direct, list_filter(hidden, lambda x: list_contains(hb, x))[1:2] AS targets FROM p JOIN facts f ON f.event_id = w JOIN dh ON dh.event_id = w WHERE ce - f.e > 1 AND ce - f.e <= 1800 AND len(direct) > 0)
        SELECT w AS world_event_id, claim_id, unnest(targets) AS target, direct[1] AS source, gap AS gap_sec, round(abs(gap - 20) / 10 - confidence * 5 + CASE WHEN truth = 'supported' THEN 1 ELSE 0 END - CASE WHEN ct = 'location' THEN 4 ELSE 0 END, 6) AS score, truth AS truth_status_global FROM q""",
    "hidden_event_candidates": _CANDIDATES + """, us AS (SELECT DISTINCT list_sort(ids)[1] AS w FROM t UNION SELECT event_id FROM facts WHERE k % 7 = 3)
        SELECT f.event_id AS world_event_id, unnest(hidden[1:2]) AS target, direct[1] AS source, round(-least(len(hidden), 5) + abs(len(direct) - 1) * 3.0 + s / 100000, 6) AS score, 'route_hidden_event' AS template_suggestion FROM facts f JOIN dh USING (event_id) WHERE len(direct) > 0 AND len(hidden) > 0 AND f.event_id NOT IN (SELECT w FROM us)""",
    "reveal_scores": _G + """ SELECT event_id, CAST(CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 3 <> 1 THEN 3 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 3 <> 1 THEN 2 ELSE 0 END + CASE WHEN k * 3 BETWEEN 45 AND 240 THEN 2 ELSE 0 END AS DOUBLE) AS score FROM gv""",
    "review_group_scores": _G + """, l AS (SELECT 'c' || (k % 20) AS c, sum(CASE k % 4 WHEN 0 THEN 18 WHEN 1 THEN 10 WHEN 2 THEN 4 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 4 ELSE 0 END) AS w FROM gv WHERE event_type = 'error' GROUP BY 1),
        r AS (SELECT event_id, unnest(['c' || (k % 20), 'c' || ((k + 1) % 20), 'c' || ((k + 2) % 20)]) AS c FROM gv WHERE k % 3 = 0), t AS (SELECT event_id, sum(w) AS w FROM r JOIN l USING (c) GROUP BY event_id)
        SELECT printf('pg%08d', event_id) AS probe_group_id, CAST([50, 45, 42, 38, 30, 10][k % 6 + 1] + CASE WHEN k % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 4 ELSE 0 END + coalesce(w, 0) AS BIGINT) AS score,
            CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN 'no_target_available_evidence_or_related_claim' || CASE WHEN k % 6 = 4 THEN ',weak_hidden_event_awareness_without_partial_information' ELSE '' END ELSE '' END AS drop_reasons FROM gv LEFT JOIN t USING (event_id)""",
    "group_duplicates": _G + """ SELECT count(*) AS n_groups, count(DISTINCT (user_id, k % 50, CASE WHEN k % 3 = 0 THEN k % 20 ELSE -1 END, k % 6)) AS n_with_template, count(DISTINCT (user_id, k % 50, CASE WHEN k % 3 = 0 THEN k % 20 ELSE -1 END)) AS n_questions FROM gv""",
    "accepted_records": _G + """ SELECT 'r' || (k % 30) AS review_record_id, user_id AS probe_group_id, min(event_id) AS event_id FROM gv WHERE k % 3 <> 1 GROUP BY 1, 2""",
    "built_groups": _G + """, b AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n, k % 6 AS t, k % 6 IN (1, 3) AS told, CASE WHEN k % 4 > 0 THEN 0.75 ELSE 0.85 END AS es, CASE WHEN k % 6 IN (1, 2, 3) AND k % 5 > 0 THEN 0.5 ELSE 0.85 END AS cs, 'c' || event_id AS c, 'e' || event_id AS ev FROM gv)
        SELECT 'g001_' || lpad(CAST(n AS VARCHAR), 6, '0') || '_' || user_id AS probe_group_id, ['private_witness', 'vote_influence', 'delayed_public_reveal', 'claim_backed_hidden_event', 'route_hidden_event', 'hidden_event_awareness'][t + 1] AS template, CASE WHEN told THEN e + 62 ELSE e + 3 END AS cutoff_abs_sec,
            ['private_witness', 'trust_update', 'delayed_public_reveal', 'claim_truth_vs_claim_awareness', 'route_belief', 'hidden_event_awareness'][t + 1] AS query_type, ev AS anchor_event_ids, CASE WHEN told THEN c ELSE '' END AS related_claim_ids, CASE WHEN t = 2 THEN c ELSE '' END AS later_public_claim_ids, CASE WHEN t = 2 THEN s + 60 END AS reveal_start_sec,
            CASE WHEN t = 0 THEN '' ELSE ev END AS hidden_event_ids_for_target, CASE WHEN t = 0 THEN ev WHEN told THEN c ELSE '' END AS available_evidence_ids_for_target,
            'false_belief,representational_change' || CASE t WHEN 0 THEN ',perspective_taking,private_witness' WHEN 1 THEN ',claim_verification,perspective_taking,strategy_communication' WHEN 2 THEN ',delayed_public_reveal' WHEN 3 THEN ',claim_verification,perspective_taking' ELSE '' END AS diagnostic_families,
            CAST(CASE WHEN t = 1 THEN cs WHEN k % 2 = 0 THEN 0.8 WHEN told THEN 0.65 ELSE 0.6 END AS DOUBLE) AS claim_truth_confidence, CAST(CASE WHEN told THEN least(es, cs) ELSE es END AS DOUBLE) AS timestamp_confidence FROM b""",
    "static_review": _G + """, i AS (SELECT 't' || event_id AS trial_id, k FROM gv WHERE k % 7 > 0 OR k % 5 > 0 OR k % 3 > 0), x AS (SELECT trial_id, k, CASE WHEN k % 5 > 0 THEN CASE k % 3 WHEN 0 THEN ['a0', 'a1'] WHEN 1 THEN ['a1'] ELSE ['a1', 'a2'] END ELSE [] END AS a, CASE WHEN k % 3 = 1 THEN ['b1'] WHEN k % 3 = 2 THEN ['b1', 'b2'] ELSE [] END AS b FROM i)
        SELECT trial_id, array_to_string(list_concat(a, b), ',') AS evidence, k % 7 > 0 AND k % 5 > 0 AND k % 3 > 0 AS complete FROM x""",
    "promoted_groups": _G + """, z AS (SELECT event_id AS probe_group_id, k % 3 > 0 AS promoted FROM gv WHERE k % 3 = 0 OR ((k % 2 = 0 OR k % 5 = 0) AND k % 4 < 3 AND k % 7 > 0)) SELECT probe_group_id, promoted, promoted AS kept FROM z""",
    "decided_rows": _G + """ SELECT 't' || event_id AS trial_id, CASE WHEN k % 4 = 2 THEN 'repair' ELSE 'accept' END AS decision, CASE WHEN k % 4 = 2 THEN CASE WHEN k % 3 > 0 AND k % 5 > 0 THEN 'f' || k END WHEN k % 9 > 0 THEN 'v' || k END AS value,
        CASE WHEN k % 4 = 2 THEN CASE WHEN k % 3 = 0 THEN 'no_final_value' WHEN k % 5 = 0 THEN 'changed_trial_id' END WHEN k % 9 = 0 THEN 'accepted_without_candidate' END AS issue FROM gv WHERE k % 4 <> 1""",
    "phase_tasks": _G + """, a AS (SELECT game_id || '_' || CAST(floor(s / 86400) AS BIGINT) AS phase_id, list(DISTINCT CAST(user_id % 6 AS VARCHAR) ORDER BY CAST(user_id % 6 AS VARCHAR)) AS l FROM gv GROUP BY 1), b AS (SELECT *, CASE WHEN list_contains(l, '4') THEN '4' WHEN list_contains(l, '1') THEN '1' ELSE l[1] END AS p FROM a)
        SELECT phase_id, p AS primary_player, array_to_string(list_filter(l, lambda x: x <> p), ',') AS context_players FROM b""",
    "filled_annotations": _G + """ SELECT g.event_id AS phase_id, r.player_id, CASE WHEN g.k % 2 = 0 AND r.player_id = g.user_id THEN 'seen' ELSE 'missing_annotation' END AS status, CASE WHEN g.k % 2 = 0 AND r.player_id = g.user_id THEN g.k ELSE 0 END AS n_items, NOT (g.k % 2 = 0 AND r.player_id = g.user_id) AS missing FROM gv g JOIN roster r ON r.game_id = g.game_id WHERE g.event_type = 'signup'""",
    "meeting_windows": _G + """, t AS (SELECT event_id, s, s + 1 + event_id % 200 AS stop FROM gv), n AS (SELECT *, unnest(range(0, greatest(CAST(ceil((stop - s - 5) / 55) AS BIGINT), 1))) AS window_no FROM t), w AS (SELECT event_id, window_no, s + window_no * 55 AS start_sec, least(stop, s + window_no * 55 + 60) AS end_sec FROM n) SELECT * FROM w WHERE end_sec - start_sec >= 2""",
    "audio_queue": _G + """ SELECT row_number() OVER (ORDER BY s, event_id) - 1 AS queue_index, event_id, ['needs_audio', 'accept', 'needs_review'][k % 3 + 1] AS decision FROM gv WHERE k % 3 <> 1""",
}
