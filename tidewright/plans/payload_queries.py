"""Queries that normalise payloads made of the `events` table, each with a DuckDB twin.

A segment is a day of a game of six neighbouring users. Payload fields come and go, change type and break with `k`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import payload
from tidewright.plans import normalise
from tidewright.plans.event_queries import EV, games

PLAYERS = ("mojiang", "beigang", "xiaolu", "saoyi", "baile", "Gemini")
ALIASES = {"末将": "mojiang", "墨将": "mojiang", "北刚": "beigang"}
def NAMES() -> Column:  # noqa: N802
    return F.array(*[F.lit(p) for p in PLAYERS])


def _rows(spark: SparkSession, sf_dir: str, **fields: Column) -> DataFrame:
    """Events with their payload (`item`, null fields left out), segment, clip and place."""
    ev = games(spark, sf_dir).withColumn("day", F.floor(F.col("s") / 86400).cast("double"))
    seat = F.element_at(NAMES(), (F.col("user_id") % 6 + 1).cast("int"))
    segment = F.struct(F.lit("d").alias("dataset"), F.col("game_id"), F.format_string("g%d_%d", "game_id", F.col("day").cast("int")).alias("segment_id"), (F.col("day") * 86400).alias("aligned_start_sec"), ((F.col("day") + 1) * 86400).alias("aligned_end_sec"), F.array(F.lit("saoyi"), F.lit("baile")).alias("povs"))
    clip = F.struct(F.format_string("c%d", "event_id").alias("clip_id"), F.col("game_id"), seat.alias("player_id"), F.lit("ep").alias("episode_id"), F.lit(1).alias("phase_index"), F.lit("gameplay").alias("phase_type"), F.format_string("src%d", "event_id").alias("source_clip_id"), F.col("s").alias("start_sec"), F.col("e").alias("end_sec"))
    item = F.parse_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return ev.select("event_id", "event_type", "k", "s", "e", segment.alias("segment"), clip.alias("clip"), seat.alias("pov"), seat.alias("target"), (F.col("event_id") % 1000).cast("int").alias("index"), item.alias("item"))


def K() -> Column:  # noqa: N802
    return F.col("k")


def S() -> Column:  # noqa: N802
    return F.col("s")


def E() -> Column:  # noqa: N802
    return F.col("e")


def _pick(*values: str | None) -> Column:
    """The value at k % n; null leaves the field out."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (K() % len(values) + 1).cast("int"))


def _window() -> dict[str, Column]:
    """Absolute times for even k, local ones for odd; an end before the start where k % 11 = 0."""
    start = F.col("day") * 86400
    end = F.when(K() % 11 == 0, S() - 1).otherwise(F.least(E(), start + 86400))
    return {"local_start_sec": F.when(K() % 2 == 0, S()).otherwise(S() - start), "local_end_sec": F.when(K() % 2 == 0, end).otherwise(end - start)}


def _lists() -> dict[str, Column]:
    return {"visible_players": F.when(K() % 3 == 0, F.array(F.lit("墨将"), F.lit("mojiang"), F.lit("nobody"), F.lit("xiaolu"))), "mentioned_players": F.when(K() % 4 == 0, F.array(F.lit("baile")))}


def pov_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, **_window(), actor=_pick("末将", "beigang", "unknown", "nobody", None), speaker=_pick("北刚", None, ""), location=_pick("", "room", None), event_id=F.when(K() % 7 == 0, F.lit("given")), **_lists())
    out = normalise.pov_events(rows, NAMES(), ALIASES)
    return out.select(F.col("clip.clip_id").alias("row_id"), "event_id", "actor", "speaker", "location", F.array_join("visible_players", ",").alias("visible"), F.array_join("mentioned_players", ",").alias("mentioned"), "local_start_sec", "local_end_sec", "abs_start_sec", "abs_end_sec", "time_ok", "dataset", F.array_join("source_pov", ",").alias("source_pov"))


def utterance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.struct(F.when(K() % 6 == 0, F.lit("own")).alias("claim_id"), _pick("墨将", None).alias("speaker"), F.lit("sighting").alias("claim_type"), F.concat(F.lit("said\n"), K()).alias("content"), F.when(K() % 4 == 0, F.lit("2.5")).alias("certainty"), F.array(F.lit("beigang"), F.lit("x")).alias("subject_players"))
    rows = _rows(spark, sf_dir, **_window(), text=F.when(K() % 3 != 0, F.concat(F.lit("t"), K())), transcript=F.when(K() % 3 != 1, F.concat(F.lit("tr"), K())), speaker=_pick("xiaolu", "who", None), certainty=F.when(K() % 5 == 0, F.lit(0.4)), claims=F.when(K() % 2 == 0, F.array(claim)), evidence=F.when(K() % 8 == 0, F.lit("seen")))
    out = normalise.utterances(rows, NAMES(), ALIASES)
    c = lambda f: F.get("claims", 0)[f].alias(f"claim_{f}")
    return out.select(F.col("clip.clip_id").alias("row_id"), "utterance_id", "text", "transcript", "speaker", "speaker_confidence", "needs_human_review", "is_speech_claim", F.size("claims").cast("bigint").alias("n_claims"), c("claim_id"), c("speaker"), c("content"), c("evidence"), c("certainty"), F.array_join(F.get("claims", 0)["subject_players"], ",").alias("claim_subjects"))


def global_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, **_window(), source_povs=F.when(K() % 3 == 0, F.array(F.lit("北刚"), F.lit("baile"))), source_pov=F.when(K() % 3 == 1, F.lit("xiaolu")), actors=F.when(K() % 4 != 0, F.array(F.lit("saoyi"))), involved_players=F.when(K() % 4 < 2, F.array(F.lit("Gemini"))), description=_pick("a\nb ", "", None), certainty=_pick("0.9", "x", "7", None), supporting_pov_event_ids=F.when(K() % 2 == 0, F.array(*[F.lit(f"e{i % 5}") for i in range(9)])), heard_by=F.array(F.lit("baile"), F.lit("baile")), conflict=F.when(K() % 9 == 0, F.lit(True)))
    out = normalise.global_events(rows, NAMES(), ALIASES)
    j = lambda n: F.array_join(n, ",").alias(n)
    return out.select(F.col("clip.clip_id").alias("row_id"), "global_event_id", "target_player", j("source_pov"), j("actors"), j("involved_players"), j("heard_by"), j("supporting_pov_event_ids"), "description", "certainty", "conflict", "is_direct_observation", "needs_human_review", "abs_start_sec")


def candidate_trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, trial_id=F.when(K() % 3 == 0, F.concat(F.format_string("g%d_%d", "game_id", F.col("day").cast("int")), F.lit("_own"))).when(K() % 3 == 1, F.lit("own")), question_type=_pick("belief_state", "false_belief", "odd", None), target_player=_pick("墨将", "nobody", None), question=F.concat(F.lit("what of "), _pick("baile", "them")), answer=_pick(None, "yes"), cutoff_abs_sec=F.when(K() % 5 == 0, S()).when(K() % 5 == 1, F.lit(-3.0)), source_pov=F.when(K() % 2 == 0, F.lit("xiaolu")), evidence=_pick("e", "", None, "f"), certainty=F.when(K() % 6 == 0, F.lit(0.25)), risk_of_perspective_leakage=_pick("high", "none", None), distractors=F.array(*[F.lit(x) for x in ("a", "b", "a", "c", "d")]))
    out = normalise.candidate_trials(rows, NAMES(), ALIASES)
    return out.select(F.col("clip.clip_id").alias("row_id"), "trial_id", "question_type", "trial_type", "target_player", "cutoff_abs_sec", "question", "answer", F.array_join("source_pov", ",").alias("source_pov"), "evidence", "certainty", "risk_of_perspective_leakage", "needs_human_review", F.array_join("distractors", ",").alias("distractors"))


def phase_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, **_window(), phase_type=_pick("voting", "odd", None, "exile"), source_pov=F.when(K() % 2 == 0, F.lit("墨将")), evidence_povs=F.when(K() % 3 == 0, F.array(F.lit("baile"), F.lit("x"))), visible_to_all=F.when(K() % 5 == 0, F.lit(True)), target_player=_pick("baile", None))
    out = normalise.phase_events(rows, NAMES(), ALIASES)
    return out.select(F.col("clip.clip_id").alias("row_id"), "phase_event_id", "phase_type", "target_player", "visible_to_all", F.array_join("evidence_povs", ",").alias("evidence_povs"), "needs_human_review", "time_ok")


def clip_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, start_sec=F.when(K() % 5 == 0, S() + 5).when(K() % 5 == 1, S() - 9).when(K() % 5 == 2, E() + 3), end_sec=F.when(K() % 5 == 0, S() + 5).when(K() % 5 == 3, F.lit(1e12)), location=_pick("hall", None), visible_players=F.when(K() % 3 == 0, F.array(F.lit("a"), F.lit("b"))), confidence=_pick("High ", "中", "odd", None), public_ui=F.when(K() % 4 == 0, F.lit(True)))
    out = normalise.clip_events(rows)
    return out.select("clip_id", "player_id", "start_sec", "end_sec", "event_type", "description", "location", F.array_join("visible_players", ",").alias("visible"), "confidence", "public_ui", "meeting_public")


def round_boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, aligned_start_sec=F.when(K() % 4 == 0, S() + 3).when(K() % 4 == 1, E() + 1).when(K() % 4 == 2, S() - 7), aligned_end_sec=F.when(K() % 4 == 0, S() + 3).when(K() % 4 == 2, S() + 11), boundary_type=_pick("game_start", None), confidence=_pick("低", None, "high"), source_povs=F.when(K() % 3 == 0, F.array(F.lit("baile"))))
    both = [normalise.round_boundaries(rows, own).select("clip_id", F.lit(own).alias("own_view"), "aligned_start_sec", "aligned_end_sec", "boundary_type", "confidence", F.array_join("source_povs", ",").alias("source_povs"), "needs_review") for own in (True, False)]
    return both[0].unionByName(both[1])


def sync_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, raw_start_sec=S(), confidence=_pick("高", None, "0.4"))
    rows = rows.withColumn("item", F.parse_json(F.when(K() % 3 == 0, F.concat(F.lit("["), F.to_json("item"), F.lit("]"))).when(K() % 3 == 1, F.to_json("item")).otherwise("7")))
    return normalise.sync_offsets(rows).select(F.col("clip.clip_id").alias("clip_id"), "ok", "raw_start_sec", "confidence")


def gameplay_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance flags, fallback events and leakage words of gameplay annotations."""
    rows = _rows(spark, sf_dir, event_type=_pick("VOTE", "task"), speech_claim=F.when(K() % 2 == 0, F.lit(True)), risk=_pick("高风险", "Medium", "低", "none", "", None, "odd"))
    out = normalise.source_flags(rows.withColumn("phase_type", _pick("meeting", "gameplay", "gameplay")), "phase_type", ("vote", "meeting"))
    return out.select(F.col("clip.clip_id").alias("clip_id"), "direct_visual_observation", "speech_claim", "public_result", "flags_added", normalise.leakage_risk(payload.string(F.col("item"), "risk")).alias("risk"))


def fallback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.struct(_pick("dead", "alive").alias("alive_state"), _pick("blood", None, "").alias("death_evidence"))
    memory = F.when(K() % 4 == 0, F.array(F.struct(_pick("m", None).alias("description"), F.lit("me").alias("evidence"))))
    rows = _rows(spark, sf_dir, gameplay_trace=F.when(K() % 5 == 0, F.array(F.lit(1))).when(K() % 5 == 1, F.array().cast("array<int>")), player_status=status, private_memory=memory)
    rows = rows.select("item", F.col("clip.clip_id").alias("clip_id"), F.col("pov").alias("player_id"), F.col("s").alias("aligned_start_sec"), (K() % 9).cast("double").alias("duration_sec"))
    return normalise.fallback_trace(rows).select("clip_id", "event_type", "actor", "abs_start_sec", "abs_end_sec", "description", "evidence", "certainty")


def information_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.struct(F.array(F.lit("f1"), F.lit("f2")).alias("known_facts"), F.lit("one").alias("beliefs"))
    rows = _rows(spark, sf_dir, available_information=F.when(K() % 3 == 0, held), known_facts=F.when(K() % 6 == 3, F.array(*[F.lit(f"k{i}") for i in range(7)])), unknowns=_pick("u", None), certainty=_pick("0.3", "2", "x", None), source_pov=_pick("baile", None), evidence=_pick("", "ev"), needs_human_review=F.when(K() % 10 == 0, F.lit(False)))
    out = normalise.information_states(rows)
    return out.select(F.col("clip.clip_id").alias("row_id"), "target_player", "cutoff_abs_sec", F.array_join("known_facts", ",").alias("known_facts"), F.array_join("beliefs", ",").alias("beliefs"), F.array_join("unknowns", ",").alias("unknowns"), F.array_join(F.transform("available_information", lambda x: F.concat_ws(":", x["type"], x["content"])), ",").alias("available"), "certainty", "evidence", F.array_join("source_pov", ",").alias("source_pov"), "needs_human_review")


def memory_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.when(K() % 4 == 0, F.lit("mm")).alias("memory_id"), _pick("Vote", "odd", "phase", None).alias("memory_type"), _pick("old", "bad", None).alias("decay_status"), _pick("PUBLIC", "x").alias("visibility"), F.when(K() % 5 == 0, S()).alias("first_observed_abs_sec"))
    delta = F.struct(F.array(F.lit("a1"), F.lit("a2")).alias("added"), F.when(K() % 3 == 0, F.lit("f1")).alias("forgotten"))
    rows = _rows(spark, sf_dir, memory_items=F.when(K() % 6 != 5, F.array(item, item)), memory_delta=F.when(K() % 2 == 0, delta))
    out = normalise.memory_states(rows)
    m = lambda f: F.array_join(F.transform("memory_items", lambda x: F.coalesce(x[f].cast("string"), F.lit("-"))), ",").alias(f)
    return out.select(F.col("clip.clip_id").alias("row_id"), *[m(f) for f in ("memory_id", "memory_type", "decay_status", "visibility", "needs_human_review")], F.get("memory_items", 0)["first_observed_abs_sec"].alias("first_seen"), F.array_join(F.transform("memory_delta", lambda x: F.concat_ws(":", x["operation"], x["memory_id"])), ",").alias("delta"))


def belief_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    belief = F.struct(_pick("baile", "x", None).alias("player"), F.lit("suspicion").alias("type"), F.concat(F.lit("beigang may "), K()).alias("content"), F.when(K() % 4 == 0, F.lit("0.9")).alias("confidence"))
    rows = _rows(spark, sf_dir, believes_or_suspects=F.when(K() % 2 == 0, F.array(belief)), forbidden_information=F.when(K() % 5 == 0, F.array(F.struct(F.lit("h9").alias("hidden_event_id")), F.struct(F.lit("").alias("hidden_event_id")))), certainty=F.when(K() % 3 == 0, F.lit(0.1)))
    events = rows.where("event_type = 'signup'").select(F.col("segment.game_id").alias("game_id"), F.col("clip.clip_id").alias("global_event_id"), F.array("pov").alias("visible_to"), F.when(K() % 2 == 0, NAMES()).alias("heard_by"))
    targets = rows.select(F.col("segment.game_id").alias("game_id"), F.col("target").alias("target_player")).distinct()
    out = normalise.belief_states(rows, NAMES(), normalise.forbidden_from_global(events, targets))
    b = lambda f: F.get("believes_or_suspects", 0)[f].alias(f"belief_{f}")
    return out.select(F.col("clip.clip_id").alias("row_id"), "target_player", b("player"), b("belief_type"), b("content"), b("confidence"), F.array_join("forbidden_event_ids", ",").alias("forbidden"), "certainty", "needs_human_review", "evidence")


def compact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, evidence=F.when(K() % 3 != 0, F.repeat(F.lit("x"), 95)), event_id=F.lit("e"), extra=F.lit("no"), supporting_utterance_ids=F.when(K() % 2 == 0, F.array(*[F.lit(f"u{i}") for i in range(8)])))
    j = normalise.compact_item(F.col("item"), {"event_id": 40, "evidence": 90, "description": 120}, {"supporting_utterance_ids": 6})
    return rows.select(F.col("clip.clip_id").alias("row_id"), F.length(F.get_json_object(j, "$.evidence")).cast("bigint").alias("evidence_length"), F.json_array_length(F.get_json_object(j, "$.supporting_utterance_ids")).cast("bigint").alias("n_ids"), F.array_join(F.json_object_keys(j), ",").alias("keys"))


def phase_annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, player_status=F.when(K() % 3 == 0, F.struct(F.lit("dead").alias("alive_state"), S().alias("death_abs_sec"))), role_and_goal=F.when(K() % 4 == 0, F.struct(F.lit("goose").alias("role"))), gameplay_trace=F.when(K() % 2 == 0, F.array(F.lit(1), F.lit(2))), needs_human_review=F.when(K() % 5 == 0, F.lit(True)))
    phase = F.struct(F.col("clip.game_id").alias("game_id"), F.col("clip.clip_id").alias("phase_id"), F.lit("gameplay").alias("phase_type"), F.col("s").alias("aligned_start_sec"), F.col("e").alias("aligned_end_sec"))
    out = normalise.phase_annotations(rows.withColumn("phase", phase))
    return out.select("phase_id", "player_id", "duration_sec", F.col("player_status.alive_state").alias("alive_state"), F.col("player_status.death_abs_sec").alias("death_abs_sec"), F.col("role_and_goal.role").alias("role"), F.col("role_and_goal.faction").alias("faction"), F.col("n_gameplay_trace").cast("bigint").alias("n_trace"), F.col("n_utterances").cast("bigint").alias("n_utterances"), "needs_human_review")


def phase_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("day") * 86400
    fields = {"local_start_sec": F.when(K() % 4 == 0, S()).when(K() % 4 == 1, S() - start).when(K() % 4 == 2, F.lit(86400.0)), "local_end_sec": F.when(K() % 4 == 0, F.least(E(), start + 86400)).when(K() % 4 == 1, S() - start - 5)}
    rows = _rows(spark, sf_dir, **fields, phase_type=_pick("meeting", "odd", None), visible_players=F.when(K() % 2 == 0, F.array(F.lit("baile"), F.lit("x"))), confidence=_pick("0.9", "0.5", "0", None), location=_pick("", "hall"), public_result=F.when(K() % 3 == 0, F.lit(True)))
    out = normalise.phase_windows(rows, NAMES())
    return out.select(F.col("clip.clip_id").alias("row_id"), "window_event_id", "local_start_sec", "local_end_sec", "abs_start_sec", "phase_type", F.array_join("visible_players", ",").alias("visible"), "confidence", "location", "public_result", "needs_human_review")


def _clip_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = games(spark, sf_dir)
    return ev.select("game_id", "event_id", F.col("user_id").alias("player_id"), F.format_string("c%d", "event_id").alias("clip_id"), F.col("s").alias("start_sec"), F.col("e").alias("end_sec"), "event_type", F.concat(_pick("会议开始", "he moved", "有人说话", "task"), F.lit(" "), K()).alias("description"), F.when(K() % 3 == 0, F.array(F.col("user_id") + 1, F.col("user_id"))).alias("visible_players"), F.array(F.col("user_id") + 1).alias("mentioned_players"), F.when(K() % 7 != 0, F.floor("value") / 1024).alias("confidence"))


def meeting_utterance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.meeting_utterances(_clip_table(spark, sf_dir)).select("clip_id", "speaker_id", "text", "speech_act", "confidence", F.array_join("mentioned_players", ",").alias("mentioned"))


def global_fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clip_table(spark, sf_dir).withColumns({c: F.transform(c, lambda x: x.cast("string")) for c in ("visible_players", "mentioned_players")}).withColumn("player_id", F.col("player_id").cast("string"))
    out = normalise.global_fold(rows, ["start_sec", "event_id"])
    return out.select("global_event_id", F.get("source_clip_ids", 0).alias("clip_id"), F.array_join("involved_players", ",").alias("involved"), F.array_join("source_player_ids", ",").alias("sources"), "confidence")


def cutoff_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.cutoff_stamp(_rows(spark, sf_dir, x=K())).select(F.col("clip.clip_id").alias("row_id"), "dataset", "game_id", "segment_id", "target_player", "cutoff_abs_sec")


QUERIES = {f.__name__: f for f in (
    pov_event_rows, utterance_rows, global_event_rows, candidate_trial_rows, phase_event_rows, clip_event_rows, round_boundary_rows, sync_rows, gameplay_flags, fallback_events, information_state_rows, memory_state_rows,
    belief_state_rows, compact_items, phase_annotation_rows, phase_window_rows, meeting_utterance_rows, global_fold_rows, cutoff_stamps,
)}

_SEAT = "['mojiang', 'beigang', 'xiaolu', 'saoyi', 'baile', 'Gemini'][user_id % 6 + 1]"
_P = f"""WITH {EV}, p AS (SELECT *, user_id // 6 AS game_id, floor(s / 86400) * 86400 AS d0, 'c' || event_id AS row_id, 'g' || (user_id // 6) || '_' || CAST(floor(s / 86400) AS INT) AS seg, {_SEAT} AS seat, lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS idx FROM ev),
    t AS (SELECT *, s - d0 AS ls, CASE WHEN k % 11 = 0 THEN s - 1 ELSE least(e, d0 + 86400) END - d0 AS le FROM p),
    w AS (SELECT *, CASE WHEN k % 2 = 0 AND s > 86400 THEN ls WHEN k % 2 = 0 THEN s ELSE ls END AS l0 FROM t),
    v AS (SELECT *, k % 2 = 0 AND d0 + ls >= d0 AND d0 + le <= d0 + 86400.000001 AND (d0 + ls > 86400 OR d0 + le > 86400) AS conv FROM t),
    x AS (SELECT *, CASE WHEN k % 2 = 0 AND NOT conv THEN d0 + ls ELSE ls END AS a, CASE WHEN k % 2 = 0 AND NOT conv THEN d0 + le ELSE le END AS b FROM v),
    y AS (SELECT *, a AS local_start_sec, CASE WHEN b <= a THEN least(86400.0, a + 1) ELSE b END AS local_end_sec FROM x),
    z AS (SELECT *, d0 + local_start_sec AS abs_start_sec, d0 + local_end_sec AS abs_end_sec, local_start_sec >= 0 AND local_end_sec > local_start_sec AND local_end_sec <= 86400.000001 AS time_ok FROM y)"""

ORACLE_SQL = {
    "pov_event_rows": _P + """ SELECT row_id, CASE WHEN k % 7 = 0 THEN 'given' ELSE seg || '_' || seat || '_event_' || idx END AS event_id, CASE k % 5 WHEN 0 THEN 'mojiang' WHEN 1 THEN 'beigang' ELSE seat END AS actor,
        CASE WHEN k % 3 = 0 THEN 'beigang' END AS speaker, CASE WHEN k % 3 = 1 THEN 'room' ELSE 'unknown' END AS location, CASE WHEN k % 3 = 0 THEN 'mojiang,xiaolu' ELSE '' END AS visible, CASE WHEN k % 4 = 0 THEN 'baile' ELSE '' END AS mentioned,
        local_start_sec, local_end_sec, abs_start_sec, abs_end_sec, time_ok, 'd' AS dataset, seat AS source_pov FROM z""",
    "utterance_rows": _P + """, u AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 't' || k ELSE 'tr' || k END AS text, CASE WHEN k % 3 <> 1 THEN 'tr' || k ELSE 't' || k END AS transcript, CASE WHEN k % 3 = 0 THEN 'xiaolu' ELSE 'unknown' END AS speaker, seg || '_' || seat || '_utt_' || idx AS utterance_id FROM z)
        SELECT row_id, utterance_id, text, transcript, speaker, CASE WHEN k % 5 = 0 THEN 0.4 ELSE 0.0 END AS speaker_confidence, speaker = 'unknown' AS needs_human_review, true AS is_speech_claim, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_claims,
        CASE WHEN k % 2 = 0 THEN CASE WHEN k % 6 = 0 THEN 'own' ELSE utterance_id || '_claim_001' END END AS claim_claim_id, CASE WHEN k % 2 = 0 THEN 'mojiang' END AS claim_speaker, CASE WHEN k % 2 = 0 THEN 'said ' || k END AS claim_content,
        CASE WHEN k % 8 = 0 THEN 'seen' WHEN k % 2 = 0 THEN 'unknown' END AS claim_evidence, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 1.0 WHEN k % 5 = 0 THEN 0.4 ELSE 0.5 END END AS claim_certainty, CASE WHEN k % 2 = 0 THEN 'beigang' END AS claim_subjects FROM u""",
    "global_event_rows": _P + """ SELECT row_id, seg || '_ge_' || idx AS global_event_id, 'global' AS target_player, CASE k % 3 WHEN 0 THEN 'beigang,baile' WHEN 1 THEN 'xiaolu' ELSE 'saoyi' END AS source_pov,
        CASE WHEN k % 4 <> 0 THEN 'saoyi' ELSE 'Gemini' END AS actors, CASE WHEN k % 4 < 2 THEN 'Gemini' ELSE 'saoyi' END AS involved_players, 'baile' AS heard_by, CASE WHEN k % 2 = 0 THEN 'e0,e1,e2,e3,e4' ELSE '' END AS supporting_pov_event_ids,
        CASE WHEN k % 3 = 0 THEN 'a b' ELSE 'unknown' END AS description, CAST([0.9, 0.5, 1.0, 0.5][k % 4 + 1] AS DOUBLE) AS certainty, k % 9 = 0 AS conflict, true AS is_direct_observation, k % 3 = 2 AS needs_human_review, abs_start_sec FROM z""",
    "candidate_trial_rows": _P + """, q AS (SELECT *, ['first_order_belief', 'false_belief', 'first_order_belief', 'first_order_belief'][k % 4 + 1] AS qt, k % 4 >= 2 OR k % 2 = 1 OR k % 4 IN (1, 2) AS review, 'what of ' || CASE WHEN k % 2 = 0 THEN 'baile' ELSE 'them' END AS question FROM p)
        SELECT row_id, CASE k % 3 WHEN 0 THEN seg || '_own' WHEN 1 THEN seg || '_own' ELSE seg || '_trial_' || idx END AS trial_id, qt AS question_type, CASE WHEN k % 4 = 0 THEN 'belief_state' ELSE qt END AS trial_type,
        CASE WHEN k % 3 = 0 THEN 'mojiang' WHEN k % 2 = 0 THEN 'baile' ELSE 'saoyi' END AS target_player, CASE WHEN k % 5 = 0 THEN s ELSE d0 + 86400 END AS cutoff_abs_sec, question, CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'yes' END AS answer,
        CASE WHEN k % 2 = 0 THEN 'xiaolu' ELSE 'saoyi,baile' END AS source_pov, ['e', 'unknown', 'unknown', 'f'][k % 4 + 1] AS evidence, CAST(CASE WHEN k % 6 = 0 THEN 0.25 WHEN review THEN 0.5 ELSE 0.7 END AS DOUBLE) AS certainty, CASE WHEN k % 3 = 0 THEN 'high' WHEN review THEN 'medium' ELSE 'low' END AS risk_of_perspective_leakage, review AS needs_human_review, 'a,b,c' AS distractors FROM q""",
    "phase_event_rows": _P + """ SELECT row_id, seg || '_phase_' || idx AS phase_event_id, ['voting', 'unknown', 'unknown', 'exile'][k % 4 + 1] AS phase_type, CASE WHEN k % 2 = 0 THEN 'baile' ELSE 'global' END AS target_player, k % 5 = 0 AS visible_to_all,
        CASE WHEN k % 3 = 0 THEN 'baile' WHEN k % 2 = 0 THEN 'mojiang' ELSE '' END AS evidence_povs, k % 4 IN (1, 2) AS needs_human_review, time_ok FROM z""",
    "clip_event_rows": _P + """ SELECT row_id AS clip_id, seat AS player_id, CASE k % 5 WHEN 0 THEN s + 5 ELSE s END AS start_sec, CASE k % 5 WHEN 0 THEN s + 6 ELSE e END AS end_sec, 'observation' AS event_type, '' AS description, CASE WHEN k % 2 = 0 THEN 'hall' END AS location,
        CASE WHEN k % 3 = 0 THEN 'a,b' ELSE '' END AS visible, CAST([0.9, 0.6, 0.0, 0.0][k % 4 + 1] AS DOUBLE) AS confidence, k % 4 = 0 AS public_ui, false AS meeting_public FROM p""",
    "round_boundary_rows": _P + """, o AS (SELECT *, unnest([true, false]) AS own_view FROM p)
        SELECT row_id AS clip_id, own_view, CASE k % 4 WHEN 0 THEN s + 3 WHEN 1 THEN CASE WHEN own_view THEN greatest(s, e - 1) ELSE e END ELSE s END AS aligned_start_sec, CASE k % 4 WHEN 0 THEN s + 4 WHEN 2 THEN s + 11 ELSE e END AS aligned_end_sec,
        CASE WHEN k % 2 = 0 THEN 'game_start' ELSE 'uncertain_boundary' END AS boundary_type, CASE WHEN own_view THEN CAST([0.3, 0.0, 0.9][k % 3 + 1] AS DOUBLE) ELSE 0.0 END AS confidence,
        CASE WHEN k % 3 = 0 THEN CASE WHEN own_view AND seat <> 'baile' THEN 'baile,' || seat ELSE 'baile' END ELSE seat END AS source_povs, k % 4 < 2 AS needs_review FROM o""",
    "sync_rows": _P + " SELECT row_id AS clip_id, k % 3 < 2 AS ok, CASE WHEN k % 3 < 2 THEN s END AS raw_start_sec, CASE WHEN k % 3 = 0 THEN 0.9 ELSE 0.0 END AS confidence FROM p",
    "gameplay_flags": _P + """ SELECT row_id AS clip_id, true AS direct_visual_observation, k % 2 = 0 AS speech_claim, k % 3 = 0 OR k % 2 = 0 AS public_result, true AS flags_added, ['high', 'medium', 'low', 'low', 'unknown', 'unknown', 'odd'][k % 7 + 1] AS risk FROM p""",
    "fallback_events": _P + """, f AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'blood' WHEN k % 4 = 0 THEN 'me' ELSE 'empty gameplay trace; the status event requires review' END AS evidence FROM p WHERE k % 5 <> 0)
        SELECT row_id AS clip_id, CASE WHEN k % 2 = 0 THEN 'spectator_or_status_observation' ELSE 'visible_gameplay_status' END AS event_type, seat AS actor, s AS abs_start_sec, s + least(k % 9, 5) AS abs_end_sec, CASE WHEN k % 4 = 0 THEN 'm' ELSE evidence END AS description, evidence, 0.45 AS certainty FROM f""",
    "information_state_rows": _P + """, i AS (SELECT *, CAST([0.3, 1.0, 0.5, 0.5][k % 4 + 1] AS DOUBLE) AS certainty FROM p)
        SELECT row_id, seat AS target_player, d0 + 86400 AS cutoff_abs_sec, CASE WHEN k % 6 = 3 THEN 'k0,k1,k2,k3,k4' WHEN k % 3 = 0 THEN 'f1,f2' ELSE '' END AS known_facts, CASE WHEN k % 3 = 0 THEN 'one' ELSE '' END AS beliefs, CASE WHEN k % 2 = 0 THEN 'u' ELSE '' END AS unknowns,
        CASE WHEN k % 3 = 0 THEN 'beliefs:one,known_facts:f1,known_facts:f2' ELSE '' END AS available, certainty, CASE WHEN k % 2 = 0 THEN '有限视角投影摘要' ELSE 'ev' END AS evidence, CASE WHEN k % 2 = 0 AND seat = 'baile' THEN 'baile' ELSE seat END AS source_pov, CASE WHEN k % 10 = 0 THEN false ELSE certainty < 0.5 END AS needs_human_review FROM i""",
    "memory_state_rows": _P + """, m AS (SELECT *, ['public_result', 'inferred', 'phase', 'inferred'][k % 4 + 1] AS mt, ['stale', 'active', 'active'][k % 3 + 1] AS ds, CASE WHEN k % 2 = 0 THEN 'public' ELSE 'private' END AS vis, CAST(k % 4 = 1 OR k % 3 = 1 AS VARCHAR) AS rv FROM p)
        SELECT row_id, CASE WHEN k % 6 = 5 THEN '' WHEN k % 4 = 0 THEN 'mm,mm' ELSE seg || '_' || seat || '_memory_001,' || seg || '_' || seat || '_memory_002' END AS memory_id, CASE WHEN k % 6 = 5 THEN '' ELSE mt || ',' || mt END AS memory_type, CASE WHEN k % 6 = 5 THEN '' ELSE ds || ',' || ds END AS decay_status,
        CASE WHEN k % 6 = 5 THEN '' ELSE vis || ',' || vis END AS visibility, CASE WHEN k % 6 = 5 THEN '' ELSE rv || ',' || rv END AS needs_human_review, CASE WHEN k % 6 = 5 THEN NULL WHEN k % 5 = 0 THEN s ELSE d0 END AS first_seen, CASE WHEN k % 2 = 1 THEN '' WHEN k % 3 = 0 THEN 'add:a1,add:a2,forget_low_confidence:f1' ELSE 'add:a1,add:a2' END AS delta FROM m""",
    "belief_state_rows": _P + """, g AS (SELECT game_id, row_id AS gid, seat AS vis, k % 2 = 0 AS heard FROM p WHERE event_type = 'signup'), tg AS (SELECT DISTINCT game_id, seat FROM p),
        h AS (SELECT tg.game_id, tg.seat, string_agg(gid, ',' ORDER BY gid) AS hidden FROM tg JOIN g ON g.game_id = tg.game_id AND vis <> tg.seat AND NOT heard GROUP BY ALL)
        SELECT row_id, p.seat AS target_player, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'baile' ELSE 'beigang' END END AS belief_player, CASE WHEN k % 2 = 0 THEN 'suspicion' END AS belief_belief_type, CASE WHEN k % 2 = 0 THEN 'beigang may ' || k END AS belief_content,
        CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 0.9 ELSE 0.5 END END AS belief_confidence, CASE WHEN k % 5 = 0 THEN 'h9,hidden_002' ELSE coalesce(hidden, '') END AS forbidden, CASE WHEN k % 3 = 0 THEN 0.1 ELSE 0.5 END AS certainty, k % 3 = 0 AS needs_human_review, 'belief state normalized from finite-view inputs' AS evidence
        FROM p LEFT JOIN h ON h.game_id = p.game_id AND h.seat = p.seat""",
    "compact_items": _P + """ SELECT row_id, CASE WHEN k % 3 <> 0 THEN 90 END AS evidence_length, CASE WHEN k % 2 = 0 THEN 6 END AS n_ids, 'event_id' || CASE WHEN k % 3 <> 0 THEN ',evidence' ELSE '' END || CASE WHEN k % 2 = 0 THEN ',supporting_utterance_ids' ELSE '' END AS keys FROM p""",
    "phase_annotation_rows": _P + """ SELECT row_id AS phase_id, seat AS player_id, e - s AS duration_sec, CASE WHEN k % 3 = 0 THEN 'dead' ELSE 'unknown' END AS alive_state, CASE WHEN k % 3 = 0 THEN s END AS death_abs_sec, CASE WHEN k % 4 = 0 THEN 'goose' ELSE 'unknown' END AS role, 'unknown' AS faction,
        CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS n_trace, 0 AS n_utterances, k % 5 = 0 AS needs_human_review FROM p""",
    "phase_window_rows": _P + """, r AS (SELECT *, CASE k % 4 WHEN 0 THEN s WHEN 1 THEN s - d0 WHEN 2 THEN 86400.0 ELSE 0.0 END AS rs, CASE k % 4 WHEN 0 THEN least(e, d0 + 86400) WHEN 1 THEN s - d0 - 5 WHEN 2 THEN 86400.0 ELSE 1.0 END AS re FROM p),
        c AS (SELECT *, rs BETWEEN d0 AND d0 + 86400 AND re BETWEEN d0 AND d0 + 86400 AND re > 86400 AS ab FROM r),
        n AS (SELECT *, greatest(0.0, least(86400.0, rs - CASE WHEN ab THEN d0 ELSE 0 END)) AS a, greatest(0.0, least(86400.0, re - CASE WHEN ab THEN d0 ELSE 0 END)) AS b FROM c),
        o AS (SELECT *, CASE WHEN b <= a THEN least(86400.0, a + 1) ELSE b END AS x FROM n), f AS (SELECT *, CASE WHEN x <= a THEN greatest(0.0, x - 1) ELSE a END AS st, CAST([0.9, 0.5, 0.5, 0.5][k % 4 + 1] AS DOUBLE) AS confidence, CASE WHEN k % 3 = 0 THEN 'meeting' ELSE 'unknown' END AS phase_type FROM o)
        SELECT row_id, seg || '_' || seat || '_phasewin_' || idx AS window_event_id, st AS local_start_sec, x AS local_end_sec, d0 + st AS abs_start_sec, phase_type, CASE WHEN k % 2 = 0 THEN 'baile' ELSE '' END AS visible, confidence, CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'hall' END AS location, k % 3 = 0 AS public_result, phase_type = 'unknown' OR confidence < 0.55 AS needs_human_review FROM f""",
    "meeting_utterance_rows": _P + """ SELECT row_id AS clip_id, user_id AS speaker_id, CASE WHEN k % 4 = 0 THEN '会议开始 ' ELSE '有人说话 ' END || k AS text, event_type AS speech_act, CASE WHEN k % 7 <> 0 THEN floor(value) / 1024 ELSE 0.0 END AS confidence, CAST(user_id + 1 AS VARCHAR) AS mentioned FROM p WHERE k % 2 = 0""",
    "global_fold_rows": _P + """ SELECT printf('ge_%06d', row_number() OVER (ORDER BY s, event_id)) AS global_event_id, row_id AS clip_id, CASE WHEN k % 3 = 0 THEN least(CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR)) || ',' || greatest(CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR)) ELSE CAST(user_id + 1 AS VARCHAR) END AS involved,
        CAST(user_id AS VARCHAR) AS sources, CASE WHEN k % 7 <> 0 THEN floor(value) / 1024 ELSE 0.0 END AS confidence FROM p""",
    "cutoff_stamps": _P + " SELECT row_id, 'd' AS dataset, game_id, seg AS segment_id, seat AS target_player, d0 + 86400 AS cutoff_abs_sec FROM p",
}

#: Columns whose literals DuckDB would take for narrower types.
for _name, _types in {
    "utterance_rows": {"speaker_confidence": "DOUBLE", "n_claims": "BIGINT", "claim_certainty": "DOUBLE"},
    "sync_rows": {"confidence": "DOUBLE"},
    "fallback_events": {"certainty": "DOUBLE"},
    "belief_state_rows": {"belief_confidence": "DOUBLE", "certainty": "DOUBLE"},
    "compact_items": {"evidence_length": "BIGINT", "n_ids": "BIGINT"},
    "phase_annotation_rows": {"n_trace": "BIGINT", "n_utterances": "BIGINT"},
}.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _types.items())
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE_SQL[_name]}) AS q"
