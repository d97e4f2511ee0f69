"""The evidence ledger: annotations to candidate events and claims, to merged ones, to visibility, truth links, snapshots
and probe groups. Every step takes and returns DataFrames; players are a dimension table, never a constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import numbers, text
from tidewright.operators import folds, joins, selection
from tidewright.scratch import staged

# Words that matter when a claim is held against events.
ACTION_TOKENS = ("杀", "刀", "尸体", "投", "右", "左", "上", "下", "任务")
DENIAL_TOKENS = ("没有", "没去", "不是", "一直")
RECENT_TOKENS = ("刚", "刚才", "上一轮")
PUBLIC_PHASES = ("meeting", "final")
NOT_PROBED = ("discussion", "meeting", "phase_transition", "gameplay_phase_transition", "scene_transition", "transition", "voting", "vote", "vote_result", "voting_result", "result", "game_result", "game_over", "game_start", "gameplay_start", "task", "task_completion", "unknown")
PROBED_CLAIMS = ("location", "defense", "accusation", "sighting")
IDLE_TALK = ("没用", "没有什么作用", "开玩笑", "哈哈")
SEEDED_TYPES = ("body_report", "encounter", "interaction", "kill", "movement", "role_clue", "task", "task_ui")
# End of fixed values.

ANNOTATION = """game_id string, episode_id string, phase_id string, phase_type string, phase_index_global int, player_id string,
    aligned_start_sec double, aligned_end_sec double,
    observations array<struct<abs_start_sec: double, abs_end_sec: double, event_type: string, actor: string, location: string, description: string,
        source_types: array<string>, evidence: string, public_result_text: string, inferred_belief_text: string, certainty: string, needs_human_review: boolean>>,
    utterances array<struct<abs_start_sec: double, abs_end_sec: double, speaker: string, transcript: string, claim_text: string, text: string, content: string,
        certainty: string, needs_human_review: boolean>>"""


def players_array(players: DataFrame) -> list[str]:
    """The roster's names in order; a dimension of at most 1,000 rows."""
    names = [r[0] for r in players.select("player_id").orderBy("player_id").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("a roster holds at most 1,000 players")
    return names


def _roster(players: DataFrame) -> Column:
    return F.array(*[F.lit(p) for p in players_array(players)])


def with_roster(df: DataFrame, players: DataFrame, session: str = "game_id", name: str = "player_id") -> DataFrame:
    """Each row with each player: of its own session, where `players` has that column, else of the one roster."""
    own = players.select(*[c for c in (session,) if c in players.columns], F.col("player_id").alias(name)).distinct()
    return df.join(own, session) if session in players.columns else joins.grid(df, own)


def _with_roster_array(df: DataFrame, players: DataFrame, session: str = "game_id") -> DataFrame:
    """Adds `_roster`, the sorted names of the row's session (a session holds a table's worth of players)."""
    if session not in players.columns:
        return df.withColumn("_roster", _roster(players))
    return df.join(players.groupBy(session).agg(F.array_sort(F.collect_set("player_id")).alias("_roster")), session)


def _if(flag: Column, value: Column) -> Column:
    return F.when(flag, F.array(F.coalesce(value, F.lit("")))).otherwise(F.array().cast("array<string>"))


def _items(annotations: DataFrame, items: str, name: str, path: str) -> DataFrame:
    """One row an item of an annotation's list, with its place; the lists themselves stay behind, so rows don't grow with them."""
    return annotations.select("game_id", "phase_id", "phase_type", "player_id", path, F.posexplode(items).alias("_pos", name))


def candidate_events(annotations: DataFrame, players: DataFrame, path: str = "path") -> DataFrame:
    """One row an observation, numbered over all files in path order; evidence goes to the column of its source type."""
    rows = _with_roster_array(_items(annotations, "observations", "o", path), players)
    has = lambda kind: F.coalesce(F.array_contains("o.source_types", kind), F.lit(False))
    actor = F.when(F.array_contains("_roster", F.col("o.actor")), F.array("o.actor")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_actors", actor).drop("_roster")  # what is numbered holds no list that grows with the game
    inferred = F.coalesce(F.col("o.inferred_belief_text"), F.lit(""))
    return selection.numbered(rows, ["game_id"], [path, "_pos"], "n").select(
        F.format_string("%s_%s_le_%06d", "phase_id", "player_id", "n").alias("local_event_id"), "game_id", F.array("phase_id").alias("source_segment_ids"), F.array("player_id").alias("source_povs"),
        F.col("o.abs_start_sec").alias("abs_start_sec"), F.col("o.abs_end_sec").alias("abs_end_sec"), "phase_type", F.coalesce("o.event_type", F.lit("other")).alias("event_type"), F.col("_actors").alias("actors"),
        F.array().cast("array<string>").alias("patients"), F.coalesce("o.location", F.lit("unknown")).alias("location"), F.coalesce("o.description", F.lit("")).alias("description"),
        _if(has("direct_visual_observation"), F.col("o.evidence")).alias("direct_visual_evidence"), _if(has("speech_claim"), F.col("o.evidence")).alias("direct_audio_evidence"),
        _if(has("public_result"), F.col("o.public_result_text")).alias("public_evidence"), _if(inferred != "", inferred).alias("inferred_fields"),
        numbers.certainty(F.col("o.certainty")).alias("certainty"), F.coalesce("o.needs_human_review", F.lit(False)).alias("needs_human_review"), F.col("n").alias("seq"),
    )


def candidate_claims(annotations: DataFrame, players: DataFrame, path: str = "path") -> DataFrame:
    """One row an utterance with text; heard by all in public phases, else by the one whose view it is."""
    roster = F.col("_roster")
    rows = _items(annotations, "utterances", "u", path)
    filled = lambda c: F.when(text.stripped(c) != "", text.stripped(c))
    said = F.coalesce(*[filled(F.col(f"u.{k}")) for k in ("claim_text", "transcript", "text", "content")])
    rows = _with_roster_array(selection.numbered(rows.withColumn("said", said).where("said is not null"), ["game_id"], [path, "_pos"], "n"), players)
    speaker = F.when(F.array_contains(roster, F.col("u.speaker")), F.col("u.speaker")).otherwise("unknown")
    kind = text.infer_claim_type(F.col("said"))
    return rows.withColumns({"speaker": speaker, "claim_type": kind}).select(
        F.format_string("%s_%s_lc_%06d", "phase_id", "player_id", "n").alias("local_claim_id"), "game_id", F.array("phase_id").alias("source_segment_ids"), "speaker",
        F.when(F.col("phase_type").isin(*PUBLIC_PHASES), roster).otherwise(F.array("player_id")).alias("heard_by"), F.col("u.abs_start_sec").alias("abs_start_sec"), F.col("u.abs_end_sec").alias("abs_end_sec"),
        "claim_type", F.coalesce(filled(F.col("u.transcript")), "said").alias("content"), F.col("said").alias("normalized_content"),
        F.when(text.contains_any(F.col("said"), RECENT_TOKENS), "relative_recent").otherwise("unknown").alias("time_referred"), text.mentioned(F.col("said"), roster).alias("target_entities"),
        text.infer_strategic_role(F.col("claim_type"), F.col("said")).alias("strategic_role"), numbers.certainty(F.col("u.certainty")).alias("certainty"),
        (F.coalesce("u.needs_human_review", F.lit(False)) | (F.col("speaker") == "unknown")).alias("needs_human_review"), F.col("n").alias("seq"),
    )


def _number(df: DataFrame, key: str, order: Sequence[str], pattern: str, out: str) -> DataFrame:
    return selection.numbered(df, [key], order, "_n").withColumn(out, F.format_string(pattern, "_n")).drop("_n")


def _ordered_union(column: str) -> Column:
    """Distinct items of all rows' arrays, in the order of the rows."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_turn", column))), lambda x: x[column]))).alias(column)


def _set_union(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column)


def canonical_events(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged events (world_event_id) and the map local_event_id -> world_event_id.

    The first match in order of start and type wins, and a merged event's interval grows; ids number the kept events in order.
    """
    keyed = candidates.withColumn("_key", text.event_key(F.col("event_type"), F.col("actors"), F.col("location"))).withColumn("_turn", F.struct("abs_start_sec", "event_type", "seq"))
    flat = keyed.select("game_id", "_key.*", "abs_start_sec", "abs_end_sec", "seq", "local_event_id")
    joined = folds.merge_events(flat, ["game_id", "event_type", "actor", "location"], "abs_start_sec", "abs_end_sec", "local_event_id", ["abs_start_sec", "event_type", "seq"])
    rows = keyed.join(joined, "local_event_id").repartition("game_id", "kept_id")  # as rows: most merge with none, and half-made lists are larger
    first = lambda c: F.min_by(c, "_turn").alias(c)
    merged = rows.groupBy("game_id", "kept_id").agg(
        F.min("_turn").alias("_turn"), F.min("abs_start_sec").alias("abs_start_sec"), F.max("abs_end_sec").alias("abs_end_sec"), *[first(c) for c in ("phase_type", "event_type", "actors", "patients", "location", "description")],
        *[_set_union(c) for c in ("source_segment_ids", "source_povs")], *[_ordered_union(c) for c in ("direct_visual_evidence", "direct_audio_evidence", "public_evidence", "inferred_fields")],
        F.max("certainty").alias("certainty"), F.bool_or("needs_human_review").alias("needs_human_review"),
        F.transform(F.array_sort(F.collect_list(F.struct("_turn", "local_event_id"))), lambda x: x["local_event_id"]).alias("duplicate_local_event_ids"),
    )
    events = _number(merged, "game_id", ["_turn"], "ge_%06d", "world_event_id")
    ids = joined.join(events.select("kept_id", "world_event_id"), "kept_id").select("local_event_id", "world_event_id")
    return events.drop("_turn", "kept_id"), ids


def canonical_claims(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged claims (claim_id) and the map local_claim_id -> claim_id: equal speaker, type and text within three seconds."""
    keyed = candidates.withColumn("_key", text.claim_key(F.col("speaker"), F.col("claim_type"), F.coalesce(F.nullif("normalized_content", F.lit("")), "content"))).withColumn("_turn", F.struct("abs_start_sec", "speaker", "claim_type", "seq"))
    flat = keyed.select("game_id", F.col("_key.speaker").alias("speaker"), F.col("_key.claim_type").alias("claim_type"), F.col("_key.text").alias("said"), "abs_start_sec", "seq", "local_claim_id")
    joined = folds.merge_claims(flat, ["game_id", "speaker", "claim_type", "said"], "abs_start_sec", "local_claim_id", ["abs_start_sec", "speaker", "claim_type", "seq"])
    rows = keyed.join(joined, "local_claim_id").repartition("game_id", "kept_id")
    first = lambda c: F.min_by(c, "_turn").alias(c)
    merged = rows.groupBy("game_id", "kept_id").agg(
        F.min("_turn").alias("_turn"), F.min("abs_start_sec").alias("abs_start_sec"), F.max("abs_end_sec").alias("abs_end_sec"),
        *[first(c) for c in ("speaker", "claim_type", "content", "normalized_content", "time_referred", "strategic_role")], *[_set_union(c) for c in ("source_segment_ids", "heard_by", "target_entities")],
        F.max("certainty").alias("certainty"), F.bool_or("needs_human_review").alias("needs_human_review"),
    )
    claims = _number(merged, "game_id", ["_turn"], "claim_%06d", "claim_id")
    return claims.drop("_turn", "kept_id"), joined.join(claims.select("kept_id", "claim_id"), "kept_id").select("local_claim_id", "claim_id")


def phase_events(annotations: DataFrame, path: str = "path") -> DataFrame:
    """The first annotation of each phase."""
    first = joins.first_per(annotations, ["phase_id"], [path])
    return first.select(F.format_string("phase_%06d", "phase_index_global").alias("phase_event_id"), "game_id", "episode_id", "phase_id", "phase_type", F.col("aligned_start_sec").alias("abs_start_sec"), F.col("aligned_end_sec").alias("abs_end_sec"))


def visibility_edges(events: DataFrame, claims: DataFrame, players: DataFrame) -> DataFrame:
    """Every event and claim against every player: seen, public, heard or not, with evidence and confidence."""
    p = F.col("player_id")
    seen = F.array_contains("source_povs", p)
    public = F.col("phase_type").isin(*PUBLIC_PHASES) | (F.size("public_evidence") > 0)
    none = F.array().cast("array<string>")
    of_events = with_roster(events, players).select(
        "game_id", F.col("world_event_id").alias("event_id"), "player_id", F.col("abs_end_sec").alias("cutoff_abs_sec"),
        F.when(seen, "direct_visual").when(public, "public_ui").otherwise("not_visible").alias("visibility"), F.when(seen | public, F.array("world_event_id")).otherwise(none).alias("evidence_ids"),
        F.when(seen, F.col("certainty")).when(public, F.least(F.lit(0.8), F.col("certainty"))).otherwise(0.75).alias("confidence"),
    )
    heard = F.array_contains("heard_by", p)
    of_claims = with_roster(claims, players).select(
        "game_id", F.col("claim_id").alias("event_id"), "player_id", F.col("abs_end_sec").alias("cutoff_abs_sec"), F.when(heard, "heard_claim").otherwise("not_visible").alias("visibility"),
        F.when(heard, F.array("claim_id")).otherwise(none).alias("evidence_ids"), F.col("certainty").alias("confidence"),
    )
    edges = of_events.unionByName(of_claims)
    return edges.withColumn("edge_id", F.concat_ws("_", F.lit("vis"), "event_id", "player_id"))


def alike(said: Column, described: Column, speaker: Column, targets: Column, actors: Column, location: Column) -> Column:
    """Whether a claim may be about an event: speaker or target acts in it, its place is named, or both name an action."""
    place = text.normalized_text(location)
    action = F.exists(F.array(*[F.lit(t) for t in ACTION_TOKENS]), lambda t: F.contains(said, t) & F.contains(described, t))
    return F.coalesce(F.array_contains(actors, speaker), F.lit(False)) | F.coalesce(F.arrays_overlap(targets, actors), F.lit(False)) | ((place != "") & F.contains(said, place)) | action


def claim_truth_links(claims: DataFrame, events: DataFrame, edges: DataFrame, players: DataFrame, within: float = 180.0, most: int = 4) -> DataFrame:
    """The first `most` similar events near each claim, in event order, with a global truth and each player's awareness.

    Of a claim whose speaker acts in one of the events: contradicted if it denies, else supported; otherwise unverified.
    """
    c = claims.select("game_id", "claim_id", "speaker", "heard_by", "content", F.col("abs_start_sec").alias("_cs"), F.col("abs_end_sec").alias("_ce"), F.col("certainty").alias("_cc"), "target_entities", text.normalized_text(F.concat_ws(" ", "content", "normalized_content")).alias("_said"))
    e = events.select("game_id", "world_event_id", "actors", "location", text.normalized_text(F.col("description")).alias("_desc"), F.col("abs_start_sec").alias("_es"), F.col("abs_end_sec").alias("_ee"), F.col("certainty").alias("_ec"))
    met = joins.range_join(c, e, ("_cs", "_ce"), ("_es", "_ee"), max(2 * within + 60, 14400.0), ["game_id"], within, within)  # events may last hours: a row a bucket
    near = met.where(alike(F.col("_said"), F.col("_desc"), F.col("speaker"), F.col("target_entities"), F.col("actors"), F.col("location")))
    top = staged(joins.first_per(near, ["game_id", "claim_id"], ["world_event_id"], most).withColumn("_acts", F.array_contains("actors", F.col("speaker"))), "near")  # used twice
    seen = top.join(edges.where("visibility = 'direct_visual'").select("game_id", F.col("event_id").alias("world_event_id"), F.col("player_id").alias("_p")), ["game_id", "world_event_id"], "left")
    saw = seen.groupBy("game_id", "claim_id").agg(F.collect_set("_p").alias("_saw"))
    grouped = top.groupBy("game_id", "claim_id").agg(
        F.array_sort(F.collect_list("world_event_id")).alias("world_event_ids"), F.bool_or("_acts").alias("_acts"), F.first("content").alias("_content"), F.first("heard_by").alias("_heard"),
        F.least(F.first("_cc"), F.max("_ec")).alias("confidence"),
    )
    denies = text.contains_any(text.normalized_text(F.col("_content")), DENIAL_TOKENS)
    grouped = _with_roster_array(grouped, players)
    out = grouped.join(saw, ["game_id", "claim_id"]).withColumn("truth_status_global", F.when(F.col("_acts") & denies, "contradicted").when(F.col("_acts"), "supported").otherwise("unverified"))
    sight = F.when(F.col("truth_status_global") == "contradicted", "has_contradictory_visual_evidence").otherwise("has_supporting_visual_evidence")
    aware = F.map_from_entries(F.transform("_roster", lambda p: F.struct(p, F.when(F.array_contains("_saw", p), sight).when(F.array_contains("_heard", p), "not_enough_information").otherwise("unknown"))))
    return out.select(
        F.concat_ws("_", F.lit("ctl"), "claim_id", F.get("world_event_ids", 0)).alias("claim_truth_link_id"), "game_id", "claim_id", "world_event_ids", "truth_status_global", aware.alias("local_awareness_by_player"),
        "confidence", F.col("truth_status_global").isin("ambiguous", "unverified").alias("needs_human_review"),
    )


def belief_snapshots(events: DataFrame, claims: DataFrame, edges: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """What each (game_id, target_player, cutoff) can know: sorted id sets of evidence, heard claims and hidden events.

    The join is one of edges of a player with that player's cutoffs, later than the event's start; sizes follow the cutoffs
    asked for.
    """
    c = staged(cutoffs.select("game_id", "target_player", "cutoff_abs_sec"), "cutoffs")  # used twice
    last = c.groupBy("game_id").agg(F.max("cutoff_abs_sec").alias("_last"))
    starts = events.select("game_id", F.col("world_event_id").alias("event_id"), "abs_start_sec", F.lit(False).alias("is_claim")).unionByName(claims.select("game_id", F.col("claim_id").alias("event_id"), "abs_start_sec", F.lit(True).alias("is_claim")))
    # What begins after a game's last cutoff is in no snapshot, and goes before it meets the players.
    starts = starts.join(last, "game_id").where("abs_start_sec <= _last").drop("_last")
    known = edges.select("game_id", F.col("player_id").alias("target_player"), "event_id", "visibility").join(starts, ["game_id", "event_id"])
    # Merged by player: the sets then come together where the rows met, and a cutoff before all events keeps its row.
    k = known.select(F.col("game_id").alias("_game"), F.col("target_player").alias("_player"), "event_id", "visibility", "abs_start_sec", "is_claim").hint("merge")
    met = c.join(k, (F.col("game_id") == F.col("_game")) & (F.col("target_player") == F.col("_player")) & (F.col("abs_start_sec") <= F.col("cutoff_abs_sec")), "left")
    observed, heard, hidden = F.col("visibility").isin("direct_visual", "direct_audio", "public_ui"), F.col("visibility") == "heard_claim", (F.col("visibility") == "not_visible") & ~F.col("is_claim")
    ids = lambda flag, value: F.array_sort(F.collect_set(F.when(flag, value)))
    obs = F.concat_ws("_", F.lit("obs"), "target_player", "event_id")
    out = met.groupBy("game_id", "target_player", "cutoff_abs_sec").agg(
        ids(observed, obs).alias("private_observations"), ids((F.col("visibility") == "public_ui"), obs).alias("_public"), ids(heard, F.col("event_id")).alias("heard_claims"), ids(hidden, F.col("event_id")).alias("forbidden_event_ids"),
    )
    return out.select(
        F.format_string("mem_%s_%s_%06d", "game_id", "target_player", F.floor("cutoff_abs_sec").cast("bigint")).alias("snapshot_id"), "game_id", "target_player", "cutoff_abs_sec", "private_observations",
        F.array_sort(F.concat("_public", "heard_claims")).alias("public_history"), "heard_claims", "forbidden_event_ids", F.array_sort(F.array_union("private_observations", "heard_claims")).alias("available_evidence_ids"),
    )


def probe_cutoffs(links: DataFrame, claims: DataFrame, events: DataFrame, players: DataFrame, from_each: int = 200, most: int = 360, viewers: bool = True) -> DataFrame:
    """Cutoffs one second after linked claims and three after events, for each player, once to a tenth of a second; without `viewers`, after
    events only for those who didn't see them.

    The bounds are those of one game's ledger: its first `from_each` links and events, and its first `most` cutoffs.
    """
    told = joins.first_per(links.select("game_id", "claim_id"), ["game_id"], ["claim_id"], from_each)
    linked = told.join(claims.select("game_id", "claim_id", "abs_end_sec"), ["game_id", "claim_id"]).select("game_id", (F.col("abs_end_sec") + 1).alias("cutoff_abs_sec"), F.array().cast("array<string>").alias("_saw"))
    first = joins.first_per(events.select("game_id", "world_event_id", "abs_end_sec", "source_povs"), ["game_id"], ["world_event_id"], from_each)
    after = first.select("game_id", (F.col("abs_end_sec") + 3).alias("cutoff_abs_sec"), F.col("source_povs").alias("_saw"))
    rows = with_roster(linked.unionByName(after), players, name="target_player")
    rows = rows if viewers else rows.where(~F.array_contains("_saw", F.col("target_player")))
    once = rows.withColumn("_r", F.bround("cutoff_abs_sec", 1)).groupBy("game_id", "target_player", "_r").agg(F.min("cutoff_abs_sec").alias("cutoff_abs_sec"))
    return joins.first_per(once.drop("_r"), ["game_id"], ["cutoff_abs_sec", "target_player"], most)


def build_ledger(annotations: DataFrame, players: DataFrame, path: str = "path", viewers: bool = True) -> dict[str, DataFrame]:
    """The seven tables of the ledger; `viewers` as in `probe_cutoffs`."""
    events, event_map = canonical_events(candidate_events(annotations, players, path))
    claims, _ = canonical_claims(candidate_claims(annotations, players, path))
    edges = visibility_edges(events, claims, players)
    links = staged(claim_truth_links(claims, events, edges, players), "links")
    snapshots = belief_snapshots(events, claims, edges, probe_cutoffs(links, claims, events, players, viewers=viewers))
    return {"world_events": events, "claims": claims, "phase_events": phase_events(annotations, path), "visibility_edges": edges, "belief_memory_snapshots": snapshots, "claim_truth_links": links, "canonical_event_map": event_map}


# Probe templates in order, and their shares.
TEMPLATES = ("hidden_critical_event", "contradicted_alibi", "private_witness", "vote_influence", "delayed_public_reveal")
SHARES = {"hidden_critical_event": 0.10, "contradicted_alibi": 0.35, "private_witness": 0.15, "vote_influence": 0.15, "delayed_public_reveal": 0.10}
# End of fixed values.


def probe_candidates(ledger: dict[str, DataFrame]) -> DataFrame:
    """(template, game_id, world_event_id, target_player, claim_ids): events hidden from a player that others saw."""
    events, edges, links, claims = ledger["world_events"], ledger["visibility_edges"], ledger["claim_truth_links"], ledger["claims"]
    hidden = edges.where("visibility = 'not_visible'").select("game_id", F.col("event_id").alias("world_event_id"), F.col("player_id").alias("target_player"))
    base = events.select("game_id", "world_event_id", "abs_start_sec", "abs_end_sec", "source_povs", "event_type").join(hidden, ["game_id", "world_event_id"])
    linked = links.select("game_id", "claim_id", "truth_status_global", F.explode("world_event_ids").alias("world_event_id")).join(claims.select("game_id", "claim_id", "claim_type", F.col("abs_start_sec").alias("_cs"), "heard_by"), ["game_id", "claim_id"])
    told = base.join(linked, ["game_id", "world_event_id"], "left")
    heard = F.array_contains("heard_by", F.col("target_player"))
    kinds = {
        "hidden_critical_event": F.lit(True),
        "contradicted_alibi": heard & (F.col("truth_status_global") == "contradicted"),
        "private_witness": F.size("source_povs") == 1,
        "vote_influence": heard & (F.col("claim_type") == "accusation"),
        "delayed_public_reveal": heard & (F.col("_cs") > F.col("abs_end_sec") + 45),
    }
    each = told.select("game_id", "world_event_id", "target_player", "abs_start_sec", "claim_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in kinds.items()]))).alias("template"))
    return each.groupBy("template", "game_id", "world_event_id", "target_player", "abs_start_sec").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))


def select_probe_groups(ledger: dict[str, DataFrame], limit: int = 240) -> DataFrame:
    """Quota for each template, then fill in template order; one group for each template, event and target."""
    rows = selection.quota_then_fill(probe_candidates(ledger), "template", TEMPLATES, SHARES, limit, ["abs_start_sec", "world_event_id", "target_player", "game_id"], ["template", "game_id", "world_event_id", "target_player"])
    return rows.withColumn("probe_group_id", F.concat_ws("_", "game_id", F.lit("pg"), "template", "world_event_id", "target_player"))


def probe_rows(groups: DataFrame, ledger: dict[str, DataFrame]) -> DataFrame:
    """Three or four probe letters a group, with the target's context as of the event's end plus three seconds.

    Letter D needs claims. Public columns carry nothing of the event itself but its id's time.
    """
    events = ledger["world_events"].select("game_id", "world_event_id", (F.col("abs_end_sec") + 3.0).alias("cutoff"))
    asked = groups.join(events, ["game_id", "world_event_id"])
    snaps = ledger["belief_memory_snapshots"].select("game_id", "target_player", F.col("cutoff_abs_sec").alias("snap_cutoff"), "available_evidence_ids", "forbidden_event_ids")
    seen = joins.asof_join(asked, snaps, "cutoff", "snap_cutoff", ["game_id", "target_player"], order=["snap_cutoff"])
    none = F.array().cast("array<string>")
    letters = F.array_compact(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.when(F.size("claim_ids") > 0, "D")))
    return seen.withColumns({"available_evidence_ids": F.coalesce("available_evidence_ids", none), "forbidden_event_ids": F.coalesce("forbidden_event_ids", none)}).select(
        "probe_group_id", "template", "target_player", "cutoff", F.explode(letters).alias("letter"), "available_evidence_ids", "forbidden_event_ids", "claim_ids"
    ).withColumn("probe_id", F.concat_ws("_", "probe_group_id", "letter"))


def public_probe(rows: DataFrame) -> DataFrame:
    """Without what only a scorer may see."""
    return rows.drop("forbidden_event_ids", "world_event_id")


def direct_and_hidden(edges: DataFrame) -> DataFrame:
    """For each event the players who saw it and those from whom it is hidden, in roster order."""
    who = lambda v: F.array_sort(F.collect_set(F.when(F.col("visibility") == v, F.col("player_id"))))
    return edges.groupBy("game_id", "event_id").agg(who("direct_visual").alias("direct"), who("not_visible").alias("hidden"))


def other_player(source_povs: Column, target: Column, roster: Column) -> Column:
    """The first viewer besides the target, else the first of the roster besides it, else the target."""
    apart = lambda xs: F.get(F.filter(xs, lambda p: p != target), 0)
    return F.coalesce(apart(source_povs), apart(roster), target)


def is_clean_event(players: Column) -> Column:
    """Worth a probe: private, not a transition or task, plainly described, sure enough, seen by roster players only."""
    described = ~text.contains_any(F.lower("description"), text.BAD_DESCRIPTION)
    seen = (F.size("source_povs") > 0) & F.forall("source_povs", lambda p: F.array_contains(players, p))
    return ~F.col("phase_type").isin(*PUBLIC_PHASES) & ~F.col("event_type").isin(*NOT_PROBED) & described & (F.col("certainty") >= 0.65) & ~F.col("needs_human_review") & seen & after_warmup()


def phase_local_start(segment_ids: Column, start: Column) -> Column:
    """Seconds since the phase began, from the second last number of the first segment's id; null if there is none."""
    begun = F.regexp_extract(F.coalesce(F.get(segment_ids, 0), F.lit("")), r"_(\d+)_[^_]*$", 1).try_cast("double")
    return start - begun


def after_warmup(seconds: float = 15.0) -> Column:
    local = phase_local_start(F.col("source_segment_ids"), F.col("abs_start_sec"))
    return (F.col("phase_type") != "gameplay") | local.isNull() | (local >= seconds)


def is_usable_claim(players: Column) -> Column:
    final = F.exists("source_segment_ids", lambda s: F.contains(s, F.lit("_final_")))
    return ~final & F.array_contains(players, F.col("speaker")) & F.col("claim_type").isin(*PROBED_CLAIMS) & (F.col("certainty") >= 0.55) & ~text.contains_any(F.col("content"), IDLE_TALK) & (F.length(text.stripped(F.col("content"))) >= 8)


def diagnostic_event_allowed() -> Column:
    """Seeded events need a plausible length, certainty, type and description; others always pass."""
    private = F.col("event_type").isin(*SEEDED_TYPES)
    length = F.col("abs_end_sec") - F.col("abs_start_sec")
    return ~F.coalesce(F.col("gold_source") == "qwen_seed", F.lit(False)) | (length.between(0, 15) & (F.col("certainty") >= 0.6) & private & (F.length(text.stripped(F.col("description"))) >= 8))


def gold_rank(event_type: Column, description: Column, claim_type: Column, claim_certainty: Column, event_certainty: Column, truth: Column, critical: Sequence[str]) -> Column:
    """Additive score of a candidate; higher goes first, ids break ties."""
    told = claim_type.isNotNull()
    return (
        F.when(event_type.isin(*critical), 80).when(text.contains_any(F.lower(description), text.CRITICAL_DESCRIPTION), 70).when(told, 45).otherwise(0)
        + F.when(truth == "contradicted", 30).when(truth == "supported", 18).when(truth == "ambiguous", 10).otherwise(0)
        + F.when(told & claim_type.isin("location", "defense", "sighting"), 14).otherwise(0)
        + F.when(told, F.least(F.lit(10), F.floor(F.coalesce(claim_certainty, F.lit(0.0)) * 10))).otherwise(0)
        + F.least(F.lit(10), F.floor(F.coalesce(event_certainty, F.lit(0.0)) * 10))
    ).cast("int")
