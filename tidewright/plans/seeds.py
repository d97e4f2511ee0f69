"""A seed ledger from fusion artifacts, initial trials, gold by layer, and midgame trials of four families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import joins, selection, windows
from tidewright.plans.ledger import PUBLIC_PHASES, with_roster

# Event types of the initial trials.
BELIEF_TYPES = ("audio_cue", "meeting", "role_clue", "body_report", "kill", "encounter")
INTENT_TYPES = ("accusation", "defense", "vote")
USEFUL_TYPES = ("kill", "body_report", "accusation", "defense", "vote", "role_clue")
FAMILIES = ("E_hidden_world_state_estimation", "F_other_player_current_action_prediction", "G_next_behavior_prediction", "H_deception_state_inference")
TRUTHS = ("supported", "contradicted", "unverified", "ambiguous")
NO_FACTS = "无可靠信息"
# End of fixed values.


def _none() -> Column:
    return F.array().cast("array<string>")


def _strings(name: str) -> Column:
    return F.coalesce(F.transform(name, lambda x: x.cast("string")), _none())


def _numbered(rows: DataFrame, order: Sequence[str], pattern: str, out: str) -> DataFrame:
    return selection.with_position(rows, order, "_n").withColumn(out, F.format_string(pattern, F.col("_n") + 1)).drop("_n")


def world_events(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Fused events as world events: actors are the involved that are sources, else the sources. rows: game_id,
    source_player_ids, involved_players, source_clip_ids, start_sec, end_sec, event_type, location, description, confidence."""
    n = _numbered(rows, order, "seed_ge_%06d", "world_event_id")
    kind = F.coalesce("event_type", F.lit("unknown"))
    named = F.filter(_strings("involved_players"), lambda p: F.array_contains(_strings("source_player_ids"), p))
    return n.select(
        "world_event_id", "game_id", _strings("source_clip_ids").alias("source_segment_ids"), _strings("source_player_ids").alias("source_povs"), F.coalesce("start_sec", F.lit(0.0)).alias("abs_start_sec"),
        F.coalesce("end_sec", "start_sec", F.lit(0.0)).alias("abs_end_sec"), F.when(F.lower(kind).contains("meeting"), "meeting").otherwise("gameplay").alias("phase_type"), kind.alias("event_type"),
        F.when(F.size(named) > 0, named).otherwise(_strings("source_player_ids")).alias("actors"), F.coalesce("location", F.lit("unknown")).alias("location"), F.coalesce("description", F.lit("")).alias("description"),
        _none().alias("public_evidence"), F.coalesce("confidence", F.lit(0.5)).alias("certainty"), F.lit(False).alias("needs_human_review"), F.lit("qwen_seed").alias("gold_source"),
    )


def claims(rows: DataFrame, players: DataFrame, order: Sequence[str]) -> DataFrame:
    """Utterances as claims that every player of the game hears. rows: game_id, speaker_id, player_id, clip_id, start_sec,
    end_sec, speech_act, text, mentioned_players, confidence."""
    n = _numbered(rows, order, "seed_claim_%06d", "claim_id")
    if "game_id" in players.columns:
        n = n.join(players.groupBy("game_id").agg(F.array_sort(F.collect_set(F.col("player_id").cast("string"))).alias("heard_by")), "game_id", "left")
    else:
        n = n.crossJoin(F.broadcast(players.agg(F.array_sort(F.collect_set(F.col("player_id").cast("string"))).alias("heard_by"))))  # one row
    said = F.coalesce("text", F.lit(""))
    who = F.coalesce(F.nullif(F.col("speaker_id").cast("string"), F.lit("")), F.nullif(F.col("player_id").cast("string"), F.lit("")), F.lit("unknown"))
    return n.select(
        "claim_id", "game_id", F.array(F.coalesce("clip_id", F.lit(""))).alias("source_segment_ids"), who.alias("speaker"), F.coalesce("heard_by", _none()).alias("heard_by"), F.coalesce("start_sec", F.lit(0.0)).alias("abs_start_sec"),
        F.coalesce("end_sec", "start_sec", F.lit(0.0)).alias("abs_end_sec"), F.coalesce("speech_act", F.lit("other")).alias("claim_type"), said.alias("content"), said.alias("normalized_content"), _strings("mentioned_players").alias("target_entities"),
        F.lit("information_sharing").alias("strategic_role"), F.coalesce("confidence", F.lit(0.5)).alias("certainty"), F.lit(False).alias("needs_human_review"), F.lit("qwen_seed").alias("gold_source"),
    )


def _ends(events: DataFrame) -> DataFrame:
    return events.groupBy("game_id").agg(F.max("abs_end_sec").alias("_end"))


def _ticks(step: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.col("_end") / step).cast("int")), lambda i: i * F.lit(step))


def snapshot_counts(events: DataFrame, players: DataFrame, step: float = 10.0) -> DataFrame:
    """(game_id, n_rows): the rows that `snapshots` gives each game, from its end and its roster; none is made.

    The end is a cutoff of its own unless it is one of the ticks, which are whole multiples of the step.
    """
    n = F.ceil(F.col("_end") / step).cast("int")
    extra = F.when(F.rint(F.col("_end") / step) * F.lit(step) == F.col("_end"), 0).otherwise(1)
    cutoffs = _ends(events).select("game_id", (F.abs(n) + 1 + extra).cast("bigint").alias("_n")).where("_n is not null")
    return with_roster(cutoffs, players).groupBy("game_id").agg(F.sum("_n").alias("n_rows"))


def snapshots(events: DataFrame, said: DataFrame, players: DataFrame, step: float = 10.0, parts: int = 256) -> DataFrame:
    """Every `step` seconds to the end of the game, and at its end: the last 12 events that a player saw and claims made, and the
    last 24 events hidden from the player, all ended by then, in order of their end. Players' rows, many more than
    events, are dealt to `parts` tasks a sort."""
    cutoffs = _ends(events).select("game_id", F.explode(F.array_distinct(F.concat(_ticks(step), F.array("_end")))).alias("cutoff_abs_sec"))
    # Claims are a game's, so they are found before players come in; numbers are given while rows hold no lists.
    cutoffs = cutoffs.withColumn("_n", F.row_number().over(Window.partitionBy("game_id").orderBy("cutoff_abs_sec")))
    told = windows.last_n_at(cutoffs, said.select("game_id", "abs_end_sec", "claim_id"), ["game_id"], "cutoff_abs_sec", "abs_end_sec", "claim_id", 12, "heard_claims")
    asked = with_roster(told, players, name="target_player").withColumn("target_player", F.col("target_player").cast("string"))
    seen = events.select("game_id", F.explode("source_povs").alias("target_player"), "abs_end_sec", "world_event_id")
    unseen = with_roster(events.select("game_id", "source_povs", "abs_end_sec", "world_event_id"), players, name="target_player").withColumn("target_player", F.col("target_player").cast("string"))
    unseen = unseen.where(~F.array_contains("source_povs", F.col("target_player"))).drop("source_povs")
    out = windows.last_n_at(asked, seen, ["game_id", "target_player"], "cutoff_abs_sec", "abs_end_sec", "world_event_id", 12, "private_observations", parts)
    out = windows.last_n_at(out, unseen, ["game_id", "target_player"], "cutoff_abs_sec", "abs_end_sec", "world_event_id", 24, "forbidden_event_ids", parts)
    sets = {"public_history": F.col("heard_claims"), "available_evidence_ids": F.concat("private_observations", "heard_claims"), "snapshot_id": F.format_string("seed_mem_%s_%06d", "target_player", "_n")}
    return out.withColumns(sets).drop("_n").select("game_id", "target_player", "cutoff_abs_sec", "private_observations", "forbidden_event_ids", "heard_claims", *sets)


def build_seed_ledger(fused: DataFrame, said: DataFrame, players: DataFrame, order: Sequence[str]) -> dict[str, DataFrame]:
    """The seven tables of a ledger that nobody has judged yet: nothing merges, links are unverified, one phase a game."""
    events, told = world_events(fused, order), claims(said, players, order)
    seen = F.array_contains("source_povs", F.col("player_id").cast("string"))
    edges = with_roster(events, players).select(
        F.concat_ws("_", F.lit("vis"), "world_event_id", "player_id").alias("edge_id"), "game_id", F.col("world_event_id").alias("event_id"), F.col("player_id").cast("string").alias("player_id"), F.col("abs_end_sec").alias("cutoff_abs_sec"),
        F.when(seen, "direct_visual").otherwise("not_visible").alias("visibility"), F.when(seen, F.array("world_event_id")).otherwise(_none()).alias("evidence_ids"), F.col("certainty").alias("confidence"),
    )
    phases = events.groupBy("game_id").agg(F.max("abs_end_sec").alias("abs_end_sec")).select(F.lit("seed_phase_000001").alias("phase_event_id"), "game_id", F.concat("game_id", F.lit("_episode_000")).alias("episode_id"), F.concat("game_id", F.lit("_seed_gameplay")).alias("phase_id"), F.lit("gameplay").alias("phase_type"), F.lit(0.0).alias("abs_start_sec"), "abs_end_sec")
    links = told.select(F.concat(F.lit("seed_ctl_"), "claim_id").alias("claim_truth_link_id"), "game_id", "claim_id", _none().alias("world_event_ids"), F.lit("unverified").alias("truth_status_global"), F.map_from_entries(F.transform("heard_by", lambda p: F.struct(p, F.lit("unknown")))).alias("local_awareness_by_player"), F.col("certainty").alias("confidence"), F.lit(False).alias("needs_human_review"))
    canonical = events.select(F.col("world_event_id").alias("canonical_event_id"), F.col("source_segment_ids").alias("duplicate_local_event_ids"), F.coalesce(F.get("source_segment_ids", 0), "world_event_id").alias("canonical_source"), F.array("abs_start_sec", "abs_end_sec").alias("abs_time_cluster"))
    return {"world_events": events, "claims": told, "phase_events": phases, "visibility_edges": edges, "belief_memory_snapshots": snapshots(events, told, players), "claim_truth_links": links, "canonical_event_map": canonical}


def _short(value: Column, limit: int = 220) -> Column:
    return text.ellipsis_text(value, limit)


def candidate_trials(events: DataFrame, states: DataFrame) -> DataFrame:
    """One to three trials a state: what the player knows, what is hidden from them, what their intent rests on.

    events: global_event_id, seq, game_id, end_sec, event_type, description, source_player_ids, confidence; states: game_id,
    player_id, cutoff_time, known_facts, confidence. Ids run over states in order, a state's trials in the order above.
    """
    e = F.struct("seq", "global_event_id", "event_type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    met = states.join(events.select("game_id", "end_sec", F.col("source_player_ids").alias("_src"), e.alias("_e")), "game_id", "left").where(F.col("end_sec").isNull() | (F.col("end_sec") <= F.col("cutoff_time")))
    own = F.array_contains("_src", F.col("player_id"))
    kind = F.col("_e.event_type")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("_e"))))
    seen = met.groupBy("game_id", "player_id", "cutoff_time").agg(listed(own).alias("_own"), listed(own & kind.isin(*BELIEF_TYPES)).alias("_belief"), listed(own & kind.isin(*INTENT_TYPES)).alias("_intent"), listed(~own & kind.isin(*USEFUL_TYPES)).alias("_hidden"))
    rows = states.join(seen, ["game_id", "player_id", "cutoff_time"], "left")
    shape = "array<struct<seq:bigint,global_event_id:string,event_type:string,description:string,confidence:double>>"
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast(shape), F.array().cast(shape)) for c in ("_own", "_belief", "_intent", "_hidden")})
    said = lambda xs: F.transform(xs, lambda x: x["description"])
    ids = lambda xs: F.filter(F.transform(xs, lambda x: x["global_event_id"]), lambda i: F.coalesce(i, F.lit("")) != "")
    facts = F.array_join(F.slice(text.unique_texts(F.concat(said("_belief"), F.coalesce("known_facts", _none()))), 1, 3), "; ")
    others = lambda c: F.slice(text.unique_texts(F.transform(F.slice(c, 2, 3), lambda x: _short(x["description"]))), 1, 3)
    head = lambda c, f: F.get(c, 0)[f]
    or_none = lambda c: F.when(c == "", NO_FACTS).otherwise(c)

    def trial(kind: str, answer: Column, support: Column, sure: Column, distractors: Column) -> Column:
        return F.struct(F.lit(kind).alias("question_type"), _short(answer).alias("answer"), ids(support).alias("supporting_global_event_ids"), sure.alias("confidence"), distractors.alias("distractors"))

    sure = F.coalesce("confidence", F.lit(0.0))
    each = F.array_compact(F.array(
        trial("first_order_belief", or_none(facts), F.when(F.size("_belief") > 0, F.slice("_belief", 1, 3)).otherwise(F.slice("_own", 1, 3)), sure, _none()),
        F.when(F.size("_hidden") > 0, trial("hidden_information", or_none(head("_hidden", "description")), F.slice("_hidden", 1, 1), F.least(sure, head("_hidden", "confidence")), others("_hidden"))),
        F.when(F.size("_intent") > 0, trial("intent_inference", or_none(head("_intent", "description")), F.slice("_intent", 1, 1), F.least(F.lit(0.85), sure), others("_intent"))),
    ))
    asked = rows.select("game_id", F.col("player_id").alias("target_player_id"), "cutoff_time", F.posexplode(each).alias("_k", "_t"))
    numbered = selection.with_position(asked, ["game_id", "target_player_id", "cutoff_time", "_k"], "_n")
    return numbered.select(F.format_string("trial_%06d", F.col("_n") + 1).alias("trial_id"), "game_id", "target_player_id", "cutoff_time", "_t.*", F.array("target_player_id").alias("supporting_information_state_ids"))


def structured_gold(rows: DataFrame, nodes: DataFrame, row_id: str) -> DataFrame:
    """Gold of each (layer, subject, target) from its evidence: access, knowledge, what was said, or what was done next.

    rows: row_id, episode_id, layer, subject, target, cutoff_abs_sec, evidence_ids. nodes as in `trajectory`, with
    trajectory_node_id. What nothing supports has the certainty "unknown".
    """
    n = nodes.select("episode_id", "trajectory_node_id", "event_type", "visible_players", "player_id", "speaker_id", "utterance", "abs_start_sec", "location", "evidence_asset_ids")
    by_evidence = n.select("*", F.explode("evidence_asset_ids").alias("_ev")).drop("evidence_asset_ids")
    met = rows.select(row_id, "episode_id", "target", F.explode("evidence_ids").alias("_ev")).join(by_evidence, ["episode_id", "_ev"])
    spoke = (F.col("speaker_id") == F.col("target")) & (F.coalesce("utterance", F.lit("")) != "")
    turn = F.struct("abs_start_sec", "trajectory_node_id")
    found = met.groupBy(row_id).agg(
        F.array_sort(F.collect_set("event_type")).alias("observed_event_types"), F.bool_or(F.array_contains("visible_players", F.col("target"))).alias("_seen"),
        F.min_by(F.when(spoke, F.struct("utterance", "event_type")), F.when(spoke, turn)).alias("_said"),
    )
    involved = n.select("episode_id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("player_id", "speaker_id"), "visible_players")))).alias("target"), "trajectory_node_id", "abs_start_sec", "event_type", "location", "evidence_asset_ids")
    asked = rows.where("layer = 'intent_and_action_prediction'").select(row_id, "episode_id", "target", F.col("cutoff_abs_sec").alias("_cut"))
    after = joins.next_join(asked, involved, "_cut", "abs_start_sec", ["episode_id", "target"], ["trajectory_node_id"]).where("trajectory_node_id is not null").select(row_id, F.struct("event_type", "location", "evidence_asset_ids").alias("_next"))
    out = rows.join(found, row_id, "left").join(after, row_id, "left")
    layer = F.col("layer")
    said = layer.isin("belief_and_false_belief", "stance_trust_and_agreement") & F.col("_said").isNotNull()
    next_ = (layer == "intent_and_action_prediction") & F.col("_next").isNotNull()
    sighted = layer.isin("perception_access", "knowledge_state")
    return out.select(
        row_id, "layer", F.array_sort(F.array_distinct("evidence_ids")).alias("subject_only_evidence_ids"), F.when(said, "explicit").when(sighted | next_, "behaviorally_supported").otherwise("unknown").alias("certainty"),
        F.when(layer == "perception_access", F.when(F.coalesce("_seen", F.lit(False)), "direct_visual").otherwise("public_ui")).when(layer == "knowledge_state", "known_from_direct_observation").when(said, F.col("_said.utterance")).when(next_, F.col("_next.event_type")).alias("answer"),
        F.when(sighted, F.coalesce("observed_event_types", _none())).alias("observed_event_types"), F.when(next_, F.coalesce("_next.location", F.lit("unknown"))).alias("next_location"), F.when(next_, F.array_sort("_next.evidence_asset_ids")).alias("future_evidence_ids"),
    )


def _with_snapshot(rows: DataFrame, snaps: DataFrame) -> DataFrame:
    """The ego's last snapshot at the cutoff or before; empty lists where there is none."""
    s = snaps.select("game_id", F.col("target_player").alias("ego_player"), F.col("cutoff_abs_sec").alias("_at"), F.col("available_evidence_ids").alias("_have"))
    return joins.asof_join(rows, s, "cutoff_abs_sec", "_at", ["game_id", "ego_player"], order=["_at"]).withColumn("acceptable_evidence_ids", F.coalesce("_have", _none())).drop("_have", "_at")


def agentic_trials(ledger: dict[str, DataFrame], limit: int = 160, horizon: float = 180.0) -> DataFrame:
    """Midgame trials: the first max(1, limit // 4) of each family in order, numbered on over the families, `limit` in all.

    E asks what a hidden event was, F where its first viewer is halfway through it, G what happens next after a snapshot, H
    whether a claim is true and whether its hearer can know. The ego is the first player, by name, that qualifies.
    """
    events, said, edges, snaps, links = (ledger[k] for k in ("world_events", "claims", "visibility_edges", "belief_memory_snapshots", "claim_truth_links"))
    each = max(1, limit // 4)
    players = edges.select("game_id", "player_id").distinct()
    hidden = edges.where("visibility = 'not_visible'").select("game_id", F.col("event_id").alias("world_event_id"), F.col("player_id").alias("_p"))
    kind = text.event_category(F.col("event_type"), F.col("description"))
    known = events.join(players.groupBy("game_id").agg(F.collect_set("player_id").alias("_all")), "game_id").withColumn("_src", F.filter("source_povs", lambda p: F.array_contains("_all", p)))
    private = known.where(~F.col("phase_type").isin(*PUBLIC_PHASES) & (F.size("_src") > 0)).withColumn("category", kind)
    met = private.join(hidden, ["game_id", "world_event_id"])
    columns = ["game_id", "ego_player", "cutoff_abs_sec", "prediction_target", "gold", "forbidden_event_ids", "order_sec", "order_id", "family"]

    def first_ego(rows: DataFrame, family: int, cutoff: Column, target: Column) -> DataFrame:
        ego = rows.groupBy("game_id", "world_event_id").agg(F.min("_p").alias("ego_player"))
        return private.join(ego, ["game_id", "world_event_id"]).select("game_id", "ego_player", cutoff.alias("cutoff_abs_sec"), target.cast("string").alias("prediction_target"), F.col("category").alias("gold"), F.array("world_event_id").alias("forbidden_event_ids"), F.col("abs_start_sec").alias("order_sec"), F.col("world_event_id").alias("order_id"), F.lit(family).alias("family"))

    e = first_ego(met.where(~F.array_contains("_src", F.col("_p"))), 0, F.col("abs_end_sec") + 3.0, F.lit("hidden_world_state"))
    f = first_ego(met.where(F.col("_p") != F.get("_src", 0)), 1, (F.col("abs_start_sec") + F.col("abs_end_sec")) / 2, F.get("_src", 0))

    ego = snaps.join(players, (snaps["game_id"] == players["game_id"]) & (snaps["target_player"] == players["player_id"]), "left_semi").select("game_id", F.col("target_player").alias("ego_player"), "cutoff_abs_sec", "snapshot_id")
    parts = F.filter(F.concat("actors", "source_povs"), lambda p: F.array_contains("_all", p))
    acting = known.withColumns({"_who": parts, "category": kind}).where(F.size("_who") > 0).select("game_id", "_who", "category", "world_event_id", F.col("abs_start_sec").alias("_es"))
    future = joins.range_join(ego.withColumn("_to", F.col("cutoff_abs_sec") + horizon), acting, ("cutoff_abs_sec", "_to"), ("_es", "_es"), horizon, ["game_id"]).where(F.col("_es") > F.col("cutoff_abs_sec"))
    future = future.withColumn("_other", F.get(F.filter("_who", lambda p: p != F.col("ego_player")), 0)).where("_other is not null")
    next_ = joins.first_per(future, ["snapshot_id", "game_id"], ["_es", "world_event_id"])
    g = next_.select("game_id", "ego_player", "cutoff_abs_sec", F.col("_other").cast("string").alias("prediction_target"), F.col("category").alias("gold"), F.array("world_event_id").alias("forbidden_event_ids"), F.col("cutoff_abs_sec").alias("order_sec"), F.col("snapshot_id").alias("order_id"), F.lit(2).alias("family"))

    told = links.where(F.col("truth_status_global").isin(*TRUTHS)).join(said.select("game_id", "claim_id", "speaker", "heard_by", F.col("abs_end_sec").alias("_ce")), ["game_id", "claim_id"]).join(players.groupBy("game_id").agg(F.collect_set("player_id").alias("_all")), "game_id")
    told = told.withColumn("ego_player", F.get(F.filter("heard_by", lambda p: F.array_contains("_all", p)), 0)).where("ego_player is not null")
    pairs = told.select("game_id", "claim_truth_link_id", "ego_player", F.explode("world_event_ids").alias("world_event_id")).join(hidden.withColumnRenamed("_p", "ego_player"), ["game_id", "world_event_id", "ego_player"], "left_semi")
    unseen = pairs.groupBy("game_id", "claim_truth_link_id").agg(F.array_sort(F.collect_set("world_event_id")).alias("_hid"))
    h = told.join(unseen, ["game_id", "claim_truth_link_id"], "left").select("game_id", "ego_player", (F.col("_ce") + 1.0).alias("cutoff_abs_sec"), F.col("speaker").cast("string").alias("prediction_target"), F.col("truth_status_global").alias("gold"), F.coalesce("_hid", _none()).alias("forbidden_event_ids"), F.lit(0.0).alias("order_sec"), F.col("claim_truth_link_id").alias("order_id"), F.lit(3).alias("family"))

    parts = [rows.select(*columns).orderBy("order_sec", "order_id").limit(each) for rows in (e, f, g, h)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    n = F.row_number().over(Window.orderBy("family", "order_sec", "order_id"))  # `limit` rows
    named = every.withColumns({"_n": n, "probe_family": F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), F.col("family") + 1)}).where(F.col("_n") <= limit)
    named = named.withColumn("trial_id", F.format_string("%s_amp_%06d", F.col("game_id").cast("string"), "_n"))
    return _with_snapshot(named, snaps).withColumn("cutoff_abs_sec", F.round("cutoff_abs_sec", 2)).drop("_n", "order_sec", "order_id", "family")


def accessible(events: DataFrame, targets: DataFrame, public_types: Sequence[str], most_seen: int = 4, most_hidden: int = 4) -> DataFrame:
    """What a target may use of a game's merged events: the best seen, heard or public ones, and references to the first hidden.

    events: game_id, global_event_id, event_type, visible_to, heard_by, certainty, needs_human_review, seq; targets: game_id,
    target_player. Best: what needs review first, then the most certain, then by place.
    """
    met = targets.join(events, "game_id")
    open_ = F.array_contains(F.coalesce("visible_to", _none()), F.col("target_player")) | F.array_contains(F.coalesce("heard_by", _none()), F.col("target_player")) | F.lower(F.coalesce("event_type", F.lit(""))).isin(*public_types)
    rows = met.withColumn("_open", open_).withColumn("_review", F.coalesce("needs_human_review", F.lit(False)).cast("int"))
    w = Window.partitionBy("game_id", "target_player", "_open").orderBy(F.when(F.col("_open"), -F.col("_review")), F.when(F.col("_open"), -F.coalesce("certainty", F.lit(0.0))), "seq")
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.when(F.col("_open"), F.col("_r") <= most_seen).otherwise(F.col("_r") <= most_hidden))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("_r", "global_event_id")))), lambda x: x["global_event_id"])
    return top.groupBy("game_id", "target_player").agg(ids(F.col("_open")).alias("visible_or_public"), ids(~F.col("_open")).alias("hidden_refs"))
