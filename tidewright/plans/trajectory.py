"""Perception rows to trajectory nodes, information states at cutoffs, and theory-of-mind trials with gold values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import answers, text
from tidewright.operators import accumulate, folds, joins, selection
from tidewright.plans.ledger import with_roster

# Event types.
VISUAL_TYPES = ("movement", "encounter", "task", "task_ui", "interaction", "meeting", "vote", "kill", "body_report", "action_outcome")
AUDIO_TYPES = ("utterance", "claim", "reaction", "accusation", "defense", "audio_cue")
PUBLIC_TYPES = ("meeting", "vote", "vote_result", "ejection", "action_outcome")
PLAYER_CENTRIC = ("movement", "task", "task_ui", "interaction")
INTERACTIVE_MARKERS = ("点击", "小游戏", "连线", "交互界面", "操作界面")
LAYERS = {
    "perception_access": ("movement", "encounter", "task", "task_ui", "interaction", "meeting", "vote", "kill", "body_report", "action_outcome", "utterance", "claim", "reaction", "accusation", "defense", "audio_cue"),
    "knowledge_state": ("encounter", "meeting", "vote", "kill", "body_report", "action_outcome", "utterance", "claim", "accusation", "defense"),
    "belief_and_false_belief": ("utterance", "claim", "accusation", "defense"),
    "intent_and_action_prediction": ("movement", "task", "task_ui", "interaction", "vote", "action_outcome"),
    "stance_trust_and_agreement": ("reaction", "accusation", "defense", "vote"),
}
RESULT_MARKERS = ("结算界面", "经验奖励", "获胜者奖励", "总经验", "胜利界面")
# End of fixed values.


def perception_event(rows: DataFrame, kind: str, speaker_least: float = 0.85) -> DataFrame:
    """Interactive screens taken for tasks become task_ui, result screens action_outcome; unsure speakers are dropped."""
    if kind == "audio":
        sure = F.coalesce("speaker_confidence", "confidence", F.lit(0.0)) >= speaker_least
        return rows.withColumns({c: F.when(sure, F.col(c)) for c in ("speaker_id", "utterance")})
    said = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("description", "evidence", "location")]))
    ui = F.when((F.col("event_type") == "task") & text.contains_any(said, INTERACTIVE_MARKERS), "task_ui").otherwise(F.col("event_type"))
    return rows.withColumn("event_type", ui).withColumn("event_type", F.when((F.col("event_type") == "task_ui") & text.contains_any(said, RESULT_MARKERS), "action_outcome").otherwise(F.col("event_type")))


def normalise(rows: DataFrame) -> DataFrame:
    """Both passes to one shape. rows: modality, player_id, event_type, start_sec, end_sec, public_ui, confidence, speaker_id,
    speaker_confidence, utterance, visible_players, mentioned_players, heard_by, meeting_public, visual_text_evidence_id,
    evidence_id, episode_id, phase_index, phase_type, location, description, seq."""
    visual = F.col("modality") == "visual"
    known = F.when(visual, F.col("event_type").isin(*VISUAL_TYPES)).otherwise(F.col("event_type").isin(*AUDIO_TYPES))
    ok = ~visual & F.col("speaker_id").isNotNull() & (F.coalesce("speaker_confidence", "confidence", F.lit(0.0)) >= 0.85) & (F.coalesce("utterance", F.lit("")) != "")
    none = F.array().cast("array<string>")
    sorted_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    return rows.withColumn("_ok", ok).withColumns({
        "event_type": F.when(known, F.col("event_type")).otherwise("unknown"), "visible_players": F.when(visual, sorted_set("visible_players")).otherwise(none),
        "mentioned_players": sorted_set("mentioned_players"), "heard_by": sorted_set("heard_by"), "location": F.when(visual, F.col("location")), "public_ui": F.coalesce("public_ui", F.lit(False)),
        "speaker_id": F.when(F.col("_ok"), F.col("speaker_id")), "utterance": F.when(F.col("_ok"), F.col("utterance")), "text_verified": F.coalesce("visual_text_evidence_id", F.lit("")) != "",
    })


def fuse(rows: DataFrame, episodes: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Trajectory nodes: rows fuse with the newest group whose first row is of equal kind, phase and signature and near in time.

    Audio needs equal speaker and words; what players see fuses only if public. Nodes are numbered before those outside
    every episode are dropped, so numbers have gaps.
    """
    n = normalise(rows)
    audio = F.when((F.col("modality") == "audio") & F.col("_ok"), F.concat_ws("\x01", "speaker_id", F.regexp_replace(F.lower(F.trim("utterance")), r"(?U)\s+", " ")))
    shared = F.when((F.col("modality") == "visual") & F.col("public_ui") & F.col("event_type").isin(*PUBLIC_TYPES), F.lit("public"))
    alone = F.concat(F.lit("row "), F.col("seq").cast("string"))  # fuses with nothing
    keyed = n.withColumn("_sig", F.coalesce(audio, shared, alone))
    key = {"_m": "modality", "_t": "event_type", "_ep": "episode_id", "_pi": "phase_index", "_pt": "phase_type"}
    flat = keyed.select(*[F.coalesce(F.col(v).cast("string"), F.lit("")).alias(k) for k, v in key.items()], "_sig", "start_sec", "seq")
    kept = folds.fuse_by_anchor(flat, [*key, "_sig"], "start_sec", "seq", ["start_sec", "seq"], tolerance)
    rows = keyed.drop("_sig").join(kept, "seq").withColumn("_turn", F.struct("start_sec", "seq"))
    first = lambda c: F.min_by(c, "_turn").alias(c)
    is_audio = F.col("modality") == "audio"
    flat_set = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    nodes = rows.groupBy("kept_id").agg(
        F.min("_turn").alias("_turn"), F.min("start_sec").alias("abs_start_sec"), F.max("end_sec").alias("abs_end_sec"),
        *[first(c) for c in ("modality", "event_type", "phase_index", "phase_type", "player_id", "location", "description", "utterance", "speaker_id")],
        flat_set("visible_players").alias("visible_players"), flat_set("mentioned_players").alias("mentioned_players"), F.array_sort(F.collect_set("player_id")).alias("source_povs"),
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_asset_ids"), F.min(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.every("public_ui").alias("_public"),
        F.count_if(is_audio).alias("_n_audio"), F.count_distinct(F.when(is_audio, F.col("player_id"))).alias("_ears"), F.bool_or(is_audio & F.col("text_verified")).alias("_verified"),
        F.bool_or(is_audio & F.coalesce("meeting_public", F.lit(False))).alias("_meeting"), F.collect_set(F.when(is_audio, F.col("player_id"))).alias("_ear_set"), flat_set(F.when(is_audio, F.col("heard_by")).otherwise(F.array().cast("array<string>"))).alias("_told"),
    )
    nodes = selection.with_position(nodes, ["_turn"], "node_index")
    admissible = F.when(F.col("_n_audio") > 0, (F.col("_ears") >= 2) | F.col("_verified"))
    meeting = (F.col("phase_type") == "meeting") & F.col("_meeting")
    none = F.array().cast("array<string>")
    public = F.col("event_type").isin(*PUBLIC_TYPES) & F.col("_public")
    heard = F.array_sort(F.array_union("_ear_set", F.when(meeting, F.col("_told")).otherwise(none)))
    nodes = nodes.withColumns({"public_ui": public, "global_fact": public, "audio_admissible": admissible, "meeting_public": meeting, "heard_by": F.when(admissible, heard).otherwise(none), "utterance": F.when(admissible, F.col("utterance")), "speaker_id": F.when(admissible, F.col("speaker_id"))})
    spans = episodes.select(F.col("episode_id"), F.col("abs_start_sec").alias("_es"), F.col("abs_end_sec").alias("_ee"))
    placed = joins.point_in_interval(nodes.withColumn("_at", F.col("_turn.start_sec")), spans, "_at", ("_es", "_ee"), [], "node_index", "episode_id", ["_es"])
    return placed.withColumn("trajectory_node_id", F.format_string("%s_node_%05d", "episode_id", "node_index")).drop("_turn", "kept_id", "_public", "_n_audio", "_ears", "_verified", "_meeting", "_ear_set", "_told", "_at", "_es", "_ee")


def access(player: Column, cutoff: Column) -> Column:
    """How a player has a node at a cutoff."""
    own = F.array_contains("source_povs", player)
    return (
        F.when(F.col("abs_start_sec") > cutoff, "post_cutoff").when(F.coalesce("public_ui", F.lit(False)), "public_ui")
        .when(own & ((F.col("modality") == "audio") | (F.coalesce("utterance", F.lit("")) != "")), "direct_audio").when(own, "direct_visual")
        .when(F.array_contains("heard_by", player) & F.coalesce("audio_admissible", F.lit(False)), "heard_claim")
        .when(F.coalesce("global_fact", F.lit(False)), "not_visible").otherwise("unknown")
    )


def _numbered(rows: DataFrame, item: str, number: str) -> tuple[DataFrame, DataFrame]:
    """(episode_id, item, number) with items numbered in their order within the episode, and (episode_id, all of them as an array)."""
    every = rows.where(F.col(item).isNotNull()).groupBy("episode_id").agg(F.array_sort(F.collect_set(item)).alias(f"{item}_all"))
    return every.select("episode_id", F.posexplode(f"{item}_all").alias(number, item)), every


def _had(nodes: DataFrame, players: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each player ever has: (episode_id, subject, access, at, node, evidence as numbers), and the ids behind the numbers.

    How a player has a node doesn't change with the cutoff but for nodes to come, so it is settled once for each node and player.
    """
    place, ids = _numbered(nodes, "trajectory_node_id", "node")
    each = nodes.select("episode_id", "trajectory_node_id", F.explode("evidence_asset_ids").alias("evidence_id")).distinct()
    mark, evidence_ids = _numbered(each, "evidence_id", "mark")
    marks = each.join(mark, ["episode_id", "evidence_id"]).groupBy("episode_id", "trajectory_node_id").agg(F.collect_set("mark").alias("evidence"))
    had = with_roster(nodes, players, "episode_id", "subject").withColumn("access", access(F.col("subject"), F.lit(float("inf"))))
    had = had.where(F.col("access").isin("direct_visual", "direct_audio", "public_ui", "heard_claim")).select("episode_id", "subject", "access", F.col("abs_start_sec").alias("cutoff_abs_sec"), "trajectory_node_id")
    had = had.join(place, ["episode_id", "trajectory_node_id"]).join(marks, ["episode_id", "trajectory_node_id"], "left")
    return had.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<int>"))).drop("trajectory_node_id"), ids, evidence_ids


def information_states(nodes: DataFrame, players: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """For each episode, player and cutoff (every node's end, unless given) the sorted ids known, public, heard, forbidden.

    Nodes and evidence go by number within their episode. What a player has grows with the cutoff and is carried along by
    `running_sets`; ids are put in at the end, and forbidden ones are those of the episode that are left over.
    """
    cutoffs = nodes.select("episode_id", F.col("abs_end_sec").alias("cutoff_abs_sec")).distinct() if cutoffs is None else cutoffs
    had, ids, evidence_ids = _had(nodes, players)
    one = lambda flag: F.when(flag, F.array("node")).otherwise(F.array().cast("array<int>"))
    public = F.col("access") == "public_ui"
    changes = had.select("episode_id", "subject", "cutoff_abs_sec", one(~public).alias("private_observations"), one(public).alias("public_history"), one(F.col("access") == "heard_claim").alias("heard_claims"), F.col("evidence").alias("available_evidence_ids"))
    sets = ("private_observations", "public_history", "heard_claims", "available_evidence_ids")
    asked = with_roster(cutoffs, players, "episode_id", "subject").where("cutoff_abs_sec is not null")
    states = accumulate.running_sets(asked, changes, ["episode_id"], ["subject"], "cutoff_abs_sec", sets).join(ids, "episode_id").join(evidence_ids, "episode_id", "left")
    named = lambda numbers, names: F.transform(numbers, lambda i: F.get(F.col(names), i))
    states = states.select(
        "episode_id", F.col("subject").alias("player_id"), "cutoff_abs_sec", *[named(F.col(c), "trajectory_node_id_all").alias(c) for c in sets[:3]], named(F.col("available_evidence_ids"), "evidence_id_all").alias("available_evidence_ids"), F.col("trajectory_node_id_all").alias("_all"),
    )
    states = states.withColumn("known_facts", F.sort_array(F.array_union("private_observations", "public_history"))).withColumn("forbidden_events", F.array_except("_all", "known_facts")).drop("_all")
    return states.withColumn("information_state_id", _state_id())


def state_keys(players: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(information_state_id, episode_id, player_id, cutoff_abs_sec) of the `information_states` at these cutoffs, without what is in them."""
    keys = with_roster(cutoffs, players, "episode_id", "player_id").where("cutoff_abs_sec is not null").select("episode_id", "player_id", "cutoff_abs_sec").distinct()
    return keys.withColumn("information_state_id", _state_id())


def _state_id() -> Column:
    return F.format_string("%s:%s:%.3f", "episode_id", "player_id", "cutoff_abs_sec")


def _stepped(nodes: DataFrame, keys: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with `_step`, the number of the first cutoff of their episode that isn't before them (null without a start; nodes after all
    cutoffs go), and (episode_id, player_id, `_last`, `_asked`): a player's states by chunks of `chunk` cutoffs."""
    steps = keys.select("episode_id", "cutoff_abs_sec").distinct().where("cutoff_abs_sec is not null")
    steps = steps.withColumn("_step", F.row_number().over(Window.partitionBy("episode_id").orderBy("cutoff_abs_sec")) - 1)
    first = accumulate.first_step(nodes.select("episode_id", F.col("abs_start_sec").alias("cutoff_abs_sec")), steps, ["episode_id"], "cutoff_abs_sec", "_step")
    numbered = nodes.join(first.withColumnRenamed("cutoff_abs_sec", "abs_start_sec"), ["episode_id", "abs_start_sec"], "left").where("_step is not null or abs_start_sec is null")
    asked = keys.select("episode_id", "player_id", "cutoff_abs_sec", "information_state_id").join(steps, ["episode_id", "cutoff_abs_sec"])
    asked = asked.groupBy("episode_id", "player_id", F.floor(F.col("_step") / chunk)).agg(F.max("_step").alias("_last"), F.collect_list(F.struct("_step", "cutoff_abs_sec", "information_state_id")).alias("_asked"))
    return numbered, asked.select("episode_id", "player_id", "_last", "_asked")


def _held(numbered: DataFrame, players: DataFrame) -> DataFrame:
    """(episode_id, subject, evidence_id, had): the first step at which a player has a piece of evidence, null without a time."""
    rows = numbered.select("episode_id", "_step", "abs_start_sec", "source_povs", "public_ui", "modality", "utterance", "heard_by", "audio_admissible", "global_fact", "evidence_asset_ids")
    had = with_roster(rows, players, "episode_id", "subject").where(access(F.col("subject"), F.lit(float("inf"))).isin("direct_visual", "direct_audio", "public_ui", "heard_claim"))
    had = had.select("episode_id", "subject", "_step", F.explode("evidence_asset_ids").alias("evidence_id")).where("evidence_id is not null")
    return had.groupBy("episode_id", "subject", "evidence_id").agg(F.min("_step").alias("had"))


def _by_state(lists: str) -> Column:
    """The ids of a list of (evidence_id, step) in order of id that count by the step of `_state`."""
    return F.transform(F.filter(lists, lambda x: x["step"] <= F.col("_state._step")), lambda x: x["evidence_id"])


def evidence_states(nodes: DataFrame, players: DataFrame, cutoffs: DataFrame, chunk: int = 256) -> DataFrame:
    """(information_state_id, player_id, cutoff_abs_sec, available_evidence_ids) as in `information_states`, for uses that need nothing else
    of a state. Episodes without nodes have states with nothing in them.
    """
    numbered, asked = _stepped(nodes, state_keys(players, cutoffs), chunk)
    held = _held(numbered, players).where("had is not null").groupBy("episode_id", F.col("subject").alias("player_id")).agg(F.array_sort(F.collect_list(F.struct("evidence_id", F.col("had").alias("step")))).alias("_held"))
    each = asked.join(held, ["episode_id", "player_id"], "left").select("player_id", "_held", F.explode("_asked").alias("_state"))
    return each.select("_state.information_state_id", "player_id", "_state.cutoff_abs_sec", F.coalesce(_by_state("_held"), F.array().cast("array<string>")).alias("available_evidence_ids"))


def layer_evidence(states: DataFrame, nodes: DataFrame, players: DataFrame, layers: dict[str, tuple[str, ...]] = LAYERS, chunk: int = 256) -> DataFrame:
    """Evidence of each (state, target, layer): of the layer's types, before the cutoff, open to the subject, about the target.

    `states` are those of `information_states` for these nodes and players, or their `state_keys`. A piece of evidence counts from the first
    cutoff at which the subject has it and a node of the layer about the target bears it. So a subject, target and layer have one list of
    ids, each with the number of that cutoff, and its states are made of it where they come out: no row of a state is shuffled.
    """
    rules = players.sparkSession.createDataFrame([(layer, t) for layer, types in layers.items() for t in types], "layer string, event_type string")
    numbered, asked = _stepped(nodes, states, chunk)
    own = F.when(F.col("event_type").isin(*PLAYER_CENTRIC), F.col("player_id"))
    about = F.explode(F.array_distinct(F.array_compact(F.concat(F.coalesce("visible_players", F.array()), F.coalesce("mentioned_players", F.array()), F.array(F.col("speaker_id"), own)))))
    typed = numbered.select("episode_id", "event_type", about.alias("target"), "_step", "evidence_asset_ids").join(F.broadcast(rules), "event_type")  # a rule table of a few dozen rows
    facts = typed.select("episode_id", "layer", "target", "_step", F.explode("evidence_asset_ids").alias("evidence_id")).where("evidence_id is not null").groupBy("episode_id", "layer", "target", "evidence_id").agg(F.min("_step").alias("borne"))
    listed = players.select(*[c for c in ("episode_id",) if c in players.columns], F.col("player_id").alias("target")).distinct()
    facts = facts.join(listed, listed.columns, "left_semi")
    changes = facts.join(_held(numbered, players), ["episode_id", "evidence_id"]).where("subject <> target").withColumn("step", F.greatest("borne", "had")).where("step is not null")
    lists = changes.groupBy("episode_id", F.col("subject").alias("player_id"), "target", "layer").agg(F.min("step").alias("_since"), F.array_sort(F.collect_list(F.struct("evidence_id", "step"))).alias("_list"))
    each = lists.join(asked, ["episode_id", "player_id"]).where("_last >= _since").select(F.col("player_id").alias("subject"), "target", "layer", "_list", "_since", F.explode("_asked").alias("_state")).where("_state._step >= _since")
    return each.select("_state.information_state_id", "subject", "target", "layer", "_state.cutoff_abs_sec", _by_state("_list").alias("evidence_ids"))


def subject_only(evidence: Column, target_available: Column) -> Column:
    """What the subject has and the target hasn't, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(evidence), target_available))


def next_behaviour(asks: DataFrame, nodes: DataFrame, row_id: str, horizon: float = 1e6) -> DataFrame:
    """The first node after each cutoff that involves the target: event type, place, evidence."""
    who = F.explode(F.array_distinct(F.array_compact(F.concat(F.array("player_id", "speaker_id"), "visible_players"))))
    involved = nodes.select("episode_id", who.alias("target"), F.col("abs_start_sec").alias("_ns"), F.col("event_type").alias("next_event_type"), F.coalesce("location", F.lit("unknown")).alias("next_location"), F.col("evidence_asset_ids").alias("future_evidence_ids"), "trajectory_node_id")
    first = Window.partitionBy("episode_id", "target").orderBy(F.desc("_t"), "_side", F.desc("trajectory_node_id")).rowsBetween(Window.unboundedPreceding, -1)
    item = F.struct("_ns", "next_event_type", "next_location", "future_evidence_ids")
    rows = involved.select("episode_id", "target", F.col("_ns").alias("_t"), F.lit(0).alias("_side"), "trajectory_node_id", item.alias("_item"), F.lit(None).cast(asks.schema[row_id].dataType).alias(row_id))
    ask = asks.select("episode_id", "target", F.col("cutoff_abs_sec").alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast("string").alias("trajectory_node_id"), F.lit(None).cast(rows.schema["_item"].dataType).alias("_item"), row_id)
    found = rows.unionByName(ask).withColumn("_next", F.last("_item", ignorenulls=True).over(first)).where("_side = -1 and _next is not null")
    return found.where(F.col("_next._ns") - F.col("_t") <= horizon).select(row_id, "_next.next_event_type", "_next.next_location", "_next.future_evidence_ids")


def trials(evidence: DataFrame, states: DataFrame, most: int = 4) -> DataFrame:
    """Four variants a group where evidence remains: the first `most` items, then without what the target has; with a split."""
    target = states.select(F.col("player_id").alias("target"), "cutoff_abs_sec", F.split_part("information_state_id", F.lit(":"), F.lit(1)).alias("episode_id"), F.col("available_evidence_ids").alias("_theirs"))
    rows = evidence.withColumns({"episode_id": F.split_part("information_state_id", F.lit(":"), F.lit(1)), "evidence_ids": F.slice("evidence_ids", 1, most)})  # what is left out doesn't move
    rows = rows.join(target, ["episode_id", "target", "cutoff_abs_sec"])
    rows = rows.withColumn("evidence_ids", subject_only(F.col("evidence_ids"), F.col("_theirs"))).where(F.size("evidence_ids") > 0)
    group = F.concat_ws(":", "information_state_id", "target", "layer")
    rows = rows.withColumn("probe_group_id", group).withColumn("split", answers.split_of(F.col("probe_group_id")))
    return rows.drop("_theirs").withColumn("variant", F.explode(F.array(*[F.lit(v) for v in "ABCD"]))).withColumn("trial_id", F.concat_ws(":", "probe_group_id", "variant"))
