"""Model payloads to rows of known shape.

Rows carry the payload as `item` (VARIANT), its place as `index` (from 1), and what it was asked about as structs:
`segment` (dataset, game_id, segment_id, aligned_start_sec, aligned_end_sec, povs) and `pov`, a player's name, or
`clip` (clip_id, game_id, player_id, episode_id, phase_index, phase_type, source_clip_id, start_sec, end_sec).
Identity comes from those, never from the payload. The roster is a column or literal array of names, aliases a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import numbers, payload, text
from tidewright.operators import selection

# Enumerations and aliases of payload fields.
QUESTION_TYPES = ("first_order_belief", "second_order_belief", "hidden_information", "false_belief", "intent_inference", "knowledge_access", "belief_state")
PHASE_TYPES = ("discussion", "voting", "vote_result", "exile", "action", "body_report", "meeting_start", "unknown")
WINDOW_PHASES = ("gameplay", "meeting", "discussion", "voting", "vote_result", "exile", "body_report", "transition", "result", "dead_spectating", "lobby_or_loading", "unknown")
RISKS = ("low", "medium", "high")
MEMORY_ALIASES = {
    "gameplay_event": "direct_visual",
    "event": "direct_visual",
    "observation": "direct_visual",
    "direct_observation": "direct_visual",
    "visual": "direct_visual",
    "speech_claim": "heard_claim",
    "claim": "heard_claim",
    "utterance": "heard_claim",
    "public_event": "public_result",
    "vote": "public_result",
    "vote_result": "public_result",
    "meeting_result": "public_result",
    "self": "self_action",
    "self_observation": "self_action",
}
MEMORY_TYPES = ("direct_visual", "heard_claim", "public_result", "self_action", "inferred", "phase")
DECAY_ALIASES = {"stable": "active", "current": "active", "remembered": "active", "new": "active", "updated": "active", "outdated": "stale", "old": "stale", "conflicted": "contradicted"}
DECAY_STATUS = ("active", "stale", "contradicted")
DELTA_KEYS = {"add": ("add", "added"), "update": ("update", "updated"), "contradict": ("contradict", "contradicted"), "forget_low_confidence": ("forget_low_confidence", "removed", "forgotten")}
SPEECH_MARKS = ("会议", "发言", "说")
# End of fixed values.

ITEM = "item"


def context(rows: DataFrame) -> DataFrame:
    """Adds dataset, game_id, segment_id; player_id and source_pov too where rows have `pov`."""
    named = rows.withColumns({c: F.col(f"segment.{c}") for c in ("dataset", "game_id", "segment_id")})
    return named.withColumns({"player_id": F.col("pov"), "source_pov": F.array("pov")}) if "pov" in rows.columns else named


def timed(rows: DataFrame) -> DataFrame:
    """Adds local and absolute times of the payload's window, and `time_ok`, false where it leaves the segment or lacks a time."""
    s, e = F.col("segment.aligned_start_sec"), F.col("segment.aligned_end_sec")
    start, end = payload.number(ITEM, "local_start_sec", F.lit(None)), payload.number(ITEM, "local_end_sec", F.lit(None))
    out = context(rows).withColumn("_w", numbers.model_window(start, end, s, e))
    out = out.withColumns({"local_start_sec": F.col("_w.local_start"), "local_end_sec": F.col("_w.local_end")})
    ok = F.coalesce(numbers.local_window_ok(F.col("local_start_sec"), F.col("local_end_sec"), e - s), F.lit(False))
    return out.withColumns({"abs_start_sec": numbers.to_absolute(s, F.col("local_start_sec")), "abs_end_sec": numbers.to_absolute(s, F.col("local_end_sec")), "time_ok": ok}).drop("_w")


def _id(key: str, pattern: str, *parts: str) -> Column:
    """The payload's own id, else one made of the parts and the index."""
    made = F.format_string(pattern, *parts, "index")
    return F.coalesce(F.nullif(payload.string(ITEM, key), F.lit("")), made)


def _players(key: str, players: Column, aliases: dict[str, str]) -> Column:
    return text.normalize_players(payload.strings(ITEM, key), players, aliases)


def _player(value: Column, players: Column, aliases: dict[str, str], default: Column) -> Column:
    return F.coalesce(text.normalize_player(value, players, aliases), default)


def pov_events(rows: DataFrame, players: Column, aliases: dict[str, str]) -> DataFrame:
    """What one player's view shows: the actor is the player unless a known name is given; lists hold known names once."""
    return timed(rows).withColumns({
        "event_id": _id("event_id", "%s_%s_event_%03d", "segment_id", "player_id"),
        "actor": _player(payload.string(ITEM, "actor"), players, aliases, F.col("pov")), "speaker": text.normalize_player(payload.string(ITEM, "speaker"), players, aliases),
        "location": payload.filled(ITEM, "location"), "utterance": payload.string(ITEM, "utterance"), "claim_type": payload.string(ITEM, "claim_type"),
        "visible_players": _players("visible_players", players, aliases), "mentioned_players": _players("mentioned_players", players, aliases),
    })


_CLAIM = "struct<claim_id:string,speaker:string,claim_type:string,content:string,evidence:string,time_referred:string,certainty:string,mentioned_players:array<string>,subject_players:array<string>,object_players:array<string>,locations:array<string>>"


def utterances(rows: DataFrame, players: Column, aliases: dict[str, str]) -> DataFrame:
    """What is said: text and transcript stand in for each other; claims take speaker, evidence and certainty from it."""
    said, heard = payload.string(ITEM, "text"), payload.string(ITEM, "transcript")
    sure = payload.number(ITEM, "certainty", 0.5)
    out = timed(rows).withColumns({
        "utterance_id": _id("utterance_id", "%s_%s_utt_%03d", "segment_id", "player_id"), "text": F.when(payload.given(ITEM, "text"), said).otherwise(heard), "transcript": F.when(payload.given(ITEM, "transcript"), heard).otherwise(said),
        "speaker": _player(payload.string(ITEM, "speaker"), players, aliases, F.lit("unknown")), "speaker_confidence": payload.number(ITEM, "speaker_confidence", payload.number(ITEM, "certainty", 0.0)),
        "addressee": _players("addressee", players, aliases), "mentioned_players": _players("mentioned_players", players, aliases),
        "is_direct_observation": payload.flag(ITEM, "is_direct_observation", False), "is_speech_claim": payload.flag(ITEM, "is_speech_claim", True), "possible_intents": payload.strings(ITEM, "possible_intents"), "evidence": payload.string(ITEM, "evidence", ""),
    })
    out = out.withColumn("needs_human_review", payload.flag(ITEM, "needs_human_review", F.col("speaker") == "unknown"))
    names = lambda xs: text.normalize_players(xs, players, aliases)

    def claim(c: Column, i: Column) -> Column:
        own = F.format_string("%s_claim_%03d", "utterance_id", i + 1)
        evidence = F.coalesce(c["evidence"], F.col("evidence"))
        return F.struct(
            F.coalesce(c["claim_id"], own).alias("claim_id"), F.coalesce(text.normalize_player(c["speaker"], players, aliases), F.col("speaker")).alias("speaker"), text.short_text(c["claim_type"], 80).alias("claim_type"), text.short_text(c["content"], 160).alias("content"),
            text.short_text(evidence, 160).alias("evidence"), F.when(F.coalesce(c["time_referred"], F.lit("")) != "", text.short_text(c["time_referred"], 80)).alias("time_referred"), numbers.clamp(F.coalesce(c["certainty"].try_cast("double"), sure)).alias("certainty"),
            names(c["mentioned_players"]).alias("mentioned_players"), names(c["subject_players"]).alias("subject_players"), names(c["object_players"]).alias("object_players"), text.short_list(c["locations"], 6).alias("locations"),
        )

    return out.withColumn("claims", F.transform(payload.objects(ITEM, "claims", _CLAIM), claim))


def global_events(rows: DataFrame, players: Column, aliases: dict[str, str]) -> DataFrame:
    """Merged events of a segment: strings that stand for lists, `source_povs` and `actors` under their other names; an event
    without a source is laid to the segment's first view and goes to review."""
    involved = F.when(payload.given(ITEM, "involved_players"), _players("involved_players", players, aliases)).otherwise(_players("actors", players, aliases))
    actors = F.when(payload.given(ITEM, "actors"), _players("actors", players, aliases)).otherwise(_players("involved_players", players, aliases))
    source = F.when(payload.given(ITEM, "source_pov"), payload.listed(ITEM, "source_pov")).otherwise(payload.listed(ITEM, "source_povs"))
    out = timed(rows.drop("pov")).withColumn("_source", text.normalize_players(source, players, aliases))
    lost = F.size("_source") == 0
    lists = {c: text.short_list(payload.strings(ITEM, c), 6) for c in ("supporting_pov_event_ids", "supporting_utterance_ids", "related_claim_ids")}
    return out.withColumns({
        "global_event_id": _id("global_event_id", "%s_ge_%03d", "segment_id"), "target_player": payload.string(ITEM, "target_player", "global"), "source_pov": F.when(lost, F.slice("segment.povs", 1, 1)).otherwise(F.col("_source")),
        "actors": actors, "involved_players": involved, **{c: _players(c, players, aliases) for c in ("visible_to", "heard_by", "not_visible_to")}, **lists,
        "description": text.short_text(payload.string(ITEM, "description"), 160), "evidence": text.short_text(payload.string(ITEM, "evidence"), 160), "certainty": payload.clamped(ITEM, "certainty", 0.5),
        "is_direct_observation": payload.flag(ITEM, "is_direct_observation", True), "is_speech_claim": payload.flag(ITEM, "is_speech_claim", False), "conflict": payload.flag(ITEM, "conflict", False),
        "needs_human_review": lost | payload.flag(ITEM, "needs_human_review", False),
    }).drop("_source")


def candidate_trials(rows: DataFrame, players: Column, aliases: dict[str, str]) -> DataFrame:
    """Proposed trials with enumerations repaired, the target found in the texts, and the cutoff inside the segment."""
    out = context(rows.drop("pov"))
    own = F.coalesce(F.nullif(payload.string(ITEM, "trial_id"), F.lit("")), F.format_string("trial_%03d", "index"))
    asked = F.when(payload.string(ITEM, "question_type") == "belief_state", "first_order_belief").otherwise(payload.string(ITEM, "question_type"))
    known = F.coalesce(asked.isin(*QUESTION_TYPES), F.lit(False))
    said = F.concat_ws(" ", *[text.short_text(payload.string(ITEM, c), 200) for c in ("question", "answer", "expected_answer_basis")])
    named = F.get(text.mentioned(said, players), 0)
    cutoff = payload.number(ITEM, "cutoff_abs_sec", F.col("segment.aligned_end_sec"))
    inside = cutoff.between(F.col("segment.aligned_start_sec"), F.col("segment.aligned_end_sec"))
    source = F.when(payload.given(ITEM, "source_pov"), payload.listed(ITEM, "source_pov")).otherwise(payload.listed(ITEM, "source_povs"))
    out = out.withColumns({"_source": text.normalize_players(source, players, aliases), "_type": F.when(known, asked).otherwise("first_order_belief")})
    basis, answer, question = (text.short_text(payload.string(ITEM, c), n) for c, n in (("expected_answer_basis", 160), ("answer", 200), ("question", 200)))
    bare = F.coalesce(payload.string(ITEM, "evidence"), F.lit("")) == ""
    review = payload.flag(ITEM, "needs_human_review", False) | ~known | (F.size("_source") == 0) | bare
    caps = {"distractors": 4, "available_information": 6, "hidden_information": 6, "supporting_global_event_ids": 6, "supporting_information_state_ids": 6}
    out = out.withColumns({
        "trial_id": F.when(own.startswith(F.concat("segment_id", F.lit("_"))), own).otherwise(F.concat_ws("_", "segment_id", own)), "question_type": F.col("_type"),
        "trial_type": payload.string(ITEM, "trial_type"), "target_player": F.coalesce(text.normalize_player(payload.string(ITEM, "target_player"), players, aliases), named, F.get("segment.povs", 0)),
        "cutoff_abs_sec": F.when(inside, cutoff).otherwise(F.col("segment.aligned_end_sec")), "question": question, "answer": answer, "expected_answer_basis": basis, **{c: text.short_list(payload.strings(ITEM, c), n) for c, n in caps.items()},
        "source_pov": F.when(F.size("_source") == 0, F.col("segment.povs")).otherwise(F.col("_source")), "evidence": F.when(bare, text.short_text(basis, 160)).otherwise(text.short_text(payload.string(ITEM, "evidence"), 160)), "needs_human_review": review,
    })
    belief = F.when(payload.string(ITEM, "question_type") == "belief_state", "belief_state").otherwise(F.col("question_type"))
    risk = payload.string(ITEM, "risk_of_perspective_leakage")
    return out.withColumns({
        "trial_type": F.coalesce("trial_type", belief), "certainty": payload.clamped(ITEM, "certainty", F.when(F.col("needs_human_review"), 0.5).otherwise(0.7)),
        "risk_of_perspective_leakage": F.when(F.coalesce(risk.isin(*RISKS), F.lit(False)), risk).when(F.col("needs_human_review"), "medium").otherwise("low"),
    }).drop("_source", "_type")


def phase_events(rows: DataFrame, players: Column, aliases: dict[str, str]) -> DataFrame:
    """Phases that a segment shows; an unknown kind goes to review."""
    kind = payload.string(ITEM, "phase_type")
    ok = F.coalesce(kind.isin(*PHASE_TYPES), F.lit(False))
    povs = F.when(payload.given(ITEM, "evidence_povs"), payload.listed(ITEM, "evidence_povs")).otherwise(payload.listed(ITEM, "source_pov"))
    return timed(rows.drop("pov")).withColumns({
        "phase_event_id": _id("phase_event_id", "%s_phase_%03d", "segment_id"), "phase_type": F.when(ok, kind).otherwise("unknown"), "target_player": payload.string(ITEM, "target_player", "global"),
        "visible_to_all": payload.flag(ITEM, "visible_to_all", False), "evidence_povs": text.normalize_players(povs, players, aliases), "needs_human_review": ~ok | payload.flag(ITEM, "needs_human_review", False),
    })


def cutoff_stamp(rows: DataFrame, target: str = "target") -> DataFrame:
    """What a target can know of a segment is as of its end."""
    return context(rows.drop("pov")).withColumns({"target_player": F.col(target), "cutoff_abs_sec": F.col("segment.aligned_end_sec")})


def _clip_identity(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: F.col(f"clip.{c}") for c in names})


def _inside_clip(start: Column, end: Column, at_end: Column) -> tuple[Column, Column, Column]:
    """Start and end inside the clip, and whether they left an empty window, which then lasts a second or to the clip's end;
    one that begins at the clip's end begins at `at_end` instead."""
    lo, hi = F.col("clip.start_sec"), F.col("clip.end_sec")
    s, e = F.least(F.greatest(start, lo), hi), F.least(F.greatest(end, lo), hi)
    empty = e <= s
    begun = F.when(empty & (s >= hi), at_end).otherwise(s)
    return begun, F.when(empty, F.least(hi, begun + 1.0)).otherwise(e), empty


def clip_events(rows: DataFrame) -> DataFrame:
    """What a clip shows, with the clip's identity; a list of places is joined, a word of confidence has its value."""
    begun = payload.number(ITEM, "start_sec", F.col("clip.start_sec"))
    start, end, empty = _inside_clip(begun, payload.number(ITEM, "end_sec", F.col("clip.end_sec")), F.col("clip.start_sec"))
    late = empty & (begun >= F.col("clip.end_sec"))  # no room for a second: the whole clip
    place = F.when(payload.kind(ITEM, "location") == "array", F.array_join(payload.strings(ITEM, "location"), "、")).otherwise(payload.string(ITEM, "location"))
    return _clip_identity(rows, "clip_id", "game_id", "player_id", "episode_id", "phase_index", "phase_type", "source_clip_id").withColumns({
        "start_sec": start, "end_sec": F.when(late, F.col("clip.end_sec")).otherwise(end),
        "event_type": payload.string(ITEM, "event_type", "observation"), "description": payload.string(ITEM, "description", ""), "location": place,
        **{c: payload.strings(ITEM, c) for c in ("visible_players", "mentioned_players", "heard_by")}, **{c: payload.string(ITEM, c) for c in ("evidence", "speaker_id", "utterance", "visual_text_evidence_id")},
        "speaker_confidence": F.try_variant_get(ITEM, "$.speaker_confidence", "double"), **{c: payload.flag(ITEM, c) for c in ("dual_pass_consistent", "meeting_public", "public_ui")}, "confidence": payload.confidence(ITEM),
    })


def round_boundaries(rows: DataFrame, keep_own_view: bool = True) -> DataFrame:
    """Boundaries of rounds, inside the clip and at least a second long where it has room; an empty one goes to review.

    With `keep_own_view` the clip's player is among the views, and an empty window at the clip's end moves back a second.
    """
    lo, hi = F.col("clip.start_sec"), F.col("clip.end_sec")
    back = F.greatest(lo, hi - 1.0) if keep_own_view else hi
    start, end, empty = _inside_clip(payload.number(ITEM, "aligned_start_sec", lo), payload.number(ITEM, "aligned_end_sec", hi), back)
    views = F.when(payload.given(ITEM, "source_povs"), payload.strings(ITEM, "source_povs")).otherwise(F.array("clip.player_id"))
    own = F.array_union(views, F.array("clip.player_id")) if keep_own_view else views
    sure = payload.confidence(ITEM) if keep_own_view else payload.number(ITEM, "confidence", 0.0)
    return _clip_identity(rows, "clip_id", "game_id", "player_id").withColumns({
        "aligned_start_sec": start, "aligned_end_sec": end, "boundary_type": payload.string(ITEM, "boundary_type", "uncertain_boundary"), "evidence": payload.string(ITEM, "evidence", ""), "confidence": sure,
        "source_povs": own, "needs_review": empty | payload.flag(ITEM, "needs_review"),
    })


def sync_offsets(rows: DataFrame) -> DataFrame:
    """One offset a video: the first of a list's items stands for the list; `ok` is false where there is no object."""
    one = F.when(F.schema_of_variant("item").startswith("ARRAY"), F.try_variant_get("item", "$[0]", "variant")).otherwise(F.col(ITEM))
    out = rows.withColumn("item", one)
    return out.withColumns({"ok": F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)), "evidence": payload.string(ITEM, "evidence"), "raw_start_sec": F.try_variant_get(ITEM, "$.raw_start_sec", "double"), "confidence": payload.confidence(ITEM)})


def source_flags(rows: DataFrame, phase_type: str, public_types: Sequence[str]) -> DataFrame:
    """Where a gameplay event comes from: five flags with their defaults, and whether any was absent."""
    public = (F.col(phase_type) == "meeting") | F.lower(payload.filled(ITEM, "event_type", "")).isin(*public_types)
    defaults = {"direct_visual_observation": F.lit(True), "speech_claim": F.lit(False), "public_result": public, "inferred_belief": F.lit(False), "hidden_or_not_visible_information": F.lit(False)}
    whole = F.lit(True)
    for name in defaults:
        whole = whole & payload.given(ITEM, name)
    return rows.withColumns({**{n: F.when(payload.given(ITEM, n), payload.flag(ITEM, n)).otherwise(d) for n, d in defaults.items()}, "flags_added": ~whole})


def fallback_trace(rows: DataFrame) -> DataFrame:
    """A status event of up to five seconds for gameplay phases whose trace is empty; `item` is the phase's annotation.

    rows: item, player_id, aligned_start_sec, duration_sec."""
    empty = (payload.kind(ITEM, "gameplay_trace") != "array") | (F.size(F.coalesce(F.try_variant_get(ITEM, "$.gameplay_trace", "array<variant>"), F.array().cast("array<variant>"))) == 0)
    inner = lambda path: F.nullif(F.try_variant_get(ITEM, path, "string"), F.lit(""))
    evidence = F.coalesce(inner("$.player_status.death_evidence"), inner("$.private_memory[0].evidence"), F.lit("empty gameplay trace; the status event requires review"))
    end = F.least("duration_sec", F.lit(5.0))
    dead = F.coalesce(inner("$.player_status.alive_state") == "dead", F.lit(False))
    made = {
        "local_start_sec": F.lit(0.0), "local_end_sec": F.round(end, 3), "abs_start_sec": F.round("aligned_start_sec", 3), "abs_end_sec": F.round(F.col("aligned_start_sec") + end, 3),
        "event_type": F.when(dead, "spectator_or_status_observation").otherwise("visible_gameplay_status"), "actor": F.coalesce("player_id", F.lit("unknown")), "location": F.lit("unknown"),
        "description": F.coalesce(inner("$.private_memory[0].description"), evidence), "evidence": evidence, "certainty": F.lit(0.45), "needs_human_review": F.lit(True),
    }
    # Not a filter: that moves below the item, and there makes it anew for each field that it looks at.
    one = F.when(F.coalesce(empty, F.lit(True)), F.array(F.struct(*[c.alias(name) for name, c in made.items()])))
    return rows.select(*[c for c in rows.columns if c not in made], F.inline(one))


def leakage_risk(value: Column) -> Column:
    """high, medium, low or unknown of a word in either language; other words stay, in lower case."""
    word = F.lower(text.stripped(F.coalesce(value, F.lit("unknown"))))
    return F.when((word == "high") | word.contains("高"), "high").when((word == "medium") | word.contains("中"), "medium").when(word.isin("low", "无", "none") | word.contains("低"), "low").when((word == "") | word.contains("未知"), "unknown").otherwise(word)


def _known_by(rows: DataFrame, evidence: str, width: int) -> DataFrame:
    """Evidence, certainty, source and review of a state that a target holds."""
    views = payload.listed(ITEM, "source_pov")
    sure = payload.clamped(ITEM, "certainty", 0.5)
    return rows.withColumns({
        "certainty": sure, "evidence": F.substring(payload.filled(ITEM, "evidence", evidence), 1, width), "source_pov": F.when(F.array_contains(views, F.col("target_player")), views).otherwise(F.array("target_player")),
        "needs_human_review": payload.flag(ITEM, "needs_human_review", sure < 0.5),
    })


def information_states(rows: DataFrame, target: str = "target") -> DataFrame:
    """What a target can know, in a fixed shape: lists of five at most, facts taken out of the map that holds them."""
    out = cutoff_stamp(rows, target)
    held = F.try_variant_get(ITEM, "$.available_information", "variant")
    inside = payload.kind(ITEM, "available_information") == "object"
    facts = {k: F.when(inside & ~payload.given(ITEM, k), payload.as_strings(held, k, 5)).otherwise(payload.as_strings(ITEM, k, 5)) for k in ("known_facts", "beliefs", "unknowns")}
    rest = {k: payload.as_strings(ITEM, k, 5) for k in ("private_observations", "public_information", "false_or_uncertain_beliefs")}
    out = out.withColumns({"available_information": payload.as_objects(ITEM, "available_information", 5, "summary"), "unknown_or_unseen_information": payload.as_objects(ITEM, "unknown_or_unseen_information", 5, "summary"), **facts, **rest})
    return _known_by(out, "有限视角投影摘要", 120)


_MEMORY = "struct<memory_id:string,memory_type:string,decay_status:string,visibility:string,first_observed_abs_sec:string,last_referenced_abs_sec:string,source_event_ids:array<string>,source_claim_ids:array<string>,needs_human_review:boolean>"


def _resolved(value: Column, aliases: dict[str, str], default: str) -> Column:
    word = F.lower(text.stripped(F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, word), word)


def memory_states(rows: DataFrame, target: str = "target") -> DataFrame:
    """A target's memory: kinds and states of decay resolved, times defaulted to the segment's, a map of changes as a list."""
    out = cutoff_stamp(rows, target)

    def item(m: Column, i: Column) -> Column:
        kind, decay = _resolved(m["memory_type"], MEMORY_ALIASES, "inferred"), _resolved(m["decay_status"], DECAY_ALIASES, "active")
        seen = F.lower(text.stripped(F.coalesce(m["visibility"], F.lit("private"))))
        odd = ~kind.isin(*MEMORY_TYPES) | ~decay.isin(*DECAY_STATUS)
        return F.struct(
            F.coalesce(m["memory_id"], F.format_string("%s_%s_memory_%03d", "segment_id", "target_player", i + 1)).alias("memory_id"), F.when(kind.isin(*MEMORY_TYPES), kind).otherwise("inferred").alias("memory_type"),
            F.when(decay.isin(*DECAY_STATUS), decay).otherwise("active").alias("decay_status"), F.when(seen.isin("private", "public"), seen).otherwise("private").alias("visibility"),
            F.coalesce(m["first_observed_abs_sec"].try_cast("double"), F.col("segment.aligned_start_sec")).alias("first_observed_abs_sec"), F.coalesce(m["last_referenced_abs_sec"].try_cast("double"), F.col("segment.aligned_end_sec")).alias("last_referenced_abs_sec"),
            F.coalesce(m["source_event_ids"], payload.nothing()).alias("source_event_ids"), F.coalesce(m["source_claim_ids"], payload.nothing()).alias("source_claim_ids"), (F.coalesce(m["needs_human_review"], F.lit(False)) | odd).alias("needs_human_review"),
        )

    delta = F.try_variant_get(ITEM, "$.memory_delta", "variant")
    changes = []
    for operation, keys in DELTA_KEYS.items():
        named = payload.nothing()
        for key in reversed(keys):
            named = F.when(payload.given(delta, key), payload.listed(delta, key)).otherwise(named)
        changes.append(F.transform(F.slice(named, 1, 12), _change(operation)))
    listed = F.coalesce(F.try_variant_get(ITEM, "$.memory_delta", "array<struct<operation:string,memory_id:string>>"), F.array().cast("array<struct<operation:string,memory_id:string>>"))
    return out.withColumns({"memory_items": F.transform(payload.objects(ITEM, "memory_items", _MEMORY), item), "memory_delta": F.when(payload.kind(ITEM, "memory_delta") == "object", F.concat(*changes)).otherwise(listed)})


def _change(operation: str) -> Callable[[Column], Column]:
    return lambda memory: F.struct(F.lit(operation).alias("operation"), memory.alias("memory_id"))


def forbidden_from_global(events: DataFrame, targets: DataFrame) -> DataFrame:
    """(game_id, target_player, hidden_event_id): events that a player neither saw nor heard; targets: game_id, target_player."""
    met = events.select("game_id", "global_event_id", "visible_to", "heard_by").join(targets, "game_id")
    known = F.array_contains(F.coalesce("visible_to", payload.nothing()), F.col("target_player")) | F.array_contains(F.coalesce("heard_by", payload.nothing()), F.col("target_player"))
    return met.where(~known).select("game_id", "target_player", F.coalesce("global_event_id", F.lit("unknown")).alias("hidden_event_id"))


_BELIEF = "struct<player:string,belief_type:string,type:string,content:string,confidence:string,certainty:string,evidence_for:array<string>,evidence_against:array<string>>"


def belief_items(item: Column, key: str, players: Column, most: int = 8) -> Column:
    """Beliefs about players: the player given, else the first whose name the text has; a confidence of 0.5 where none is."""

    def one(b: Column) -> Column:
        named = F.when(F.array_contains(players, b["player"]), b["player"]).otherwise(F.get(text.mentioned(F.coalesce(b["content"], F.to_json(b)), players), 0))
        sure = F.coalesce(F.nullif(F.coalesce(b["confidence"], b["certainty"]).try_cast("double"), F.lit(0.0)), F.lit(0.5))
        return F.struct(
            named.alias("player"), F.coalesce(F.nullif(b["belief_type"], F.lit("")), F.nullif(b["type"], F.lit("")), F.lit("unknown")).alias("belief_type"), F.substring(F.coalesce(b["content"], F.to_json(b)), 1, 120).alias("content"),
            F.coalesce(b["evidence_for"], payload.nothing()).alias("evidence_for"), F.coalesce(b["evidence_against"], payload.nothing()).alias("evidence_against"), numbers.clamp(sure).alias("confidence"),
        )

    return F.transform(F.slice(payload.objects(item, key, _BELIEF), 1, most), one)


def belief_states(rows: DataFrame, players: Column, forbidden: DataFrame, target: str = "target") -> DataFrame:
    """What a target believes; what it mustn't use is its own list, else every event of the game hidden from it."""
    out = cutoff_stamp(rows, target)
    hidden = forbidden.groupBy("game_id", "target_player").agg(F.array_sort(F.collect_set("hidden_event_id")).alias("_hidden"))
    out = out.join(hidden, ["game_id", "target_player"], "left")
    own = F.transform(F.slice(payload.as_objects(ITEM, "forbidden_information", 12, "hidden"), 1, 12), lambda x, i: F.format_string("hidden_%03d", i + 1))
    ids = F.transform(payload.objects(ITEM, "forbidden_information", "struct<hidden_event_id:string,event_id:string>"), lambda x: F.coalesce(F.nullif(x["hidden_event_id"], F.lit("")), F.nullif(x["event_id"], F.lit(""))))
    named = F.zip_with(ids, own, lambda a, b: F.coalesce(a, b))
    kept = F.when(payload.kind(ITEM, "forbidden_information") == "array", F.slice(named, 1, 12)).otherwise(own)
    out = out.withColumns({
        "knows": payload.as_objects(ITEM, "knows", 8, "belief"), "does_not_know": payload.as_objects(ITEM, "does_not_know", 8, "belief"), "believes_or_suspects": belief_items(ITEM, "believes_or_suspects", players),
        "forbidden_event_ids": F.when(F.size(kept) > 0, kept).otherwise(F.coalesce("_hidden", payload.nothing())),
    }).drop("_hidden")
    return _known_by(out, "belief state normalized from finite-view inputs", 160)


def compact_item(item: Column, widths: dict[str, int], lists: dict[str, int]) -> Column:
    """JSON of a payload's allowed keys: texts cut to their width, lists to their length; absent keys stay absent."""
    parts = [F.when(payload.given(item, k), F.substring(payload.string(item, k), 1, n)).alias(k) for k, n in widths.items()]
    parts += [F.when(payload.kind(item, k) == "array", F.slice(payload.strings(item, k), 1, n)).alias(k) for k, n in lists.items()]
    return F.to_json(F.struct(*parts))


def phase_annotations(rows: DataFrame) -> DataFrame:
    """An annotation of one phase and view in its fixed shape; rows: item, phase (struct), pov."""
    inner = lambda path: F.coalesce(F.try_variant_get(ITEM, path, "string"), F.lit("unknown"))
    size = lambda k: F.size(F.when(payload.kind(ITEM, k) == "array", F.try_variant_get(ITEM, f"$.{k}", "array<variant>")).otherwise(F.array().cast("array<variant>")))
    start, end = F.col("phase.aligned_start_sec"), F.col("phase.aligned_end_sec")
    return rows.select(
        "phase.game_id", "phase.phase_id", "phase.phase_type", F.col("pov").alias("player_id"), start.alias("aligned_start_sec"), end.alias("aligned_end_sec"), (end - start).alias("duration_sec"),
        F.struct(inner("$.player_status.alive_state").alias("alive_state"), F.try_variant_get(ITEM, "$.player_status.death_abs_sec", "double").alias("death_abs_sec"), inner("$.player_status.death_evidence").alias("death_evidence")).alias("player_status"),
        F.struct(*[inner(f"$.role_and_goal.{k}").alias(k) for k in ("role", "faction", "visible_goal", "evidence")]).alias("role_and_goal"),
        *[size(k).alias(f"n_{k}") for k in ("gameplay_trace", "utterances", "private_memory", "tom_questions")], payload.flag(ITEM, "needs_human_review").alias("needs_human_review"), "item",
    )


def phase_windows(rows: DataFrame, players: Column) -> DataFrame:
    """Windows of phases inside the segment, a second long at least; unknown phases and unsure ones go to review."""
    s0, s1 = F.col("segment.aligned_start_sec"), F.col("segment.aligned_end_sec")
    length = s1 - s0
    start = payload.number(ITEM, "local_start_sec", 0.0)
    out = context(rows).withColumns({"_s": start, "_e": payload.number(ITEM, "local_end_sec", F.least(length, start + 1.0))})
    absolute = F.col("_s").between(s0, s1) & F.col("_e").between(s0, s1) & (F.col("_e") > length)
    out = out.withColumns({c: numbers.clamp(F.when(absolute, F.col(c) - s0).otherwise(F.col(c)), 0.0, 1e12) for c in ("_s", "_e")})
    out = out.withColumns({c: F.least(length, c) for c in ("_s", "_e")}).withColumn("_x", F.when(F.col("_e") <= F.col("_s"), F.least(length, F.col("_s") + 1.0)).otherwise(F.col("_e")))
    kind = payload.filled(ITEM, "phase_type")
    known = kind.isin(*WINDOW_PHASES)
    sure = numbers.clamp(F.coalesce(F.nullif(payload.number(ITEM, "confidence", 0.5), F.lit(0.0)), F.lit(0.5)))
    out = out.withColumns({
        "window_event_id": F.format_string("%s_%s_phasewin_%03d", "segment_id", "player_id", "index"), "local_start_sec": F.when(F.col("_x") <= F.col("_s"), F.greatest(F.lit(0.0), F.col("_x") - 1.0)).otherwise(F.col("_s")), "local_end_sec": F.col("_x"),
        "phase_type": F.when(known, kind).otherwise("unknown"), "boundary_type": payload.filled(ITEM, "boundary_type", "none"), "player_alive_state": payload.filled(ITEM, "player_alive_state"), "location": F.substring(payload.filled(ITEM, "location"), 1, 120),
        "visible_players": F.filter(payload.strings(ITEM, "visible_players"), lambda p: F.array_contains(players, p)), **{c: payload.strings(ITEM, c) for c in ("key_visual_facts", "key_audio_claims")},
        **{c: payload.flag(ITEM, c) for c in ("direct_visual_observation", "speech_claim", "public_result", "inferred_belief")}, **{c: F.substring(payload.filled(ITEM, c), 1, n) for c, n in (("role_or_goal_clue", 160), ("death_or_body_clue", 160), ("evidence", 240))},
        "confidence": sure,
    }).drop("_s", "_e", "_x")
    review = payload.flag(ITEM, "needs_human_review") | (F.col("phase_type") == "unknown") | (F.col("confidence") < 0.55)
    return out.withColumns({"abs_start_sec": s0 + F.col("local_start_sec"), "abs_end_sec": s0 + F.col("local_end_sec"), "needs_human_review": review})


def meeting_utterances(events: DataFrame) -> DataFrame:
    """Clip events whose description tells of a meeting or of speech, as utterances."""
    return events.where(text.contains_any(F.col("description"), SPEECH_MARKS)).select("game_id", "player_id", "clip_id", "start_sec", "end_sec", F.col("player_id").alias("speaker_id"), F.col("description").alias("text"), "mentioned_players", F.col("event_type").alias("speech_act"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def global_fold(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Clip events as global ones, one to one, numbered in order."""
    rows = selection.with_position(events, order, "_n")
    involved = F.array_sort(F.array_distinct(F.concat(F.coalesce("visible_players", payload.nothing()), F.coalesce("mentioned_players", payload.nothing()))))
    return rows.select(F.format_string("ge_%06d", F.col("_n") + 1).alias("global_event_id"), "game_id", "start_sec", "end_sec", "event_type", "description", involved.alias("involved_players"), F.array("clip_id").alias("source_clip_ids"), F.array("player_id").alias("source_player_ids"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
