"""Probe groups and review candidates: predicates, scores, star joins, and one builder for the templates of groups.

Scores put smaller first where a docstring says "least first", else larger. Players come as a literal or column array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import joins, selection, windows
from tidewright.plans.checks import codes
from tidewright.plans.ledger import after_warmup

# Types, words and priorities of review candidates.
ROUTE_TYPES = ("movement", "player_movement", "task", "task_completion", "gameplay")
ROUTE_NOISE = ("开始", "寻找目标", "周围有其他角色", "地图上", "声称", "击中", "倒下")
PLACES = ("街道", "下水道", "学校", "实验室", "游戏厅", "警署", "餐厅", "电站", "公园", "大厅")
CRITICAL_TYPES = ("interaction", "player_interaction", "combat", "death", "player_death")
MOVES = ("movement", "player_movement")
REVEAL_WORDS = ("死", "死亡", "尸体", "击杀", "杀", "刀", "倒地", "血", "kill", "killed", "death", "body")
OWN_KILLS = ("我杀", "我刀", "我击杀", "一刀下去")
SAID_KILLS = ("我杀", "我刀", "我击杀", "I killed")
DEATHS = ("死亡", "尸体", "killed", "death")
KILL_WORDS = ("杀", "刀", "死", "尸体", "击杀")
TEMPLATE_PRIORITY = {"contradicted_alibi": 50, "vote_influence": 45, "delayed_public_reveal": 42, "private_witness": 38, "hidden_event_awareness": 30}
QUERY_TYPES = {"contradicted_alibi": "claim_truth_vs_claim_awareness", "claim_backed_hidden_event": "claim_truth_vs_claim_awareness", "route_hidden_event": "route_belief", "private_witness": "private_witness", "vote_influence": "trust_update", "delayed_public_reveal": "delayed_public_reveal"}
# End of fixed values.


def _none() -> Column:
    return F.array().cast("array<string>")


def is_route_event(players: Column) -> Column:
    """A sure, plainly described move of one player through a known place, after the warm-up of a gameplay phase."""
    said = text.stripped(F.col("description"))
    plain = ~text.contains_any(F.lower(said), text.BAD_DESCRIPTION) & ~text.contains_any(F.lower(said), text.CRITICAL_DESCRIPTION) & ~text.contains_any(said, ROUTE_NOISE)
    named = F.exists(players, lambda p: F.contains(said, p)) & text.contains_any(said, PLACES)
    sure = (F.coalesce("certainty", F.lit(0.0)) >= 0.8) & ~F.coalesce("needs_human_review", F.lit(False))
    return F.coalesce((F.col("phase_type") == "gameplay") & after_warmup() & F.col("event_type").isin(*ROUTE_TYPES) & (F.size("source_povs") == 1) & sure & plain & named, F.lit(False))


def heard_before_cutoff(target: Column, cutoff: Column) -> Column:
    """Of a claim: whether the target heard it and it was over by the cutoff."""
    return F.coalesce(F.array_contains("heard_by", target), F.lit(False)) & (F.col("abs_end_sec") <= cutoff)


def speaker_grounds(speaker: Column, direct: Column, actors: Column, description: Column) -> Column:
    """Whether a claim's speaker saw the event, or acts in it without being its victim."""
    dead = F.contains(description, F.concat(speaker, F.lit("的角色倒地"))) | F.contains(description, F.concat(speaker, F.lit(" 被杀"))) | F.contains(description, F.concat(speaker, F.lit("的尸体")))
    return F.coalesce(F.array_contains(direct, speaker), F.lit(False)) | (F.coalesce(F.array_contains(actors, speaker), F.lit(False)) & ~F.coalesce(dead, F.lit(False)))


def links_by_event(links: DataFrame) -> DataFrame:
    """Links turned round: a row for each event that a link names."""
    return links.select("*", F.explode("world_event_ids").alias("world_event_id")).drop("world_event_ids")


def reveals(event: str, claim: str, players: Column) -> Column:
    """Whether a claim (a struct) can be about an event (a struct): a word of death, and a name both have; not the victim's own kill.

    Without any name in the event, a plain report of a death is enough.
    """
    e, c = (lambda k: F.col(f"{event}.{k}")), (lambda k: F.col(f"{claim}.{k}"))
    said = text.stripped(F.concat_ws(" ", c("content"), c("normalized_content")))
    told = text.stripped(F.concat_ws(" ", e("description"), e("location")))
    speaker = F.coalesce(c("speaker"), F.lit(""))
    victim = (speaker != "") & (F.contains(told, F.concat(speaker, F.lit(" 被"))) | F.contains(told, F.concat(speaker, F.lit("的角色被"))) | F.contains(told, F.concat(speaker, F.lit(" 的角色在"))))
    names = F.array_distinct(F.filter(F.concat(*[F.coalesce(e(k), _none()) for k in ("actors", "patients", "source_povs")], text.mentioned(told, players)), lambda n: F.coalesce(n, F.lit("")) != ""))
    named = F.exists(names, lambda n: F.contains(said, n)) | ((speaker != "") & F.array_contains(names, speaker) & text.contains_any(said, SAID_KILLS))
    return ~(victim & text.contains_any(said, OWN_KILLS)) & text.contains_any(F.lower(said), REVEAL_WORDS) & F.when(F.size(names) > 0, named).otherwise(text.contains_any(said, DEATHS))


def claim_event_score(gap: Column, confidence: Column, truth: Column, claim_type: Column, event_type: Column, target: Column, favoured: Sequence[str] = ()) -> Column:
    """Least first: a claim about twenty seconds after the event, a sure link, a place or a defence, a move."""
    score = F.abs(gap - 20.0) / 10.0 - F.coalesce(confidence, F.lit(0.0)) * 5.0 + F.when(truth == "supported", 1.0).otherwise(0.0)
    score = score - F.when(claim_type.isin("location", "defense"), 4.0).otherwise(0.0) - F.when(event_type.isin(*MOVES), 2.0).otherwise(0.0)
    return score - F.when(target.isin(*favoured), 0.5).otherwise(0.0) if favoured else score


def hidden_event_score(event_type: Column, direct: Column, hidden: Column, start: Column) -> Column:
    """Least first: critical events, moves, hidden from many, seen by one, early."""
    base = F.when(event_type.isin(*CRITICAL_TYPES), -8.0).otherwise(0.0) - F.when(event_type.isin(*MOVES), 2.0).otherwise(0.0)
    return base - F.least(hidden, F.lit(5)) + F.abs(direct - 1) * 3.0 + F.coalesce(start, F.lit(0.0)) / 100000.0


def reveal_score(delay: Column, speaker: Column, claim_type: Column, said: Column, players: Column) -> Column:
    """Largest first: a known speaker, an accusation or a sighting, a name, a word of death, 45 to 240 seconds later."""
    one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
    return one(F.array_contains(players, speaker), 5.0) + one(claim_type.isin("accusation", "sighting"), 3.0) + one(F.exists(players, lambda p: F.contains(said, p)), 2.0) + one(text.contains_any(said, KILL_WORDS), 2.0) + one(delay.between(45, 240), 2.0)


def review_scores(groups: DataFrame, links: DataFrame) -> DataFrame:
    """`score` of each group for the review queue: its template, claims, hidden events, review flag, and the links of its claims."""
    worth = F.when(F.col("truth_status_global") == "contradicted", 18).when(F.col("truth_status_global") == "ambiguous", 10).when(F.col("truth_status_global") == "supported", 4).otherwise(0) + F.when(F.col("needs_human_review"), 4).otherwise(0)
    by_claim = links.groupBy("claim_id").agg(F.sum(worth).alias("_w"))
    told = groups.select("probe_group_id", F.explode("related_claim_ids").alias("claim_id")).join(by_claim, "claim_id").groupBy("probe_group_id").agg(F.sum("_w").alias("_w"))
    base = F.lit(10)
    for name, value in TEMPLATE_PRIORITY.items():
        base = F.when(F.col("template") == name, value).otherwise(base)
    own = base + F.least(F.size("related_claim_ids"), F.lit(8)) + F.when(F.size("hidden_event_ids_for_target") > 0, 8).otherwise(0) + F.when(F.col("needs_human_review"), 4).otherwise(0)
    return groups.join(told, "probe_group_id", "left").withColumn("score", (own + F.coalesce("_w", F.lit(0))).cast("bigint")).drop("_w")


def direct_and_hidden(edges: DataFrame) -> DataFrame:
    """game_id, world_event_id, direct, hidden: sorted players of each event by visibility."""
    who = lambda v: F.array_sort(F.collect_set(F.when(F.col("visibility") == v, F.col("player_id"))))
    return edges.groupBy("game_id", F.col("event_id").alias("world_event_id")).agg(who("direct_visual").alias("direct"), who("not_visible").alias("hidden"))


def claim_truth_candidates(links: DataFrame, claims: DataFrame, events: DataFrame, edges: DataFrame, truth: str | None = None, skipped: DataFrame | None = None, longest: float = 240.0, each: int = 2, limit: int | None = None) -> DataFrame:
    """Events with a claim that ended one second to `longest` later, seen by some and hidden from a hearer: a row a target.

    The first `each` hidden hearers of an (event, claim) count; `limit` keeps the least by score. skipped: world_event_id, claim_id.
    """
    wanted = links if truth is None else links.where(F.col("truth_status_global") == truth)
    star = links_by_event(wanted.select("game_id", "claim_truth_link_id", "claim_id", "truth_status_global", F.col("confidence").alias("link_confidence"), "world_event_ids"))
    star = star.join(claims.select("game_id", "claim_id", "speaker", "claim_type", "heard_by", F.col("abs_end_sec").alias("claim_end")), ["game_id", "claim_id"])
    star = star.join(events.select("game_id", "world_event_id", "event_type", F.col("abs_end_sec").alias("event_end")), ["game_id", "world_event_id"])
    gap = F.col("claim_end") - F.col("event_end")
    star = star.withColumn("gap_sec", gap).where((gap > 1.0) & (gap <= longest)).join(direct_and_hidden(edges), ["game_id", "world_event_id"]).where(F.size("direct") > 0)
    if skipped is not None:
        star = star.join(skipped, ["world_event_id", "claim_id"], "left_anti")
    if truth == "supported":
        star = star.where(F.array_contains("direct", F.col("speaker")))
    targets = F.slice(F.filter("hidden", lambda p: F.array_contains("heard_by", p)), 1, each)
    rows = star.select("*", F.explode(targets).alias("target")).withColumn("source", F.get("direct", 0))
    rows = rows.withColumn("score", claim_event_score(F.col("gap_sec"), F.col("link_confidence"), F.col("truth_status_global"), F.col("claim_type"), F.col("event_type"), F.col("target")))
    return rows if limit is None else rows.orderBy("score", "world_event_id", "claim_id", "target").limit(limit)


def skip_list(*tables: DataFrame) -> DataFrame:
    """Distinct event ids that several tables name, under event_id, anchor_event_id, or ahead of a colon in cluster_key."""
    parts = []
    for t in tables:
        named = [F.col(c) for c in ("event_id", "anchor_event_id") if c in t.columns]
        named += [F.split_part("cluster_key", F.lit(":"), F.lit(1))] if "cluster_key" in t.columns else []
        parts.append(t.select(F.explode(F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in named]))).alias("world_event_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def hidden_event_candidates(events: DataFrame, edges: DataFrame, used: DataFrame, each: int = 2, limit: int | None = None) -> DataFrame:
    """Events seen by some and hidden from some that no list (`used`: world_event_id) has: a row for each of the first hidden players."""
    fresh = events.join(used.select("world_event_id").distinct(), "world_event_id", "left_anti").join(direct_and_hidden(edges), ["game_id", "world_event_id"]).where((F.size("direct") > 0) & (F.size("hidden") > 0))
    rows = fresh.select("*", F.explode(F.slice("hidden", 1, each)).alias("target")).withColumns({
        "source": F.get("direct", 0), "score": hidden_event_score(F.col("event_type"), F.size("direct"), F.size("hidden"), F.col("abs_start_sec")), "template_suggestion": F.when(F.col("event_type").isin(*CRITICAL_TYPES), "critical_hidden_event").otherwise("route_hidden_event"),
    })
    return rows if limit is None else rows.orderBy("score", "world_event_id", "target").limit(limit)


def semantic_key(with_template: bool = True) -> Column:
    """What makes two groups the same question: target, anchors, claims, query type and, if asked, the template."""
    parts = [F.col("target_player"), F.col("anchor_event_ids"), F.col("related_claim_ids"), F.col("query_type")]
    return F.struct(*parts, F.col("template")) if with_template else F.struct(*parts)


def accepted_records(records: DataFrame, order: Sequence[str], decision: str = "accept_human_verified") -> DataFrame:
    """The first accepting record of each (review record, group)."""
    return joins.first_per(records.where(F.col("gate_decision") == decision), ["review_record_id", "probe_group_id"], order)


def drop_reasons() -> Column:
    """Why a group can't be asked: a target that has neither evidence nor a claim, and worse so for mere awareness."""
    bare = (F.size(F.coalesce("available_evidence_ids_for_target", _none())) == 0) & (F.size(F.coalesce("related_claim_ids", _none())) == 0)
    return codes([("no_target_available_evidence_or_related_claim", bare), ("weak_hidden_event_awareness_without_partial_information", bare & (F.col("template") == "hidden_event_awareness"))])


def hidden_template(event_type: Column) -> Column:
    return F.when(event_type.isin(*MOVES), "route_hidden_event").when(event_type.isin(*CRITICAL_TYPES), "critical_hidden_event").otherwise("hidden_event_awareness")


def build_groups(rows: DataFrame, template: Column, prefix: str, order: Sequence[str]) -> DataFrame:
    """Groups of any template from (event, target) rows, numbered in order.

    rows: game_id, target_player, `event` (struct with world_event_id, abs_end_sec, description, certainty, source_segment_ids), and
    `claims` (array of structs with claim_id, abs_start_sec, abs_end_sec, certainty; empty where none), `truth`. A group about
    claims is asked two seconds after the first of them, others three seconds after the event; a later reveal is no evidence.
    """
    r = selection.with_position(rows.withColumn("template", template), order, "_n")
    t = F.col("template")
    ids = F.transform("claims", lambda c: c["claim_id"])
    later, witness = t == "delayed_public_reveal", t == "private_witness"
    told = ~later & (F.size("claims") > 0)
    sure = F.coalesce("event.certainty", F.lit(0.85))
    claim_sure = F.coalesce(F.array_min(F.transform("claims", lambda c: F.coalesce(c["certainty"], F.lit(0.85)))), F.lit(0.85))
    query = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in QUERY_TYPES.items() for x in kv]), t), F.lit("hidden_event_awareness"))
    listens = told & t.isin("contradicted_alibi", "claim_backed_hidden_event", "vote_influence")
    families = F.array_compact(F.array(
        F.lit("false_belief"), F.lit("representational_change"), F.when(told, "claim_verification"), F.when(witness | told, "perspective_taking"), F.when(witness, "private_witness"), F.when(t == "vote_influence", "strategy_communication"), F.when(later, "delayed_public_reveal"),
    ))
    return r.select(
        F.concat(F.lit(f"{prefix}_"), F.lpad((F.col("_n") + 1).cast("string"), 6, "0"), F.lit("_"), F.col("target_player").cast("string")).alias("probe_group_id"), "game_id", F.col("event.source_segment_ids").alias("source_segment_ids"), "target_player",
        F.when(listens, F.get("claims", 0)["abs_end_sec"] + 2.0).otherwise(F.col("event.abs_end_sec") + 3.0).alias("cutoff_abs_sec"), query.alias("query_type"), F.array("event.world_event_id").alias("anchor_event_ids"),
        F.when(later, _none()).otherwise(ids).alias("related_claim_ids"), F.when(later, ids).otherwise(_none()).alias("later_public_claim_ids"), F.when(later, F.array_min(F.transform("claims", lambda c: c["abs_start_sec"]))).alias("reveal_start_sec"),
        F.when(witness, _none()).otherwise(F.array("event.world_event_id")).alias("hidden_event_ids_for_target"), F.when(witness, F.array("event.world_event_id")).when(later, _none()).otherwise(ids).alias("available_evidence_ids_for_target"), families.alias("diagnostic_families"), "template",
        F.when(t == "vote_influence", claim_sure).when(F.col("truth").isin("supported", "contradicted"), 0.8).when(told, 0.65).otherwise(0.6).alias("claim_truth_confidence"), F.when(listens, F.least(sure, claim_sure)).otherwise(sure).alias("timestamp_confidence"), F.lit(True).alias("needs_human_review"),
    )


def meeting_windows(meetings: DataFrame, start: str, end: str, size: float, overlap: float, least: float = 2.0) -> DataFrame:
    """Windows over a meeting every size - overlap seconds, ceil((length - overlap) / step) of them; those under `least` seconds go."""
    return windows.sliding(meetings, start, end, size, overlap, least)


def phase_tasks(rows: DataFrame, preferred: Column) -> DataFrame:
    """Rows of a phase as one task: the player to look through is the first preferred that is there, the others are context."""
    got = rows.groupBy("phase_id").agg(F.array_sort(F.collect_set("player_id")).alias("_all"))
    main = selection.prefer(F.col("_all"), preferred)
    return got.select("phase_id", main.alias("primary_player"), F.array_except("_all", F.array(main)).alias("context_players"))


def filled_annotations(phases: DataFrame, povs: DataFrame, annotations: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Every phase and view of a game with its annotation, or the defaults and `missing`, where there is none."""
    grid = phases.join(povs, "game_id")
    out = grid.join(annotations.withColumn("_has", F.lit(True)), ["phase_id", "player_id"], "left")
    return out.withColumns({**{c: F.when(F.col("_has"), F.col(c)).otherwise(d) for c, d in defaults.items()}, "missing": F.col("_has").isNull()}).drop("_has")


def static_review_rows(trials: DataFrame, gold: DataFrame, hidden: DataFrame) -> DataFrame:
    """Trials whose gold and hidden gold are there too, with the sorted union of acceptable evidence; `complete` is false for
    an id that one of the three lacks."""
    g, h = (t.select("trial_id", F.col("acceptable_evidence_ids").alias(n), F.lit(True).alias(f"_{n}")) for t, n in ((gold, "g"), (hidden, "h")))
    out = trials.withColumn("_t", F.lit(True)).join(g, "trial_id", "full_outer").join(h, "trial_id", "full_outer")
    whole = F.col("_t").isNotNull() & F.col("_g").isNotNull() & F.col("_h").isNotNull()
    return out.withColumns({"available_evidence_ids": F.array_sort(F.array_union(F.coalesce("g", _none()), F.coalesce("h", _none()))), "complete": whole}).drop("_t", "_g", "_h", "g", "h")


def kept_of(tables: dict[str, DataFrame], accepted: DataFrame, key: str) -> dict[str, DataFrame]:
    """The rows of each table whose key is accepted."""
    ids = accepted.select(key).distinct()
    return {n: t.join(ids, key, "left_semi") for n, t in tables.items()}


def promote(base: DataFrame, accepted: Sequence[DataFrame], probes: DataFrame, hidden: DataFrame, key: str = "probe_group_id") -> DataFrame:
    """Base groups and, of accepted ones that have probes and hidden gold, those with new ids; the first of an id wins, and new
    ones are marked as promoted."""
    rows = base.withColumns({"_turn": F.lit(0), "promoted": F.lit(False)})
    for i, a in enumerate(accepted, 1):
        rows = rows.unionByName(a.join(probes.select(key).distinct(), key, "left_semi").join(hidden.select(key).distinct(), key, "left_semi").withColumns({"_turn": F.lit(i), "promoted": F.lit(True)}))
    return joins.first_per(rows, [key], ["_turn"]).drop("_turn")


def decided_rows(trials: DataFrame, decisions: DataFrame) -> DataFrame:
    """Trials with their decisions applied: rejected ones go, repaired ones take the final value; `issue` names what can't be:
    an accepted trial that isn't there, a decision without a final value, an id that the final value changes.

    decisions: trial_id, decision, final_id, final_value (nulls where an accepted trial stays as it is); trials: trial_id, value.
    """
    met = decisions.where("decision <> 'reject'").join(trials, "trial_id", "left")
    plain = (F.col("decision") == "accept") & F.col("final_value").isNull()
    issue = F.when(plain & F.col("value").isNull(), "accepted_without_candidate").when(~plain & F.col("final_value").isNull(), "no_final_value").when(~plain & (F.coalesce("final_id", "trial_id") != F.col("trial_id")), "changed_trial_id")
    return met.select("trial_id", "decision", F.when(issue.isNull(), F.when(plain, F.col("value")).otherwise(F.col("final_value"))).alias("value"), issue.alias("issue"))


def queue(records: DataFrame, decisions: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The review records whose decision leaves something to confirm, in order, projected."""
    return selection.with_position(records.where(F.col("decision").isin(*decisions)), order, "queue_index").select("queue_index", *columns)
