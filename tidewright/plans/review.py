"""Reason-coded rules for proposed probes and review candidates. Inputs are joined rows; a rule list gives array<string>.

Claim-truth and delayed-reveal rows carry the event as `event` and the claim as `claim` (structs), with `target`, `truth` and
the target's `visibility` of the event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.plans.checks import codes, decision
from tidewright.plans.ledger import phase_local_start

# Types of claims and uses.
TESTABLE_CLAIMS = ("location", "defense", "accusation", "sighting")
TRUTH_CLAIMS = ("location", "route", "sighting", "defense", "accusation", "role_claim")
ROUTE_CLAIMS = ("route", "location", "sighting")
PERSPECTIVE_ACTS = ("accuse", "defend_self", "defend_other", "coordinate_vote", "ask_for_information")
VOTE_ACTS = ("coordinate_vote", "accuse")
# End of fixed values.


def _soon(row: str, least: float) -> Column:
    local = phase_local_start(F.col(f"{row}.source_segment_ids"), F.col(f"{row}.abs_start_sec"))
    return local < least


def claim_truth_reasons(players: Column, excluded_types: Sequence[str], strong_types: Sequence[str], warmup: float = 15.0, least_text: int = 8) -> Column:
    e, c = (lambda k: F.col(f"event.{k}")), (lambda k: F.col(f"claim.{k}"))
    against = F.col("truth") == "contradicted"
    gameplay = e("phase_type") == "gameplay"
    acts = F.array_contains(e("actors"), c("speaker")) | F.contains(e("description"), c("speaker"))
    return codes([
        ("anchor_event_not_gameplay", ~gameplay), ("anchor_event_too_close_to_phase_start", gameplay & _soon("event", warmup)), ("anchor_event_type_excluded", e("event_type").isin(*excluded_types)),
        ("contradicted_anchor_too_weak", against & ~e("event_type").isin(*strong_types)), ("anchor_description_weak", text.contains_any(F.lower(e("description")), text.BAD_DESCRIPTION)),
        ("anchor_event_needs_review", e("needs_human_review")), ("anchor_event_low_certainty", F.coalesce(e("certainty"), F.lit(0.0)) < 0.75), ("anchor_event_without_source", F.size(e("source_povs")) == 0),
        ("claim_speaker_not_player", ~F.coalesce(F.array_contains(players, c("speaker")), F.lit(False))), ("claim_type_not_supported", ~F.coalesce(c("claim_type").isin(*TESTABLE_CLAIMS), F.lit(False))),
        ("claim_content_too_short", F.length(text.stripped(c("content"))) < least_text), ("claim_low_certainty", F.coalesce(c("certainty"), F.lit(0.0)) < 0.7),
        ("target_did_not_hear_claim", ~F.coalesce(F.array_contains(c("heard_by"), F.col("target")), F.lit(False))), ("claim_must_end_after_event", c("abs_end_sec") < e("abs_end_sec")),
        ("target_visibility_not_hidden", ~F.coalesce(F.col("visibility") == "not_visible", F.lit(False))), ("contradicted_speaker_not_actor", against & ~F.coalesce(acts, F.lit(False))),
        ("contradicted_anchor_without_place", against & (text.stripped(e("location")) == "") & (text.stripped(e("description")) == "")),
    ])


def delayed_reveal_reasons(matches: Column, least_delay: float = 45.0, warmup: float = 15.0, claim_types: Sequence[str] = ("sighting", "accusation", "location", "role", "other")) -> Column:
    e, c = (lambda k: F.col(f"event.{k}")), (lambda k: F.col(f"claim.{k}"))
    return codes([
        ("target_is_source", F.array_contains(e("source_povs"), F.col("target"))), ("anchor_event_too_close_to_phase_start", (e("phase_type") == "gameplay") & _soon("event", warmup)),
        ("reveal_claim_too_close_to_phase_start", _soon("claim", warmup)), ("reveal_too_close_to_event", c("abs_start_sec") - e("abs_end_sec") < least_delay), ("claim_not_public_enough", F.size(c("heard_by")) < 4),
        ("claim_type_not_reveal", ~F.coalesce(c("claim_type").isin(*claim_types), F.lit(False))), ("claim_not_after_event", c("abs_start_sec") <= e("abs_end_sec")), ("claim_does_not_match_event", ~F.coalesce(matches, F.lit(False))),
    ])


def probe_metadata_reasons() -> Column:
    """Faults of a group against its anchor event: columns template, target, cutoff, needs_human_review and `event`."""
    e = lambda k: F.col(f"event.{k}")
    hidden = F.col("template").isin("hidden_event_awareness", "contradicted_alibi")
    return codes([
        ("group_needs_review", F.col("needs_human_review")), ("anchor_event_needs_review", e("needs_human_review")), ("anchor_event_starts_after_cutoff", e("abs_start_sec") > F.col("cutoff")),
        ("anchor_event_extends_after_cutoff", hidden & (e("abs_end_sec") > F.col("cutoff"))), ("target_is_source", hidden & F.array_contains(e("source_povs"), F.col("target"))),
    ])


def probe_uses(claim_type: Column, function: Column) -> Column:
    """What a claim can be used for, in order."""
    return codes([("claim_truth_vs_claim_awareness", claim_type.isin(*TRUTH_CLAIMS)), ("route_belief", claim_type.isin(*ROUTE_CLAIMS)), ("perspective_taking", function.isin(*PERSPECTIVE_ACTS)), ("vote_influence", function.isin(*VOTE_ACTS))])


def conservative_decision(issues: Column, said: Column, targets: Column, speaker: Column, players: Column) -> Column:
    """What may happen to a claim candidate without a human: only ever a rejection or a request."""
    known = F.coalesce(F.array_contains(players, speaker), F.lit(False))
    return decision(
        (F.size(issues) > 0, "reject_for_gold"), (text.stripped(said) == "", "reject_for_gold"), (F.size(F.array_except(targets, players)) > 0, "reject_for_gold"), (~known, "needs_speaker_and_audio_confirmation"),
        (F.size(targets) > 0, "needs_alias_and_audio_confirmation"), default="needs_audio_confirmation",
    )


def review_reasons(needs_review: Column, certainty: Column, least: float = 0.55, unknown_fields: Sequence[Column] = ()) -> Column:
    """Why an item should be looked at; none means it needn't be."""
    unknown = [(f"unknown_field_{i}", F.coalesce(f, F.lit("unknown")) == "unknown") for i, f in enumerate(unknown_fields)]
    return codes([("marked", needs_review), ("low_certainty", F.coalesce(certainty, F.lit(0.0)) < least), *unknown])
