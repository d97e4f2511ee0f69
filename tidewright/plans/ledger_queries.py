"""Queries of the whole ledger path over the `events` table, each with a DuckDB twin: annotations of a day and a view, made
into candidates, merged, held against each other, and asked about.

A view's annotation holds a day of its player's events: errors are utterances, all else observations that last four hours
more. A third of the events are seen a minute later (heard a second later) from the next player's view too. Every seventh
day is a meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.plans import ledger
from tidewright.plans.event_queries import EV, GAMES, games, roster

_NONE = "CAST(NULL AS STRING)"


def _name(user: Column) -> Column:
    return F.format_string("p%05d", user)


def _views(ev: DataFrame) -> DataFrame:
    """Each event from its player's view, and a third of them from the next player's."""
    late = F.when(F.col("event_type") == "error", 1).otherwise(60)
    other = F.col("game_id") * 6 + (F.col("user_id") + 1) % 6
    again = ev.where("k % 3 = 0").withColumns({"viewer": other, "s": F.col("s") + late, "e": F.col("e") + late})
    return ev.withColumn("viewer", F.col("user_id")).unionByName(again)


def _annotations(ev: DataFrame) -> DataFrame:
    """One row a view and day, as a file of annotations holds it."""
    day = F.floor(F.col("s") / 86400)
    kind = F.when(day % 7 == 6, "meeting").otherwise("gameplay")
    me, other = _name(F.col("user_id")), _name(F.col("game_id") * 6 + (F.col("user_id") + 1) % 6)
    sees = F.when(F.col("k") % 3 == 1, F.array(F.lit("speech_claim"), F.lit("public_result"))).otherwise(F.array(F.lit("direct_visual_observation")))
    sure = F.when(F.col("k") % 3 == 0, "high").when(F.col("k") % 3 == 1, (F.floor("value") / 256).cast("string"))
    observation = F.struct(
        F.col("s").alias("abs_start_sec"), (F.col("e") + 14400).alias("abs_end_sec"), "event_type", F.when(F.col("k") % 4 == 0, other).alias("actor"), F.concat(F.lit("Room "), F.col("k") % 2).alias("location"),
        F.concat(F.lit("near the "), F.col("event_type"), F.when(F.col("k") % 5 == 0, " 杀").otherwise("")).alias("description"), sees.alias("source_types"), F.format_string("saw %d", "event_id").alias("evidence"),
        F.lit("board").alias("public_result_text"), F.when(F.col("k") % 9 == 0, "guess").alias("inferred_belief_text"), sure.alias("certainty"), (F.col("k") % 8 == 0).alias("needs_human_review"),
    )
    said = F.when(F.col("k") % 4 == 0, "我没有杀人").when(F.col("k") % 4 == 1, F.concat(F.lit("seen in Room "), F.col("k") % 2)).when(F.col("k") % 4 == 2, F.concat(F.lit("刚才看到 "), other)).otherwise("...")
    utterance = F.struct(
        F.col("s").alias("abs_start_sec"), F.col("e").alias("abs_end_sec"), F.when(F.col("k") % 5 > 0, me).alias("speaker"), said.alias("transcript"), F.when(F.col("k") % 7 == 0, F.concat(F.lit(" 投票 "), other)).alias("claim_text"),
        F.expr(_NONE).alias("text"), F.expr(_NONE).alias("content"), sure.alias("certainty"), (F.col("k") % 8 == 0).alias("needs_human_review"),
    )
    rows = _views(ev).withColumns({"day": day, "phase_type": kind, "player_id": _name(F.col("viewer"))}).withColumn("phase_id", F.format_string("g%04d_%02d_%s_%07d_%07d", "game_id", "day", "phase_type", F.col("day") * 86400, (F.col("day") + 1) * 86400))
    listed = lambda flag, item: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("s", "event_id", item.alias("item"))))), lambda x: x["item"])
    return rows.groupBy("game_id", "day", "phase_type", "phase_id", "player_id").agg(listed(F.col("event_type") != "error", observation).alias("observations"), listed(F.col("event_type") == "error", utterance).alias("utterances")).select(
        "game_id", F.format_string("g%04d_e0", "game_id").alias("episode_id"), "phase_id", "phase_type", F.col("day").alias("phase_index_global"), "player_id",
        (F.col("day") * 86400).cast("double").alias("aligned_start_sec"), ((F.col("day") + 1) * 86400).cast("double").alias("aligned_end_sec"), "observations", "utterances", F.concat_ws("/", "phase_id", "player_id").alias("path"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Annotations and players."""
    ev = games(spark, sf_dir)
    return _annotations(ev), roster(ev).withColumn("player_id", _name(F.col("player_id")))


def _ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ledger.build_ledger(*_parts(spark, sf_dir), viewers=False)


def _joined(*columns: str) -> list[Column]:
    return [F.array_join(c, ",").alias(c) for c in columns]


def ledger_world_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of all views merged into world events."""
    lists = _joined("actors", "source_povs", "source_segment_ids", "direct_visual_evidence", "direct_audio_evidence", "public_evidence", "inferred_fields", "duplicate_local_event_ids")
    return ledger.canonical_events(ledger.candidate_events(*_parts(spark, sf_dir)))[0].select("game_id", "world_event_id", "abs_start_sec", "abs_end_sec", "phase_type", "event_type", "location", "description", "certainty", "needs_human_review", *lists)


def ledger_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of all views merged into claims."""
    return ledger.canonical_claims(ledger.candidate_claims(*_parts(spark, sf_dir)))[0].select("game_id", "claim_id", "abs_start_sec", "abs_end_sec", "speaker", "claim_type", "content", "normalized_content", "time_referred", "strategic_role", "certainty", "needs_human_review", *_joined("heard_by", "target_entities", "source_segment_ids"))


def ledger_truth_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against the events near them."""
    aware = F.array_join(F.transform(F.array_sort(F.map_entries("local_awareness_by_player")), lambda x: F.concat_ws(":", x["key"], x["value"])), ",")
    return _ledger(spark, sf_dir)["claim_truth_links"].select("game_id", "claim_truth_link_id", "claim_id", "truth_status_global", "confidence", "needs_human_review", aware.alias("awareness"), *_joined("world_event_ids"))


def ledger_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What players know at the first 360 cutoffs of each game (the bound of a ledger)."""
    return _ledger(spark, sf_dir)["belief_memory_snapshots"].select("game_id", "snapshot_id", "target_player", "cutoff_abs_sec", *_joined("private_observations", "public_history", "heard_claims", "forbidden_event_ids"), F.size("available_evidence_ids").cast("bigint").alias("n_available"))


def ledger_probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of 240 groups over all games' ledgers (the quota is the feature)."""
    tables = _ledger(spark, sf_dir)
    rows = ledger.probe_rows(ledger.select_probe_groups(tables, 240), tables)
    return rows.select("probe_id", "template", "target_player", "cutoff", "letter", *_joined("claim_ids", "available_evidence_ids", "forbidden_event_ids"))


QUERIES = {f.__name__: f for f in (ledger_world_events, ledger_claims, ledger_truth_links, ledger_snapshots, ledger_probe_rows)}


def _any(column: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


_KINDS = "CASE " + " ".join(f"WHEN {_any('said', tokens)} THEN '{name}'" for name, tokens in text.CLAIM_CLASSES) + " ELSE 'other' END"
_FLAT = r"regexp_replace(lower({}), '\s+', '', 'g')"

# Views, candidates and merged rows; each later part of the chain is one string more.
_CANDIDATES = f"""WITH RECURSIVE {EV}, {GAMES}, ros AS (SELECT game_id, list('p' || lpad(CAST(player_id AS VARCHAR), 5, '0') ORDER BY player_id) AS roster FROM roster GROUP BY game_id),
    vw AS (SELECT *, user_id AS viewer FROM gv UNION ALL SELECT event_id, user_id, event_type, value, k, s + late, e + late, game_id, game_id * 6 + (user_id + 1) % 6 FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 60 END AS late FROM gv WHERE k % 3 = 0)),
    dy AS (SELECT *, CAST(floor(s / 86400) AS BIGINT) AS d, 'p' || lpad(CAST(viewer AS VARCHAR), 5, '0') AS pov, 'p' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS me, 'p' || lpad(CAST(game_id * 6 + (user_id + 1) % 6 AS VARCHAR), 5, '0') AS other,
        CASE k % 3 WHEN 0 THEN 0.85 WHEN 1 THEN least(1.0, floor(value) / 256) ELSE 0.5 END AS sure FROM vw JOIN ros USING (game_id)),
    ph AS (SELECT *, CASE WHEN d % 7 = 6 THEN 'meeting' ELSE 'gameplay' END AS phase_type, printf('g%04d_%02d_%s_%07d_%07d', game_id, d, CASE WHEN d % 7 = 6 THEN 'meeting' ELSE 'gameplay' END, d * 86400, (d + 1) * 86400) AS phase_id FROM dy)"""

_EVENTS = _CANDIDATES + """, ob AS (SELECT *, CASE WHEN k % 4 = 0 AND list_contains(roster, other) THEN other ELSE '' END AS actor, k % 2 AS room, row_number() OVER (PARTITION BY game_id ORDER BY phase_id, pov, s, event_id) AS seq FROM ph WHERE event_type <> 'error'),
    on_ AS (SELECT game_id || '|' || event_type || '|' || actor || '|' || room AS kk, seq, s, e + 14400 AS e, row_number() OVER (PARTITION BY game_id, event_type, actor, room ORDER BY s, seq) AS n FROM ob),
    mf AS (SELECT kk, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(lo DOUBLE, hi DOUBLE, id BIGINT)[]) AS live, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS kept FROM on_ GROUP BY kk
        UNION ALL SELECT kk, n, CASE WHEN hit > 0 THEN list_transform(l, lambda x, i: CASE WHEN i = hit THEN struct_pack(lo := least(x.lo, s), hi := greatest(x.hi, e), id := x.id) ELSE x END)
            ELSE list_append(l, struct_pack(lo := s, hi := e, id := seq)) END, seq, CASE WHEN hit > 0 THEN l[hit].id ELSE seq END
            FROM (SELECT *, coalesce(list_position(list_transform(l, lambda x: (abs(x.lo - s) <= 3 AND abs(x.hi - e) <= 3) OR (least(x.hi, e) - greatest(x.lo, s)) / (greatest(x.hi, e) - least(x.lo, s)) > 0.5), true), 0) AS hit
                FROM (SELECT on_.*, list_filter(mf.live, lambda x: x.hi > on_.s OR x.lo >= on_.s - 3) AS l FROM mf JOIN on_ ON on_.kk = mf.kk AND on_.n = mf.n + 1))),
    oj AS (SELECT ob.*, kk, kept, (s, event_type, ob.seq) AS turn FROM ob JOIN (SELECT split_part(kk, '|', 1) AS gid, kk, seq, kept FROM mf WHERE n > 0) m ON CAST(m.gid AS BIGINT) = ob.game_id AND m.seq = ob.seq),
    we AS (SELECT *, printf('ge_%06d', row_number() OVER (PARTITION BY game_id ORDER BY turn)) AS world_event_id FROM (
        SELECT game_id, min(turn) AS turn, min(s) AS s, max(e + 14400) AS e, arg_min(phase_type, turn) AS phase_type, arg_min(event_type, turn) AS event_type, arg_min(actor, turn) AS actor, arg_min('Room ' || room, turn) AS location, arg_min('near the ' || event_type || CASE WHEN k % 5 = 0 THEN ' 杀' ELSE '' END, turn) AS description,
            list_sort(list(DISTINCT pov)) AS povs, list_sort(list(DISTINCT phase_id)) AS segments, max(sure) AS sure, bool_or(k % 8 = 0) AS review, bool_or(k % 3 = 1) AS board, bool_or(k % 9 = 0) AS guess,
            list('saw ' || event_id ORDER BY turn) FILTER (k % 3 <> 1) AS seen, list('saw ' || event_id ORDER BY turn) FILTER (k % 3 = 1) AS audio, list(printf('%s_%s_le_%06d', phase_id, pov, seq) ORDER BY turn) AS locals
        FROM oj GROUP BY game_id, kk, kept))"""

_CLAIMS = _EVENTS + f""", ut AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY phase_id, pov, s, event_id) AS seq, CASE WHEN k % 5 > 0 AND list_contains(roster, me) THEN me ELSE 'unknown' END AS speaker,
        CASE k % 4 WHEN 0 THEN '我没有杀人' WHEN 1 THEN 'seen in Room ' || (k % 2) WHEN 2 THEN '刚才看到 ' || other ELSE '...' END AS content FROM ph WHERE event_type = 'error'),
    us AS (SELECT *, CASE WHEN k % 7 = 0 THEN '投票 ' || other ELSE content END AS said FROM ut),
    uk AS (SELECT *, {_KINDS} AS kind FROM us), un AS (SELECT *, game_id || '|' || speaker || '|' || kind || '|' || {_FLAT.format('said')} AS kk, (s, speaker, kind, seq) AS turn FROM uk), uo AS (SELECT *, row_number() OVER (PARTITION BY kk ORDER BY turn) AS n FROM un),
    cf AS (SELECT kk, CAST(0 AS BIGINT) AS n, CAST(-1e18 AS DOUBLE) AS first, CAST(NULL AS BIGINT) AS kept FROM uo GROUP BY kk
        UNION ALL SELECT uo.kk, uo.n, CASE WHEN s - first > 3 THEN s ELSE first END, CASE WHEN s - first > 3 THEN seq ELSE kept END FROM cf JOIN uo ON uo.kk = cf.kk AND uo.n = cf.n + 1),
    cl AS (SELECT *, printf('claim_%06d', row_number() OVER (PARTITION BY game_id ORDER BY turn)) AS claim_id FROM (
        SELECT game_id, min(turn) AS turn, min(s) AS s, max(e) AS e, arg_min(speaker, turn) AS speaker, arg_min(kind, turn) AS kind, arg_min(content, turn) AS content, arg_min(said, turn) AS said, max(sure) AS sure, bool_or(k % 8 = 0 OR speaker = 'unknown') AS review,
            list_sort(list_distinct(flatten(list(CASE WHEN phase_type = 'meeting' THEN roster ELSE [pov] END)))) AS heard, list_sort(list_distinct(flatten(list(list_filter(roster, lambda p: contains(said, p)))))) AS targets, list_sort(list(DISTINCT phase_id)) AS segments
        FROM uo JOIN cf USING (kk, n) GROUP BY game_id, kk, kept))"""

_TRUTHS = _CLAIMS + f""", pl AS (SELECT game_id, unnest(roster) AS player_id FROM ros),
    ed AS (SELECT we.game_id, world_event_id AS id, player_id, CASE WHEN list_contains(povs, player_id) THEN 'direct_visual' WHEN phase_type = 'meeting' OR board THEN 'public_ui' ELSE 'not_visible' END AS visibility, s, false AS claim FROM we JOIN pl ON pl.game_id = we.game_id
        UNION ALL SELECT cl.game_id, claim_id, player_id, CASE WHEN list_contains(heard, player_id) THEN 'heard_claim' ELSE 'not_visible' END, s, true FROM cl JOIN pl ON pl.game_id = cl.game_id),
    cn AS (SELECT *, {_FLAT.format("content || ' ' || said")} AS words FROM cl), wn AS (SELECT *, {_FLAT.format('description')} AS words, {_FLAT.format('location')} AS place FROM we),
    nr AS (SELECT c.game_id, claim_id, world_event_id, w.actor = c.speaker AS acts, c.sure AS cs, w.sure AS es, row_number() OVER (PARTITION BY c.game_id, claim_id ORDER BY world_event_id) AS rn FROM cn c JOIN wn w ON w.game_id = c.game_id AND w.s <= c.e + 180 AND w.e >= c.s - 180
        AND (w.actor = c.speaker OR list_contains(c.targets, w.actor) OR contains(c.words, w.place) OR {" OR ".join(f"(contains(c.words, '{t}') AND contains(w.words, '{t}'))" for t in ledger.ACTION_TOKENS)})),
    lg AS (SELECT game_id, claim_id, list(world_event_id ORDER BY world_event_id) AS ids, bool_or(acts) AS acts, least(any_value(cs), max(es)) AS confidence FROM nr WHERE rn <= 4 GROUP BY game_id, claim_id),
    lk AS (SELECT lg.*, c.heard, c.kind, c.s AS cs, c.e AS ce, CASE WHEN NOT acts THEN 'unverified' WHEN {_any(_FLAT.format('content'), ledger.DENIAL_TOKENS)} THEN 'contradicted' ELSE 'supported' END AS truth FROM lg JOIN cl c USING (game_id, claim_id))"""

_KNOWN = _TRUTHS + """, ct AS (SELECT game_id, player_id, round_even(c, 1) AS r, min(c) AS cut FROM (
        SELECT lk.game_id, ce + 1 AS c, player_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY claim_id) AS n FROM lk) lk JOIN pl ON pl.game_id = lk.game_id WHERE n <= 200
        UNION ALL SELECT w.game_id, e + 3, player_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY world_event_id) AS n FROM we) w JOIN pl ON pl.game_id = w.game_id WHERE n <= 200 AND NOT list_contains(povs, player_id)) z GROUP BY ALL),
    cu AS (SELECT game_id, player_id, cut FROM ct QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY cut, player_id) <= 360),
    sn AS (SELECT cu.game_id, cu.player_id, cut, list('obs_' || cu.player_id || '_' || id ORDER BY id) FILTER (visibility IN ('direct_visual', 'public_ui')) AS obs, list('obs_' || cu.player_id || '_' || id ORDER BY id) FILTER (visibility = 'public_ui') AS pub,
        list(id ORDER BY id) FILTER (visibility = 'heard_claim') AS heard, list(id ORDER BY id) FILTER (visibility = 'not_visible' AND NOT claim) AS hid FROM cu LEFT JOIN ed ON ed.game_id = cu.game_id AND ed.player_id = cu.player_id AND ed.s <= cut GROUP BY ALL),
    sx AS (SELECT *, list_sort(list_concat(coalesce(obs, []), coalesce(heard, []))) AS avail FROM sn)"""

_J = "coalesce(array_to_string({}, ','), '')"
ORACLE_SQL = {
    "ledger_world_events": _EVENTS + f""" SELECT game_id, world_event_id, s AS abs_start_sec, e AS abs_end_sec, phase_type, event_type, location, description, sure AS certainty, review AS needs_human_review, actor AS actors, {_J.format('povs')} AS source_povs, {_J.format('segments')} AS source_segment_ids,
        {_J.format('list_filter(seen, lambda x, i: list_position(seen, x) = i)')} AS direct_visual_evidence, {_J.format('list_filter(audio, lambda x, i: list_position(audio, x) = i)')} AS direct_audio_evidence, CASE WHEN board THEN 'board' ELSE '' END AS public_evidence, CASE WHEN guess THEN 'guess' ELSE '' END AS inferred_fields,
        {_J.format('locals')} AS duplicate_local_event_ids FROM we""",
    "ledger_claims": _CLAIMS + f""" SELECT game_id, claim_id, s AS abs_start_sec, e AS abs_end_sec, speaker, kind AS claim_type, content, said AS normalized_content, CASE WHEN {_any('said', ledger.RECENT_TOKENS)} THEN 'relative_recent' ELSE 'unknown' END AS time_referred,
        CASE WHEN kind IN ('defense', 'location') OR {_any('said', text.ROLE_DEFENSE)} THEN 'defense' WHEN kind = 'accusation' OR {_any('said', text.ROLE_ACCUSATION)} THEN 'accusation' WHEN kind = 'sighting' THEN 'information_sharing' ELSE 'other' END AS strategic_role,
        sure AS certainty, review AS needs_human_review, {_J.format('heard')} AS heard_by, {_J.format('targets')} AS target_entities, {_J.format('segments')} AS source_segment_ids FROM cl""",
    "ledger_truth_links": _TRUTHS + f""", sw AS (SELECT u.game_id, u.claim_id, list(DISTINCT player_id) AS saw FROM (SELECT game_id, claim_id, unnest(ids) AS id FROM lk) u JOIN ed ON ed.game_id = u.game_id AND ed.id = u.id AND visibility = 'direct_visual' GROUP BY ALL)
        SELECT lk.game_id, 'ctl_' || lk.claim_id || '_' || ids[1] AS claim_truth_link_id, lk.claim_id, truth AS truth_status_global, confidence, truth = 'unverified' AS needs_human_review, {_J.format('ids')} AS world_event_ids,
            array_to_string(list_transform(roster, lambda p: p || ':' || CASE WHEN list_contains(coalesce(saw, []), p) THEN CASE WHEN truth = 'contradicted' THEN 'has_contradictory_visual_evidence' ELSE 'has_supporting_visual_evidence' END WHEN list_contains(heard, p) THEN 'not_enough_information' ELSE 'unknown' END), ',') AS awareness
        FROM lk JOIN ros ON ros.game_id = lk.game_id LEFT JOIN sw ON sw.game_id = lk.game_id AND sw.claim_id = lk.claim_id""",
    "ledger_snapshots": _KNOWN + f""" SELECT game_id, printf('mem_%s_%s_%06d', CAST(game_id AS VARCHAR), player_id, CAST(floor(cut) AS BIGINT)) AS snapshot_id, player_id AS target_player, cut AS cutoff_abs_sec, {_J.format('obs')} AS private_observations, {_J.format('list_sort(list_concat(coalesce(pub, []), coalesce(heard, [])))')} AS public_history,
        {_J.format('heard')} AS heard_claims, {_J.format('hid')} AS forbidden_event_ids, len(avail) AS n_available FROM sx""",
    "ledger_probe_rows": _KNOWN + f""", hw AS (SELECT we.game_id, world_event_id, player_id, we.s, we.e, len(povs) AS np FROM we JOIN ed ON ed.game_id = we.game_id AND ed.id = world_event_id AND visibility = 'not_visible'),
        ll AS (SELECT game_id, claim_id, truth, kind, cs, heard, unnest(ids) AS world_event_id FROM lk),
        td AS (SELECT h.game_id, h.world_event_id, h.player_id, h.s, h.e, np, claim_id, truth, kind, cs, coalesce(list_contains(heard, h.player_id), false) AS hears FROM hw h LEFT JOIN ll ON ll.game_id = h.game_id AND ll.world_event_id = h.world_event_id),
        tp AS (SELECT 0 AS r, 24 AS q, 'hidden_critical_event' AS template, * FROM td UNION ALL SELECT 1, 84, 'contradicted_alibi', * FROM td WHERE hears AND truth = 'contradicted' UNION ALL SELECT 2, 36, 'private_witness', * FROM td WHERE np = 1
            UNION ALL SELECT 3, 36, 'vote_influence', * FROM td WHERE hears AND kind = 'accusation' UNION ALL SELECT 4, 24, 'delayed_public_reveal', * FROM td WHERE hears AND cs > e + 45),
        pc AS (SELECT r, q, template, game_id, world_event_id, player_id, s, e, coalesce(list_sort(list(DISTINCT claim_id) FILTER (claim_id IS NOT NULL)), []) AS claims FROM tp GROUP BY ALL),
        pn AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s, world_event_id, player_id, game_id) AS n FROM pc),
        pg AS (SELECT *, game_id || '_pg_' || template || '_' || world_event_id || '_' || player_id AS gid FROM pn ORDER BY n > q, r, s, world_event_id, player_id, game_id LIMIT 240),
        pa AS (SELECT pg.*, e + 3 AS cutoff, avail, hid FROM pg ASOF LEFT JOIN sx ON sx.game_id = pg.game_id AND sx.player_id = pg.player_id AND pg.e + 3 + 1e-6 >= sx.cut)
        SELECT gid || '_' || letter AS probe_id, template, player_id AS target_player, cutoff, letter, {_J.format('claims')} AS claim_ids, {_J.format('avail')} AS available_evidence_ids, {_J.format('hid')} AS forbidden_event_ids
        FROM (SELECT *, unnest(CASE WHEN len(claims) > 0 THEN ['A', 'B', 'C', 'D'] ELSE ['A', 'B', 'C'] END) AS letter FROM pa)""",
}
