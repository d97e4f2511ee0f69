"""Numbers within a key, and the cutoffs of several ledgers at once."""

from tidewright.operators import selection
from tidewright.plans import ledger


def test_numbers_within_a_key(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 3}", (i * 7) % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = {r.id: r.n for r in selection.numbered(df, ["k"], ["at", "id"], "n").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {r[2]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]))}
    assert got == want
    assert selection.numbered(df.limit(0), ["k"], ["at"], "n").count() == 0


def test_cutoffs_are_bounded_by_game(spark):
    """Ids repeat between games; each game has its own first links and events, and its own bound."""
    names = [f"ge_{i:06d}" for i in range(6)]
    events = spark.createDataFrame([(g, n, 10.0 * i, ["ana"]) for g in ("g1", "g2") for i, n in enumerate(names)], "game_id string, world_event_id string, abs_end_sec double, source_povs array<string>")
    claims = spark.createDataFrame([("g1", "claim_000001", 52.0), ("g2", "claim_000001", 2.0)], "game_id string, claim_id string, abs_end_sec double")
    players = spark.createDataFrame([("g1", "ana"), ("g1", "bo"), ("g2", "ana"), ("g2", "bo")], "game_id string, player_id string")
    got = {tuple(r) for r in ledger.probe_cutoffs(claims, claims, events, players, from_each=3, most=100, viewers=False).select("game_id", "target_player", "cutoff_abs_sec").collect()}
    after = {(g, "bo", c) for g in ("g1", "g2") for c in (3.0, 13.0, 23.0)}
    assert got == after | {("g1", p, 53.0) for p in ("ana", "bo")} | {("g2", "ana", 3.0)}  # bo's at 3.0 is there once
    few = ledger.probe_cutoffs(claims, claims, events, players, from_each=3, most=2)
    assert {tuple(r) for r in few.select("game_id", "target_player", "cutoff_abs_sec").collect()} == {(g, p, 3.0) for g in ("g1", "g2") for p in ("ana", "bo")}
