"""Configurations, boundary windows and releases made from releases."""

import hashlib
import json

import pytest

from tidewright.plans import release
from tidewright.sources import ledgers

CONFIG = {
    "pipeline": "strict", "alignment": {"minimum_anchors_per_episode": 5}, "models": {"judge": "written"},
    "games": [
        {"game_id": "g1", "valid_range": [10, 90], "excluded_ranges": [[20, 30], [95, 99]], "players": [{"player_id": "ana", "video_path": "a.mp4"}, {"player_id": "ana", "video_path": "b.mp4"}]},
        {"game_id": "g2"},
        {"game_id": "g3", "valid_range": [50, 40], "excluded_ranges": [[30, 35]], "players": [{"player_id": 7, "video_path": "c.mp4"}]},
    ],
}


def test_configuration_and_its_issues(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps(CONFIG))
    config = ledgers.load_config(str(path), environ={})
    assert config["alignment.minimum_anchors_per_episode"] == 5 and config["alignment.minimum_anchor_confidence"] == 0.15
    assert (config["pipeline"], config["models.judge"]) == ("strict", "written")
    assert ledgers.load_config(str(path), environ={"TIDEWRIGHT_JUDGE_MODEL": "other"})["models.judge"] == "other"
    games, players = ledgers.config_tables(spark, config)
    assert {(r.game_id, r.valid_start, r.valid_end, len(r.excluded)) for r in games.collect()} == {("g1", 10.0, 90.0, 2), ("g2", 0.0, None, 0), ("g3", 50.0, 40.0, 1)}
    assert sorted(tuple(r) for r in players.collect()) == [("g1", "ana", "a.mp4"), ("g1", "ana", "b.mp4"), ("g3", "7", "c.mp4")]
    found = {r.code for r in release.config_issues(games, players, config).collect()}
    assert found == {"duplicate_player_id", "game_without_players", "invalid_valid_range", "invalid_excluded_range", "excluded_exceeds_valid_range"}


def test_an_empty_configuration(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text("{}")
    config = ledgers.load_config(str(path), environ={})
    assert config["games"] == [] and config["models.judge"] is None and config["pipeline"] == "release"
    games, players = ledgers.config_tables(spark, config)
    assert games.count() == players.count() == release.config_issues(games, players, config).count() == 0


def test_yaml_configurations_load_or_say_what_is_missing(tmp_path):
    path = tmp_path / "run.yaml"
    path.write_text("pipeline: strict\ngames: []\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="PyYAML"):
            ledgers.load_config(str(path), environ={})
    else:
        assert ledgers.load_config(str(path), environ={})["pipeline"] == "strict"


def test_boundary_windows(spark, tmp_path):
    window = {"segment_id": "s1", "player_id": "ana", "abs_start_sec": 1.0, "abs_end_sec": 2.0, "phase_type": "meeting"}
    for name, body in (("a/one.json", {"game_id": "g1", "phase_windows": [window, {**window, "segment_id": "s2"}]}), ("two.json", {"game_id": "g2", "phase_windows": [window]}), ("three.json", {"game_id": "g3", "phase_windows": []})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    rows = ledgers.boundary_windows(spark, str(tmp_path)).collect()
    assert sorted((r.game_id, r.segment_id) for r in rows) == [("g1", "s1"), ("g1", "s2"), ("g2", "s1")]
    assert [r.abs_end_sec for r in ledgers.boundary_windows(spark, str(tmp_path), "g2").collect()] == [2.0]
    assert ledgers.boundary_windows(spark, str(tmp_path / "no")).count() == 0


def test_release_from_a_release(spark, tmp_path):
    source, target = tmp_path / "old", str(tmp_path / "new")
    for name, body in (("public/t.jsonl", '{"gold_source": "human_verified", "note": "human_verified"}\n\n{"human_reviewer": "codex_human_reviewer"}\n'), ("media/g1/ana.mp4", "film"), ("media/cache/x.mp4", "no"), ("media/cache/old.jsonl", '{"note": "stale"}\n'), ("notes.txt", "text")):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(body)
    made = ledgers.build_release(spark, str(source), target, ["cache"])
    hashes = {r.path.split("/new/")[1]: r.sha256 for r in made.collect() if "/assets/" in r.path}
    assert hashes == {"assets/media/g1/ana.mp4": hashlib.sha256(b"film").hexdigest(), "assets/notes.txt": hashlib.sha256(b"text").hexdigest()}
    lines = [r.value for r in spark.read.text(f"{target}/public").collect()]
    assert sorted(map(json.loads, lines), key=str) == sorted([{"gold_source": "model_verified", "note": "model_verified"}, {"review_model": "legacy_codex_qwen_review"}], key=str)
    recorded = spark.createDataFrame(made.collect())
    assert ledgers.release_issues(spark, target, recorded, ["human_verified"]).count() == 0
    (tmp_path / "new/assets/notes.txt").write_text("changed")
    assert [r.code for r in ledgers.release_issues(spark, target, recorded, ["model_verified"]).orderBy("code").collect()] == ["changed", "private_marker"]
