"""Ledgers, configurations and result files as sources; whole objects, trees and releases as sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import answers, payload
from tidewright.operators import joins
from tidewright.sources import files
from tidewright.sources.commits import put_file

# The tables of a ledger, and defaults of a run's configuration.
LEDGER = ("world_events", "claims", "phase_events", "visibility_edges", "belief_memory_snapshots", "claim_truth_links", "canonical_event_map")
CORE = ("world_events", "claims", "claim_truth_links", "visibility_edges", "belief_memory_snapshots")
DEFAULTS = {
    "pipeline": "release",
    "alignment.minimum_anchors_per_episode": 3,
    "alignment.median_residual_limit_sec": 1.0,
    "alignment.p95_residual_limit_sec": 2.0,
    "alignment.minimum_anchor_confidence": 0.15,
    "perception.dual_pass": False,
    "perception.speaker_confidence_min": 0.85,
    "perception.max_visual_chunk_sec": 30.0,
    "perception.max_audio_chunk_sec": 30.0,
    "perception.split_on_phase_boundaries": False,
    "pilot_gates.minimum_episodes": 5,
    "pilot_gates.minimum_trials_per_layer": 30,
}
# End of fixed values.


def load_ledger(spark: SparkSession, root: str, schemas: dict[str, str], tables: Sequence[str] = LEDGER) -> dict[str, DataFrame]:
    """The ledger's tables from `root`/<table>.jsonl; a table whose file is missing is empty. schemas: DDL by table."""
    return {t: files.read_jsonl(spark, f"{root}/{t}.jsonl", schemas[t], missing_ok=True) for t in tables}


def write_ledger(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        files.write_jsonl(df, f"{root}/{name}.jsonl")


def load_config(path: str, environ: dict[str, str] | None = None, judge_variable: str = "TIDEWRIGHT_JUDGE_MODEL") -> dict[str, object]:
    """A run's configuration from a JSON or, where PyYAML is there, YAML file: flat keys with `DEFAULTS`, `games` as written.

    The judge's model comes from the environment if that names one.
    """
    with open(path, encoding="utf-8") as source:
        text = source.read()
    if path.endswith(".json"):
        loaded = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML configurations need PyYAML; write the configuration as JSON") from missing
        loaded = yaml.safe_load(text)
    loaded = loaded or {}
    flat = dict(DEFAULTS)
    for key, value in loaded.items():
        if isinstance(value, dict):
            flat.update({f"{key}.{k}": v for k, v in value.items()})
        elif key != "games":
            flat[key] = value
    flat["models.judge"] = (os.environ if environ is None else environ).get(judge_variable, flat.get("models.judge"))
    flat["games"] = loaded.get("games", [])
    return flat


def config_tables(spark: SparkSession, config: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(games, players) of a configuration, as `release.config_issues` takes them."""
    games, players = [], []
    for g in config["games"]:
        start, end = (g.get("valid_range") or [0, None])[:2]
        games.append((str(g["game_id"]), float(start), None if end is None else float(end), [(float(a), float(b)) for a, b in g.get("excluded_ranges", [])]))
        players += [(str(g["game_id"]), str(p["player_id"]), str(p["video_path"])) for p in g.get("players", [])]
    return (
        spark.createDataFrame(games, "game_id string, valid_start double, valid_end double, excluded array<struct<start: double, end: double>>"),
        spark.createDataFrame(players, "game_id string, player_id string, video_path string"),
    )


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One object as a JSON file, put in place in one step: readers see the old one or the new one."""
    put_file(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True).encode(), replace=True)


def _below(path: Column, source: str) -> Column:
    """The names from the folder `source` to a file in it."""
    return F.split(F.substring_index(path, f"{source.rstrip('/').split('://')[-1].split(':', 1)[-1]}/", -1), "/")


def _ignored(names: Column, ignore: Sequence[str]) -> Column:
    return F.exists(names, lambda n: n.isin(*ignore)) if ignore else F.lit(False)


def copy_tree(spark: SparkSession, source: str, target: str, ignore: Sequence[str] = (), leave: str | None = None) -> DataFrame:
    """Every file below `source` but those with an ignored name on their way or with the ending `leave`, copied by tasks when read: (path, target, bytes)."""
    names = _below(F.col("path"), source)
    listed = files.listing(spark, source).where(~_ignored(names, ignore))
    listed = listed if leave is None else listed.where(~F.col("path").endswith(leave))
    listed = listed.select("path", F.concat(F.lit(target.rstrip("/") + "/"), F.array_join(names, "/")).alias("target"), F.col("length").alias("bytes"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in zip(b.column("path").to_pylist(), b.column("target").to_pylist()):
                (from_, here), (to, there) = pyarrow.fs.FileSystem.from_uri(a), pyarrow.fs.FileSystem.from_uri(z)
                to.create_dir(there.rsplit("/", 1)[0], recursive=True)
                with from_.open_input_stream(here) as reader, to.open_output_stream(there) as writer:
                    while block := reader.read(4 << 20):
                        writer.write(block)
            yield b

    return listed.repartition(max(1, min(listed.count(), 2000)), "path").mapInArrow(copy, "path string, target string, bytes long")


def boundary_windows(spark: SparkSession, root: str, game_id: str | None = None) -> DataFrame:
    """Phase windows of all files below a folder, one row each, of one game if given."""
    window = "struct<segment_id: string, player_id: string, abs_start_sec: double, abs_end_sec: double, phase_type: string>"
    rows = files.read_json_tree(spark, root, f"game_id string, phase_windows array<{window}>", missing_ok=True).select("path", "game_id", F.inline("phase_windows"))
    return rows if game_id is None else rows.where(F.col("game_id") == game_id)


def result_sets(results: DataFrame) -> DataFrame:
    """Result files of equal content once, the first path standing: path, model, setting, n, n_correct.

    results: path, model, setting, position, row_id, correct. Content is the model, the setting, the counts and the first ids.
    """
    first = F.transform(F.filter(F.array_sort(F.collect_list(F.when(F.col("position") < 5, F.struct("position", "row_id")))), lambda x: x.isNotNull()), lambda x: x["row_id"])
    each = results.groupBy("path", "model", "setting").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), first.alias("_first"))
    return joins.first_per(each, ["model", "setting", "n", "n_correct", "_first"], ["path"]).drop("_first")


def model_verified(line: Column) -> Column:
    """A JSON line whose provenance says model instead of human: in keys, texts, gold sources and the reviewer."""
    out = F.replace(line, F.lit("human_verified"), F.lit("model_verified"))
    out = F.regexp_replace(out, r'"(gold_source|recommended_gold_source)"\s*:\s*"[^"]*"', '"$1":"model_verified"')
    return F.regexp_replace(out, r'"human_reviewer"\s*:\s*"codex_human_reviewer"', '"review_model":"legacy_codex_qwen_review"')


def build_release(spark: SparkSession, source: str, target: str, ignore: Sequence[str] = ()) -> DataFrame:
    """A release from another: JSON lines with their provenance rewritten, other files copied, and the manifest of what is there."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(source).where(~_ignored(_below(F.col("_metadata.file_path"), source), ignore))
    lines.where(F.trim("value") != "").select(model_verified(F.col("value")).alias("value")).write.mode("overwrite").text(f"{target}/public")
    copy_tree(spark, source, f"{target}/assets", ignore, leave=".jsonl").write.format("noop").mode("overwrite").save()
    return files.manifest(spark, target)


def release_issues(spark: SparkSession, root: str, recorded: DataFrame, markers: Sequence[str]) -> DataFrame:
    """What is wrong with a release: files missing, changed or unexpected, and lines that still hold a marker."""
    odd = files.manifest_issues(recorded, files.manifest(spark, root)).select("code", F.col("path").alias("key"))
    lines = spark.read.option("recursiveFileLookup", True).text(f"{root}/public")
    hits = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.col("value"), m))
    return odd.unionByName(lines.select(F.lit("private_marker").alias("code"), F.explode(hits).alias("key")).distinct())


def recovered(errors: DataFrame) -> DataFrame:
    """Quarantined answers by what can be made of them: a list's objects for stages of lists, one object for others, nothing.

    errors: stage, key, raw; `lists` says whether the stage answers with a list. status: recovered or failed.
    """
    cleaned = errors.withColumn("raw", answers.strip_fences(F.col("raw")))
    whole = cleaned.withColumns({"many": answers.recover_array(F.col("raw")), "part": answers.recover_objects(F.col("raw")), "one": answers.recover_object(F.col("raw"))})
    listed = F.when(F.size("many") > 0, F.col("many")).otherwise(F.coalesce("part", payload.nothing()))
    items = F.when(F.col("lists"), listed).otherwise(F.when(F.col("one").isNotNull(), F.array("one")).otherwise(payload.nothing()))
    return whole.select("stage", "key", items.alias("items"), F.when(F.size(items) > 0, "recovered").otherwise("failed").alias("status"))
