"""Evaluation of models over task tables: registry, task grid, runs through a pluggable client, resume, report.

A client is any picklable callable prompt -> answer text. It runs in `mapInPandas`, so tasks spread over executors; retries,
parsing and schema checks happen next to it. `mock_client` stands in for a model in tests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import answers
from tidewright.operators import joins
from tidewright.plans import normalise
from tidewright.scratch import staged

#: Name, adapter and inputs of example models; a registry is a small dimension table that callers extend.
MODELS = (
    ("mock-text", "mock", ["text"]),
    ("mock-vision", "mock", ["text", "image", "video"]),
    ("mock-omni", "mock", ["text", "image", "video", "audio"]),
)
#: What each modality needs.
MODALITIES = (("text", ["text"]), ("video", ["text", "video"]), ("audio_video", ["text", "video", "audio"]))


def registry(spark: SparkSession, models: Sequence[tuple[str, str, list[str]]] = MODELS) -> DataFrame:
    return spark.createDataFrame(list(models), "model string, adapter string, inputs array<string>")


def modalities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODALITIES), "modality string, needs array<string>")


def supports(inputs: Column, needs: Column) -> Column:
    return F.size(F.array_except(needs, inputs)) == 0


def plan(tasks: DataFrame, models: DataFrame, kinds: DataFrame, prompt_version: str) -> DataFrame:
    """tasks (trial_id, ...) x models x modalities: task_key, and whether the model takes the modality."""
    each = joins.grid(tasks, models.select("model", "inputs"), kinds)
    key = answers.task_key(F.col("trial_id").cast("string"), F.col("model"), F.col("modality"), F.lit(prompt_version))
    return each.withColumns({"task_key": key, "supported": supports(F.col("inputs"), F.col("needs"))}).drop("inputs", "needs")


def mock_client(prompt: str) -> str:
    return '{"answer": "A", "evidence_ids": []}' if "fail" not in prompt else "no answer"


def with_retry(client: Callable[[str], str], prompt: str, attempts: int = 2, base_sec: float = 0.0, most_sec: float = 60.0) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts made); waits min(most, base * 2**min(n - 1, 6)) seconds after the n-th failure."""
    error = None
    for n in range(1, attempts + 1):
        try:
            return client(prompt), None, n
        except Exception as problem:  # noqa: BLE001 - a client may raise anything; it becomes the row's error
            error = f"{type(problem).__name__}: {problem}"
            if n < attempts:
                time.sleep(min(most_sec, base_sec * 2 ** min(n - 1, 6)))
    return None, error, attempts


def run(tasks: DataFrame, client: Callable[[str], str] = mock_client, wanted: Sequence[str] = ("answer",), completed: DataFrame | None = None, attempts: int = 2) -> DataFrame:
    """Responses of planned tasks (task_key, prompt, supported): status ok, error or skipped, answer, parse and schema flags.

    Tasks in `completed` that are ok or skipped don't run again.
    """
    left = tasks if completed is None else joins.anti_completed(tasks, completed)
    skipped = left.where(~F.col("supported")).select("task_key", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("raw_response"), F.lit("unsupported modality").alias("error"), F.lit(0).alias("attempts"), F.lit(0.0).alias("latency_sec"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, prompt in zip(rows["task_key"], rows["prompt"]):
                began = time.perf_counter()
                raw, error, n = with_retry(client, prompt, attempts)
                out.append((key, "ok" if error is None else "error", raw, error, n, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["task_key", "status", "raw_response", "error", "attempts", "latency_sec"])

    asked = left.where("supported").select("task_key", "prompt").mapInPandas(ask, "task_key string, status string, raw_response string, error string, attempts int, latency_sec double")
    every = asked.unionByName(skipped).withColumn("_p", answers.parse_answer(F.col("raw_response")))
    ok = F.col("_p.parse_ok")
    return every.withColumns({"parse_ok": ok, "schema_ok": ok & answers.schema_matches(F.to_json("_p.parsed"), F.array(*[F.lit(w) for w in wanted]))}).drop("_p")


def annotate(clips: DataFrame, client: Callable[[str], str], prompt: str = "prompt", key: str = "clip_id", parts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(events, errors): objects of each answer's array, recovered where it was cut short; clips whose answer has none.

    Clips are dealt to `parts` tasks, since a prompt stands for much work, and each is asked once: answers are written before they are read twice.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(k, *with_retry(client, p)[:2]) for k, p in zip(rows[key], rows[prompt])], columns=[key, "raw", "error"])

    asked = clips.select(key, prompt).repartition(parts, key).mapInPandas(ask, f"{key} {dict(clips.dtypes)[key]}, raw string, error string")
    parsed = staged(asked.withColumn("items", answers.recover_array(answers.strip_fences(F.col("raw")))), "answers")
    return parsed.select(key, F.explode("items").alias("item")), parsed.where("items is null").select(key, "raw", F.coalesce("error", F.lit("no objects in the answer")).alias("error"))


def reprocess(errors: DataFrame, key: str = "clip_id") -> DataFrame:
    """Objects that brace scanning finds in answers that didn't parse."""
    return errors.select(key, F.explode(answers.recover_objects(F.col("raw"))).alias("item"))


def markdown_report(scores: DataFrame, order: Sequence[str], digits: int = 3, most: int = 1000) -> str:
    """A Markdown table of all score rows; more than `most` of them are an error, since a report is read as a whole."""
    rows = scores.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    names = scores.columns
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows]]) + "\n"


def client_of(model: str, clients: dict[str, Callable[[str], str]]) -> Callable[[str], str]:
    """The client that serves a model, by its whole name or the longest prefix that is known."""
    for name in sorted(clients, key=len, reverse=True):
        if model == name or model.startswith(name):
            return clients[name]
    raise ValueError(f"no client for {model}")


def boundary_loop(clips: DataFrame, client: Callable[[str], str], accepts: Column, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(boundaries, errors) of clips: each answer's objects in their clip's frame; those that `accepts` refuses are left out.

    clips: clip (struct), prompt."""
    keyed = clips.withColumn("clip_id", F.col("clip.clip_id"))
    items, errors = annotate(keyed, client, prompt)
    rows = keyed.select("clip_id", "clip").join(items, "clip_id").withColumn("item", F.parse_json("item"))
    return normalise.round_boundaries(rows).where(accepts), errors


def sync_loop(videos: DataFrame, client: Callable[[str], str], known: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Offsets of videos: those known with confidence stay, the others are asked for and put in their place.

    videos: game_id, player_id, prompt; known: game_id, player_id, raw_start_sec, confidence."""
    sure = known.where("confidence > 0")
    left = videos.join(sure.select("game_id", "player_id"), ["game_id", "player_id"], "left_anti").withColumn("key", F.concat_ws("|", "game_id", "player_id"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(k, with_retry(client, p)[0]) for k, p in zip(rows["key"], rows[prompt])], columns=["key", "raw"])

    asked = left.select("key", prompt).mapInPandas(ask, "key string, raw string").withColumn("item", F.try_parse_json(answers.strip_fences(F.col("raw"))))
    got = normalise.sync_offsets(left.select("key", "game_id", "player_id").join(asked, "key")).where("ok")
    return sure.select("game_id", "player_id", "raw_start_sec", "confidence").unionByName(got.select("game_id", "player_id", "raw_start_sec", "confidence"))
