import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.operators import folds
from tidewright.sources import files
from tidewright.streaming import twins


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1, "v": "a"}\n\n{"id": 2}\nbroken\n')
    assert files.read_jsonl(spark, path, "id int, v string").where("id is not null").count() == 2
    rows, errors = files.read_jsonl_with_errors(spark, path, "id int, v string")
    assert sorted(r.id for r in rows.collect()) == [1, 2] and [r.raw for r in errors.collect()] == ["broken"]
    assert files.read_jsonl(spark, path + "no", "id int", missing_ok=True).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, "id int", strict=True).collect()
    assert files.find_one(rows, "id", 2).first().id == 2
    with pytest.raises(KeyError):
        files.find_one(rows, "id", 9)


def test_json_trees(spark, tmp_path):
    for name, body in (("a/x.json", {"events": [{"t": 1}, {"t": 2}]}), ("b/y.json", {"events": [{"t": 3}]}), ("b/._z.json", {"events": [{"t": 9}]})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    got = files.read_json_tree(spark, str(tmp_path), "events array<struct<t: int>>", list_key="events")
    assert sorted(r.t for r in got.collect()) == [1, 2, 3]
    assert files.read_json_tree(spark, str(tmp_path / "no"), "events array<struct<t: int>>", missing_ok=True).count() == 0
    (tmp_path / "o.json").write_text('{"offsets": [{"game_id": "g", "player_id": "p", "raw_start_sec": 2.5}]}')
    (tmp_path / "l.json").write_text('[{"game_id": "g", "player_id": "q", "raw_start_sec": 1}]')
    assert {(r.player_id, r.raw_start_sec) for n in ("o", "l") for r in files.read_offsets(spark, str(tmp_path / f"{n}.json")).collect()} == {("p", 2.5), ("q", 1.0)}
    (tmp_path / "blank.json").write_text(" ")
    values = {r.path.rsplit("/", 1)[1]: r.value is None for r in files.read_text_json(spark, str(tmp_path / "*.json")).collect()}
    assert values == {"o.json": False, "l.json": False, "blank.json": True}


def test_listings_and_manifest(spark, tmp_path):
    for name in ("g1/ana.mp4", "g1/bo.mp4", "g2/ana.mp4", "g2/episode_003_win_a.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    listed = files.listing(spark, str(tmp_path), "*.mp4")
    videos = files.raw_videos(listed)
    assert ("g1", "bo") in {(r.game_id, r.player_id) for r in videos.collect()}
    assert [(r.idx, r.label) for r in files.episode_clips(listed).collect()] == [(3, "win_a")]
    assert {r.game_id for r in files.enough_views(videos, "game_id", 2).collect()} == {"g1", "g2"}
    was = spark.createDataFrame(files.manifest(spark, str(tmp_path), "*.mp4").collect())
    assert files.manifest_issues(was, files.manifest(spark, str(tmp_path), "*.mp4")).count() == 0
    (tmp_path / "g1/ana.mp4").write_bytes(b"other")
    (tmp_path / "g1/bo.mp4").unlink()
    assert sorted(r.code for r in files.manifest_issues(was, files.manifest(spark, str(tmp_path), "*.mp4")).collect()) == ["changed", "missing"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "s1"), (1, "a", "s2")], "z int, a string, secret string")
    files.write_sorted_jsonl(df.select("z", "a"), str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect()) == ['{"a":"a","z":1}', '{"a":"b","z":2}']
    files.write_jsonl(df, str(tmp_path / "j"))
    files.write_jsonl(df, str(tmp_path / "j"), "append")
    assert sum(r.n_lines for r in files.line_counts(spark, str(tmp_path / "j")).collect()) == 4
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["z", "a", "secret"]
    files.export_tracks(df, str(tmp_path / "e"), "a", ["secret"], {"small": F.col("z") < 2})
    assert "secret" not in spark.read.json(str(tmp_path / "e/public")).columns and spark.read.json(str(tmp_path / "e/tracks/small")).count() == 1


def test_xlsx_packages(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Frage</t></is></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>1</v></c></row><row><c r="B3"><v>x</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>ID</t></si><si><t>who</t></si></sst>'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("data.xlsx", book.getvalue())
    got = files.read_xlsx_packages(spark, str(tmp_path), {"id": [], "question": ["frage"], "none": []}).collect()
    assert [(r.id, r.question, r.none) for r in got] == [("7", "who", None), (None, "x", None)]


@pytest.fixture
def stream_dir(spark, tmp_path):
    path = str(tmp_path / "in")
    for k, rows in enumerate([[(1, "2024-01-01 00:00:10", 10.0, "start")], [(1, "2024-01-01 02:00:00", 400.0, "end"), (2, "2024-01-01 02:00:01", 5.0, "start")], [(2, "2024-01-01 03:00:00", 700.0, "end")], [(1, "2024-01-01 00:00:20", 450.0, "start"), (1, "2024-01-01 04:00:00", 900.0, "end")]]):
        spark.createDataFrame(rows, "user_id int, ts string, t double, kind string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{path}/{k}")
    return path


def stream(spark, path):
    schema = spark.read.parquet(f"{path}/*").schema
    return twins.read_events(spark, f"{path}/*", schema)


def test_late_rows_are_dropped(spark, stream_dir):
    counted = twins.chunk_counts(stream(spark, stream_dir), "ts", "1 hour", "30 minutes", ["kind"])
    out = twins.run_to_memory(counted, "late_rows").collect()
    batch = twins.chunk_counts(spark.read.parquet(f"{stream_dir}/*"), "ts", "1 hour", "30 minutes", ["kind"])
    assert sum(r.n_events for r in batch.collect()) == 6
    first = [r.n_events for r in out if r.kind == "start" and r.window_start.hour == 0]
    assert first == [1]  # the row of the last file, three hours late, isn't counted


def test_stateful_scan_is_the_batch_scan(spark, stream_dir):
    got = twins.run_to_memory(twins.boundary_scan(stream(spark, stream_dir), "user_id", "t", "kind", ["start"], ["end"]), "scan_rows").collect()
    want = folds.boundary_scan(spark.read.parquet(f"{stream_dir}/*"), "user_id", "t", "kind", ["start"], ["end"]).collect()
    assert sorted((r.user_id, r.episode, r.start_sec, r.end_sec) for r in got) == sorted((r.user_id, r.episode, r.start_sec, r.end_sec) for r in want) != []


def test_carry_forward_and_idempotent_sink(spark, stream_dir, tmp_path):
    got = twins.run_to_memory(twins.carry_forward(stream(spark, stream_dir), "user_id", "t", "t"), "carried").collect()
    assert sorted((r.user_id, r.seen_before) for r in got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    sink = twins.append_sink(str(tmp_path / "out"), "t")
    batch = spark.read.parquet(f"{stream_dir}/1")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
