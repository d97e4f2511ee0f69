import hashlib
import threading

import pytest

from tidewright.plans import evaluation, stages
from tidewright.sources import files, ledgers
from tidewright.sources.commits import CommitLog, put_file, read_file

SCHEMA = "id int, who string"


def test_one_of_two_files_is_put(spark, tmp_path):
    path = str(tmp_path / "d" / "f.json")
    assert put_file(spark, path, b"one") and not put_file(spark, path, b"two")
    assert read_file(spark, path) == b"one"
    assert put_file(spark, path, b"three", replace=True) and read_file(spark, path) == b"three"
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["f.json"]
    ledgers.write_json(spark, {"b": 1, "a": "é"}, path)
    assert read_file(spark, path).decode() == '{"a": "é", "b": 1}'


def test_two_writers_race(spark, tmp_path):
    """Both have looked and written before either commits; the second leaves out what the first added."""
    path, meet, added = str(tmp_path / "t"), threading.Barrier(2, timeout=120), {}

    def write(who, ids):
        first = [True]

        def wait():
            if first:
                first.pop()
                meet.wait()

        added[who] = CommitLog(spark, path).append_once(spark.createDataFrame([(i, who) for i in ids], SCHEMA), "id", before_commit=wait)

    threads = [threading.Thread(target=write, args=a) for a in (("x", range(0, 6)), ("y", range(3, 10)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = CommitLog(spark, path)
    rows = log.read().collect()
    assert sorted(r.id for r in rows) == list(range(10)) and sum(added.values()) == 10 and log.version() == 1
    assert {r.who for r in rows if 3 <= r.id < 6} in ({"x"}, {"y"})
    assert log.vacuum(0) == []


def test_a_writer_that_dies_before_its_commit(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    assert log.read() is None and log.version() == -1
    log.append_once(spark.createDataFrame([(1, "a")], SCHEMA), "id")

    def die():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        log.append_once(spark.createDataFrame([(2, "b")], SCHEMA), "id", before_commit=die)
    assert [tuple(r) for r in log.read().collect()] == [(1, "a")] and log.version() == 0
    assert log.append_once(spark.createDataFrame([(2, "b"), (1, "z"), (2, "c")], SCHEMA), "id") == 2
    assert log.append_once(spark.createDataFrame([(2, "b")], SCHEMA), "id") == 0 and log.version() == 1
    assert log.vacuum(3600) == [] and len(log.vacuum(0)) == 1
    assert sorted(tuple(r) for r in log.read().collect()) == [(1, "a"), (2, "b"), (2, "c")]


def test_versions_and_full_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidewright.sources.commits._FULL", 3)
    log = CommitLog(spark, str(tmp_path / "t"))
    for i in range(7):
        log.append_once(spark.createDataFrame([(i, "a")], SCHEMA), "id")
    assert [sorted(r.id for r in log.read(v).collect()) for v in (0, 2, 3, 6)] == [[0], [0, 1, 2], [0, 1, 2, 3], list(range(7))]
    before = log.read()
    log.overwrite(spark.createDataFrame([(50, "b")], SCHEMA))
    log.append_once(spark.createDataFrame([(51, "b"), (0, "b")], SCHEMA), "id")
    assert sorted(r.id for r in log.read().collect()) == [0, 50, 51] and before.count() == 7


def test_a_stage_that_fails_on_a_second_run_leaves_its_output(spark, tmp_path):
    fine = [True]

    def stage(spark, before, config):
        return spark.range(3) if fine[0] else spark.range(3).selectExpr("raise_error('late') AS id")

    run = stages.StageRunner(spark, str(tmp_path), {}, [("only", stage)])
    run.run()
    fine[0] = False
    with pytest.raises(Exception, match="late"):
        run.run(from_stage="only")
    assert run.output("only").count() == 3 and run.status() == {"only": "failed"}


def test_tree_hash(spark, tmp_path):
    root = tmp_path / "tree é"
    for name, text in {"a/x.json": "1", "a-b/y.json": "22", "a/_private": "3", ".hidden": "4", "z z.txt": "", "a/b/c/d.txt": "x" * 9_000_000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    want = hashlib.sha256()
    for child in sorted(p for p in root.rglob("*") if p.is_file()):
        want.update(child.relative_to(root).as_posix().encode() + b"\0" + hashlib.sha256(child.read_bytes()).hexdigest().encode() + b"\n")
    assert files.tree_hash(spark, str(root)).first()[0] == want.hexdigest()
    (root / "a" / "._x.json").write_bytes(b"finder metadata")
    assert files.tree_hash(spark, str(root)).first()[0] == want.hexdigest()
    (root / "a" / "x.json").write_text("2")
    assert files.tree_hash(spark, str(root)).first()[0] != want.hexdigest()
    assert files.tree_hash(spark, str(root / "a-b" / "y.json")).first()[0] == hashlib.sha256(b"22").hexdigest()
    (tmp_path / "empty").mkdir()
    assert files.tree_hash(spark, str(tmp_path / "empty")).first()[0] == hashlib.sha256(b"").hexdigest()


def test_reports_are_whole_or_refused(spark):
    scores = spark.range(12).selectExpr("id AS n", "id / 3 AS score")
    assert evaluation.markdown_report(scores, ["n"], most=12).count("\n") == 14
    with pytest.raises(ValueError):
        evaluation.markdown_report(scores, ["n"], most=11)
