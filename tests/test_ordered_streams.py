import datetime
import random

from tidewright.operators import folds
from tidewright.streaming import ordered, twins

START = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id int, ts timestamp, t double, kind string"


def scan_rows(seed=5, n=120):
    rng = random.Random(seed)
    times = sorted(rng.randrange(40_000) for _ in range(n))
    return [(rng.randrange(3), START + datetime.timedelta(seconds=t), float(t), rng.choice(["start", "end", "other"])) for t in times]


def put(spark, path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


END = [(99, START + datetime.timedelta(days=400), 0.0, "other")]


def files(rows, parts=3):
    """Rows in files by time, but a fifth of each file's rows come one file late."""
    size = -(-len(rows) // parts)
    out = [[] for _ in range(parts + 1)]
    for i, r in enumerate(rows):
        out[min(i // size + (i % 5 == 0), parts)].append(r)
    return out


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_rows_out_of_order_give_the_batch_result_also_after_a_restart(spark, tmp_path):
    path, rows = str(tmp_path / "in"), scan_rows()
    parts = files(rows)
    for i, part in enumerate(parts[:2]):
        put(spark, path, f"{i:02d}", part)

    def run():
        found = ordered.boundary_scan(stream(spark, path), "user_id", "ts", "t", "kind", ["start"], ["end"], "8 hours")
        return twins.run_to_table(found, str(tmp_path / "out"), str(tmp_path / "check"))

    before = run().count()
    for i, part in enumerate([*parts[2:], END], 2):
        put(spark, path, f"{i:02d}", part)
    got = run()
    want = folds.boundary_scan(spark.createDataFrame(rows, SCHEMA), "user_id", "t", "kind", ["start"], ["end"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > max(5, before)


def test_keys_that_rest_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "in")
    at = lambda s: START + datetime.timedelta(seconds=s)
    put(spark, path, "0", [(1, at(20), 20.0, "x"), (1, at(10), 10.0, "x"), (2, at(30), 30.0, "x")])
    put(spark, path, "1", [(2, at(900), 900.0, "x")])
    put(spark, path, "2", [(1, at(5000), 5000.0, "x"), (2, at(1200), 1200.0, "x")])
    put(spark, path, "3", END)
    found = ordered.carry_forward(stream(spark, path), "user_id", "ts", "t", "400 seconds", idle_sec=1000)
    got = sorted((r.user_id, r.t, r.seen_before, r.last_before) for r in twins.run_to_table(found, str(tmp_path / "out"), str(tmp_path / "check")).where("user_id < 99").collect())
    assert got == [(1, 10.0, 0, None), (1, 20.0, 1, 10.0), (1, 5000.0, 0, None), (2, 30.0, 0, None), (2, 900.0, 1, 30.0), (2, 1200.0, 2, 900.0)]


def test_keys_share_the_state_of_a_bucket(spark, tmp_path, monkeypatch):
    """Many keys, one of them null, in two buckets: the state is called for by buckets, and each key has its own scan and its own end."""
    path, groups = str(tmp_path / "in"), []
    monkeypatch.setattr(ordered.OrderedScan, "__init__", lambda self, *a, init=ordered.OrderedScan.__init__: groups.append(a[0]) or init(self, *a))
    at = lambda s: START + datetime.timedelta(seconds=s)
    keys = [None, *range(40)]
    put(spark, path, "0", [(k, at(20 + t), 20.0 + t, "x") for k in keys for t in (7, 0)])
    put(spark, path, "1", [(k, at(900), 900.0, "x") for k in keys if k is None or k % 2])
    put(spark, path, "2", [(k, at(1400), 1400.0, "x") for k in keys])
    put(spark, path, "3", END)
    found = ordered.carry_forward(stream(spark, path), "user_id", "ts", "t", "400 seconds", idle_sec=1000, buckets=2)
    got = {(r.user_id, r.t): (r.seen_before, r.last_before) for r in twins.run_to_table(found, str(tmp_path / "out"), str(tmp_path / "check")).where("user_id is null or user_id < 99").collect()}
    odd = lambda k: k is None or k % 2
    assert got == {(k, t): v for k in keys for t, v in [(20.0, (0, None)), (27.0, (1, 20.0)), *([(900.0, (2, 27.0)), (1400.0, (3, 900.0))] if odd(k) else [(1400.0, (0, None))])]}
    assert groups == [["own_key", "ts", "ts_2", "t"]] and found.schema["user_id"].dataType.simpleString() == "int"
