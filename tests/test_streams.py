import pytest
from pyspark.sql import functions as F

from strophe.streaming import exact, incremental


def arrive(spark, path, rows, schema="task_id string, s double, status string"):
    """One more file of the stream."""
    spark.createDataFrame(rows, schema).coalesce(1).select("*", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts")).drop("s").write.mode("append").json(path)


def test_polls_by_event_time(spark, tmp_path):
    """Outcomes follow the events' own time: late and unordered updates count, the wall clock doesn't; a restart goes on."""
    path, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))

    def run():
        events = spark.readStream.schema("task_id string, ts timestamp, status string").option("maxFilesPerTrigger", 1).json(path)
        incremental.poll(events, 60_000, late="100 seconds").writeStream.format("json").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("task_id string, outcome string, polls long").json(out).collect())

    arrive(spark, path, [("a", 10.0, "running"), ("a", 30.0, "succeeded"), ("b", 10.0, "running"), ("c", 100.0, "succeeded"), ("d", 5.0, "running"), ("e", 10.0, "running"), ("e", 10.0, "failed"), ("e", 10.0, "succeeded"), ("f", 10.0, "running"), ("f", 70.0, "succeeded")])
    assert run() == []
    # a's earlier failure and b's and c's earlier updates come late; d's end comes after its time
    arrive(spark, path, [("a", 20.0, "failed"), ("b", 40.0, "running"), ("c", 50.0, "running"), ("d", 66.0, "succeeded"), ("a", 25.0, "running")])
    run()
    arrive(spark, path, [("z", 500.0, "running")])
    want = [("a", "failed", 2), ("b", "timeout", 2), ("c", "succeeded", 2), ("d", "timeout", 1), ("e", "failed", 3), ("f", "succeeded", 2)]
    assert run() == want
    arrive(spark, path, [("a", 450.0, "succeeded"), ("b", 460.0, "succeeded")])
    assert run() == want and run() == want


def test_windows_drop_what_comes_too_late(spark, tmp_path):
    path, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))

    def run():
        log = spark.readStream.schema("task_id string, ts timestamp").option("maxFilesPerTrigger", 1).json(path)
        rates = incremental.request_windows(log, late="30 seconds").select(F.unix_seconds("window.start").alias("s"), "n")
        rates.writeStream.format("json").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return {r.s: r.n for r in spark.read.schema("s long, n long").json(out).collect()}

    arrive(spark, path, [("a", 100.0, ""), ("a", 103.0, ""), ("a", 112.0, "")])
    arrive(spark, path, [("a", 90.0, ""), ("a", 300.0, "")])  # late, but in time
    arrive(spark, path, [("a", 310.0, "")])
    arrive(spark, path, [("a", 101.0, ""), ("a", 900.0, "")])  # too late: its windows are out
    got = run()
    assert got[100] == 2 and got[103] == 2 and got[91] == 1 and got[90] == 1 and got[300] == 1 and max(got.values()) == 2
    assert run() == got


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_appends_are_exactly_once_when_killed(spark, tmp_path, monkeypatch, steps):
    """The run dies before, between and after renames; the next one, from its checkpoint, adds what is missing and nothing else."""
    path, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    arrive(spark, path, [(f"k{i:03d}", float(i), "x") for i in range(25)])
    stream = lambda: spark.readStream.schema("task_id string, ts timestamp, status string").json(path)
    run = lambda: exact.append_once(stream(), "task_id", lambda b: b.select("task_id", "status"), out, at, every=10, kind="csv", header=True).awaitTermination()
    commit, done = exact.Ledger.commit, []

    def dies(self, batch, flush):
        if len(done) == steps:
            raise RuntimeError("killed")
        done.append(flush)
        commit(self, batch, flush)

    monkeypatch.setattr(exact.Ledger, "commit", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    read = lambda: exact.read_appended(spark, out, "task_id string, status string", "csv", header=True)
    assert read().count() == 10 * steps
    monkeypatch.setattr(exact.Ledger, "commit", commit)
    run()
    arrive(spark, path, [(f"m{i}", float(i), "x") for i in range(3)])
    run()
    run()
    rows = read().collect()
    assert sorted(r.task_id for r in rows) == sorted([f"k{i:03d}" for i in range(25)] + [f"m{i}" for i in range(3)])
    sizes = {}
    for r in rows:
        sizes[r.flush] = sizes.get(r.flush, 0) + 1
    assert [sizes[f] for f in sorted(sizes)] == [10, 10, 5, 3]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted(sizes)


def test_a_commit_lists_no_flushes(spark, tmp_path, monkeypatch):
    """A listing for each commit would make the commits quadratic in the flushes."""
    ledger = exact.Ledger(spark, str(tmp_path / "out"))
    (tmp_path / "out" / "_staging-3" / "__flush=1").mkdir(parents=True)
    monkeypatch.setattr(exact.Ledger, "names", lambda self: pytest.fail("listed"))
    ledger.commit(3, 1)
    ledger.commit(3, 1)  # again, after a crash
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("flush")] == ["flush-000000003-000000001"]
    with pytest.raises(Exception, match="__flush=2|can't rename"):  # a flush that isn't there
        ledger.commit(3, 2)


def test_a_poll_has_one_timer_for_each_end(monkeypatch):
    """Not one for each final status: a task's updates of one batch cost one append and at most one timer."""

    class State(list):
        def get(self):
            return iter(self)

        def exists(self):
            return bool(self)

        def appendList(self, rows):
            self.extend(rows)

    class Handle:
        timers = []
        getListState = getValueState = lambda self, *a: State()

        def registerTimer(self, ms):
            self.timers.append(ms)

    p = incremental._Poll("k", 60_000_000)
    p.init(Handle())
    batch = lambda *us: p.handleInputRows(("a",), iter([{"us": x * 1_000_000, "status": "failed"} for x in us]), None)
    batch(*range(100, 150))
    batch(*range(150, 200))
    assert Handle.timers == [100_001]
    batch(90, 95)
    batch(10)
    assert Handle.timers == [100_001, 90_001, 10_001]
