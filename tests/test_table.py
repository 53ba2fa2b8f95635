"""The table against a dict, over flushes, compactions, crashes and threads."""

import io
import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from keyfold import cli
from keyfold.operators.table import ClosedTable, KVTable
from keyfold.plans import resolve
from keyfold.plans.schema import CHANGELOG
from keyfold.queries import QUERIES
from keyfold.sources import manifest as mf
from keyfold.sources import runs as rn
from keyfold.sources import segments as sg
from keyfold.streaming.sink import table_sink


def rows(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def mutate(table, state, seed, n, keys=60, deletes=3):
    r = random.Random(seed)
    for _ in range(n):
        key = b"key-%03d" % r.randrange(keys)
        if r.randrange(10) < 10 - deletes:
            state[key] = r.randbytes(r.randrange(1, 41))
            table.put(key, state[key])
        else:
            state.pop(key, None)
            table.delete(key)


def frame(spark, pairs):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], "key binary, value binary")


def test_random_operations_match_a_dict(spark, tmp_path):
    state = {}
    with KVTable.open(spark, tmp_path / "t", flush_threshold=24, fsync=False) as table:
        mutate(table, state, 11, 400)
        assert rows(table.scan()) == sorted(state.items())
        for low, high in ((b"key-010", b"key-030"), (None, b"key-020"), (b"key-050", None), (b"key-023", b"key-024")):
            assert rows(table.scan(low, high)) == sorted((k, v) for k, v in state.items() if (low is None or k >= low) and (high is None or k < high))
        assert table.size() == len(state)
        assert all(table.get(k) == state.get(k) for k in (b"key-000", b"key-017", b"key-059", b"nothing"))
        assert table.compactions > 0 and max(table.run_counts()) >= 1
        table.compact()
        assert 0 not in table.run_counts()
        assert rows(table.scan()) == sorted(state.items())
        assert table.scan(limit=3).count() == 3
        assert rows(table.prefix_scan("key-01")) == sorted((k, v) for k, v in state.items() if k.startswith(b"key-01"))
    with KVTable.open(spark, tmp_path / "t") as table:
        assert rows(table.scan()) == sorted(state.items())


def test_byte_order_empty_values_and_ranges(spark, tmp_path):
    keys = [bytes.fromhex(x) for x in "00 01 7f 80 81 fe ff 8000 ff00 00ff".split()] + [b""]
    with KVTable.open(spark, tmp_path / "t") as table:
        for k in keys:
            table.put(k, b"" if k == b"\x80" else k + b"v")
        table.flush()
        assert [k for k, _ in rows(table.scan())] == sorted(keys)
        assert table.get(b"\x80") == b"" and table.size() == 11
        for low, high in ((b"\x80", b"\x80"), (b"\x81", b"\x01"), (b"\xff\xff", None)):
            assert rows(table.scan(low, high)) == []
        for bad in (lambda: table.put(None, b""), lambda: table.put(b"", None), lambda: table.get(None), lambda: table.delete(None)):
            with pytest.raises(TypeError):
                bad()


def test_deletes_shadow_until_nothing_lies_below(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"gone", b"1"), (b"stays", b"2")]))
        table.compact()
        table.delete_all(spark.createDataFrame([(bytearray(b"gone"),), (bytearray(b"never"),)], "key binary"))
        assert rows(table.scan()) == [(b"stays", b"2")] and table.get(b"gone") is None
        table.compact()
        assert sum(r["tombstones"] for r in table.describe().collect()) == 0
        table.put(b"gone", b"back")
        assert table.get(b"gone") == b"back"


def test_bulk_writes_order_and_refusals(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t") as table:
        twice = spark.createDataFrame([(b"a", b"old", 1), (b"a", b"new", 2), (b"b", b"x", 1)], "key binary, value binary, at int")
        with pytest.raises(ValueError, match="order_by"):
            table.put_all(twice)
        assert table.put_all(twice, order_by="at") == 2
        assert rows(table.scan()) == [(b"a", b"new"), (b"b", b"x")]
        with pytest.raises(ValueError, match="null"):
            table.put_all(spark.createDataFrame([(None, b"x")], "key binary, value binary"))
        assert table.put_all(twice.where("false")) == 0
        table.put(b"a", b"single")
        table.put_all(frame(spark, [(b"a", b"bulk")]))
        assert table.get(b"a") == b"bulk"
        hits = spark.createDataFrame([(b"a",), (b"zz",)], "key binary")
        assert rows(table.multi_get(hits)) == [(b"a", b"bulk")]
        assert [bytes(r["key"]) for r in table.multi_get_misses(hits).collect()] == [b"zz"]


def test_streamed_batches_count_once(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t") as table:
        sink = table_sink(table, "s")
        batch = spark.createDataFrame([(b"k", "P", b"1")], "key binary, op string, value binary")
        sink(batch, 0)
        sink(spark.createDataFrame([(b"k", "D", None)], "key binary, op string, value binary"), 1)
        sink(batch, 0)
        assert table.size() == 0
    with KVTable.open(spark, tmp_path / "t") as table:
        table_sink(table, "s")(batch, 1)
        assert table.size() == 0


def test_snapshots_outlive_writes_and_compactions(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t", flush_threshold=20, fsync=False) as table:
        table.put_all(frame(spark, [(b"k%02d" % k, b"1") for k in range(50)]))
        snapshot = table.snapshot()
        held = snapshot.scan()
        table.put_all(frame(spark, [(b"k%02d" % k, b"2") for k in range(50)]))
        table.compact()
        table.vacuum()
        assert rows(held) == [(b"k%02d" % k, b"1") for k in range(50)]
        assert snapshot.size() == 50
        snapshot.release()
        assert table.vacuum() > 0
        assert {v for _, v in rows(table.scan())} == {b"2"}
        assert rows(table.snapshot(table.version).scan()) == rows(table.scan())


@pytest.mark.parametrize("keep", ["before", "after"])
def test_a_crash_leaves_the_old_or_the_new_state(spark, tmp_path, keep):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"k%d" % k, b"old") for k in range(9)]))
        table.compact()
        table.delete_all(spark.createDataFrame([(b"k0",)], "key binary"))
        before = table.version
        shutil.copytree(tmp_path / "t", tmp_path / "copy")
        table.compact()
        expected = rows(table.scan())
    shutil.copytree(tmp_path / "t" / "runs", tmp_path / "copy" / "runs", dirs_exist_ok=True)
    if keep == "after":
        shutil.copytree(tmp_path / "t" / "manifest", tmp_path / "copy" / "manifest", dirs_exist_ok=True)
    folders = mf.run_folders(tmp_path / "copy")
    with KVTable.open(spark, tmp_path / "copy") as table:
        assert rows(table.scan()) == expected
        assert (table.version == before) == (keep == "before")
        assert (mf.run_folders(tmp_path / "copy") < folders) == (keep == "before")


def test_recovery_of_the_log_missing_runs_and_adoption(spark, tmp_path):
    table = KVTable.open(spark, tmp_path / "t")
    table.put(b"a", b"1")
    table.close()
    table.close()
    with pytest.raises(ClosedTable):
        table.get(b"a")
    with KVTable.open(spark, tmp_path / "t") as table:
        assert table.get(b"a") == b"1" and table.stats.wal == 0
        table.flush()
        table.flush()
        assert table.run_counts() == {0: 1}
    shutil.copytree(tmp_path / "t", tmp_path / "bare")
    shutil.rmtree(tmp_path / "bare" / "manifest")
    with KVTable.open(spark, tmp_path / "bare") as table:
        assert table.get(b"a") == b"1"
    shutil.rmtree(tmp_path / "t" / "runs")
    with pytest.raises(mf.ManifestError, match="missing"):
        KVTable.open(spark, tmp_path / "t")


def test_damage_names_the_run(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"k%04d" % k, random.Random(k).randbytes(60)) for k in range(3000)]))
        run, *_ = sorted(table.describe().collect(), key=lambda r: r["path"])
        file = tmp_path / "t" / "runs" / run["path"]
        data = bytearray(file.read_bytes())
        data[len(data) // 3] ^= 0xFF
        file.write_bytes(data)
        assert table.verify() == [run["path"]]
        with pytest.raises(rn.CorruptRun, match=run["path"].split("/")[0]):
            for k in range(0, 3000, 250):
                table.get(b"k%04d" % k)


def test_background_compaction_with_readers(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t", flush_threshold=10, fsync=False, background=True) as table:
        seen, stop = [], threading.Event()

        def read():
            while not stop.is_set():
                with table.snapshot() as s:
                    seen.append(s.size())

        reader = threading.Thread(target=read)
        reader.start()
        for k in range(120):
            table.put(b"k%04d" % k, b"k%04d" % k)
        stop.set()
        reader.join()
        assert seen == sorted(seen) and table.size() == 120
        table.compact()
        assert table.compactions > 0 and all(k == v for k, v in rows(table.scan()))


def test_statistics(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put(b"abc", b"12345")
        table.delete(b"abc")
        assert table.stats.logical == 11 and table.stats.wal == 17 * 2 + 11
        table.put(b"x", b"y")
        table.flush()
        assert table.stats.flush > 0 and table.stats.write_amplification > 1
        assert {r["metric"] for r in table.io_stats().collect()} >= {"logical", "physical"}
        with table.snapshot() as s:
            assert s.space_amplification() > 1


def test_key_ranges_reach_the_scan_and_single_runs_need_no_shuffle(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t", run_entries=100) as table:
        table.put_all(frame(spark, [(b"k%03d" % k, b"v") for k in range(500)]))
        table.compact()
        plan = table._view().live(b"k010", b"k020")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "GreaterThanOrEqual(key" in plan and "Exchange" not in plan
        assert len(rn.prune(table._manifest.runs, b"k010", b"k020")) < len(table._manifest.runs)


def test_newest_keeps_deletes_and_empty_values(spark):
    changes = spark.createDataFrame([(b"a", 1, "P", b"x"), (b"a", 2, "D", None), (b"b", 1, "D", None), (b"b", 3, "P", b""), (b"", 1, "P", b"e")], CHANGELOG)
    assert sorted(rows(resolve.live(changes))) == [(b"", b"e"), (b"b", b"")]
    assert resolve.live_count(changes).first()["n"] == 2
    assert resolve.tombstones(changes).count() == 1
    assert resolve.layer_stats(changes, F.lit(0)).first()["tombstones"] == 2


def test_command_line(spark, tmp_path):
    def call(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.run(list(args), out, err, spark), out.getvalue(), err.getvalue()

    folder = str(tmp_path / "t")
    for k in "abcd":
        assert call("put", folder, k, k.upper())[:2] == (0, "ok\n")
    assert call("get", folder, "b")[:2] == (0, "B\n") and call("get", folder, "zz")[:2] == (1, "")
    assert call("scan", folder, "b", "d")[:2] == (0, "b\tB\nc\tC\n")
    assert call("scan", folder, "", "b")[:2] == (0, "a\tA\n")
    assert call("delete", folder, "a")[:2] == (0, "ok\n")
    assert call("compact", folder)[:2] == (0, "")
    assert call("info", folder)[:2] == (0, "live_keys=3 run_files=1 deepest_level=1\n")
    for bad in ((), ("put", folder, "k"), ("fly", folder), ("scan",)):
        assert call(*bad)[0] == 2 and "usage" in call(*bad)[2]


# ---- concurrency, pins, crashes in between, what a read touches


def slow(monkeypatch, started, go):
    """Holds every write of a run between its job and its commit."""
    write = rn.write_run

    def held(*args, **more):
        out = write(*args, **more)
        started.set()
        assert go.wait(60)
        return out

    monkeypatch.setattr(rn, "write_run", held)


def test_readers_do_not_wait_for_a_writer(spark, tmp_path, monkeypatch):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"a", b"old")]))
        table.put(b"b", b"buffered")
        started, go = threading.Event(), threading.Event()
        slow(monkeypatch, started, go)
        writer = threading.Thread(target=lambda: table.put_all(frame(spark, [(b"a", b"new"), (b"c", b"new")])))
        writer.start()
        try:
            assert started.wait(60)
            assert table.get(b"a") == b"old" and table.get(b"b") == b"buffered"
            assert rows(table.scan()) == [(b"a", b"old"), (b"b", b"buffered")]
            with table.snapshot() as s:
                assert s.size() == 2
        finally:
            go.set()
            writer.join()
        assert rows(table.scan()) == [(b"a", b"new"), (b"b", b"buffered"), (b"c", b"new")]


def test_a_flush_that_lands_during_a_merge_stays(spark, tmp_path, monkeypatch):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"a", b"1"), (b"b", b"1")]))
        started, go = threading.Event(), threading.Event()
        write = rn.write_run

        def held(changes, path, level, *args, **more):
            out = write(changes, path, level, *args, **more)
            if level:
                started.set()
                assert go.wait(60)
            return out

        monkeypatch.setattr(rn, "write_run", held)
        merge = threading.Thread(target=lambda: table._compact_once(force=True))
        merge.start()
        try:
            assert started.wait(60)
            table.put(b"a", b"2")
            table.flush()
            assert table.get(b"a") == b"2"
        finally:
            go.set()
            merge.join()
        assert table.run_counts() == {0: 1, 1: 1} and rows(table.scan()) == [(b"a", b"2"), (b"b", b"1")]


def test_frames_of_a_scan_keep_their_runs_until_released(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"k%02d" % k, b"1") for k in range(20)]))
        held, derived = table.scan(), table.live().where("key > 'k10'")
        table.put_all(frame(spark, [(b"k%02d" % k, b"2") for k in range(20)]))
        table.compact()
        table.vacuum()
        assert rows(held) == [(b"k%02d" % k, b"1") for k in range(20)] and derived.count() == 9
        table.release_scans()
        assert table.vacuum() > 0
        assert {v for _, v in rows(table.scan())} == {b"2"}


def test_writers_stall_while_compaction_is_behind(spark, tmp_path, monkeypatch):
    from keyfold.plans import planner

    monkeypatch.setattr(planner, "STALL_TRIGGER", 5)
    with KVTable.open(spark, tmp_path / "t", flush_threshold=4, fsync=False, background=True) as table:
        table._busy.acquire()  # no compaction can start
        most = []
        writer = threading.Thread(target=lambda: [table.put(b"k%04d" % (k * 37 % 100), b"v") for k in range(40)])
        writer.start()
        try:
            writer.join(20)
            assert writer.is_alive() and table.write_stalls > 0
            most.append(len({r.seq for r in planner.at_level(table._manifest.runs, 0)}))
        finally:
            table._busy.release()
            writer.join()
        assert most[0] == planner.STALL_TRIGGER and table.size() == 40
        got = {r["metric"]: r["value"] for r in table.overview().collect()}
        assert got["write_stalls"] == table.write_stalls > 0 and got["compactions"] == table.compactions and got["deepest_level"] >= 1


def test_a_crash_between_flush_and_log_reset_loses_nothing(spark, tmp_path):
    state = {}
    with KVTable.open(spark, tmp_path / "t", flush_threshold=10_000, fsync=False) as table:
        mutate(table, state, 17, 400, keys=80)
        shutil.copy(tmp_path / "t" / "wal.log", tmp_path / "kept")
        table.flush()
    shutil.copy(tmp_path / "kept", tmp_path / "t" / "wal.log")
    with KVTable.open(spark, tmp_path / "t") as table:
        assert rows(table.scan()) == sorted(state.items())
        table.flush()
        table.compact()
        assert rows(table.scan()) == sorted(state.items())


def test_restarts_in_between_lose_nothing(spark, tmp_path):
    state = {}
    for part in range(6):
        with KVTable.open(spark, tmp_path / "t", flush_threshold=96, fsync=False) as table:
            mutate(table, state, 23 + part, 250, keys=300)
            assert rows(table.scan()) == sorted(state.items())


def test_deletes_and_restores_over_generations(spark, tmp_path):
    keys = [b"g%03d" % k for k in range(40)]
    with KVTable.open(spark, tmp_path / "t") as table:
        for generation in range(4):
            table.put_all(frame(spark, [(k, b"%d" % generation) for k in keys]))
            assert {v for _, v in rows(table.scan())} == {b"%d" % generation}
            table.delete_all(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"))
            assert table.size() == 0 and table.get(keys[7]) is None
        table.compact()
        assert table.size() == 0 and table.run_counts() == {}


def read_rows(df):
    """The rows that the scans of a plan handed on."""
    df.collect()

    def walk(node):
        if "FileSourceScan" in node.getClass().getSimpleName():
            yield node.metrics().apply("numOutputRows").value()
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            yield from walk(node.executedPlan())
        children = node.children()
        for k in range(children.size()):
            yield from walk(children.apply(k))

    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_a_read_touches_a_page_and_an_absent_key_none(spark, tmp_path):
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"k%06d" % (2 * k), random.Random(k).randbytes(20)) for k in range(30_000)]))
        table.compact()
        point = lambda key: table._view().live(key, key + b"\0").where(F.col("key") == F.lit(key))
        assert 1 <= read_rows(point(b"k%06d" % 30_000)) <= 2 * rn.PAGE_ROWS
        absent = sum(read_rows(point(b"k%06d" % k)) > 0 for k in range(20_001, 20_041, 2))
        assert absent <= 2
        assert read_rows(table._view().live(b"k000000", b"k000100")) <= 2 * rn.PAGE_ROWS
        assert read_rows(table._view().live()) == 30_000


def test_bulk_files_are_disjoint_and_failed_writes_leave_nothing(spark, tmp_path, monkeypatch):
    with KVTable.open(spark, tmp_path / "t", run_entries=400) as table:
        monkeypatch.setattr("keyfold.operators.table.RUN_ENTRIES", 400)
        assert table.put_all(frame(spark, [(b"k%05d" % k, b"v") for k in range(3000)])) == 3000
        assert rn.disjoint(list(table._manifest.runs)) and len(table._manifest.runs) >= 7
        folders = mf.run_folders(tmp_path / "t")
        with pytest.raises(ValueError, match="null"):
            table.put_all(spark.createDataFrame([(b"a", None)], "key binary, value binary"))
        assert mf.run_folders(tmp_path / "t") == folders and table.size() == 3000
        assert table.stats.logical == 3000 * 7


@pytest.mark.parametrize(
    ("args", "code", "said"),
    [(("get", "T", "nothing"), 1, ""), (("scan", "T"), 0, "a\t1\nb\t2\n"), (("scan", "T", "b"), 0, "b\t2\n"), (("scan", "T", "z", "a"), 0, ""), (("delete", "T", "nothing"), 0, "ok\n"), (("get", "T"), 2, ""), (("info",), 2, ""), (("info", "T", "x"), 2, "")],
)
def test_commands_and_their_codes(spark, tmp_path, args, code, said):
    with KVTable.open(spark, tmp_path / "t", fsync=False) as table:
        table.put("a", "1")
        table.put("b", "2")
    out, err = io.StringIO(), io.StringIO()
    assert cli.run([str(tmp_path / "t") if x == "T" else x for x in args], out, err, spark) == code
    assert out.getvalue() == said and ("usage" in err.getvalue()) == (code == 2)


def many(spark, n, keys, seed=5):
    """Mutations in no order of their column, and the state after them."""
    r, state = random.Random(seed), {}
    out = [(at, b"k%04d" % r.randrange(keys), r.choice("PPD"), r.randbytes(r.randrange(0, 30))) for at in range(n)]
    for _, key, op, value in out:
        state[key] = value if op == "P" else None
    r.shuffle(out)
    return spark.createDataFrame([(at, k, op, v if op == "P" else None) for at, k, op, v in out], "at long, key binary, op string, value binary"), {k: v for k, v in state.items() if v is not None}


def test_mutations_that_tasks_log_are_single_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "SEGMENT_BYTES", 4_000)
    df, state = many(spark, 2_000, 300)
    with KVTable.open(spark, tmp_path / "t") as table:
        table.put_all(frame(spark, [(b"k0000", b"old"), (b"z", b"below")]))
        table.put(b"k0001", b"before")
        before = table.run_counts()[0]
        assert table.log_all(df, order_by="at") == 2_000
        assert table.stats.wal == sum(s.size for s in table._segments) + 17 + 11 and len(table._segments) > 10
        assert table.run_counts() == {0: before + 1}  # what was logged singly before has been flushed
        state[b"z"] = b"below"
        table.put(b"k0002", b"after")
        state[b"k0002"] = b"after"
        assert rows(table.scan()) == sorted(state.items()) and table.size() == len(state)
        assert rows(table.scan(b"k0100", b"k0200")) == sorted((k, v) for k, v in state.items() if b"k0100" <= k < b"k0200")
        assert all(table.get(k) == state.get(k) for k in (b"k0000", b"k0002", b"k0150"))
    with KVTable.open(spark, tmp_path / "t") as table:
        held = table.live()
        assert sorted(rows(held)) == sorted(state.items()) and len(table._segments) > 10
        table.flush()
        assert not table._segments and table._log.path.stat().st_size == 0 and not list((tmp_path / "t" / "wal").glob("*.json"))
        assert sorted(rows(held)) == sorted(state.items())  # pinned
        assert rows(table.scan()) == sorted(state.items())
        table.release_scans()
        table.vacuum()
        assert not list((tmp_path / "t" / "wal").iterdir())
    with KVTable.open(spark, tmp_path / "t", flush_threshold=1_000) as table:
        assert rows(table.scan()) == sorted(state.items())
        table.log_all(df, order_by="at")
        assert not table._segments and table.run_counts()


def test_tasks_log_all_or_nothing_and_damage_is_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "READ_BYTES", 100)
    df, state = many(spark, 200, 40)
    with KVTable.open(spark, tmp_path / "t") as table:
        for bad in ("cast(null as binary) as key, op, value, at", "key, 'X' as op, value, at", "key, 'P' as op, cast(null as binary) as value, at", "key, op, value, cast(null as long) as at"):
            with pytest.raises(ValueError, match="null"):
                table.log_all(df.selectExpr(*[x.strip() for x in bad.split(", ")]), order_by="at")
        assert table.log_all(df.where("false"), order_by="at") == 0
        assert not list((tmp_path / "t" / "wal").iterdir()) and table.size() == 0
        table.log_all(df, order_by="at")
        table.log_all(spark.createDataFrame([(b"k0001", "P", b"1", 0), (b"k0001", "D", None, 1), (b"k0002", "D", None, 0), (b"k0002", "P", b"2", 0)], "key binary, op string, value binary, at int"), order_by="at")
    state.pop(b"k0001", None)
    state[b"k0002"] = b"2"
    (tmp_path / "t" / "wal" / f"b00000009-{'0' * 32}").mkdir()  # of a write that was never committed
    with KVTable.open(spark, tmp_path / "t") as table:
        assert rows(table.scan()) == sorted(state.items())
        assert len(list((tmp_path / "t" / "wal").iterdir())) == 4
        file = tmp_path / "t" / "wal" / table._segments[0].name
        data = bytearray(file.read_bytes())
        data[len(data) // 2] ^= 0xFF
        file.write_bytes(data)
        with pytest.raises(Exception, match="DamagedSegment"):
            table.scan().collect()
    file.write_bytes(data[:-1])
    with pytest.raises(sg.DamagedSegment, match="length"):
        KVTable.open(spark, tmp_path / "t")


def test_a_crash_between_flush_and_the_reset_of_segments_loses_nothing(spark, tmp_path):
    df, state = many(spark, 500, 80)
    with KVTable.open(spark, tmp_path / "t") as table:
        table.log_all(df, order_by="at")
        shutil.copytree(tmp_path / "t" / "wal", tmp_path / "kept")
        table.flush()
    shutil.copytree(tmp_path / "kept", tmp_path / "t" / "wal", dirs_exist_ok=True)
    with KVTable.open(spark, tmp_path / "t") as table:
        assert table._segments and rows(table.scan()) == sorted(state.items())
        table.compact()
        assert not table._segments and rows(table.scan()) == sorted(state.items())


@pytest.mark.parametrize("name", ["kv_table_log_replay", "kv_table_flush_crash"])
def test_no_mutation_comes_to_the_driver_to_be_logged(spark, tmp_path, monkeypatch, name):
    for call in ("put", "delete"):
        monkeypatch.setattr(KVTable, call, lambda *_: pytest.fail("a mutation came to the driver"))
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda *_: pytest.fail("rows came to the driver"))
    spark.sql("SELECT id AS event_id, id % 7 AS user_id, if(id % 5 = 0, 'error', 'view') AS event_type, id / 4 AS value FROM range(1000)").write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, QUERIES["kv_live_scan"](spark, str(tmp_path)).collect()))
    assert want and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want


def test_files_are_described_without_a_sort_of_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(rn.WRITE_OPTIONS, "parquet.block.size", "20000")
    monkeypatch.setitem(rn.WRITE_OPTIONS, "parquet.block.size.row.check.min", "100")
    rows = [(bytearray(b"k%06d" % k), 3, "D" if k % 7 == 0 else "P", None if k % 7 == 0 else bytearray(random.Random(k).randbytes(30))) for k in range(9_000)]
    made = spark.createDataFrame(rows, CHANGELOG)
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")  # several tasks read a file
    try:
        for most in (9_000, 4_000, 20):  # 450 files at last, more than a hash aggregate of objects holds groups
            got = rn.write_run(made, tmp_path, 0, 3, most, 1)
            want = [rows[k : k + most] for k in range(0, 9_000, most)]
            assert [(r.first_key, r.last_key, r.entries, r.tombstones) for r in got] == [(bytes(x[0][0]), bytes(x[-1][0]), len(x), sum(r[2] == "D" for r in x)) for x in want]
        folder = got[0].path.split("/")[0]
        read = rn.read_changelog(spark, [rn.uri(tmp_path, folder)])
        assert "Sort" not in rn.per_file(read)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
