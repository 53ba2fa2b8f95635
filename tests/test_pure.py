"""The parts without Spark: keys, log, manifest, planner."""

import random
import struct
import zlib

import pytest

from keyfold.functions.keys import as_bytes, is_empty_range, successor
from keyfold.functions.stats import IoStats
from keyfold.plans import planner
from keyfold.plans.schema import RunMeta
from keyfold.sources import manifest as mf
from keyfold.sources import segments as sg
from keyfold.sources.oplog import OVERHEAD, OpLog, UnknownRecord, decode_records, encode_record


def ops(seed, n=60, keys=10):
    r = random.Random(seed)
    return [("P", b"key-%d" % r.randrange(keys), r.randbytes(r.randrange(1, 9))) if r.randrange(10) < 7 else ("D", b"key-%d" % r.randrange(keys), None) for _ in range(n)]


def meta(level, seq, first, last, path=None):
    return RunMeta(path or f"run-{level:02d}-{seq:010d}-{'0' * 8}/{first.hex()}", level, seq, 1, 0, 10, first, last)


def test_log_recovers_a_prefix_after_any_truncation(tmp_path):
    todo = ops(1)
    data = b"".join(encode_record(*x) for x in todo)
    ends = [0]
    for x in todo:
        ends.append(ends[-1] + OVERHEAD + len(x[1]) + len(x[2] or b""))
    for cut in range(len(data) + 1):
        found = [x[1:] for x in decode_records(data[:cut])]
        assert found == todo[: max(k for k, e in enumerate(ends) if e <= cut)]


def test_log_recovers_a_prefix_after_any_flipped_byte():
    todo = ops(2, 25)
    data = b"".join(encode_record(*x) for x in todo)
    for at in range(len(data)):
        found = [x[1:] for x in decode_records(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :])]
        assert found == todo[: len(found)]


def test_log_cuts_a_torn_tail_and_goes_on(tmp_path):
    log = OpLog(tmp_path / "wal.log")
    log.append("P", b"a", b"1")
    log.append("P", b"b", b"")
    log.close()
    with open(tmp_path / "wal.log", "ab") as f:
        f.write(bytes.fromhex("00000032010203040909"))
    log = OpLog(tmp_path / "wal.log", fsync=False)
    assert log.recover() == [("P", b"a", b"1"), ("P", b"b", b"")]
    log.append("D", b"a", None)
    log.close()
    assert OpLog(tmp_path / "wal.log").recover()[-1] == ("D", b"a", None)


@pytest.mark.parametrize("at_once", [1, 8, 100, 1 << 20])
def test_a_segment_is_read_in_pieces_and_damage_is_an_error(tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(sg, "READ_BYTES", at_once)
    todo = [*ops(3, 40), ("P", b"long", random.Random(3).randbytes(5_000)), *ops(4, 20)]
    data = b"".join(encode_record(*x) for x in todo)
    file = tmp_path / "segment"
    file.write_bytes(data)
    assert [x for some in sg._records(str(file)) for x in some] == todo
    for bad in (data[:-3], *(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :] for at in (0, 3, 5, len(data) // 2, len(data) - 1))):
        file.write_bytes(bad)
        found = []
        with pytest.raises(sg.DamagedSegment):
            for some in sg._records(str(file)):
                found += some
        assert found == todo[: len(found)]


def test_ranges():
    assert is_empty_range(b"k5", b"k2") and is_empty_range(b"k3", b"k3") and not is_empty_range(None, b"a")
    assert successor(b"ab") == b"ac" and successor(b"a\xff\xff") == b"b" and successor(b"\xff") is None
    assert as_bytes("é") == b"\xc3\xa9"
    with pytest.raises(TypeError):
        as_bytes(None)


def test_manifest_commits_once_and_damage_is_fatal(tmp_path):
    m = mf.commit(tmp_path, mf.Manifest(1, 5, (meta(0, 4, b"a", b"\xff"),), {"s": 2}))
    assert mf.read(tmp_path) == m
    with pytest.raises(mf.CommitConflict):
        mf.commit(tmp_path, m)
    assert not list((tmp_path / mf.FOLDER).glob("*.tmp"))
    with pytest.raises(mf.ManifestError, match="missing"):
        mf.check(tmp_path, m)
    file = tmp_path / mf.FOLDER / "v000000000001.json"
    data = bytearray(file.read_bytes())
    data[10] ^= 1
    file.write_bytes(data)
    with pytest.raises(mf.ManifestError, match="damaged"):
        mf.read(tmp_path)


def test_deltas_replay_to_the_same_versions_and_vacuum_keeps_their_chain(tmp_path, monkeypatch):
    monkeypatch.setattr(mf, "CHECKPOINT_EVERY", 5)
    r, m, known = random.Random(3), mf.commit(tmp_path, mf.Manifest(1, 1)), {}
    for seq in range(2, 20):
        gone = {x.path for x in m.runs if r.random() < 0.3}
        m = mf.commit(tmp_path, m.with_runs([meta(0, seq, b"a%d" % seq, b"z%d" % seq)], gone, next_seq=seq, batches={"s": seq}), m)
        known[m.version] = m
    assert all(mf.read(tmp_path, v) == x for v, x in known.items())
    sizes = [len((tmp_path / mf.FOLDER / f"v{v:012d}.json").read_bytes()) for v in (10, 11)]
    assert sizes[1] < sizes[0]
    files, folders = mf.needed(tmp_path, [13, 19])
    assert files == {10, 11, 12, 13, 15, 16, 17, 18, 19} and folders <= mf.named_folders(tmp_path)
    for v in set(mf.versions(tmp_path)) - files:
        mf.drop_version(tmp_path, v)
    assert mf.read(tmp_path, 13) == known[13] and mf.read(tmp_path) == known[19]


def test_a_record_of_unknown_type_is_an_error_and_nothing_is_cut(tmp_path):
    payload = struct.pack(">bi", 7, 1) + b"k" + struct.pack(">i", -1)
    data = encode_record("P", b"a", b"1") + struct.pack(">iI", len(payload), zlib.crc32(payload)) + payload + encode_record("P", b"b", b"2")
    (tmp_path / "wal.log").write_bytes(data)
    with pytest.raises(UnknownRecord, match="type 7"):
        OpLog(tmp_path / "wal.log").recover()
    assert (tmp_path / "wal.log").read_bytes() == data


def test_names():
    assert mf.parse_name(mf.folder_name(2, 17)) == (2, 17)
    assert mf.parse_name("run-1-2-x") is None and mf.parse_name("tmp") is None


def test_planner_rules():
    l0 = [meta(0, k, b"b", b"d") for k in range(4)]
    assert planner.plan(l0[:3]) is None
    assert planner.plan([]) is None and planner.plan([], force=True) is None
    deep = [meta(1, 9, b"a", b"b"), meta(1, 9, b"c", b"e"), meta(1, 9, b"f", b"g"), meta(2, 8, b"a", b"z")]
    job = planner.plan(l0 + deep)
    assert job.target == 1 and set(job.inputs) == {*l0, deep[0], deep[1]} and not job.drop_tombstones
    assert planner.plan(l0).drop_tombstones
    assert planner.plan(l0[:1], force=True).inputs == (l0[0],)
    wide = [meta(1, 9, bytes([97 + 2 * k]), bytes([98 + 2 * k])) for k in range(5)]
    job = planner.plan(wide)
    assert job.target == 2 and job.inputs == (wide[0],) and job.drop_tombstones
    below = [meta(2, 3, b"a", b"b"), meta(2, 3, b"e", b"e"), meta(2, 3, b"x", b"z")]
    more = [*wide, meta(1, 9, b"q", b"r")]
    assert set(planner.plan(more + below).inputs) == {wide[0], wide[1], below[0]}
    assert [planner.budget(n) for n in (1, 2, 3)] == [4, 16, 64]


def test_amplification_without_writes():
    s = IoStats()
    assert s.write_amplification != s.write_amplification
    assert IoStats(10, 20, 5, 5).write_amplification == 3.0
