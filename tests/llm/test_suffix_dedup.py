import hashlib
import random

import numpy as np
import pytest

from keyfold.llm import suffix_dedup
from keyfold.llm.suffix_dedup import LENGTH, remove_repeats


def brute(rows):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - LENGTH + 1):
            w = data[p : p + LENGTH]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - LENGTH + 1):
            if first[data[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(seed, n=60):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcé") for _ in range(r.randrange(30, 220))) for _ in range(6)] + ["a" * 130]
    out = []
    for i in range(n):
        text = "".join(r.choice(passages)[r.randrange(0, 40) :] if r.random() < 0.6 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 120))) for _ in range(r.randrange(0, 5)))
        if out and r.random() < 0.25:
            text = r.choice(out)[1] or ""
            if text and r.random() < 0.7:
                k = r.randrange(len(text))
                text = text[:k] + "Z" + text[k + 1 :]
        out.append((i * 3 % 181, text if i % 17 else None))
    return out


def digests(df):
    return sorted(tuple(x) for x in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_over_many_batches(spark, monkeypatch, seed):
    monkeypatch.setattr("keyfold.llm.suffix_dedup.BATCH_BYTES", 1500)
    monkeypatch.setattr("keyfold.llm.suffix_dedup.LEAST_BUCKETS", 5)
    data = rows(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in data], "doc_id long, text string, kept string, batch string")
    assert digests(remove_repeats(df, "doc_id", "text")) == brute(data)


def test_null_id_repeated_rows_long_text_and_empty_table(spark):
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400_000))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (3, None), (4, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in remove_repeats(df, "doc_id", "text").collect()}
    assert got == {(1, 400_000, 0), (None, 400_000, 0), (2, 400_000, 400_000), (3, 0, 0), (4, 0, 0)}
    assert remove_repeats(df, "doc_id", "text").count() == 6
    assert remove_repeats(df.where("false"), "doc_id", "text").count() == 0


def test_anchors_do_not_depend_on_segments(monkeypatch):
    r = random.Random(5)
    texts = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (0, 49, 50, 51, 400, 3, 1200, 70)] + [b"a" * 300]
    sizes, ids = np.array([len(t) for t in texts]), np.arange(len(texts))
    whole = suffix_dedup.Batch(b"".join(texts), sizes, ids)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 37)
    parts = suffix_dedup.Batch(b"".join(texts), sizes, ids)
    for name in ("anchor", "low", "high", "gram", "stretch", "document"):
        assert (getattr(whole, name) == getattr(parts, name)).all()
    assert (whole.high - whole.low + 1).sum() == sum(max(0, len(t) - 49) for t in texts)


def test_a_gram_in_many_surroundings_is_held_once():
    r = np.random.default_rng(3)
    gram = np.array([7], np.uint64)
    batches = [(b, gram, r.integers(1, 40, 1).astype(np.uint64), np.array([b], np.uint32)) for b in range(200)]
    replies = suffix_dedup._scan_bucket(iter(batches), False)
    seen, want_hit, want_open = set(), set(), set()
    for b, _, second, _ in batches:
        if int(second[0]) in seen:
            want_hit.add(b)
        elif seen:
            want_open |= {b, 0}
        seen.add(int(second[0]))
    assert {b for b, x in replies.items() if x[0]} == want_hit and {b for b, x in replies.items() if x[1]} == want_open
    assert sum(len(x) for x in replies[0][1]) == 1


def test_equal_keys_with_other_second_keys_do_not_match():
    levels = suffix_dedup.Levels()
    key = np.array([5, 5, 5, 9], np.uint64)
    levels.add([key, np.array([3, 1, 2, 1], np.uint64)])
    levels.add([np.array([5], np.uint64), np.array([8], np.uint64)])
    assert levels.has(np.array([5, 5, 5, 9, 4], np.uint64), np.array([2, 8, 7, 1, 1], np.uint64)).tolist() == [True, True, False, True, False]
