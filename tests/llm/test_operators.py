"""Each operator against a brute-force version, and its edge cases."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from keyfold.llm import bpe, ego_join, line_rules, mixing, prefix_lists, quality_cnn, simhash, token_counts, toxicity, warc
from keyfold.llm.common import labelled_sample
from keyfold.llm.components import connected_components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def classes(nodes, linked):
    """The least node reachable from each, by brute force."""
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return label


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


# ---- components


def test_components_of_chains_stars_and_noise(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (7, 6), (6, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    nodes = {x for e in edges for x in e}
    want = classes(nodes, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert dict(map(tuple, connected_components(df).collect())) == {n: want[n] for n in linked}
    assert connected_components(df.where("false")).count() == 0


# ---- 1


def vectors(seed=1):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(14):
        centre = r.normal(size=12)
        for _ in range(r.integers(1, 9)):
            out.append((centre + r.normal(size=12) * r.choice([0.0, 0.12, 0.3])).astype(np.float32).tolist())
    return out


def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCKS", 6)
    monkeypatch.setattr(ego_join, "LEAST_BLOCK", 4)
    monkeypatch.setattr(ego_join, "LEAF", 4)
    data = [(k, v) for k, v in enumerate(vectors())]
    n = len(data)
    data += [(n, None), (n + 1, [0.0] * 12), (n + 2, [math.nan] + [1.0] * 11), (n + 3, [None] + [1.0] * 11), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0])]
    df = spark.createDataFrame([(k, v, "x") for k, v in data], "vec_id long, embedding array<float>, n_links string")
    x = np.array([v for _, v in data[:n]], dtype=np.float64)
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    linked = [(a, b) for a, b in combinations(range(n), 2) if cosine[a, b] >= 0.95] + [(n + 5, n + 6)]
    label = classes(range(len(data)), linked)
    degree = {k: sum(k in e for e in linked) for k in range(len(data))}
    got = {tuple(r) for r in ego_join.near_duplicates(df, "vec_id", "embedding").collect()}
    assert got == {(k, degree[k], label[k], label[k] == k) for k in range(len(data))}
    assert ego_join.near_duplicates(df.where("false"), "vec_id", "embedding").count() == 0


def brute_links(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return linked.sum(axis=1), label
        label = new


@pytest.mark.parametrize("kind", ["float", "double"])
def test_thousands_of_vectors_with_chains_copies_and_pairs_next_to_the_threshold(spark, kind):
    r = np.random.default_rng(5)
    rows = [r.normal(size=32) for _ in range(1200)]
    for _ in range(40):  # chains whose ends do not link, which cross blocks
        x = r.normal(size=32)
        x /= np.linalg.norm(x)
        step = r.normal(size=32)
        step -= step @ x * x
        step /= np.linalg.norm(step)
        rows += [x * math.cos(0.3 * k) + step * math.sin(0.3 * k) for k in range(20)]
    for gap in (1e-4, -1e-4, 1e-6, -1e-6):  # pairs at 0.95 and a little to either side
        for _ in range(50):
            x, y = r.normal(size=(2, 32))
            x /= np.linalg.norm(x)
            y -= y @ x * x
            y /= np.linalg.norm(y)
            c = 0.95 + gap
            rows += [x, c * x + math.sqrt(1 - c * c) * y]
    rows += [rows[k] * s for k in range(0, 300, 3) for s in (1.0, 2.0, 0.5)]
    x = np.array(rows)[r.permutation(len(rows))]
    if kind == "float":
        x = x.astype(np.float32).astype(np.float64)
    degree, label = brute_links(x)
    assert degree.sum() > 2000 and len(x) > 2500
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], f"vec_id long, embedding array<{kind}>")
    got = sorted(tuple(z) for z in ego_join.near_duplicates(df, "vec_id", "embedding").collect())
    assert got == [(k, int(degree[k]), int(label[k]), bool(label[k] == k)) for k in range(len(x))]


def leaf_pairs(x, size=512):
    """Leaf pairs compared, and all, of a sequence in epsilon grid order."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    epsilon = math.sqrt(0.1)
    _, axes = np.linalg.eigh(np.cov(unit.T))
    axes = np.ascontiguousarray(axes[:, ::-1][:, : ego_join.LEADING])
    cells = ego_join._cells(unit, axes, epsilon)
    order = np.lexsort(cells.T[::-1])
    blocks = []
    for a in range(0, len(x), size):
        own = order[a : a + size]
        blocks.append(ego_join.Block({"ids": own.astype("<i8").tobytes(), "copies": np.ones(len(own), "<i8").tobytes(), "data": unit[own].tobytes()}, x.shape[1], "<f8", axes, epsilon, 64))
    done = sum(ego_join.join_blocks(p, q, epsilon, 0.95)[2] for i, p in enumerate(blocks) for q in blocks[i:])
    n = sum(len(b.bounds) - 1 for b in blocks)
    return done, n * (n + 1) // 2


def test_clustered_vectors_are_skipped_in_blocks():
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 64))
    done, every = leaf_pairs(centres[r.integers(0, 60, 4000)] + 0.08 * r.normal(size=(4000, 64)))
    assert done < 0.15 * every
    decaying = r.normal(size=(4000, 64)) * 0.75 ** np.arange(64)
    done, every = leaf_pairs(decaying)
    assert done < 0.5 * every


def test_leaves_are_cut_at_cell_borders():
    cells = np.repeat(np.array([[0, 0], [0, 1], [3, 0]], np.int32), [30, 10, 24], axis=0)
    bounds = ego_join.leaves(cells, 40).tolist()
    assert bounds == [0, 40, 64] and ego_join.leaves(cells[:1], 4).tolist() == [0, 1]


# ---- 2


def brute_fingerprint(text, width):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in own.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_four_positions_hold_a_triple():
    triples = [set(t) for t in simhash.turan_triples()]
    assert len(triples) == 20 and all(any(t <= set(q) for t in triples) for q in combinations(range(8), 4))


@pytest.mark.parametrize("size", [simhash.LIST, 3])
def test_simhash_matches_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", size)
    monkeypatch.setattr(simhash, "SHORT", 4)
    r = random.Random(size)
    texts = [words(r, r.randrange(0, 60)) for _ in range(25)] + [None, "", "É x", "\x1c a"]
    base = words(r, 400)
    for _ in range(40):
        t = base.split()
        t[r.randrange(len(t))] = "changed"
        texts.append(" ".join(t) if r.random() < 0.8 else base.upper())
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, fp int")
    prints = {k: brute_fingerprint(t, 4) for k, t in rows}
    label = classes(prints, [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df, "doc_id", "text", 4, 4).collect()}
    assert got == {k: (prints[k], label[k]) for k in prints}


@pytest.mark.parametrize("size", [simhash.LIST, 20, 3])
def test_links_of_dense_and_sparse_lists_match_brute_force(spark, size):
    r = random.Random(size)
    base = r.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    fps = {base, *(flip(base, r.randrange(1, 4)) for _ in range(60)), *(flip(base, r.randrange(5, 12)) for _ in range(60))}
    tail = base
    for _ in range(12):
        tail = flip(tail, 4)
        fps.add(tail)
    fps |= {base & ~0xFFFFFFFFFF | r.getrandbits(40) for _ in range(40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, k) for k, x in enumerate(fps)], "fp long, node long")
    for bits in (4, 1):
        want = classes(range(len(fps)), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= bits])
        edges = [tuple(x) for x in simhash.links(df, bits, size).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= bits for a, b in edges) or size > 3
        assert classes(range(len(fps)), edges) == want


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(3)
    for text in ("", "  ", "a", "a b c", "a b c d e", words(r, 200), " \n".join(words(r, 50).split()) + " ", "x" * 500 + " y z w v"):
        whole = [h for part in simhash.shingle_hashes(text.encode(), 4) for h in part.tolist()]
        with monkeypatch.context() as m:
            m.setattr(simhash, "PIECE", 7)
            assert [h for part in simhash.shingle_hashes(text.encode(), 4) for h in part.tolist()] == whole
        w = text.split()
        assert whole == [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 4] for i in range(len(w) - 3)] or ([w] if w else []))]


def test_simhash_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "x y z w v u"), (None, "a b c d e"), (2, "x y z w v u")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df, "doc_id", "text", 4, 4).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert simhash.near_duplicates(df.where("false"), "doc_id", "text").count() == 0


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def near_copies(r):
    """Texts of 40 to 250 words with copies that differ in 1 to 6 words, some in many copies."""
    texts = [None, "", " ", "a b", "A  b"]
    for k in range(30):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 250))]
        for _ in range(30 if k == 0 else r.randrange(1, 5)):
            t = list(base)
            for _ in range(r.randrange(0, 7)):
                t[r.randrange(len(t))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(t))
    texts += [f"{x} " + "one line that stands in very many of the texts here again" for x in range(30)]
    return texts


def wide_classes(texts):
    """The components of the whole link relation of wide fingerprints, and that of Jaccard 0.8, by brute force."""
    own = np.array([np.frombuffer(simhash.wide_fingerprint((t or "").encode(), 5), np.uint64) for t in texts])
    limit = simhash.most_bits(0.8)
    linked = [(a, b) for a, b in combinations(range(len(texts)), 2) if np.bitwise_count(own[a] ^ own[b]).sum() <= limit]
    sets = [shingle_set(t) for t in texts]
    similar = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return classes(range(len(texts)), linked), similar


def test_wide_fingerprints_are_majorities_of_distinct_shingles():
    text = "A b c d e f g a b c d e"
    own = sorted({xxhash.xxh64_intdigest(x, 42) for x in (b"a b c d e", b"b c d e f", b"c d e f g", b"d e f g a", b"e f g a b", b"f g a b c", b"g a b c d")})
    mask = 2**64 - 1
    want = b""
    for plane in simhash._PLANE.tolist():
        hashes = []
        for x in own:
            y = x * plane & mask
            y = (y ^ y >> 32) * 0x9E3779B97F4A7C15 & mask
            hashes.append((y ^ y >> 29).to_bytes(8, "little"))
        for byte in range(8):
            want += bytes([sum(1 << bit for bit in range(8) if 2 * sum(h[byte] >> bit & 1 for h in hashes) > len(own))])
    assert simhash.wide_fingerprint(text.encode(), 5) == want
    long = words(random.Random(1), 30_000).encode()
    assert simhash.wide_fingerprint(long, 5) == simhash.wide_fingerprint(long + b" ", 5) != want
    assert simhash.wide_fingerprint(b" \n", 5) == bytes(len(want))


@pytest.mark.parametrize("chunk", [2048, 7])
def test_near_copies_of_0_8_are_found_and_others_are_not(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = near_copies(random.Random(chunk))
    label, similar = wide_classes(texts)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, _h0 string, _wide int")
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    rows = {x["doc_id"] for x in kept.collect()}
    # what is found is part of the whole relation: each of its components keeps at least its least row
    assert set(label.values()) <= rows
    missed = [b for a, b in similar if {a, b} <= rows]
    assert len(missed) <= 0.05 * len(similar) and len(rows) <= 1.05 * len(set(label.values()))
    assert simhash.keep_one(df.where("false"), "doc_id", "text").count() == 0


def test_the_limit_takes_nine_in_ten_pairs_of_0_8_and_none_far_below():
    r = random.Random(2)
    found = {0.8: [], 0.6: []}
    for share in found:
        for _ in range(60):
            n = r.randrange(150, 500)
            both = [str(r.random()) for _ in range(round(2 * n * share / (1 + share)))]
            own = [{*both, *(str(r.random()) for _ in range(n - len(both)))} for _ in range(2)]
            a, b = (np.frombuffer(simhash.wide_fingerprint(" ".join(x).encode(), 1), np.uint64) for x in own)
            found[share].append(np.bitwise_count(a ^ b).sum() <= simhash.most_bits(0.8))
    assert np.mean(found[0.8]) >= 0.8 and np.mean(found[0.6]) == 0


def test_the_pipeline_keeps_a_row_of_each_group_whatever_its_id(spark):
    import corpus_pipeline

    r = random.Random(12)
    t = [words(r, 60) for _ in range(6)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (7, t[2]), (7, t[3]), (7, t[3]), (3, t[4]), (None, t[4]), (9, t[4]), (3, t[5]), (2, t[5]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (3, t[4]), (2, t[5]), (None, None)]
    assert sorted(map(str, map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect()))) == sorted(map(str, want))


def test_repeats_keeps_rows_of_one_id_apart(spark):
    import corpus_pipeline

    r = random.Random(13)
    passage, a, b = words(r, 40), words(r, 30), words(r, 30)
    df = spark.createDataFrame([(1, passage), (2, a + passage), (2, b + passage), (2, b + passage), (None, passage)], "doc_id long, text string")
    got = sorted(map(str, map(tuple, corpus_pipeline.repeats(spark, df, "").collect())))
    assert got == sorted(map(str, [(1, passage), (2, a), (2, b), (2, b), (None, passage)]))


def test_repeats_keeps_replacement_characters_of_the_input(spark):
    import corpus_pipeline

    r = random.Random(14)
    passage, a, b = words(r, 40), words(r, 30), words(r, 30)
    # the passage and the next character share their first bytes: the cut falls inside the character
    df = spark.createDataFrame([(1, passage + "é"), (2, f"{a}\ufffd{passage}è\ufffd{b}")], "doc_id long, text string")
    got = dict(map(tuple, corpus_pipeline.repeats(spark, df, "").collect()))
    assert got == {1: passage + "é", 2: f"{a}\ufffd\ufffd{b}"}


# ---- 3 and 10

TRICKY = ["", "a", "It's the  end\n\n  of\tit's", "é字😀 ß ²Ⅷ ٣", "\x1c\xa0\x85  x", "ab" * 3000, "   \n \n", "don't 'S 123abc", "<|endoftext|>", "z" * 20000]


def test_encoding_equals_the_library_and_decodes(spark, encoding):
    r = random.Random(9)
    alphabet = "aab \n\t'sé²Ⅷ字\x1c\xa0٣😀ß.-_A1"
    texts = TRICKY + ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    got = {x["doc_id"]: x for x in bpe.encode_documents(df, "doc_id", "text", RANKS, PATTERN, ids=True).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate([*texts, ""]):
        assert got[k]["ids"] == encoding.encode_ordinary(t) and got[k]["n_tokens"] == len(got[k]["ids"]) and got[k]["round_trip"]
    back = bpe.decode_documents(spark.createDataFrame([(k, got[k]["ids"]) for k in range(8)], "doc_id long, ids array<int>"), "doc_id", "ids", RANKS, PATTERN)
    assert {x["doc_id"]: bytes(x["bytes"]) for x in back.collect()} == {k: texts[k].encode() for k in range(8)}


def test_the_queue_merges_ties_from_the_left():
    merge = bpe.RankQueue({b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}).merge
    assert merge(b"aaa") == [2, 0] and merge(b"aaaab") == [2, 3] and merge(b"ba") == [1, 0]


def test_tokens_of_lines_and_sections(spark, encoding):
    texts = [*TRICKY, "one\ntwo\n\nthree", "é\né字\n😀😀\nend"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(99, None, 0)], "doc_id long, text string, section int")
    got = {}
    for x in token_counts.count_tokens(df, "doc_id", "text", RANKS, PATTERN).collect():
        got.setdefault(x["doc_id"], {})[x["section"]] = x
    assert got[99][0]["n_tokens"] == 0
    for k, t in enumerate(texts):
        ids = encoding.encode_ordinary(t)
        assert sum(x["n_tokens"] for x in got[k].values()) == len(ids)
        lines = t.splitlines(keepends=True) if not set(t) & set("\x1c\x85\r\x0b\x0c") else None
        if lines is not None:
            assert [t[x["start"] : x["end"]] for _, x in sorted(got[k].items())] == (lines or [""])
        want, at, data = dict.fromkeys(got[k], 0), 0, t.encode()
        for i in ids:
            size = len(encoding.decode_single_token_bytes(i))
            first = len(data[:at].decode(errors="ignore"))
            last = len((data[: at + size] + b"").decode(errors="replace").rstrip("�")) if size else first
            last = max(last, first + 1)
            share = {n: min(last, x["end"]) - max(first, x["start"]) for n, x in got[k].items()}
            want[max(sorted(share), key=lambda n: share[n])] += 1
            at += size
        if t.isascii():
            assert want == {n: x["n_tokens"] for n, x in got[k].items()}
    own = spark.createDataFrame([(1, "hello world", [(0, 2), (6, 11)])], "doc_id long, text string, spans array<struct<start:bigint,end:bigint>>")
    assert sorted((x["section"], x["n_tokens"]) for x in token_counts.count_tokens(own, "doc_id", "text", RANKS, PATTERN, "spans").collect()) == [(0, 1), (1, 1)]
    gaps = spark.createDataFrame([(1, "hello world", [(0, 5), None, (None, 3), (5, 11)]), (None, "a b", None), (1, "hello world", [(0, 11)])], "doc_id long, text string, spans array<struct<start:bigint,end:bigint>>")
    found = sorted(((x["doc_id"] or 0, x["section"], x["start"], x["n_tokens"]) for x in token_counts.count_tokens(gaps, "doc_id", "text", RANKS, PATTERN, "spans").collect()), key=str)
    assert found == [(0, -1, None, 2), (1, 0, 0, 1), (1, 0, 0, 2), (1, 1, None, 0), (1, 2, None, 0), (1, 3, 5, 1)]
    assert token_counts.count_tokens(gaps.where("false"), "doc_id", "text", RANKS, PATTERN, "spans").count() == 0
    for wrong in ([(4, 8), (0, 2)], [(0, 5), (4, 8)], [(3, 1)], [(-2, 1)]):
        with pytest.raises(ValueError, match="ascend"):
            token_counts.section_spans([{"start": a, "end": b} for a, b in wrong])
    with pytest.raises(ValueError, match="rule"):
        token_counts.count_tokens(own, "doc_id", "text", RANKS, PATTERN, rule="best")


@pytest.mark.parametrize(("rule", "want"), [("start", [2, 0]), ("end", [1, 1]), ("majority", [1, 1])])
def test_the_rule_decides_crossing_tokens(rule, want):
    counts, crossing, outside = token_counts.allocate(np.array([0, 2]), np.array([2, 6]), np.array([0, 3]), np.array([3, 9]), rule)
    assert counts.tolist() == want and outside == 0 and crossing.sum() == 1


# ---- 4 and 7


def test_toxicity_finds_the_sentence(spark):
    r = random.Random(4)
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        s = [words(r, 6) + "." for _ in range(6)]
        if toxic:
            s[r.randrange(6)] = f"{words(r, 2)} rotten {words(r, 2)}."
        rows.append((k, " ".join(s).replace("0", "x"), int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000, None), (1001, ""), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, "doc_id", "text", labels.withColumnRenamed("toxic", "label"), "label", lambda i: i % 3 != 0)
    got = toxicity.score(docs, "doc_id", "text", model).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == 403 and by[1000]["score"] == by[1001]["score"] == 0
    held = [(by[k], t, y) for k, t, y in rows if k % 3 == 0]
    assert all((x["score"] >= 0.3) == bool(y) for x, _, y in held)
    for x, t, y in held:
        if y:
            assert any("rotten" in t[o["start"] : o["end"]] for o in x["offending"])
    assert abs(toxicity.noisy_or([0.0, 0.0]) - 0.75) < 1e-12


def test_quality_network_learns_and_reads_whole_texts(spark):
    r = random.Random(5)
    junk = lambda n: " ".join(w + "***" for w in words(r, n).split())
    rows = [(k, words(r, r.randrange(5, 200)) if k % 3 else junk(r.randrange(5, 120)), int(k % 3 > 0)) for k in range(360)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = quality_cnn.fit(docs, "doc_id", "text", labels, "quality", lambda i: i % 5 != 0)
    got = dict(map(tuple, quality_cnn.score(docs, "doc_id", "text", model).collect()))
    assert len(got) == 362 and all(0 <= s <= 1 for s in got.values())
    held = [(k, y) for k, _, y in rows if k % 5 == 0]
    assert sum((got[k] >= 0.3) == bool(y) for k, y in held) >= 0.95 * len(held)
    kept = quality_cnn.keep_good(docs, "doc_id", "text", model, 0.3)
    assert {x["doc_id"] for x in kept.collect()} == {k for k, s in got.items() if s >= 0.3} and kept.columns == docs.columns
    clean = words(r, 400).encode()
    late = clean + b" " + junk(300).encode()
    assert quality_cnn.predict(model, [late])[0] < quality_cnn.predict(model, [clean])[0]
    one, many = quality_cnn.predict(model, [late]), quality_cnn.predict(model, [b"", clean, late, b"x"])
    assert abs(one[0] - many[2]) < 1e-6


def test_a_score_does_not_depend_on_the_texts_around():
    r = np.random.default_rng(0)
    model = quality_cnn.QualityModel(r.normal(size=(5, 256, 10)).astype(np.float32), r.normal(size=10).astype(np.float32), r.normal(size=10).astype(np.float32), 0.0)
    for text in (b"", b"x", b"house", b"The house", b"z" * 256, b"ab " * 200):
        alone = quality_cnn.predict(model, [text])[0]
        for others in ([b"###$%^"], [b"The house"], [b""], [b"z" * 70_000, b"a"]):
            assert quality_cnn.predict(model, [text, *others])[0] == quality_cnn.predict(model, [*others, text])[-1] == alone


def test_the_noisy_or_likelihood_and_its_gradient():
    r = np.random.default_rng(4)
    document_of = np.sort(r.integers(0, 6, 15))
    sentence_of = np.sort(r.integers(0, 15, 40))
    ids, y, weight, w = r.integers(0, 8, 40), np.array([1, 0, 1, 0, 0, 1]), r.random(6), r.normal(size=9)

    def naive(w):
        out = 0.0
        for d in range(6):
            clean = 1.0
            for s in np.flatnonzero(document_of == d):
                clean *= 1 - 1 / (1 + math.exp(-(w[-1] + sum(w[ids[t]] for t in np.flatnonzero(sentence_of == s)))))
            out -= weight[d] * math.log(1 - clean if y[d] else clean) if (document_of == d).any() else 0
        return out

    some = np.isin(np.arange(6), document_of)
    loss, grad = toxicity.likelihood(w, ids, sentence_of, document_of, y, weight * some)
    assert abs(loss - naive(w)) < 1e-9
    for k in range(9):
        step = np.eye(9)[k] * 1e-5
        assert abs((naive(w + step) - naive(w - step)) / 2e-5 - grad[k]) < 1e-6


def test_scores_equal_a_naive_noisy_or(spark):
    model = toxicity.ToxicityModel({"bad": 3.0, "ba*": 0.5, "good": -1.0, "badly": 0.25}, -2.0, (2,))
    texts = ["Bad bad good. Fine!\nbadly done", "", "...", None, "x " * 200_000 + "bad", "good"]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(None, "bad", 0.0), (5, "good", 0.0)], "doc_id long, text string, score double")
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    first = 1 - (1 - sigmoid(-2 + 3.5 - 1)) * (1 - sigmoid(-2)) * (1 - sigmoid(-2 + 0.75))
    want = {0: first, 1: 0, 2: 0, 3: 0, 4: sigmoid(1.5), 5: sigmoid(-3), None: sigmoid(1.5)}
    got = toxicity.score(df, "doc_id", "text", model).collect()
    assert len(got) == 8 and all(abs(x["score"] - want[x["doc_id"]]) < 1e-12 for x in got)
    assert toxicity.score(df.where("false"), "doc_id", "text", model).count() == 0


def test_training_chooses_beginnings_only_where_they_help():
    r = random.Random(9)
    fill = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    inflected = [(f"{fill(5)} rotten{fill(1)[:3]} {fill(4)}." if k % 3 == 0 else f"{fill(10)}.", int(k % 3 == 0)) for k in range(400)]
    model = toxicity.train([(t.encode(), y, 1.0) for t, y in inflected])
    assert model.prefixes and toxicity.noisy_or([z for *_, z in model.sentences("a rottenest b")]) > 0.5
    assert toxicity.train([]).weights == {} and toxicity.train([(b"a", 1, 1.0)]).weights == {}


def test_scores_equal_a_naive_convolution(spark):
    r = np.random.default_rng(1)
    model = quality_cnn.QualityModel(r.normal(size=(5, 256, 10)).astype(np.float32), r.normal(size=10).astype(np.float32), r.normal(size=10).astype(np.float32), 0.3)
    texts = [None, "", "a", "abé", "x" * 256, "y" * 257, "word " * 300, "".join(chr(97 + k * k % 26) for k in range(1500))]

    def naive(text):
        data = (text or "\0").encode()
        padded = data + bytes(5)
        responses = np.array([sum(model.filters[k, padded[p + k]] for k in range(5)) for p in range(len(data))])
        cells = [responses[a : a + 256].max(axis=0) for a in range(0, len(data), 256)]
        chunks = np.array([np.maximum(x, y) for x, y in zip(cells, [*cells[1:], cells[-1]], strict=True)])
        return 1 / (1 + math.exp(-float(chunks.max(axis=0) @ model.top + chunks.mean(axis=0) @ model.mean + 0.3)))

    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "a", "s"), (2, "a", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    want = sorted((k if k is not None else -1, naive(t)) for k, t, _ in rows)
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["score"]) for x in quality_cnn.score(df, "doc_id", "text", model).collect())
    assert [x for x, _ in got] == [x for x, _ in want] and all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(got, want, strict=True))
    kept = quality_cnn.keep_good(df, "doc_id", "text", model, 0.3)
    assert kept.columns == df.columns and kept.count() == sum(s >= 0.3 for _, s in got)
    assert quality_cnn.score(df.where("false"), "doc_id", "text", model).count() == 0


def test_the_sample_takes_one_row_of_an_id_and_keeps_to_its_bytes(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (1, "b" * 50), (1, "a" * 50), *((k, "t" * 100) for k in range(2, 60))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1)], "doc_id long, y int")
    rows = labelled_sample(docs, "doc_id", "text", labels, "y", lambda i: i >= 0, 1000)
    assert len(rows) == 59 and sum(len(t) == 50 for t, *_ in rows) == 1
    assert sum(len(t) for t, *_ in labelled_sample(docs, "doc_id", "text", labels, "y", lambda i: i >= 0, 1000, most_bytes=1_050)) in range(950, 1051)
    assert labelled_sample(docs.where("false"), "doc_id", "text", labels, "y", lambda i: i >= 0, 9) == []


def test_the_sample_is_bounded_and_keeps_to_its_fold(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(2000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    rows = labelled_sample(docs, "doc_id", "text", labels, "y", lambda i: F.crc32(i.cast("string").cast("binary")) % 4 != 2, 100)
    assert 120 < len(rows) < 280
    assert all(zlib.crc32(t[1:]) % 4 != 2 and int(t[1:]) % 2 == y for t, y, _ in rows)


# ---- 6


def test_archives_round_trip(spark):
    page = "<p>" + "é" * 80
    rows = [(5, "http://a/", page), (3, "http://b/\n x", page), (9, None, page), (3, "http://c/", page), (None, "http://d/", page), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x\r\n\r\ny" * 50_000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archive(df, "page_id", "url", "html")
    got = warc.read_records(index).collect()
    assert len(got) == len(rows) and all(x["intact"] for x in got)
    kinds = sorted((x["page_id"] or 0, x["record_type"], x["refers_to"]) for x in got)
    assert kinds == sorted([(0, "response", None), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "response", None), (9, "revisit", 3)])
    assert {bytes(x["payload"]) for x in got if x["page_id"] == 7} == {rows[-1][2].encode()}
    assert {x["payload_bytes"] for x in got if x["page_id"] in (3, 5, 9)} == {163}
    some = index.where("page_id in (1, 7)")
    assert {x["page_id"] for x in warc.read_records(some, payload=False).collect()} == {1, 7}
    assert warc.read_records(warc.write_archive(df.where("false"), "page_id", "url", "html")).count() == 0
    assert warc.dangling(index).count() == 0 and warc.dangling(index.where("page_id = 5 or page_id = 1")).count() == 1


def test_many_revisits_of_one_payload_and_an_index_kept_beside_the_archives(spark, tmp_path):
    page = "<p>" + "x" * 200
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, page).otherwise(F.concat(F.lit(page), "id")).alias("html"))
    warc.write_archive(df, "page_id", "url", "html", f"file://{tmp_path}/a")
    index = warc.read_index(spark, f"file://{tmp_path}/a")
    got = warc.read_records(index, payload=False).collect()
    assert len(got) == 2000 and {(x["record_type"], x["refers_to"]) for x in got if x["page_id"] % 3 and x["page_id"] != 1} == {("revisit", 1)}
    assert all(x["record_type"] == "response" for x in got if x["page_id"] % 3 == 0 or x["page_id"] == 1) and warc.dangling(index).count() == 0


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP_BYTES, 5), ("a", 10**9, 5), ("b", 0, 5)]
    assert [x[1:] for x in warc._ranges(rows)] == [(0, 20 + warc.GAP_BYTES, 0, 3), (10**9, 10**9 + 5, 3, 4), (0, 5, 4, 5)]
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(warc.encode_record(1, "u", b"abc", "00", None, False)[:-1])


# ---- 8


def test_mixing_meets_its_targets(spark):
    r = random.Random(8)
    vocabulary = {"en": ["the", "and", "of", "house"], "fr": ["le", "et", "de", "maison"], "de": ["der", "und", "von", "haus"]}
    rows = [(k, " ".join(r.choice(vocabulary[d]) for _ in range(r.randrange(3, 60))), d) for k in range(300) for d in [r.choice(["en"] * 6 + ["fr", "fr", "de"])]]
    rows += [(1000, None, "en"), (1001, "", None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, rate string")
    labelled = df.where("doc_id < 150").select("text", F.col("lang").alias("domain"))
    weights = {"en": 0.4, "fr": 0.3, "de": 0.3}
    for least in (0.0, 1.0):
        out = mixing.mix(df, "doc_id", "text", labelled, "domain", weights, least_rate=least)
        got = out.collect()
        assert len(got) == len(rows) and all(x["rate"] >= least for x in got)
        total = {d: sum(x["rate"] * x["n_words"] * x[f"p_{d}"] for x in got) for d in weights}
        assert all(abs(total[d] / sum(total.values()) - w) < 1e-3 for d, w in weights.items())
        lang = {k: d for k, _, d in rows}
        assert sum(x["domain"] == lang[x["doc_id"]] for x in got if x["n_words"]) >= 0.95 * len(got)
    again = mixing.apply_rates(df, "doc_id", "text", out)
    assert again.columns == df.columns and {x["doc_id"] for x in again.collect()} == {x[0] for x in rows}
    assert mixing.mix(df.where("false"), "doc_id", "text", labelled, "domain", weights).count() == 0


def test_rates_are_the_least_squares_optimum(spark):
    """The conditions of an optimum, where targets can be met and where they cannot."""
    r = np.random.default_rng(6)
    rows = [(int(r.integers(1, 3)), int(r.integers(0, 50)), *map(float, p)) for p in r.dirichlet([0.2, 0.2, 0.2], 200)]
    df = spark.createDataFrame(rows, "copies long, n_words long, p0 double, p1 double, p2 double")
    weight = np.array([a * b for a, b, *_ in rows], float)
    p = np.array([x[2:] for x in rows])
    for targets, least in (([900.0, 1500.0, 600.0], 0.0), ([0.0, 4000.0, 100.0], 0.0), ([900.0, 1500.0, 600.0], 1.0), ([1e5, 1e5, 1e5], 1.0)):
        table, off = mixing.fit_rates(df, targets, least)
        got = {(x["copies"], x["n_words"], x["p0"], x["p1"], x["p2"]): x["rate"] for x in table.collect()}
        rate = np.array([got[x] for x in rows])
        assert np.abs(np.array(targets) - (weight * rate) @ p - off).max() < 1e-6 * max(targets)
        gradient = -p @ np.array(off)
        free = rate > least + 1e-9
        near = (5e-3 if max(np.abs(off)) > 1e-5 * max(targets) else 1e-5) * max(targets)
        assert (rate >= least).all() and (gradient >= -near).all() and (np.abs(gradient[free]) <= near).all()


def test_a_fit_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 0)
    df = spark.createDataFrame([(1, 5, 0.9, 0.1)], "copies long, n_words long, p0 double, p1 double")
    with pytest.raises(mixing.NotConverged):
        mixing.fit_rates(df, [1.0, 2.0], 0.0)


def test_posteriors_equal_naive_bayes(spark):
    texts = [(1, "the cat. The 12 ###", "a"), (2, "le chat\tnoir", "b"), (3, "the the le", "a"), (4, None, "b"), (5, "", None), (None, "42 42", "a"), (6, "the " * 30_000, "b"), (6, "the " * 30_000, "b")]
    df = spark.createDataFrame([(*x, 0.5) for x in texts], "doc_id long, text string, domain string, p0 double")
    labelled = df.where("doc_id <= 4").select("text", "domain")
    bucket = lambda w: spark.range(1).select(mixing._bucket(F.lit(w))).first()[0]
    counts = {"a": {}, "b": {}}
    for k, t, d, in texts[:4]:
        for w in (t or "").lower().split():
            counts[d][bucket(w)] = counts[d].get(bucket(w), 0) + 1
    model, unseen, priors = mixing.word_model(labelled, "text", "domain", ["a", "b"])
    for x in mixing.posteriors(df, "doc_id", "text", model, unseen, priors).collect():
        text = next(t for k, t, _ in texts if k == x["id"]) or ""
        own = text.lower().split()
        logit = [priors[j] + sum(math.log((counts[d].get(bucket(w), 0) + 0.5) / (sum(counts[d].values()) + 0.5 * mixing.BUCKETS)) for w in {w: 0 for w in own} for _ in range(own.count(w))) if len(own) < 100 else 0.0 for j, d in enumerate("ab")]
        assert x["n_words"] == len(own) and x["copies"] == (2 if x["id"] == 6 else 1)
        if len(own) < 100:
            assert abs(x["p0"] - 1 / (1 + math.exp(logit[1] - logit[0]))) < 1e-9
    empty, unseen, priors = mixing.word_model(labelled.where("false"), "text", "domain", ["a", "b"])
    assert {round(x["p0"], 9) for x in mixing.posteriors(df, "doc_id", "text", empty, unseen, priors).collect()} == {0.5}


# ---- 9


def test_line_rules(spark):
    clean = "one two three four five six seven eight nine ten eleven"
    rows = [(1, clean), (2, None), (3, ""), (4, "Home | About | Contact | Help\n" * 3 + clean), (5, "Home | About | Contact | Help | More | Terms of use | Imprint | Login\n" * 2 + clean), (6, (clean + "\n") * 2), (7, "a " * 50_000), (8, "x\x0by\x0cz\tw\r\nv " + clean), (9, clean + "\n" + " ".join(w + "***" for w in clean.split()) * 2)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_words int")
    got = {x["doc_id"]: x for x in line_rules.apply_rules(df, "doc_id", "text", clean_text=True).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"] and got[1]["n_words"] == 11 and got[1]["word_chars"] == len(clean.replace(" ", ""))
    assert all(got[k]["base_failed"] and not got[k]["kept"] and got[k]["n_words"] == 0 for k in (2, 3))
    assert got[5]["n_lines_removed"] == 2 and not got[5]["kept"] and got[5]["clean_text"] == clean
    assert got[6]["n_dup_lines"] == 1 and got[6]["n_repeat_words"] == 22 and got[6]["base_failed"]
    assert got[7]["n_repeat_words"] == got[7]["n_words"] == 50_000
    assert got[8]["n_words"] == 16 and got[8]["kept"]
    assert got[9]["n_symbols"] == 66 and got[9]["n_lines_removed"] == 1 and not got[9]["kept"]
    assert line_rules.apply_rules(df.where("false"), "doc_id", "text").count() == 0


# ---- the pipeline


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    passage = words(r, 40)
    docs = [(k, words(r, 60), "en") for k in range(60)] + [(60 + k, " ".join(w + "***" for w in words(r, 60).split()), "en") for k in range(30)]
    docs += [(100, docs[3][1], "fr"), (101, docs[4][1].upper(), "fr"), (102, words(r, 30) + " " + passage, "de"), (103, passage + " " + words(r, 30), "es"), (104, None, "en"), (105, "", None)]
    spark.createDataFrame([(k, t, d, "src0", len(t or "")) for k, t, d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(now)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(x.columns == columns for x in kept[:4])
    ids = [{x["doc_id"] for x in k.collect()} for k in kept]
    assert set(range(60)) <= ids[0] and not ids[0] & set(range(60, 90))
    assert set(range(60)) <= ids[1] and not ids[1] & {100, 101}
    cut = {x["doc_id"]: x for x in kept[2].collect()}
    assert passage in cut[102]["text"] and passage not in cut[103]["text"] and cut[103]["n_chars"] == len(cut[103]["text"])
    assert ids[1] == ids[2] == ids[3] == ids[4]
    assert all(x["round_trip"] for x in now.collect())
    assert [x[0] for x in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mix", "encode"]


@pytest.mark.parametrize("size", [1_024, 5])
def test_shingle_sets_across_components_match_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(prefix_lists, "LIST", size)
    r = np.random.default_rng(size)
    line = r.integers(0, 1 << 63, 30, np.uint64) * np.uint64(2)
    sets = []
    for k in range(60):
        base = np.concatenate([line if k % 3 == 0 else line[:0], r.integers(0, 1 << 63, r.integers(1, 90), np.uint64) * np.uint64(2)])
        for _ in range(r.integers(1, 6)):
            own = base[r.random(len(base)) < 1 - 0.15 * r.random()]
            sets.append(np.unique(np.concatenate([own, r.integers(0, 1 << 63, r.integers(0, 1 + len(base) // 10), np.uint64)])))
    # one text in many copies that are one component, and some near it that are not
    sets += [np.unique(np.append(line, k + 1).astype(np.uint64)) for k in range(20)]
    sets += [np.unique(np.concatenate([line[:k], [k]]).astype(np.uint64)) for k in range(20, 31)] + [np.zeros(0, np.uint64)] * 2
    n, many = len(sets), len(sets) - 33
    component = [many if many <= k < many + 18 else k for k in range(n)]
    near = [(a, b) for a, b in combinations(range(n), 2) if len(sets[a]) and len(sets[b]) and 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))]
    want = {tuple(sorted((component[a], component[b]))) for a, b in near if component[a] != component[b]}
    rows = [(bytes([k // 256, k % 256]), xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63), bytearray(x.tobytes())) for k, x in enumerate(sets)]
    table = spark.createDataFrame([*rows, *rows[:9]], "w binary, own long, hashes binary")
    names = spark.createDataFrame([(bytes([k // 256, k % 256]), c) for k, c in enumerate(component)], "w binary, component long")
    got = {tuple(sorted(x)) for x in prefix_lists.links_across(table, names, "w", 0.8).collect()}
    assert len(want) > 50 and got == want
    assert prefix_lists.links_across(table.where("false"), names, "w", 0.8).count() == 0


def test_pairs_that_meet_in_many_lists_make_no_rows(spark, monkeypatch):
    r = np.random.default_rng(8)
    draw = lambda n: r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
    base = draw(240)
    # one group in which all share many shingles and few are similar enough, two equal sets and two of very different counts of bits
    sets = [np.unique(np.concatenate([base[r.random(240) < 0.8], draw(40)])) for _ in range(50)]
    sets += [np.unique(np.concatenate([x[r.random(len(x)) < 0.96], draw(k)])) for k, x in enumerate(sets[:8])] + [sets[9]]
    sets += [x := np.unique(draw(64)), np.unique(np.concatenate([x, draw(10)]))]
    rows = [(bytes([k]), xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63), bytearray(x.tobytes()), k) for k, x in enumerate(sets)]
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))}
    made, stored = {}, prefix_lists.stored

    def counted(df, tag, *more, **named):
        out = stored(df, tag, *more, **named)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(prefix_lists, "stored", counted)
    df = spark.createDataFrame(rows, "w binary, own long, hashes binary, component long")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "37")  # lists and sets go on over batches
    try:
        got = {tuple(sorted(x)) for x in prefix_lists.links_across(df.select("w", "own", "hashes"), df.select("w", "component"), "w", 0.8).collect()}
    finally:
        spark.conf.set(limit, before)
    assert len(want) >= 10 and got == want
    assert max(made.values()) <= sum(prefix_lists.indexed(len(x), 0.8) for x in sets)
    assert made["simhash-met"] <= 4 * len(want)


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(9)
    draw = lambda n: r.integers(0, 1 << 63, n, np.uint64)
    sets = []
    for n in (1, 2, 60, 64, 65, 300, 1_000, 5_000, 40_000):
        base = np.unique(draw(n))
        sets += [base, *(np.unique(np.concatenate([base[r.random(len(base)) < keep], draw(n // 20)])) for keep in (0.99, 0.9, 0.5))]
    bits = [prefix_lists.parities(x) for x in sets]
    assert max(len(x) * 64 for x in bits) == prefix_lists.MOST_BITS and min(map(len, bits)) == 1
    width = np.array(list(map(len, bits)))
    a, b = np.array(list(combinations(range(len(sets)), 2))).T
    got = prefix_lists._differing(np.concatenate(bits), np.cumsum(width) - width, width, a, b)
    differ = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    assert (got <= differ).all()
    # sets that share half of their shingles are told from similar ones
    apart = np.array([x % 4 == 0 and y == x + 3 and len(sets[x]) >= 300 and len(sets[x]) < 20_000 for x, y in zip(a, b, strict=True)])
    n, m = (np.array([len(sets[x]) for x in k]) for k in (a, b))
    assert apart.sum() == 3 and (got > n + m - 2 * prefix_lists._needed(n, m, 0.8))[apart].all()


@pytest.mark.parametrize("size", [1_024, 4])
def test_no_pair_of_0_8_stays_whole(spark, size, monkeypatch):
    monkeypatch.setattr(prefix_lists, "LIST", size)
    r = random.Random(size)
    texts = []
    for _ in range(150):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30, 300))]
        texts.append(" ".join(base))
        n = len(base) - 4
        most = (n - 8 * (2 * n) // 18 - 1) if n > 20 else 0  # shingles that both may lose
        for _ in range(2):
            t, lost = list(base), 0
            while lost + 5 <= most:
                t[5 + lost] = f"n{r.randrange(10**6)}"
                lost += 5
            texts.append(" ".join(t))
    _, similar = wide_classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x["doc_id"] for x in simhash.keep_one(df, "doc_id", "text").collect()}
    assert len(similar) >= 200 and not [x for x in similar if set(x) <= rows]
    assert {k for k in range(0, len(texts), 3)} <= rows
