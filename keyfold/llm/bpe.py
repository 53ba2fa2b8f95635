"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that has a merge rank waits
in the bucket of that rank; a two-level bitmap says which buckets have entries, and
find-first-set on it gives the lowest rank. Within a bucket the leftmost position comes
first. An entry whose pair has changed since is stale and skipped. A merge touches two
neighbours, so a pre-token of n bytes takes O(n log n) steps, however long it is.

Encoded pre-tokens of ordinary length are remembered in a bounded table per worker.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from keyfold.llm.common import ready, text_slices, texts

WORD_BITS = 8
CACHE_PIECES = 250_000
CACHE_PIECE_CHARS = 64
#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_WIDE = re.compile("[^\x00-\xff]").search


def read_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a base64 token and its rank on each line. ``path`` may be a URI."""
    if "://" in path:
        system, place = pafs.FileSystem.from_uri(path)
        data = system.open_input_stream(place).readall()
    else:
        with open(path, "rb") as f:
            data = f.read()
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _ranges(major: str, most: int) -> str:
    """The code points up to ``most`` of a general category as the inside of a character class."""
    out, start, last = [], None, None
    for code in range(most + 1):
        if unicodedata.category(chr(code))[0] == major:
            if start is None:
                start = code
            last = code
        elif start is not None:
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.cache
def piece_pattern(pattern: str, most: int) -> re.Pattern[str]:
    """Compiles a pre-token pattern for ``re`` and texts without characters above ``most``.

    Unicode properties become explicit classes; classes of few characters match faster.
    """
    classes = {r"\p{L}": _ranges("L", most), r"\p{N}": _ranges("N", most), r"\s": "".join(x for x in WHITE_SPACE if ord(x) <= most)}
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((x for x in (*classes, r"\S") if pattern.startswith(x, i)), pattern[i])
        if name == r"\S":
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif name in classes:
            out.append(classes[name] if inside else f"[{classes[name]}]")
        else:
            inside = name == "[" or inside and name != "]"
            out.append(name)
        i += len(name)
    return re.compile("".join(out))


class RankQueue:
    """Buckets of list positions by merge rank under a two-level bitmap; empty between pre-tokens.

    ``words[h]`` has a bit for each non-empty bucket of the ranks h * 256 to h * 256 + 255,
    ``top`` a bit for each non-zero word.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        most = max(ranks.values(), default=0) + 1
        self.words = [0] * ((most >> WORD_BITS) + 1)
        self.buckets: list[list[int] | None] = [None] * most
        #: The rank of each pair of bytes, -1 without one: the first pairs need no slices.
        self.byte_pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]

    def merge(self, piece: bytes) -> list[int]:
        """The token ids of one pre-token: merges the lowest rank first, the leftmost pair on ties."""
        get, words, buckets, longest = self.ranks.get, self.words, self.buckets, self.longest
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        byte_pairs = self.byte_pairs
        waiting = [byte_pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        waiting.append(-1)
        top = 0
        for i, rank in enumerate(waiting):
            if rank >= 0:
                if buckets[rank]:
                    buckets[rank].append(i)  # ascending, so already a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                buckets[rank] = None
                word &= word - 1
                words[high] = word
                if not word:
                    top &= top - 1
            else:
                i = heappop(bucket)
            if waiting[i] != rank:
                continue  # stale: the pair has changed since
            j = after[i]
            end = after[j]
            waiting[j] = -1
            after[i] = end
            before[end] = i
            if end < n:
                stop = after[end]
                new = waiting[i] = get(piece[i:stop], -1) if stop - i <= longest else -1
                if new >= 0:
                    if buckets[new]:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
            else:
                waiting[i] = -1
            if i:
                h = before[i]
                new = waiting[h] = get(piece[h:end], -1) if end - h <= longest else -1
                if new >= 0:
                    if buckets[new]:
                        heappush(buckets[new], h)
                    else:
                        buckets[new] = [h]
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : after[i]]))
            i = after[i]
        return out


class Codec:
    """Encodes and decodes with one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.merge = RankQueue(ranks).merge
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.patterns = [piece_pattern(pattern, most).findall for most in (0x7F, 0xFF, sys.maxunicode)]
        self.known: tuple[dict, dict] = ({}, {})
        self.sizes: tuple[dict, dict] = ({}, {})

    def split(self, text: str) -> list[str]:
        """The pre-tokens; the narrower classes for texts in ASCII or Latin-1 only match faster."""
        return self.patterns[0 if text.isascii() else 2 if _WIDE(text) else 1](text)

    def piece(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        return self.merge(piece.encode())

    def encode(self, text: str) -> list[int]:
        joined = self.summary(text)[1]
        return list(map(int, joined.split(b" "))) if joined else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def summary(self, text: str) -> tuple[int, bytes, bytes]:
        """The number of tokens, the decimal ids joined by spaces, and the bytes that the ids decode to."""
        found = self._all(self.split(text), self.known, self._both)
        ids = b"".join([x[0] for x in found])
        return ids.count(b" "), ids[:-1], b"".join([x[1] for x in found])

    def byte_sizes(self, text: str) -> bytes:
        """The number of bytes of each token, as one array of 16-bit numbers."""
        return b"".join(self._all(self.split(text), self.sizes, self._sizes))

    def _both(self, piece: str) -> tuple[bytes, bytes]:
        ids = self.piece(piece)
        return b"".join([b"%d " % i for i in ids]), self.decode(ids)

    def _sizes(self, piece: str) -> bytes:
        return b"".join([len(self.tokens[i]).to_bytes(2, "little") for i in self.piece(piece)])

    @staticmethod
    def _all(pieces: list[str], known: tuple[dict, dict], make) -> list:
        """What ``make`` gives for each pre-token; short ones are remembered, in a younger and an older table."""
        young, old = known
        out = list(map(young.get, pieces))
        if None in out:
            if len(young) >= CACHE_PIECES:
                old.clear()
                old.update(young)
                young.clear()
            for i, x in enumerate(out):
                if x is None:
                    piece = pieces[i]
                    if (x := young.get(piece)) is None:
                        if (x := old.get(piece)) is None:
                            x = make(piece)
                        if len(piece) <= CACHE_PIECE_CHARS:
                            young[piece] = x
                    out[i] = x
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and rank file; its remembered pre-tokens last as long as the worker."""
    return Codec(read_ranks(path), pattern)


def encode_documents(df: DataFrame, id_column: str, text_column: str, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded bytes equal
    the text) and, with ``ids``, the token ids. A null or empty text has no tokens and
    the digests of no bytes; a null id stays null; repeated rows give repeated rows;
    other columns of ``df`` are not read. An unpaired surrogate cannot occur in a text
    column. One pass without a shuffle.
    """
    ready(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                counts, digests, decoded, same, kept = [], [], [], [], []
                for text in texts(batch.column("text")):
                    n, joined, back = own.summary(text)
                    counts.append(n)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
                    if ids:
                        kept.append(list(map(int, joined.split())))
                columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    source = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    return source.mapInArrow(each, schema).withColumnRenamed("id", id_column)


def decode_documents(df: DataFrame, id_column: str, ids_column: str, ranks_path: str, pattern: str) -> DataFrame:
    """Decodes token ids to bytes: id, bytes. Null ids decode to no bytes; an unknown token id is an error."""
    ready(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            back = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(back, pa.binary())], ["id", "bytes"])

    source = df.select(df[id_column].alias("id"), df[ids_column].alias("ids"))
    return source.mapInArrow(each, f"id {kind}, bytes binary").withColumnRenamed("id", id_column)
