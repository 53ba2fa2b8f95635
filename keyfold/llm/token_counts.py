"""Token counts by section: whole texts are encoded once, token spans are joined to sections.

A text is encoded as a whole, so that pre-tokens and merges that cross section borders
come out as a model sees them. Each token has the character span [first character it
touches, last one + 1). Sections are ascending, disjoint character spans; the join of
the two sorted span lists is one binary search for all tokens of a text. A token that
touches several sections goes to one of them by ``rule``:

* ``majority``: the section that holds most of its characters, the earlier one on a tie;
* ``start``: the section that holds its first character;
* ``end``: the section that holds its last character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.llm.bpe import codec
from keyfold.llm.common import ready, text_slices, texts

RULES = ("majority", "start", "end")


def token_spans(own, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token."""
    sizes = np.frombuffer(own.byte_sizes(text), "<u2").astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not text.isascii():
        chars = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        starts, ends = chars[starts] - 1, chars[ends - 1]
    return starts, ends


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, each with the line feed that ends it; together they cover the text."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if text.count("\n") > len(text) // 16 else _found(text)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    ends = np.array(ends, np.int64)
    return np.concatenate(([0], ends[:-1])), ends


def _found(text: str) -> list[int]:
    out, i = [], text.find("\n")
    while i >= 0:
        out.append(i + 1)
        i = text.find("\n", i + 1)
    return out


def section_spans(spans: list[dict | None] | None) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last characters of given sections, -1 for null ones; raises ValueError if they overlap or descend."""
    whole = [(x["start"], x["end"]) if x is not None and None not in (x["start"], x["end"]) else None for x in spans or []]
    at = 0
    for x in whole:
        if x is not None:
            if not at <= x[0] <= x[1]:
                raise ValueError(f"sections must ascend and not overlap: {x} after {at}")
            at = x[1]
    return tuple(np.array([-1 if x is None else x[k] for x in whole], np.int64) for k in (0, 1))


def allocate(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and border-crossing tokens of each section, and the tokens that touch no section."""
    n = len(first)
    low = np.searchsorted(last, starts, "right")
    high = np.searchsorted(first, ends, "left") - 1
    outside = high < low
    crossing = np.flatnonzero(high > low)
    chosen = np.where(outside, n, high if rule == "end" else low)
    if rule == "majority":
        for t in crossing.tolist():
            best, most = low[t], -1
            for k in range(low[t], high[t] + 1):
                share = min(ends[t], last[k]) - max(starts[t], first[k])
                if share > most:
                    best, most = k, share
            chosen[t] = best
    counts = np.bincount(chosen, minlength=n + 1)
    return counts[:n], np.bincount(chosen[crossing], minlength=n + 1)[:n], int(counts[n])


def count_tokens(df: DataFrame, id_column: str, text_column: str, ranks_path: str, pattern: str, sections: str | None = None, rule: str = "majority") -> DataFrame:
    """Counts the tokens of each section of each whole text. A span list that is not ascending and disjoint is an error.

    ``sections`` names a column of array<struct<start, end>> with ascending disjoint
    character spans; without it the sections are the lines. Returns a row per section:
    id, section (0 on), start, end, n_tokens, n_crossing (tokens given to it that also
    touch another section). Tokens that touch no section form a row with section -1 and
    null span, if there are any. A null or empty text has one empty line with no tokens;
    a null section list counts as empty; a null entry of it, or one with a null border,
    keeps its number, has a null span and gets no tokens. A null id stays null; repeated
    rows give repeated rows; an empty table gives no rows; other columns are not read.
    One pass without a shuffle; a text is never cut.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ready(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                given = batch.column("spans").to_pylist() if sections else None
                rows, parts = [], []
                for i, text in enumerate(texts(batch.column("text"))):
                    starts, ends = token_spans(own, text)
                    if given is None:
                        first, last = line_spans(text)
                    else:
                        first, last = section_spans(given[i])
                    known = first >= 0
                    part = np.stack([np.arange(len(first)), first, last, np.zeros_like(first), np.zeros_like(first)])
                    part[3, known], part[4, known], outside = allocate(starts, ends, first[known], last[known], rule)
                    if outside:
                        part = np.concatenate([part, [[-1], [-1], [-1], [outside], [0]]], axis=1)
                    rows.append(np.full(part.shape[1], i))
                    parts.append(part)
                flat = np.concatenate(parts, axis=1)
                lost = flat[1] < 0
                columns = [batch.column("id").take(pa.array(np.concatenate(rows))), pa.array(flat[0].astype(np.int32))]
                columns += [pa.array(flat[k], mask=lost if k < 3 else None, type=pa.int64()) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "section", "start", "end", "n_tokens", "n_crossing"])

    source = df.select(df[id_column].alias("id"), df[text_column].alias("text"), *([df[sections].alias("spans")] if sections else []))
    out = source.mapInArrow(each, f"id {kind}, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint")
    return out.withColumnRenamed("id", id_column)
