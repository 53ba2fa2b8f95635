"""Measures: nearest-rank percentiles and amplification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(column: str, share: float) -> Column:
    """The value at rank ceil(share * n): an aggregate."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def median(values: list[float]) -> float:
    """The middle value, the upper of two middles."""
    return sorted(values)[len(values) // 2]


@dataclass
class IoStats:
    """Bytes since the table was opened: given by callers, and written to the log, by flushes and by compactions."""

    logical: int = 0
    wal: int = 0
    flush: int = 0
    compaction: int = 0

    @property
    def physical(self) -> int:
        return self.wal + self.flush + self.compaction

    @property
    def write_amplification(self) -> float:
        return self.physical / self.logical if self.logical else float("nan")

    def rows(self) -> list[tuple[str, float]]:
        names = ("logical", "wal", "flush", "compaction", "physical", "write_amplification")
        return [(k, float(getattr(self, k))) for k in names]


def payload_bytes(live: DataFrame) -> int:
    """Key and value bytes of a live table."""
    return live.agg(F.sum(F.octet_length("key") + F.octet_length("value"))).first()[0] or 0
