"""The table's schemas and the description of a run."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

PUT, DELETE = "P", "D"
CHANGELOG = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("value", T.BinaryType())])
LIVE = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])


@dataclass(frozen=True)
class RunMeta:
    """One immutable sorted file: its level, the commit that made it, its size and its key range."""

    path: str
    level: int
    seq: int
    entries: int
    tombstones: int
    size: int
    first_key: bytes
    last_key: bytes

    def to_json(self) -> dict:
        return asdict(self) | {"first_key": self.first_key.hex(), "last_key": self.last_key.hex()}

    @classmethod
    def from_json(cls, x: dict) -> RunMeta:
        return cls(**x | {"first_key": bytes.fromhex(x["first_key"]), "last_key": bytes.fromhex(x["last_key"])})

    def overlaps(self, first: bytes, last: bytes) -> bool:
        """Whether the run's closed key range meets the closed range [first, last]."""
        return self.first_key <= last and first <= self.last_key

    def meets(self, low: bytes | None, high: bytes | None) -> bool:
        """Whether the run may hold keys of the half-open range [low, high)."""
        return (low is None or self.last_key >= low) and (high is None or self.first_key < high)
