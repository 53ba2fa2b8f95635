"""Byte keys: order-preserving encoders and half-open ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(value: bytes | str, what: str = "key") -> bytes:
    """A key or value as bytes; text is taken in UTF-8, None is refused."""
    if value is None:
        raise TypeError(f"{what} must not be None")
    return value.encode() if isinstance(value, str) else bytes(value)


def fixed_width_key(prefix: str, number: Column, width: int = 13) -> Column:
    """A non-negative number as prefix and fixed-width decimals, whose byte order is the numeric order."""
    return F.encode(F.format_string(f"{prefix}%0{width}d", number.cast("bigint")), "utf-8")


def text_key(text: Column) -> Column:
    return F.encode(text, "utf-8")


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def is_empty_range(low: bytes | None, high: bytes | None) -> bool:
    return low is not None and high is not None and low >= high


def in_range(key: Column, low: bytes | None, high: bytes | None) -> Column:
    """low <= key < high; a missing bound is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (key >= F.lit(low))
    if high is not None:
        out = out & (key < F.lit(high))
    return out


def hex_text(key: Column) -> Column:
    """Bytes as lower-case hexadecimal text, whose order is the byte order."""
    return F.lower(F.hex(key))


def scattered_key(number: int) -> bytes:
    """A fixed-width key that spreads consecutive numbers over the key space, for benchmarks."""
    return b"key%013d" % ((number * 0x9E3779B97F4A7C15) % 10**13)
