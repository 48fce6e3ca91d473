"""Byte sizes on the driver. The same rules as columns: functions.scalars.parse_bytes."""

from __future__ import annotations

import re

#: Bytes of each unit; fixed values.
UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15}


def byte_size(text: str) -> int:
    """A number with a unit; a unit alone is one of it."""
    found = re.fullmatch(r"\s*([0-9.]+(?:e[+-]?[0-9]+)?)?\s*([a-z]*)\s*", text.lower())
    if not found or found[2] not in UNITS or not (found[1] or found[2]):
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1] or 1) * UNITS[found[2]])


def device_bytes(size, total: int, align: int = 1) -> int | None:
    """None or nothing: None. A float in (0, 1], or text that reads as such a float with a point: that share of `total`. Else bytes. Rounded down to `align`."""
    if size is None:
        return None
    if isinstance(size, str):
        as_float = float(size) if re.fullmatch(r"\s*[0-9]*\.[0-9]+\s*", size) else None
        size = as_float if as_float is not None and 0 < as_float <= 1 else byte_size(size)
    if isinstance(size, float) and 0 < size <= 1:
        size = int(total * size)
    size = int(size)
    return size // align * align if size else None


def memory_limit(limit, total: int | None, align: int = 1, share: float = 0.8) -> int | None:
    """device_bytes(), and "auto": all, "default": `share` of it; both None where there is no memory of its own (total None)."""
    if limit in ("auto", "default"):
        return None if total is None else device_bytes(1.0 if limit == "auto" else share, total, align)
    return device_bytes(limit, total or 0, align)
