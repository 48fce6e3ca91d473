"""Scalar functions as column expressions: all run in generated code, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sizes import UNITS


def unpack_bitmask(words: Column, bits: int = 64) -> Column:
    """Positions of the bits set in an array of words, lowest first; word k starts at k * bits. Words above 2**63 may come as DECIMAL(20, 0) through signed()."""
    return F.flatten(F.transform(words, lambda w, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.getbit(w, b) == 1), lambda b: b + k * bits)))


def signed(word: Column) -> Column:
    """An unsigned 64-bit number, given as DECIMAL(20, 0), as the long of the same bits."""
    return F.when(word >= F.lit("9223372036854775808").cast("decimal(20,0)"), word - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(word).cast("long")


def rotated(devices: Column, i: Column) -> Column:
    """The array from place i on, then what stands before it, joined by commas."""
    at = F.pmod(i, F.size(devices)).cast("int")
    return F.array_join(F.concat(F.slice(devices, at + 1, F.size(devices)), F.slice(devices, F.lit(1), at)), ",")


def parsed_device(text: Column) -> Column:
    """A number, or a string that starts with GPU- or MIG-, as it is; an error for all else."""
    return F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text).cast("long").cast("string")).when(text.rlike("^(GPU|MIG)-"), text).otherwise(F.raise_error(F.concat(F.lit("not a device: "), text)))


def nth_device(i: Column, devices: Column) -> Column:
    """The i-th entry, from 0, of a comma-separated list."""
    return F.trim(F.element_at(F.split(devices, ","), (i + 1).cast("int")))


def parsed_bytes(text: Column, total: Column, align: int = 1) -> Column:
    """Bytes of a size in text, as functions.sizes.device_bytes() has it: null for null and for nothing, a share of total for 0 < x <= 1 with a point."""
    t = F.lower(F.trim(text))
    number = F.coalesce(F.nullif(F.regexp_extract(t, r"^([0-9.]+(?:e[+-]?[0-9]+)?)", 1), F.lit("")), F.lit("1")).cast("double")
    unit = F.regexp_extract(t, r"([a-z]*)$", 1)
    factor = F.element_at(F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(float(v)))]), unit)
    is_share = t.rlike(r"^[0-9]*\.[0-9]+$") & (number > 0) & (number <= 1)
    size = F.floor(F.when(is_share, number * total).otherwise(number * factor)).cast("long")
    good = t.rlike(r"^([0-9.]+(e[+-]?[0-9]+)?)?\s*[a-z]*$") & (F.length(t) > 0) & factor.isNotNull()
    return F.when(text.isNull(), None).when(good, F.nullif(size - F.pmod(size, F.lit(align)), F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not a size: "), text)))


def memory_limit(text: Column, total: Column, align: int = 1, share: float = 0.8) -> Column:
    """parsed_bytes(), and auto: all of total, default: `share` of it."""
    part = F.when(text == "auto", total.cast("double")).when(text == "default", total * share)
    whole = F.floor(part).cast("long")
    return F.when(text.isin("auto", "default"), whole - F.pmod(whole, F.lit(align))).otherwise(parsed_bytes(F.when(~text.isin("auto", "default"), text), total, align))


def log_name(worker: Column, prefix: str, is_scheduler: Column | None = None) -> Column:
    """<prefix>_<last part of the worker's path>.txt, or <prefix>_scheduler.txt."""
    name = F.element_at(F.split(worker, "/"), -1)
    return F.concat(F.lit(f"{prefix}_"), name if is_scheduler is None else F.when(is_scheduler, F.lit("scheduler")).otherwise(name), F.lit(".txt"))


def comma_choices(text: Column, allowed: list[str]) -> Column:
    """The trimmed parts of a comma-separated list; an error if one isn't allowed."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.when(F.size(F.array_except(parts, F.array(*map(F.lit, allowed)))) == 0, parts).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), text)))


def resources(text: Column) -> Column:
    """A=1 B=2, separated by commas or blanks, as a map of doubles."""
    return F.transform_values(F.str_to_map(F.trim(F.regexp_replace(text, r"[,\s]+", " ")), F.lit(" "), F.lit("=")), lambda _, v: v.cast("double"))


def ports(text: Column, workers: Column) -> Column:
    """a:b as all ports from a to b, or one port; an error if there are fewer than workers and more than one is named."""
    ends = F.transform(F.split(text, ":"), lambda x: x.cast("long"))
    all_ = F.sequence(F.element_at(ends, 1), F.element_at(ends, -1))
    return F.when((F.size(ends) == 1) & (workers <= 1) | (F.size(all_) >= workers), all_).otherwise(F.raise_error(F.lit("fewer ports than workers")))


def transport(protocol: Column, a: Column, b: Column, c: Column) -> Column:
    """not-applicable unless the protocol can choose; automatic if no option is given; else manual."""
    return F.when(~protocol.rlike("^uc"), "not-applicable").when(F.coalesce(a, b, c).isNull(), "automatic").otherwise("manual")


def throughput(data: Column, seconds: Column) -> Column:
    return F.try_divide(data, seconds)
