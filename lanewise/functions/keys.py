"""Object keys of lanes: building and parsing them as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The key layout.
NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"
SUFFIX = ".tqs"
WIDE = "L1-"


def check_name(name: str, kind: str) -> str:
    """Spaces, agents, checkpoints and leases have names that are safe in keys."""
    if not re.fullmatch(NAME, name or ""):
        raise ValueError(f"{kind} name {name!r} must match {NAME}")
    return name


def object_key(space: str, agent: Column, epoch: Column, lo: Column, hi: Column, level: Column) -> Column:
    """The key of an object that covers lo to hi of an epoch of an agent's lane."""
    check_name(space, "space")
    single = F.format_string("%012d", lo)
    wide = F.concat(F.lit(WIDE), F.format_string("%012d-%012d", lo, hi))
    stem = F.when(level == 1, wide).otherwise(single)
    return F.concat(F.lit(f"spaces/{space}/lanes/"), agent, F.lit("/e"), F.format_string("%010d", epoch), F.lit("/"), stem, F.lit(SUFFIX))


def parsed(space: str, key: Column) -> Column:
    """agent, epoch, lo, hi, level of a key; null where the key has no such part."""
    start = f"^spaces/{space}/lanes/"
    found = lambda pattern, group=1: F.nullif(F.regexp_extract(key, pattern, group), F.lit(""))
    single, wide = r"(?:^|/)(\d+)\.tqs$", r"(?:^|/)L1-(\d+)-(\d+)\.tqs$"
    return F.struct(
        found(f"{start}([^/]*)/").alias("agent"),
        found(r".*(?:^|/)e(\d+)(?:/|$)").cast("bigint").alias("epoch"),
        F.coalesce(found(single), found(wide)).cast("bigint").alias("lo"),
        F.coalesce(found(single), found(wide, 2)).cast("bigint").alias("hi"),
        F.when(found(wide).isNotNull(), 1).when(found(single).isNotNull(), 0).alias("level"),
    )
