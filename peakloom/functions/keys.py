"""Key hashing, hashed splits and the small string helpers around keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "split-v1"


def stable_fraction(key: Column, seed: str = SEED) -> Column:
    """First 16 hex digits of sha256(seed|key) over 2**64: the same number on every machine."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + "|"), key), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def assign_split(key: Column, share: float = 0.1, seed: str = SEED) -> Column:
    return F.when(stable_fraction(key, seed) < share, "validation").otherwise("train")


def stable_order(*parts: Column, seed: str = SEED) -> Column:
    """Hex digest to order by, where a seeded shuffle is meant."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def first_block(key: Column, n: int = 14) -> Column:
    return F.substring(key, 1, n)


def query_id(structure: Column, source: Column) -> Column:
    return F.concat_ws("|", structure, source)


def molecule_of(query: Column) -> Column:
    return F.split_part(query, F.lit("|"), F.lit(1))


def same_label(value: Column, label: str) -> Column:
    """Trimmed, case-blind equality; null is no match."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")))) == label.lower()


def joined_distinct(value: Column, separator: str) -> Column:
    """Aggregate: the sorted distinct values as one text."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def joined_by(rank: Column, value: Column, separator: str = ";") -> Column:
    """Aggregate: values in the order of rank as one text."""
    pairs = F.array_sort(F.collect_list(F.struct(rank.alias("r"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), separator)
