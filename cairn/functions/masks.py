"""Archetype masks: bit t of a bigint is set where the entity has a row in table t, 0 <= t < 64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(table_id: int) -> int:
    if not 0 <= table_id < 64:
        raise ValueError(f"table id {table_id} isn't in 0..63; a shift would wrap around")
    return table_id


def empty() -> Column:
    return F.lit(0).cast("long")


def bit(table_id: int) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), checked(table_id))


def add(mask: Column, table_id: int) -> Column:
    return mask.bitwiseOR(bit(table_id))


def remove(mask: Column, table_id: int) -> Column:
    return mask.bitwiseAND(F.bitwise_not(bit(table_id)))


def contains(mask: Column, table_id: int) -> Column:
    return F.getbit(mask, F.lit(checked(table_id))) == 1


def of(*table_ids: int) -> int:
    """The mask as a signed 64-bit integer."""
    m = 0
    for t in table_ids:
        m |= 1 << checked(t)
    return m - 2**64 if m >= 2**63 else m
