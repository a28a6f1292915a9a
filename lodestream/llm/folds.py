"""Deterministic folds of documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def chance(id_col: str, salt: str) -> Column:
    """A number in [0, 1) that the id decides."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1_000_000)) / F.lit(1e6)
