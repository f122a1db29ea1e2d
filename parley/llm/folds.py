"""Folds of rows by the CRC-32 of an id's decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32(id as text) mod n; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def is_held_out(doc_id: str | Column, n: int, held: int) -> Column:
    return fold(doc_id, n) == held
