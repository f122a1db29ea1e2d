"""Hash expressions of shard routing and of change detection."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.settings import DEFAULTS


def java_hash(text: Column) -> Column:
    """31 h + c over the characters of the basic plane, as a signed 32-bit number."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def shard_number(text: Column, shards: int = DEFAULTS.shard_count) -> Column:
    return F.pmod(java_hash(text), F.lit(shards).cast("long")) + 1


def crc_partition(key: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(key, F.lit(""))) % parts


def word_list_fingerprint(words: Column) -> Column:
    """First 16 hexadecimal digits of the MD5 of the sorted words; an aggregate."""
    return F.substring(F.md5(F.array_join(F.array_sort(F.collect_list(words)), "\n")), 1, 16)


def config_fingerprint(config: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def sha1_name(*parts: Column) -> Column:
    """A stable name of parts joined by colons."""
    return F.sha1(F.concat_ws(":", *(p.cast("string") for p in parts)))
