"""Stable identifiers and hashes."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The name-based UUID (version 5) of a name, without Python in the executors."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(digest.substr(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [digest.substr(1, 8), digest.substr(9, 4), F.concat(F.lit("5"), digest.substr(14, 3)), F.concat(variant, digest.substr(18, 3)), digest.substr(21, 12)]
    return F.concat_ws("-", *parts)


def kept_or_new(known: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(known, F.lit("")), new)


def dataset_hash(df: DataFrame) -> DataFrame:
    """One row `hash`: depends on column names and rows, not on row order or partitioning.

    Row hashes are summed and counted before they are hashed again, so no task sees all rows.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    number = lambda at: F.conv(row.substr(at, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n"), *(F.sum(number(1 + 15 * k)).alias(f"s{k}") for k in range(4)))
    return sums.select(F.sha2(F.concat_ws("|", F.lit(",".join(df.columns)), *sums.columns), 256).alias("hash"))


def release_id(parts: dict[str, str]) -> str:
    """First 16 hex digits of the hash over `name:hash` lines."""
    return hashlib.sha256("\n".join(f"{k}:{v}" for k, v in sorted(parts.items())).encode()).hexdigest()[:16]


def fingerprint_of(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cache_key(*parts: Column) -> Column:
    """Key of a cached answer: hash of the parts with NUL between them, 32 hex digits."""
    return F.sha2(F.concat_ws("\0", *parts), 256).substr(1, 32)
