"""Schemas, constants and settings of the fact store."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

#: Stands for "still open" in storage, so that range filters reach the scan; see also ``is_open``.
FOREVER = dt.datetime(9999, 12, 31, 23, 59, 59, 999999)

LEAF = "struct<path: string, fact_name: string, value: string, value_type: string, value_hash: binary>"

#: A push as it arrives. Identity comes with the transport, never from the body.
PUSH = "certname string, seq bigint, received_at timestamp_ntz, producer_ts timestamp_ntz, tree string, builtin map<string, string>, external map<string, string>"

#: A push before its body is read.
REQUEST = "certname string, seq bigint, received_at timestamp_ntz, body string"

#: A push once planned: ``reason`` is set for what is rejected on its own evidence.
PLANNED = f"certname string, seq bigint, received_at timestamp_ntz, producer_ts timestamp_ntz, reason string, status int, clean boolean, durable array<{LEAF}>, volatile map<string, string>, volatile_key map<string, string>"

HISTORY = "certname string, path string, fact_name string, value string, value_type string, value_hash binary, valid_from timestamp_ntz, valid_to timestamp_ntz, is_open boolean, ended_by string"

CHANGES = "certname string, seq bigint, ts timestamp_ntz, change string, path string, fact_name string, value string, value_type string, value_hash binary"


@dataclass(frozen=True)
class Settings:
    """Limits and periods; the defaults are part of the semantics."""

    max_skew: dt.timedelta = dt.timedelta(minutes=5)
    max_body_bytes: int = 8 << 20
    max_leaves: int = 50_000
    max_path_bytes: int = 1024
    max_value_bytes: int = 256 << 10
    pushes_per_minute: int = 6
    dirty_streak: int = 10
    expire_after: dt.timedelta = dt.timedelta(days=7)
    max_query_bytes: int = 8192

    def limits(self) -> dict[str, int]:
        """What a producer is told before it pushes."""
        return {"max_snapshot_bytes": self.max_body_bytes, "max_leaf_count": self.max_leaves, "max_path_len": self.max_path_bytes, "max_value_bytes": self.max_value_bytes}


class FactError(Exception):
    """An error that a query surface answers with ``status``."""

    status = 500


class BadQuery(FactError):
    status = 400


class UnsupportedQuery(BadQuery):
    pass


class NoHistory(FactError):
    """A volatile path was asked for at an explicit time."""

    status = 422


class QueryTooLong(FactError):
    status = 413


class NodeNotFound(FactError):
    status = 404
