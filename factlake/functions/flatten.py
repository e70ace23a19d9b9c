"""Snapshot trees to leaves."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.functions.values import decode, measured, type_of, wire_size
from factlake.model import LEAF, Settings


class TreeError(ValueError):
    """``reason`` as a push is answered, ``status`` as HTTP has it."""

    def __init__(self, reason: str, status: int) -> None:
        super().__init__(reason)
        self.reason, self.status = reason, status


def flatten(tree: dict[str, Any], max_leaves: int, max_path_bytes: int) -> list[tuple[str, str, Any]]:
    """(path, fact name, value) of each leaf, depth first.

    Only objects with entries are entered; null, {} and arrays are leaves. The fact's name is
    the whole top-level key, dots and all. A path is measured before it is entered, so inner
    paths count too; two entries at one path are an error before the number of leaves is.
    """
    out: dict[str, tuple[str, str, Any]] = {}
    todo = [(key, key, value) for key, value in reversed(tree.items())]
    while todo:
        path, name, value = todo.pop()
        if len(path) * 4 > max_path_bytes and len(path.encode()) > max_path_bytes:
            raise TreeError("oversized: path-length", 413)
        if type(value) is dict and value:
            todo.extend([(f"{path}.{key}", name, inner) for key, inner in reversed(value.items())])
            continue
        if path in out:
            raise TreeError(f"bad-request: colliding path {path}", 400)
        if len(out) >= max_leaves:
            raise TreeError("oversized: leaf-count", 413)
        out[path] = path, name, value
    return list(out.values())


def tree_leaves(text: str | None, settings: Settings) -> list[tuple[str, str, Any]]:
    """The leaves of a tree's text; TreeError for what can't be a snapshot."""
    try:
        tree = decode(text) if text and text.strip(" \t\r\n") else {}
    except (ValueError, RecursionError):
        raise TreeError("bad-request", 400) from None
    if tree is None or tree == {} or type(tree) is not dict:
        raise TreeError("bad-request", 400)
    return flatten(tree, settings.max_leaves, settings.max_path_bytes)


FLAT = f"struct<reason: string, status: int, large: boolean, leaves: array<{LEAF[:-1]}, equality_key: string>>>"


def flat_batch(texts: pa.Array, settings: Settings) -> pa.StructArray:
    """``FLAT`` of a batch: for each tree the reason and status against it, or its leaves and
    whether one is over the cap. A node's snapshots mostly repeat the one before, so a text that a
    batch has more than once is read once."""
    found = texts.dictionary_encode("encode")
    if len(found.dictionary) == len(texts):
        return _flat(texts, settings)
    return _flat(found.dictionary, settings).take(found.indices)


def _flat(texts: pa.Array, settings: Settings) -> pa.StructArray:
    """Columns are filled as leaves are met; no row is made in between."""
    reasons, statuses, large, ends = [], [], [], [0]
    paths, names, values, kinds, digests, keys = columns = [[] for _ in range(6)]
    for text in texts.to_pylist():
        over = None
        try:
            leaves = tree_leaves(text, settings)
        except TreeError as e:
            reasons.append(e.reason)
            statuses.append(e.status)
        else:
            over = False
            for path, name, value in leaves:
                text, digest, key = measured(value)
                # no value is larger than six bytes a character
                over = over or (6 * len(text) > settings.max_value_bytes and wire_size(text) > settings.max_value_bytes)
                paths.append(path)
                names.append(name)
                values.append(text)
                kinds.append(type_of(value))
                digests.append(digest)
                keys.append(key)
            reasons.append(None)
            statuses.append(None)
        large.append(over)
        ends.append(len(paths))
    fields = ["path", "fact_name", "value", "value_type", "value_hash", "equality_key"]
    leaves = pa.StructArray.from_arrays([pa.array(c, pa.binary() if f == "value_hash" else pa.string()) for f, c in zip(fields, columns)], fields)
    lists = pa.ListArray.from_arrays(pa.array([None if r is not None else at for at, r in zip(ends, reasons)] + ends[-1:], pa.int32()), leaves)
    return pa.StructArray.from_arrays([pa.array(reasons, pa.string()), pa.array(statuses, pa.int32()), pa.array(large, pa.bool_()), lists], ["reason", "status", "large", "leaves"])


def read_tree(text: str | None, settings: Settings) -> dict[str, Any]:
    """``flat_batch`` of one tree."""
    return flat_batch(pa.array([text], pa.string()), settings)[0].as_py()


def flat_column(tree: Column, settings: Settings) -> Column:
    """``flat_batch`` as a column. Spark's JSON functions rewrite number literals, so this is Python, by Arrow batches."""
    return F.arrow_udf(lambda texts: flat_batch(texts, settings), FLAT)(tree)
