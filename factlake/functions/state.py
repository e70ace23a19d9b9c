"""One node's ingest as a state machine: for streams, for histories with resets, and as a model."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

TICK = dt.timedelta(microseconds=1)


@dataclass
class NodeState:
    """Open facts by path with their values and starts, and what guards the next push."""

    known: bool = False
    watermark: dt.datetime | None = None
    deactivated: dt.datetime | None = None
    last_closed: dt.datetime | None = None
    open: dict[str, tuple[Any, ...]] = field(default_factory=dict)  # path -> (hash, start)

    def outcome(self, ts: dt.datetime, received: dt.datetime, skew: dt.timedelta) -> str:
        """Why a push that is sound in itself is or isn't applied; the first reason counts."""
        if ts > received + skew:
            return "skewed"
        if self.deactivated is not None:
            return "deactivated"
        if self.watermark is not None and ts <= self.watermark:
            return "stale"
        if not self.known and ts < received - skew:
            return "skewed"
        if self.watermark is None:  # else it is past every start and end
            if self.open and ts <= max(start for _, start in self.open.values()):
                return "stale"
            if self.last_closed is not None and ts < self.last_closed:
                return "stale"
        return "applied"

    def apply(self, ts: dt.datetime, leaves: list[dict], clean: bool) -> list[tuple[str, dict]]:
        """(change, leaf) pairs: close, tombstone (by path alone) and open."""
        changes: list[tuple[str, dict]] = []
        present = set()
        for leaf in leaves:
            path, digest = leaf["path"], bytes(leaf["value_hash"])
            present.add(path)
            held = self.open.get(path)
            if held is not None and held[0] == digest:
                continue
            if held is not None:
                changes.append(("close", {"path": path}))
                self.last_closed = ts
            changes.append(("open", leaf))
            self.open[path] = digest, ts
        if clean and leaves:
            for path in [p for p in self.open if p not in present]:
                changes.append(("tombstone", {"path": path}))
                self.last_closed = ts
                del self.open[path]
        self.known, self.watermark = True, ts
        return changes

    def reset(self) -> None:
        self.watermark = None

    def deactivate(self, now: dt.datetime) -> tuple[dt.datetime, list[tuple[str, dict]]]:
        """The seal, the first one if there is one already, and what it closes."""
        if self.deactivated is not None:
            return self.deactivated, []
        seal = max(now, max((start for _, start in self.open.values()), default=now) + TICK)
        changes = [("seal", {"path": path}) for path in self.open]
        self.open.clear()
        self.deactivated = self.last_closed = seal
        return seal, changes
