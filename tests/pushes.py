"""Pushes for tests."""

import datetime as dt

from factlake.model import PUSH

t1, t2, t3 = (dt.datetime(2026, 1, 1, h) for h in (10, 11, 12))
CLEAN = ({"os": "ok"}, {})
DIRTY = ({}, {"/etc/facts.d/rpm.sh": "error"})


def pushes(spark, rows):
    """(certname, producer_ts, tree, clean|dirty[, received_at]) in arrival order."""
    out = []
    for seq, (name, ts, tree, kind, *received) in enumerate(rows):
        builtin, external = CLEAN if kind == "clean" else DIRTY
        out.append((name, seq, received[0] if received else ts, ts, tree, builtin, external))
    return spark.createDataFrame(out, PUSH)
