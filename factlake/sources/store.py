"""The fact tables on disk: files that never change, and a log of which of them count.

``root/data/<commit>/`` holds what one commit wrote, ``root/log/`` a file for each commit. Open facts,
nodes and volatile values lie in buckets of nodes, and a commit replaces the buckets that it
touched. Closed intervals and new paths are only ever added.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from factlake.functions.classify import Policy
from factlake.functions.times import ntz
from factlake.model import HISTORY, FactError, Settings
from factlake.operators import lifecycle
from factlake.operators.carry import NODES, VOLATILE, Applied, Carried, apply_batch, deactivate, nothing, reset
from factlake.operators.intervals import fact_paths
from factlake.operators.reads import facts_at
from factlake.plans.compile import Facts
from factlake.sources.shared import kept

LAYOUT = 2
PATHS = "path string, fact_name string"

#: A line of the log. ``commit`` lines name the batch; the others a folder by table and part, which
#: is a bucket, or a level and slot of closed intervals.
ENTRY = "number long, kind string, part string, path string, level int, slot long, layout int, whole boolean"

#: Spans have 2 ** 11 minutes or more, a day and a half, so that a batch closes intervals of few spans.
LEAST_LEVEL = 11

#: The tables whose buckets a commit replaces.
REPLACED = {"open": HISTORY, "nodes": NODES, "volatile": VOLATILE}


class Conflict(FactError):
    """Another writer committed first; what was read is no longer what is there."""

    status = 409


def _minute(time: str) -> Column:
    """Minutes since 1970, in no zone."""
    return F.unix_date(F.to_date(time)) * F.lit(1440).cast("long") + F.hour(time) * 60 + F.minute(time)


def spanned(closed: DataFrame) -> DataFrame:
    """``closed`` with ``level`` and ``slot``: the least level, ``LEAST_LEVEL`` or more, whose spans of
    ``2 ** level`` minutes are no shorter than the interval, and the number of the span in which it began."""
    level = F.greatest(F.length(F.bin(_minute("valid_to") - _minute("valid_from"))), F.lit(LEAST_LEVEL))
    return closed.withColumn("level", level).withColumn("minute", _minute("valid_from")).withColumn("slot", F.expr("shiftright(minute, level)")).drop("minute")


def holding(at: dt.datetime) -> Column:
    """Which (level, slot) may have an interval that holds at a time: it began in the time's span or
    in the one before, whatever the level. So a read of the past opens two spans a level."""
    minute = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=1)
    return F.expr(f"slot BETWEEN shiftright(CAST({minute} AS BIGINT), level) - 1 AND shiftright(CAST({minute} AS BIGINT), level)")


def _as(table: DataFrame, schema: str) -> DataFrame:
    """A table's columns in a schema's order and types, null where it lacks one."""
    return table.select(*[(F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


class StoredFacts(Facts):
    """``Facts`` of one commit that open only what a question needs: the open files for now, and of
    the closed ones those whose span can hold the time asked about."""

    def __init__(self, store: FactStore, number: int, policy: Policy) -> None:
        self.store, self.number, self.policy = store, number, policy
        self.nodes, self.volatile, self.current = (store.read(kind, number) for kind in ("nodes", "volatile", "open"))

    @property
    def history(self) -> DataFrame:
        return self.current.unionByName(self.store.read("closed", self.number))

    def now(self) -> DataFrame:
        return self.current

    def at(self, at: dt.datetime) -> DataFrame:
        return facts_at(self.current.unionByName(self.store.read("closed", self.number, holding(at))), at)


@dataclass
class FactStore:
    """A store under ``root``, which all executors share.

    A commit writes its data, then one log file that must not be there yet: so readers see a commit
    whole or not at all, and of two writers that read the same state one gets ``Conflict``. What a
    failed commit wrote is never named and never read.
    """

    spark: SparkSession
    root: str
    buckets: int = 64
    upgrades: list[tuple[int, Callable[[FactStore], None]]] = field(default_factory=lambda: UPGRADES)
    _whole: dict[int, int] = field(default_factory=dict)

    # --- the log

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def log(self) -> DataFrame | None:
        if not self.exists(f"{self.root}/log"):
            return None
        return self.spark.read.schema(ENTRY).json(f"{self.root}/log")

    def version(self) -> int:
        """The number of the last commit."""
        log = self.log()
        if log is None:
            raise ValueError(f"{self.root} holds no store" + (", or one of layout 1: upgrade it" if self.exists(f"{self.root}/current") else ""))
        row = log.filter("kind = 'commit'").agg(F.max("number").alias("number"), F.max("layout").alias("layout")).first()
        if row.layout != LAYOUT:
            raise ValueError(f"the store has layout {row.layout}, this code reads {LAYOUT}")
        return row.number

    def committed(self, batch: str) -> bool:
        log = self.log()
        return log is not None and log.filter((F.col("kind") == "commit") & (F.col("part") == batch)).limit(1).count() > 0

    def _entries(self, kind: str, number: int, where: Column | None = None) -> DataFrame:
        """The log's lines of a table that count at a commit."""
        log = self.log().filter(F.col("number") <= number)
        if number not in self._whole:  # what a commit's past is doesn't change
            self._whole[number] = log.filter("whole").agg(F.max("number")).first()[0] or 0
        own = log.filter((F.col("kind") == kind) & (F.col("number") >= self._whole[number]))
        own = own if where is None else own.filter(where)
        return own.groupBy("part").agg(F.max_by("path", "number").alias("path")) if kind in REPLACED else own

    def files(self, kind: str, number: int, where: Column | None = None) -> list[str]:
        """Folders of a table at a commit; their names alone come to the driver."""
        return sorted(r.path for r in self._entries(kind, number, where).filter("path IS NOT NULL").select("path").collect())

    def read(self, kind: str, number: int, where: Column | None = None) -> DataFrame:
        schema = {**REPLACED, "closed": HISTORY, "paths": PATHS}[kind]
        found = self.files(kind, number, where)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{path}" for path in found)) if found else self.spark.createDataFrame([], schema)

    def _commit(self, after: int, lines: list[dict], batch: str, whole: bool = False) -> int:
        number = after + 1
        header = {"kind": "commit", "part": batch, "layout": LAYOUT, "whole": whole}
        text = "\n".join(json.dumps({"number": number, **line}) for line in [header, *lines])
        final, draft = f"{self.root}/log/{number:020d}.json", f"{self.root}/log/.{uuid.uuid4().hex}"
        fs, where = self._fs(draft)
        out = fs.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        never = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never[0] = getattr(hadoop, "Options$Rename").NONE
        try:  # a rename that doesn't replace, so that the file appears whole or not at all
            hadoop.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(where, hadoop.Path(final), never)
        except Exception as e:
            fs.delete(where, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"commit {number} is another writer's") from e
            raise
        return number

    # --- writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("certname"), F.lit(self.buckets)).cast("int")

    def _write_replaced(self, kind: str, table: DataFrame, at: str, touched: list[int]) -> list[dict]:
        """The touched buckets of a table, each sorted as it is asked for. A fact that all nodes share
        stands in each bucket, so no task gathers it."""
        order = ["path", "value_hash", "valid_from"] if kind == "open" else ["certname"]
        rows = _as(table, REPLACED[kind]).withColumn("bucket", self._bucket())
        rows.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.root}/{at}/{kind}")
        return [{"kind": kind, "part": str(b), "path": path if self.exists(f"{self.root}/{(path := f'{at}/{kind}/bucket={b}')}") else None} for b in touched]

    def _write_closed(self, closed: DataFrame, at: str) -> list[dict]:
        """Closed intervals by level and slot, many to a file only where they are many."""
        where = f"{self.root}/{at}/closed"
        spans = spanned(_as(closed, HISTORY)).repartition("level", "slot", F.pmod(F.xxhash64("path", "value_hash"), F.lit(4)))
        spans.sortWithinPartitions("level", "slot", "path", "value_hash", "valid_from").write.partitionBy("level", "slot").parquet(where)
        fs, folder = self._fs(where)
        lines = []
        for one in fs.listStatus(folder):
            if one.isDirectory():
                level = one.getPath().getName()
                for two in fs.listStatus(one.getPath()):
                    slot = two.getPath().getName()
                    lines.append({"kind": "closed", "part": f"{level}/{slot}", "path": f"{at}/closed/{level}/{slot}", "level": int(level[6:]), "slot": int(slot[5:])})
        return lines

    def _write_paths(self, paths: DataFrame, number: int, at: str) -> list[dict]:
        """What the dictionary hasn't got yet; nothing that is only asked about ever gets there."""
        known = self.read("paths", number) if number else self.spark.createDataFrame([], PATHS)
        new = paths.distinct().join(known, ["path", "fact_name"], "left_anti")
        new.write.parquet(f"{self.root}/{at}/paths")
        some = self.spark.read.schema(PATHS).parquet(f"{self.root}/{at}/paths").limit(1).count()
        return [{"kind": "paths", "part": "", "path": f"{at}/paths"}] if some else []

    def save(self, history: DataFrame, nodes: DataFrame, volatile: DataFrame) -> int:
        """A whole history in place of all that was there."""
        log = self.log()
        after = self.version() if log is not None else 0
        at, every = f"data/{uuid.uuid4().hex}", list(range(self.buckets))
        history = kept(history, "history")  # four tables are made of it
        edges = history.groupBy("certname").agg(F.max(F.when(F.col("is_open"), F.col("valid_from"))).alias("open_from"), F.max(F.when(~F.col("is_open"), F.col("valid_to"))).alias("closed_to"))
        if "open_from" not in nodes.columns:
            nodes = nodes.join(edges, "certname", "left")
        lines = self._write_replaced("open", history.filter("is_open"), at, every) + self._write_closed(history.filter("NOT is_open"), at)
        lines += self._write_replaced("nodes", nodes, at, every) + self._write_replaced("volatile", volatile, at, every)
        return self._commit(after, lines + self._write_paths(fact_paths(history), 0, at), at, whole=True)

    def _carried(self, number: int, touched: list[int]) -> Carried:
        """The state of the touched buckets."""
        return Carried(**{kind: self.read(kind, number, F.col("part").isin(*map(str, touched))) for kind in REPLACED}) if number else nothing(self.spark)

    def _touched(self, names: DataFrame) -> list[int]:
        return sorted(r[0] for r in names.select(self._bucket()).distinct().collect())

    def apply(self, planned: DataFrame, batch: str | None = None, settings: Settings = Settings()) -> Applied | None:
        """Takes a batch of planned pushes, all of which arrived after those that are stored.

        Reads and rewrites the buckets of its nodes, adds the intervals that it closes and its new
        paths. A ``batch`` that was committed before changes nothing, and None comes back. What
        comes back else is read from what was written.
        """
        if batch is not None and self.committed(batch):
            return None
        after = self.version() if self.log() is not None else 0
        at = f"data/{uuid.uuid4().hex}"

        touched = self._touched(planned.filter("certname IS NOT NULL"))
        done = apply_batch(planned, self._carried(after, touched), settings, kept)
        lines = [x for kind in REPLACED for x in self._write_replaced(kind, getattr(done.after, kind), at, touched)] if touched else []
        lines += self._write_closed(done.closed, at)
        # what applied pushes show lies in the intervals, which are fewer; carried ones are known already
        shown = done.closed.unionByName(done.after.open)
        self._commit(after, lines + self._write_paths(fact_paths(shown), after, at), batch or at)
        return done

    def _change_nodes(self, which: DataFrame, change: Callable[[Carried], tuple[Carried, DataFrame | None]]) -> int:
        after = self.version()
        touched, at = self._touched(which), f"data/{uuid.uuid4().hex}"
        if not touched:
            return after
        state, closed = change(self._carried(after, touched))
        lines = [x for kind in ("open", "nodes") for x in self._write_replaced(kind, getattr(state, kind), at, touched)]
        return self._commit(after, lines + (self._write_closed(closed, at) if closed is not None else []), at)

    def deactivate(self, which: DataFrame, as_of: dt.datetime) -> int:
        """Seals the nodes of ``which`` for good; those sealed before keep their seal."""
        return self._change_nodes(which, lambda c: deactivate(c, which.select("certname", ntz(as_of).alias("at"))))

    def reset(self, which: DataFrame) -> int:
        """The nodes of ``which`` lose their watermark."""
        return self._change_nodes(which, lambda c: (reset(c, which), None))

    def expire(self, as_of: dt.datetime, after: dt.timedelta = Settings().expire_after) -> int:
        """Marks the nodes that have gone silent; only their buckets are rewritten."""
        nodes = self.read("nodes", self.version())
        due = lifecycle.expire_stale(nodes, as_of, after).filter(F.col("expired") == ntz(as_of))
        return self._change_nodes(due, lambda c: (Carried(lifecycle.expire_stale(c.nodes, as_of, after), c.open, c.volatile), None))

    # --- reading

    def open(self, policy: Policy = Policy(), number: int | None = None) -> StoredFacts:
        """The facts at a commit, the last one if none is named."""
        number = self.version() if number is None else number
        return StoredFacts(self, number, policy)

    def paths(self) -> DataFrame:
        """The dictionary: each path that an applied push has shown."""
        return self.read("paths", self.version())

    # --- layouts

    def upgrade(self) -> list[int]:
        """Brings a store of an older layout to this one, step by step; the layouts that were reached.

        Steps run in the order of their numbers. Each is safe to repeat and counts once the log, or
        a store's old pointer, says so; a number that is there twice is an error.
        """
        steps = upgrade_chain(self.upgrades)
        now, reached = (LAYOUT if self.log() is not None else 1 if self.exists(f"{self.root}/current") else 0), []
        if now == 0:
            raise ValueError(f"{self.root} holds no store")
        for number, step in steps:
            if number > now:
                step(self)
                reached.append(number)
        return reached


def upgrade_chain(steps: list[tuple[int, Callable]]) -> list[tuple[int, Callable]]:
    numbers = [n for n, _ in steps]
    if len(set(numbers)) != len(numbers):
        raise ValueError(f"an upgrade's number is there twice: {numbers}")
    return sorted(steps, key=lambda s: s[0])


def _from_pointers(store: FactStore) -> None:
    """Layout 1 had a folder for each whole version, and numbered pointers in ``current``. Its nodes
    had no streaks, which begin at none."""
    try:
        last: Row = store.spark.read.schema("layout int, number long, version string").parquet(f"{store.root}/current").orderBy(F.desc("number"), "version").first()
    except AnalysisException as e:
        raise ValueError(f"{store.root} holds no store") from e
    at = f"{store.root}/{last.version}"
    history = store.spark.read.schema(HISTORY).parquet(f"{at}/history")
    store.save(history, store.spark.read.parquet(f"{at}/nodes"), store.spark.read.parquet(f"{at}/volatile"))


#: Steps by the layout that they lead to.
UPGRADES: list[tuple[int, Callable[[FactStore], None]]] = [(2, _from_pointers)]
