"""Materialised views: live gauges and continuous aggregates that seal time buckets by the clock.

A gauge keeps each key's last contribution (its group and value) in a folder of
rows by key; a batch of changes replaces those of the keys it has. Groups are
sums over the contributions, so an update subtracts what it replaces. A
continuous view also seals buckets whose end is ``grace`` behind the clock:
their groups move to an append-only folder, and later rows for a sealed bucket
are dropped and counted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import text
from ..plans.compile import Compiler, Untyped, as_real, plain_arithmetic, scope_of, true_of
from ..sources.files import delete_path, path_exists, read_text, write_text


class TooManySeries(RuntimeError):
    pass


@dataclass(frozen=True)
class ViewSpec:
    """COUNT, and SUM and AVG of ``value``, by group; with a ``time`` attribute and width, by bucket as well."""

    groups: tuple
    value: str = ""
    only: str = ""
    time: str = ""
    width: int = 0
    grace: int = 0
    max_series: int = 10_000

    @property
    def continuous(self) -> bool:
        return bool(self.time)

    def check(self) -> None:
        if not self.groups and not self.continuous:
            raise ValueError("a view needs a group or a time bucket")
        if self.continuous and self.width <= 0:
            raise ValueError("a time bucket needs a width")
        if self.max_series <= 0:
            raise ValueError("max_series")


def contributions(rows: DataFrame, spec: ViewSpec) -> DataFrame:
    """(key, group columns, bucket, value) of the rows that count. An undefined label is the empty text."""
    with plain_arithmetic(rows.sparkSession):
        c = Compiler(scope_of(rows))
        keep = true_of(c.compile(spec.only)) if spec.only else F.lit(True)
        cols = []
        for g in spec.groups:
            x = c.compile(g)
            try:
                label = text(x)
            except Untyped:
                label = x
            cols.append((F.lit("") if label.v is None else F.coalesce(label.v, F.lit(""))).alias(g))
        bucket = F.lit(None).cast("bigint")
        if spec.continuous:
            t = c.compile(spec.time)
            bucket = F.floor(as_real(t) / spec.width).cast("bigint") * spec.width
            keep = keep & bucket.isNotNull()
        value = F.lit(None).cast("double")
        if spec.value:
            v = c.compile(spec.value)
            if v.kind in "bir":
                value = as_real(v) if v.err is False else F.when(~v.err, as_real(v))
        return rows.where(keep).select("key", *cols, bucket.alias("bucket"), value.alias("value"))


def rollup(contribs: DataFrame, spec: ViewSpec) -> DataFrame:
    """Groups of contributions; sums and averages are real, 0.0 of none."""
    by = [*spec.groups, *(["bucket"] if spec.continuous else [])]
    return contribs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("sum"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg")
    )


class View:
    """A view's state under a folder: contributions, sealed groups and the watermark."""

    def __init__(self, spark: SparkSession, path: str, spec: ViewSpec):
        spec.check()
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        raw = read_text(spark, f"{self.path}/state.json")
        self.state = json.loads(raw) if raw else {"live": None, "sealed_to": None, "late": 0, "failed": False, "batch": -1, "spec": asdict(spec)}

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/state.json", json.dumps(self.state))

    def _contribs(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{self.state['live']}") if self.state["live"] else None

    def apply(self, changes: DataFrame, batch: int | None = None) -> None:
        """One batch of change rows (key, seq, kind or deleted, attributes). A batch number seen before does nothing."""
        if batch is not None and batch <= self.state["batch"]:
            return
        if "kind" in changes.columns:
            changes = changes.withColumn("deleted", F.col("kind") == "delete").drop("kind")
        cols = [c for c in changes.columns if c != "key"]
        last = changes.groupBy("key").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("_e")).select("key", "_e.*")
        new = contributions(last.where(~F.col("deleted")), self.spec)
        late = 0
        sealed = self.state["sealed_to"]
        touched = last.select("key")
        if self.spec.continuous and sealed is not None:
            late = new.where(F.col("bucket") <= sealed).count()
            new = new.where(F.col("bucket") > sealed)
        old = self._contribs()
        kept = new if old is None else old.join(touched, "key", "left_anti").unionByName(new)
        self._replace(kept)
        self.state["late"] += late
        if batch is not None:
            self.state["batch"] = batch
        n = rollup(self._contribs(), self.spec).count()
        if n > self.spec.max_series:
            self.state["failed"] = True
        self._save()
        if self.state["failed"]:
            raise TooManySeries(f"{n} series; the view holds {self.spec.max_series}")

    def _replace(self, rows: DataFrame) -> None:
        fresh, was = f"live-{uuid.uuid4().hex}", self.state["live"]
        rows.write.parquet(f"{self.path}/{fresh}")
        self.state["live"] = fresh
        self._save()
        if was:
            delete_path(self.spark, f"{self.path}/{was}")

    def seal(self, now: int) -> int:
        """Move buckets that end ``grace`` before now to the sealed folder; how many groups went."""
        live = self._contribs()
        if live is None or not self.spec.continuous:
            return 0
        ripe = live.where(F.col("bucket") <= now - self.spec.width - self.spec.grace)
        top = ripe.agg(F.max("bucket")).first()[0]
        if top is None:
            return 0
        groups = rollup(ripe, self.spec)
        n = groups.count()
        # rows at or before what was sealed are late, so no other seal has this folder; one that broke off is done anew
        groups.write.mode("overwrite").parquet(f"{self.path}/sealed/upto={top}")
        # the watermark moves with what was sealed, not with the clock
        self._replace(live.where(F.col("bucket") > now - self.spec.width - self.spec.grace))
        self.state["sealed_to"] = max(top, self.state["sealed_to"] if self.state["sealed_to"] is not None else top)
        self._save()
        return n

    def live(self) -> DataFrame | None:
        c = self._contribs()
        return None if c is None else rollup(c, self.spec)

    def sealed(self) -> DataFrame | None:
        path = f"{self.path}/sealed"
        return self.spark.read.parquet(path).drop("upto") if path_exists(self.spark, path) else None

    def rows(self) -> DataFrame:
        """Live and sealed groups."""
        live, sealed = self.live(), self.sealed()
        if live is None or sealed is None:
            return live if sealed is None else sealed
        return live.unionByName(sealed)


def tumbling(rows: DataFrame, spec: ViewSpec, seal_at: int, late_from: int | None = None) -> DataFrame:
    """The sealed groups of a batch: what a view that saw these rows in time holds at ``seal_at``."""
    c = contributions(rows, spec)
    if late_from is not None:
        c = c.where(F.col("bucket") > late_from)
    return rollup(c.where(F.col("bucket") <= seal_at - spec.width - spec.grace), spec)
