"""Tables as version logs: upserts, deletes, reads as of a time, optimistic transactions, retention.

A table is a folder of Parquet rows (key, seq, ts, deleted, attributes...). A
write appends a batch under the next sequence number; the visible row of a key
is its last at or before a sequence number or a time. The writer is one driver;
readers are any number.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import delete_path, path_exists, read_text, rename_path, write_text
from .scan import for_each, project, where

SYSTEM = "\u0000sys/"
META = ["seq", "ts", "deleted"]


def visible(log: DataFrame, key: str = "key", seq: str = "seq", deleted: str = "deleted", upto=None, by: str | None = None) -> DataFrame:
    """The last version of every key, without deleted ones; ``upto`` bounds ``by`` (or seq)."""
    if upto is not None:
        log = log.where(F.col(by or seq) <= F.lit(upto))
    cols = [c for c in log.columns if c != key]
    # max_by combines before the shuffle: one row per key and task goes over
    last = log.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_last"))
    return last.where(~F.col(f"_last.{deleted}")).select(key, *(F.col(f"_last.{c}").alias(c) for c in cols))


def last_of_key(rows: DataFrame, order: str | None) -> DataFrame:
    """One row a key: the last by ``order``, which rows with equal keys must have."""
    if order is not None:
        cols = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.max_by(F.struct(*cols), F.col(order)).alias("_last")).select("key", "_last.*")
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("rows with one key need an order")
    return rows


class Conflict(Exception):
    def __init__(self, keys: list):
        super().__init__(f"{len(keys)} keys changed since the transaction began")
        self.keys = keys


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, clock=time.time):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        if isinstance(schema, str):
            from pyspark.sql.types import _parse_datatype_string

            schema = _parse_datatype_string(schema)
        self.attrs = [f for f in schema if f.name != "key" and f.name not in META]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.attrs)
        from pyspark.sql.types import _parse_datatype_string

        self.schema = _parse_datatype_string("key string, seq bigint, ts bigint, deleted boolean" + (", " + ddl if ddl else ""))

    # -- log -------------------------------------------------------------------

    def log(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def seq(self) -> int:
        return self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def epoch(self) -> tuple[str, int]:
        """The log's generation, and the sequence number up to which tombstones are gone."""
        raw = read_text(self.spark, f"{self.path}.epoch")
        return tuple(json.loads(raw)) if raw else ("", 0)

    def _renew(self, trimmed: int = 0) -> None:
        write_text(self.spark, f"{self.path}.epoch", json.dumps([uuid.uuid4().hex, trimmed]))

    def _append(self, *parts: tuple[DataFrame, bool]) -> int:
        """Write rows and tombstones as one batch under the next sequence number: all of it or nothing."""
        if not path_exists(self.spark, self.path):
            self._renew()
        seq, ts = self.seq() + 1, int(self.clock())
        batch = None
        for rows, deleted in parts:
            out = rows.select(
                F.col("key").cast("string").alias("key"), F.lit(seq).cast("bigint").alias("seq"), F.lit(ts).cast("bigint").alias("ts"), F.lit(deleted).alias("deleted"),
                *((F.col(f.name) if f.name in rows.columns and not deleted else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.attrs),
            )
            batch = out if batch is None else batch.unionByName(out)
        batch.write.mode("append").parquet(self.path)
        return seq

    # -- writes ----------------------------------------------------------------

    def put(self, rows: DataFrame, order: str | None = None) -> int:
        """Upsert a batch. Of rows with one key the last by ``order`` stays; without an order such rows are refused."""
        return self._append((last_of_key(rows, order), False))

    def delete(self, keys: DataFrame) -> int:
        return self._append((keys.select("key").distinct(), True))

    def delete_where(self, constraint: str) -> int:
        """Tombstones for the keys whose current row matches; how many."""
        keys = where(self.scan(), constraint).select("key")
        n = keys.count()
        if n:
            self.delete(keys)
        return n

    def set_attribute(self, key: str, name: str, value) -> int:
        row = self.get(key)
        kinds = {f.name: f.dataType for f in self.attrs}
        return self.put(row.withColumn(name, F.lit(value).cast(kinds[name])))

    def truncate(self) -> None:
        self._renew()
        delete_path(self.spark, self.path)

    # -- reads -----------------------------------------------------------------

    def scan(self, upto: int | None = None, system: bool = False) -> DataFrame:
        own = F.col("key").startswith(SYSTEM)
        return visible(self.log().where(own if system else ~own), upto=upto).drop(*META)

    def as_of(self, ts: int) -> DataFrame:
        return visible(self.log().where(~F.col("key").startswith(SYSTEM)), upto=ts, by="ts").drop(*META)

    def get(self, key: str) -> DataFrame:
        return visible(self.log().where(F.col("key") == key)).drop(*META)

    def query(self, constraint: str = "", as_of: int | None = None) -> DataFrame:
        return where(self.scan() if as_of is None else self.as_of(as_of), constraint)

    def project(self, attrs, constraint: str = "") -> DataFrame:
        return project(self.scan(), attrs, constraint)

    def keys(self, constraint: str = "") -> DataFrame:
        return self.query(constraint).select("key")

    def __len__(self) -> int:
        return self.scan().count()

    def for_each(self, f, upto: int | None = None) -> int:
        """Call ``f(key, attributes)`` on every row until it returns False; how many calls. Rows stream a partition at a time."""
        return for_each(self.scan(upto), f)

    def begin(self) -> "Txn":
        return Txn(self)

    # -- upkeep ----------------------------------------------------------------

    def compact(self) -> None:
        """Rewrite the log as its visible rows; history before now is gone.

        The fresh log is whole before it takes the old one's place, which stays beside until then.
        """
        fresh, was = (f"{self.path}.{kind}-{uuid.uuid4().hex}" for kind in ("fresh", "was"))
        visible(self.log()).select(*(f.name for f in self.schema)).write.parquet(fresh)
        # noted before they go: a reader that misses a tombstone would keep its key for good
        write_text(self.spark, f"{self.path}.epoch", json.dumps([self.epoch()[0], self.seq()]))
        rename_path(self.spark, self.path, was)
        rename_path(self.spark, fresh, self.path)
        delete_path(self.spark, was)

    def snapshot(self, path: str) -> None:
        visible(self.log()).write.mode("overwrite").parquet(path)

    def restore(self, path: str) -> None:
        self.truncate()
        self.spark.read.schema(self.schema).parquet(path).write.parquet(self.path)


class Txn:
    """Reads see the snapshot and the transaction's own writes; commit checks each written key against the log."""

    def __init__(self, table: Table):
        self.table, self.at = table, table.seq()
        self.puts: list[DataFrame] = []
        self.drops: list[DataFrame] = []

    def put(self, rows: DataFrame) -> None:
        self._forget(rows)
        self.puts.append(rows)

    def delete(self, keys: DataFrame) -> None:
        self._forget(keys)
        self.drops.append(keys.select("key"))

    def _forget(self, rows: DataFrame) -> None:
        keys = rows.select(F.col("key"))
        self.puts = [p.join(keys, "key", "left_anti") for p in self.puts]
        self.drops = [d.join(keys, "key", "left_anti") for d in self.drops]

    def _own_keys(self) -> DataFrame | None:
        out = None
        for df in [p.select("key") for p in self.puts] + self.drops:
            out = df if out is None else out.unionByName(df)
        return out

    def scan(self) -> DataFrame:
        base, keys = self.table.scan(self.at), self._own_keys()
        if keys is None:
            return base
        out = base.join(keys, "key", "left_anti")
        for p in self.puts:
            out = out.unionByName(p.select(*(c for c in p.columns if c in base.columns)), allowMissingColumns=True)
        return out

    def query(self, constraint: str = "") -> DataFrame:
        return where(self.scan(), constraint)

    def commit(self, ledger: str | None = None) -> list[str]:
        """Write what does not conflict; the keys that do are returned, and their rows are not written.

        With a ``ledger`` id the commit happens once however often it is tried.
        """
        spark = self.table.spark
        mark = f"{SYSTEM}ledger/{ledger}" if ledger else None
        if mark and not self.table.log().where(F.col("key") == mark).isEmpty():
            return []
        keys = self._own_keys()
        if keys is None:
            return []
        newer = self.table.log().where(F.col("seq") > self.at).select("key").distinct()
        lost = keys.join(newer, "key", "left_semi").distinct()
        conflicted = sorted(r[0] for r in lost.collect())
        parts = [(last_of_key(p.join(lost, "key", "left_anti"), None), False) for p in self.puts]
        parts += [(d.join(lost, "key", "left_anti").distinct(), True) for d in self.drops]
        if mark:
            # the mark is a record of the same batch, so it is there if and only if the writes are
            parts.append((spark.createDataFrame([(mark,)], "key string"), False))
        self.table._append(*parts)
        return conflicted


class Archive:
    """Append-only records, newest first, in day partitions; retention drops whole partitions."""

    def __init__(self, spark: SparkSession, path: str, time_attr: str, width: int = 86400):
        self.spark, self.path, self.time_attr, self.width = spark, path.rstrip("/"), time_attr, width

    def append(self, rows: DataFrame) -> None:
        seq = F.lit(time.time_ns()) + F.monotonically_increasing_id() % 1_000_000
        rows.withColumns({"_seq": seq, "_day": F.expr(f"cast({self.time_attr} as bigint) div {self.width}")}).write.mode("append").partitionBy("_day").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def query(self, constraint: str = "", limit: int | None = None) -> DataFrame:
        out = where(self.rows(), constraint).orderBy(F.col("_seq").desc())
        return out if limit is None else out.limit(limit)

    def count(self, constraint: str = "") -> int:
        return where(self.rows(), constraint).count()

    def days(self) -> list[int]:
        return sorted(r[0] for r in self.rows().select("_day").distinct().collect())

    def rotate(self, now: int, max_age: int | None = None, max_parts: int | None = None, min_age: int | None = None, floor: int | None = None) -> list[int]:
        """Drop partitions that are wholly too old or too many; ``min_age`` protects from the floor only."""
        gone = []
        days = self.days()
        for i, day in enumerate(days):
            newest = (day + 1) * self.width - 1
            old = max_age is not None and now - newest > max_age
            many = max_parts is not None and len(days) - i > max_parts
            free = floor is not None and newest < floor and (min_age is None or now - newest >= min_age)
            if old or many or free:
                delete_path(self.spark, f"{self.path}/_day={day}")
                gone.append(day)
        return gone


class Catalog:
    """Named tables, archives, views and exporters under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        raw = read_text(spark, f"{self.path}/catalog.json")
        self.entries = json.loads(raw) if raw else {}

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/catalog.json", json.dumps(self.entries))

    def _add(self, kind: str, name: str, info: dict) -> None:
        import re

        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]{0,127}", name):
            raise ValueError(f"not a name: {name!r}")
        if name in self.entries:
            raise ValueError(f"{name} exists")
        self.entries[name] = {"kind": kind, **info}
        self._save()

    def create_table(self, name: str, schema: str) -> Table:
        self._add("table", name, {"schema": schema})
        return self.table(name)

    def create_archive(self, name: str, time_attr: str, width: int = 86400) -> Archive:
        self._add("archive", name, {"time_attr": time_attr, "width": width})
        return self.archive(name)

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/tables/{name}", self._of("table", name)["schema"])

    def archive(self, name: str) -> Archive:
        e = self._of("archive", name)
        return Archive(self.spark, f"{self.path}/archives/{name}", e["time_attr"], e["width"])

    def _of(self, kind: str, name: str) -> dict:
        e = self.entries.get(name)
        if e is None or e["kind"] != kind:
            raise KeyError(f"no {kind} {name}")
        return e

    def names(self, kind: str) -> list[str]:
        return sorted(n for n, e in self.entries.items() if e["kind"] == kind)

    def drop(self, name: str) -> None:
        e = self.entries.pop(name)
        self._save()
        delete_path(self.spark, f"{self.path}/{e['kind']}s/{name}")

    def create_exporter(self, name: str, config: dict) -> None:
        self._add("exporter", name, {"config": config, "state": None})

    def save_exporter_state(self, name: str, state: str) -> None:
        self._of("exporter", name)["state"] = state
        self._save()

    def exporter(self, name: str) -> dict:
        return self._of("exporter", name)

    def snapshot(self, path: str) -> None:
        for n in self.names("table"):
            self.table(n).snapshot(f"{path}/tables/{n}")
        write_text(self.spark, f"{path}/catalog.json", json.dumps(self.entries))

    def restore(self, path: str) -> None:
        self.entries = json.loads(read_text(self.spark, f"{path}/catalog.json") or "{}")
        self._save()
        for n in self.names("table"):
            self.table(n).restore(f"{path}/tables/{n}")


def window_visible(log: DataFrame, upto: int) -> DataFrame:
    """The same as ``visible`` by a window, where the whole rows are wide and few."""
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return log.where(F.col("seq") <= upto).withColumn("_n", F.row_number().over(w)).where("_n = 1 AND NOT deleted").drop("_n")
