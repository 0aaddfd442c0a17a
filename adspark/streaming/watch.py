"""Change events from a version log: watch, filtered watch, coalescing, fan-out, sinks and acknowledgements."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import compile_over
from ..operators.versions import META, SYSTEM, Table
from ..plans.compile import plain_arithmetic, true_of
from ..sources.files import path_exists, read_text, write_text


def events(log: DataFrame, after: int = -1) -> DataFrame:
    """Log rows after a cursor as events: kind, key, seq and the row. Deletes come before upserts."""
    kind = F.when(F.col("deleted"), "delete").otherwise("upsert")
    return log.where(F.col("seq") > after).withColumn("kind", kind).orderBy(F.col("kind"), "seq", "key")


def catch_up(table: Table, after: int | None = None) -> tuple[DataFrame, int]:
    """Everything since a cursor (all visible rows without one), and the cursor to go on from."""
    head = table.seq()
    log = table.log().where(F.col("seq") <= head)
    if after is None or after > head:
        rows = table.scan(head).withColumns({"kind": F.lit("upsert"), "seq": F.lit(head).cast("bigint")})
        return rows, head
    return coalesce(events(log, after).drop("ts", "deleted")), head


def _resumes_at(table: Table, cursor: str | None) -> int | None:
    """The sequence number a cursor goes on from; none where it is of another generation or before lost tombstones."""
    epoch, trimmed = table.epoch()
    if cursor is None:
        return None
    own, at = json.loads(cursor)
    return at if own == epoch and trimmed <= at <= table.seq() else None


def _marks(rows: DataFrame, kind: str, cursor: str | None) -> DataFrame:
    """One event without a key."""
    mark = rows.sparkSession.createDataFrame([(kind, cursor)], "kind string, cursor string")
    return mark.select(*((F.col(f.name) if f.name in mark.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))


def watch(table: Table, cursor: str | None = None) -> tuple[DataFrame, str]:
    """Catch up from a cursor: the events and the cursor to go on from.

    After a fitting cursor: each changed key's last event, deletes before
    upserts. Else a ``reset``, upon which a reader forgets what it has, and all
    visible rows. ``synced`` ends both and alone carries the cursor. The parts
    are a union in that order, so no sort orders them.
    """
    at, head = _resumes_at(table, cursor), table.seq()
    after = json.dumps([table.epoch()[0], head])
    shape = lambda df: df.withColumn("cursor", F.lit(None).cast("string"))
    if at is None:
        rows = shape(table.scan(head).withColumns({"kind": F.lit("upsert"), "seq": F.lit(head).cast("bigint")}))
        parts = [_marks(rows, "reset", None), rows]
    else:
        log = table.log().where((F.col("seq") > at) & (F.col("seq") <= head) & ~F.col("key").startswith(SYSTEM))
        rows = shape(coalesce(log.withColumn("kind", F.when(F.col("deleted"), "delete").otherwise("upsert")).drop("ts", "deleted")))
        parts = [rows.where("kind = 'delete'"), rows.where("kind = 'upsert'")]
    out = parts[0].unionByName(parts[1])
    return out.unionByName(_marks(out, "synced", after)), after


def poll(table: Table, cursor: str) -> tuple[DataFrame, str]:
    """Live events after a cursor, each with its own; where it fits no more, one ``resync``: the reader must catch up again."""
    at, head = _resumes_at(table, cursor), table.seq()
    epoch = table.epoch()[0]
    log = table.log().where((F.col("seq") > (head if at is None else at)) & (F.col("seq") <= head) & ~F.col("key").startswith(SYSTEM))
    kind = F.when(F.col("deleted"), "delete").otherwise("upsert")
    rows = log.withColumns({"kind": kind, "cursor": F.format_string("[%s, %d]", F.lit(json.dumps(epoch)), F.col("seq"))}).drop("ts", "deleted")
    if at is None:
        return _marks(rows, "resync", None), cursor
    return rows.orderBy("seq", "kind", "key"), json.dumps([epoch, head])


def coalesce(changes: DataFrame) -> DataFrame:
    """The last event of every key."""
    cols = [c for c in changes.columns if c != "key"]
    return changes.groupBy("key").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("_e")).select("key", "_e.*")


def filtered(log: DataFrame, constraint: str) -> DataFrame:
    """The log seen through a constraint: a key that stops matching is deleted, one that never did is not seen."""
    with plain_arithmetic(log.sparkSession):
        hit = F.coalesce(true_of(compile_over(log, constraint)), F.lit(False)) & ~F.col("deleted")
        w = Window.partitionBy("key").orderBy("seq")
        marked = log.withColumn("_hit", hit).withColumn("_was", F.coalesce(F.lag("_hit").over(w), F.lit(False)))
    return marked.where("_hit OR _was").withColumn("kind", F.when(F.col("_hit"), "upsert").otherwise("delete")).drop("_hit", "_was")


def stream(spark: SparkSession, table: Table) -> DataFrame:
    """The log as a stream; its checkpoint is the cursor."""
    return spark.readStream.schema(table.schema).parquet(table.path)


def run_available(df: DataFrame, each, checkpoint: str) -> None:
    """Process what there is, batch by batch, and stop."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def fan_out(changed_parents: DataFrame, children: DataFrame, parent_key: str = "parent", before: DataFrame | None = None) -> DataFrame:
    """Children of changed parents, seen anew; with the parents' rows before, only where an inherited value differs."""
    p = changed_parents.select(F.col("key").alias(parent_key), *(F.col(c) for c in changed_parents.columns if c not in ("key", *META, "kind")))
    if before is not None:
        names = [c for c in p.columns if c != parent_key]
        old = before.select(F.col("key").alias(parent_key), F.struct(*names).alias("_old"))
        p = p.join(old, parent_key, "left").where(F.col("_old").isNull() | ~F.struct(*names).eqNullSafe(F.col("_old"))).drop("_old")
    return children.join(p.select(parent_key), parent_key, "left_semi")


# -- events as text ------------------------------------------------------------


def to_events(changes: DataFrame, src: str) -> DataFrame:
    """NDJSON lines: kind, src, ver, key, ad, cursor."""
    skip = ("kind", "seq", "key", *META)
    ad = F.struct(*(F.col(c) for c in changes.columns if c not in skip))
    row = F.struct(
        F.col("kind"), F.lit(src).alias("src"), F.col("seq").alias("ver"), F.col("key"), F.when(F.col("kind") == "upsert", ad).alias("ad"), F.col("seq").cast("string").alias("cursor")
    )
    return changes.select(F.to_json(row).alias("value"))


def from_events(lines: DataFrame, attrs: str) -> DataFrame:
    schema = f"kind string, src string, ver bigint, key string, ad struct<{attrs}>, cursor string"
    return lines.select(F.from_json("value", schema).alias("e")).select("e.kind", "e.src", F.col("e.ver").alias("seq"), "e.key", "e.cursor", "e.ad.*")


class TableSink:
    """Last write wins by (src, key); events at or before the source's cursor are dropped, so a replay changes nothing."""

    def __init__(self, table: Table, src: str):
        self.table, self.src, self.mark = table, src, f"{table.path}.cursor/{src}"

    def cursor(self) -> int:
        raw = read_text(self.table.spark, self.mark)
        return json.loads(raw) if raw else -1

    def apply(self, changes: DataFrame) -> None:
        fresh = coalesce(changes.where(F.col("seq") > self.cursor()))
        head = fresh.agg(F.max("seq")).first()[0]
        if head is None:
            return
        ups = fresh.where("kind = 'upsert'")
        downs = fresh.where("kind = 'delete'")
        if not ups.isEmpty():
            self.table.put(ups.drop("kind", "seq", "src", "cursor"))
        if not downs.isEmpty():
            self.table.delete(downs)
        write_text(self.table.spark, self.mark, json.dumps(head))


class ArchiveSink:
    """Appends upserts; deletes are ignored; events at or before the source's cursor are not appended again.

    What is about to be written is noted first, and each batch has a folder of
    its own, so an append that broke off is done anew in its place.
    """

    def __init__(self, spark: SparkSession, path: str, src: str):
        self.spark, self.path, self.src, self.mark = spark, path, src, f"{path}.cursor/{src}"

    def apply(self, changes: DataFrame) -> None:
        raw = read_text(self.spark, self.mark)
        note = json.loads(raw) if raw else {"after": -1, "head": -1, "done": True}
        if not note["done"]:
            self._write(changes, note["after"], note["head"])
        after = note["head"]
        head = changes.agg(F.max("seq")).first()[0]
        if head is not None and head > after:
            self._write(changes, after, head)

    def _write(self, changes: DataFrame, after: int, head: int) -> None:
        note = {"after": after, "head": head, "done": False}
        write_text(self.spark, self.mark, json.dumps(note))
        ups = changes.where((F.col("kind") == "upsert") & (F.col("seq") > after) & (F.col("seq") <= head))
        ups.drop("kind").write.mode("overwrite").parquet(f"{self.path}/source={self.src}/upto={head}")
        write_text(self.spark, self.mark, json.dumps(note | {"done": True}))


class AckRegistry:
    """Subscribers' acknowledged times with leases; the floor is the least over live ones."""

    def __init__(self, spark: SparkSession, path: str, lease: int = 3600):
        self.spark, self.path, self.lease = spark, path, lease
        raw = read_text(spark, path) if path_exists(spark, path) else None
        self.acks = json.loads(raw) if raw else {}

    def _save(self) -> None:
        write_text(self.spark, self.path, json.dumps(self.acks))

    def ack(self, table: str, sub: str, at: int, now: int) -> None:
        own = self.acks.setdefault(table, {})
        own[sub] = [max(at, own.get(sub, [at])[0]), now + self.lease]
        self._save()

    def renew(self, table: str, sub: str, now: int) -> bool:
        own = self.acks.get(table, {}).get(sub)
        if own is None:
            return False
        own[1] = now + self.lease
        self._save()
        return True

    def floor(self, table: str, now: int) -> int | None:
        live = [a for a, until in self.acks.get(table, {}).values() if until >= now]
        return min(live) if live else None

    def evict(self, now: int) -> int:
        n = 0
        for own in self.acks.values():
            for sub in [s for s, (_, until) in own.items() if until < now]:
                del own[sub]
                n += 1
        self._save()
        return n
