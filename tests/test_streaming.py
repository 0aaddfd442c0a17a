"""Watches, sinks, acknowledgements and views."""

import pytest
from pyspark.sql import functions as F

from adspark.operators.versions import Table
from adspark.streaming import views, watch


def jobs(spark, path):
    return Table(spark, path, "key string, owner string, mem bigint, qdate bigint", lambda: 0)


def rows(spark, *data):
    return spark.createDataFrame(list(data), "key string, owner string, mem bigint, qdate bigint")


def test_catch_up_and_filter(spark, tmp_path):
    t = jobs(spark, f"file://{tmp_path}/t")
    t.put(rows(spark, ("a", "x", 1, 0), ("b", "x", 9, 0)))
    first, cursor = watch.catch_up(t)
    assert first.count() == 2 and cursor == 1
    t.put(rows(spark, ("a", "x", 5, 0)))
    t.put(rows(spark, ("a", "x", 7, 0)))
    t.delete(rows(spark, ("b", None, None, None)))
    more, cursor = watch.catch_up(t, cursor)
    assert sorted((r["key"], r["kind"], r["mem"]) for r in more.collect()) == [("a", "upsert", 7), ("b", "delete", None)] and cursor == 4
    assert watch.catch_up(t, 99)[0].count() == 1  # a cursor from elsewhere starts anew
    seen = watch.filtered(t.log(), "mem > 4 && mem < 6").select("key", "seq", "kind")
    assert sorted(tuple(r) for r in seen.collect()) == [("a", 2, "upsert"), ("a", 3, "delete")]


def test_stream_to_sinks(spark, tmp_path):
    t = jobs(spark, f"file://{tmp_path}/t")
    t.put(rows(spark, ("a", "x", 1, 0), ("b", "y", 2, 0)))
    copy = jobs(spark, f"file://{tmp_path}/copy")
    sink, arch = watch.TableSink(copy, "s"), watch.ArchiveSink(spark, f"file://{tmp_path}/arch", "s")

    def each(batch, n):
        e = watch.events(batch).drop("ts", "deleted")
        sink.apply(e)
        arch.apply(e)

    watch.run_available(watch.stream(spark, t), each, f"file://{tmp_path}/cp")
    t.put(rows(spark, ("a", "x", 8, 0)))
    t.delete(rows(spark, ("b", None, None, None)))
    watch.run_available(watch.stream(spark, t), each, f"file://{tmp_path}/cp")
    each(t.log(), 0)  # a replay changes nothing
    assert [(r["key"], r["mem"]) for r in copy.scan().collect()] == [("a", 8)]
    assert spark.read.parquet(f"{tmp_path}/arch").count() == 3


def test_archive_sink_after_a_crash(spark, tmp_path, monkeypatch):
    """An append whose last step never came is done anew in its place, also when more events have come since."""
    t = jobs(spark, f"file://{tmp_path}/t")
    t.put(rows(spark, ("a", "x", 1, 0), ("b", "y", 2, 0)))
    path = f"file://{tmp_path}/arch"
    changes = lambda: watch.events(t.log()).drop("ts", "deleted")
    write, calls = watch.write_text, []

    def once(spark, path, text):
        calls.append(text)
        if len(calls) == 2:
            raise OSError("gone")
        write(spark, path, text)

    monkeypatch.setattr(watch, "write_text", once)
    with pytest.raises(OSError):
        watch.ArchiveSink(spark, path, "s").apply(changes())
    t.put(rows(spark, ("a", "x", 5, 0)))
    watch.ArchiveSink(spark, path, "s").apply(changes())
    watch.ArchiveSink(spark, path, "s").apply(changes())
    assert sorted((r["key"], r["mem"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 5), ("b", 2)]


def test_fan_out(spark):
    before = spark.createDataFrame([("p", "x"), ("q", "y")], "key string, cmd string")
    after = spark.createDataFrame([("p", "z"), ("q", "y")], "key string, cmd string")
    kids = spark.createDataFrame([("1", "p"), ("2", "q")], "key string, parent string")
    assert [r["key"] for r in watch.fan_out(after, kids, before=before).collect()] == ["1"]
    assert watch.fan_out(after, kids).count() == 2


def test_acks(spark, tmp_path):
    r = watch.AckRegistry(spark, f"file://{tmp_path}/acks.json", lease=10)
    r.ack("t", "a", 5, 0)
    r.ack("t", "b", 3, 8)
    assert r.floor("t", 9) == 3 and r.floor("t", 15) == 3 and r.floor("u", 0) is None
    assert r.renew("t", "a", 15) and r.floor("t", 20) == 5 and r.evict(20) == 1
    assert watch.AckRegistry(spark, f"file://{tmp_path}/acks.json").acks["t"].keys() == {"a"}


def test_gauge_view(spark, tmp_path):
    v = views.View(spark, f"file://{tmp_path}/v", views.ViewSpec(groups=("owner",), value="mem", max_series=2))
    ch = lambda seq, *data: rows(spark, *data).withColumns({"seq": F.lit(seq), "deleted": F.lit(False)})
    v.apply(ch(1, ("a", "alice", 100, 0), ("b", "alice", 300, 0), ("c", "bob", 200, 0)), 0)
    v.apply(ch(1, ("a", "alice", 100, 0)), 0)  # the same batch again
    assert sorted(tuple(r) for r in v.rows().collect()) == [("alice", 2, 400.0, 200.0), ("bob", 1, 200.0, 200.0)]
    v.apply(ch(2, ("a", "bob", 50, 0)).unionByName(ch(3, ("b", None, None, None)).withColumn("deleted", F.lit(True))), 1)
    assert sorted(tuple(r) for r in v.rows().collect()) == [("bob", 2, 250.0, 125.0)]
    v.apply(ch(4, ("d", None, None, 0)), 2)
    assert {r["owner"] for r in v.rows().collect()} == {"bob", ""}
    with pytest.raises(views.TooManySeries):
        v.apply(ch(5, ("e", "carl", 1, 0)), 3)


def test_continuous_view(spark, tmp_path):
    spec = views.ViewSpec(groups=(), value="mem", time="qdate", width=3600)
    path = f"file://{tmp_path}/v"
    v = views.View(spark, path, spec)
    ch = lambda seq, *data: rows(spark, *data).withColumns({"seq": F.lit(seq), "deleted": F.lit(False)})
    v.apply(ch(1, ("a", "x", 1, 3600), ("b", "x", 2, 3700), ("c", "x", 3, 7200)))
    assert v.seal(7199) == 0 and v.seal(7200) == 1
    v = views.View(spark, path, spec)  # the watermark outlives the process
    v.apply(ch(2, ("late", "x", 9, 3650)))
    assert v.state["late"] == 1
    assert sorted((r["bucket"], r["count"]) for r in v.rows().collect()) == [(3600, 2), (7200, 1)]
    assert v.seal(10800) == 1 and v.sealed().count() == 2 and v.live().count() == 0
    assert v.seal(99999) == 0 and v.state["sealed_to"] == 7200


def test_view_spec():
    for bad in (dict(groups=()), dict(groups=("a",), time="t"), dict(groups=("a",), max_series=0)):
        with pytest.raises(ValueError):
            views.ViewSpec(**bad).check()


def test_watch_events(spark, tmp_path):
    """Reset and snapshot without a fitting cursor, deletes before upserts with one, resync once tombstones or the generation are gone."""
    t = jobs(spark, f"file://{tmp_path}/t")
    t.put(rows(spark, ("a", "x", 1, 0), ("b", "x", 9, 0)))
    kinds = lambda df: [(r["kind"], r["key"]) for r in df.collect()]
    first, cursor = watch.watch(t)
    got = kinds(first)
    assert got[0] == ("reset", None) and sorted(got[1:-1]) == [("upsert", "a"), ("upsert", "b")] and got[-1] == ("synced", None)
    assert [r["cursor"] for r in first.collect()] == [None] * 3 + [cursor]
    t.put(rows(spark, ("a", "x", 5, 0)))
    t.delete(rows(spark, ("b", None, None, None)))
    assert kinds(watch.watch(t, cursor)[0]) == [("delete", "b"), ("upsert", "a"), ("synced", None)]
    live, after = watch.poll(t, cursor)
    assert kinds(live) == [("upsert", "a"), ("delete", "b")]
    # an event's own cursor goes on behind it
    assert kinds(watch.poll(t, live.collect()[0]["cursor"])[0]) == [("delete", "b")]
    assert kinds(watch.poll(t, after)[0]) == [] and kinds(watch.watch(t, after)[0]) == [("synced", None)]
    t.compact()
    assert kinds(watch.poll(t, cursor)[0]) == [("resync", None)] and kinds(watch.watch(t, cursor)[0]) == [("reset", None), ("upsert", "a"), ("synced", None)]
    after = watch.watch(t)[1]
    t.truncate()
    t.put(rows(spark, ("c", "x", 1, 0)))
    assert kinds(watch.watch(t, after)[0]) == [("reset", None), ("upsert", "c"), ("synced", None)]
    t.truncate()
    assert kinds(watch.watch(t)[0]) == [("reset", None), ("synced", None)]
