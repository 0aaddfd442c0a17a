"""Version logs, transactions, archives, catalogs, sources and the greedy claim."""

import pytest
from pyspark.sql import functions as F

from adspark.operators import chain, match, order, scan
from adspark.operators.aggregate import Agg, Group, aggregate
from adspark.operators.versions import SYSTEM, Archive, Catalog, Table
from adspark.sources import ads
from adspark.sources.files import path_exists


class Clock:
    def __init__(self):
        self.now = 100

    def __call__(self):
        return self.now


@pytest.fixture
def jobs(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/jobs", "key string, owner string, status bigint", Clock())


def rows(spark, *data):
    return spark.createDataFrame(list(data), "key string, owner string, status bigint")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, jobs):
    jobs.put(rows(spark, ("a", "alice", 1), ("b", "bob", 1)))
    jobs.clock.now = 200
    jobs.put(rows(spark, ("a", "alice", 2)))
    assert got(jobs.query("status == 1").select("key")) == [("b",)]
    assert got(jobs.query("status == 1", as_of=150).select("key")) == [("a",), ("b",)]
    assert jobs.delete_where('owner == "BOB"') == 1 and len(jobs) == 1
    assert got(jobs.get("a")) == [("a", "alice", 2)] and got(jobs.keys()) == [("a",)]
    jobs.set_attribute("a", "status", 7)
    assert got(jobs.project({"s": "status + 1"})) == [(8,)]
    jobs.put(rows(spark, (SYSTEM + "x", None, 0)))
    assert len(jobs) == 1 and jobs.scan(system=True).count() == 1
    before = got(jobs.scan())
    jobs.compact()
    assert got(jobs.scan()) == before
    jobs.truncate()
    assert len(jobs) == 0


def test_transactions(spark, jobs):
    jobs.put(rows(spark, ("a", "x", 1), ("b", "x", 1), ("c", "x", 1)))
    t = jobs.begin()
    t.put(rows(spark, ("a", "t", 5), ("d", "t", 5)))
    t.delete(rows(spark, ("b", None, None)))
    assert got(t.query("status == 5").select("key")) == [("a",), ("d",)] and t.scan().count() == 3
    jobs.put(rows(spark, ("a", "other", 9)))
    assert t.commit("tx1") == ["a"]
    assert got(jobs.scan()) == [("a", "other", 9), ("c", "x", 1), ("d", "t", 5)]
    assert t.commit("tx1") == [] and len(jobs) == 3


def test_put_of_repeated_keys(spark, jobs):
    twice = spark.createDataFrame([("a", "x", 1, 7), ("a", "x", 2, 9), ("a", "x", 3, 8)], "key string, owner string, status bigint, at int")
    with pytest.raises(ValueError):
        jobs.put(twice)
    jobs.put(twice, order="at")
    assert got(jobs.scan()) == [("a", "x", 2)]


def test_commit_is_one_batch(spark, jobs):
    """Writes, deletes and the mark have one sequence number, so a commit that broke off left nothing, and one that did not is not repeated."""
    jobs.put(rows(spark, ("a", "x", 1), ("b", "x", 1)))
    t, again = jobs.begin(), jobs.begin()
    for x in (t, again):
        x.put(rows(spark, ("c", "x", 2)))
        x.delete(rows(spark, ("a", None, None)))
    assert t.commit("once") == [] and again.commit("once") == []
    assert got(jobs.scan()) == [("b", "x", 1), ("c", "x", 2)] and jobs.seq() == 2
    assert jobs.log().where("seq = 2").count() == 3 and jobs.scan(system=True).count() == 1
    jobs.compact()
    assert jobs.begin().commit("once") == [] and got(jobs.scan()) == [("b", "x", 1), ("c", "x", 2)]


def test_archive(spark, tmp_path):
    a = Archive(spark, f"file://{tmp_path}/arch", "done", width=100)
    a.append(spark.createDataFrame([(i, 10 * i) for i in range(40)], "id bigint, done bigint"))
    a.append(spark.createDataFrame([(99, 395)], "id bigint, done bigint"))
    assert a.query("id > 30", 1).first()["id"] == 99 and a.count("done < 100") == 10
    assert a.rotate(now=400, max_age=150) == [0, 1] and a.count() == 21
    assert a.rotate(now=400, floor=300, min_age=200) == []
    assert a.rotate(now=400, max_parts=1) == [2]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    t = c.create_table("jobs", "key string, owner string, status bigint")
    t.put(rows(spark, ("a", "x", 1)))
    c.create_archive("hist", "done")
    c.create_exporter("out", {"to": "there"})
    c.save_exporter_state("out", "s1")
    with pytest.raises(ValueError):
        c.create_table("../bad", "key string")
    with pytest.raises(ValueError):
        c.create_table("jobs", "key string")
    c.snapshot(f"file://{tmp_path}/snap")
    other = Catalog(spark, f"file://{tmp_path}/cat2")
    other.restore(f"file://{tmp_path}/snap")
    assert other.names("table") == ["jobs"] and got(other.table("jobs").scan()) == [("a", "x", 1)] and other.exporter("out")["state"] == "s1"
    c.drop("jobs")
    assert c.names("table") == [] and not path_exists(spark, f"file://{tmp_path}/cat/tables/jobs")


def test_text_sources(spark, tmp_path):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "a.ad").write_text("[JobId = 1; Owner = \"x\"]\n[JobId = 2; Owner = \"y\"; R = TARGET.m > JobId]\n")
    (tmp_path / "new" / "b.ad").write_text("[JobId = ")
    df = ads.read_new(spark, f"file://{tmp_path}/new")
    assert df.where("error IS NOT NULL").count() == 1
    good = df.where("error IS NULL").select("index", "ad")
    typed = ads.shred(good)
    assert got(typed.select("jobid", "owner")) == [(1, "x"), (2, "y")]
    assert typed.where("jobid = 2").first()["_expr"] == {"r": "TARGET.m > JobId"}
    assert got(scan.raw_projected(good, ["R"], follow=True).select(F.size("ad"))) == [(0,), (2,)]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "m").write_text('Name = "a"\nCpus = 4\nClaimId = "s"\n\n   \nName = "b"\nCpus = 2 * 4\n')
    old = ads.read_old(spark, f"file://{tmp_path}/old").select("index", "ad")
    assert [r["text"] for r in ads.render(old, "new").orderBy("index").collect()] == ['[Name = "a"; Cpus = 4]', '[Name = "b"; Cpus = 2 * 4]']
    as_json = ads.render(old, "json")
    assert as_json.orderBy("index").collect()[1]["text"] == '{"Name": "b", "Cpus": "\\/Expr(2 * 4)\\/"}'
    back = ads.parse_json_column(as_json, "text")
    assert got(ads.render(back, "old").select("text"))[1] == ('Name = "b"\nCpus = 2 * 4\n',)


def test_private(spark):
    for bad in ("CLAIMID == 1", "MY.TransferKey =?= 1", "_condor_privX > 1", "[a = 1].Capability == 1", "eval(x) == 1"):
        with pytest.raises(scan.PrivateName):
            scan.check_public(bad)
    scan.check_public("Memory > 1 && TARGET.Owner == \"x\"")


def test_match_fixture(spark):
    slots = spark.createDataFrame(
        [(1, 4096, "X86", 2, "TARGET.RequestMemory <= Memory"), (2, 512, "X86", 8, "TARGET.RequestMemory <= Memory"), (3, 8192, "ARM", 16, "false"), (4, 8192, "x86", 4, "TARGET.RequestMemory <= Memory")],
        "id int, memory int, arch string, cpus int, requirements string",
    )
    job = spark.createDataFrame([(7, 1024, 'TARGET.Arch == "X86" && TARGET.Memory >= RequestMemory')], "job int, requestmemory int, requirements string")
    m = match.match_by_text(job, slots, rank="TARGET.Cpus")
    assert sorted(r[0] for r in m.select("r_id").collect()) == [1, 4]
    assert [r["r_id"] for r in match.best(m, ["l_job"], 1, ["r_id"]).collect()] == [4]
    with pytest.raises(ValueError):
        match.match_by_text(job, slots, most=1)


def test_match_uses_keys(spark):
    a = spark.range(100).selectExpr("id AS k", "id AS v")
    plan = match.explain_match(a, a, "TARGET.k == k && TARGET.v > v - 1", "true")
    assert plan["equi"]


def test_greedy(spark):
    pairs = spark.createDataFrame([(1, "big", 3.0), (1, "small", 1.0), (2, "big", 5.0), (2, "small", None), (3, "big", 9.0)], "req int, res string, rank double")
    out = match.greedy(pairs, "req", "res", [], spark.createDataFrame([(1,), (2,), (3,), (4,)], "req int"))
    assert sorted((r["req"], r["res"]) for r in out.collect()) == [(1, "big"), (2, "small"), (3, None), (4, None)]


def test_family(spark):
    t = spark.createDataFrame(
        [("1.-1", None, True, "alice", "run", None, ["owner", "cmd"]), ("1.0", "1.-1", False, None, None, 0, ["proc"]), ("1.1", "1.-1", False, None, "own", 1, ["proc", "cmd", "owner"]), ("2.0", "2.-1", False, None, None, 0, [])],
        "key string, parent string, structural boolean, owner string, cmd string, proc int, present array<string>",
    )
    assert got(chain.family_view(t.drop("present")).select("key", "owner", "cmd")) == [("1.0", "alice", "run"), ("1.1", "alice", "own"), ("2.0", None, None)]
    parents = t.where("structural").select("key", "owner", "cmd")
    out = chain.inherit(t.where("NOT structural"), parents, "parent", "key", present="present")
    assert got(out.select("key", "owner"))[:2] == [("1.0", "alice"), ("1.1", None)]


def test_ordered_resume(spark):
    q = spark.createDataFrame([("alice", 1, 5, 10, 1), ("alice", 1, 9, 20, 2), ("alice", 2, 9, 5, 3), ("bob", 1, None, 1, 4), ("alice", 1, 9, 10, 5)], "owner string, status int, prio int, qdate int, n int")
    spec = order.OrderSpec("status == 1", "owner", (("prio", True), ("qdate", False)), "n")
    walk = [r.asDict() for r in order.ordered(q, spec, "alice").collect()]
    assert [r["n"] for r in walk] == [5, 2, 1]
    assert [r["n"] for r in order.ordered(q, spec, "alice", walk[0]).collect()] == [2, 1]


def test_aggregate_rules(spark):
    df = spark.createDataFrame([("a", 4, 4.0, "x"), ("a", 8, 1.5, None), (None, None, None, "y"), ("undefined", 2, None, None)], "g string, n int, x double, s string")
    out = aggregate(df, ["g"], [Agg("COUNT", name="c"), Agg("SUM", "n", name="sum"), Agg("AVG", "x", name="avg"), Agg("MIN", "s", name="low"), Agg("COUNT DISTINCT", "s", name="d")])
    assert {r["g"]: (r["c"], r["sum"], r["avg"], r["d"]) for r in out.collect()} == {"a": (2, 12, 2.75, 1), "undefined": (2, 2, 0.0, 1)}
    assert got(aggregate(df, [Group("n", 4, "b")], [Agg("COUNT", name="c")])) == [(0, 1), (4, 1), (8, 1)]
    with pytest.raises(ValueError):
        aggregate(df, [], [Agg("COUNT DISTINCT")])


def test_top_k_skips_what_is_no_number(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, 7.0, "c")], "id int, v double, s string")
    assert [r["id"] for r in order.top_k(df, ["id"], "v", 5).collect()] == [3, 1]
    assert order.top_k(df, ["id"], "s", 5).count() == 0 and order.top_k(df, ["id"], "v", 0).count() == 0


def test_fallback_filter(spark):
    df = spark.createDataFrame([("1.10",), ("1.9",), (None,)], "v string")
    assert [r["v"] for r in scan.where(df, 'versionGT(v, "1.9")').collect()] == ["1.10"]


def test_callback_stops(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "key string, n bigint", lambda: 0)
    t.put(spark.createDataFrame([(str(i), i) for i in range(9)], "key string, n bigint"))
    t.delete(spark.createDataFrame([("3",)], "key string"))
    seen = []
    assert t.for_each(lambda k, row: seen.append((k, row["n"]))) == 8 and sorted(seen) == [(str(i), i) for i in range(9) if i != 3]
    assert t.for_each(lambda k, row: False) == 1 and t.for_each(lambda k, row: True, upto=1) == 9


def test_wire_batches(spark):
    from adspark.operators import scan

    ads = spark.createDataFrame([(i, {"A": str(i), "ClaimId": '"x"'}) for i in range(10)], "k bigint, ad map<string, string>").coalesce(1)
    got = scan.raw_batches(ads, ["a", "claimid"], rows=4).collect()
    assert [r["rows"] for r in got] == [4, 4, 2]
    assert [x for r in got for x in scan.read_wire(r["wire"]).to_pylist()] == [{"k": i, "ad": [("A", str(i))]} for i in range(10)]
    assert scan.raw_batches(ads.limit(0), ["a"]).count() == 0


def test_typed_reads(spark):
    from adspark.operators import scan

    df = spark.createDataFrame([(1, 1.5, "x", True), (None, None, None, None)], "i bigint, r double, s string, b boolean")
    want = {"int": ("i", 1), "real": ("r", 1.5), "string": ("s", "x"), "bool": ("b", True)}
    for kind, (own, value) in want.items():
        for form in ("{}", "eval(\"{}\")"):
            got = scan.typed(df, {c: (form.format(c), kind) for c in "irsb"}).collect()
            assert [got[0][c] for c in "irsb"] == [value if c == own else None for c in "irsb"] and not any(got[1])
    got = scan.typed(df, {"a": ("i", "number", 9), "b": ("r", "number", 9), "c": ("s", "number", 9), "d": ("i / 0", "int", 4)}).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.5, 9.0, 4), (9.0, 9.0, 9.0, 4)]


def test_greedy_limit(spark):
    from adspark.operators.match import greedy

    pairs = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (3, "b", 5.0), (3, "a", 4.0), (4, "c", 1.0)], "o int, r string, rank double")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "o int")
    got = lambda **kw: sorted((x["o"], x["r"]) for x in greedy(pairs, "o", "r", [], **kw).collect())
    assert got(requests=asked, limit=3) == [(1, "b"), (2, None), (3, "a")] and got(limit=2) == [(1, "b"), (3, "a")]
    assert got(requests=asked) == [(1, "b"), (2, None), (3, "a"), (4, "c")]


def test_greedy_by_stretches(spark, monkeypatch):
    """Stretches of few pairs give what a walk gives, and no pair of a taken resource is made again."""
    import random

    rng = random.Random(4)
    asked = [(i, rng.randrange(3), rng.randrange(50)) for i in range(200)] + [(None, 1, 0)]
    offers = [(i, rng.randrange(3), rng.randrange(60)) for i in range(90)] + [(None, 1, 99)]
    a, b = spark.createDataFrame(asked, "o long, k int, least int"), spark.createDataFrame(offers, "r long, k int, size int")
    want, taken = {}, set()
    for o, k, least in asked[:-1]:
        free = [(-s, r) for r, kk, s in offers[:-1] if kk == k and s >= least and r not in taken]
        want[o] = min(free)[1] if free else None
        taken.add(want[o])
    pairs = match.match(a, b, "TARGET.k == k && TARGET.size >= least", "true", "TARGET.size").selectExpr("l_o AS o", "r_r AS r", "rank")
    sizes = []
    keep = match._settled
    monkeypatch.setattr(match, "_settled", lambda df: sizes.append(df) or keep(df))
    monkeypatch.setattr(match, "PAIRS", 1500)
    monkeypatch.setattr(match, "REQUESTS", 64)
    out = match.greedy(pairs, "o", "r", [], a)
    assert {x["o"]: x["r"] for x in out.collect()} == want | {None: None}
    assert len(sizes) > 2
