"""Queries over the test tables, one or more for each operator, and their SQL.

Keys start with the operator's id in the survey. Every query runs over its
whole tables; limits appear only where they are the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chain, match as matching, order, scan, versions
from .operators.aggregate import Agg, Group, aggregate, numeric_stats, presence
from .plans.compile import unix_time
from .sources.files import scratch_path
from .streaming import views, watch

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def projection(name: str, table: str, attrs: dict[str, tuple[str, str]], constraint: str = "", condition: str = "") -> None:
    """A query of evaluated expressions, beside the SQL of each."""

    @query(name, f"SELECT {', '.join(f'{s} AS {n}' for n, (_, s) in attrs.items())} FROM {table}" + (f" WHERE {condition}" if condition else ""))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.project(_load(spark, sf_dir, table), {n: e for n, (e, _) in attrs.items()}, constraint)


# -- flagship ------------------------------------------------------------------


@query(
    "pivot_orders",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (lower(o_orderstatus) = 'f') AS n_f, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS largest
    FROM orders WHERE o_totalprice > 50000 AND lower(o_orderstatus) <> 'p' GROUP BY 1""",
)
def pivot_orders(spark, d):
    out = aggregate(
        _load(spark, d, "orders"), ["o_orderpriority"],
        [Agg("COUNT", name="n"), Agg("COUNT", only='o_orderstatus == "F"', name="n_f"), Agg("SUM", "o_totalprice", name="total"), Agg("MAX", "o_totalprice", name="largest")],
        'o_totalprice > 1000 * 50 && o_orderstatus != "P"',
    )
    return out.withColumn("total", F.round("total", 2))


# -- scans and sources ---------------------------------------------------------


@query("S1_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1(spark, d):
    return scan.where(_load(spark, d, "nation"))


@query("S2_constraint_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 AND lower(o_orderstatus) <> 'p'")
def s2(spark, d):
    return scan.where(_load(spark, d, "orders"), 'o_totalprice > 1000*50 && o_orderstatus != "p"').select("o_orderkey", "o_totalprice")


@query("S3_redacted_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def s3(spark, d):
    secret = _load(spark, d, "customer").withColumn("ClaimId", F.concat(F.lit("x"), F.col("c_custkey")))
    return scan.where(scan.redacted(secret), "c_acctbal > 0 && ClaimId is undefined").select("c_custkey", "c_name")


@query("S4_newest_first", "SELECT event_id, user_id FROM events WHERE value > 10 ORDER BY event_id DESC LIMIT 100")
def s4(spark, d):
    return scan.where(_load(spark, d, "events"), "value > 10").orderBy(F.desc("event_id")).limit(100).select("event_id", "user_id")


@query("S5_projected_scan", "SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE l_discount >= 0.05")
def s5(spark, d):
    return scan.project(_load(spark, d, "lineitem"), {"l_orderkey": "l_orderkey", "twice": "l_quantity * 2"}, "l_discount >= 0.05")


def _part_ads(spark, d):
    """Parts as records of expression texts, one of which refers to others."""
    p = _load(spark, d, "part")
    return p.select(
        "p_partkey",
        F.create_map(
            F.lit("Price"), F.lit("Base + Extra"), F.lit("Base"), F.col("p_size").cast("string"), F.lit("Extra"), F.lit("Base * 2"), F.lit("Brand"), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')),
            F.lit("ClaimId"), F.lit('"secret"'),
        ).alias("ad"),
    )


@query("S6_raw_projected", "SELECT p_partkey, 'Base + Extra' AS price, CAST(NULL AS VARCHAR) AS claim FROM part")
def s6(spark, d):
    return scan.raw_projected(_part_ads(spark, d), ["price", "claimid"]).select("p_partkey", F.col("ad")["Price"].alias("price"), F.col("ad")["ClaimId"].alias("claim"))


@query("S7_raw_projected_closure", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS base, 'Base * 2' AS extra, CAST(NULL AS VARCHAR) AS brand FROM part")
def s7(spark, d):
    out = scan.raw_projected(_part_ads(spark, d), ["Price"], follow=True)
    return out.select("p_partkey", *(F.col("ad")[n].alias(n.lower()) for n in ("Base", "Extra", "Brand")))


@query("S9_point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def s9(spark, d):
    return scan.where(_load(spark, d, "orders"), "o_orderkey == 7").select("o_orderkey", "o_custkey")


@query("S10_keys_where", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000")
def s10(spark, d):
    return scan.where(_load(spark, d, "supplier"), "s_acctbal < 5000").select("s_suppkey")


def _event_log(spark, d):
    e = _load(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), unix_time(F.col("ts")).alias("ts"), (F.col("event_type") == "purchase").alias("deleted"), "event_type", "value"
    )


_LOG = "(SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type = 'purchase' AS deleted, event_type, value FROM events)"


def _table(spark, rows: DataFrame, attrs: str) -> versions.Table:
    """A table in the shared folder with ``rows`` as its log: key and attributes, and what else of a log's columns they have."""
    t = versions.Table(spark, scratch_path(spark, "table"), f"key string, {attrs}", lambda: 0)
    given = {"seq": F.lit(1), "ts": F.lit(0), "deleted": F.lit(False)}
    rows = rows.withColumns({c: v for c, v in given.items() if c not in rows.columns})
    rows.select(*(F.col(f.name).cast(f.dataType) for f in t.schema)).write.parquet(t.path)
    return t


@query(
    "S11_as_of",
    f"""SELECT key, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG}
    WHERE ts <= (SELECT CAST(avg(CAST(floor(epoch(ts)) AS BIGINT)) AS BIGINT) FROM events)) WHERE rn = 1 AND NOT deleted""",
)
def s11(spark, d):
    log = _event_log(spark, d)
    mid = log.agg(F.round(F.avg("ts")).cast("bigint")).first()[0]
    return versions.visible(log, upto=mid, by="ts").select("key", "event_type", "value")


@query(
    "S12_txn_scan",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'O' UNION ALL
    SELECT o_orderkey, 'O' FROM orders WHERE o_orderkey % 6 = 0""",
)
def s12(spark, d):
    """A transaction's own reads: keys divisible by 3 are written, half of them deleted."""
    base = _load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderkey", "o_orderstatus")
    txn = _table(spark, base, "o_orderkey bigint, o_orderstatus string").begin()
    txn.delete(scan.where(base, "o_orderkey % 3 == 0"))
    txn.put(scan.where(base, "o_orderkey % 6 == 0").withColumn("o_orderstatus", F.lit("O")))
    return txn.query('o_orderstatus == "o"').select("o_orderkey", "o_orderstatus")


@query("S15_count", "SELECT count(*) AS n FROM lineitem")
def s15(spark, d):
    return aggregate(_load(spark, d, "lineitem"), [], [Agg("COUNT", name="n")])


@query("S16_count_constraint", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_shipdate IS NOT NULL")
def s16(spark, d):
    return aggregate(_load(spark, d, "lineitem"), [], [Agg("COUNT", name="n")], "l_quantity > 25 && l_shipdate isnt undefined")


def _props(spark, d):
    return _load(spark, d, "events").withColumn("props", F.from_json("props", "struct<k:bigint>"))


@query("S19_json_source", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def s19(spark, d):
    return scan.project(_props(spark, d), {"event_id": "event_id", "k": "props.k"}, "props.k >= 50")


@query("S20_old_text_round_trip", "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS size1, p_brand AS brand FROM part")
def s20(spark, d):
    from .sources import ads

    p = _load(spark, d, "part")
    text = F.concat(F.lit("Size = "), F.col("p_size").cast("string"), F.lit("\nBrand = \""), F.col("p_brand"), F.lit("\"\nNext = Size + 1\n"))
    shredded = ads.shred(ads.parse_old_column(p.select(F.col("p_partkey"), text.alias("t")), "t"), {"size": "bigint", "brand": "string"})
    return scan.project(shredded, {"p_partkey": "p_partkey", "size1": "size + 1", "brand": "brand"})


@query("S31_raw_text_redacted", """SELECT p_partkey, '[Price = Base + Extra; Base = ' || p_size || '; Extra = Base * 2; Brand = "' || p_brand || '"]' AS text FROM part""")
def s31(spark, d):
    from .sources import ads

    return ads.render(_part_ads(spark, d), "new")


# -- expressions ---------------------------------------------------------------

_D = "CAST({} AS DOUBLE)"
projection("E1_attribute_ref", "customer", {"k": ("C_CustKey", "c_custkey"), "m": ("MY.c_mktsegment", "c_mktsegment"), "u": ("nosuch is undefined", "true")})
projection(
    "E2_to_E4_arithmetic", "lineitem",
    {"a": ("l_orderkey + l_linenumber", "l_orderkey + l_linenumber"), "b": ("l_orderkey - l_partkey * 3", "l_orderkey - l_partkey * 3"), "c": ("l_extendedprice * (1 - l_discount)", "l_extendedprice * (1 - l_discount)")},
)
projection(
    "E5_E6_division", "lineitem",
    {"q": ("-l_orderkey / 7", "(-l_orderkey) // 7"), "r": ("-l_orderkey % 7", "(-l_orderkey) % 7"), "x": ("l_extendedprice / l_quantity", "l_extendedprice / l_quantity"),
     "z": ("isError(l_orderkey / (l_linenumber - 1))", "l_linenumber = 1"), "v": ("l_orderkey / (l_linenumber - 1)", "CASE WHEN l_linenumber <> 1 THEN l_orderkey // (l_linenumber - 1) END")},
)
projection("E7_E8_unary", "lineitem", {"a": ("-l_partkey", "-l_partkey"), "b": ("!(l_quantity > 10)", "NOT (l_quantity > 10)"), "c": ("!(l_linenumber - 1)", "(l_linenumber - 1) = 0"), "d": ("+l_tax", "l_tax")})
projection(
    "E9_to_E13_bits", "lineitem",
    {"a": ("~l_orderkey", "~l_orderkey"), "b": ("l_orderkey & 12", "l_orderkey & 12"), "c": ("l_orderkey | 3", "l_orderkey | 3"), "d": ("l_orderkey ^ l_partkey", "xor(l_orderkey, l_partkey)"),
     "e": ("l_orderkey << 2", "l_orderkey * 4"), "f": ("l_orderkey >> 2", "l_orderkey // 4"), "g": ("-8 >> (l_linenumber * 100)", "CAST(-1 AS BIGINT)"), "h": ("l_orderkey >>> 1", "l_orderkey // 2")},
)
projection(
    "E14_E15_comparison", "orders",
    {"a": ("o_totalprice >= 100000", "o_totalprice >= 100000"), "b": ('o_orderpriority < "2-high"', "lower(o_orderpriority) < '2-high'"), "c": ('o_orderstatus == "f"', "lower(o_orderstatus) = 'f'"),
     "d": ("o_custkey != o_orderkey", "o_custkey <> o_orderkey"), "e": ("isError(o_orderstatus < 3)", "true")},
)
projection(
    "E16_E17_identity", "orders",
    {"a": ('o_orderstatus =?= "f"', "o_orderstatus = 'f'"), "b": ("o_custkey is 1.0", "false"), "c": ("nosuch isnt undefined", "false"), "d": ("o_custkey =!= 3", "o_custkey <> 3")},
)
projection(
    "E18_E19_logic", "lineitem",
    {"a": ("l_quantity > 20 && nosuch", "CASE WHEN l_quantity > 20 THEN CAST(NULL AS BOOLEAN) ELSE false END"), "b": ("l_quantity > 20 || nosuch", "CASE WHEN l_quantity > 20 THEN true END"),
     "c": ("isError((l_orderkey / (l_linenumber - 1) > 0) || true)", "l_linenumber = 1"), "d": ("l_linenumber == 1 || l_orderkey / (l_linenumber - 1) > 5", "CASE WHEN l_linenumber = 1 THEN true ELSE l_orderkey // (l_linenumber - 1) > 5 END")},
)
projection(
    "E20_E21_conditional", "lineitem",
    {"a": ('l_quantity > 25 ? "many" : "few"', "CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END"), "b": ("nosuch ?: l_linenumber", "CAST(l_linenumber AS BIGINT)"), "c": ("(l_linenumber - 1) ? 1 : 0", "CAST(l_linenumber <> 1 AS BIGINT)")},
)
projection("E22_E25_lists", "embeddings", {"vec_id": ("vec_id", "vec_id"), "first": ("embedding[0]", "CAST(embedding[1] AS DOUBLE)"), "bad": ("isError(embedding[64])", "len(embedding) <= 64"), "second": ("{label, 5}[1]", "CAST(5 AS BIGINT)")})


@query("E24_select", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS missing FROM events")
def e24(spark, d):
    return scan.project(_props(spark, d), {"event_id": "event_id", "k": "props.K", "missing": "props.k is undefined"})


projection("E27_where_true", "labels", {"doc_id": ("doc_id", "doc_id")}, "quality", "false")
projection("E27_where_undefined", "orders", {"o_orderkey": ("o_orderkey", "o_orderkey")}, "o_totalprice > 1e5 || nosuch == 3", "o_totalprice > 100000")


@query("E31_match_none", "SELECT o_orderkey FROM orders WHERE false")
def e31(spark, d):
    return scan.where(_load(spark, d, "orders"), "1 > 2 && true").select("o_orderkey")


@query("E30_flatten", "SELECT p_partkey, CAST(p_size * 3 AS BIGINT) AS price FROM part")
def e30(spark, d):
    from .lang.fold import flatten
    from .lang.syntax import parse_ad, parse_expr, unparse

    ad = parse_ad("[Factor = 1 + 1; Price = Base + Base * Factor]")
    return scan.project(_load(spark, d, "part").withColumnRenamed("p_size", "Base"), {"p_partkey": "p_partkey", "price": unparse(flatten(ad, parse_expr("Price")))})


# -- aggregates ----------------------------------------------------------------


@query("A1_A3_group_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def a1(spark, d):
    return aggregate(_load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [Agg("COUNT", name="n")])


@query("A2_buckets", "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1")
def a2(spark, d):
    return aggregate(_load(spark, d, "events"), [Group("ts", 3600, "hour")], [Agg("COUNT", name="n")])


@query("A4_count_defined", "SELECT d.lang, count(l.quality) AS rated, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def a4(spark, d):
    docs = _load(spark, d, "documents").select("doc_id", "lang").join(_load(spark, d, "labels"), "doc_id", "left")
    return aggregate(docs, ["lang"], [Agg("COUNT", "quality", name="rated"), Agg("COUNT", name="n")])


@query(
    "A5_A6_A7_sum_avg_min_max",
    """SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_extendedprice), 1) AS price, round(avg(l_quantity), 6) AS qty, min(l_tax) AS low, max(l_discount) AS high
    FROM lineitem GROUP BY 1""",
)
def a5(spark, d):
    out = aggregate(
        _load(spark, d, "lineitem"), ["l_returnflag"],
        [Agg("SUM", "l_linenumber", name="lines"), Agg("SUM", "l_extendedprice", name="price"), Agg("AVG", "l_quantity", name="qty"), Agg("MIN", "l_tax", name="low"), Agg("MAX", "l_discount", name="high")],
    )
    return out.withColumns({"price": F.round("price", 1), "qty": F.round("qty", 6)})


@query("A7_error_aggregate", "SELECT o_orderstatus, CAST(NULL AS BIGINT) AS low FROM orders GROUP BY 1")
def a7(spark, d):
    return aggregate(_load(spark, d, "orders"), ["o_orderstatus"], [Agg("MIN", "o_orderpriority", name="low")])


@query("A8_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def a8(spark, d):
    return aggregate(_load(spark, d, "lineitem"), ["l_returnflag"], [Agg("COUNT DISTINCT", "l_suppkey", name="suppliers")])


@query(
    "A9_filtered_aggregates",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS o, count(*) FILTER (o_totalprice > 1e9) AS none FROM orders GROUP BY 1",
)
def a9(spark, d):
    out = aggregate(
        _load(spark, d, "orders"), ["o_orderpriority"],
        [Agg("COUNT", only='o_orderstatus == "f"', name="f"), Agg("SUM", "o_totalprice", 'o_orderstatus == "o"', "o"), Agg("COUNT", only="o_totalprice > 1e9", name="none")],
    )
    return out.withColumn("o", F.round("o", 2))


@query("A10_global_empty", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, CAST(0 AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS low")
def a10(spark, d):
    return aggregate(
        _load(spark, d, "lineitem"), [], [Agg("COUNT", name="n"), Agg("SUM", "l_orderkey", name="total"), Agg("AVG", "l_quantity", name="mean"), Agg("MIN", "l_tax", name="low")], "l_quantity < 0"
    )


@query("A11_numeric_stats", "SELECT count(s_acctbal) AS n, round(sum(s_acctbal), 2) AS total, min(s_acctbal) AS least, max(s_acctbal) AS largest FROM supplier WHERE s_nationkey > 5")
def a11(spark, d):
    return numeric_stats(_load(spark, d, "supplier"), "s_acctbal", "s_nationkey > 5").withColumn("total", F.round("total", 2))


@query("A12_group_stats", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total, min(l_quantity) AS least, max(l_quantity) AS largest FROM lineitem GROUP BY 1")
def a12(spark, d):
    return numeric_stats(_load(spark, d, "lineitem"), "l_quantity", group="l_linenumber").withColumn("total", F.round("total", 2))


@query("A13_category_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a13(spark, d):
    return aggregate(_load(spark, d, "events"), ["event_type"], [Agg("COUNT", name="n")])


@query("A14_category_buckets", "SELECT event_type, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def a14(spark, d):
    return aggregate(_load(spark, d, "events"), ["event_type", Group("ts", 86400, "day")], [Agg("COUNT", name="n")])


@query("A15_category_counts_ranges", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_extendedprice > 1000 GROUP BY 1")
def a15(spark, d):
    return aggregate(_load(spark, d, "lineitem"), ["l_returnflag"], [Agg("COUNT", name="n")], "l_quantity >= 10 && l_quantity < 30 && l_extendedprice > 1000")


projection(
    "A16_list_aggregates", "embeddings",
    {"vec_id": ("vec_id", "vec_id"), "low": ("min(embedding)", "CAST(list_min(embedding) AS DOUBLE)"), "high": ("max(embedding)", "CAST(list_max(embedding) AS DOUBLE)"), "none": ("sum({})", "CAST(0 AS BIGINT)")},
)


@query("A18_presence", "SELECT count(l.quality) AS defined, count(*) - count(l.quality) AS undefined, CAST(0 AS BIGINT) AS error FROM documents d LEFT JOIN labels l USING (doc_id)")
def a18(spark, d):
    return presence(_load(spark, d, "documents").select("doc_id").join(_load(spark, d, "labels"), "doc_id", "left"), "quality")


# -- order ---------------------------------------------------------------------


@query("O1_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def o1(spark, d):
    df = _load(spark, d, "lineitem").withColumn("tie", F.struct("l_orderkey", "l_linenumber"))
    return order.top_k(df, ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_extendedprice", 10, tie="tie").withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("O2_limit", "SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 50)")
def o2(spark, d):
    return _load(spark, d, "orders").limit(50).agg(F.count(F.lit(1)).alias("n"))


_QUEUE = order.OrderSpec('o_orderstatus == "O"', "o_custkey", (("o_orderpriority", False), ("o_totalprice", True)), "o_orderkey")


@query(
    "O3_ordered_walk",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'""",
)
def o3(spark, d):
    from pyspark.sql import Window

    walk = order.ordered(_load(spark, d, "orders"), _QUEUE)
    w = Window.partitionBy("_part").orderBy("_kind0", "_key0", F.desc("_kind1"), F.desc("_key1"), "_seq")
    return walk.withColumn("place", F.row_number().over(w).cast("bigint")).select("o_custkey", "o_orderkey", "place")


@query(
    "O4_resume",
    """SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rn FROM orders
    WHERE o_orderstatus = 'O' AND o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'O')) WHERE rn > 1""",
)
def o4(spark, d):
    orders = _load(spark, d, "orders")
    first = order.ordered(orders, _QUEUE).limit(1).collect()[0].asDict()
    return order.ordered(orders, _QUEUE, first["_part"], first).select("o_orderkey")


@query("O5_signature", "SELECT count(*) AS groups FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def o5(spark, d):
    orders = _load(spark, d, "orders")
    return orders.select(order.fnv1a(orders, ["o_orderstatus", "o_orderpriority"]).alias("sig")).agg(F.count_distinct("sig").alias("groups"))


@query(
    "O6_run_lengths",
    """SELECT o_custkey, CAST(run AS BIGINT) AS run, o_orderstatus, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM
    (SELECT *, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 1 ELSE 0 END AS new FROM orders)) GROUP BY 1, 2, 3""",
)
def o6(spark, d):
    return order.run_lengths(_load(spark, d, "orders"), "o_custkey", ["o_orderkey"], "o_orderstatus")


@query("O8_last_version", f"SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG}) WHERE rn = 1 AND NOT deleted")
def o8(spark, d):
    return versions.visible(_event_log(spark, d)).select("key", "seq", "value")


# -- joins ---------------------------------------------------------------------

_NEED, _OFFER = "TARGET.s_nationkey == c_nationkey && TARGET.s_acctbal >= c_acctbal", "TARGET.c_acctbal > 0"
_PAIRS = "FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal >= c_acctbal AND c_acctbal > 0"


def _customer_supplier(spark, d, rank=None, only=""):
    return matching.match(_load(spark, d, "customer"), _load(spark, d, "supplier"), _NEED, _OFFER, rank, only)


@query("J1_match", f"SELECT c_custkey, s_suppkey {_PAIRS}")
def j1(spark, d):
    return _customer_supplier(spark, d).select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"))


@query("J2_ranked_match", f"SELECT c_custkey, s_suppkey, place FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_acctbal DESC, s_suppkey) AS place {_PAIRS}) WHERE place <= 3")
def j2(spark, d):
    out = matching.best(_customer_supplier(spark, d, "TARGET.s_acctbal"), ["l_c_custkey"], 3, ["r_s_suppkey"])
    return out.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), F.col("place").cast("bigint").alias("place"))


@query("J3_filtered_match", f"SELECT c_custkey, s_suppkey {_PAIRS} WHERE s_acctbal > 2000")
def j3(spark, d):
    return _customer_supplier(spark, d, only="s_acctbal > 2000").select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"))


@query(
    "J4_greedy_assignment",
    f"""WITH RECURSIVE pairs AS MATERIALIZED (SELECT c_custkey, s_suppkey, CAST(s_acctbal AS DOUBLE) AS rank {_PAIRS}),
    asked AS MATERIALIZED (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM (SELECT DISTINCT c_custkey FROM pairs)),
    walk AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS c_custkey, CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS DOUBLE) AS rank, CAST([] AS BIGINT[]) AS taken
      UNION ALL
      SELECT i, c_custkey, s_suppkey, rank, CASE WHEN s_suppkey IS NULL THEN taken ELSE list_append(taken, s_suppkey) END FROM (
        SELECT q.i AS i, q.c_custkey, first(p.s_suppkey ORDER BY p.rank DESC, p.s_suppkey) AS s_suppkey, first(p.rank ORDER BY p.rank DESC, p.s_suppkey) AS rank, w.taken
        FROM walk w JOIN asked q ON q.i = w.i + 1 LEFT JOIN pairs p ON p.c_custkey = q.c_custkey AND NOT list_contains(w.taken, p.s_suppkey) GROUP BY q.i, q.c_custkey, w.taken)
    ) SELECT c.c_custkey, w.s_suppkey, w.rank FROM customer c LEFT JOIN walk w USING (c_custkey)""",
)
def j4(spark, d):
    pairs = _customer_supplier(spark, d, "TARGET.s_acctbal").select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), "rank")
    return matching.greedy(pairs, "c_custkey", "s_suppkey", [], _load(spark, d, "customer"))


@query("J5_inherit", "SELECT c_custkey, c_name, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j5(spark, d):
    out = chain.inherit(_load(spark, d, "customer"), _load(spark, d, "nation"), "c_nationkey", "n_nationkey")
    return out.select("c_custkey", "c_name", "n_name", "n_regionkey")


@query("J6_anti_merge", "SELECT p_partkey, p_size FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_size <= 25")
def j6(spark, d):
    """A transaction's buffered rows stand before those of the snapshot."""
    base = _load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_partkey", "p_size")
    txn = _table(spark, base, "p_partkey bigint, p_size int").begin()
    txn.put(scan.where(base, "p_size <= 25").withColumn("p_size", F.lit(0)))
    return txn.scan().select("p_partkey", "p_size")


@query("J7_equi_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def j7(spark, d):
    m = matching.match(scan.where(_load(spark, d, "orders"), "o_totalprice > 200000"), _load(spark, d, "customer"), "TARGET.c_custkey == o_custkey", "true")
    return m.select(F.col("l_o_orderkey").alias("o_orderkey"), F.col("r_c_name").alias("c_name"))


# -- functions -----------------------------------------------------------------

projection(
    "F1_strings", "part",
    {"cat": ('strcat(p_brand, "-", p_size)', "p_brand || '-' || p_size"), "sub": ("substr(p_brand, 5)", "substr(p_brand, 6)"), "neg": ("substr(p_name, -3)", "right(p_name, 3)"), "mid": ("substr(p_type, 1, 3)", "substr(p_type, 2, 3)"),
     "n": ("size(p_name)", "CAST(strlen(p_name) AS BIGINT)"), "up": ("toUpper(p_name)", "upper(p_name)"), "low": ("toLower(p_type)", "lower(p_type)"), "c": ('strcmp(p_brand, "Brand#3")', "CAST(CASE WHEN p_brand < 'Brand#3' THEN -1 WHEN p_brand > 'Brand#3' THEN 1 ELSE 0 END AS BIGINT)"),
     "ci": ('stricmp(p_brand, "BRAND#3")', "CAST(CASE WHEN lower(p_brand) < 'brand#3' THEN -1 WHEN lower(p_brand) > 'brand#3' THEN 1 ELSE 0 END AS BIGINT)"), "s": ("string(p_size)", "CAST(p_size AS VARCHAR)")},
)
projection(
    "F2_regex", "part",
    {"a": ('regexp("#1[0-9]$", p_brand)', "regexp_matches(p_brand, '#1[0-9]$')"), "b": ('regexp("STEEL", p_type, "i")', "regexp_matches(p_type, 'STEEL', 'i')"), "c": ('regexps("([A-Z])", p_brand, "<$1>")', "regexp_replace(p_brand, '([A-Z])', '<\\1>', 'g')"),
     "d": ('replaceAll("[aeiou]", p_name, "_")', "regexp_replace(p_name, '[aeiou]', '_', 'g')"), "e": ('isError(regexp("(", p_name))', "true")},
)
projection(
    "F3_string_lists", "part",
    {"a": ('stringListMember("STEEL", p_type, " ")', "list_contains(string_split(p_type, ' '), 'STEEL')"), "b": ('stringListIMember("steel", p_type, " ")', "list_contains(string_split(lower(p_type), ' '), 'steel')"),
     "c": ('stringListSize(p_type, " ")', "CAST(len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS BIGINT)"), "d": ('stringListsIntersect(p_type, "PROMO TIN", " ")', "list_has_any(string_split(p_type, ' '), ['PROMO', 'TIN'])"),
     "e": ('stringListSubsetMatch("STEEL", p_type, " ")', "list_contains(string_split(p_type, ' '), 'STEEL')")},
)
projection(
    "F4_math", "supplier",
    {"f": ("floor(s_acctbal)", "CAST(floor(s_acctbal) AS BIGINT)"), "c": ("ceiling(s_acctbal)", "CAST(ceil(s_acctbal) AS BIGINT)"), "r": ("round(s_acctbal)", "CAST(round_even(s_acctbal, 0) AS BIGINT)"), "i": ("int(s_acctbal)", "CAST(trunc(s_acctbal) AS BIGINT)"),
     "x": ("real(s_suppkey)", "CAST(s_suppkey AS DOUBLE)"), "b": ("bool(s_nationkey)", "s_nationkey <> 0"), "p": ("pow(s_nationkey, 2)", "CAST(s_nationkey * s_nationkey AS BIGINT)"), "q": ("quantize(s_suppkey, 8)", "CAST((s_suppkey + 7) // 8 * 8 AS BIGINT)"),
     "e": ("isError(floor(nosuch))", "true")},
)
projection(
    "F5_type_tests", "supplier",
    {"a": ("isUndefined(nosuch)", "true"), "b": ("isError(s_name + 1)", "true"), "c": ("isString(s_name)", "true"), "d": ("isInteger(s_suppkey)", "true"), "e": ("isReal(s_acctbal)", "true"), "f": ("isBoolean(s_acctbal > 0)", "true"), "g": ("isList({1})", "true"), "h": ("isClassAd(s_name)", "false")},
)
projection(
    "F6_members", "customer",
    {"a": ('member(c_mktsegment, {"building", "MACHINERY"})', "lower(c_mktsegment) IN ('building', 'machinery')"), "b": ('identicalMember(c_mktsegment, {"building"})', "false"), "c": ('anyCompare("<", {1, 5, 9}, c_nationkey)', "c_nationkey > 1"), "d": ('allCompare(">=", {5, 9}, c_nationkey)', "c_nationkey <= 5")},
)
projection(
    "F7_conditional_time", "orders",
    {"a": ("ifThenElse(o_totalprice > 100000, o_custkey, -1)", "CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE -1 END"), "t": ('formatTime(o_orderdate, "%Y-%m-%d %H:%M:%S")', "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"), "n": ("interval(o_orderkey % 60)", "CAST(o_orderkey % 60 AS VARCHAR)")},
)


def evaluated_projection(name: str, table: str, attrs: dict[str, tuple[str, str, str]]) -> None:
    """Like ``projection``, of expressions that run in the evaluator: the kind (i, d, s or b) says which part of a value is meant."""

    @query(name, f"SELECT {', '.join(f'{s} AS {n}' for n, (_, _, s) in attrs.items())} FROM {table}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scan.project(_load(spark, sf_dir, table), {n: e for n, (e, _, _) in attrs.items()})
        kinds = dict(out.dtypes)
        part = lambda n, k: F.col(n)["i"] == 1 if k == "b" else F.col(n)[k]
        return out.select(*(part(n, k).alias(n) if kinds[n].startswith("struct") else F.col(n) for n, (_, k, _) in attrs.items()))


_N = "CAST(substr(p_brand, 7) AS BIGINT)"
evaluated_projection(
    "F8_versions", "part",
    {"p_partkey": ("p_partkey", "i", "p_partkey"), "c": ('versioncmp(p_brand, "Brand#9")', "i", f"CASE WHEN {_N} > 9 THEN CAST(1 AS BIGINT) ELSE {_N} - 9 END"), "ge": ('versionGE(p_brand, "Brand#12")', "b", f"{_N} >= 12"),
     "gt": ('versionGT(p_brand, "Brand#12")', "b", f"{_N} > 12"), "le": ('versionLE(p_brand, "Brand#4")', "b", f"{_N} <= 4"), "lt": ('versionLT(p_brand, "Brand#4")', "b", f"{_N} < 4"), "eq": ('versionEQ(p_brand, "Brand#21")', "b", f"{_N} = 21"),
     "within": ('version_in_range(p_brand, "Brand#11", "Brand#33")', "b", f"{_N} BETWEEN 11 AND 33")},
)
evaluated_projection(
    "F9_split_and_eval", "part",
    {"p_partkey": ("p_partkey", "i", "p_partkey"), "words": ("size(split(p_name))", "i", "CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS BIGINT)"),
     "joined": ('join("+", split(p_name))', "s", "array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '+')"), "dyn": ('eval("p_size * 2")', "i", "CAST(p_size * 2 AS BIGINT)"),
     "first": ('replace("[A-Z]+", p_type, "X")', "s", "regexp_replace(p_type, '[A-Z]+', 'X')")},
)
evaluated_projection(
    "F10_list_numbers", "part",
    {"p_partkey": ("p_partkey", "i", "p_partkey"), "total": ('stringListSum(strcat(p_size, ",", p_partkey))', "i", "CAST(p_size + p_partkey AS BIGINT)"), "mean": ('stringListAvg(strcat(p_size, ",", p_partkey))', "i", "CAST((p_size + p_partkey) // 2 AS BIGINT)"),
     "low": ('stringListMin(strcat(p_size, ",", p_partkey))', "i", "CAST(least(p_size, p_partkey) AS BIGINT)"), "high": ('stringListMax(strcat(p_size, ",", p_partkey))', "i", "CAST(greatest(p_size, p_partkey) AS BIGINT)"),
     "has": ('stringListRegexpMember("^ST", p_type, " ")', "b", "len(list_filter(string_split(p_type, ' '), lambda x: starts_with(x, 'ST'))) > 0"), "any": ('regexpMember("^brand#1", {"none", p_brand}, "i")', "b", "starts_with(p_brand, 'Brand#1')")},
)
evaluated_projection(
    "F11_records_and_names", "customer",
    {"c_custkey": ("c_custkey", "i", "c_custkey"), "user": ('splitUserName(strcat(c_name, "@", c_mktsegment))[0]', "s", "c_name"), "domain": ('splitUserName(strcat(c_name, "@", c_mktsegment))[1]', "s", "c_mktsegment"),
     "slot": ('splitSlotName(strcat("slot1@", c_name))[1]', "s", "c_name"), "hits": ("countMatches(x > 10, {[x = 5], [x = 20], [x = 30]})", "i", "CAST(2 AS BIGINT)"), "each": ("evalInEachContext(x * 2, {[x = 4], [x = 7]})[1]", "i", "CAST(14 AS BIGINT)"),
     "record": ("[a = 1; b = a + 2].b", "i", "CAST(3 AS BIGINT)"), "shown": ('unparse(c_custkey)', "s", "CAST(c_custkey AS VARCHAR)"), "now": ("time() > 1500000000", "b", "true"), "chance": ("random() < 1.0", "b", "true"),
     "up": ("ceil(c_acctbal)", "i", "CAST(ceil(c_acctbal) AS BIGINT)"), "mean": ("avg({c_custkey, c_nationkey})", "d", "(c_custkey + c_nationkey) / 2")},
)


projection("T3_list_predicates", "part", {"a": ('stringListsIntersect(p_type, "STEEL,BRASS", " ,")', "list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS'])")})


# -- streams -------------------------------------------------------------------


@query(
    "W3_filtered_watch",
    f"""SELECT key, seq, CASE WHEN hit THEN 'upsert' ELSE 'delete' END AS kind FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY key ORDER BY seq), false) AS was FROM
    (SELECT key, seq, value > 50 AND NOT deleted AS hit FROM {_LOG})) WHERE hit OR was""",
)
def w3(spark, d):
    return watch.filtered(_event_log(spark, d), "value > 50").select("key", "seq", "kind")


@query("W4_coalesced", f"SELECT key, max(seq) AS seq FROM {_LOG} WHERE seq > 100 GROUP BY 1")
def w4(spark, d):
    return watch.coalesce(watch.events(_event_log(spark, d), 100)).select("key", "seq")


@query("W5_fan_out", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def w5(spark, d):
    changed = scan.where(_load(spark, d, "nation"), "n_regionkey == 1").withColumnRenamed("n_nationkey", "key")
    return watch.fan_out(changed, _load(spark, d, "customer").withColumnRenamed("c_nationkey", "parent")).select("c_custkey")


@query(
    "W6_gauge_view",
    f"""SELECT event_type, count(*) AS count, coalesce(round(sum(value), 4), 0) AS sum FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG}) WHERE rn = 1 AND NOT deleted GROUP BY 1""",
)
def w6(spark, d):
    """Two batches of changes: the second replaces contributions of the first."""
    log = _event_log(spark, d)
    mid = log.agg(F.round(F.avg("seq")).cast("bigint")).first()[0]
    view = views.View(spark, scratch_path(spark, "view"), views.ViewSpec(groups=("event_type",), value="value"))
    for n, part in enumerate((log.where(F.col("seq") <= mid), log.where(F.col("seq") > mid))):
        view.apply(part.drop("ts"), n)
    return view.rows().select("event_type", "count", F.round("sum", 4).alias("sum"))


_CONT = views.ViewSpec(groups=("event_type",), value="value", time="ts", width=3600, grace=600, max_series=1 << 20)


def _hourly(spark, d):
    """The events as changes, their last time, and a view of them by the hour."""
    e = _load(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.lit(False).alias("deleted"), "event_type", "value", unix_time(F.col("ts")).alias("ts"))
    return rows, rows.agg(F.max("ts")).first()[0], views.View(spark, scratch_path(spark, "view"), _CONT)


@query(
    "W7_continuous_view",
    """SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS count, round(sum(value), 4) AS sum FROM events
    WHERE CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) <= (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) - 4200 GROUP BY 1, 2""",
)
def w7(spark, d):
    rows, now, view = _hourly(spark, d)
    view.apply(rows)
    view.seal(now)
    return view.sealed().select("event_type", "bucket", "count", F.round("sum", 4).alias("sum"))


@query("W8_late_rows", "SELECT count(*) AS late FROM events WHERE CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) <= (SELECT CAST(floor(min(epoch(ts)) / 3600) * 3600 AS BIGINT) + 7200 FROM events)")
def w8(spark, d):
    """The first three hours are sealed; then all rows come, theirs too late."""
    rows, _, view = _hourly(spark, d)
    edge = rows.agg(F.min("ts")).first()[0] // 3600 * 3600 + 3 * 3600
    view.apply(rows.where(F.col("ts") < edge))
    view.seal(edge + _CONT.grace)
    view.apply(rows)
    return spark.createDataFrame([(view.state["late"],)], "late bigint")


@query("T1_W10_live_and_sealed", "SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS count FROM events GROUP BY 1, 2")
def w10(spark, d):
    rows, now, view = _hourly(spark, d)
    view.apply(rows)
    view.seal(now)
    return view.rows().select("event_type", "bucket", "count")


@query("W11_events_round_trip", f"SELECT key, seq, CASE WHEN deleted THEN 'delete' ELSE 'upsert' END AS kind, CASE WHEN NOT deleted THEN event_type END AS event_type FROM {_LOG}")
def w11(spark, d):
    lines = watch.to_events(watch.events(_event_log(spark, d), -1), "src1")
    return watch.from_events(lines, "event_type string, value double").select("key", "seq", "kind", "event_type")


@query("P6_private_refused", "SELECT true AS refused, true AS allowed")
def p6(spark, d):
    def refused(text: str) -> bool:
        try:
            scan.check_public(text)
            return False
        except scan.PrivateName:
            return True

    tried = [refused(t) for t in ('ClaimId == "x"', "TARGET.Capability isnt undefined", 'eval("Claim" + "Id")')]
    return spark.createDataFrame([(all(tried), not refused("Memory > 3"))], "refused boolean, allowed boolean")


# -- writes, as the rows that they leave ---------------------------------------


def _written(spark, d):
    """The event log as a table, and a transaction begun on it before every user with a value over 90 is written and every one under 3 deleted."""
    t = _table(spark, _event_log(spark, d), "event_type string, value double")
    txn = t.begin()
    t.put(t.query("value > 90").withColumn("value", F.col("value") + 1000))
    t.delete_where("int(value) < 3")
    return t, txn


_VISIBLE = f"(SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {_LOG}) WHERE rn = 1 AND NOT deleted)"


@query("S21_S22_upsert_delete_where", f"SELECT key, CASE WHEN value > 90 THEN value + 1000 ELSE value END AS value FROM {_VISIBLE} WHERE trunc(value) >= 3")
def s21(spark, d):
    return _written(spark, d)[0].scan().select("key", "value")


@query("P2_conflicts", f"SELECT DISTINCT key FROM {_VISIBLE} WHERE value > 90 OR trunc(value) < 3")
def p2(spark, d):
    """Keys written after a transaction's snapshot: its writes to them are refused."""
    _, txn = _written(spark, d)
    txn.put(txn.scan())
    return spark.createDataFrame([(k,) for k in txn.commit()], "key string")


@query("P3_set_attribute", "SELECT p_partkey, CASE WHEN p_partkey = 5 THEN 77 ELSE p_size END AS p_size FROM part")
def p3(spark, d):
    t = _table(spark, _load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_partkey", "p_size"), "p_partkey bigint, p_size int")
    t.set_attribute("5", "p_size", 77)
    return t.scan().select("p_partkey", "p_size")


@query(
    "P1_retention",
    """SELECT CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day, count(*) AS n FROM events
    WHERE (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) - ((CAST(floor(epoch(ts)) AS BIGINT) // 86400 + 1) * 86400 - 1) <= 5 * 86400 GROUP BY 1""",
)
def p1(spark, d):
    """Whole days go when their newest possible row is five days old."""
    rows = _load(spark, d, "events").select(unix_time(F.col("ts")).alias("t"))
    kept = versions.Archive(spark, scratch_path(spark, "archive"), "t")
    kept.append(rows)
    kept.rotate(rows.agg(F.max("t")).first()[0], max_age=5 * 86400)
    return kept.rows().groupBy(F.col("_day").cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("S14_system_records", "SELECT key FROM (SELECT 'sys-' || n_name AS key, n_nationkey AS k FROM nation) WHERE k < 5")
def s14(spark, d):
    nation = _load(spark, d, "nation")
    keyed = nation.select(F.when(F.col("n_nationkey") < 5, F.concat(F.lit(versions.SYSTEM), F.col("n_name"))).otherwise(F.col("n_name")).alias("key"), "n_regionkey")
    own = _table(spark, keyed, "n_regionkey int").scan(system=True)
    return own.select(F.concat(F.lit("sys-"), F.substring(F.col("key"), len(versions.SYSTEM) + 1, 1000)).alias("key"))


@query("S17_S19_text_forms", "SELECT p_partkey, true AS new_form, true AS old_form, true AS json_form FROM part")
def s17(spark, d):
    """Each record written in every form and read back is the record."""
    from .sources import ads

    src = _part_ads(spark, d)
    public = F.map_filter("ad", lambda k, v: k != "ClaimId")
    want = src.select("p_partkey", F.to_json(public).alias("want"))
    out = want
    for form, parse in (("old", ads.parse_old_column), ("json", ads.parse_json_column)):
        back = parse(ads.render(src, form), "text").select("p_partkey", F.to_json("ad").alias(form))
        out = out.join(back, "p_partkey")
    new = ads._parsed(ads.render(src, "new"), "text", lambda t: ads.parse_ads(t)[0]).select("p_partkey", F.to_json("ad").alias("new"))
    same = lambda c: (F.col(c) == F.col("want")).alias(f"{c}_form")
    return out.join(new, "p_partkey").select("p_partkey", same("new"), same("old"), same("json"))


@query("E29_references", "SELECT 'Factor,TARGET.Memory' AS outside, 'Base' AS inside")
def e29(spark, d):
    from .lang.fold import external_refs, internal_refs
    from .lang.syntax import parse_ad, parse_expr

    ad, e = parse_ad("[Base = 2]"), parse_expr("Base * Factor + TARGET.Memory")
    return spark.createDataFrame([(",".join(external_refs(ad, e)), ",".join(internal_refs(ad, e)))], "outside string, inside string")


@query("E33_two_scopes", f"SELECT c_custkey, s_suppkey, s_acctbal - c_acctbal AS margin {_PAIRS}")
def e33(spark, d):
    out = _customer_supplier(spark, d, "TARGET.s_acctbal - MY.c_acctbal")
    return out.select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), F.col("rank").alias("margin"))


@query("E34_E35_text_and_equality", """SELECT true AS same_ads, true AS same_exprs, '"a\\"b"' AS quoted, '[A = 1; b = x + 2]' AS unparsed""")
def e34(spark, d):
    from .lang.syntax import ad_text, parse_ad, parse_expr, quote, same_ad, same_expr

    ads_ = same_ad(parse_ad("[A = 1; b = X + 2.0]"), parse_ad("[B = x + 2.0000000000001; a = 1]"))
    return spark.createDataFrame([(ads_, same_expr(parse_expr("foo(A)"), parse_expr("FOO(a)")), quote('a"b'), ad_text(parse_ad("[A = 1; b = x + 2]")))], "same_ads boolean, same_exprs boolean, quoted string, unparsed string")


@query("W1_W2_catch_up", f"SELECT key, max(seq) AS seq FROM {_LOG} WHERE seq > (SELECT CAST(round(avg(event_id)) AS BIGINT) FROM events) GROUP BY 1")
def w1(spark, d):
    """What a reader with a cursor in the middle gets: every later key once, at its last event."""
    log = _event_log(spark, d)
    cursor = log.agg(F.round(F.avg("seq")).cast("bigint")).first()[0]
    return watch.catch_up(_table(spark, log, "event_type string, value double"), cursor)[0].select("key", "seq")


# -- wire batches, callbacks, typed reads --------------------------------------


@query("S8_raw_wire", "SELECT p_partkey, 'Base + Extra' AS price, CAST(p_size AS VARCHAR) AS base, CAST(NULL AS VARCHAR) AS claim FROM part")
def s8(spark, d):
    """Raw records packed into wire batches and read back from them."""

    def unpack(batches):
        for b in batches:
            for wire in b.column("wire").to_pylist():
                yield from scan.read_wire(wire).to_batches()

    wires = scan.raw_batches(_part_ads(spark, d), ["price", "base", "claimid"], rows=100)
    back = wires.mapInArrow(unpack, "p_partkey bigint, ad map<string, string>")
    return back.select("p_partkey", F.col("ad")["Price"].alias("price"), F.col("ad")["Base"].alias("base"), F.col("ad")["ClaimId"].alias("claim"))


@query("S13_callback_scan", "SELECT n_name AS key, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def s13(spark, d):
    """What a callback over a table's rows was called with."""
    t = _table(spark, _load(spark, d, "nation").select(F.col("n_name").alias("key"), "n_regionkey"), "n_regionkey int")
    seen: list = []
    t.for_each(lambda key, row: seen.append((key, row["n_regionkey"])))
    return spark.createDataFrame(seen, "key string, region bigint")


@query(
    "E32_typed_reads",
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS size, CAST(NULL AS DOUBLE) AS real_size, CAST(p_size AS DOUBLE) AS number_size, CAST(-1 AS BIGINT) AS name_as_int, p_name AS name, p_size > 25 AS large,
    'none' AS missing, CAST(NULL AS BOOLEAN) AS size_as_bool, CAST(p_size * 2 AS BIGINT) AS dynamic, CAST(7 AS BIGINT) AS failed FROM part""",
)
def e32(spark, d):
    return scan.typed(
        _load(spark, d, "part"),
        {
            "p_partkey": ("p_partkey", "int"), "size": ("p_size", "int"), "real_size": ("p_size", "real"), "number_size": ("p_size", "number"), "name_as_int": ("p_name", "int", -1), "name": ("p_name", "string"),
            "large": ("p_size > 25", "bool"), "missing": ("nosuch", "string", "none"), "size_as_bool": ("p_size", "bool"), "dynamic": ('eval("p_size * 2")', "int", 0), "failed": ("p_size / 0", "int", 7),
        },
    )


# -- tables as a whole ---------------------------------------------------------


@query("S23_append", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s23(spark, d):
    """Two appends to an archive leave every row."""
    rows = _load(spark, d, "events").select("event_id", "event_type", unix_time(F.col("ts")).alias("t"))
    kept = versions.Archive(spark, scratch_path(spark, "archive"), "t")
    for part in ("event_id % 2 == 0", "event_id % 2 != 0"):
        kept.append(scan.where(rows, part))
    return aggregate(kept.rows(), ["event_type"], [Agg("COUNT", name="n")])


def _parts_table(spark, d):
    rows = _load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_partkey", "p_size")
    return rows, _table(spark, rows, "p_partkey bigint, p_size int")


@query("S24_truncate", "SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def s24(spark, d):
    rows, t = _parts_table(spark, d)
    t.truncate()
    t.put(scan.where(rows, "p_size > 25"))
    return t.scan().select("p_partkey", "p_size")


@query("S25_snapshot_restore", "SELECT p_partkey, p_size FROM part WHERE p_size <> 7")
def s25(spark, d):
    """A catalog's table as it was at the snapshot, whatever was written after it."""
    rows, _ = _parts_table(spark, d)
    cat = versions.Catalog(spark, scratch_path(spark, "catalog"))
    t = cat.create_table("parts", "key string, p_partkey bigint, p_size int")
    t.put(rows)
    t.delete_where("p_size == 7")
    at = scratch_path(spark, "snapshot")
    cat.snapshot(at)
    t.delete_where("p_size > 10")
    t.put(rows.limit(1).withColumn("p_size", F.lit(-1)))
    cat.restore(at)
    return cat.table("parts").scan().select("p_partkey", "p_size")


@query("S29_exporters", """SELECT 'out' AS name, '{"to": "there"}' AS config, 'at 7' AS state""")
def s29(spark, d):
    import json

    path = scratch_path(spark, "catalog")
    cat = versions.Catalog(spark, path)
    cat.create_exporter("out", {"to": "there"})
    cat.save_exporter_state("out", "at 7")
    e = versions.Catalog(spark, path).exporter("out")
    return spark.createDataFrame([("out", json.dumps(e["config"]), e["state"])], "name string, config string, state string")


@query("P4_commit_once", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS p_size, CAST(2 AS BIGINT) AS writes FROM part")
def p4(spark, d):
    """A commit tried again under the same ledger id writes nothing more."""
    _, t = _parts_table(spark, d)
    for _ in range(2):
        txn = t.begin()
        txn.put(txn.query("p_size > 25").withColumn("p_size", F.col("p_size") + 1))
        txn.commit("move-1")
    return t.scan().select("p_partkey", "p_size", F.lit(t.seq()).cast("bigint").alias("writes"))


# -- events as a reader gets them ----------------------------------------------


def _shifted(spark, d):
    """A table of parts and a cursor from before the large ones went and the small ones grew."""
    rows, t = _parts_table(spark, d)
    _, cursor = watch.watch(t)
    t.delete_where("p_size > 40")
    t.put(scan.where(rows, "p_size < 10").withColumn("p_size", F.col("p_size") + 100))
    return t, cursor


@query("W1_snapshot_events", "SELECT 'reset' AS kind, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS INT) AS p_size UNION ALL SELECT 'upsert', CAST(p_partkey AS VARCHAR), CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END FROM part WHERE p_size <= 40 UNION ALL SELECT 'synced', NULL, NULL")
def w1_snapshot(spark, d):
    """A truncated and refilled table is another generation, so the cursor does not fit and all rows come anew."""
    t, cursor = _shifted(spark, d)
    rows = t.scan()
    again = _table(spark, rows, "p_partkey bigint, p_size int")
    again._renew()
    return watch.watch(again, cursor)[0].select("kind", "key", "p_size")


@query("W1_delta_events", "SELECT 'delete' AS kind, CAST(p_partkey AS VARCHAR) AS key, CAST(NULL AS INT) AS p_size FROM part WHERE p_size > 40 UNION ALL SELECT 'upsert', CAST(p_partkey AS VARCHAR), p_size + 100 FROM part WHERE p_size < 10 UNION ALL SELECT 'synced', NULL, NULL")
def w1_delta(spark, d):
    t, cursor = _shifted(spark, d)
    return watch.watch(t, cursor)[0].select("kind", "key", "p_size")


@query("W2_live_and_resync", "SELECT 'delete' AS kind, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_size > 40 UNION ALL SELECT 'upsert', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 10 UNION ALL SELECT 'resync', NULL")
def w2(spark, d):
    """Live events after a cursor; once compaction has dropped tombstones that it had not seen, it must catch up again."""
    t, cursor = _shifted(spark, d)
    live = watch.poll(t, cursor)[0].select("kind", "key")
    copy = _table(spark, t.log(), "p_partkey bigint, p_size int")
    copy.compact()
    return live.unionByName(watch.poll(copy, cursor)[0].select("kind", "key"))


@query("W9_watermark_persists", "SELECT count(*) AS late, CAST(floor(min(epoch(ts)) / 3600) * 3600 AS BIGINT) + 7200 AS sealed_to FROM events WHERE CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) <= (SELECT CAST(floor(min(epoch(ts)) / 3600) * 3600 AS BIGINT) + 7200 FROM events)")
def w9(spark, d):
    """A view opened again goes on from its stored watermark: replayed rows of sealed buckets are dropped."""
    rows, _, view = _hourly(spark, d)
    edge = rows.agg(F.min("ts")).first()[0] // 3600 * 3600 + 3 * 3600
    view.apply(rows.where(F.col("ts") < edge), 0)
    view.seal(edge + _CONT.grace)
    again = views.View(spark, view.path, _CONT)
    again.apply(rows, 1)
    state = views.View(spark, view.path, _CONT).state
    return spark.createDataFrame([(state["late"], state["sealed_to"])], "late bigint, sealed_to bigint")


@query("W12_ack_floor", "SELECT r_name, (SELECT min(n_nationkey * 10) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey >= 10) AS floor FROM region")
def w12(spark, d):
    """Each nation acknowledges its region's table at its own time; at time 20, leases of 10 given before time 10 have run out."""
    acks = watch.AckRegistry(spark, scratch_path(spark, "acks"), lease=10)
    names = {r["r_regionkey"]: r["r_name"] for r in _load(spark, d, "region").collect()}
    for r in _load(spark, d, "nation").orderBy("n_nationkey").collect():
        acks.ack(names[r["n_regionkey"]], r["n_name"], r["n_nationkey"] * 10, r["n_nationkey"])
    return spark.createDataFrame([(n, acks.floor(n, 20)) for n in names.values()], "r_name string, floor bigint")


@query("S28_sinks", f"SELECT key, value, (SELECT count(*) FROM {_LOG} WHERE NOT deleted) AS archived FROM {_VISIBLE}")
def s28(spark, d):
    """A log streamed into both sinks, then given to them again."""
    t = _table(spark, _event_log(spark, d), "event_type string, value double")
    copy = versions.Table(spark, scratch_path(spark, "table"), "key string, event_type string, value double", lambda: 0)
    path = scratch_path(spark, "archive")
    sinks = watch.TableSink(copy, "s"), watch.ArchiveSink(spark, path, "s")

    def each(batch, n):
        for sink in sinks:
            sink.apply(watch.events(batch).drop("ts", "deleted"))

    watch.run_available(watch.stream(spark, t), each, scratch_path(spark, "stream"))
    each(t.log(), 1)
    return copy.scan().select("key", "value", F.lit(spark.read.parquet(path).count()).cast("bigint").alias("archived"))


@query("J4_limit", f"SELECT * FROM ({_SQL['J4_greedy_assignment']}) WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 20)")
def j4_limit(spark, d):
    pairs = _customer_supplier(spark, d, "TARGET.s_acctbal").select(F.col("l_c_custkey").alias("c_custkey"), F.col("r_s_suppkey").alias("s_suppkey"), "rank")
    return matching.greedy(pairs, "c_custkey", "s_suppkey", [], _load(spark, d, "customer"), limit=20)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
