"""Bilateral matching: two records match when each one's requirements hold with the other as target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.syntax import parse_expr
from ..plans.compile import Compiler, Typed, plain_arithmetic, scope_of, true_of
from .scan import where

L, R = "l_", "r_"


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    rename = lambda df, p: df.select(*(F.col(f"`{c}`").alias(p + c) for c in df.columns))
    return rename(left, L), rename(right, R)


def _compilers(a: DataFrame, b: DataFrame, left_exprs: dict | None = None, right_exprs: dict | None = None) -> tuple[Compiler, Compiler]:
    ls, rs = scope_of(a, L), scope_of(b, R)
    le, re_ = ({k.lower(): parse_expr(v) for k, v in (x or {}).items()} for x in (left_exprs, right_exprs))
    return Compiler(ls, rs, None, le, re_), Compiler(rs, ls, None, re_, le)


def _number(x: Typed) -> Column:
    """A rank: integers and reals count, anything else is no rank."""
    return x.v.cast("double") if x.kind in "ir" else F.lit(None).cast("double")


def match(
    left: DataFrame, right: DataFrame, requirements: str, other_requirements: str, rank: str | None = None, only: str = "", left_exprs: dict | None = None, right_exprs: dict | None = None
) -> DataFrame:
    """All pairs whose requirements are boolean true on both sides; columns are prefixed ``l_`` and ``r_``, with ``rank``.

    Equalities between the sides become join keys; ranges stay as the join's
    residual. The optimizer picks the join, and broadcasts only what it has
    measured as small.
    """
    a, b = _sides(left, where(right, only))
    with plain_arithmetic(left.sparkSession):
        ca, cb = _compilers(a, b, left_exprs, right_exprs)
        cond = true_of(ca.compile(requirements)) & true_of(cb.compile(other_requirements))
        out = a.join(b, cond)
        return out.withColumn("rank", _number(ca.compile(rank)) if rank else F.lit(None).cast("double"))


def best(matches: DataFrame, by: list[str], k: int, tie: list[str]) -> DataFrame:
    """The k best of each left record; unranked pairs last, ties by key."""
    w = Window.partitionBy(*by).orderBy(F.col("rank").desc_nulls_last(), *tie)
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def match_by_text(left: DataFrame, right: DataFrame, column: str = "requirements", rank: str | None = None, most: int = 64) -> DataFrame:
    """Matching where each row has its own requirements text: one join per pair of distinct texts.

    The texts are few in practice (rows share them); more than ``most`` on a
    side is refused rather than run as that many joins.
    """
    texts = []
    for df in (left, right):
        got = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
        if len(got) > most:
            raise ValueError(f"more than {most} different texts")
        texts.append(sorted(got))
    out = None
    for s in texts[0]:
        for t in texts[1]:
            part = match(left.where(F.col(column) == s).drop(column), right.where(F.col(column) == t).drop(column), s, t, rank)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else match(left.limit(0).drop(column), right.limit(0).drop(column), "false", "false", rank)


#: A stretch of greedy assignment has so many pairs at most, unless one request has more; the first tries so many requests.
PAIRS, REQUESTS = 4_000_000, 32_768


def _settled(df: DataFrame) -> DataFrame:
    """``df`` worked out now, in the checkpoint folder where there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def greedy(matches: DataFrame, order: str, resource: str, keep: list[str], requests: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Requests in order each take their best resource that is still free.

    Sequential by definition, so it goes by stretches of the order: a stretch's
    pairs with resources that earlier ones left free stream, sorted, through one
    task that remembers the resources taken. Both conditions are on one side of
    a join, so the optimizer moves them below the matching and pairs of taken
    resources are never made. A null request or resource takes no part.
    ``requests`` (with the order column) adds a row with an empty resource for those that get none.
    ``limit``: only the first so many requests, those without a match among them.
    """
    if limit is not None:
        asked = matches if requests is None else requests
        first = asked.select(order).distinct().orderBy(order).limit(limit)
        matches = matches.join(first, order, "left_semi")
        requests = None if requests is None else first
    cols = list(dict.fromkeys([order, resource, "rank", *keep]))
    o, r = F.col(f"`{order}`"), F.col(f"`{resource}`")
    pairs = matches.select(*cols).where(o.isNotNull() & r.isNotNull())

    def claim(batches):
        taken: set = set()
        done = object()
        last = done
        for pdf in batches:
            rows = []
            for i, (o, r) in enumerate(zip(pdf[order].tolist(), pdf[resource].tolist())):
                if o == last or r in taken:
                    continue
                last = o
                taken.add(r)
                rows.append(i)
            yield pdf.iloc[rows]

    asked = _settled((pairs if requests is None else requests.where(o.isNotNull())).select(order).distinct())
    got, after, many = None, None, REQUESTS
    while True:
        rest = asked if after is None else asked.where(o > F.lit(after))
        n, upto = rest.orderBy(o).limit(many).agg(F.count(F.lit(1)), F.max(o)).first()
        last = n < many  # what lies behind the last request known is in the last stretch
        part = pairs if after is None else pairs.where(o > F.lit(after))
        part = part if last else part.where(o <= F.lit(upto))
        if got is not None:
            part = part.join(got.select(r.alias("_taken")), r == F.col("_taken"), "left_anti")
        size = part.count()
        if size > PAIRS and n > 1:
            many = max(1, min(n // 2, n * PAIRS // size))
            continue
        if size:
            new = _settled(part.repartition(1).sortWithinPartitions(o, F.col("rank").desc_nulls_last(), r).mapInPandas(claim, part.schema))
            got = new if got is None else got.unionByName(new)
        if last:
            break
        after = upto
        many = max(1, min(16 * many, many * PAIRS // max(size, 1)))
    if got is None:
        got = pairs.limit(0)
    if requests is None:
        return got
    return requests.select(order).distinct().join(got, order, "left")


def explain_match(left: DataFrame, right: DataFrame, requirements: str, other_requirements: str) -> dict:
    """Which join the optimizer chose and on which keys."""
    plan = match(left, right, requirements, other_requirements)._jdf.queryExecution().executedPlan().toString()
    joins = [line.strip() for line in plan.splitlines() if "Join" in line]
    return {"joins": joins, "equi": any("NestedLoop" not in j and "Cartesian" not in j for j in joins), "plan": plan}



