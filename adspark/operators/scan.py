"""Constraint scans and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.fold import is_match_all, is_match_none, reads
from ..lang.syntax import is_private, parse_expr
from ..plans.compile import Compiler, Typed, Untyped, plain_arithmetic, scope_of, true_of
from ..plans.fallback import BOOL_TAG, INT_TAG, REAL_TAG, STRING_TAG, evaluated


class PrivateName(ValueError):
    """A constraint would read an attribute that the reader may not see."""


def check_public(*texts: str) -> None:
    """Refuse expressions that read a private name, or might at run time."""
    for t in texts:
        names, dynamic = reads(t)
        bad = sorted(n for n in names if is_private(n))
        if bad or dynamic:
            raise PrivateName(bad[0] if bad else "an expression made at run time")


def redacted(df: DataFrame) -> DataFrame:
    """Without the private attributes: their names read as undefined."""
    return df.drop(*(c for c in df.columns if is_private(c)))


def compile_over(df: DataFrame, text: str, now: int | None = None) -> Typed:
    return Compiler(scope_of(df), now=now).compile(text)


def where(df: DataFrame, constraint: str = "", now: int | None = None) -> DataFrame:
    """Rows for which the constraint is boolean true; an empty one keeps all."""
    if is_match_all(constraint):
        return df
    if is_match_none(constraint):
        return df.limit(0)
    with plain_arithmetic(df.sparkSession):
        try:
            return df.where(true_of(compile_over(df, constraint, now)))
        except Untyped:
            v = evaluated(df, constraint, now)
            return df.where((v["t"] == BOOL_TAG) & (v["i"] == 1))


def value_column(x: Typed) -> Column:
    return F.lit(None).cast("boolean") if x.v is None else x.v


def project(df: DataFrame, attrs: dict[str, str] | list[str], constraint: str = "", errors: bool = False, now: int | None = None) -> DataFrame:
    """Evaluated values of attributes or expressions by name; with ``errors``, a flag for each that may fail."""
    attrs = attrs if isinstance(attrs, dict) else {a: a for a in attrs}
    df = where(df, constraint, now)
    with plain_arithmetic(df.sparkSession):
        cols = []
        for name, text in attrs.items():
            try:
                x = compile_over(df, text, now)
                cols.append(value_column(x).alias(name))
                if errors:
                    cols.append((F.lit(x.err) if isinstance(x.err, bool) else x.err).alias(f"{name}_error"))
            except Untyped:
                cols.append(evaluated(df, text, now).alias(name))
        return df.select(*cols)


#: Spark types that hold a kind's values, by the kind's letter in the compiler.
_KINDS = {"int": "i", "real": "r", "number": "ir", "string": "s", "bool": "b"}
_TAGS = {"int": (INT_TAG,), "real": (REAL_TAG,), "number": (INT_TAG, REAL_TAG), "string": (STRING_TAG,), "bool": (BOOL_TAG,)}
_HOST = {"int": "bigint", "real": "double", "number": "double", "string": "string", "bool": "boolean"}


def typed(df: DataFrame, reads: dict[str, tuple], now: int | None = None) -> DataFrame:
    """Values read as one kind each: ``{name: (expression, kind[, default])}``.

    An int comes only from an integer, a real only from a real, a number from
    both, a string and a bool only from their own; anything else is the default,
    NULL where none is given.
    """
    with plain_arithmetic(df.sparkSession):
        cols = []
        for name, (text, kind, *default) in reads.items():
            host, other = _HOST[kind], F.lit(default[0] if default else None)
            try:
                x = compile_over(df, text, now)
                got = x.v.cast(host) if x.v is not None and x.kind and x.kind in _KINDS[kind] else F.lit(None)
                if x.err is not False and x.v is not None:
                    got = F.when(~(F.lit(x.err) if isinstance(x.err, bool) else x.err), got)
            except Untyped:
                v = evaluated(df, text, now)
                part = v["s"] if kind == "string" else v["i"] == 1 if kind == "bool" else v["d"] if kind == "real" else v["i"]
                if kind == "number":
                    part = F.coalesce(v["d"], v["i"].cast("double"))
                got = F.when(v["t"].isin(*_TAGS[kind]), part).cast(host)
            cols.append(F.coalesce(got.cast(host), other.cast(host)).alias(name))
        return df.select(*cols)


def for_each(df: DataFrame, f) -> int:
    """Call ``f(key, attributes)`` on rows with a ``key`` until it returns False; how many calls. The driver holds one partition at a time."""
    n = 0
    for row in df.toLocalIterator():
        n += 1
        d = row.asDict()
        if f(d.pop("key"), d) is False:
            break
    return n


def raw_batches(ads: DataFrame, names: list[str], follow: bool = False, redact: bool = True, rows: int = 1024) -> DataFrame:
    """``raw_projected`` rows packed into wire batches: (rows int, wire binary), a wire being an Arrow stream of ``rows`` rows at most."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, rows):
                part = b.slice(a, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows", "wire"])

    return raw_projected(ads, names, follow, redact).mapInArrow(run, "rows int, wire binary")


def read_wire(wire: bytes):
    """The Arrow table of a wire batch."""
    import pyarrow as pa

    return pa.ipc.open_stream(wire).read_all()


def explain(df: DataFrame, constraint: str) -> dict:
    """The compiled predicate's conjuncts, which of them reach the scan, and the physical plan."""
    kept = where(df, constraint)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = [line.split("PushedFilters:", 1)[1].strip() for line in plan.splitlines() if "PushedFilters:" in line]
    return {"reads": sorted(reads(constraint)[0]), "pushed": pushed, "python": "Python" in plan or "Arrow" in plan, "plan": plan}


def raw_projected(ads: DataFrame, names: list[str], follow: bool = False, redact: bool = True) -> DataFrame:
    """Unevaluated attribute texts of a frame with an ``ad`` map; ``follow`` adds what the texts refer to.

    The closure is worked out once per distinct set of texts in a batch.
    """
    import pyarrow as pa

    from ..lang.fold import closure

    keys = [c for c in ads.columns if c != "ad"]

    def run(batches):
        for b in batches:
            out = []
            for ad in b.column("ad").to_pylist():
                own = {k.lower(): (k, v) for k, v in ad or []}
                want = closure({k: parse_expr(v) for k, (_, v) in own.items()}, names) if follow else [n.lower() for n in names]
                out.append([own[n] for n in want if n in own and not (redact and is_private(n))])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.map_(pa.string(), pa.string()))], names=[*keys, "ad"])

    return ads.select(*keys, "ad").mapInArrow(run, ads.select(*keys, "ad").schema)
