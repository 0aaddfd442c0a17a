"""The expression compiler: a syntax tree becomes a value column and an error column.

A value is NULL where it is undefined or an error; the error column tells the
two apart, and is the plain ``False`` where no error can arise, which is nearly
everywhere, so that the value alone reaches Catalyst. Types are static: b, i,
r, s, a list of one of them, a record, or the undefined and error literals.
What has no static type raises ``Untyped``; the caller then takes the
evaluator over Arrow batches (``fallback``).

Columns are built under non-ANSI arithmetic (``plain_arithmetic``): integers
wrap and a bad cast is NULL, which the error column accounts for.
"""

from __future__ import annotations

import contextlib
import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.fold import fold
from ..lang.interp import MAX_INT, MIN_INT, arity_ok, pattern
from ..lang.syntax import ERROR, UNDEFINED, Binary, Call, Cond, Elvis, ListOf, Lit, RecordOf, Ref, Select, Subscript, Unary, parse_expr


class Untyped(Exception):
    """The expression has no static column form."""


class BadPattern(Exception):
    """A literal pattern that is an error wherever it meets a subject."""


@dataclass
class Typed:
    """kind: b i r s u e l R; item: the kind of a list's items, or a record's fields."""

    kind: str
    v: Column | None
    err: Column | bool = False
    item: object = None
    lit: object = None  # the literal's own value


INF = float("inf")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextlib.contextmanager
def plain_arithmetic(spark: SparkSession):
    """Columns analysed inside wrap and null instead of raising; the session's setting comes back."""
    key = "spark.sql.ansi.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


# -- schema --------------------------------------------------------------------


def unix_time(c: Column, wall: bool = True) -> Column:
    """Unix seconds of a timestamp; wall-clock times count as UTC in whatever zone the session has."""
    t = c.cast("timestamp")
    return F.unix_seconds(F.from_utc_timestamp(t, F.current_timezone()) if wall else t)


def typed_column(c: Column, kind: T.DataType) -> Typed | None:
    """A table's column as an attribute: integers widen, times become Unix seconds."""
    if isinstance(kind, T.BooleanType):
        return Typed("b", c)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return Typed("i", c.cast("bigint"))
    if isinstance(kind, T.LongType):
        return Typed("i", c)
    if isinstance(kind, (T.FloatType, T.DecimalType)):
        return Typed("r", c.cast("double"))
    if isinstance(kind, T.DoubleType):
        return Typed("r", c)
    if isinstance(kind, T.StringType):
        return Typed("s", c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Typed("i", unix_time(c, not isinstance(kind, T.TimestampType)))
    if isinstance(kind, T.ArrayType):
        own = typed_column(F.lit(None), kind.elementType)
        if own is None or own.kind in "lR":
            return None
        cast = {"i": "bigint", "r": "double", "b": "boolean", "s": "string"}[own.kind]
        return Typed("l", c.cast(f"array<{cast}>"), False, own.kind)
    if isinstance(kind, T.StructType):
        return Typed("R", c, False, {f.name.lower(): (f.name, f.dataType) for f in kind})
    return None


def scope_of(df: DataFrame, prefix: str = "", alias: str | None = None) -> dict[str, Typed]:
    """The attributes of a frame by folded name. ``prefix`` is left off names; ``alias`` qualifies columns."""
    out = {}
    for f in df.schema:
        if f.name.startswith(prefix):
            name = f"`{f.name}`" if alias is None else f"{alias}.`{f.name}`"
            t = typed_column(F.col(name), f.dataType)
            if t is not None:
                out[f.name[len(prefix) :].lower()] = t
    return out


# -- small helpers -------------------------------------------------------------


def _or(*errs):
    live = [e for e in errs if e is not False]
    if not live:
        return False
    out = live[0]
    for e in live[1:]:
        out = out | e
    return out


def _some(x: Typed) -> Column:
    return x.v.isNotNull() if x.v is not None else F.lit(False)


def _all_some(*xs: Typed) -> Column:
    out = _some(xs[0])
    for x in xs[1:]:
        out = out & _some(x)
    return out


def _null(kind: str) -> Column:
    return F.lit(None).cast({"b": "boolean", "i": "bigint", "r": "double", "s": "string", "u": "boolean", "e": "boolean"}[kind])


def _failed(*xs: Typed) -> Typed:
    """An error wherever no operand is undefined."""
    return Typed("b", _null("b"), _or(*(x.err for x in xs), _all_some(*xs)))


def _undefined(*xs: Typed) -> Typed:
    """Undefined, but for the operands' errors."""
    err = _or(*(x.err for x in xs))
    return Typed("u", None) if err is False else Typed("b", _null("b"), err)


E = Typed("e", None, True)
U = Typed("u", None)


def _lift(x: Typed) -> Typed:
    """Literal errors and undefineds as columns."""
    if x.kind == "e":
        return Typed("b", _null("b"), F.lit(True))
    if x.kind == "u":
        return Typed("b", _null("b"), x.err)
    return x


def as_int(x: Typed) -> Column:
    return x.v.cast("int").cast("bigint") if x.kind == "b" else x.v


def as_real(x: Typed) -> Column:
    return as_int(x).cast("double") if x.kind != "r" else x.v


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def truth(x: Typed) -> Typed:
    if x.kind in "ue" or x.kind == "b":
        return x
    if x.kind in "ir":
        v = x.v != F.lit(0)
        return Typed("b", v, x.err)
    return _failed(x)


_CAST = {"b": "boolean", "i": "bigint", "r": "double", "s": "string"}


def unify(a: Typed, b: Typed) -> tuple[str, object, Column, Column]:
    """One kind for two branches."""
    if a.kind in "ue":
        a = Typed(b.kind, F.lit(None).cast(_CAST.get(b.kind, "boolean")) if b.kind in _CAST else F.lit(None), a.err, b.item)
    if b.kind in "ue":
        b = Typed(a.kind, F.lit(None).cast(_CAST.get(a.kind, "boolean")) if a.kind in _CAST else F.lit(None), b.err, a.item)
    if a.kind in "ue":
        return "b", None, _null("b"), _null("b")
    if a.kind != b.kind or a.item != b.item:
        raise Untyped("branches of different types")
    return a.kind, a.item, a.v, b.v


def _err_col(e) -> Column:
    return F.lit(e) if isinstance(e, bool) else e


class Compiler:
    """Compiles expressions over attribute tables for this record, its match target and its parent."""

    def __init__(self, my: dict[str, Typed], target: dict[str, Typed] | None = None, parent: dict[str, Typed] | None = None, exprs: dict | None = None, target_exprs: dict | None = None, now: int | None = None):
        self.my, self.target, self.parent = my, target, parent
        self.exprs, self.target_exprs = exprs or {}, target_exprs or {}
        self.now = now if now is not None else int(time.time())
        self.busy: set = set()

    def compile(self, e) -> Typed:
        if isinstance(e, str):
            e = parse_expr(e)
        return self.expr(fold(e, None if "currenttime" in self.my else self.now))

    def predicate(self, e) -> Column:
        """True for rows where the expression is boolean true."""
        return true_of(self.compile(e))

    # -- references ------------------------------------------------------------

    def swapped(self) -> "Compiler":
        c = Compiler(self.target or {}, self.my, None, self.target_exprs, self.exprs, self.now)
        c.busy = self.busy
        return c

    def own(self, name: str) -> Typed | None:
        if name in self.exprs:
            key = (id(self.exprs), name)
            if key in self.busy:
                return E
            self.busy.add(key)
            try:
                return self.expr(self.exprs[name])
            finally:
                self.busy.discard(key)
        return self.my.get(name)

    def ref(self, r: Ref) -> Typed:
        name = r.name.lower()
        if r.scope == "target":
            return (self.swapped().own(name) if self.target is not None else None) or U
        if r.scope == "parent":
            return (self.parent or {}).get(name) or U
        got = self.own(name)
        if got is None and self.parent is not None:
            got = self.parent.get(name)
        if got is None and r.scope == "" and self.target is not None:
            got = self.swapped().own(name)
        return got or U

    # -- operators -------------------------------------------------------------

    def expr(self, e) -> Typed:
        if isinstance(e, Lit):
            return self.literal(e.value)
        if isinstance(e, Ref):
            return self.ref(e)
        if isinstance(e, Unary):
            return self.unary(e.op, self.expr(e.arg))
        if isinstance(e, Binary):
            a, b = self.expr(e.left), self.expr(e.right)
            if e.op in ("&&", "||"):
                return self.logic(e.op, a, b)
            if e.op in ("is", "isnt"):
                return self.identity(e.op, a, b)
            if e.op in "+-*/%":
                return self.arith(e.op, a, b)
            if e.op in ("<", "<=", ">", ">=", "==", "!="):
                return self.compare(e.op, a, b)
            return self.bits(e.op, a, b)
        if isinstance(e, Cond):
            return self.choose(self.expr(e.test), self.expr(e.yes), self.expr(e.no))
        if isinstance(e, Elvis):
            a, b = self.expr(e.left), self.expr(e.right)
            if a.kind == "u" and a.err is False:
                return b
            if a.kind == "e":
                return a
            kind, item, av, bv = unify(a, b)
            empty = av.isNull() if a.err is False else av.isNull() & ~a.err
            err = _or(a.err, False if b.err is False else empty & _err_col(b.err))
            return Typed(kind, F.coalesce(av, F.when(empty, bv)) if a.err is not False else F.coalesce(av, bv), err, item)
        if isinstance(e, ListOf):
            return self.list_of([self.expr(x) for x in e.items])
        if isinstance(e, RecordOf):
            raise Untyped("record literal")
        if isinstance(e, Select):
            return self.select(self.expr(e.record), e.name)
        if isinstance(e, Subscript):
            return self.subscript(self.expr(e.container), self.expr(e.index))
        if isinstance(e, Call):
            return self.call(e)
        raise Untyped(type(e).__name__)

    @staticmethod
    def literal(v) -> Typed:
        if v is UNDEFINED:
            return U
        if v is ERROR:
            return E
        kind = "b" if isinstance(v, bool) else "i" if isinstance(v, int) else "r" if isinstance(v, float) else "s"
        return Typed(kind, F.lit(v).cast(_CAST[kind]) if kind in "ir" else F.lit(v), False, None, v)

    @staticmethod
    def arith(op: str, a: Typed, b: Typed) -> Typed:
        if "e" in (a.kind, b.kind):
            return E
        if "u" in (a.kind, b.kind):
            return _undefined(a, b)
        if not (a.kind in "bir" and b.kind in "bir"):
            return _failed(a, b)
        err = _or(a.err, b.err)
        if op == "%":
            if "r" in (a.kind, b.kind):
                return _failed(a, b)
            x, y = as_int(a), as_int(b)
            bad = False if isinstance(b.lit, int) and b.lit else (y == 0) & x.isNotNull()
            v = F.when(y == -1, F.when(x.isNotNull(), F.lit(0).cast("bigint"))).when(y != 0, x % y) if not (isinstance(b.lit, int) and b.lit > 0) else x % y
            return Typed("i", v, _or(err, bad if bad is False else F.coalesce(bad, F.lit(False))))
        if "r" in (a.kind, b.kind):
            x, y = as_real(a), as_real(b)
            if op == "/":
                if isinstance(b.lit, (int, float)) and b.lit:
                    v = x / y
                else:
                    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.when((x > 0) == ~(y.cast("string").startswith("-")), F.lit(INF)).otherwise(F.lit(-INF)))
                    v = F.when(y == 0, F.when(x.isNotNull(), zero)).otherwise(x / y)
            else:
                v = x + y if op == "+" else x - y if op == "-" else x * y
            # a NaN compares as the largest number in Spark, so equality is what tells +Inf
            bad = F.coalesce(v == F.lit(INF), F.lit(False))
            return Typed("r", F.when(~bad, v), _or(err, bad))
        x, y = as_int(a), as_int(b)
        if op == "/":
            bad = False if isinstance(b.lit, int) and b.lit else F.coalesce((y == 0) & x.isNotNull(), F.lit(False))
            v = F.call_function("div", x, y)
            if not (isinstance(b.lit, int) and b.lit > 0):
                v = F.when((x == MIN_INT) & (y == -1), F.lit(MAX_INT)).when(y != 0, v)
            return Typed("i", v, _or(err, bad))
        return Typed("i", x + y if op == "+" else x - y if op == "-" else x * y, err)

    @staticmethod
    def bits(op: str, a: Typed, b: Typed) -> Typed:
        if "e" in (a.kind, b.kind):
            return E
        if "u" in (a.kind, b.kind):
            return _undefined(a, b)
        if a.kind != "i" or b.kind != "i":
            return _failed(a, b)
        x, y, err = a.v, b.v, _or(a.err, b.err)
        if op in "&|^":
            return Typed("i", {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y), err)
        shift = lambda name, p, n: F.call_function(name, p, n.cast("int"))
        low = y.bitwiseAND(F.lit(63).cast("bigint"))
        if op == "<<":
            return Typed("i", shift("shiftleft", x, low), err)
        if op == ">>":
            v = F.when(x >= 0, shift("shiftright", x, low)).when(y <= 0, x).otherwise(shift("shiftright", x, F.least(y, F.lit(63).cast("bigint"))))
        else:
            once = shift("shiftrightunsigned", x, F.lit(1))
            v = F.when(x >= 0, shift("shiftright", x, low)).otherwise(shift("shiftright", once, (y - 1).bitwiseAND(F.lit(63).cast("bigint"))))
        return Typed("i", F.when(x.isNotNull() & y.isNotNull(), v), err)

    @staticmethod
    def compare(op: str, a: Typed, b: Typed) -> Typed:
        if "e" in (a.kind, b.kind):
            return E
        if "u" in (a.kind, b.kind):
            return _undefined(a, b)
        err = _or(a.err, b.err)
        if a.kind in "bir" and b.kind in "bir":
            real = "r" in (a.kind, b.kind)
            # integers compare as doubles; with a small literal the exact comparison is the same and can be pushed down
            exact = not real and (op in ("==", "!=") or any(isinstance(x.lit, int) and abs(x.lit) < 1 << 53 for x in (a, b)))
            x, y = (as_int(a), as_int(b)) if exact else (as_real(a), as_real(b))
            v = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[op]
            for t, c in ((a, x), (b, y)):
                if t.kind == "r" and t.lit is None:
                    v = v | F.isnan(c) if op == "!=" else v & ~F.isnan(c)
            return Typed("b", v, err)
        if a.kind == b.kind == "s":
            x, y = (F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t.lit)) if isinstance(t.lit, str) else ascii_fold(t.v) for t in (a, b))
            return Typed("b", {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[op], err)
        return _failed(a, b)

    @staticmethod
    def identity(op: str, a: Typed, b: Typed) -> Typed:
        if a.kind in "lR" and a.kind == b.kind:
            raise Untyped("identity of lists")
        ea, eb = _err_col(a.err if a.kind != "e" else True), _err_col(b.err if b.kind != "e" else True)
        plain = a.err is False and b.err is False and "e" not in (a.kind, b.kind)
        na = a.v.isNull() if a.v is not None else F.lit(True)
        nb = b.v.isNull() if b.v is not None else F.lit(True)
        if a.kind == b.kind and a.kind in "birs":
            same = a.v.eqNullSafe(b.v)
            if a.kind == "r":
                same = same & ~F.coalesce(F.isnan(a.v), F.lit(False))
        elif a.kind == "u":
            same = nb
        elif b.kind == "u":
            same = na
        else:
            same = na & nb
        if not plain:
            same = same & (ea == eb)
        return Typed("b", same if op == "is" else ~same)

    @staticmethod
    def logic(op: str, a: Typed, b: Typed) -> Typed:
        a, b = truth(a), truth(b)
        if a.kind == "e":
            return E
        a, b = _lift(a), _lift(b)
        v = a.v & b.v if op == "&&" else a.v | b.v
        if a.err is False and b.err is False:
            return Typed("b", v)
        decided = a.v.eqNullSafe(F.lit(op == "||"))
        err = _or(a.err, False if b.err is False else _err_col(b.err) & ~decided)
        return Typed("b", F.when(~err, v), err)

    @staticmethod
    def unary(op: str, x: Typed) -> Typed:
        if x.kind in "ue":
            return x
        if op == "!":
            t = truth(x)
            return Typed("b", ~t.v, t.err)
        if op == "~":
            return Typed("i", F.bitwise_not(x.v), x.err) if x.kind == "i" else _failed(x)
        if x.kind not in "ir":
            return _failed(x)
        return x if op == "+" else Typed(x.kind, -x.v, x.err)

    @staticmethod
    def choose(test: Typed, yes: Typed, no: Typed) -> Typed:
        test = truth(test)
        if test.kind in "ue":
            return test
        kind, item, a, b = unify(yes, no)
        err = _or(test.err, False if yes.err is False and yes.kind != "e" else F.coalesce(test.v, F.lit(False)) & _err_col(yes.err), False if no.err is False and no.kind != "e" else F.coalesce(~test.v, F.lit(False)) & _err_col(no.err))
        return Typed(kind, F.when(test.v, a).when(~test.v, b), err, item)

    @staticmethod
    def list_of(items: list[Typed]) -> Typed:
        kinds = {x.kind for x in items} - {"u"}
        if len(kinds) > 1 or not kinds <= set("birs") or any(x.err is not False for x in items):
            raise Untyped("list of different types")
        kind = kinds.pop() if kinds else "i"
        cols = [x.v if x.v is not None else _null(kind) for x in items]
        return Typed("l", F.array(*cols).cast(f"array<{_CAST[kind]}>"), False, kind)

    @staticmethod
    def select(x: Typed, name: str) -> Typed:
        if x.kind in "ue":
            return x
        if x.kind != "R":
            if x.kind == "l":
                raise Untyped("selection from a list")
            return _failed(x)
        found = x.item.get(name.lower())
        if found is None:
            return _undefined(x)
        got = typed_column(x.v.getField(found[0]), found[1])
        if got is None:
            raise Untyped("field type")
        got.err = _or(got.err, x.err)
        return got

    def subscript(self, x: Typed, i: Typed) -> Typed:
        if "e" in (x.kind, i.kind):
            return E
        if "u" in (x.kind, i.kind):
            return _undefined(x, i)
        if x.kind == "R" and isinstance(i.lit, str):
            return self.select(x, i.lit)
        if x.kind != "l" or i.kind != "i":
            return _failed(x, i)
        out = F.coalesce((i.v < 0) | (i.v >= F.size(x.v)), F.lit(False)) & _all_some(x, i)
        return Typed(x.item, F.get(x.v, i.v.cast("int")), _or(x.err, i.err, out))

    def call(self, e: Call) -> Typed:
        from ..functions.columns import FUNCTIONS

        name = e.name.lower()
        if not arity_ok(name, len(e.args)):
            return E
        f = FUNCTIONS.get(name)
        if f is None:
            raise Untyped(f"function {name}")
        return f(self, [self.expr(a) for a in e.args])


def true_of(x: Typed) -> Column:
    """Boolean true, not merely truthy; as a filter it keeps what Catalyst can push down."""
    if x.kind != "b":
        return F.lit(False)
    return x.v if x.err is False else ~x.err & x.v


def literal_pattern(pat: Typed, options: Typed | None) -> str:
    """A pattern and its options as one Java pattern, or Untyped."""
    if not isinstance(pat.lit, str) or options is not None and not isinstance(options.lit, str):
        raise Untyped("pattern that is no literal")
    opts = "".join(sorted({c for c in (options.lit if options else "").lower() if c in "ims"}))
    if pattern(pat.lit, opts) is None:
        raise BadPattern(pat.lit)
    if re.search(r"\\[pPzZAQECX]|\[\[:|&&|\(\?P?<", pat.lit):
        raise Untyped("pattern with a dialect")
    return (f"(?{opts})" if opts else "") + pat.lit
