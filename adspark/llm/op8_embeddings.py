"""Embedding near-duplicates by partial distances along principal axes.

Unit vectors with cosine >= t lie within squared distance D = 2 - 2 t, so they
do in any part of their coordinates. Vectors are rotated to the principal axes;
the leading ones, which hold most of the variance, part nearly all pairs in
single precision with room for its rounding. What they leave is settled by an
exact cosine in double precision.

Exact copies (equal components, by a 128-bit hash) are one vector with a
multiplicity before the join. The others are packed into tiles, a row of a
table each, sorted along the first axis; each two tiles meet in a task by a
Cartesian product over files, which shuffles nothing, so disk grows with the
vectors and not with their pairs. In two tiles only slabs whose stretches of
the first axis come within the distance are compared. No pairs leave a task:
counts per vector do, and the edges of a spanning forest of the links found there.

Vectors link within their own length; each length is a join of its own. Null,
zero and non-finite vectors and a null id link with nothing. Repeated ids with equal vectors count as copies.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bound_batches, files_for, lean, materialize
from .graph import components

#: Rows of a tile at most; fewer where so many are more bytes than a batch.
TILE = 8192
#: Rows of two slabs that are compared at once.
SLABS = 512, 2048
#: The leading axes hold so much of the variance, and are so many at least.
SHARE, LEAST_AXES = 0.4, 16


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles; every list has ``dim`` finite components."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _moments(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Second moments over all rows: one dim x dim sum per task reaches the driver's aggregate."""

    def run(batches):
        s, n = np.zeros((dim, dim)), 0
        for b in batches:
            x = _unit(_vectors(b.column(0), dim))
            s += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim * dim), pa.int32()), pa.array(s.ravel()), pa.array(np.full(dim * dim, n if n else 0), pa.int64())], names=["k", "s", "n"])

    got = rows.select("vector").mapInArrow(run, "k int, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas().sort_values("k")
    if not len(got):
        return np.eye(dim), 0
    n = int(got["n"].iloc[0])
    return got["s"].to_numpy().reshape(dim, dim) / max(n, 1), n


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def leading(values: np.ndarray) -> int:
    """How many axes are compared first; ``values``: variances, largest first."""
    held = np.cumsum(np.maximum(values, 0))
    return min(len(values), max(LEAST_AXES, int(np.searchsorted(held, SHARE * held[-1])) + 1))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of 0..n-1 reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def near_pairs(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vectors`` (vec_id long, embedding array): one row per vector with n_links, component_id and kept."""
    spark = vectors.sparkSession
    bound_batches(spark)
    # vectors travel as wide as they came; all sums that decide are in doubles
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    e = F.col("embedding").cast("array<double>")
    largest = F.aggregate(e, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    sound = (
        F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & ~F.coalesce(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & (largest > 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    own_width = F.col("embedding") if kind == "<f4" else e
    good = rows.where("sound AND vec_id IS NOT NULL").select("vec_id", own_width.alias("vector")).withColumn("dim", F.size("vector"))
    # a vector that is alone in its length links with nothing
    dims = {r["dim"]: r["count"] for r in good.groupBy("dim").count().where("count > 1").collect()}
    joined = F.col("sound") & F.col("vec_id").isNotNull() & F.size("embedding").isin(sorted(dims))
    out = rows.where(~F.coalesce(joined, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for dim, count in sorted(dims.items()):
        own = good.where(F.col("dim") == dim).select("vec_id", "vector")
        tile = max(1, min(TILE, BATCH_BYTES // (dim * np.dtype(kind).itemsize)))
        values, turn = (v[..., ::-1] for v in np.linalg.eigh(_moments(own, dim)[0]))
        keyed = own.mapInArrow(lambda it, dim=dim: _keys(it, dim, kind, True), "vec_id long, key binary, vector binary")
        one = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        tiles = materialize(_tiles(one, dim, kind, turn, tile, files_for(count, tile)), "tiles")
        found = materialize(_join(tiles, dim, kind, turn, leading(values), threshold), "near")
        counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("near"))
        comp = components(found.where("b IS NOT NULL").select("a", "b"))
        names = own.mapInArrow(lambda it, dim=dim: _keys(it, dim, kind, False), "vec_id long, key binary")
        per = (
            names.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
            .join(counts, F.col("rep") == F.col("a"), "left")
            .join(comp, F.col("rep") == F.col("id"), "left")
            .select("key", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        )
        out = names.join(per, "key").select("vec_id", "n_links", "component_id").unionByName(out)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _keys(batches, dim: int, kind: str, whole: bool):
    """Ids with a 128-bit hash of the components, and, for ``whole``, the components as bytes; 0.0 and -0.0 are equal."""
    for b in batches:
        x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) + np.zeros(1, kind)
        raw = [v.tobytes() for v in x]
        cols = {"vec_id": b.column("vec_id"), "key": pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in raw], pa.binary())}
        yield pa.RecordBatch.from_pydict(cols | ({"vector": pa.array(raw, pa.binary())} if whole else {}))


def _tiles(one: DataFrame, dim: int, kind: str, turn: np.ndarray, tile: int, files: int) -> DataFrame:
    """The vectors of ``one`` packed into rows of ``tile`` vectors at most, each sorted along the first axis."""
    first = turn[:, 0]

    def pack(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        held, rows = [], 0

        def full():
            nonlocal at
            t = pa.Table.from_batches(held)
            x = np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(-1, dim)
            order = np.argsort(_unit(x.astype(np.float64)) @ first, kind="stable")
            cols = t.column("rep").to_numpy()[order], t.column("copies").to_numpy()[order], x[order]
            name = (part << 32) + at
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=["tile", "rep", "copies", "vector"])

        for b in batches:
            while rows + b.num_rows >= tile:
                held.append(b.slice(0, tile - rows))
                b = b.slice(tile - rows)
                yield full()
                held, rows = [], 0
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
        if rows:
            yield full()

    return one.select("rep", "copies", "vector").coalesce(files).mapInArrow(lean(pack), "tile long, rep binary, copies binary, vector binary")


def _join(tiles: DataFrame, dim: int, kind: str, turn: np.ndarray, lead: int, threshold: float) -> DataFrame:
    """Rows (a, null, n): n links of a found in two tiles; rows (a, b, 0): an edge of their links' forest."""
    turn = np.ascontiguousarray(turn[:, :lead])
    # single precision may be off by so much, sums of all coordinates included
    most = 2 - 2 * threshold + 1e-6 * (dim + 64)

    class Tile:
        def __init__(self, rep, copies, vector):
            self.rep, self.copies = np.frombuffer(rep, np.int64), np.frombuffer(copies, np.int64)
            self.x = _unit(np.frombuffer(vector, kind).astype(np.float64).reshape(-1, dim))
            y = (self.x @ turn).astype(np.float32)
            norm = (y * y).sum(axis=1, keepdims=True)
            one = np.ones_like(norm)
            # the product of a left and a right row is their squared distance
            self.left, self.right = np.hstack((-2 * y, norm, one)), np.ascontiguousarray(np.hstack((y, one, norm)).T)
            self.first = y[:, 0]

        def __len__(self):
            return len(self.rep)

    def meet(s: Tile, t: Tile):
        """Places of the linked rows of two tiles, slab by slab; in a tile with itself each pair once."""
        for a in range(0, len(s), SLABS[0]):
            z = min(a + SLABS[0], len(s))
            lo, hi = np.searchsorted(t.first, (s.first[a:z].min() - most**0.5 - 1e-3, s.first[a:z].max() + most**0.5 + 1e-3))
            for c in range(max(lo, a) if s is t else lo, hi, SLABS[1]):
                e = min(c + SLABS[1], hi)
                hit = np.flatnonzero(s.left[a:z] @ t.right[:, c:e] <= most)
                if not len(hit):
                    continue
                i, j = np.divmod(hit, e - c)
                i, j = i + a, j + c
                if s is t:
                    i, j = i[j > i], j[j > i]
                if len(i) > (z - a) * (e - c) // 16:
                    # many: all at once, and those at the threshold again as below
                    cosine = (s.x[a:z] @ t.x[c:e].T)[i - a, j - c]
                    i, j, cosine = (v[cosine >= threshold - 1e-9] for v in (i, j, cosine))
                    edge = cosine < threshold + 1e-9
                    live = ~edge
                    live[edge] = np.einsum("ij,ij->i", s.x[i[edge]], t.x[j[edge]]) >= threshold
                else:
                    live = np.einsum("ij,ij->i", s.x[i], t.x[j]) >= threshold
                yield i[live], j[live]

    def compare(batches):
        held: dict[int, Tile] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["tile"] not in held:
                    held.clear()
                    held[r["tile"]] = Tile(r["rep"], r["copies"], r["vector"])
                s = held[r["tile"]]
                t = s if r["tile2"] == r["tile"] else Tile(r["rep2"], r["copies2"], r["vector2"])
                far = 0 if s is t else len(s)
                rep, copies = (s.rep, s.copies) if s is t else (np.concatenate((s.rep, t.rep)), np.concatenate((s.copies, t.copies)))
                links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
                for p, q in meet(s, t):
                    q = q + far
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    live = label[p] != label[q]
                    if live.any():
                        label = _spanning(np.concatenate((np.arange(len(rep)), p[live])), np.concatenate((label, q[live])), len(rep))
                some, root = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((rep[some], rep[root]))),
                    pa.array(np.concatenate((rep[some], rep[label[root]])), mask=np.arange(len(some) + len(root)) < len(some)),
                    pa.array(np.concatenate((links[some], np.zeros(len(root), np.int64)))),
                ], names=["a", "b", "n"])

    other = tiles.select(*(F.col(c).alias(f"{c}2") for c in tiles.columns))
    met = tiles.hint("shuffle_replicate_nl").join(other, F.col("tile") <= F.col("tile2"))
    return met.mapInArrow(lean(compare), "a long, b long, n long")


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
