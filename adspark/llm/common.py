"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
NULL_ID = -(1 << 63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Keep one Arrow batch sent to a Python worker at ``limit`` bytes or less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > limit:
        spark.conf.set(key, str(limit))


def pieces(batch, column: str, limit: int = PIECE_BYTES):
    """An Arrow batch in parts of at most ``limit`` bytes of a text column, a row at least; rows keep their order."""
    import numpy as np

    from .bytesops import flat

    _, off = flat(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="adspark-")
        spark.sparkContext.setCheckpointDir(top)
    return top


def materialize(df: DataFrame, name: str = "t", files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    ``files``: dealt anew to so many, for results known to be small beside the shuffle partitions.
    """
    spark = df.sparkSession
    if files:
        df = df.repartition(files)
    path = f"{shared_dir(spark)}/adspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_for(rows: int, each: int) -> int:
    """A file for so many rows, one at least."""
    return max(1, -(-rows // each))


def release(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` result that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int = 10 << 20) -> int:
    """A bucket count in proportion to the input, at least the shuffle partitions."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    # a plan over an RDD has no estimate, which Catalyst writes as the largest long
    return least if size >= 1 << 60 else max(least, -(-size // bytes_each))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shield(df: DataFrame, *keep: str):
    """``df`` with all columns but ``keep`` under names that no operator uses, and a function that names them back.

    Where a result has a column of an input column's name besides, the result's own stays and the input's goes.
    """
    names = {c: f"_adspark_own{i}" for i, c in enumerate(df.columns) if c not in keep}
    col = lambda c: F.col(quoted(c))

    def back(out: DataFrame) -> DataFrame:
        old = {v: k for k, v in names.items()}
        own = {c for c in out.columns if c not in old}
        return out.select(*(col(c).alias(old.get(c, c)) for c in out.columns if old.get(c) not in own))

    return df.select(*(col(c).alias(names.get(c, c)) for c in df.columns)), back


def row_key(df: DataFrame) -> DataFrame:
    """Add ``k1`` (doc_id, null as the least long) and ``k2`` (hash of the text).

    Rows that agree in both are repeated rows and get equal results.
    """
    return df.withColumns(
        {
            "k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
            "k2": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
    )


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


BLOOM_BITS = 1 << 25


def bloom(keys: DataFrame, *cols: str):
    """A fixed 4 MB Bloom filter of key columns, as a broadcast of 64-bit words.

    It spares shuffling rows that cannot join. When it fills up it spares
    less; results do not depend on it.
    """
    import numpy as np

    bits = keys.select(F.explode(F.array(*_bloom_places(cols))).alias("p"))
    got = bits.groupBy((F.col("p") / 64).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("w")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    words[got.column("i").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def _bloom_places(cols) -> list:
    return [F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(BLOOM_BITS)) for seed in (1, 2)]


def with_bloom_places(df: DataFrame, *cols: str) -> DataFrame:
    a, b = _bloom_places(cols)
    return df.withColumns({"_p1": a, "_p2": b})


def bloom_hits(words, batch):
    """Which rows of an Arrow batch with ``_p1`` and ``_p2`` may be among the keys."""
    import numpy as np

    hit = np.ones(batch.num_rows, bool)
    for c in ("_p1", "_p2"):
        p = batch.column(c).to_numpy()
        hit &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
    return hit


def lean(run):
    """``run`` (over batches, groups or tables), giving freed memory back to the system when it ends.

    Python workers live on between tasks; what their allocators keep would
    count against the executor during stages that need none of it.
    """
    import functools
    import inspect

    def trim() -> None:
        import contextlib
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def batches(*args):
            try:
                yield from run(*args)
            finally:
                trim()

        return batches

    # Spark reads the number of arguments off the function
    if len(inspect.signature(run).parameters) == 1:

        def table(a):
            try:
                return run(a)
            finally:
                trim()

    else:

        def table(a, b):
            try:
                return run(a, b)
            finally:
                trim()

    return table
