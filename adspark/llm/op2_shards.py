"""Proportional stratified interleaving into training shards, DataFrame only.

Rows are shuffled within their source by a seeded hash of the id, ranked, and
ordered by the fractional rank (rank - 1/2) / rows of the source; cutting that
order evenly gives every shard the mixture of the whole.

No window spans a source or the table. A rank is the sum of two parts: the
rows in lower hash buckets, from a small table of bucket counts, and the
position in the bucket. So a source with a third of all rows is as many
buckets as a third of the table has. How many rows come before a cut follows
from the sources' row counts, which are summed over the cuts that hold rows.

The hash is of the id and of a hash of the whole row, and equal hashes are
ordered by that, so the same rows get the same slots in whatever order they
are read, and rows of one id (or of none) are spread like others. Rows that
agree in all columns share out their slots among them.

Null source: a stratum of its own. Null text: size 1. Null id: hashed as the
empty text. Repeated rows: each gets its own slot. Empty table: no rows.
Columns named ``shard`` or ``slot`` give way to the result's, others are
carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import input_bytes, quoted, shield

BUCKET_BYTES = 4 << 20
#: Cuts are added up in blocks of so many.
BLOCK = 1024


def _cuts(docs: DataFrame) -> int:
    """Buckets in proportion to the input."""
    size, n = input_bytes(docs), 64
    while n * BUCKET_BYTES < size < 1 << 60:  # a plan over an RDD has no estimate, which Catalyst writes as the largest long
        n *= 2
    return n


def seeded(id_col, seed: int, row):
    """A 60-bit hash that any SQL engine with md5 gives as well, from the id's text and a row's own hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def row_hash(df: DataFrame):
    """A hash of all columns that have one; maps have none."""
    return F.xxhash64(*(df[c] for c in (quoted(f.name) for f in df.schema if "map<" not in f.dataType.simpleString())))


def interleave(docs: DataFrame, id_col: str = "doc_id", stratum: str = "source", shards: int = 8, seed: int = 7) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0); shard sizes differ by a row at most."""
    cuts = _cuts(docs)
    width = (1 << 60) // cuts
    place, by_source = docs.columns.index(id_col), docs.columns.index(stratum)
    own, back = shield(docs)
    own = own.withColumns({"_s": F.col(own.columns[by_source]), "_t": row_hash(own)})
    own = own.withColumn("_h", seeded(F.col(own.columns[place]), seed, F.col("_t"))).withColumn("_b", F.expr(f"_h div {width}"))

    count = own.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_s2")
    before = count.select(F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), "_n").select(
        "_s2", "_b2", (F.sum("_n").over(by.orderBy("_b2")) - F.col("_n")).alias("_lower"), F.sum("_n").over(by).alias("_all")
    )
    ranked = (
        own.join(before, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")))
        .withColumn("_rank", F.col("_lower") + F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_t")))
        .withColumn("_cut", F.expr(f"(2 * _rank - 1) * {cuts} div (2 * _all)"))
    )
    # ranks of a source before a cut: of one with few rows each rank's cut, of others each cut's ranks
    upto = lambda c: f"(CASE WHEN {c} = 0 THEN 0L ELSE ((2 * _all * {c} - 1) div {cuts} + 1) div 2 END)"
    held = f"""CASE WHEN _all < {cuts} THEN transform(sequence(1L, _all), r -> named_struct('cut', (2 * r - 1) * {cuts} div (2 * _all), 'n', 1L))
        ELSE transform(sequence(0L, {cuts - 1}L), c -> named_struct('cut', c, 'n', {upto('(c + 1)')} - {upto('c')})) END"""
    per = count.groupBy("_s").agg(F.sum("_n").alias("_all")).select(F.explode(F.expr(held)).alias("_c")).groupBy(F.col("_c.cut").alias("_cut2")).agg(F.sum("_c.n").alias("_n"))
    per = per.withColumn("_block", F.expr(f"_cut2 div {BLOCK}"))
    blocks = per.groupBy("_block").agg(F.sum("_n").alias("_m"))
    blocks = blocks.select(
        F.col("_block").alias("_block2"), (F.sum("_m").over(Window.orderBy("_block")) - F.col("_m")).alias("_ahead"), F.sum("_m").over(Window.partitionBy(F.lit(0))).alias("_total")
    )
    starts = per.join(blocks, F.col("_block") == F.col("_block2")).select(
        "_cut2", "_total", (F.col("_ahead") + F.sum("_n").over(Window.partitionBy("_block").orderBy("_cut2")) - F.col("_n")).alias("_first")
    )
    placed = (
        ranked.join(starts, F.col("_cut") == F.col("_cut2"))
        .withColumn(
            "_pos",
            F.col("_first") + F.row_number().over(Window.partitionBy("_cut").orderBy((2 * F.col("_rank") - 1) / F.col("_all"), "_s", "_rank")) - 1,
        )
        .withColumn("shard", F.expr(f"cast(_pos * {shards} div _total AS int)"))
    )
    begin = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return back(placed.withColumn("slot", (F.col("_pos") - begin).cast("long")).select(*own.columns[: len(docs.columns)], "shard", "slot"))


def op2_stratified_interleave(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return interleave(slim).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
