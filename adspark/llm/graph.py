"""Connected components of a link table by alternating stars.

Large-star hangs each vertex's larger neighbours on its least neighbour,
small-star the smaller ones; repeated, every component becomes a star around
its least vertex. Rounds are written to the shared folder, so lineage stays
short and a lost executor costs one round; both sides of each join come from
files, so adaptive execution can split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, materialize, release


#: A round's table has a file for so many links, one at least.
LINKS_A_FILE = 1 << 18


def _print(edges: DataFrame):
    r = edges.agg(
        F.count(F.lit(1)), F.count_distinct("u"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
    ).first()
    return tuple(r)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has a link; component is its least vertex."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.distinct(), "links", files_for(edges.count(), LINKS_A_FILE))
    was = _print(edges)
    if was[0]:
        while True:
            if was[0] == was[1] and not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
                break  # stars already: each vertex hangs on one other, which hangs on none
            files = files_for(was[0], LINKS_A_FILE)

            def table(df, name, files=files):
                return materialize(df, name, files)

            def least(df):
                return table(df.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "least")

            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            m = least(both)
            large = table(
                both.where(F.col("v") > F.col("u")).join(m, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large"
            )
            release(m)
            m2 = least(large)
            small = large.join(m2, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = table(small.unionByName(m2.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small")
            release(m2)
            release(large)
            release(edges)
            edges, now = new, _print(new)
            if now == was:
                break
            was = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
