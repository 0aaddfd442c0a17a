"""Inheritance from parent records, one level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.syntax import is_private


def inherit(children: DataFrame, parents: DataFrame, on: str, parent_key: str, present: str | None = None, private: bool = False) -> DataFrame:
    """Each child with its parent's attributes where it lacks them.

    Presence decides, not definedness: ``present`` names an array column of the
    attributes that a child has, so one set to undefined hides the parent's.
    Without it a null is a lack. The parent's private attributes stay behind.
    Frames partitioned by the key join without a shuffle.
    """
    names = [c for c in parents.columns if c != parent_key and (private or not is_private(c))]
    p = parents.select(F.col(parent_key).alias("_pk"), *(F.col(c).alias(f"_p_{c}") for c in names))
    joined = children.join(p, F.col(on) == F.col("_pk"), "left")
    own = {c.lower(): c for c in children.columns}
    cols = []
    for c in children.columns:
        if c == present or f"_p_{c}" not in joined.columns:
            cols.append(F.col(c))
        elif present is None:
            cols.append(F.coalesce(F.col(c), F.col(f"_p_{c}")).alias(c))
        else:
            cols.append(F.when(F.array_contains(F.coalesce(F.col(present), F.array().cast("array<string>")), c), F.col(c)).otherwise(F.coalesce(F.col(c), F.col(f"_p_{c}"))).alias(c))
    return joined.select(*cols, *(F.col(f"_p_{c}").alias(c) for c in names if c.lower() not in own))


def family_view(table: DataFrame, key: str = "key", parent_key: str = "parent", structural: str = "structural") -> DataFrame:
    """A table's plain records with what they inherit; structural ones are hidden, and only they are parents."""
    names = [c for c in table.columns if c not in (key, parent_key, structural)]
    parents = table.where(F.col(structural)).select(key, *names)
    return inherit(table.where(~F.coalesce(F.col(structural), F.lit(False))).drop(structural), parents, parent_key, key)
