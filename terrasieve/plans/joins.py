"""Joins by keys in which a null key is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all keys are equal or both null.

    Without keys ``right`` must be one row, which is broadcast. For ``left_semi`` and ``left_anti`` no column is added.
    """
    if not keys:
        return left.join(F.broadcast(right), how="left" if how == "left" else "inner")
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.{n}")) for k, n in names.items()])
    joined = left.alias("l").join(renamed.alias("r"), on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())
