"""The same or nearly the same records across splits.

Evaluation records are written as short symbol strings (an identifier, a place from coarse to fine) and
indexed in shards of bounded size; training records stream through backward search against the shards their
strings can occur in. Equal strings are indexed and searched once, whatever their number of records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.llm.fmindex import SEPARATOR, FMIndex, id_symbols, place_symbols
from terrasieve.llm.gridlinks import FLOAT_SLACK
from terrasieve.plans.scratch import Scratch

#: Distinct evaluation strings in a shard and distinct training strings searched at once in a task.
SHARD_ROWS, CHUNK_ROWS = 50_000, 100_000
#: Cells along one side of a tile; a tile's strings go to one shard, a large tile is divided.
TILE = 256

_ID, _PLACE = 0, 1


def _shift(w: float) -> tuple[int, int]:
    """What makes cell numbers of valid coordinates positive, with one cell to spare."""
    return int(180 / w) + 2, int(90 / w) + 2


def _strings(records: DataFrame, key: str, x: str, y: str, tolerance: float) -> DataFrame:
    """(kind, id, x, y, cx, cy), distinct: one row for each identifier and each place."""
    w = tolerance + FLOAT_SLACK
    sx, sy = _shift(w)
    ids = records.select(F.lit(_ID).alias("kind"), F.col(key).alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    places = records.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.lit(_PLACE).alias("kind"),
        F.lit(0).cast("long").alias("id"),
        F.col(x).alias("x"),
        F.col(y).alias("y"),
    )
    cell = lambda c, s: F.when(F.col("kind") == _PLACE, F.floor(F.col(c) / F.lit(w)) + s).otherwise(0)
    return ids.unionByName(places).dropDuplicates().withColumns({"cx": cell("x", sx), "cy": cell("y", sy)})


def _tile(cx, cy):  # noqa: ANN001, ANN202
    return F.xxhash64(F.lit(_PLACE), F.floor(cx / TILE), F.floor(cy / TILE))


def _routed(strings: DataFrame, shards: int, *, reach: bool) -> DataFrame:
    """Adds ``shard``; with ``reach`` a place goes to every tile its neighbouring cells touch, mostly one."""
    by_id = F.xxhash64(F.lit(_ID), "id")
    if reach:
        corners = F.array_distinct(F.array(*[_tile(F.col("cx") + i, F.col("cy") + j) for i in (-1, 1) for j in (-1, 1)]))
        routed = strings.withColumn("route", F.explode(F.when(F.col("kind") == _ID, F.array(by_id)).otherwise(corners)))
    else:
        routed = strings.withColumn("route", F.when(F.col("kind") == _ID, by_id).otherwise(_tile(F.col("cx"), F.col("cy"))))
    return routed.withColumn("shard", F.pmod("route", F.lit(shards)).cast("int")).drop("route").dropDuplicates()


def matched_strings(train: DataFrame, evaluation: DataFrame, key: str, x: str, y: str, tolerance: float) -> DataFrame:
    """(kind, train_id, train_x, train_y, eval_id, eval_x, eval_y): strings of the two sides that agree.

    kind 0: the same identifier; kind 1: places that differ by at most ``tolerance`` in x and in y. Both inputs
    are distinct rows of key (long), x and y (doubles, both null where the place is unknown).
    """
    spark = train.sparkSession
    scratch = Scratch(spark, "overlap")
    left = scratch.write(_strings(train, key, x, y, tolerance), "train")
    right = scratch.write(_strings(evaluation, key, x, y, tolerance), "eval")
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(right.count() / SHARD_ROWS))
    right = _routed(right, shards, reach=False)
    left = _routed(left, shards, reach=True)
    # a shard that outgrows its bound is divided into parts, and what must search it into chunks
    parts = right.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts"))
    chunks = left.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    plan = scratch.write(parts.join(chunks, "shard"), "plan")
    spread = F.xxhash64("kind", "id", "x", "y")
    right = right.join(plan, "shard").withColumn("part", F.pmod(spread, F.col("parts")).cast("int"))

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("kind", kind="stable", ignore_index=True)
        ids, places = rows[rows.kind == _ID], rows[rows.kind == _PLACE]
        built = FMIndex.build([id_symbols(ids.id.to_numpy(np.int64)), place_symbols(places.cx.to_numpy(), places.cy.to_numpy())])
        rows = pd.concat([ids, places])
        return pd.DataFrame(
            {
                "shard": [rows.shard.iloc[0]],
                "part": [rows.part.iloc[0]],
                "chunks": [rows.chunks.iloc[0]],
                "index": [built.dump()],
                "ids": [rows.id.tolist()],
                "xs": [rows.x.tolist()],
                "ys": [rows.y.tolist()],
            }
        )

    indexes = right.groupBy("shard", "part").applyInPandas(
        index,
        "shard int, part int, chunks int, index binary, ids array<long>, xs array<double>, ys array<double>",
    )
    indexes = scratch.write(indexes, "indexes").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    queries = left.join(plan, "shard").withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int")).withColumn(
        "part",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
    )
    w = tolerance + FLOAT_SLACK

    def search(rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "train_id", "train_x", "train_y", "eval_id", "eval_x", "eval_y"]
        if rows.empty or shard.empty:
            return pd.DataFrame(columns=columns)
        held = FMIndex.load(shard["index"].iloc[0])
        eid, ex, ey = (np.asarray(shard[c].iloc[0]) for c in ("ids", "xs", "ys"))
        found = []
        ids = rows[rows.kind == _ID]
        for at, symbols in [(ids.index.to_numpy(), id_symbols(ids.id.to_numpy(np.int64))), *_around(rows[rows.kind == _PLACE])]:
            whole = np.concatenate([np.full((len(symbols), 1), SEPARATOR, np.uint8), symbols], axis=1)
            low, high, length = held.search(whole)
            full = length == whole.shape[1]
            pattern, record = held.records_of(low[full], high[full])
            found.append((at[full][pattern], record))
        where, record = (np.concatenate(c) for c in zip(*found, strict=True))
        hit = rows.loc[where]
        out = pd.DataFrame(
            {
                "kind": hit.kind.to_numpy(),
                "train_id": hit.id.to_numpy(),
                "train_x": hit.x.to_numpy(),
                "train_y": hit.y.to_numpy(),
                "eval_id": eid[record],
                "eval_x": ex[record],
                "eval_y": ey[record],
            }
        )
        close = (np.abs(out.train_x - out.eval_x) <= w) & (np.abs(out.train_y - out.eval_y) <= w)
        return out[close]

    schema = "kind int, train_id long, train_x double, train_y double, eval_id long, eval_x double, eval_y double"
    return queries.groupBy("shard", "part", "chunk").cogroup(
        indexes.groupBy("shard", "part", "chunk")
    ).applyInPandas(search, schema)


def _around(places: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The strings of a place's own cell and its eight neighbours."""
    at, cx, cy = places.index.to_numpy(), places.cx.to_numpy(), places.cy.to_numpy()
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            yield at, place_symbols(cx + i, cy + j)


def cross_split_overlaps(
    records: DataFrame,
    splits: DataFrame,
    key: str,
    x: str,
    y: str,
    tolerance: float,
    *,
    train: str = "train",
) -> DataFrame:
    """(key_1, key_2, split), distinct: a record listed as train and one listed in another split that are the same or at the same place.

    ``records`` has one row per key with its place (null where unknown); ``splits`` lists (key, split). key_1 <=
    key_2; a record listed in train and in another split gives a pair of itself. Records not listed, listed ones
    not in ``records`` and null keys are ignored; empty inputs give no rows. A place shared by many records is
    matched once and expanded by joins, which AQE splits where one place holds a large share.
    """
    scratch = Scratch(records.sparkSession, "overlap-members")
    listed = scratch.write(
        splits.select(key, "split").dropna().dropDuplicates().join(
            records.select(key, F.col(x).alias("x"), F.col(y).alias("y")).filter(F.col(key).isNotNull()),
            key,
        ),
        "members",
    )
    left, right = listed.filter(F.col("split") == train), listed.filter(F.col("split") != train)
    matched = scratch.write(
        matched_strings(
            left.select(key, "x", "y").dropDuplicates(),
            right.select(key, "x", "y").dropDuplicates(),
            key,
            "x",
            "y",
            tolerance,
        ),
        "matched",
    )
    same = matched.filter(F.col("kind") == _ID).select(
        F.col("train_id").alias("t"),
        F.col("eval_id").alias(key),
    ).join(right.select(key, "split"), key).select("t", F.col(key).alias("e"), "split")
    places = matched.filter(F.col("kind") == _PLACE)
    t = left.select(F.col(key).alias("t"), F.col("x").alias("train_x"), F.col("y").alias("train_y"))
    e = right.select(F.col(key).alias("e"), "split", F.col("x").alias("eval_x"), F.col("y").alias("eval_y"))
    near = places.join(t, ["train_x", "train_y"]).join(e, ["eval_x", "eval_y"]).select("t", "e", "split")
    both = same.unionByName(near)
    return both.select(F.least("t", "e").alias(f"{key}_1"), F.greatest("t", "e").alias(f"{key}_2"), "split").dropDuplicates()


def cross_split_links(
    records: DataFrame,
    splits: DataFrame,
    key: str,
    x: str,
    y: str,
    tolerance: float,
    *,
    train: str = "train",
) -> DataFrame:
    """(key, split, place_key, n_links): for every record listed as train, with how many records of each other split it overlaps.

    The same matches as ``cross_split_overlaps``, but records of one place stand as one class, named by its smallest
    train key as ``place_key`` (the key itself where the place is unknown): the spans of evaluation places that a
    class matches are merged and their records counted, so no pair of records is listed, however many share a place.
    Nulls, unlisted records and empty inputs as there; records without an overlap give no row.
    """
    scratch = Scratch(records.sparkSession, "overlap-links")
    place = records.select(key, F.col(x).alias("x"), F.col(y).alias("y")).filter(F.col(key).isNotNull())
    listed = scratch.write(splits.select(key, "split").dropna().dropDuplicates().join(place, key), "members")
    left, right = listed.filter(F.col("split") == train).drop("split"), listed.filter(F.col("split") != train)
    found = matched_strings(left.dropDuplicates(), right.select(key, "x", "y").dropDuplicates(), key, "x", "y", tolerance)
    places = scratch.write(found.filter(F.col("kind") == _PLACE).select("train_x", "train_y", "eval_x", "eval_y"), "places")
    held = right.groupBy(F.col("x").alias("eval_x"), F.col("y").alias("eval_y"), "split").agg(F.count(F.lit(1)).alias("n"))
    spans = places.join(held, ["eval_x", "eval_y"]).groupBy("train_x", "train_y", "split").agg(F.sum("n").alias("n_links"))
    classes = left.dropna().groupBy("x", "y").agg(F.min(key).alias("place_key"))
    members = left.join(classes, ["x", "y"]).select(key, "place_key", F.col("x").alias("train_x"), F.col("y").alias("train_y"))
    near = members.join(spans, ["train_x", "train_y"]).select(key, "split", "place_key", "n_links")
    # a record listed on both sides meets itself at its place; without one it meets only itself
    lone = left.filter(F.col("x").isNull() | F.col("y").isNull()).select(key)
    itself = lone.join(right.select(key, "split"), key).select(key, "split", F.col(key).alias("place_key"), F.lit(1).cast("long").alias("n_links"))
    return near.unionByName(itself)
