"""Regions of a genome: labels, windows, merging and spacing.

The greedy rules depend on what was accepted before, but start afresh after a wide enough gap; positions are therefore
cut into islands at such gaps, which spread over tasks and are walked through in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasieve.plans.joins import join_same
from terrasieve.plans.positions import global_positions, same_as_before
from terrasieve.plans.scratch import Scratch

#: Longest region that merging may make, in bases.
LONGEST_REGION = 131_072


def parse_region(header: Column) -> dict[str, Column]:
    """chromosome, start and end of ``ChrN:start..end`` in a header; NULL where there is none."""
    pattern = r"(Chr\w+):(\d{1,18})\.\.(\d{1,18})"
    part = lambda i: F.nullif(F.regexp_extract(header, pattern, i), F.lit(""))
    return {"chromosome": part(1), "start": part(2).cast("long"), "end": part(3).cast("long")}


def format_region(chromosome: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("Chr"), chromosome.cast("string"), F.lit(":"), start.cast("string"), F.lit(".."), end.cast("string"))


def parse_site(name: Column, window: int) -> dict[str, Column]:
    """chromosome, position and window number of ``chr_pos``; NULL where it isn't of that form."""
    ok = name.rlike(r"^\d{1,9}_\d{1,18}$")
    parts = F.split(name, "_")
    position = F.when(ok, F.try_element_at(parts, F.lit(2)).try_cast("long"))
    return {
        "chromosome": F.when(ok, F.try_element_at(parts, F.lit(1)).try_cast("int")),
        "position": position,
        "window": F.floor(position / window),
    }


def _islands(df: DataFrame, group: Sequence[str], position: str, gap: int) -> DataFrame:
    """(group, island, p): distinct positions, numbered by stretches between which at least ``gap`` is free.

    A greedy rule starts afresh after such a gap, so islands are independent. Positions are put into buckets as wide
    as the gap, so that an island can only begin at the lowest position of a bucket, which the highest one of the
    bucket before decides; buckets are numbered by global positions, and no task holds a whole chromosome.
    """
    keys = [*group, "__bucket"]
    p = F.col(position).cast("long")
    rows = df.filter(F.col(position).isNotNull()).select(*group, p.alias("__p"), F.floor(p / gap).alias("__bucket")).dropDuplicates()
    buckets = rows.groupBy(*keys).agg(F.min("__p").alias("__low"), F.max("__p").alias("__high"))
    before = buckets.select(*group, (F.col("__bucket") + 1).alias("__bucket"), F.col("__high").alias("__before"))
    new = F.coalesce((F.col("__low") - F.col("__before") >= gap).cast("long"), F.lit(1).cast("long"))
    begun = join_same(buckets, before, keys, "left").select(*keys, new.alias("__new"))
    placed = global_positions(begun, group, [F.col("__bucket")], Scratch(df.sparkSession, "islands"), "buckets", weight="__new", as_="__before")
    numbered = placed.select(*keys, (F.col("__before") + F.col("__new")).alias("__island"))
    return join_same(rows, numbered, keys).drop("__bucket")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[
    tuple[pa.RecordBatch, np.ndarray, list[tuple[int, int, bool]]]
]:
    """Each batch with its positions (the last column) and its runs of equal keys: (from, to, whether it goes on from the batch before)."""
    last: list[pa.Array] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i) for i in range(keys)]
        same = same_as_before([pa.concat_arrays([last[i] if last else c.slice(0, 1), c]) for i, c in enumerate(columns)])
        goes_on = bool(same[0]) and last is not None
        starts = np.flatnonzero(~same[1:]) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        last = [c.slice(len(c) - 1, 1) for c in columns]
        yield batch, batch.column(batch.num_columns - 1).to_numpy(), [
            (x, y, goes_on and x == 0) for x, y in zip(edges, edges[1:], strict=False)
        ]


def _by_island(islands: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, "__island"]
    return islands.select(*keys, "__p").repartition(*keys).sortWithinPartitions(*keys, "__p")


def spaced_positions(df: DataFrame, group: Sequence[str], position: str, spacing: int) -> DataFrame:
    """Positions kept greedily from the lowest on, each at least ``spacing`` from the last kept.

    Islands are independent, so they spread over tasks; within one each step jumps to the next kept position.
    """
    group = list(group)
    schema = T.StructType([*(df.schema[g] for g in group), T.StructField(position, T.LongType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch, p, runs in _runs(batches, len(group) + 1):
            kept = []
            for x, y, goes_on in runs:
                i = x + int(np.searchsorted(p[x:y], last + spacing)) if goes_on else x
                while i < y:
                    kept.append(i)
                    last = int(p[i])
                    i += int(np.searchsorted(p[i:y], last + spacing))
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(len(group))), rows.column(rows.num_columns - 1)],
                names=[*group, position],
            )

    return _by_island(_islands(df, group, position, spacing), group).mapInArrow(keep, schema)


def merged_windows(df: DataFrame, group: Sequence[str], position: str, width: int, longest: int = LONGEST_REGION) -> DataFrame:
    """(group, start, end, n): windows of ``width`` around positions, merged while the gap is at most half a window and the region stays within ``longest``.

    Stretches that stay within the cap are plain aggregates; only the positions of longer ones are walked through.
    """
    group, half = list(group), width // 2
    islands = _islands(df, group, position, 3 * half + 1)
    whole = islands.groupBy(*group, "__island").agg(
        (F.min("__p") - half).alias("start"),
        (F.max("__p") + half).alias("end"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )
    fits = F.col("end") - F.col("start") <= longest
    schema = T.StructType(
        [
            *(df.schema[g] for g in group),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("n", T.IntegerType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.RecordBatch, int, int, int] | None = None  # a row of the open region's group, its first and last position, its count

        def region(row: pa.RecordBatch, first: int, last: int, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    *(row.column(i) for i in range(len(group))),
                    pa.array([first - half]),
                    pa.array([last + half]),
                    pa.array([n], pa.int32()),
                ],
                names=[*group, "start", "end", "n"],
            )

        for batch, p, runs in _runs(batches, len(group) + 1):
            for x, y, goes_on in runs:
                if held and not goes_on:
                    yield region(*held)
                    held = None
                i = x
                while i < y:
                    first = held[1] if held else int(p[i])
                    # the first position whose window would end beyond the cap; a lone window may
                    j = i + int(np.searchsorted(p[i:y], first - 2 * half + longest, side="right"))
                    j = max(j, i + 1) if not held else j
                    if j > i:
                        held = (held[0] if held else batch.slice(i, 1), first, int(p[j - 1]), (held[3] if held else 0) + j - i)
                    if j < y:
                        yield region(*held)
                        held = None
                    i = j
        if held:
            yield region(*held)

    long_ones = islands.join(
        whole.filter(~fits).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__island").alias("__i")),
        reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__island") == F.col("__i")),
        "left_semi",
    )
    return whole.filter(fits).select(*group, "start", "end", "n").unionByName(
        _by_island(long_ones, group).mapInArrow(cut, schema)
    )


def exact_windows(df: DataFrame, position: str, size: Column, width: int) -> DataFrame:
    """Adds start and end (exclusive) of a window of exactly ``width`` around a position, moved to stay within [0, size)."""
    start = F.greatest(F.lit(0), F.least(F.col(position) - width // 2, size - width))
    return df.withColumn("start", start.cast("long")).withColumn("end", F.least(start + width, size).cast("long"))


def exact_regions(df: DataFrame, group: Sequence[str], position: str, size: Column, width: int) -> DataFrame:
    """(group, start, end): the ``exact_windows`` of all positions, merged where the merged region would still be of that width.

    A region always has the full width, so a later window can only join it if it adds nothing: it must be the same
    window, or, as an odd width leaves the centre half a place aside, begin one place later. What would be trimmed is
    then cut back to the region as it was. Regions of odd width are thus those at least two places apart.
    """
    windows = exact_windows(df.select(*group, position).dropna(subset=[position]), position, size, width)
    if width % 2 == 0:
        return windows.select(*group, "start", "end").dropDuplicates()
    kept = spaced_positions(windows.select(*group, "start"), group, "start", 2)
    ends = windows.select(*group, "start", "end").dropDuplicates()
    return join_same(kept, ends, [*group, "start"]).select(*group, "start", "end")


def genomic_position(start: Column, offset: Column) -> Column:
    """A place within a region as a place of the chromosome."""
    return start + offset


def site_label(site: Column, position: Column, ref: Column, alt: Column) -> Column:
    """``SNP<site>_<position>_<ref>><alt>``; NULL where a part is."""
    return F.concat(F.lit("SNP"), site.cast("string"), F.lit("_"), position.cast("string"), F.lit("_"), ref, F.lit(">"), alt)


def combination_label(site: Column, positions: Column) -> Column:
    """``COMBO<site>_<positions>``; NULL where a part is."""
    return F.concat(F.lit("COMBO"), site.cast("string"), F.lit("_"), positions.cast("string"))


def tile_members(df: DataFrame, keys: Sequence[str], x: str, y: str, step: float) -> DataFrame:
    """(tile_x, tile_y, keys, x, y): each row in its tile; tiles span ``step`` from the first value beyond the last tile's end, first along x, then along y in each column.

    The starts are found exactly, each by a smallest value over all rows; along y all columns take a step at once.
    The driver holds the starts, of which a map has a bounded number. A lone last value opens a tile like any other.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "tiles")
    rows = df.select(
        *keys,
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    ).dropna(subset=["x", "y"]).filter(~F.isnan("x") & ~F.isnan("y"))
    values = scratch.write(rows.select("x").dropDuplicates(), "x")
    columns, at = [], values.agg(F.min("x")).first()[0]
    while at is not None:
        columns.append((at, at + step))
        at = values.filter(F.col("x") > at + step).agg(F.min("x")).first()[0]
    starts = spark.createDataFrame(columns, "tile_x double, end_x double")
    in_x = rows.join(F.broadcast(starts), (F.col("x") >= F.col("tile_x")) & (F.col("x") <= F.col("end_x"))).drop("end_x")
    in_x = scratch.write(in_x, "columns")
    values = scratch.write(in_x.select("tile_x", "y").dropDuplicates(), "y")
    tiles, ends = [], [(t, float("-inf")) for t, _ in columns]
    while ends:
        beyond = values.join(F.broadcast(spark.createDataFrame(ends, "tile_x double, end_y double")), "tile_x").filter("y > end_y")
        found = [(r[0], r[1], r[1] + step) for r in beyond.groupBy("tile_x").agg(F.min("y")).collect()]  # one row a column
        tiles += found
        ends = [(t, end) for t, _, end in found]
    boxes = F.broadcast(spark.createDataFrame(tiles, "tile_x double, tile_y double, end_y double"))
    return in_x.join(boxes, "tile_x").filter("y >= tile_y and y <= end_y").select("tile_x", "tile_y", *keys, "x", "y")


def greedy_tiles(df: DataFrame, x: str, y: str, step: float, margin: float = 0.1) -> DataFrame:
    """(tile_x, tile_y, n, x0, x1, y0, y1): the tiles of ``tile_members``, each with its rows counted and the box around them."""
    return tile_members(df, [], x, y, step).groupBy("tile_x", "tile_y").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("x") - margin).alias("x0"),
        (F.max("x") + margin).alias("x1"),
        (F.min("y") - margin).alias("y0"),
        (F.max("y") + margin).alias("y1"),
    )
