"""Several values packed in one field, split into one value per row.

The writer's notation (delimiters, quoting, brackets, a quote around the whole field, letters written
without delimiters) is read off a *skeleton* of each field: ordinary characters are masked, every separator
is one mark, and repeats collapse. Fields share few skeletons, so the splitting rules are worked out once
per distinct skeleton and joined back; extraction itself stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns of the notation: a value outside quotes is a run of letters, digits, '-', '_' and '.'
# with a letter or digit in it; inside quotes everything up to the closing quote is one value.
# Groups repeat possessively: the matcher would otherwise need stack for every repetition of a long field.
WORD = r"[-_.]*[\p{L}\p{N}][\p{L}\p{N}\p{M}_.-]*"
DOUBLE = '"(?:[^"]|"")*+"'
SINGLE = "'(?:[^']|'')*+'"
ITEM = f"{DOUBLE}|{SINGLE}|{WORD}"

#: Above this many distinct skeletons (about 100 bytes each) the rules are joined with a shuffle.
BROADCAST_SKELETONS = 20_000


def skeleton(field: Column) -> Column:
    """The field with quoted values as D or S, other values as x, separators as one comma; two or more values are xx.

    What is left are the ends and unpaired quotes, so even large tables have few distinct skeletons.
    """
    s = F.regexp_replace(field, DOUBLE, "\u0001")
    s = F.regexp_replace(s, SINGLE, "\u0002")
    s = F.regexp_replace(s, WORD, "\u0003")
    s = F.regexp_replace(s, "[^\u0001\u0002\u0003\"']+", ",")
    s = F.translate(s, "\u0001\u0002\u0003", "DSx")
    return F.regexp_replace(s, "[DSx],?(?:[DSx],?)++", "xx")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rules(skeletons: pd.Series) -> pd.Series:
    """The readings a skeleton allows, the most literal first.

    list: each quoted or bare value; open: an unpaired quote is a separator; wrapped: one quote pair around
    the whole field, then a list within; letters: every letter or digit is a value.
    """

    def of(s: str) -> list[str]:
        if s.strip(",") == "":
            return ["list"]
        found = ["list"]
        inner = s.strip(",")
        if inner in ("D", "S"):
            found.append("wrapped")
        if '"' in s or "'" in s:
            found.append("open")
        if set(inner) <= set("DSx,"):
            found.append("letters")
        return found

    return skeletons.map(of)


def _unquote(item: Column) -> Column:
    body = F.substring(item, F.lit(2), F.length(item) - 2)
    return (
        F.when(item.startswith('"'), F.replace(body, F.lit('""'), F.lit('"')))
        .when(item.startswith("'"), F.replace(body, F.lit("''"), F.lit("'")))
        .otherwise(item)
    )


def _items(field: Column) -> Column:
    return F.regexp_extract_all(field, F.lit(f"({ITEM})"))


def _readings(field: Column) -> dict[str, Column]:
    inner = _unquote(F.element_at(_items(field), 1))
    return {
        "list": _items(field),
        "open": F.regexp_extract_all(field, F.lit(f"({WORD})")),
        "wrapped": _items(inner),
        "letters": F.regexp_extract_all(field, F.lit(r"([\p{L}\p{N}])")),
    }


def unpack(
    df: DataFrame,
    key: str,
    fields: dict[str, Column],
    *,
    broadcast_limit: int = BROADCAST_SKELETONS,
) -> DataFrame:
    """One row per value: ``key``, ``field``, ``item_no`` from 1, ``item``.

    ``fields`` maps a packed column to the number of values it should hold (NULL: unknown). Of the readings
    that the skeleton's rules allow, the first that yields that number is taken, else the most literal one.
    Null, empty and value-free fields give no rows; repeated rows count once; other columns are ignored.
    """
    packed = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("field"),
                    F.col(f"`{name}`").alias("text"),
                    n.cast("int").alias("expected"),
                ) for name, n in fields.items()
            ]
        )
    )
    long = (
        df.select(F.col(key).alias("key"), packed.alias("p"))
        .select("key", "p.*")
        .filter(F.length(F.trim("text")) > 0)
        .dropDuplicates(["key", "field", "text", "expected"])
        .withColumn("skeleton", skeleton(F.col("text")))
    )
    kinds = long.select("skeleton").distinct()
    # the limit is checked on the data before the rules may be broadcast
    few = kinds.limit(broadcast_limit + 1).count() <= broadcast_limit
    rules = kinds.withColumn("rules", _rules("skeleton"))
    joined = long.join(F.broadcast(rules) if few else rules.hint("shuffle_hash"), "skeleton")
    readings = _readings(F.col("text"))
    chosen: Column | None = None
    for rule, found in readings.items():
        fits = F.array_contains("rules", rule) & (F.size(found) == F.col("expected"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    items = chosen.otherwise(readings["list"])
    return joined.select("key", "field", F.posexplode(items).alias("at", "raw")).select(
        F.col("key").alias(key), "field", (F.col("at") + 1).cast("int").alias("item_no"), _unquote(F.col("raw")).alias("item")
    )


def unpack_variants(df: DataFrame) -> DataFrame:
    """The packed lists of a variant overlap table: positions, alternative bases and (at most 50) accessions."""
    return unpack(
        df,
        "variant_id",
        {"positions": F.col("size"), "alt_bases": F.col("size"), "accession_ids": F.least(F.col("n_accessions"), F.lit(50))},
    )


def item_counts(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """How many values each field of each row of ``unpack`` output holds, as columns ``n_<field>``."""
    return df.groupBy(key).agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f"n_{f}") for f in fields])
