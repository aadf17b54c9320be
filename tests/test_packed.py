from __future__ import annotations

import pytest

from terrasieve.operators.packed import item_counts, unpack_variants

SCHEMA = "variant_id long, positions string, size int, alt_bases string, n_accessions int, accession_ids string"
CASES = [
    ("1;2;3", 3, ["1", "2", "3"]),
    ("1 | 2,3\t4", 4, ["1", "2", "3", "4"]),
    ('"1";"2"', 2, ["1", "2"]),
    ("['1', '2']", 2, ["1", "2"]),
    (";1;;2;", 2, ["1", "2"]),
    ('"1; 2; 3"', 3, ["1", "2", "3"]),
    ('"""1"";""2"""', 2, ["1", "2"]),
    ('"a, b" c', 2, ["a, b", "c"]),
    ('"say ""x"" now",y', 2, ['say "x" now', "y"]),
    ("'it''s'", 1, ["it's"]),
    ("A - B", 2, ["A", "B"]),
    ("A-1_b.2", 1, ["A-1_b.2"]),
    ("1;2;3, …", 3, ["1", "2", "3"]),
    ("'1;2", 2, ["1", "2"]),
]


@pytest.mark.parametrize(("field", "n", "want"), CASES)
def test_notations(spark, field, n, want):
    df = spark.createDataFrame([(1, field, n, None, None, None)], SCHEMA)
    rows = sorted((r["item_no"], r["item"]) for r in unpack_variants(df).collect())
    assert rows == list(enumerate(want, 1))


def test_letters_without_delimiters_and_whole_words(spark):
    df = spark.createDataFrame(
        [
            (1, None, 3, "GCG", None, None),
            (2, None, 1, "GCG", None, None),
            (3, None, 3, '"ACG"', None, None),
            (4, None, 3, "CGA;C;A", None, None),
        ],
        SCHEMA,
    )
    got = {}
    for r in unpack_variants(df).collect():
        got.setdefault(r["variant_id"], {})[r["item_no"]] = r["item"]
    assert got == {1: {1: "G", 2: "C", 3: "G"}, 2: {1: "GCG"}, 3: {1: "A", 2: "C", 3: "G"}, 4: {1: "CGA", 2: "C", 3: "A"}}


def test_nothing_held_repeats_and_clashing_columns(spark):
    rows = [(1, "", 1, "  ", 1, "[]"), (2, ";", 1, None, None, None), (3, "7;8", 2, "A", 1, "x"), (3, "7;8", 2, "A", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*",
        "1 as key",
        "'f' as field",
        "2 as item_no",
        "'z' as item",
        "3 as skeleton",
        "4 as rules",
    )
    out = unpack_variants(df)
    assert out.columns == ["variant_id", "field", "item_no", "item"]
    assert sorted(map(tuple, out.collect())) == [
        (3, "accession_ids", 1, "x"),
        (3, "alt_bases", 1, "A"),
        (3, "positions", 1, "7"),
        (3, "positions", 2, "8"),
    ]
    assert unpack_variants(df.limit(0)).collect() == []
    assert item_counts(out, "variant_id", ["positions"]).collect()[0]["n_positions"] == 2


def test_null_count_and_long_field(spark):
    long = ";".join(str(i) for i in range(20_000))
    df = spark.createDataFrame([(1, long, None, None, 60, ",".join("b%d" % i for i in range(50)))], SCHEMA)
    got = unpack_variants(df).groupBy("field").count().collect()
    assert {r["field"]: r["count"] for r in got} == {"positions": 20_000, "accession_ids": 50}


def test_very_long_quoted_value_and_unpaired_quote(spark):
    word = "ab, " * 50_000
    df = spark.createDataFrame(
        [(1, None, None, None, 1, f'"{word}"'), (2, None, None, None, 3, '"' + "c" * 100_000 + ";d;e")],
        SCHEMA,
    )
    got = {(r["variant_id"], r["item_no"]): len(r["item"]) for r in unpack_variants(df).collect()}
    assert got == {(1, 1): 200_000, (2, 1): 100_000, (2, 2): 1, (2, 3): 1}


def test_rules_joined_without_broadcast(spark):
    from pyspark.sql import functions as F

    from terrasieve.operators.packed import unpack

    df = spark.createDataFrame([(1, "a;b"), (2, "a b"), (3, '"a;b"')], "k long, f string")
    out = unpack(df, "k", {"f": F.lit(2)}, broadcast_limit=1)
    assert out.count() == 6
