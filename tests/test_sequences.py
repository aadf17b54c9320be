from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasieve.operators import sequence, vectors
from terrasieve.queries import genetics
from tests.comparing import connection, same_rows


def one(spark, column, **values):
    df = spark.createDataFrame(
        [tuple(values.values())],
        ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()),
    )
    return df.select(column.alias("x")).collect()[0]["x"]


@settings(max_examples=15, deadline=None)
@given(st.text("ACGTNacgtn", max_size=40))
def test_reverse_complement_is_an_involution(spark, s):
    rc = sequence.reverse_complement(F.col("s"))
    assert one(spark, sequence.reverse_complement(rc), s=s) == s


def test_complement_cases(spark):
    assert one(spark, sequence.reverse_complement(F.col("s")), s="aCGNx-") == "-xNCGt"
    assert one(spark, sequence.reverse_complement(F.col("s")), s=None) is None
    assert one(spark, sequence.reverse_complement_segments(F.col("s")), s="AAC[SEP]GT[SEP]") == "AC[SEP]GTT"


def test_substitution_outside_changes_nothing(spark):
    for p, want in ((0, "GCG"), (2, "ACG"), (3, "ACG"), (-1, "ACG")):
        assert one(spark, sequence.substitute(F.col("s"), F.col("p"), F.lit("G")), s="ACG", p=p) == want
    assert one(spark, F.array_join(sequence.alternatives(F.col("s")), ""), s="N") == "ACGT"


def test_tokens_pad_cut_and_unknown(spark):
    assert one(spark, sequence.token_ids(F.col("s"), 6), s="acgtx") == [0, 1, 2, 3, 4, -1]
    assert one(spark, sequence.token_ids(F.col("s"), 2), s="ACGT") == [0, 1]
    same = sequence.variant_index(sequence.token_ids(F.col("s"), 4), sequence.token_ids(F.col("s"), 4))
    assert one(spark, same, s="ACGT") == -1
    assert one(spark, sequence.recode_chromosome(F.col("s")), s="X") == -1


def test_multi_mutants_are_counted_and_limited(spark):
    df = spark.createDataFrame([(1, "ACGT", [0, 2, 3, 9, 2])], "id int, s string, ps array<int>")
    assert sequence.multi_mutants(df, ["id"], "s", "ps", 2).count() == 3 * 9
    assert sequence.multi_mutants(df, ["id"], "s", "ps", 3).count() == 27
    first = sequence.multi_mutants(df, ["id"], "s", "ps", 2, limit=1).collect()[0]
    assert (list(first["positions"]), first["mutant"]) == ([0, 2], "CCAT")


def test_short_sequences_count_as_n(spark):
    df = spark.createDataFrame([("g", "AC"), ("g", "A"), ("g", None)], "g string, s string")
    got = {r["position"]: r for r in sequence.base_composition(df, ["g"], "s").collect()}
    assert got[0]["pct_a"] == 100.0 and got[1]["pct_c"] == 50.0 and got[1]["pct_n"] == 50.0


def test_consensus_and_empty(spark):
    df = spark.createDataFrame([("g", "ACT"), ("g", "AGT"), ("g", "-")], "g string, s string")
    pfm = sequence.position_counts(df, ["g"], "s")
    assert sequence.consensus(pfm, ["g"]).collect()[0]["consensus"] == "ANT"
    assert sequence.consensus(pfm.limit(0), ["g"]).collect() == []


def test_segments_pack_without_splitting(spark):
    rows = [("a", i, "A" * n) for i, n in enumerate([3, 4, 9, 2, 2, 2])] + [("b", 0, None)]
    got = sequence.pack_segments(
        spark.createDataFrame(rows, "g string, i int, s string"),
        ["g"],
        "i",
        "s",
        7,
    ).orderBy("chunk").collect()
    assert [[len(x) for x in r["text"].split("[SEP]")] for r in got] == [[3, 4], [9], [2, 2, 2]]


def test_pooling_and_places(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 5.0]), ("a", 2, [3.0, 1.0])], "g string, i int, v array<double>")
    assert vectors.pooled(df, ["g"], "v").collect()[0]["v"] == [3.0, 5.0]
    assert vectors.pooled(df, ["g"], "v", "mean").collect()[0]["v"] == [2.0, 3.0]
    assert vectors.flattened(df, ["g"], "i", "v").collect()[0]["v"] == [1.0, 5.0, 3.0, 1.0]
    out = df.select(vectors.replace_row(F.array(F.col("v"), F.col("v")), F.lit(1), F.array(F.lit(0.0))).alias("m"))
    assert out.collect()[0]["m"] == [[1.0, 5.0], [0.0]]


@pytest.fixture(scope="module")
def sequence_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sequences")
    seqs = ["ACGT" * 40 + "A", "ACGT" * 40 + "G", "ACGGT" * 59 + "NT", "C", "GA", "TTA" * 33]
    docs = [f">acc{i}|chr{i % 3 + 1}|{100 + i}\n{s}\n" for i, s in enumerate(seqs)]
    pq.write_table(pa.table({"doc_id": list(range(len(docs))), "text": docs}), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["token_checksum", "variant_places", "double_mutants_all"])
def test_whole_sequences_agree_with_sql(spark, sequence_folder, name):
    same_rows(genetics.QUERIES[name](spark, sequence_folder), connection(sequence_folder), genetics.ORACLES[name])


def test_checksum_and_place_see_letters_after_120(spark, sequence_folder):
    tokens = {r["doc_id"]: r["tokens"] for r in genetics.token_checksum(spark, sequence_folder).collect()}
    assert tokens[0] != tokens[1]
    at = {r["doc_id"]: r["at"] for r in genetics.variant_places(spark, sequence_folder).collect()}
    assert (at[0], at[2], at[3]) == (160, 148, -1)


def test_double_mutants_of_every_chromosome(spark, sequence_folder):
    found = {r["doc_id"] for r in genetics.double_mutants(spark, sequence_folder).select("doc_id").distinct().collect()}
    assert found == {0, 1, 2, 5}
