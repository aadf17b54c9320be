"""DNA sequences: complement, mutation, tokens, composition, position frequencies and consensus.

All of it is built-in string and array work in the JVM. A NULL sequence gives NULL, an empty one an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.operators.rank import first_rows
from terrasieve.plans.joins import join_same

BASES = ("A", "C", "G", "T")
#: Symbols of the character tokeniser and their ids.
TOKEN_IDS = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4, "P": -1}


def reverse_complement(seq: Column) -> Column:
    """Case is kept; symbols other than A, C, G, T stay."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def reverse_complement_segments(seq: Column, separator: str = "[SEP]") -> Column:
    """Segments complemented one by one in reverse order; one empty segment at the end is dropped."""
    parts = F.split(seq, "\\Q" + separator + "\\E")
    parts = F.when(
        F.try_element_at(parts, F.lit(-1)) == "",
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
    ).otherwise(parts)
    return F.array_join(F.reverse(F.transform(parts, reverse_complement)), separator)


def substitute(seq: Column, position: Column, base: Column) -> Column:
    """The sequence with one base replaced; positions count from 0, outside ones change nothing."""
    inside = (position >= 0) & (position < F.length(seq))
    return F.when(inside, F.overlay(seq, base, (position + 1).cast("int"), F.lit(1))).otherwise(seq)


def substitute_all(seq: Column, changes: Column) -> Column:
    """Several bases replaced; ``changes`` is an array of (position, base)."""
    return F.aggregate(changes, seq, lambda s, c: substitute(s, c["position"], c["base"]))


def alternatives(base: Column) -> Column:
    """The other bases in alphabetical order; all four for another symbol."""
    return F.array_except(F.array(*[F.lit(b) for b in BASES]), F.array(F.upper(base)))


def ungap(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def context(seq: Column, position: Column, half: int) -> Column:
    """The sequence around a position, cut at its ends; 0 keeps it whole."""
    if half == 0:
        return seq
    first = F.greatest(position - half, F.lit(0))
    return F.substring(seq, (first + 1).cast("int"), (F.least(position + half + 1, F.length(seq)) - first).cast("int"))


def token_ids(seq: Column, length: int) -> Column:
    """Fixed-length token ids; short sequences are padded, long ones cut, unknown symbols are N."""
    ids = F.create_map(*[F.lit(v) for k in TOKEN_IDS for v in (k, TOKEN_IDS[k])])
    letters = F.filter(F.split(F.rpad(F.upper(seq), length, "P"), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(TOKEN_IDS["N"])))


def variant_tokens(ref: Column, alt: Column, length: int) -> dict[str, Column]:
    """Token ids of both alleles on both strands."""
    return {
        "ref": token_ids(ref, length),
        "alt": token_ids(alt, length),
        "ref_rc": token_ids(reverse_complement(ref), length),
        "alt_rc": token_ids(reverse_complement(alt), length),
    }


def variant_index(ref: Column, alt: Column) -> Column:
    """Where two token arrays differ: the middle if it does, else the last place; -1 if nowhere."""
    differs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ref) - 1, F.lit(0))), lambda i: F.get(ref, i) != F.get(alt, i))
    middle = F.floor(F.size(ref) / 2).cast("int")
    return F.when(F.array_contains(differs, middle), middle).otherwise(F.coalesce(F.array_max(differs), F.lit(-1)))


def recode_chromosome(c: Column) -> Column:
    """X as -1, a number as itself, anything else NULL."""
    return F.when(c == "X", F.lit(-1)).otherwise(c.try_cast("int"))


def point_mutants(df: DataFrame, keys: Sequence[str], seq: str, positions: str) -> DataFrame:
    """(keys, position, ref, alt, mutant): every single substitution at the positions of the array column."""
    rows = df.select(
        *keys,
        F.col(seq).alias("s"),
        F.explode(positions).alias("position"),
    ).filter((F.col("position") >= 0) & (F.col("position") < F.length("s")))
    rows = rows.withColumn("ref", F.substring("s", (F.col("position") + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("alt", F.explode(alternatives(F.col("ref"))))
    return rows.select(*keys, "position", "ref", "alt", substitute(F.col("s"), F.col("position"), F.col("alt")).alias("mutant"))


def multi_mutants(df: DataFrame, keys: Sequence[str], seq: str, positions: str, size: int, limit: int = 50_000) -> DataFrame:
    """(keys, positions, alts, mutant): every combination of ``size`` positions and alternatives, the first ``limit`` per sequence in order.

    Combinations are grown inside the row from its few positions; the limit is the feature that bounds them.
    """
    order = F.array_sort(F.array_distinct(F.filter(positions, lambda p: (p >= 0) & (p < F.length(seq)))))
    rows = df.select(*keys, F.col(seq).alias("s"), order.alias("ps"), F.array().cast("array<int>").alias("chosen"))
    for _ in range(size):
        last = F.coalesce(F.try_element_at("chosen", F.lit(-1)), F.lit(-1))
        rows = rows.withColumn("p", F.explode("ps")).filter(F.col("p") > last).withColumn(
            "chosen",
            F.concat("chosen", F.array(F.col("p").cast("int"))),
        ).drop("p")
    rows = rows.withColumn("alts", F.array().cast("array<string>"))
    for i in range(size):
        ref = F.substring("s", F.get("chosen", F.lit(i)) + 1, F.lit(1))
        rows = rows.withColumn("a", F.explode(alternatives(ref))).withColumn("alts", F.concat("alts", F.array("a"))).drop("a")
    kept = first_rows(rows, keys, [F.col("chosen"), F.col("alts")], limit)
    changes = F.zip_with("chosen", "alts", lambda p, a: F.struct(p.alias("position"), a.alias("base")))
    return kept.select(*keys, F.col("chosen").alias("positions"), "alts", substitute_all(F.col("s"), changes).alias("mutant"))


def letters(df: DataFrame, group: Sequence[str], seq: str) -> DataFrame:
    """(group, position, base): one row per letter, upper case, positions from 0."""
    chars = F.filter(F.split(F.upper(F.col(seq)), ""), lambda c: c != "")
    return df.select(*group, F.posexplode(chars).alias("position", "base"))


def base_composition(df: DataFrame, group: Sequence[str], seq: str, gaps: bool = False) -> DataFrame:
    """Per group and position: percentages of A, T, G, C and N.

    Without ``gaps`` a short sequence counts as N and so does every other symbol; with ``gaps`` the shares leave
    gaps out and ``pct_gap`` is their own. Counts are combined before the shuffle.
    """
    rows = letters(df, group, seq).filter(F.col("position").isNotNull())
    is_ = lambda *bs: F.col("base").isin(*bs)
    n = lambda c: F.sum(c.cast("int"))
    counts = rows.groupBy(*group, "position").agg(
        *[n(is_(b)).alias(f"__{b}") for b in ("A", "T", "G", "C")],
        n(is_("-")).alias("__gap"),
        F.count(F.lit(1)).alias("__seen"),
    )
    known = F.col("__A") + F.col("__T") + F.col("__G") + F.col("__C")
    if gaps:
        whole = F.nullif(F.col("__seen") - F.col("__gap"), F.lit(0))
        pct = lambda c: F.coalesce(100.0 * c / whole, F.lit(0.0))
        return counts.select(
            *group,
            "position",
            *[pct(F.col(f"__{b}")).alias(f"pct_{b.lower()}") for b in ("A", "T", "G", "C")],
            pct(F.col("__seen") - F.col("__gap") - known).alias("pct_n"),
            (100.0 * F.col("__gap") / F.col("__seen")).alias("pct_gap"),
        )
    total = df.groupBy(*group).agg(F.count(seq).alias("__total"))
    joined = join_same(counts, total, group)
    share = lambda c: 100.0 * c / F.col("__total")
    return joined.select(
        *group,
        "position",
        *[share(F.col(f"__{b}")).alias(f"pct_{b.lower()}") for b in ("A", "T", "G", "C")],
        share(F.col("__total") - known).alias("pct_n"),
    )


def position_counts(df: DataFrame, group: Sequence[str], seq: str) -> DataFrame:
    """Position frequency matrix: per group and position the counts n_a, n_c, n_g, n_t, n_n; gaps are left out, unknown symbols are N."""
    rows = letters(df, group, seq).filter(F.col("base") != "-")
    n = lambda b: F.sum((F.col("base") == b).cast("int")).cast("long")
    known = [n(b).alias(f"n_{b.lower()}") for b in BASES]
    return rows.groupBy(*group, "position").agg(
        *known,
        F.sum((~F.col("base").isin(*BASES)).cast("int")).cast("long").alias("n_n"),
    )


def consensus(pfm: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group the string of each position's single most frequent base, N where several tie. A motif has a bounded length."""
    cs = [F.col(f"n_{b.lower()}") for b in BASES]
    top = F.greatest(*cs)
    ties = F.size(F.filter(F.array(*cs), lambda c: c == top))
    base = F.when(
        (ties == 1) & (top > 0),
        F.element_at(F.array(*[F.lit(b) for b in BASES]), F.array_position(F.array(*cs), top).cast("int")),
    ).otherwise("N")
    rows = pfm.select(*group, "position", base.alias("b"))
    return rows.groupBy(*group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "b"))), lambda s: s["b"]),
            "",
        ).alias("consensus")
    )


def pfm_difference(top: DataFrame, bottom: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of one matrix less those of another, position by position; a position that one lacks counts 0."""
    names = [f"n_{b}" for b in "acgtn"]
    b = bottom.select(*group, "position", *[F.col(n).alias(f"__{n}") for n in names])
    joined = top.join(b, [*group, "position"], "full")
    return joined.select(
        *group,
        "position",
        *[(F.coalesce(n, F.lit(0)) - F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in names],
    )


def majority_base(df: DataFrame, group: Sequence[str], seq: str, ties: Sequence[str] = ("A", "T", "G", "C", "N")) -> DataFrame:
    """(group, position, base, n): the most frequent base of each position; ties in the order given, then by letter."""
    counts = letters(df, group, seq).filter(F.col("base") != "-").groupBy(*group, "position", "base").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(t) for t in ties]), F.col("base"))
    return first_rows(counts, [*group, "position"], [F.col("n").desc(), F.when(place == 0, 99).otherwise(place), F.col("base")])


def alignment_quality(df: DataFrame, group: Sequence[str], aligned: str) -> DataFrame:
    """Per group: the share of gaps and the mean share of a column's commonest base; a column of gaps alone counts 0."""
    counts = letters(df, group, aligned).groupBy(*group, "position", "base").agg(F.count(F.lit(1)).alias("n"))
    columns = counts.groupBy(*group, "position").agg(
        F.sum("n").alias("all"),
        F.sum(F.when(F.col("base") == "-", F.col("n")).otherwise(0)).alias("gaps"),
        F.coalesce(F.max(F.when(F.col("base") != "-", F.col("n"))), F.lit(0)).alias("top"),
    )
    kept = F.coalesce(F.col("top") / F.nullif(F.col("all") - F.col("gaps"), F.lit(0)), F.lit(0.0))
    return columns.groupBy(*group).agg((100.0 * F.sum("gaps") / F.sum("all")).alias("gap_pct"), F.avg(kept).alias("conservation"))


def normalised_pwm(pfm: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts as shares of A, C, G, T; 0.25 each where there are none."""
    total = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    return pfm.select(
        *group,
        "position",
        *[F.when(total == 0, F.lit(0.25)).otherwise(F.col(f"n_{b}") / F.nullif(total, F.lit(0))).alias(f"p_{b}") for b in "acgt"],
    )


def motif_statistics(pwm: DataFrame, motif: str) -> DataFrame:
    """Per motif: length, share of G and C, and mean share of each base."""
    means = [F.avg(f"p_{b}").alias(f"mean_{b}") for b in "acgt"]
    gc = (F.sum(F.col("p_c") + F.col("p_g")) / F.sum(F.col("p_a") + F.col("p_c") + F.col("p_g") + F.col("p_t"))).alias("gc")
    return pwm.groupBy(motif).agg(F.count(F.lit(1)).alias("length"), gc, *means)


def pack_segments(df: DataFrame, group: Sequence[str], order: str, seq: str, longest: int, separator: str = "[SEP]") -> DataFrame:
    """(group, chunk, text): segments in order, joined into chunks of at most ``longest`` letters, none split unless it is longer by itself.

    The separator follows every segment of a chunk but its last. A group is one accession's selected regions.
    """
    parts = df.filter(F.col(seq).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, seq))).alias("ps"))
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"),
        F.array().cast("array<string>").alias("open"),
        F.lit(0).alias("n"),
    )

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x[seq])
        fits = (F.size(acc["open"]) == 0) | (acc["n"] + n <= longest)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(fits, F.concat(acc["open"], F.array(x[seq]))).otherwise(F.array(x[seq])).alias("open"),
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
        )

    chunks = F.aggregate(
        "ps",
        start,
        step,
        lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda c: F.size(c) > 0),
    )
    return parts.select(*group, F.posexplode(chunks).alias("chunk", "c")).select(
        *group,
        "chunk",
        F.array_join("c", separator).alias("text"),
    )
