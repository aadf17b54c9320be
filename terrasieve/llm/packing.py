"""Filling fixed-capacity containers with texts, keeping related texts together.

Texts are measured in tokens of a public tokenizer and packed by lexical retrieval: in every shard of an inverted
index a seed text asks BM25 for its unused neighbours, and these fill its container greedily, best first; room
room that no neighbour fits goes to the largest unused texts of the shard that do. Shards hold like texts: a tree of
cuts, fitted on the sketches of a bounded sample, sends every text to a leaf, and texts are divided into shards in the
order of the leaves. What a first pass leaves in containers with room is sharded anew, by the texts' most telling terms,
and packed by retrieval once more. A shard's size is bounded and tasks hold several, so shards, not tasks, grow in
number with the data.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasieve.plans.scratch import Scratch

#: Where the vocabulary of a byte-level BPE lies, one rank a line; a parameter, never copied into the package.
VOCABULARY = os.environ.get("TERRASIEVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed pattern that belongs to that vocabulary: text is split by it before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Terms are hashed into so many buckets, which bounds the table of document frequencies at 2 MB.
BUCKETS = 1 << 18
#: Texts in a shard, and the query terms of a seed.
SHARD_TEXTS, QUERY_TERMS = 20_000, 12
#: Numbers in a text's sketch, levels of the tree that orders texts, and texts that it is fitted on.
SKETCH, TREE_DEPTH, SAMPLE_TEXTS = 64, 8, 8_000
#: Containers emptier than this after the first pass are opened again and their texts packed once more.
WELL_FILLED = 0.98
K1, B = 1.2, 0.75
#: Pieces, and stretches of at most so many letters, that a task holds with what was found for them.
_CACHED_PIECES, _CACHED_LETTERS = 300_000, 60
#: A piece's term plus one has so many bits.
_TERM_BITS = 20


@cache
def _tokenizer(path: str) -> tuple[tiktoken.Encoding, regex.Pattern]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(PATTERN)


class _Uneven(Exception):
    """A stretch between single spaces that is empty or begins or ends with another blank."""


class TokenCounter:
    """Tokens and terms of texts. Merges never cross the pattern's pieces, so a text's count is the sum over its pieces, each merged once.

    A piece ends before every space that stands alone between two letters or marks, and neither side's pieces depend on
    the other's; so a text is taken apart at its spaces and the pattern is asked once for each stretch between two. A
    text in which blanks follow each other there goes through the pattern as a whole. A piece is one number: its tokens
    above, its term plus one in the lowest bits.
    """

    def __init__(self, path: str):
        self.encoding, self.pattern = _tokenizer(path)
        self.known: dict[str, int] = {}
        self.stretches = _Stretches(self)

    def _piece(self, piece: str) -> int:
        if len(self.known) > _CACHED_PIECES:
            self.known.clear()
        word = piece.strip().lower()
        term = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS if len(word) > 1 and word[0].isalpha() else -1
        found = self.known[piece] = len(self.encoding.encode_ordinary(piece)) << _TERM_BITS | term + 1
        return found

    def pieces(self, text: str) -> list[int]:
        known, new = self.known, self._piece
        return [known.get(p) or new(p) for p in self.pattern.findall(text)]

    def _numbers(self, text: str) -> list[int]:
        head, *others = text.split(" ")
        if not others or head[-1:].isspace() or others[-1].isspace():
            return self.pieces(text)
        end = " " + others.pop() if text[-1].isspace() else ""  # blanks that end a text are apart from those within
        try:
            found = self.pieces(head)
            found.extend(chain.from_iterable(map(self.stretches.__getitem__, others)))
        except _Uneven:
            return self.pieces(text)
        return found + self.pieces(end) if end else found

    def analyse(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(tokens, terms, counts): the size of a text and its hashed terms, ascending, with their frequencies."""
        numbers = np.array(self._numbers(text), np.int64)
        terms = numbers & ((1 << _TERM_BITS) - 1)
        terms.sort()
        terms = terms[terms.searchsorted(1) :]
        edge = np.ones(len(terms) + 1, bool)
        np.not_equal(terms[1:], terms[:-1], out=edge[1:-1])
        at = edge.nonzero()[0]
        return int((numbers >> _TERM_BITS).sum()), (terms[at[:-1]] - 1).astype(np.int32), (at[1:] - at[:-1]).astype(np.int32)


class _Stretches(dict):
    """The pieces of a space and what follows it up to the next one."""

    def __init__(self, counter: TokenCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        if not stretch or stretch[0].isspace() or stretch[-1].isspace():
            raise _Uneven
        found = tuple(self.counter.pieces(" " + stretch))
        if len(stretch) <= _CACHED_LETTERS:
            if len(self) > _CACHED_PIECES:
                self.clear()
            self[stretch] = found
        return found


def analysed(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens, terms, counts) of every text with at least one token; whole texts are read."""
    source = docs.select(key, text).filter(F.length(text) > 0)
    schema = T.StructType(
        [
            source.schema[0],
            T.StructField("tokens", T.LongType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            found = [counter.analyse(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([t.tobytes() for _, t, _ in found], pa.binary()),
                    pa.array([c.tobytes() for _, _, c in found], pa.binary()),
                ],
                names=[key, "tokens", "terms", "counts"],
            )

    return source.mapInArrow(measure, schema).filter("tokens > 0")


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of all texts each term bucket occurs; a fixed number of buckets comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            terms = np.frombuffer(b"".join(v.as_py() for v in batch.column(0)), np.int32)
            total += np.bincount(terms, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    rows = texts.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _telling_term(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, shared: np.ndarray) -> int:
    """A text's term of highest weight that other texts have too, or -1."""
    t = terms[shared[terms]]
    return int(t[np.argmax(counts[shared[terms]] * idf[t])]) if len(t) else -1


def sketches(terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """A unit vector of ``SKETCH`` numbers a text: its weighted terms, each along a direction of random signs, summed."""
    out = np.zeros((len(terms), SKETCH), np.float32)
    for a in range(0, len(terms), 500):
        sizes = [len(t) for t in terms[a : a + 500]]
        if not sum(sizes):
            continue
        t = np.concatenate(terms[a : a + 500]).astype(np.uint64)
        tf = np.concatenate(counts[a : a + 500]).astype(np.float32)
        with np.errstate(over="ignore"):
            mixed = (t + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        signs = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
        signs *= (idf[t.astype(np.int64)] * tf / (tf + K1))[:, None]
        filled = [i for i, n in enumerate(sizes) if n]
        begins = (np.cumsum(sizes) - sizes)[filled]
        out[a + np.array(filled)] = np.add.reduceat(signs, begins, axis=0)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-9)[:, None]


def fit_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts) of a binary tree of ``TREE_DEPTH`` levels: a node cuts its sketches across their widest direction, where the middle half has its widest gap."""
    nodes = 2**TREE_DEPTH - 1
    directions, cuts = np.zeros((nodes, SKETCH), np.float32), np.zeros(nodes, np.float32)
    members = {0: np.arange(len(x))}
    for node in range(nodes):
        own = members.pop(node, np.zeros(0, np.int64))
        if len(own) > 1:
            spread = x[own] - x[own].mean(axis=0)
            d = spread[np.argmax(np.einsum("ij,ij->i", spread, spread))]
            for _ in range(10):
                d = np.einsum("i,ij->j", np.einsum("ij,j->i", spread, d), spread)
                d = d / max(float(np.sqrt((d * d).sum())), 1e-9)
            at = np.sort(np.einsum("ij,j->i", x[own], d))
            middle = at[len(at) // 4 : max(3 * len(at) // 4, len(at) // 4 + 2)]
            g = int(np.argmax(np.diff(middle)))
            directions[node], cuts[node] = d, (middle[g] + middle[g + 1]) / 2
        right = np.einsum("ij,j->i", x[own], directions[node]) > cuts[node]
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return directions, cuts


def leaves(x: np.ndarray, directions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each sketch, numbered from left to right."""
    node = np.zeros(len(x), np.int64)
    for _ in range(TREE_DEPTH):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, directions[node]) > cuts[node])
    return node - len(cuts)


class Shard:
    """An inverted index over a bounded number of texts, from which texts are taken until none is left."""

    def __init__(
        self,
        sizes: np.ndarray,
        terms: list[np.ndarray],
        counts: list[np.ndarray],
        lengths: np.ndarray,
        idf: np.ndarray,
        average: float,
    ):
        self.sizes, n = sizes, len(sizes)
        of = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate([*terms, np.zeros(0, np.int32)]).astype(np.int64)
        tf = np.concatenate([*counts, np.zeros(0, np.int32)]).astype(np.float64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[of] / average))
        self.of_text = np.split(np.arange(len(term)), np.cumsum([len(t) for t in terms])[:-1]) if n else []
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.posting, self.posting_weight = of[order], weight[order]
        self.names, self.first = np.unique(term[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.free = np.ones(n, bool)
        self.by_size = np.argsort(sizes, kind="stable")
        self.sorted_sizes = sizes[self.by_size]
        self.below = np.arange(n + 1)  # of each place in size order the nearest free one at or before it, shifted by one

    def take(self, i: int) -> None:
        self.free[i] = False

    def neighbours(self, seed: int, room: int) -> np.ndarray:
        """Unused texts that share a query term with the seed and fit, by BM25, best first."""
        own = self.of_text[seed]
        if not len(own):
            return np.zeros(0, np.int64)
        top = own[np.argsort(-self.weight[own], kind="stable")[:QUERY_TERMS]]
        at = np.searchsorted(self.names, self.term[top])
        spans = [slice(self.first[a], self.first[a + 1]) for a in at]
        found = np.concatenate([self.posting[s] for s in spans])
        score = np.bincount(found, weights=np.concatenate([self.posting_weight[s] for s in spans]), minlength=len(self.sizes))
        usable = np.flatnonzero((score > 0) & self.free & (self.sizes <= room))
        return usable[np.lexsort((usable, -score[usable]))]

    def largest(self, room: int) -> int:
        """The largest unused text of at most ``room`` tokens, or -1."""
        at = int(np.searchsorted(self.sorted_sizes, room, side="right"))
        path = []
        while at > 0:
            if self.below[at] != at:
                path.append(at)
                at = int(self.below[at])
            elif not self.free[self.by_size[at - 1]]:
                self.below[at] = at - 1
            else:
                break
        for p in path:
            self.below[p] = at
        return int(self.by_size[at - 1]) if at > 0 else -1


def fill_containers(shard: Shard, capacity: int) -> list[list[int]]:
    """Containers of text numbers: the largest unused text seeds each, its neighbours follow, then what else fits."""
    out = []
    for seed in shard.by_size[::-1]:
        if not shard.free[seed]:
            continue
        shard.take(seed)
        held, room = [int(seed)], capacity - int(shard.sizes[seed])
        if room > 0:
            near = shard.neighbours(int(seed), room)
            while len(near):
                i = int(near[0])
                shard.take(i)
                held.append(i)
                room -= int(shard.sizes[i])
                near = near[1:][shard.sizes[near[1:]] <= room]
        while room > 0 and (i := shard.largest(room)) >= 0:
            shard.take(i)
            held.append(i)
            room -= int(shard.sizes[i])
        out.append(held)
    return out


def pack_containers(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    capacity: int = 2048,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(key, part, token_start, n_tokens, seed, seed_part): every token of every text in one container, named by its seed.

    A text longer than ``capacity`` is divided into parts that fill containers of their own, and a last part that
    is packed as the others are; no other text is divided. Null and empty texts have no tokens and no container.
    Keys (longs) must be unique; a null key is packed too but can't be told from other null keys. Counts of terms
    cover all texts. Jobs run here: the texts are analysed once into a written table, and so are the results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = scratch.write(analysed(docs, key, text, vocabulary), "analysed")
    stats = texts.agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("average")).first()
    n, average = stats["n"], float(stats["average"] or 1.0)
    df = document_frequencies(texts)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    known = spark.sparkContext.broadcast((idf, df > 1))  # 1.3 MB, whatever the size of the data
    whole = F.floor((F.col("tokens") - 1) / capacity)
    full = texts.filter(F.col("tokens") > capacity).select(
        F.col(key),
        F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part"),
    ).select(
        key, F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"), F.col(key).alias("seed"), F.col("part").cast("int").alias("seed_part")
    )
    rest = texts.select(
        key,
        whole.cast("int").alias("part"),
        (whole * capacity).alias("token_start"),
        (F.col("tokens") - whole * capacity).alias("n_tokens"),
        "tokens",
        "terms",
        "counts",
    )
    item = T.StructType([*rest.schema.fields, T.StructField("leaf", T.LongType()), T.StructField("term", T.IntegerType())])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = ([np.frombuffer(v.as_py(), np.int32) for v in batch.column(c)] for c in ("terms", "counts"))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in sketches(terms, counts, known.value[0])])], names=["v"])

    some = texts.orderBy(F.xxhash64(key), key).limit(SAMPLE_TEXTS).select("terms", "counts")
    vectors = [np.frombuffer(r["v"], np.float32) for r in some.mapInArrow(sketched, "v binary").collect()]
    tree = fit_tree(np.array(vectors).reshape(-1, SKETCH))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shared = known.value
        for batch in batches:
            terms, counts = ([np.frombuffer(v.as_py(), np.int32) for v in batch.column(c)] for c in ("terms", "counts"))
            leaf = leaves(sketches(terms, counts, weights), *tree)
            telling = [_telling_term(t, c, weights, shared) for t, c in zip(terms, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf), pa.array(telling, pa.int32())],
                names=[*batch.schema.names, "leaf", "term"],
            )

    out_schema = T.StructType(
        [
            *item.fields,
            T.StructField("seed", rest.schema[0].dataType),
            T.StructField("seed_part", T.IntegerType()),
            T.StructField("filled", T.DoubleType()),
        ]
    )

    def packed(last: bool):  # noqa: ANN202
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, _ = known.value
            held: list[pa.RecordBatch] = []
            for batch in batches:
                while batch.num_rows:
                    room = SHARD_TEXTS - sum(b.num_rows for b in held)
                    held.append(batch.slice(0, room))
                    batch = batch.slice(room)
                    if sum(b.num_rows for b in held) == SHARD_TEXTS:
                        yield _pack(held, weights, average, capacity, last)
                        held = []
            if held:
                yield _pack(held, weights, average, capacity, last)

        return pack

    most = int(spark.conf.get("spark.sql.shuffle.partitions"))  # tasks; what is sampled for their ranges is bounded so
    spread = F.xxhash64(key, "part")  # divides the texts of a term that very many share

    def sharded(rows: DataFrame, texts: int, first: str, second: str) -> DataFrame:
        order = [F.col(first), F.col(second), spread]
        return rows.repartitionByRange(min(max(1, math.ceil(texts / SHARD_TEXTS)), most), *order).sortWithinPartitions(*order)

    # written, as ranges are found by a pass of their own over the rows to be divided
    signed = sharded(scratch.write(rest.mapInArrow(sign, item), "signed"), n, "leaf", "term")
    first = scratch.write(signed.mapInArrow(packed(False), out_schema), "first")
    done = first.filter(F.col("filled") >= WELL_FILLED)
    open_ = first.filter(F.col("filled") < WELL_FILLED).select(*item.names)
    again = sharded(open_, open_.count(), "term", "leaf").mapInArrow(packed(True), out_schema)
    columns = [key, "part", "token_start", "n_tokens", "seed", "seed_part"]
    return full.unionByName(done.select(*columns)).unionByName(again.select(*columns))


def _pack(batches: list[pa.RecordBatch], idf: np.ndarray, average: float, capacity: int, last: bool) -> pa.RecordBatch:
    """Packs one shard; rows of well-filled containers no longer carry their terms."""
    batch = pa.concat_batches(batches)
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    terms = [np.frombuffer(v.as_py(), np.int32) for v in get("terms")]
    counts = [np.frombuffer(v.as_py(), np.int32) for v in get("counts")]
    sizes = get("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
    containers = fill_containers(
        Shard(sizes, terms, counts, get("tokens").to_numpy(zero_copy_only=False).astype(np.float64), idf, average),
        capacity,
    )
    seed, filled = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.float64)
    for held in containers:
        seed[held] = held[0]
        filled[held] = sizes[held].sum() / capacity
    keep = ~((filled >= WELL_FILLED) | last)
    void = lambda name: pa.array([v.as_py() if k else None for v, k in zip(get(name), keep, strict=True)], pa.binary())
    columns = {
        name: batch.column(i) for i, name in enumerate(batch.schema.names)
    } | {"terms": void("terms"), "counts": void("counts")}
    names = list(columns)
    at = pa.array(seed)
    return pa.RecordBatch.from_arrays(
        [*columns.values(), batch.column(0).take(at), get("part").take(at), pa.array(filled)],
        names=[*names, "seed", "seed_part", "filled"],
    )
