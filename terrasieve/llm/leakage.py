"""Evaluation texts leaking into training text.

Texts are reduced to streams of letters and digits, so that case, punctuation, spacing, markup, entities,
invisible characters and Unicode form don't matter. By the q-gram lemma a passage of length n found with at most
k edits shares at least n - q + 1 - k q of its q-grams, all on at most k + 1 neighbouring diagonals: shared
q-grams are counted in overlapping diagonal bands, bands that reach the bound are retained, and an edit alignment
within the band decides. Only the evaluation side is indexed, by tasks; each document is read once, by one task.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Letters of evaluation items indexed together; a larger set goes through the documents in such blocks.
BLOCK_LETTERS = 10_000_000
#: Lengths of q-grams; an item is indexed with the longest that its shortest passage allows.
GRAMS = (16, 12, 8, 6, 4, 3, 2, 1)
#: Letters of documents hashed at once in a task.
BATCH_LETTERS = 2_000_000
#: Shared q-grams counted at once; repetitive texts have many.
SLICE_HITS = 2_000_000

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_SEPARATOR, _LETTER, _DROPPED = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 21


def _class_of(c: str) -> int:
    if c.isalnum():
        return _LETTER
    # soft hyphens, zero-width marks and marks that couldn't be composed vanish; all else separates words
    return _DROPPED if unicodedata.category(c) in ("Cf", "Mn", "Me") else _SEPARATOR


_classes: list[np.ndarray] = []


def _classify(codes: np.ndarray) -> np.ndarray:
    if not _classes:
        _classes.append(
            np.array([_class_of(chr(i)) if not 0xD800 <= i < 0xE000 else _SEPARATOR for i in range(0x10000)], np.uint8)
        )
    table = _classes[0]
    if len(codes) and int(codes.max()) >= len(table):
        kinds = table[np.minimum(codes, len(table) - 1)]
        high = np.flatnonzero(codes >= len(table))
        found, back = np.unique(codes[high], return_inverse=True)
        kinds[high] = np.array([_class_of(chr(int(c))) for c in found], np.uint8)[back]
        return kinds
    return table[codes]


def canonical(text: str) -> str:
    """The text with entities resolved, markup taken out, compatibility forms composed and case folded."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.casefold() if not text.isascii() else text.lower()


def stream(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, gaps): the text's letters and digits, and whether something separates each from the one before (one entry more, for the end)."""
    codes = np.frombuffer(canonical(text).encode("utf-32-le", "replace"), np.uint32)
    kinds = _classify(codes)
    kept = codes[kinds != _DROPPED]
    letters = kinds[kinds != _DROPPED] == _LETTER
    at = np.flatnonzero(letters)
    gaps = np.ones(len(at) + 1, bool)
    if len(at) > 1:
        gaps[1:-1] = np.diff(at) > 1
    return kept[at], gaps


def item_words(text: str) -> list[str]:
    """The item's words as written between white space, reduced to letters and digits; others don't count."""
    plain = canonical(text)
    words = ("".join(c for c in w if c.isalnum()) for w in plain.split())
    return [w for w in words if w]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q symbols from each place on; the last q - 1 places run beyond the end and are left out."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width, rest = codes.astype(np.uint64) * _ODD, 1, q
        total, done, factor = None, 0, _ODD
        while rest:
            if rest & 1:
                part = power[done:]
                total = part.copy() if total is None else total[: len(part)] * factor + part[: len(total)]
                done += width
            rest >>= 1
            if rest:
                power = power[:-width] * factor + power[width:]
                width *= 2
                factor = factor * factor
        mixed = total[:n]
        return mixed ^ (mixed >> np.uint64(29))


@dataclass
class ItemIndex:
    """q-grams of items of one class: hashes with the items and places they stand at, and each item's words."""

    q: int
    bound: np.ndarray  # least number of shared q-grams of each item
    hashes: np.ndarray
    first: np.ndarray  # into places, one entry more
    item_of: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # whether any q-gram has these top bits
    streams: list[np.ndarray]
    ends: list[np.ndarray]  # where each word ends in its stream
    keys: list

    @classmethod
    def build(cls, q: int, items: list[tuple], edits: int) -> ItemIndex:
        """``items`` are (key, letters, ends of words, letters of the shortest passage)."""
        keys, streams, ends, shortest = (list(x) for x in zip(*items, strict=True))
        grams = [gram_hashes(s, q) for s in streams]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item_of = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.zeros(0, np.int32)])
        order = np.argsort(every, kind="stable")
        hashes, first = np.unique(every[order], return_index=True)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        bound = np.array([max(1, n - q + 1 - edits * q) for n in shortest], np.int64)
        return cls(q, bound, hashes, np.append(first, len(order)), item_of[order], place[order], maybe, streams, ends, keys)


def build_indexes(items: list[tuple], words: int, edits: int) -> list[ItemIndex]:
    """Indexes of (key, text) items, one for each length of q-gram that some of them need."""
    classes: dict[int, list[tuple]] = {}
    for key, text in items:
        w = item_words(text or "")
        if len(w) < words:
            continue
        e = np.cumsum([len(x) for x in w])
        shortest = int((e[words - 1 :] - np.concatenate([[0], e[:-1]])[: len(e) - words + 1]).min())
        # the longest q-gram for which even the shortest passage keeps a bound of at least 1
        q = next((g for g in GRAMS if g <= (shortest + 1) // (edits + 1) - 1), 1)
        classes.setdefault(q, []).append((key, np.frombuffer("".join(w).encode("utf-32-le"), np.uint32), e, shortest))
    return [ItemIndex.build(q, rows, edits) for q, rows in sorted(classes.items())]


def _shared(index: ItemIndex, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, item, item place) of every q-gram that a text shares with an item, in slices of bounded size."""
    h = gram_hashes(codes, index.q)
    near = np.flatnonzero(index.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(near) or not len(index.hashes):
        return
    at = np.minimum(np.searchsorted(index.hashes, h[near]), len(index.hashes) - 1)
    exact = index.hashes[at] == h[near]
    near, at = near[exact], at[exact]
    n = index.first[at + 1] - index.first[at]
    slice_of = np.cumsum(n) // SLICE_HITS
    for cut in np.split(np.arange(len(near)), np.flatnonzero(np.diff(slice_of)) + 1):
        if len(cut):
            m = n[cut]
            entry = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index.first[at[cut]], m)
            yield np.repeat(near[cut], m), index.item_of[entry].astype(np.int64), index.place[entry].astype(np.int64)


def _counted(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows, counts = rows[order], counts[order]
    starts = np.concatenate([[0], np.flatnonzero(np.any(rows[1:] != rows[:-1], axis=1)) + 1])
    return rows[starts], np.add.reduceat(counts, starts)


def _bands(
    hits: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]],
    bound: np.ndarray,
    edits: int,
) -> Iterator[tuple[int, int, int]]:
    """(doc, item, first diagonal) of bands 2(k + 1) wide, each half over the next, in which (doc, item, diagonal) hits reach the item's bound."""
    half = edits + 1
    parts = []
    for doc, item, diagonal in hits:
        # a diagonal lies in the band that starts here and in the one before
        slot = np.concatenate([diagonal // half, diagonal // half - 1])
        rows = np.stack([np.tile(doc, 2), np.tile(item, 2), slot], axis=1)
        parts.append(_counted(rows, np.ones(len(rows), np.int64)))
    if not parts:
        return
    rows, counts = parts[0] if len(parts) == 1 else _counted(
        np.concatenate([r for r, _ in parts]),
        np.concatenate([c for _, c in parts]),
    )
    for i in np.flatnonzero(counts >= bound[rows[:, 1]]):
        d, t, s = rows[i]
        yield int(d), int(t), int(s) * half


def longest_run(
    item: np.ndarray, ends: np.ndarray, codes: np.ndarray, gaps: np.ndarray, diagonal: int, width: int, edits: int
) -> int:
    """The most consecutive whole words of an item that a text shows within a band of diagonals with at most ``edits`` edits.

    An alignment starts at every word of the item on every diagonal, and is carried as far as its edits allow: with
    each edit it goes on along its diagonal past a changed letter, or to a neighbouring one past a dropped or an
    inserted letter, and from there as far as letters agree. A word at either end that is only part of a longer one
    of the text doesn't count.
    """
    n = len(item)
    at = diagonal + np.arange(width)[:, None] + np.arange(n)[None, :]
    inside = (at >= 0) & (at < len(codes))
    equal = inside & (codes[np.clip(at, 0, len(codes) - 1)] == item[None, :])
    # to which place of the item letters agree from each place on
    stop = np.full((width, n + 1), n)
    stop[:, :n] = np.where(equal, n, np.arange(n))
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    row = np.arange(width)[:, None]
    begins = np.concatenate([[0], ends[:-1]])
    best = 0
    for origin in range(width):
        reach = np.full((width, len(begins)), -1)
        reach[origin] = stop[origin, begins]
        for _ in range(edits):
            none = np.full((1, len(begins)), -1)
            dropped = np.concatenate([reach[1:] + (reach[1:] >= 0), none])
            inserted = np.concatenate([none, reach[:-1]])
            further = np.minimum(np.maximum(np.maximum(reach + (reach >= 0), dropped), inserted), n)
            reach = np.maximum(reach, np.where(further >= 0, stop[row, np.maximum(further, 0)], -1))
        whole = np.searchsorted(ends, reach, side="right")  # words that end by then
        opens = gaps[np.clip(diagonal + origin + begins, 0, len(codes))]
        last = np.clip(diagonal + row + ends[np.maximum(whole - 1, 0)], 0, len(codes))
        run = whole - np.arange(len(begins)) - ~opens - ~gaps[last]
        best = max(best, int(np.where(reach > begins, run, 0).max()))
    return best


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    words: int = 13,
    edits: int = 0,
) -> DataFrame:
    """(doc_key, item_key, run), once each: documents that show at least ``words`` consecutive words of an item.

    The run may hold up to ``edits`` changed, dropped or inserted letters. Items must be a held-out set; tasks index
    them in blocks of bounded length, which are broadcast one by one, and each block passes over the documents
    without any shuffle of these. Items of fewer words, null texts and empty documents match nothing; whole
    documents are read, of any length; equal texts give a row each; equal items give a row each.
    """
    spark = docs.sparkSession
    source = docs.select(doc_key, text)
    schema = T.StructType(
        [
            T.StructField(doc_key, source.schema[0].dataType),
            T.StructField(item_key, items.schema[item_key].dataType),
            T.StructField("run", T.IntegerType()),
        ]
    )
    batch_type = to_arrow_type(items.schema[item_key].dataType)
    given = items.select(item_key, text).dropna()
    size = given.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_LETTERS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for key, t, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(block, []).append((key, t))
        made = [pickle.dumps(build_indexes(rows, words, edits)) for rows in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["index"])

    block = F.pmod(F.xxhash64(item_key), F.lit(blocks)).cast("int")
    built = given.withColumn("block", block).repartition(blocks, "block").mapInArrow(index, "index binary")
    out: DataFrame | None = None
    for row in built.toLocalIterator():
        shared = spark.sparkContext.broadcast(bytes(row["index"]))
        part = source.mapInArrow(_searcher(shared, doc_key, item_key, batch_type, words, edits), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy(doc_key, item_key).agg(F.max("run").alias("run"))


def _searcher(shared: Broadcast, doc_key: str, item_key: str, item_type: pa.DataType, words: int, edits: int):  # noqa: ANN202
    """The search of documents for the items of one block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = pickle.loads(shared.value)
        for batch in batches:
            found: list[tuple[int, object, int]] = []
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            size = 0
            for i, value in enumerate(batch.column(1)):
                t = value.as_py()
                if not t or not indexes:
                    continue
                codes, gaps = stream(t)
                held.append((i, codes, gaps))
                size += len(codes)
                if size >= BATCH_LETTERS:
                    found += [f for x in indexes for f in _search(x, held, words, edits)]
                    held, size = [], 0
            found += [f for x in indexes for f in _search(x, held, words, edits)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([i for i, _, _ in found], pa.int64())),
                    pa.array([k for _, k, _ in found], item_type),
                    pa.array([r for _, _, r in found], pa.int32()),
                ],
                names=[doc_key, item_key, "run"],
            )

    return search


def _search(
    index: ItemIndex,
    held: list[tuple[int, np.ndarray, np.ndarray]],
    words: int,
    edits: int,
) -> list[tuple[int, object, int]]:
    """(row, item's key, run) of the texts held; texts are joined by symbols that occur in no text."""
    if not held:
        return []
    wall = np.full(1, 0xFFFFFFFF, np.uint32)
    joined = np.concatenate([x for _, codes, _ in held for x in (codes, wall)])
    begin = np.cumsum([0, *(len(codes) + 1 for _, codes, _ in held)])
    hits = (
        (
            d := np.searchsorted(begin, at, side="right") - 1,
            item,
            at - begin[d] - place,
        ) for at, item, place in _shared(index, joined)
    )
    best: dict[tuple[int, int], int] = {}
    for d, t, diagonal in _bands(hits, index.bound, edits):
        row, codes, gaps = held[d]
        run = longest_run(index.streams[t], index.ends[t], codes, gaps, diagonal, 2 * (edits + 1), edits)
        if run >= words:
            best[row, t] = max(best.get((row, t), 0), run)
    return [(row, index.keys[t], run) for (row, t), run in best.items()]
