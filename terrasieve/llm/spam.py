"""Keyword-stuffed and link-list pages.

A page is spam when its words stand outside sentences and are the same words over and over. Repetition is measured
with the suffix automaton of a whole page, whose symbols are the page's words and figures: for every place the longest
phrase ending there that returns often enough is read off the suffix links, and what these repeated maximal phrases
cover is counted in characters. Sentences are told by their form alone, so no language is known or unknown to it.
"""

from __future__ import annotations

import html
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A word, also inside a compound written in mixed case, or a figure.
_SYMBOL = re.compile(r"\d+|[A-ZÀ-Þ]+(?![a-zß-ÿ])|[^\W\d_A-ZÀ-Þ]+|[^\W\d_][^\W\d_A-ZÀ-Þ]*")
#: Lines, sentences and addresses are taken apart; an address is a part of its own, and is looked for where a run of
#: letters begins, as a search from each of its letters would take the square of its length.
_PART = re.compile(r"(?<=[.!?])\s+|[\r\n]+|(?<!\S)(\S*//\S*)")
#: The same for a page without an address; spaces after a line's end go with it.
_BREAK = re.compile(r"\s(?:(?<=[\r\n])|(?<=[.!?]\s))\s*")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
#: Words and figures the shortest sentence has.
SENTENCE_WORDS = 7
#: Words of a page above which its automaton is packed.
PACKED_WORDS = 200_000
#: Words held between pages; the number of them has no part in any result.
_CACHED_WORDS = 200_000


def repeated_cover(symbols: list[int], min_repeats: int) -> list[bool]:
    """For each place, whether some phrase that occurs ``min_repeats`` times covers it, from a suffix automaton.

    Most states have a single transition, which is kept in two lists; only states that branch have a table. The lists
    of a page above ``PACKED_WORDS`` are packed, which is slower and takes a fifth of the memory, so that a page of
    millions of words fits a task and is measured as one.
    """
    n = len(symbols)
    states = 2 * n + 2
    blank = (lambda x: array("i", [x]) * states) if n > PACKED_WORDS else (lambda x: [x] * states)
    first, to = blank(-1), blank(0)  # a state's first transition
    more: dict[int, dict[int, int]] = {}  # the others
    link, length, count = blank(0), blank(0), blank(0)
    link[0] = -1
    at = blank(0)  # the state of each prefix
    last, size = 0, 1
    for i, s in enumerate(symbols):
        new = size
        size += 1
        at[i] = new
        count[new] = 1
        length[new] = length[last] + 1
        p, q = last, -1
        while p != -1:
            held = first[p]
            if held == s:
                q = to[p]
                break
            if held == -1:
                first[p] = s
                to[p] = new
            elif p not in more:
                more[p] = {s: new}
            else:
                q = more[p].setdefault(s, new)
                if q != new:
                    break
            p = link[p]
        if p != -1:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = size
                size += 1
                first[copy], to[copy], link[copy], length[copy] = first[q], to[q], link[q], length[p] + 1
                if q in more:
                    more[copy] = more[q].copy()
                while p != -1:
                    if first[p] == s:
                        if to[p] != q:
                            break
                        to[p] = copy
                    elif p in more and more[p].get(s) == q:
                        more[p][s] = copy
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    for state in sorted(range(1, size), key=length.__getitem__, reverse=True):
        if link[state] > 0:
            count[link[state]] += count[state]
    edge = [0] * (n + 1)
    for i in range(n):
        state = at[i]
        while state > 0 and count[state] < min_repeats:
            state = link[state]
        if state > 0:
            edge[i + 1 - length[state]] += 1
            edge[i + 1] -= 1
    return [depth > 0 for depth in accumulate(edge[:n])]


class _Words(dict):
    """The number of each word's lower-case form and how many letters it has, none for a figure."""

    def __init__(self):
        super().__init__()
        self.ids: dict[str, int] = {}

    def __missing__(self, word: str) -> tuple[int, int]:
        found = self[word] = (self.ids.setdefault(word.lower(), len(self.ids)), 0 if word[0].isdigit() else len(word))
        return found

    def clear(self) -> None:
        super().clear()
        self.ids.clear()


_words = _Words()


def _closed(part: str) -> bool:
    """Whether one mark ends the part, quotes and brackets after it aside."""
    end = part.rstrip().rstrip("\"'”»)")[-2:]
    return end[-1:] in (".", "!", "?") and end[:-1] not in (".", "!", "?")


def page_measures(text: str, spacing: int, min_loose: float = 0.0) -> tuple[float, float]:
    """(loose, covered): the share of the page's letters outside sentences and records, and of those letters the share in repeated phrases.

    Of a page whose ``loose`` is below ``min_loose`` nothing else is asked: no automaton is built and ``covered`` is 0.

    A phrase counts as repeated if it returns once in ``spacing`` words of the page or more often, twice at least. A
    part has a sentence's form if one mark closes it, it is long enough, and no word of four letters or more makes up
    a tenth of it three times over. A line that is figures by half or more, without address or tag, is a record.
    """
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if len(_words) > _CACHED_WORDS:
        _words.clear()
    symbols: list[int] = []
    letters: list[int] = []
    spans: list[tuple[int, int]] = []  # the words of each part that isn't told
    a = total = loose = 0
    for part in (_PART if "//" in text else _BREAK).split(text):
        if not part or not (found := _SYMBOL.findall(part)):
            continue
        own, sizes = zip(*map(_words.__getitem__, found), strict=True)
        symbols += own
        letters += sizes
        n, size = len(own), sum(sizes)
        total += size
        told = False
        if "//" not in part:
            told = "#" not in part and 2 * sizes.count(0) >= n
            # two words of a part must be the same as others before one can stand there three times
            if not told and n >= SENTENCE_WORDS and _closed(part):
                told = len(set(own)) > n - 2
                if not told:
                    most = max(Counter([w for w, k in zip(own, sizes, strict=True) if k > 3]).values(), default=0)
                    told = most < 3 or most < 0.1 * n
        if not told:
            spans.append((a, a + n))
            loose += size
        a += n
    share = loose / total if total else 0.0
    if not loose or share < min_loose:
        return share, 0.0
    cover = repeated_cover(symbols, max(2, -(-a // spacing)))
    return share, sum(sum(compress(letters[a:b], cover[a:b])) for a, b in spans) / loose


def spam_pages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    spacing: int = 80,
    min_score: float = 1.02,
    min_loose: float = 0.4,
) -> DataFrame:
    """(key, loose, covered) of the pages that are mostly repeated matter outside sentences.

    ``loose`` is the share of a page's letters outside sentences and records, ``covered`` the share of those that
    repeated phrases cover; their sum must reach ``min_score``, so a page without sentences needs few repeats and a
    page with some needs many, and no page is found by either alone while ``min_score`` is above 1.

    An automaton is built from a page's whole text, one page at a time, where ``loose`` reaches ``min_loose``: no other
    page can be found, whatever repeats in it. The table is not shuffled. Null, empty and blank texts are no spam; other columns are ignored; a null key is kept as it is. An empty table gives no rows.
    """
    source = docs.select(key, text)
    schema = T.StructType([source.schema[0], T.StructField("loose", T.DoubleType()), T.StructField("covered", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, looses, covers = [], [], []
            for i, value in enumerate(batch.column(1)):
                t = value.as_py()
                loose, covered = page_measures(t, spacing, min_loose) if t else (0.0, 0.0)
                if loose >= min_loose and loose + covered >= min_score:
                    keep.append(i), looses.append(loose), covers.append(covered)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array(looses, pa.float64()),
                    pa.array(covers, pa.float64()),
                ],
                names=[key, "loose", "covered"],
            )

    return source.mapInArrow(judge, schema)
