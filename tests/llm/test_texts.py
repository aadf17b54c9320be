"""Problems 7, 8 and 9 against brute force, with odd, empty, repeated and very long texts."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import pytest

from terrasieve.llm import leakage, packing, spam

WORDS = [f"{a}{b}{c}" for a in "bdfkmst" for b in "aeiou" for c in "lnrx"]


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# Leaks


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as run")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["run"] for r in leakage.leaked_passages(d, i, **kw).collect()}


def test_thirteen_words_leak_and_twelve_do_not(spark):
    r = random.Random(1)
    item = "Pick one.\n" + words(r, 30)
    w = item.split()
    docs = []
    for n in (12, 13, 20):
        for at in (0, 5):
            docs.append((n * 100 + at, f"{words(r, 15)} zq {' '.join(w[at : at + n])} zq {words(r, 9)}"))
    got = leaks(spark, docs, [(1, item), (2, item), (3, words(r, 12)), (4, None)])
    assert got == {(d, i): n for n, d in ((n, n * 100 + at) for n in (13, 20) for at in (0, 5)) for i in (1, 2)}


def test_what_does_not_matter(spark):
    item = "When Öls-23 is crossed with Masi-9, the offspring show 5.67 stems in 105 trays out of 43 near the fine ridge."
    w = item.split()
    forms = {
        1: item.upper(),
        2: item.replace(" ", "\n\n  "),
        3: item.replace("e", "e­").replace("o", "o​"),
        4: " ".join(f"<b>{x}</b>" for x in w),
        5: item.replace(" ", "&nbsp;"),
        6: item.replace("Ö", "Ö").replace("fi", "ﬁ"),
        7: "".join(w),
        8: item.replace(",", " --- ").replace("-", "‑"),
        9: " ".join("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in x) for x in w),
    }
    got = leaks(spark, list(forms.items()), [(7, item)])
    assert set(got) == {(k, 7) for k in forms}


def test_partial_words_at_the_ends_do_not_count(spark):
    item = "5 " + " ".join(WORDS[:11]) + " 7"
    docs = [(1, "15 " + " ".join(WORDS[:11]) + " 77"), (2, item)]
    assert set(leaks(spark, docs, [(1, item)])) == {(2, 1)}


def test_odd_texts(spark):
    r = random.Random(2)
    item = words(r, 20)
    long = words(r, 60_000) + " zq " + item + " zq " + words(r, 60_000)
    docs = [
        (1, None),
        (2, ""),
        (3, "   "),
        (4, long),
        (5, long),
        (6, "\U0001f600" * 50),
        (7, "<" * 1000 + "&" * 1000),
        (None, item),
    ]
    assert set(leaks(spark, docs, [(1, item)])) == {(4, 1), (5, 1), (None, 1)}
    assert leaks(spark, [(1, item)], []) == {}
    assert leaks(spark, [], [(1, item)]) == {}


def test_repetitive_texts_are_counted_in_slices(spark, monkeypatch):
    item = " ".join(["aa"] * 60)
    docs = [(1, "aa " * 5_000), (2, "aa " * 12), (3, "aa " * 13)]
    want = {(1, 1), (3, 1)}
    assert set(leaks(spark, docs, [(1, item)])) == want
    monkeypatch.setattr(leakage, "SLICE_HITS", 1_000)
    assert set(leaks(spark, docs, [(1, item)])) == want


def test_blocks_of_items_agree(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, words(r, 16)) for i in range(9)]
    docs = [(i, words(r, 30) + " " + t) for i, t in items]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr(leakage, "BLOCK_LETTERS", 300)
    monkeypatch.setattr(leakage, "BATCH_LETTERS", 100)
    assert leaks(spark, docs, items) == whole and len(whole) == 9


def test_random_texts_match_brute_force(spark):
    r = random.Random(4)
    items = [(i, words(r, r.randint(10, 40))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = [words(r, 10)]
        for _ in range(2):
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            parts += [" ".join(w[a : a + r.randint(5, 25)]), "zq" + words(r, 3)]
        docs.append((d, " ".join(parts)))
    want = set()
    for d, t in docs:
        dw = t.split()
        for i, it in items:
            iw = it.split()
            runs = {tuple(iw[a : a + 13]) for a in range(len(iw) - 12)}
            if any(tuple(dw[a : a + 13]) in runs for a in range(len(dw) - 12)):
                want.add((d, i))
    assert set(leaks(spark, docs, items)) == want and len(want) > 20


def test_edits_are_found_when_asked_for(spark):
    r = random.Random(5)
    item = words(r, 13)
    at = len(item) // 2
    while item[at] == " ":
        at += 1
    forms = {
        1: item,
        2: item[:at] + "q" + item[at + 1 :],
        3: item[:at] + item[at + 1 :],
        4: item[:at] + "q" + item[at:],
        5: item[: at - 9] + "q" + item[at - 9 : at + 9] + item[at + 10 :],
        6: item.replace("a", "q"),
    }
    docs = [(k, f"{words(r, 30)} zq {t} zq {words(r, 30)}") for k, t in forms.items()]
    assert {d for d, _ in leaks(spark, docs, [(1, item)])} == {1}
    assert {d for d, _ in leaks(spark, docs, [(1, item)], edits=1)} == {1, 2, 3, 4}
    assert {d for d, _ in leaks(spark, docs, [(1, item)], edits=2)} == {1, 2, 3, 4, 5}


def test_short_items_do_not_weaken_the_others():
    items = [(1, " ".join("abcdefghijklm")), (2, " ".join(WORDS[:20]))]
    assert {x.q: x.keys for x in leakage.build_indexes(items, 13, 0)} == {12: [1], 16: [2]}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *(0 for _ in b)] if not b else [i] + [min(row[j] + 1, row[j - 1] + (x != y)) for j, y in enumerate(b, 1)]
        for j in range(1, len(row)):
            row[j] = min(row[j], row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("seed", range(12))
def test_band_alignment_agrees_with_the_edit_distance(seed):
    import numpy as np

    r = random.Random(seed)
    item = ["".join(r.choices("ab", k=r.randint(1, 4))) for _ in range(6)]
    text = list("".join(item))
    for _ in range(r.randint(0, 3)):
        i = r.randrange(len(text))
        text[i : i + 1] = r.choice([[], [text[i], "a"], ["b"]])
    code = lambda t: np.array([ord(c) for c in t], np.uint32)
    ends = np.cumsum([len(w) for w in item])
    for k in (0, 1, 2):
        got = leakage.longest_run(code("".join(item)), ends, code(text), np.ones(len(text) + 1, bool), -k - 1, 2 * (k + 1) + 1, k)
        want = 0
        for a in range(6):
            for b in range(a + 1, 7):
                w = "".join(item[a:b])
                s = len("".join(item[:a]))
                if any(
                    edit_distance(w, text[p : p + m]) <= k
                    for p in range(max(0, s - k - 1), min(len(text), s + k + 1) + 1)
                    for m in range(max(1, len(w) - k), len(w) + k + 1)
                    if p + m <= len(text)
                ):
                    want = max(want, b - a)
        assert got >= want - 1 and got <= max(want, 0) + (k > 0)


def test_gram_hashes_depend_on_every_symbol():
    import numpy as np

    r = np.random.default_rng(0)
    for q in (1, 2, 3, 5, 7, 13, 16):
        x = r.integers(97, 123, 200).astype(np.uint32)
        h = leakage.gram_hashes(x, q)
        assert len(h) == 200 - q + 1
        seen = {}
        for i, v in enumerate(h):
            assert seen.setdefault(tuple(x[i : i + q]), v) == v
        assert len(set(map(int, h))) == len(seen)


# Spam


def brute_cover(symbols, k):
    n = len(symbols)
    covered = [False] * n
    for length in range(1, n + 1):
        counts = Counter(tuple(symbols[i : i + length]) for i in range(n - length + 1))
        for i in range(n - length + 1):
            if counts[tuple(symbols[i : i + length])] >= k:
                for j in range(i, i + length):
                    covered[j] = True
    return covered


@pytest.mark.parametrize("seed", range(25))
def test_automaton_covers_what_repeats(seed):
    r = random.Random(seed)
    s = [r.randint(0, r.choice([1, 3, 9])) for _ in range(r.randint(0, 40))]
    for k in (2, 3):
        assert spam.repeated_cover(s, k) == brute_cover(s, k)


SPAM = [
    "grow light grow light cheap grow light best grow light order grow light " * 6,
    "#PlantSensor12 # SeedTrays #PlantSensorbest #SeedTrays44 # PlantSensor #PeatPotscheap " * 4,
    "\n".join(f"Buy seed trays - SKU {i * 37} - {i}.99 EUR - free shipping" for i in range(12)),
    " ".join(f'<a href="https://x{i}.example/{i}?ref={i * 7}">cheap seed trays</a>' for i in range(12)),
    "\n".join(f"http://shop{i}.example/seed-trays-{i}" for i in range(20)),
    "If you look for a peat pots in town, our peat pots is the peat pots for you and your peat pots garden. " * 8,
]
SOUND = [
    "We measured the plants again in May because the first reading had failed. The error fell from 5.1 to 3.2, and the leaves stayed green until June.",
    "\n".join(f"2001-02-{i:02d} 10:0{i % 10}:00 INFO fold={i % 5} var=BIO{i} r2=0.{i}" for i in range(1, 25)),
    "accession\tsite\taltitude\tyear\n" + "\n".join(f"Kar-{i}\tPlace{i}\t{i * 31}\t{1950 + i}" for i in range(30)),
    "\n".join(f">s{i}|chr1|{i}\n" + "".join(random.Random(i).choices("ACGT", k=120)) for i in range(10)),
    "\n".join(
        f"- https://x{i}.example/{i} : This page tells how the seeds of line {i} were stored and which of them died." for i in range(10)
    ),
    "Kasvit mitattiin uudelleen toukokuussa, koska ensimmäinen lukema oli epäonnistunut. Virhe pieneni selvästi, ja lehdet pysyivät vihreinä kesäkuuhun asti. "
    "Kasvihuoneen lämpötila nousi hitaasti, eikä kukaan huomannut muutosta ennen syksyn ensimmäisiä pakkasia.",
    "Le piante sono state misurate di nuovo a maggio perché la prima lettura era fallita. L'errore è diminuito e le foglie sono rimaste verdi fino a giugno. "
    "Nessuno si aspettava che la serra rimanesse così calda durante le prime notti di gelo dell'autunno.",
    "The price of the grow light rose by 41 percent, so we ordered a used one from the shop. Our old seed trays still work after 19 months in the cold frame.",
]


def test_spam_and_sound_pages(spark):
    docs = [(i, t) for i, t in enumerate(SPAM)] + [(100 + i, t) for i, t in enumerate(SOUND)] + [
        (200, None),
        (201, ""),
        (202, " \n "),
        (203, "12 34"),
        (None, SPAM[0]),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as loose", "2 as covered")
    got = {r["doc_id"] for r in spam.spam_pages(df).collect()}
    assert got == {*range(len(SPAM)), None}
    assert spam.spam_pages(df.limit(0)).collect() == []


def test_repetition_decides_between_pages_without_sentences():
    r = random.Random(11)
    names = ["".join(r.choices("abdeiklmnorstu", k=9)).title() for _ in range(40)]
    roll = "\n".join(f"{a} {b}" for a, b in zip(names[::2], names[1::2], strict=True))
    wares = "\n".join(f"{a} grow light {b}" for a, b in zip(["cheap", "best"] * 10, names, strict=False))
    loose = [spam.page_measures(t, 80)[0] for t in (roll, wares)]
    covered = [spam.page_measures(t, 80)[1] for t in (roll, wares)]
    assert loose == [1.0, 1.0] and covered[0] == 0 and covered[1] > 0.4


def test_phrases_repeat_across_any_distance():
    r = random.Random(12)
    half = [r.randrange(40_000) for _ in range(150_000)]
    assert sum(spam.repeated_cover(half + [40_001] + half, 2)) == 300_000


def test_an_automaton_is_built_where_it_can_decide(monkeypatch):
    asked = []
    real = spam.repeated_cover
    monkeypatch.setattr(spam, "repeated_cover", lambda s, k: asked.append(len(s)) or real(s, k))
    whole = [spam.page_measures(t, 80) for t in SPAM + SOUND]
    n = len(asked)
    assert [spam.page_measures(t, 80, 0.4) for t in SPAM + SOUND] == [(a, b if a >= 0.4 else 0.0) for a, b in whole]
    assert len(asked) - n == sum(a >= 0.4 for a, _ in whole) < n


def test_a_run_of_letters_takes_time_by_its_length():
    began = time.process_time()
    assert spam.page_measures("ACGT" * 25_000, 80) == (1.0, 0.0)
    assert time.process_time() - began < 5  # every letter searched the rest of the run for an address: 35 s


def test_words_held_between_pages_change_nothing(monkeypatch):
    whole = [spam.page_measures(t, 80) for t in SPAM + SOUND]
    monkeypatch.setattr(spam, "_CACHED_WORDS", 0)
    assert [spam.page_measures(t, 80) for t in SPAM + SOUND] == whole


@pytest.mark.parametrize("end", ["", ".", "..", "!\"", "?')", ". )", ".»\n", "a.\t ", '"', ")."])
def test_marks_that_close_a_part(end):
    closed = re.compile(r"(?<![.!?])[.!?][\"'”»)]*\s*$")
    assert [spam._closed(w + end) for w in ("", "ab", "a.")] == [bool(closed.search(w + end)) for w in ("", "ab", "a.")]


def test_very_long_page(spark):
    df = spark.createDataFrame([(1, "cheap grow light online " * 60_000)], "doc_id long, text string")
    assert spam.spam_pages(df).count() == 1


# Packing


def test_tokens_by_pieces_equal_the_tokenizer():
    counter = packing.TokenCounter(packing.VOCABULARY)
    r = random.Random(6)
    texts = [
        "",
        " ",
        "a",
        "Don't  stop\n\n  now  ",
        "é" * 300,
        "ACGT" * 700,
        "x­y 12,3.4 !!??",
        "\t\t a \r\n",
        "日本語 text",
    ] + [words(r, 40) for _ in range(20)]
    for t in texts:
        assert counter.analyse(t)[0] == len(counter.encoding.encode_ordinary(t))


def test_stretches_give_the_pieces_of_the_whole_text():
    r = random.Random(61)
    counter = packing.TokenCounter(packing.VOCABULARY)
    marks = [*"ab'sé1.,²日 \n\t\r\x1c\x85\u200b\u3000", " ", " ", " ", "don't", "Ⅷ"]
    texts = ["", " ", "  ", " a", "a ", "a b ", "a b \n", "a b\n", "a  b c", "a \nb c", " \ta b", "a b\t c", "x" * 200 + " b " + "x" * 200]
    for t in texts + ["".join(r.choices(marks, k=r.randint(1, 25))) for _ in range(3_000)]:
        want = Counter()
        for p in counter.pattern.findall(t):
            w = p.strip().lower()
            if len(w) > 1 and w[0].isalpha():
                want[zlib.crc32(w.encode()) % packing.BUCKETS] += 1
        n, terms, counts = counter.analyse(t)
        assert n == len(counter.encoding.encode_ordinary(t))
        assert (terms.tolist(), counts.tolist()) == (sorted(want), [want[k] for k in sorted(want)])
    assert max(map(len, counter.stretches)) <= packing._CACHED_LETTERS


def test_the_pattern_is_asked_once_for_a_stretch():
    counter = packing.TokenCounter(packing.VOCABULARY)
    asked = []
    real = counter.pieces
    counter.pieces = lambda t: asked.append(len(t)) or real(t)
    r = random.Random(62)
    texts = [words(r, 400) for _ in range(50)]
    for t in texts:
        counter.analyse(t)
    assert sum(asked) < 0.1 * sum(map(len, texts))


def test_held_pieces_stay_within_their_bound(monkeypatch):
    r = random.Random(63)
    texts = [words(r, 60) for _ in range(20)]
    whole = [[x if isinstance(x, int) else x.tolist() for x in packing.TokenCounter(packing.VOCABULARY).analyse(t)] for t in texts]
    monkeypatch.setattr(packing, "_CACHED_PIECES", 5)
    counter = packing.TokenCounter(packing.VOCABULARY)
    assert [[x if isinstance(x, int) else x.tolist() for x in counter.analyse(t)] for t in texts] == whole
    assert max(len(counter.known), len(counter.stretches)) <= 6


def test_neighbours_fill_a_container_best_first():
    import numpy as np

    r = random.Random(64)
    sizes = np.array([r.randint(1, 60) for _ in range(200)])
    terms = [np.array(sorted(r.sample(range(30), 5)), np.int32) for _ in sizes]
    make = lambda: packing.Shard(sizes, terms, [np.ones(5, np.int32) for _ in sizes], sizes.astype(float), np.ones(30, np.float32), 30.0)
    shard, want = make(), []
    for seed in shard.by_size[::-1]:
        if not shard.free[seed]:
            continue
        shard.take(seed)
        held, room = [int(seed)], 100 - int(sizes[seed])
        for i in shard.neighbours(int(seed), room):
            if sizes[i] <= room:
                shard.take(i)
                held.append(int(i))
                room -= int(sizes[i])
        while room > 0 and (i := shard.largest(room)) >= 0:
            shard.take(i)
            held.append(i)
            room -= int(sizes[i])
        want.append(held)
    assert packing.fill_containers(make(), 100) == want


def pack(spark, docs, capacity):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as terms", "3 as filled")
    return packing.pack_containers(df, capacity=capacity).collect()


@pytest.mark.parametrize("shard", [4_000, 7])
def test_every_token_in_one_container(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TEXTS", shard)
    r = random.Random(7)
    docs = [(i, words(r, r.choice([1, 3, 10, 40, 90, 400]))) for i in range(120)] + [
        (900, None),
        (901, ""),
        (902, docs_text := words(r, 50)),
        (903, docs_text),
    ]
    cap = 150
    rows = pack(spark, docs, cap)
    counter = packing.TokenCounter(packing.VOCABULARY)
    sizes = {i: counter.analyse(t)[0] for i, t in docs if t}
    held = Counter()
    for x in rows:
        held[x["seed"], x["seed_part"]] += x["n_tokens"]
    assert max(held.values()) <= cap
    for i, n in sizes.items():
        parts = sorted((x["token_start"], x["n_tokens"]) for x in rows if x["doc_id"] == i)
        assert sum(p[1] for p in parts) == n and all(
            a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False)
        ) and parts[0][0] == 0
        assert len(parts) == -(-n // cap)  # nothing is divided but what is larger than a container
    assert {x["doc_id"] for x in rows} == set(sizes)
    if shard > 100:
        assert len(held) <= sum(sizes.values()) / cap * 1.1 + 1


def test_neighbours_share_a_container(spark):
    r = random.Random(9)
    topic = lambda k: " ".join(r.choice([f"{k}{w}" for w in WORDS[:12]]) for _ in range(25))
    docs = [(i, topic("plum" if i % 2 else "zinc")) for i in range(60)]
    rows = pack(spark, docs, 400)
    together = Counter()
    by = {}
    for x in rows:
        by.setdefault((x["seed"], x["seed_part"]), []).append(x["doc_id"] % 2)
    for kinds in by.values():
        together["same" if len(set(kinds)) == 1 else "mixed"] += 1
    assert together["same"] >= 4 * together["mixed"]


def test_empty_table(spark):
    assert pack(spark, [], 100) == []
    assert pack(spark, [(1, None)], 100) == []


def test_shards_see_most_of_the_best_neighbours():
    import numpy as np

    r = random.Random(21)
    counter = packing.TokenCounter(packing.VOCABULARY)
    topics = [[r.choice(WORDS) + r.choice(WORDS) for _ in range(8)] for _ in range(60)]
    texts = [" ".join(r.choices(r.choice(topics), k=20) + r.choices(WORDS, k=20)) for _ in range(900)]
    found = [counter.analyse(t) for t in texts]
    sizes = np.array([n for n, _, _ in found])
    df = np.bincount(np.concatenate([t for _, t, _ in found]), minlength=packing.BUCKETS)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5)).astype(np.float32)
    make = lambda rows: packing.Shard(sizes[rows], [found[i][1] for i in rows], [found[i][2] for i in rows], sizes[rows].astype(float), idf, float(sizes.mean()))
    whole = make(np.arange(len(texts)))
    x = packing.sketches([t for _, t, _ in found], [c for _, _, c in found], idf)
    order = np.argsort(packing.leaves(x, *packing.fit_tree(x[::3])), kind="stable")
    hits = total = 0
    for rows in np.array_split(order, 3):
        shard = make(rows)
        for at in range(0, len(rows), 7):
            for x, i in ((whole, rows[at]), (shard, at)):
                x.take(int(i))
            best = [int(i) for i in whole.neighbours(int(rows[at]), 10**6)[:10]]
            seen = {int(rows[i]) for i in shard.neighbours(at, 10**6)[:10]}
            hits, total = hits + len(seen & set(best)), total + len(best)
            whole.free[:] = True
            shard.free[:] = True
    assert hits / total > 0.5  # a third by chance
