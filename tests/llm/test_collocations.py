"""Phrases against counting them all, and tries against their definition."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quantloom.llm import collocations
from quantloom.llm.common import Scratch

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def grams(rows):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for d in range(1, 5):
                f.update((lang or "und", *words[i : i + d]) for i in range(len(words) - d + 1))
    return n, f


def brute(rows, least=30, most=2000):
    n, f = grams(rows)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = []
    for (lang, *words), a in candidates.items():
        longer = [b for (other, *w), b in candidates.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((int(Fraction(2000000 * a, x + y)), k, x, y) for k, (x, y) in enumerate(cuts))
        held.append((lang, -score, -a, " ".join(words).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(held):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def prose(seed, count=400, words=60):
    rng = random.Random(seed)
    bag = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(words)]
    idioms = ["In Spite Of", "de facto", "the very same old", "Über alles"]
    rows = []
    for i in range(count):
        text = "".join((rng.choice(idioms) if rng.random() < 0.15 else rng.choice(bag)) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randint(0, 80)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"]), "s"))
    return rows


def found(docs, **options):
    return sorted(tuple(r) for r in collocations.mine(docs, **options).collect())


@pytest.mark.parametrize("shard", [300, 5000, 1 << 22])
def test_equals_brute_force_whatever_the_shards(spark, make, shard):
    rows = prose(1) + [(900, None, "en", "s"), (901, "", "en", "s"), (902, " .,\n", "en", "s"), (None, "de facto", "en", "s")]
    rows += rows[:20]
    assert found(make(rows).repartition(7), shard=shard, least=5) == sorted(brute(rows, 5))


def test_frequent_pairs_long_texts_and_ties(make):
    rng = random.Random(4)
    rows = [(i, "big deal " * 50 + " ".join(rng.choice("abcdefgh") for _ in range(30)), "en", "s") for i in range(60)]
    rows.append((100, "lone pair here. " * 40_000, "en", "s"))
    rows += [(200 + i, f"tie{i % 9} same{i % 9}; ", "de", "s") for i in range(9 * 30)]
    assert found(make(rows).repartition(5)) == sorted(brute(rows))


def test_a_limit_takes_the_first(make):
    rows = prose(2, 200, 30)
    every = brute(rows, 5)
    assert found(make(rows), least=5, most=3) == sorted(r for r in every if r[1] <= 3)


def test_nothing_to_find(make):
    assert found(make([])) == [] and found(make([(1, None), (2, "a b c d e")])) == []


def test_ranges_hold_every_node_once_with_whole_counts(spark, make):
    rows = prose(3, 150)
    scratch = Scratch(spark, "test")
    before = collocations.RANGE_BYTES
    collocations.RANGE_BYTES = 400  # about a hundred ranges
    try:
        langs, nodes = collocations.count_nodes(make(rows).repartition(6), scratch, 1, shard=2000)
        held = nodes.collect()
    finally:
        collocations.RANGE_BYTES = before
    n, f = grams(rows)
    assert {r.lang: r.n for r in langs.collect() if r.n} == {k: v for k, v in n.items() if v}
    paths = [(r.key, *r.path) for r in held]
    assert len(paths) == len(set(paths)) == len(f) and Counter(r.f for r in held) == Counter(f.values())
    count = dict(zip(paths, (r.f for r in held), strict=True))
    for r in held:
        assert r.lefts == [count[(r.key, *r.path[:k])] for k in range(1, r.depth)]
    spelt = {(r.key, r.path[0]): bytes(r.word).decode() for r in held if r.depth == 1}
    assert sorted(spelt.values()) == sorted(w for _, *w in (k for k in f if len(k) == 2) for w in w)


def test_counts_beyond_32_bits_survive():
    big = np.array([1 << 40, 7], np.int64)
    one = np.array([3], np.int64)
    none = [np.zeros(0, np.int64)] * 3
    blob = collocations.serialised([0] * 4, one, np.array([5, -9]), [np.array([0, 0]), *none], [np.array([1, 0]), *none], [big, *none], np.array([1, 2]), b"abb")
    piece = collocations.Piece(blob)
    assert [x.tolist() for x in piece.level(0)] == [[0, 0], [1, 0], big.tolist()] and [len(x) for x in piece.level(3)] == [0, 0, 0]
    assert (piece.above, piece.langs.tolist(), piece.words.tolist(), piece.texts()) == ([0] * 4, [3], [5, -9], [b"a", b"bb"])
