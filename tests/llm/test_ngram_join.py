import glob
import random
import re
import time

import numpy as np
import pyspark.sql.functions as F
import pytest

from quantloom.llm import ngram_join
from quantloom.llm.components import components, contracted, extended
from quantloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ngrams(text, n=4):
    if text is None:
        return set()
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n=4, percent=85):
    nodes = {}
    for doc, text in rows:
        if doc is not None:
            nodes.setdefault(doc, []).append(ngrams(text, n))
    label = {d: d for d in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in nodes[a] for y in nodes[b]):
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return sorted(((d, len(ngrams(t, n)), root(d) if d is not None else None) for d, t in rows), key=str)


def test_equals_brute_force(make, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    found = sorted(map(tuple, ngram_join.similar_documents(make(rows)).collect()), key=str)
    assert found == brute(rows)
    assert len({r[2] for r in found}) < len({r[0] for r in found})


def test_small_chunks_and_partitions_agree(make, corpus, monkeypatch):
    rows = [(r[0], r[1]) for r in corpus[:60]]
    docs = make(rows).repartition(7)
    assert ngram_join.signature_rows(docs, chunk=50).where("direct").count() > 0
    one = ngram_join.shared_signatures(ngram_join.signature_rows(docs, chunk=50)).distinct().collect()
    all_at_once = ngram_join.shared_signatures(ngram_join.signature_rows(docs.coalesce(1))).distinct().collect()
    # Exact copies that one task holds need no signatures of their own.
    assert {r.key for r in all_at_once} <= {r.key for r in one}


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    bands = ngram_join.Bands(5000)
    missed = 0
    for size in [1, 3, 5, 6, 7, 8, 11, 20, 33, 60, 150, 400, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            out = rng.integers(0, size // 12 + 1) if size > 5 else 0
            b = np.concatenate([a[out:], rng.integers(0, 1 << 63, rng.integers(0, size // 14 + 1), dtype=np.uint64)])
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if not inter or 100 * inter < 85 * union:
                continue
            a, b = np.unique(a), np.unique(b)
            row = np.repeat([0, 1], [len(a), len(b)])
            at, keys, _ = ngram_join.signatures(row, np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
            missed += not set(keys[at == 0]) & set(keys[at == 1])
    assert missed == 0


def test_long_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(9)
    for n, m, common in [(3, 3, 2), (200, 260, 150), (500, 530, 480), (3000, 2000, 1900), (5, 4000, 5)]:
        both = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
        a, b = both[:n], both[n - common :]
        x, y = (ngram_join.long_parities(np.zeros(len(v), np.int64), v, np.array([len(v)]))[0] for v in (a, b))
        assert ngram_join.bits_apart(x, x) == 0
        assert ngram_join.bits_apart(x, y) == ngram_join.bits_apart(y, x) <= n + m - 2 * common


def crowd(seed, groups=6, members=14, length=130):
    """Groups of variants of one text, most of them less alike than the threshold but under common signatures,
    and in every text a passage that all texts share."""
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(14)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(length)]
        for m in range(members):
            words = list(base)
            start = rng.randrange(length // 2)
            for i in range(start, start + rng.choice([3, 10, 20, 25, 30, 35]) * length // 130):  # one run, so that signatures beside it stay
                words[i] = f"v{g}x{m}y{i}"
            rows.append((len(rows) * 3 + 1, " ".join(words + shared)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,seed,length", [(4, 85, 1, 130), (5, 80, 2, 130), (5, 80, 3, 900)])
def test_crowds_under_one_signature(make, words, percent, seed, length):
    rows = crowd(seed, length=length)
    found = sorted(map(tuple, ngram_join.similar_documents(make(rows), words=words, percent=percent).collect()), key=str)
    assert found == brute(rows, words, percent)
    assert len(rows) > len({r[2] for r in found}) > 12  # some are linked, many are not


def test_a_doc_id_with_several_texts_joins_their_groups(make):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(7, texts[0]), (7, texts[1]), (3, texts[1]), (9, texts[0]), (5, texts[2]), (6, None), (6, texts[2] + " more")]
    found = sorted(map(tuple, ngram_join.similar_documents(make(rows)).collect()), key=str)
    assert found == brute(rows)
    assert {r[0]: r[2] for r in found} == {7: 3, 3: 3, 9: 3, 5: 5, 6: 5}


def test_empty_table(make):
    assert ngram_join.similar_documents(make([(1, "x")]).where("false")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "s").collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "s").select(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_later_links_extend_earlier_ones(spark, seed):
    dice = random.Random(seed)
    links = [(dice.randrange(90), dice.randrange(90)) for _ in range(70)]
    scratch = Scratch(spark, "t")

    def table(rows):
        return spark.createDataFrame(rows, "a long, b long")

    labels = components(table(links[:40]), scratch, "first")
    later = components(contracted(table(links[40:]), labels), scratch, "later")
    found = extended(labels, later).collect()
    assert len(found) == len({r.node for r in found})
    assert set(map(tuple, found)) == set(map(tuple, components(table(links), scratch, "all").collect()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        return set(glob.glob(spark.conf.get("spark.local.dir") + "/**/shuffle_*.data", recursive=True))

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = files(), spark.conf.get(key, None)
    numbers = spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").agg(F.count("*").alias("n"))
    table = Scratch(spark, "t").write(numbers, "numbers")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert {r.n for r in table.collect()} == {100}
    assert spark.conf.get(key, None) == set_before


def test_repeated_rows_are_compared_once(make, monkeypatch):
    """Copies of whole rows, of texts under other ids, and ids with several texts."""
    base = [f"w{i}" for i in range(60)]
    near = [[*base[:j], "other", *base[j + 1 :]] for j in (0, 59)]
    texts = [(1, base), (2, near[0]), (3, near[1]), (4, base), (5, [*base, "more"])]
    rows = [(i, " ".join(x)) for i, x in texts for _ in range(40)]
    rows += [(9, "a b c d e f"), (9, " ".join(base)), (12, "a b c d e f"), (12, "g h i j k l"), (20, "g h i j k l"), (8, "g h i j k l")]
    asked, real = [], ngram_join.verified

    def counted(pairs, docs, *rest):
        of = ngram_join.id_texts(docs, rest[0])
        asked.append((pairs.join(of.withColumnRenamed("of", "a"), "a").join(of.withColumnRenamed("of", "b"), "b").count(), pairs.count()))
        return real(pairs, docs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    found = sorted(map(tuple, ngram_join.similar_documents(make(rows)).collect()), key=str)
    assert found == brute(rows)
    # Every asked pair is compared once, but for ids with two texts.
    assert asked[0][1] > 0
    assert all(compared <= 4 * pairs for compared, pairs in asked)


def test_copies_make_no_links(make, monkeypatch):
    seen, real = [], ngram_join.components

    def counted(links, *rest):
        seen.append(links.count())
        return real(links, *rest)

    monkeypatch.setattr(ngram_join, "components", counted)
    rows = [(i, "the same words in each of these texts") for i in range(50)] + [(50 + i, f"text {i} with words of its own only") for i in range(5)]
    found = sorted(map(tuple, ngram_join.similar_documents(make(rows)).collect()), key=str)
    assert found == brute(rows)
    assert not any(seen)


def test_similar_sets_have_more_signatures_in_common_than_either_leaves_out(spark):
    """Sets as unlike as the threshold allows, whose other elements fall into as many parts as they can."""
    rng = np.random.default_rng(11)
    bands = ngram_join.Bands(3000)
    met = []
    for size in [7, 8, 12, 25, 40, 77, 113, 114, 147, 170, 300, 700, 1500]:
        for only in range(6):  # how much of the difference is the first set's own
            out = size * 15 // 100 * only // 5
            differ = out + 100 * (size - out) // 85 - size
            n = max(1, bands.parts[np.searchsorted(bands.low, size, "right") - 1])
            pool = rng.integers(0, 1 << 63, 40 * (differ + 1), dtype=np.uint64)
            _, first = np.unique((pool >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), return_index=True)
            odd = np.concatenate([pool[first], np.delete(pool, first)])[:differ]
            same = rng.integers(0, 1 << 63, size - out, dtype=np.uint64)
            a, b = np.unique(np.concatenate([same, odd[:out]])), np.unique(np.concatenate([same, odd[out:]]))
            assert 100 * len(same) >= 85 * len(np.union1d(a, b)) > 100 * len(same) - 185
            at, keys, of = ngram_join.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
            band = int(of[at == (len(b) < len(a))].max())
            both = set(keys[(at == 0) & (of == band)]) & set(keys[(at == 1) & (of == band)])
            met += [(band, len(x), len(both)) for x in (a, b)]
    rows = spark.createDataFrame(met, "band short, n long, common long").withColumn("leave", F.expr(bands.leave()))
    assert rows.where("leave > 4").count() > 80
    assert rows.where("common <= leave").collect() == []


def test_what_is_left_of_crowded_signatures_is_written_and_little(make, monkeypatch):
    placed, left, real_placed, real_undecided = [], [], ngram_join._placed, ngram_join._undecided

    def counted(met, *rest):
        out = real_placed(met, *rest)
        placed.append((met.count(), out.count()))
        return out

    def seen(rows, scratch, name):
        if name != "split0":
            left.append(rows._jdf.queryExecution().executedPlan().toString())
        return real_undecided(rows, scratch, name)

    monkeypatch.setattr(ngram_join, "_placed", counted)
    monkeypatch.setattr(ngram_join, "_undecided", seen)
    rows = crowd(4, groups=2, members=40)
    found = sorted(map(tuple, ngram_join.similar_documents(make(rows)).collect()), key=str)
    assert found == brute(rows)
    (met, kept), *_ = placed
    assert kept < 0.6 * met
    assert left and not any("Join" in plan for plan in left)
