import math
import re
from collections import Counter

import pytest
from test_lm_score import ROWS

from quantloom.llm import queries, word_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, targets):
    def pairs(text):
        words = ["", *WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")), ""]
        return list(zip(words, words[1:], strict=False))

    every = [g for _, t in rows for g in pairs(t)]
    own = [g for d, t in rows for g in pairs(t) * targets.count(d)]
    vocabulary = {b for _, b in every}
    scale = len(own) / len(every) if own else 1.0

    def model(found, scale):
        two, one, before = Counter(), Counter(), Counter()
        for a, b in found:
            two[a, b] += scale
            one[b] += scale
            before[a] += scale
        p1 = lambda b: (one[b] + 1) / (len(found) * scale + len(vocabulary))
        return lambda a, b: -math.log((two[a, b] + 50 * p1(b)) / (before[a] + 50))

    t, b = model(own, 1.0), model(every, scale)
    out = [(d, len(g), sum(t(*x) for x in g) / len(g), sum(b(*x) for x in g) / len(g)) for d, text in rows for g in [pairs(text)]]
    return sorted(out, key=str)


@pytest.mark.parametrize("targets", [[1, 2, 2, 99], []])
@pytest.mark.parametrize("chunk", [1, 60, 1 << 22])
def test_equals_brute_force(spark, make, targets, chunk):
    named = spark.createDataFrame([(t,) for t in targets] + [(None,)], "doc_id long")
    found = sorted((tuple(r) for r in word_lm.cross_entropy_difference(make(ROWS), named, chunk=chunk).collect()), key=str)
    want = brute(ROWS, targets)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[2:4] == pytest.approx(b[2:4], abs=1e-9) and a[4] == pytest.approx(b[2] - b[3], abs=1e-9)


def test_empty(spark, make):
    assert word_lm.cross_entropy_difference(make(ROWS).where("false"), spark.createDataFrame([], "doc_id long")).collect() == []


def test_query_tells_word_order_apart(spark, make, tmp_path):
    # The same bytes in words of the same lengths, so that byte trigrams are nearly all the same.
    rows = [(i, f"alpha beta gamma delta {i}") for i in range(50)] + [(100, "delta gamma beta alpha 1")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in queries.op6_lm_score(spark, str(tmp_path)).collect()}
    assert found[1].n_tokens == 6 and found[100].target_loss > found[1].target_loss + 0.2
