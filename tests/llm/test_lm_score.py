import math
from collections import Counter

import pytest

from quantloom.llm import lm_score

ROWS = [(1, "The cat sat on the mat."), (2, "the dog sat on the log"), (3, "zzq xxv qqz zxv"), (4, None), (5, ""), (6, "éa été"), (1, "The cat sat on the mat."), (None, "loose text")]


def brute(rows, targets):
    def grams(text):
        raw = [b + 1 for b in bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())]
        s = [0, 0, *raw, 0]
        return [tuple(s[i : i + 3]) for i in range(len(raw) + 1)]

    every = [g for _, t in rows for g in grams(t)]
    own = [g for d, t in rows for g in grams(t) * targets.count(d)]
    vocabulary = {x for g in every for x in g} | {0}
    scale = len(own) / len(every) if own else 1.0

    def model(found, scale):
        c3, c2, c1, h3, h2 = Counter(), Counter(), Counter(), Counter(), Counter()
        for a, b, c in found:
            c3[a, b, c] += scale
            c2[b, c] += scale
            c1[c] += scale
            h3[a, b] += scale
            h2[b] += scale
        n = sum(c1.values())

        def loss(a, b, c):
            p1 = (c1[c] + 1) / (n + len(vocabulary))
            p2 = (c2[b, c] + 50 * p1) / (h2[b] + 50)
            return -math.log((c3[a, b, c] + 50 * p2) / (h3[a, b] + 50))

        return loss

    t, b = model(own, 1.0), model(every, scale)
    out = []
    for d, text in rows:
        g = grams(text)
        out.append((d, len(g), sum(t(*x) for x in g) / len(g), sum(b(*x) for x in g) / len(g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("targets", [[1, 2, 2, 99], []])
def test_equals_brute_force(spark, make, targets):
    named = spark.createDataFrame([(t,) for t in targets] + [(None,)], "doc_id long")
    found = sorted((tuple(r) for r in lm_score.cross_entropy_difference(make(ROWS), named).collect()), key=str)
    want = brute(ROWS, targets)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[2:4] == pytest.approx(b[2:4], abs=1e-5)
        assert a[4] == pytest.approx(b[2] - b[3], abs=1e-5)


def test_target_text_scores_lower(spark, make):
    named = spark.createDataFrame([(1,), (2,)], "doc_id long")
    found = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(make(ROWS), named).collect()}
    assert found[1] < found[3] and found[2] < found[3]


def test_empty(spark, make):
    assert lm_score.cross_entropy_difference(make(ROWS).where("false"), spark.createDataFrame([], "doc_id long")).collect() == []
