"""Scopes, counts and segmentation of the learned sentiment."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quantloom.operators import sentiment, text


def found(spark, value):
    row = spark.createDataFrame([(value,)], "t string").select(sentiment.scoped(sentiment.tokens(F.col("t"))).alias("x")).first()
    return [(r.word, r.weight) for r in row.x]


def test_negation_turns_three_words_up_to_punctuation(spark):
    assert found(spark, "It's NOT a good day here") == [("it's", 2), ("not_a", 2), ("not_good", 2), ("not_day", 2), ("here", 2)]
    assert found(spark, "Not good, bad") == [("not_good", 2), ("bad", 2)]
    assert found(spark, "it isn't bad. fine") == [("it", 2), ("not_bad", 2), ("fine", 2)]
    assert found(spark, "no\nloss") == [("loss", 2)]


def test_degree_weighs_the_next_word(spark):
    assert found(spark, "very good slightly bad never really great") == [("good", 3), ("bad", 1), ("not_great", 3)]
    assert found(spark, None) == found(spark, " ... ") == []


def test_scores_equal_their_definition(spark):
    rows = [(1, "good very good day"), (2, "bad day"), (3, "not good"), (4, None), (5, "day unseen"), (6, "good bad")]
    docs = spark.createDataFrame(rows, "doc_id long, t string")
    classes = spark.createDataFrame([(1, True), (2, False), (3, False), (9, None)], "doc_id long, positive boolean")
    words = sentiment.weighted_words(docs, "doc_id", sentiment.tokens(F.col("t")))
    counts = sentiment.class_counts(words, classes, "doc_id")
    held = {r.word: (r.pos, r.neg) for r in counts.collect()}
    assert held == {"good": (5, 0), "day": (2, 2), "bad": (0, 2), "not_good": (0, 2)}
    odds = {w: math.log((p + 1) / (7 + 4)) - math.log((n + 1) / (6 + 4)) for w, (p, n) in held.items()}
    prior = math.log(2) - math.log(3)
    want = {1: 2.5 * odds["good"] + odds["day"], 2: odds["bad"] + odds["day"], 3: odds["not_good"], 4: 0.0, 5: odds["day"], 6: odds["good"] + odds["bad"]}
    for r in sentiment.bayes_scores(words, counts, docs, classes, "doc_id").collect():
        assert r.log_odds == pytest.approx(prior + want[r.doc_id]) and r.score == pytest.approx(math.tanh(r.log_odds / 2))


def test_an_empty_model_leaves_zero(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, t string")
    words = sentiment.weighted_words(docs, "doc_id", sentiment.tokens(F.col("t")))
    none = spark.createDataFrame([], "doc_id long, positive boolean")
    assert [tuple(r) for r in sentiment.bayes_scores(words, sentiment.class_counts(words, none, "doc_id"), docs, none, "doc_id").collect()] == [(1, 0.0, 0.0)]


def test_the_score_is_a_base_of_the_lexicon(spark):
    rows = spark.createDataFrame([("shares rally", 0.5)], "t string, score double")
    assert rows.select(text.lexicon_boost(F.col("t"), F.col("score")).alias("s")).first().s == pytest.approx(0.58)


def every_cut(value):
    for n in range(len(value)):
        for at in combinations(range(1, len(value)), n):
            yield [value[a:b] for a, b in zip((0, *at), (*at, len(value)), strict=True)]


def test_segmentation_is_the_most_probable():
    rng = random.Random(7)
    for _ in range(150):
        counts = {"".join(rng.choice("涨跌停大盘") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(8)}
        words, total = sentiment.Segmenter(counts), sum(counts.values())
        value = "".join(rng.choice("涨跌停大盘x") for _ in range(rng.randint(1, 9)))
        cost = lambda cut: sum(-math.log(counts[w] / total) if w in counts else -math.log(0.5 / total) if len(w) == 1 else math.inf for w in cut)  # noqa: B023, E731
        got = words.cut(value)
        assert "".join(got) == value and cost(got) == pytest.approx(min(map(cost, every_cut(value))))


def test_segmented_texts_are_scored_like_others(spark):
    words = sentiment.dictionary(spark.createDataFrame([("大涨", 9), ("大跌", 9), ("今天", 5), ("", 3), ("一二三四五六七八九", 99)], "word string, n long"))
    assert words.longest == 2
    texts = spark.createDataFrame([(1, "今天大涨，大跌"), (2, None), (3, "ABC")], "doc_id long, t string")
    rows = {r.doc_id: r.words for r in sentiment.segmented(texts, "doc_id", "t", words).collect()}
    assert rows == {1: ["今天", "大涨", "，", "大跌"], 2: [], 3: ["a", "b", "c"]}
