"""A base sentiment that is learned: naive Bayes over words in their scope.

Words are taken with what stands before them: within three words behind a negation, and before
the next punctuation, a word counts as its negated form; behind a word of degree it counts more
or less.  Weights are whole numbers of halves, so counts are exact.  Text that is written
without blanks is first cut into the words of its most probable segmentation.

Counts by class are one aggregate over all words, and the model is a table, a row a word; texts
are scored by joining their words to it, combined by text and word before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.session import Tables, dealt

#: Words that turn what follows, strengthen and weaken it; forms in n't turn it too.
NEGATIONS = ["not", "no", "never", "none", "nor", "neither", "cannot", "without", "nothing"]
STRONGER = ["very", "extremely", "highly", "really", "sharply", "strongly", "significantly", "hugely"]
WEAKER = ["slightly", "somewhat", "barely", "hardly", "partly", "almost", "marginally", "mildly"]
#: Words behind a negation that it turns.
SCOPE = 3
_TOKEN = r"[\p{L}']+|[.,;:!?\n]"
_STOPS = [".", ",", ";", ":", "!", "?", "\n"]
#: Weights in halves: of a word, behind a strengthening and behind a weakening word.
PLAIN, MORE, LESS = 2, 3, 1
#: Words of a dictionary for segmentation at most, and characters of a word.
DICTIONARY, LONGEST = 50_000, 8


def tokens(text: Column) -> Column:
    """Words and punctuation in order, in lower case; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def scoped(words: Column, negations: list[str] = NEGATIONS, stronger: list[str] = STRONGER, weaker: list[str] = WEAKER) -> Column:
    """Of tokens an array of (word, weight): negated words begin with ``not_``."""
    turns = lambda t: t.isin(negations) | t.endswith("n't")

    def one(t: Column, i: Column) -> Column:
        before = F.slice(words, F.greatest(i - (SCOPE - 1), F.lit(1)), F.least(i, F.lit(SCOPE)))
        turned = F.aggregate(before, F.lit(False), lambda held, b: F.when(b.isin(_STOPS), F.lit(False)).otherwise(held | turns(b)))
        last = F.get(words, i - 1)
        weight = F.when(last.isin(stronger), MORE).when(last.isin(weaker), LESS).otherwise(PLAIN)
        return F.struct(F.when(turned, F.concat(F.lit("not_"), t)).otherwise(t).alias("word"), weight.alias("weight"))

    own = F.transform(words, lambda t, i: F.struct(t.alias("t"), one(t, i).alias("found")))
    kept = F.filter(own, lambda x: ~(x["t"].isin(_STOPS + negations + stronger + weaker) | x["t"].endswith("n't")))
    return F.transform(kept, lambda x: x["found"])


def weighted_words(texts: DataFrame, key: str, words: Column, **scopes) -> DataFrame:
    """key, word, weight: each text's words once, their weights added up.  Texts are dealt by key, so their words are not."""
    # The tokens have a column of their own: inside the lambdas they would be found anew for each word.
    rows = dealt(texts, key).select(key, words.alias("_tokens")).select(key, F.inline(scoped(F.col("_tokens"), **scopes)))
    return rows.groupBy(key, "word").agg(F.sum("weight").cast("long").alias("weight"))


def class_counts(words: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """word, pos, neg: weights in the texts of each class; ``classes`` has key and positive (boolean), one row a text."""
    rows = words.join(classes.where("positive IS NOT NULL"), key)
    sums = {name: F.sum(F.when(F.col("positive") == side, F.col("weight")).otherwise(0)).alias(name) for name, side in (("pos", True), ("neg", False))}
    return rows.groupBy("word").agg(*sums.values())


def bayes_scores(words: DataFrame, counts: DataFrame, texts: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """key, log_odds, score (-1 to 1) of every text: the class's prior and its words' odds, smoothed by one.

    Words that no text of a class has, and texts without words, leave the prior.  The model is
    written, so that Spark knows its size: where it can be sent to all tasks no word is shuffled.
    """
    counts = Tables(counts.sparkSession, "bayes").write(counts, "counts")
    whole = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("all_neg"), F.count(F.lit(1)).alias("size"))
    sides = classes.where("positive IS NOT NULL").agg(*(F.count(F.when(F.col("positive") == side, 1)).alias(name) for name, side in (("n_pos", True), ("n_neg", False))))
    odds = F.log((F.col("pos") + 1.0) / (F.col("all_pos") + F.col("size"))) - F.log((F.col("neg") + 1.0) / (F.col("all_neg") + F.col("size")))
    model = counts.crossJoin(F.broadcast(whole)).select("word", odds.alias("_odds"))  # one row
    moved = words.join(model, "word").groupBy(key).agg((F.sum(F.col("weight") * F.col("_odds")) / PLAIN).alias("_moved"))
    prior = F.log(F.col("n_pos") + 1.0) - F.log(F.col("n_neg") + 1.0)
    found = texts.select(key).join(moved, key, "left").crossJoin(F.broadcast(sides))  # one row
    found = found.select(key, (prior + F.coalesce("_moved", F.lit(0.0))).alias("log_odds"))
    return found.withColumn("score", F.tanh(F.col("log_odds") / 2))


# --------------------------------------------------------------------------- segmentation


class Segmenter:
    """Cuts text into the words of its most probable segmentation.

    A word's probability is its share of all counts; a character that is no word has half of
    one count.  Of equally probable segmentations the one whose last words are longer.
    """

    def __init__(self, counts: dict[str, int]):
        total = math.log(max(sum(counts.values()), 1))
        self.costs = {w: total - math.log(n) for w, n in counts.items() if w and n > 0}
        self.unknown = total + math.log(2)
        self.longest = max(map(len, self.costs), default=1)

    def cut(self, text: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            cost, start = min(
                (best[s] + c, s)
                for s in range(max(0, end - self.longest), end)
                if (c := self.costs.get(text[s:end], self.unknown if s == end - 1 else None)) is not None
            )
            best.append(cost)
            back.append(start)
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]


def dictionary(counts: DataFrame, most: int = DICTIONARY) -> Segmenter:
    """From a table word, n: its ``most`` most frequent words of up to LONGEST characters."""
    rows = counts.where((F.length("word") > 0) & (F.length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(most).select("word", "n")
    return Segmenter({r.word: r.n for r in rows.collect()})


def segmented(texts: DataFrame, key: str, text: str, words: Segmenter) -> DataFrame:
    """key, words: stretches without blanks or punctuation cut by the dictionary, punctuation left in place."""
    import regex

    token = regex.compile(r"[^\s.,;:!?。，；：！？、]+|[.,;:!?\n。，；：！？、]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1).to_pylist():
                out: list[str] = []
                for part in token.findall(value or ""):
                    out += words.cut(part)
                found.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=[key, "words"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.lower(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, words array<string>")
