"""Language identification by rank-order n-gram profiles.

A text is folded to lower-case letters with single blanks between words and around
them; its 1- to 3-grams are ordered by count, ties by code point.  A language's profile
is the same order over all its training texts.  The out-of-place distance sums, over the
document's most frequent n-grams, how far each one's rank is from its rank in the
profile, with the profile's length for n-grams that it lacks; the nearest language wins,
ties by name.

Defined cases: texts that are null, empty or without a letter get ``und`` and score 0;
without any learned language every text gets ``und``; null ``doc_id`` is never held out;
repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch

UNKNOWN = "und"
#: n-grams in a language's profile and in a document's.
PROFILE, OWN = 1000, 400
#: Languages up to which the profiles are shipped to the tasks; more are an error.
MAX_LANGUAGES = 2000
_BITS, _BLANK = np.uint64(21), np.uint64(1)


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point its lower-case form, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 and low.isalpha() else code
    return table


def letters(text: str) -> np.ndarray:
    """Folded code points, 1 at the start, the end and once between words."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = np.zeros(len(codes) + 2, np.uint64)
    folded[1:-1] = _fold()[codes]
    keep = folded != 0
    keep[1:] |= folded[:-1] != 0
    keep[0] = True
    return np.maximum(folded[keep], _BLANK)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a character) of the 1- to 3-grams, ascending, and their counts."""
    c = letters(text)
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pairs = c[:-1] << _BITS | c[1:]
    triples = pairs[:-1] << _BITS | c[2:]
    grams = np.concatenate([c[c != _BLANK], pairs, triples[c[1:-1] != _BLANK]])
    return np.unique(grams, return_counts=True)


def profile(text: str, size: int = OWN) -> np.ndarray:
    """The n-grams of a text, the most frequent first."""
    grams, counts = ngram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out():
    """Documents kept from training: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, dict[int, int]] = {}
    buffered: dict[str, list] = {}

    def flush() -> None:
        for lang, parts in buffered.items():
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
            own = sums.setdefault(lang, {})
            for gram, n in zip(grams.tolist(), counts.tolist(), strict=True):
                own[gram] = own.get(gram, 0) + n
        buffered.clear()

    def drain() -> Iterator[pa.RecordBatch]:
        flush()
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"]
            )
        sums.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            buffered.setdefault(batch.column(0)[i].as_py(), []).append(ngram_counts(batch.column(1)[i].as_py().decode("utf-8", "replace")))
            if i % 500 == 499:
                flush()
        flush()
        if sum(map(len, sums.values())) > 250_000:
            yield from drain()
    yield from drain()


def learn(training: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0): each language's profile over all its training texts.

    Tasks add up their own documents first, so what is shuffled is bounded by the
    n-grams that each task has seen, not by its text.
    """
    rows = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.select(F.col(lang).cast("string"), F.col(text).cast("binary")).mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counts = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    return counts.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def gather(profiles: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, the n-grams of any profile ascending, and ranks[gram, language].

    Bounded by languages times the profile's length, which is checked.
    """
    profiles = Scratch(profiles.sparkSession, "language_id").write(profiles, "profiles")
    languages = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages.sort()
    rows = profiles.collect() if languages else []
    size = max([r["rank"] for r in rows], default=-1) + 1
    grams = np.unique(np.array([r["gram"] for r in rows], np.uint64))
    ranks = np.full((len(grams), len(languages)), size, np.int32)
    place = {lang: i for i, lang in enumerate(languages)}
    if rows:
        at = np.searchsorted(grams, np.array([r["gram"] for r in rows], np.uint64))
        ranks[at, [place[r["lang"]] for r in rows]] = [r["rank"] for r in rows]
    return languages, grams, ranks


def _predictor(model: tuple[list[str], np.ndarray, np.ndarray], own: int):
    languages, grams, ranks = model
    size = np.int32(max(int(ranks.max()) if ranks.size else 0, 1))

    def of(text: str) -> tuple[str, float]:
        mine = profile(text, own)
        if not len(mine) or not languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
        there = grams[at] == mine
        places = np.where(there[:, None], ranks[at], size)
        off = np.where(places < size, np.abs(places - np.arange(len(mine), dtype=np.int32)[:, None]), size)
        distance = np.minimum(off, size).sum(axis=0)
        best = int(np.argmin(distance))
        return languages[best], 1.0 - float(distance[best]) / (float(size) * len(mine))

    return of


def predictor(spark: SparkSession, model: tuple[list[str], np.ndarray, np.ndarray], own: int = OWN):
    """A function from a text column to a struct of lang_pred and score.

    Only the text goes to Python, in Arrow batches.  score is 1 - distance / (the distance
    of a text that shares no n-gram).
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        one = _predictor(shared.value, own)
        found = [(UNKNOWN, 0.0) if x.as_py() is None else one(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang_pred", "score"])

    return of


def language(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", own: int = OWN) -> Column:
    """The predicted language of each row of docs, as a column."""
    return predictor(docs.sparkSession, model, own)(F.col(text).cast("string"))["lang_pred"]


def annotate(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", own: int = OWN) -> DataFrame:
    """All columns of docs with lang_pred and score (columns of these names are replaced)."""
    found = docs.withColumn("lang_pred", predictor(docs.sparkSession, model, own)(F.col(text).cast("string")))
    return found.withColumns({"score": F.col("lang_pred.score"), "lang_pred": F.col("lang_pred.lang_pred")})


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", own: int = OWN) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col(text).alias("text"))
    return annotate(rows, model, "text", own).select("doc_id", "held_out", "lang_pred", "score")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out, then predicts for all."""
    return predict(docs, gather(learn(docs.where(~held_out()), text, lang)), text)
