"""Cross-entropy difference between a target and a background language model.

Both models are interpolated trigram models over one vocabulary: the bytes that occur in
the lower-cased corpus, with a boundary symbol before and behind each text.  The target
model counts the texts named as target, the background model counts all texts.  The
models are matched: they have the same order, vocabulary and smoothing, and background
counts are scaled to the target's number of tokens, so that the prior weighs as much in
one as in the other.  A document's score is the mean over its tokens of the target's loss
less the background's, in nats; lower is nearer to the target.

Counting covers every text.  Each task adds up its own texts, so what is shuffled grows
with tasks and not with text; a model has at most 257 ** 3 entries whatever the corpus,
which bounds what the driver builds and the tasks receive.

Defined cases: null and empty texts consist of the closing boundary; without any target
text both models are uniform where they know nothing and the target's loss is that of the
uniform model; a document that is listed as target twice counts twice; repeated rows
repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import LOWER, Texts, steps, text_bytes

#: Tokens that the next shorter model's distribution counts for.
PRIOR = 50.0
#: Symbol 0 is the boundary; byte b is symbol b + 1.
SYMBOLS = 257


def trigrams(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams that end at each byte and at each text's close, and their rows."""
    sizes = np.diff(part.bounds)
    row = np.repeat(np.arange(part.rows), sizes + 3)
    symbols = np.zeros(len(part.data) + 3 * part.rows, np.int32)
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    at = np.arange(len(part.data)) - np.repeat(part.bounds[:-1], sizes) + np.repeat(starts + 2, sizes)
    symbols[at] = LOWER[part.data].astype(np.int32) + 1
    ends = np.ones(len(symbols), bool)
    ends[starts] = ends[starts + 1] = False
    third = np.flatnonzero(ends)
    return (symbols[third - 2] * SYMBOLS + symbols[third - 1]) * SYMBOLS + symbols[third], row[third]


def _counts(code: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes with their counts; one may come twice, for what counts once and for what counts more often."""
    if times is None:
        return np.unique(code, return_counts=True)
    once = times == 1
    found, n = np.unique(code[once], return_counts=True)
    if once.all():
        return found, n
    more, at = np.unique(code[~once], return_inverse=True)
    return np.concatenate([found, more]), np.concatenate([n, np.bincount(at, times[~once], len(more)).astype(np.int64)])


def _summed(batches: Iterator[pa.RecordBatch], weighted: bool) -> pa.RecordBatch:
    """One task's trigrams with their counts; weighted by the first column or not."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        times = batch.column(0).to_numpy(zero_copy_only=False) if weighted else None
        for part in steps(column):
            code, row = trigrams(part)
            found, n = _counts(code, times[part.first_row + row] if weighted else None)
            codes, at = np.unique(np.concatenate([codes, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])


def _count_background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _summed(batches, weighted=False)


def _count_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _summed(batches, weighted=True)


def count_trigrams(docs: DataFrame, targets: DataFrame, text: str = "text") -> DataFrame:
    """code, target, background: how often each trigram occurs in the target's and in all texts.

    ``targets`` has the doc_id of the target documents.
    """
    chosen = targets.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.count(F.lit(1)).alias("times"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("bytes"))
    # Targets grow with the corpus, so they are joined by a shuffle at every size; all texts are counted in place.
    own = rows.join(chosen.hint("merge"), F.col("doc_id") == F.col("of")).select("times", "bytes").mapInArrow(_count_target, "code long, n long")
    every = rows.select("bytes").mapInArrow(_count_background, "code long, n long")
    zero = F.lit(0).cast("long")
    both = every.select("code", zero.alias("target"), F.col("n").alias("background")).unionAll(own.select("code", F.col("n").alias("target"), zero.alias("background")))
    return both.groupBy("code").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Model:
    """Losses in nats of both models, for the trigrams over the symbols that occur."""

    def __init__(self, codes: np.ndarray, target: np.ndarray, background: np.ndarray, prior: float = PRIOR):
        first, second, third = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        self.alphabet = np.unique(np.concatenate([[0], first, second, third]))
        n = len(self.alphabet)
        self.place = np.full(SYMBOLS, -1, np.int64)
        self.place[self.alphabet] = np.arange(n)
        at = (self.place[first] * n + self.place[second]) * n + self.place[third]
        scale = target.sum() / background.sum() if background.sum() and target.sum() else 1.0
        self.target = self._losses(at, target.astype(np.float64), n, prior)
        self.background = self._losses(at, background * scale, n, prior)

    @staticmethod
    def _losses(at: np.ndarray, counts: np.ndarray, n: int, prior: float) -> np.ndarray:
        three = np.bincount(at, counts, n**3).reshape(n, n, n)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + prior * p1) / (two.sum(axis=1, keepdims=True) + prior)
        out = np.empty((n, n, n), np.float32)
        for a in range(n):  # a slice at a time, so that no second full table is made
            out[a] = -np.log((three[a] + prior * p2) / (three[a].sum(axis=1, keepdims=True) + prior))
        return out.ravel()

    def losses(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.alphabet)
        at = (self.place[code // SYMBOLS**2] * n + self.place[code // SYMBOLS % SYMBOLS]) * n + self.place[code % SYMBOLS]
        return self.target[at], self.background[at]


def fit(docs: DataFrame, targets: DataFrame, text: str = "text", prior: float = PRIOR) -> Model:
    """The matched models; at most 257 ** 3 counts reach the driver."""
    counts = count_trigrams(docs, targets, text).toArrow()
    return Model(*(counts.column(i).to_numpy() for i in range(3)), prior=prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of each whole text; map-only.

    The model must know every byte of the texts, as one fitted on them does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, losses = [np.zeros(0, np.int64)], [[np.zeros(0)], [np.zeros(0)]]
            for part in steps(batch.column(1)):
                code, row = trigrams(part)
                n.append(np.bincount(row, minlength=part.rows))
                for out, loss in zip(losses, known.losses(code), strict=True):
                    out.append(np.bincount(row, loss, part.rows))
            tokens = np.concatenate(n)
            target, background = (np.concatenate(x) / np.maximum(tokens, 1) for x in losses)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens.astype(np.int64)), pa.array(target), pa.array(background), pa.array(target - background)],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, text: str = "text") -> DataFrame:
    """Fits both models on the whole corpus and scores every document of it."""
    return score(docs, fit(docs, targets, text), text)
