"""Cross-entropy difference between a target and a background word model.

Both models are interpolated bigram models over one vocabulary: every word of the
lower-cased corpus, and a boundary before and behind each text.  The target model counts
the texts named as target, the background model all texts.  The models are matched: same
order, vocabulary and smoothing, and background counts are scaled to the target's number
of tokens.  A document's score is the mean over its tokens of the target's loss less the
background's, in nats; lower is nearer to the target.

Every word and word pair of the corpus is counted and kept, so the model grows with the
corpus.  Texts are packed in chunks.  A chunk's distinct n-grams go, sorted and cut in
buckets by hash, to the task that adds up their bucket, and their totals return to the
chunk in the same order.  Only three sums reach the driver.

Defined cases: null and empty texts consist of the closing boundary; without any target
text the target model is that of the smoothing alone; a document that is listed as target
twice counts twice; repeated rows repeat; an empty table gives an empty result; other
columns are not read.  Words are 63-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch, mix, steps, text_bytes
from quantloom.llm.lm_score import PRIOR

#: Text bytes of a chunk, and of what a bucket adds up, about.
CHUNK_BYTES, BUCKET_BYTES = 1 << 21, 1 << 23
_EVEN, _ODD = np.uint64((1 << 64) - 2), np.uint64(1)
#: Words have even keys, pairs odd ones; this is the boundary's.
BOUNDARY = mix(np.array([0xB0], np.uint64))[0] & _EVEN

_CHUNK = "chunk long, size long, ids array<long>, times array<long>, bounds array<long>, data binary"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _planes(x: np.ndarray) -> bytes:
    """64-bit values byte by byte, so that bytes that hardly differ lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(_planes(counts), 1)


def _values(blob: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _chunked(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def one() -> pa.RecordBatch:
            ids, times, texts = zip(*held, strict=True)
            bounds = np.cumsum([0, *map(len, texts)])
            data = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (ids, times, bounds.tolist())]
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([size]), *lists, pa.array([data], pa.binary())], names=["chunk", "size", "ids", "times", "bounds", "data"])

        for batch in batches:
            for doc_id, times, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((doc_id, times, text))
                size += len(text)
                if size >= limit:
                    yield one()
                    held, size, at = [], 0, at + 1
        if held:
            yield one()

    return run


def _tokens(bounds: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of a chunk, the closing boundaries among them, and their rows."""
    raw = pa.decompress(data, decompressed_size=int(bounds[-1]), codec="zstd")
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), raw])
    tokens, rows = [], []
    for part in steps(column):
        part = part.lower()
        starts, ends, ranges = part.words()
        counts = np.diff(ranges) + 1
        out = np.full(len(starts) + part.rows, BOUNDARY, np.uint64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[inner] = part.hash_spans(starts, ends) & _EVEN
        tokens.append(out)
        rows.append(part.first_row + np.repeat(np.arange(part.rows), counts))
    return np.concatenate(tokens), np.concatenate(rows)


def _grams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of a chunk's words and pairs, and where each word and then each pair is."""
    before = np.concatenate([[BOUNDARY], tokens[:-1]])  # a text begins behind the boundary that closes the one before
    pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(tokens)) | _ODD
    return np.unique(np.concatenate([tokens, pairs]), return_inverse=True)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens, at = _tokens(np.array(row["bounds"], np.int64), row["data"])
                keys, place = _grams(tokens)
                times = np.tile(np.array(row["times"], np.int64)[at], 2)
                target = np.bincount(place, times, len(keys)).astype(np.int64)
                every = np.bincount(place, minlength=len(keys)).astype(np.int64)
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                found, first = np.unique(bucket, return_index=True)
                ends = [*first[1:].tolist(), len(keys)]
                spans = list(zip(first.tolist(), ends, strict=True))
                blobs = [[_planes(keys[i:j]) for i, j in spans], *([_packed(x[i:j]) for i, j in spans] for x in (target, every))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), row["chunk"])), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "chunk", "keys", "target", "background"]
                )

    return run


def _total(table: pa.Table) -> pa.Table:
    """A bucket's totals for each chunk, in the order of its keys; the first row has the sums over words."""
    rows = table.to_pydict()
    parts = [_values(x, np.uint64) for x in rows["keys"]]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    sums = [np.bincount(place, np.concatenate([_values(zlib.decompress(x), np.int64) for x in rows[c]]), len(keys)).astype(np.int64) for c in ("target", "background")]
    words = keys & _ODD == 0
    cuts = np.cumsum([0, *map(len, parts)])
    blobs = [[_packed(x[place[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)] for x in sums]
    n = len(parts)
    once = lambda x: pa.array([int(x)] + [0] * (n - 1), pa.int64())
    return pa.table(
        {
            "chunk": pa.array(rows["chunk"], pa.int64()),
            "bucket": pa.array(rows["bucket"], pa.int64()),
            "target": pa.array(blobs[0], pa.binary()),
            "background": pa.array(blobs[1], pa.binary()),
            "words": once(words.sum()),
            "n_target": once(sums[0][words].sum()),
            "n_background": once(sums[1][words].sum()),
        }
    )


def _losses(chunk: pa.Table, totals: pa.Table, words: int, n_target: int, n_background: int, prior: float) -> pa.Table:
    out = []
    for row in chunk.to_pylist():
        tokens, at = _tokens(np.array(row["bounds"], np.int64), row["data"])
        keys, place = _grams(tokens)
        word, pair = place[: len(tokens)], place[len(tokens) :]
        before = np.concatenate([[np.searchsorted(keys, BOUNDARY)], word[:-1]])
        pieces = totals.sort_by("bucket").to_pydict()
        scale = n_target / n_background if n_target and n_background else 1.0
        losses = []
        for name, n, by in (("target", n_target, 1.0), ("background", n_background, scale)):
            count = np.concatenate([_values(zlib.decompress(x), np.int64) for x in pieces[name]]) * by
            single = (count[word] + 1) / (n * by + words)
            losses.append(-np.log((count[pair] + prior * single) / (count[before] + prior)))
        held = np.bincount(at, minlength=len(row["ids"]))
        target, background = (np.bincount(at, x, len(held)) / held for x in losses)
        columns = [pa.array(row["ids"], pa.int64()), pa.array(held.astype(np.int64)), *map(pa.array, (target, background, target - background))]
        out.append(pa.table(columns, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"]))
    return pa.concat_tables(out)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, text: str = "text", prior: float = PRIOR, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Fits both models on the whole corpus and scores every document of it.

    ``targets`` has the doc_id of the target documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "word_lm")
    chunks = scratch.write(_marked(docs, targets, text).mapInArrow(_chunked(chunk), _CHUNK), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / BUCKET_BYTES))
    totals = scratch.write(_totals(chunks, buckets), "totals")
    sums = [x or 0 for x in totals.agg(F.sum("words"), F.sum("n_target"), F.sum("n_background")).first()]
    back = totals.select("chunk", "bucket", "target", "background")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lambda a, b: _losses(a, b, *sums, prior), _SCORES)


def _marked(docs: DataFrame, targets: DataFrame, text: str) -> DataFrame:
    """doc_id, how often it is a target, and its bytes."""
    chosen = targets.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.count(F.lit(1)).alias("times"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("bytes"))
    # Targets grow with the corpus, so they are joined by a shuffle at every size.
    rows = rows.join(chosen.hint("merge"), F.col("doc_id") == F.col("of"), "left")
    return rows.select("doc_id", F.coalesce("times", F.lit(0).cast("long")).alias("times"), "bytes")


def _totals(chunks: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's totals by bucket, from the n-grams of all chunks."""
    grams = chunks.mapInArrow(_count(buckets), "bucket long, chunk long, keys binary, target binary, background binary")
    return grams.groupBy("bucket").applyInArrow(_total, "chunk long, bucket long, target binary, background binary, words long, n_target long, n_background long")
