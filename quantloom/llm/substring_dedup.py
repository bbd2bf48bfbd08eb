"""Substring dedup by content-defined chunking.

A gear hash rolls over the last 16 bytes of the text; where it falls below a threshold
the text is cut, so an insertion moves only the cuts near it.  Every chunk's digest
belongs to the first document (by doc_id) that holds it, and chunks of later documents
with that digest are duplicates.  Neighbouring duplicate chunks form a span, and spans
with enough words are reported.

Chunks are short (about 20 bytes) so that a passage of over 50 words, whatever stands
around it, contains chunks for all but a few words at either end.

Defined cases: null and empty texts have no chunks; rows with a null doc_id are not
compared; rows that repeat a doc_id count as one document and never repeat one another; of
equal chunks (a tie) the one of the least doc_id owns the digest; very long texts are cut as
others are, a task holds one whole; bytes that are no UTF-8 are compared as they stand, and
a run of more than three of them may be cut anywhere; an empty table gives an empty result;
only doc_id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch, mix, signed, steps, text_bytes

#: One cut in so many bytes on average; bytes of a chunk at least and at most.
MEAN, LEAST, MOST = 16, 8, 2048
#: Words of a reported span, at least.
SPAN_WORDS = 24
#: The gear's value of each byte, from a rule.
GEAR = (mix(np.arange(1001, 1257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_WINDOW = 16


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes up to each place: sums of shifted values, by doubling."""
    state = GEAR[data]
    width = 1
    while width < _WINDOW:
        state[width:] = state[width:] + (state[:-width] << np.uint32(width))
        width *= 2
    return state


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; a cut never splits a UTF-8 character."""
    if not len(data):
        return np.zeros(0, np.int64)
    low = gear(data) < np.uint32((1 << 32) // MEAN)
    low[:-1] &= (data[1:] & 0xC0) != 0x80
    return _spaced(np.flatnonzero(low) + 1, len(data), data)


def _spaced(places: np.ndarray, length: int, data: np.ndarray) -> np.ndarray:
    """Drops cuts that are too near the one before and adds some where none comes."""
    out, before = [], 0
    for place in [*places.tolist(), length]:
        while place - before > MOST:
            before += MOST
            # Back to the start of a character; where none is so near, the bytes are no UTF-8.
            before -= next((i for i in range(4) if data[before - i] & 0xC0 != 0x80), 0)
            out.append(before)
        if place - before >= LEAST or place == length and place > before:
            out.append(place)
            before = place
    return np.array(out, np.int64)


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for part in steps(batch.column(1)):
            state = [cuts(part.data[s:e]) + s for s, e in zip(part.bounds[:-1], part.bounds[1:], strict=True)]
            ends = np.concatenate(state)
            counts = np.array([len(x) for x in state], np.int64)
            starts = np.empty_like(ends)
            starts[1:] = ends[:-1]
            firsts = np.cumsum(counts) - counts
            starts[firsts[counts > 0]] = part.bounds[:-1][counts > 0]
            points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
            words, _, _ = part.words()
            row = np.repeat(np.arange(part.rows), counts)
            # Where the chunk starts, its code points and the words that begin in it.
            begin = points[starts] - points[part.bounds[:-1]][row]
            n_words = np.minimum(np.searchsorted(words, ends) - np.searchsorted(words, starts), 4095)
            place = begin << 24 | (points[ends] - points[starts]) << 12 | n_words
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(part.hash_spans(starts, ends))), pa.array(ids[part.first_row + row]), pa.array(place)], names=["digest", "doc_id", "place"]
            )


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest, doc_id and place (start, length and words packed) of every chunk."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_bytes(text))
    return rows.mapInArrow(_chunk, "digest long, doc_id long, place long")


_LATER = "doc_id long, place long, owner long, digest long"


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (digest, doc_id): those of other documents than the digest's first.

    Streams: only the current digest and its owner are kept, however many rows it has.
    A digest may go on over several ranges, so the rows of a range's first digest all come
    out, with their digest, and the owners found of its first and last digest without a place.
    """
    held = owner = first = None

    def made(doc: np.ndarray, place: np.ndarray, owners: np.ndarray, digest: np.ndarray) -> pa.RecordBatch:
        # A digest other than the first is settled here and not needed again.
        columns = [pa.array(doc), pa.array(place, mask=place < 0), pa.array(owners), pa.array(digest, mask=(digest != first) & (place >= 0))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "owner", "digest"])

    def edge(digest: int, of: int) -> pa.RecordBatch:
        one = lambda x: np.array([x], np.int64)
        return made(one(of), one(-1), one(of), one(digest))

    for batch in batches:
        digest, doc, place = (batch.column(i).to_numpy() for i in range(3))
        if not len(digest):
            continue
        new = np.ones(len(digest), bool)
        new[1:] = digest[1:] != digest[:-1]
        if held is not None and digest[0] == held:
            new[0] = False
        last = np.maximum.accumulate(np.where(new, np.arange(len(digest)), -1))
        owners = np.where(last >= 0, doc[last], owner if owner is not None else 0)
        if first is None:
            first = digest[0]
            yield edge(first, owners[0])
        held, owner = digest[-1], owners[-1]
        out = np.flatnonzero((owners != doc) | (digest == first))
        yield made(doc[out], place[out], owners[out], digest[out])
    if held is not None:
        yield edge(held, owner)


def later_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, place, owner of the chunks whose digest an earlier document owns.

    Chunks are dealt by ranges of (digest, doc_id): a digest that a large share of all chunks
    has spreads over many tasks.  Owners at the ends of the ranges, two a range, put its
    pieces together.
    """
    ranged = chunks(docs, text).repartitionByRange("digest", "doc_id").sortWithinPartitions("digest", "doc_id")
    found = Scratch(docs.sparkSession, "substring_dedup").write(ranged.mapInArrow(_later, _LATER), "later")
    ends = found.where("place IS NULL").groupBy(F.col("digest").alias("end")).agg(F.min("owner").alias("least"))
    # At most two rows a range; a chunk that is settled has no digest and meets none of them.
    later = found.where("place IS NOT NULL").join(F.broadcast(ends), F.col("digest") == F.col("end"), "left")
    later = later.select("doc_id", "place", F.coalesce("least", "owner").alias("owner"))
    return later.where("doc_id != owner").distinct()


def repeated_spans(docs: DataFrame, text: str = "text", span_words: int = SPAN_WORDS) -> DataFrame:
    """doc_id, start and end (code points), n_words, first_doc_id of each repeated span.

    ``first_doc_id`` is the first document that holds the span's first chunk.
    """
    later = later_chunks(docs, text)
    later = later.select(
        "doc_id", "owner", F.shiftright("place", 24).alias("start"), F.shiftright("place", 12).bitwiseAND(F.lit(4095)).alias("size"), F.col("place").bitwiseAND(F.lit(4095)).alias("words")
    )
    order = Window.partitionBy("doc_id").orderBy("start")
    broken = F.when(F.lag(F.col("start") + F.col("size")).over(order) == F.col("start"), 0).otherwise(1)
    later = later.withColumn("island", broken).withColumn("island", F.sum("island").over(order))
    spans = later.groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("n_words"), F.min_by("owner", "start").alias("first_doc_id")
    )
    return spans.where(F.col("n_words") >= span_words).drop("island")
