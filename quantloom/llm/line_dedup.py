"""Line dedup by pairwise alignment.

Evidence that documents overlap are runs of consecutive lines: from each line that has a
word the shortest run with enough words, which is the line alone where it has enough.
Every run has an owner, the first document (by doc_id) that holds it.  A document is
compared with the owners of its runs only, so work is linear in lines however many copies
there are.  Every shared run is evidence, however many documents hold it, so results do
not depend on the corpus size.  A document and each owner of its runs are aligned by
patience diff over line hashes, and the aligned common blocks (consecutive in both) with
enough words are deleted from the later document.

Defined cases: a null text has no lines and stays null; an empty text is one empty line;
rows with a null doc_id are returned unchanged; rows that repeat both doc_id and text are
one document and get the same result; of rows that repeat only doc_id, the one with the
least text hash is compared and the others stay unchanged; an empty table gives an empty
result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch, mix, powers, signed, steps, text_bytes

#: Words of a run that is evidence, and of a block that is deleted, at least.
LINE_WORDS = 8


def _runs(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the shortest runs with enough words, by the lines that they begin with."""
    begun = np.concatenate([[0], np.cumsum(words)])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.searchsorted(begun, begun[:-1] + least)  # lines up to here have enough
    first = np.flatnonzero((words > 0) & (end <= bounds[1:][row]))
    up, down = powers(len(hashes) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up[: len(hashes)])])
    return row[first], mix((prefix[end[first]] - prefix[first]) * down[first] + (end[first] - first).astype(np.uint64))


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.column(2)):
                breaks = np.flatnonzero(part.data == 10)
                starts = np.sort(np.concatenate([part.bounds[:-1], breaks + 1]))
                ends = np.sort(np.concatenate([breaks, part.bounds[1:]]))
                begun, _, _ = part.words()
                words = np.searchsorted(begun, ends) - np.searchsorted(begun, starts)
                bounds = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, part.bounds)) + 1)])
                hashes = part.hash_spans(starts, ends)
                row, runs = _runs(hashes, words, bounds, least)
                offsets, run_offsets = pa.array(bounds, pa.int32()), pa.array(np.searchsorted(row, np.arange(part.rows + 1)), pa.int32())
                ids = (batch.column(i).slice(part.first_row, part.rows) for i in range(2))
                lists = (
                    pa.ListArray.from_arrays(offsets, pa.array(signed(hashes))),
                    pa.ListArray.from_arrays(offsets, pa.array(words, pa.int64())),
                    pa.ListArray.from_arrays(run_offsets, pa.array(signed(runs))),
                )
                yield pa.RecordBatch.from_arrays([*ids, *lists], names=["doc_id", "text_hash", "hashes", "words", "runs"])

    return run


def line_table(docs: DataFrame, text: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """doc_id, text_hash, per line its hash and words, and the hashes of its runs; one row per doc_id."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text_bytes(text)
    )
    rows = rows.mapInArrow(_lines(line_words), "doc_id long, text_hash long, hashes array<long>, words array<long>, runs array<long>")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", "hashes", "words", "runs")).alias("x")).select("doc_id", "x.*")


def overlapping(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """owner, doc_id: later documents with the owner of every run that they share.

    Owners are written first: Spark can split a join of two tables where a run is frequent,
    but not one whose other side it aggregates in the same stage.
    """
    each = lines.select("doc_id", F.explode("runs").alias("hash"))
    owners = each.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    owners = scratch.write(owners, "owners")
    return each.join(owners, "hash").where("doc_id > owner").select("owner", "doc_id").distinct()


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of the common lines, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _rising(_unique(a[a0:a1], b[b0:b1])) or _rising(_occurrences(a[a0:a1], b[b0:b1]))
        if not chain:
            continue
        chain = [(j + b0, i + a0) for j, i in chain]
        at_a, at_b = a0, b0
        for j, i in chain:
            todo.append((at_a, i, at_b, j))
            out.append((i, j))
            at_a, at_b = i + 1, j + 1
        todo.append((at_a, a1, at_b, b1))
    return sorted(out, key=lambda x: x[1])


def _unique(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in b, in a) of the lines that occur once in each, ascending in b."""
    in_a, in_b = Counter(a), Counter(b)
    at = {x: i for i, x in enumerate(a)}
    return [(j, at[x]) for j, x in enumerate(b) if in_b[x] == 1 == in_a[x]]


def _occurrences(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """As _unique, the n-th occurrence of a line in b with the n-th in a."""
    numbered = []
    for lines in (a, b):
        seen: Counter[int] = Counter()
        numbered.append([(x, seen.update([x]) or seen[x]) for x in lines])
    at = {x: i for i, x in enumerate(numbered[0])}
    return [(j, at[x]) for j, x in enumerate(numbered[1]) if x in at]


def _rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of points, ascending in the first, that also ascends in the second."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for n, (_, i) in enumerate(points):
        pile = bisect_left(tops, i)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(i)
            top_at.append(n)
        else:
            tops[pile], top_at[pile] = i, n
    out, n = [], top_at[-1] if top_at else -1
    while n >= 0:
        out.append(points[n])
        n = back[n]
    return out[::-1]


def repeated_lines(a: list[int], b: list[int], words: list[int], block_words: int = LINE_WORDS) -> list[int]:
    """Positions in b of aligned blocks (consecutive in both) with enough words."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for pair in [*patience(a, b), (-5, -5)]:
        if pair != (before[0] + 1, before[1] + 1):
            if sum(words[j] for j in block) >= block_words:
                out += block
            block = []
        block.append(pair[1])
        before = pair
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            _, a, b, words = (c.to_pylist() for c in part.columns)
            gone = [repeated_lines(*row) for row in zip(a, b, words, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "gone"])


def repeated(docs: DataFrame, text: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """doc_id, text_hash, gone: positions of the lines to delete, for documents with any."""
    scratch = Scratch(docs.sparkSession, "line_dedup")
    lines = scratch.write(line_table(docs, text, line_words), "lines")
    pairs = scratch.write(overlapping(lines, scratch), "pairs")
    first = lines.select(F.col("doc_id").alias("owner"), F.col("hashes").alias("a"))
    both = pairs.join(first, "owner").join(lines, "doc_id").select("doc_id", "a", F.col("hashes").alias("b"), "words")
    gone = both.mapInArrow(_align, "doc_id long, gone array<int>").where(F.size("gone") > 0)
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return scratch.write(gone.join(lines.select("doc_id", "text_hash"), "doc_id"), "gone")


def _with_gone(rows: DataFrame, docs: DataFrame, text: str, line_words: int) -> DataFrame:
    """``rows`` (with doc_id and text_hash of each row of docs) and the positions gone, null if none."""
    gone = repeated(docs, text, line_words).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "gone")
    return rows.join(gone, F.expr("doc_id = of AND text_hash = of_hash"), "left").drop("of", "of_hash")


def trimmed(docs: DataFrame, text: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """row (all columns of docs, as they are), rest (the text that remains), lines_before and lines_gone."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("whole"))
    joined = _with_gone(rows, docs, text, line_words)
    lines = F.split("whole", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("whole")).otherwise(rest).alias("rest"),
        F.when(F.col("whole").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("lines_before"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_gone"),
    )


def remaining(docs: DataFrame, text: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """The rows of docs with the repeated lines taken out of the text, and the columns
    ``lines_before`` and ``lines_gone`` behind (columns of docs with these names are replaced)."""
    found = trimmed(docs, text, line_words)
    own = [F.col("rest").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lines_before", "lines_gone")]
    return found.select(*own, "lines_before", "lines_gone")


def removals(docs: DataFrame, text: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """doc_id, lines_before, lines_gone and the positions gone of each row, without its text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.regexp_count(F.col(text), F.lit("\n")) + 1, F.lit(0)).cast("long").alias("lines_before"),
    )
    joined = _with_gone(rows, docs, text, line_words)
    return joined.select("doc_id", "lines_before", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_gone"), F.array_join("gone", ",").alias("gone"))
