"""Quality rules judged by host.

Each document is measured once, in one pass over its whole text.  Rule failures are
summed by host, every host's failure rates are shrunk towards the corpus by a beta
prior fitted to the hosts by moments, and the hosts' verdicts are joined back.

Defined cases: a null or empty text has no words and fails the base rule; documents
without a host form a host of their own; repeated rows each count and each return;
an empty table gives an empty result.  Only ``doc_id`` and computed columns are
returned, so further columns of the input cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, Scratch, in_row, steps, text_bytes, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_CONTINUED = (np.arange(256) & 0xC0) != 0x80

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SCHEMA = "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)

#: Rules as SQL over the measures; true means that the document fails.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("short", "repeats")
#: A host goes if a shrunken failure rate of any rule is above this.
MAX_RATE = 0.5
#: Hosts up to which the table of verdicts (under 50 bytes a host) is broadcast.
BROADCAST_HOSTS = 100_000


def _repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[np.ndarray] = []
        for part in steps(batch.column(2)):
            starts, ends, ranges = part.words()
            n_words = np.diff(ranges)
            word_chars = part.sums(_NOT_CONTINUED[part.data] & ~SPACE[part.data])
            n_symbols = part.sums(_SYMBOL[part.data])
            line_start, line_end, lines = part.runs(part.data != 10)
            worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
            line_row = np.repeat(np.arange(part.rows), np.diff(lines))
            kept, row = worded.nonzero()[0], line_row[worded]
            keys = in_row(part.hash_spans(line_start[kept], line_end[kept]), row)
            _, first = np.unique(keys, return_index=True)
            n_lines = np.bincount(row, minlength=part.rows)
            n_dup = n_lines - np.bincount(row[first], minlength=part.rows)
            at, row, five = windows(part.hash_spans(starts, ends), ranges, 5)
            at = at[_repeated(in_row(five, row))] if len(at) else at
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            inside = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
            n_repeat = np.diff(inside[ranges])
            out.append(np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines]))
        values = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *map(pa.array, values.astype(np.int64))],
            names=["doc_id", "host", *MEASURES],
        )


def measure_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, host and the measures of each whole text; no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string"), text_bytes(text)).mapInArrow(_measure, _SCHEMA)


def host_verdicts(measures: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: host, host_docs, host_rate (its worst shrunken rate), host_ok.

    The prior of a rule is a beta distribution with the corpus rate m as its mean and
    the strength m(1-m)/V - 1, where V is the hosts' variance weighted by documents;
    the strength is held between 1 and 10,000.
    """
    hosts = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), *(F.sum(F.when(F.expr(rule), 1).otherwise(0)).alias(name) for name, rule in RULES.items())
    )
    corpus = hosts.agg(  # two sums a rule, whatever the corpus
        F.sum("host_docs").alias("docs"),
        *(F.sum(name).alias(f"{name}_all") for name in RULES),
        *(F.sum(F.expr(f"cast({name} as double) * {name} / host_docs")).alias(f"{name}_sq") for name in RULES),
    ).first()
    rates = []
    for name in RULES:
        mean, strength = 0.0, 1.0
        if corpus["docs"]:
            mean = corpus[f"{name}_all"] / float(corpus["docs"])
            spread = max(corpus[f"{name}_sq"] / corpus["docs"] - mean * mean, 1e-12)
            strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 10000.0)
        rates.append((F.col(name) + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength)))
    worst = F.greatest(*rates)
    return hosts.select("host", "host_docs", worst.alias("host_rate"), (worst <= max_rate).alias("host_ok"))


def host_quality(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of each document with base_failed, its host's verdict and kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "host_quality")
    measures = scratch.write(measure_documents(docs, host, text), "measures")
    verdicts = scratch.write(host_verdicts(measures, max_rate), "hosts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    verdicts = verdicts.withColumnRenamed("host", "of")
    base = F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))
    return (
        measures.join(verdicts, F.col("host").eqNullSafe(F.col("of")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
        .select("doc_id", *MEASURES, "base_failed", "kept", "host_docs", "host_ok", F.round("host_rate", 9).alias("host_rate"))
    )
