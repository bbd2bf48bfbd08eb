"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash.  A budget of a source is a threshold on that
hash: documents below it are taken.  The threshold is found from histograms of words
by (source, hash prefix): the prefix at which the running sum passes the budget is
kept and only the documents in that boundary bucket are summed again by their next 15
bits, until single hash values remain.  Thresholds of growing budgets are nested, no
document is ever sorted, and a rerun takes the same documents.

Defined cases: a null text has size 0; documents with a null source form a source that
comes last; rows with the same doc_id have the same hash and are taken together, and rows
without one are taken by their text's hash; an empty table gives an empty result; other
columns of the input are not read and pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
LEVELS, LEVEL_BITS = 4, 15


def _hash(text: str):
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.col(text).cast("string")), F.lit(""))
    digest = F.md5(name.cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words of the whole text) and the document's hash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hash(text).alias("hash"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: a share of all words by weight, filled up to the cap.

    With sources in order of cap / weight, the first m are held at their cap and the
    others get a common level times their weight; m is the least for which that level
    is at most the next source's ratio.  One row per source, so one task orders them.
    """
    table = F.array(*map(F.lit, weights))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("place", F.row_number().over(order) - 1)
    sources = sources.withColumn("weight", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int")))
    sources = sources.withColumn("cap", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    sources = (
        sources.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("held", F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("held")) / F.col("left"))
        .withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)
    sources = sources.withColumn("level", F.coalesce(level["level"], F.lit(float("inf"))))
    return sources.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def thresholds(sizes: DataFrame, budgets: DataFrame, scratch: Scratch, levels: int = LEVELS, bits: int = LEVEL_BITS) -> DataFrame:
    """source, threshold: documents whose hash is below it hold about ``rest`` words.

    ``budgets`` has source and rest.  The last document at the boundary is taken if
    that brings the sum nearer to the budget.
    """
    state = budgets.select(F.col("source").alias("of"), F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, levels + 1):
        # One row a source, written so that no level plans the ones before it again.
        state = scratch.write(state.select("of", "rest", "prefix"), f"state{level}")
        shift = bits * (levels - level)
        wide = 1 << bits
        inside = sizes.join(state, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift + bits) == F.col("prefix")))
        histogram = inside.groupBy("of", "rest", "prefix", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("of").orderBy("bucket")
        histogram = histogram.withColumn("after", F.sum("words").over(running)).withColumn("before", F.col("after") - F.col("words"))
        # The first bucket that passes the budget; without one, the end of the last.
        passed = F.min(F.when(F.col("after") > F.col("rest"), F.struct("bucket", "before", "words")))
        found = histogram.groupBy("of", "rest", "prefix").agg(passed.alias("at"))
        state = state.alias("s").join(found.alias("f"), F.expr("s.of <=> f.of"), "left").select(
            F.col("s.of"),
            F.coalesce(F.col("s.rest") - F.col("f.at.before"), F.lit(0.0)).alias("rest"),
            F.coalesce(F.col("f.at.bucket"), (F.col("s.prefix") + 1) * wide).alias("prefix"),
            F.coalesce(F.col("f.at.words"), F.lit(0)).alias("words"),
        )
    return state.select("of", (F.col("prefix") + F.when(2 * F.col("rest") >= F.col("words"), 1).otherwise(0)).alias("threshold"))


def _cuts(sizes: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """One row per source: of, source_size, target, whole repeats and the threshold beyond."""
    targets = scratch.write(source_targets(sizes, weights, share, repeats), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long"))
    budgets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return scratch.write(
        budgets.join(thresholds(sizes, budgets, scratch), F.col("source").eqNullSafe(F.col("of")), "left").select(
            F.col("source").alias("of"), "source_size", "target", "whole", F.when(F.col("rest") > 0, F.col("threshold")).otherwise(0).alias("threshold")
        ),
        "cuts",
    )


_TIMES = "whole + CASE WHEN hash < threshold THEN 1 ELSE 0 END"


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, text: str = "text", source: str = "source"
) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as it is taken.

    A text without words costs nothing and is taken as a text of its hash would be.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.write(sized(docs, text, source), "sizes")
    cuts = _cuts(sizes, scratch, weights, share, repeats).select("of", "whole", "threshold")
    rows = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("own"), _hash(text).alias("hash"))
    joined = rows.join(cuts, F.col("own").eqNullSafe(F.col("of")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), F.expr(_TIMES).cast("int")))).select("row.*")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, text: str = "text", source: str = "source"
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row, with whole repeats first."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.write(sized(docs, text, source), "sizes")
    cuts = _cuts(sizes, scratch, weights, share, repeats)
    return sizes.join(cuts, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", F.expr(f"size * ({_TIMES})").alias("taken")
    )
