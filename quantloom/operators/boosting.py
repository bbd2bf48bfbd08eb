"""Second-order boosting over binned features, with a listwise ranking loss or squared error.

A round computes gradient and curvature of each row, grows a tree level by level and adds its
leaf values to the scores.  A level costs one aggregate: gradients summed by node, feature
and bin, combined before they are sent on.  What reaches the driver is that histogram, whose
size is nodes times features times bins whatever the number of rows; splits are chosen there.

``boost`` keeps the rows as blocks of arrays, whole groups together, one block a task: a round is
one job that moves the scores, judges them and sums the next tree's first level, and one more
job for each further level.

The ranking loss pairs each row of a date (or another group) with the date's first ``top`` rows
by score, and weighs a pair by what its exchange would move in NDCG.  A date's rows pass
through a task in the order of their scores, so its few leaders come first and meet the others
as these arrive; no pair is shuffled.

A feature's bins lie between cuts at equal steps of its standard deviation around its mean, or
at its quantiles.  Null and NaN have a bin of their own, below all others.
"""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions.expr import pct_rank
from quantloom.functions.session import checkpointing, dealt, deleted


@dataclass(frozen=True)
class Settings:
    """objective: "rank" (judged by NDCG) or "squared" (judged by mean absolute error, unless judge is "ndcg")."""

    objective: str = "rank"
    judge: str | None = None
    rounds: int = 1000
    patience: int = 50
    rate: float = 0.05
    leaves: int = 31
    depth: int = 6
    l1: float = 0.0
    l2: float = 0.0
    least_hessian: float = 1e-3
    least_rows: int = 20
    #: Shares of the features of a tree, and of the rows of some trees in a row.
    feature_share: float = 0.85
    row_share: float = 0.8
    row_every: int = 5
    top: int = 30
    judged_at: int = 10
    grades: int = 5
    seed: int = 42


# --------------------------------------------------------------------------- bins


def spread_cuts(rows: DataFrame, features: list[str], half: int = 15, width: float = 0.2) -> list[list[float]]:
    """For each feature 2 * half + 1 cuts around its mean, ``width`` standard deviations apart; from one aggregate."""
    good = {f: F.when(~F.isnan(f), F.col(f)) for f in features}
    found = rows.agg(*(x for i, f in enumerate(features) for x in (F.avg(good[f]).alias(f"m{i}"), F.stddev_pop(good[f]).alias(f"s{i}")))).first()
    cuts = []
    for i in range(len(features)):
        mean, spread = found[f"m{i}"] or 0.0, found[f"s{i}"] or 0.0
        cuts.append([round(mean + k * width * spread, 9) for k in range(-half, half + 1)] if spread > 0 else [])
    return cuts


def quantile_cuts(rows: DataFrame, features: list[str], bins: int = 64, accuracy: int = 10_000) -> list[list[float]]:
    """For each feature cuts at its quantiles, from mergeable sketches of bounded size."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.when(~F.isnan(f), F.col(f)), shares, accuracy).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [sorted(set(found[f"q{i}"] or [])) for i in range(len(features))]


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    """Adds bins: for each feature 0 where it is missing, else one more than the cuts below it."""

    def of(feature: str, own: list[float]) -> Column:
        below = F.size(F.filter(F.array(*map(F.lit, own)).cast("array<double>"), lambda c: c < F.col(feature))) if own else F.lit(0)
        return F.when(F.col(feature).isNull() | F.isnan(feature), F.lit(0)).otherwise(1 + below).cast("short")

    return rows.withColumn("bins", F.array(*(of(f, c) for f, c in zip(features, cuts, strict=True))))


# --------------------------------------------------------------------------- gradients


def graded(rows: DataFrame, label: str = "label", grades: int = 5, top: int = 30, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Adds rel (the grade of the label's percentile in its group) and ideal (the group's best DCG over ``top`` rows)."""
    rows = dealt(rows, *by).withColumn("rel", F.least(F.lit(grades - 1), F.floor(pct_rank(label, *by) * grades)).cast("double"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rel"), "symbol"))
    part = F.when(F.col("_place") <= top, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("_place") + 1.0)).otherwise(0.0)
    return rows.withColumn("_place", place).withColumn("ideal", F.sum(part).over(Window.partitionBy(*by))).drop("_place")


class _Group:
    """The rows of one group so far, best score first: its leaders wait until its last row has met them."""

    def __init__(self, top: int):
        self.top, self.seen, self.waiting = top, 0, []
        self.score, self.gain, self.cut, self.ideal = (np.zeros(0) for _ in range(4))
        self.sums = np.zeros((2, 0))

    def met(self, score: np.ndarray, gain: np.ndarray, cut: np.ndarray, ideal: np.ndarray) -> np.ndarray:
        """g and h of each pair of a row with a leader: (2, rows, leaders)."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            apart = gain[:, None] - self.gain[None, :]
            side = np.sign(apart)
            w = np.abs(apart) * np.abs(cut[:, None] - self.cut[None, :]) / ideal[:, None]
            c = 1.0 / (1.0 + np.exp(side * (score[:, None] - self.score[None, :])))
            good = (side != 0) & ~np.isnan(apart) & (ideal > 0)[:, None]
            return np.where(good, [-side * w * c, w * c * (1.0 - c)], 0.0)

    def take(self, rows: pa.RecordBatch, score: np.ndarray, rel: np.ndarray, ideal: np.ndarray) -> list[tuple[pa.RecordBatch, np.ndarray]]:
        """Further rows of the group; those behind the leaders come back with their sums."""
        n = rows.num_rows
        gain, cut = 2.0**rel - 1, 1.0 / np.log2(np.arange(self.seen, self.seen + n) + 2.0)
        lead = min(n, max(0, self.top - self.seen))
        self.seen += n
        if lead:
            self.waiting.append(rows.slice(0, lead))
            self.score, self.gain, self.cut, self.ideal = (np.concatenate([x, y[:lead]]) for x, y in ((self.score, score), (self.gain, gain), (self.cut, cut), (self.ideal, ideal)))
            self.sums = np.concatenate([self.sums, np.zeros((2, lead))], axis=1)
        if lead == n:
            return []
        pairs = self.met(score[lead:], gain[lead:], cut[lead:], ideal[lead:])
        # A leader is given the other side of its pairs with the rows behind all leaders, too.
        self.sums += np.stack([-pairs[0].sum(0), pairs[1].sum(0)])
        return [(rows.slice(lead), pairs.sum(2))]

    def end(self) -> list[tuple[pa.RecordBatch, np.ndarray]]:
        """The leaders, with their sums."""
        if not self.waiting:
            return []
        sums = self.sums + self.met(self.score, self.gain, self.cut, self.ideal).sum(2)
        ends = np.cumsum([x.num_rows for x in self.waiting])
        return list(zip(self.waiting, np.split(sums, ends[:-1], axis=1), strict=True))


def rank_gradients(rows: DataFrame, top: int = 30, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Adds g and h of the pairwise logistic loss, each pair weighed by its exchange's move of NDCG.

    ``rows`` have symbol, score, rel, ideal and the columns of the group, ``by``.  Pairs of different
    grades count if one of them is among the first ``top`` of its group; equal scores are
    ordered by symbol.  A group passes through one task in that order, batch by batch, and of it
    only the leaders are held.
    """
    schema = StructType([*rows.schema.fields, StructField("g", DoubleType()), StructField("h", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = _Group(top), None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.unique(np.concatenate([[0], *(np.asarray(pc.run_end_encode(batch.column(c)).run_ends)[:-1] for c in by)])).astype(int)
            score, rel, ideal = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("score", "rel", "ideal"))
            done = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                own = tuple(batch.column(c)[start].as_py() for c in by)
                if own != key:
                    done += group.end()
                    group, key = _Group(top), own
                done += group.take(batch.slice(start, end - start), score[start:end], rel[start:end], ideal[start:end])
            yield from map(given, done)
        yield from map(given, group.end())

    def given(found: tuple[pa.RecordBatch, np.ndarray]) -> pa.RecordBatch:
        part, sums = found
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(sums[0]), pa.array(sums[1])], names=schema.names)

    return dealt(rows, *by).sortWithinPartitions(*by, F.desc("score"), "symbol").mapInArrow(run, schema)


def squared_gradients(rows: DataFrame, target: str = "label") -> DataFrame:
    return rows.withColumns({"g": F.col("score") - F.col(target), "h": F.lit(1.0)})


# --------------------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes are numbered from 1, the children of i are 2i (at most the bin) and 2i + 1."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def node(self) -> Column:
        """The leaf that a row with column bins comes to."""

        def below(i: int) -> Column:
            if i not in self.splits:
                return F.lit(i)
            feature, at = self.splits[i]
            return F.when(F.col("bins")[feature] <= at, below(2 * i)).otherwise(below(2 * i + 1))

        return below(1)

    def leaf_value(self) -> Column:
        def below(i: int) -> Column:
            if i not in self.splits:
                return F.lit(float(self.values.get(i, 0.0)))
            feature, at = self.splits[i]
            return F.when(F.col("bins")[feature] <= at, below(2 * i)).otherwise(below(2 * i + 1))

        return below(1)

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """node(), of an array of bins."""
        most = 2 * max(self.splits, default=0) + 2
        feature, at = np.zeros(most, np.int64), np.full(most, -1)
        for i, (f, b) in self.splits.items():
            feature[i], at[i] = f, b
        node, every = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(max(self.splits, default=0).bit_length()):
            node = np.where(at[node] < 0, node, 2 * node + (bins[every, feature[node]] > at[node]))
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        values = np.zeros(2 * max(self.splits, default=0) + 2)
        for i, value in self.values.items():
            values[i] = value
        return values[self.reached(bins)]


def _soft(g: float, l1: float) -> float:
    return math.copysign(max(abs(g) - l1, 0.0), g)


def newton_value(g: float, h: float, s: Settings) -> float:
    """The leaf value that minimises the loss to second order, under the penalties."""
    return -_soft(g, s.l1) / (h + s.l2) if h + s.l2 > 0 else 0.0


def _strength(g: float, h: float, s: Settings) -> float:
    return _soft(g, s.l1) ** 2 / (h + s.l2) if h + s.l2 > 0 else 0.0


def histogram(rows: DataFrame, node: Column, features: list[int]) -> DataFrame:
    """node, feature, bin, g, h, n: sums of the rows by node and by bin of each chosen feature."""
    spread = rows.select(node.alias("node"), "g", "h", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col("bins")[f].alias("bin")) for f in features))).alias("_at"))
    sums = spread.groupBy("node", "_at.feature", "_at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    return sums


def best_splits(found: list, s: Settings) -> dict[int, tuple]:
    """Of histogram rows, for each node its best split: (gain, feature, bin, left sums, right sums), or none."""
    held: dict[int, dict[int, list]] = {}
    for r in found:
        held.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"], r["n"]))
    out = {}
    for node, features in held.items():
        best = None
        for feature in sorted(features):
            bins = sorted(features[feature])
            whole = tuple(math.fsum(b[i] for b in bins) for i in (1, 2, 3))
            left = (0.0, 0.0, 0.0)
            for at, g, h, n in bins[:-1]:
                left = (left[0] + g, left[1] + h, left[2] + n)
                right = tuple(w - x for w, x in zip(whole, left, strict=True))
                if min(left[2], right[2]) < s.least_rows or min(left[1], right[1]) < s.least_hessian:
                    continue
                gain = _strength(*left[:2], s) + _strength(*right[:2], s) - _strength(*whole[:2], s)
                # Gains that differ in the last digits only are ties; the first feature and bin have them.
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, feature, at, left, right)
        out[node] = best
    return out


def grow(rows: DataFrame, features: list[int], s: Settings) -> Tree:
    """A tree on rows with bins, g and h; one aggregate a level."""

    def found(tree: Tree, open_nodes: list[int]) -> list:
        node = tree.node()
        inside = rows.where(node.isin(open_nodes)) if open_nodes != [1] else rows
        return histogram(inside, node, features).collect()  # nodes * features * bins

    return _grown(found, s)


def _grown(found_in: Callable[[Tree, list[int]], list], s: Settings) -> Tree:
    """A tree by the histogram rows that the tree so far has in its open nodes."""
    tree, open_nodes = Tree(), [1]
    for _ in range(s.depth):
        found = found_in(tree, open_nodes)
        if not tree.values and found:
            one = [r for r in found if r["feature"] == found[0]["feature"]]
            tree.values[1] = newton_value(math.fsum(r["g"] for r in one), math.fsum(r["h"] for r in one), s)
        room = s.leaves - len(tree.splits) - 1
        chosen = sorted(((b, i) for i, b in best_splits(found, s).items() if b), key=lambda x: (-x[0][0], x[1]))[: max(room, 0)]
        open_nodes = []
        for (gain, feature, at, left, right), i in chosen:
            tree.splits[i], tree.gains[i] = (feature, at), gain
            tree.values[2 * i], tree.values[2 * i + 1] = newton_value(*left[:2], s), newton_value(*right[:2], s)
            open_nodes += [2 * i, 2 * i + 1]
        if not open_nodes:
            break
    return tree


# --------------------------------------------------------------------------- boosting


@dataclass
class Boosted:
    """The trees up to the best round, and how each round was judged."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    settings: Settings
    history: list[float]
    base: float = 0.0

    def predict(self, rows: DataFrame, name: str = "pred_ret") -> DataFrame:
        """Adds the score."""
        trees, rate, base, cuts = self.trees, self.settings.rate, self.base, self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = np.zeros((batch.num_rows, len(cuts)), np.int16)
                for i, own in enumerate(cuts):
                    values = batch.column(batch.num_columns - len(cuts) + i).to_numpy(zero_copy_only=False).astype(np.float64)
                    bins[:, i] = np.where(np.isnan(values), 0, 1 + np.searchsorted(own, values))
                score = np.full(batch.num_rows, base)
                for tree in trees:
                    score += rate * tree.predict(bins)
                kept = [batch.column(i) for i in range(batch.num_columns - len(cuts))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*batch.schema.names[: len(kept)], name])

        inner = rows.drop(name).select("*", *(F.col(f).cast("double").alias(f"_bin_of_{i}") for i, f in enumerate(self.features)))
        schema = StructType([*rows.drop(name).schema.fields]).add(name, DoubleType())
        return inner.mapInArrow(run, schema)

    def importance(self) -> list[tuple[str, float]]:
        """Features by the gain of their splits."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for i, (feature, _) in tree.splits.items():
                total[self.features[feature]] += tree.gains[i]
        return sorted(total.items(), key=lambda x: (-x[1], x[0]))


# --------------------------------------------------------------------------- blocks

#: Rows whose pairs with leaders a task holds at once; rounds between checkpoints of the blocks; tasks whose
#: histograms the driver adds up itself.
PAIRED, KEPT_EVERY, FEW = 1 << 10, 10, 64


@dataclass
class _Block:
    """A task's rows by group, each by symbol: rows to train on, then to judge by.  ``starts`` are the groups' first rows."""

    train: int
    starts: np.ndarray
    ideal: np.ndarray  # one a group
    key: np.ndarray
    label: np.ndarray
    rel: np.ndarray
    bins: np.ndarray
    score: np.ndarray
    g: np.ndarray
    h: np.ndarray

    def groups(self, judged: bool) -> np.ndarray:
        """The first rows of the groups of a part, counted from the part's first."""
        return self.starts[self.starts >= self.train] - self.train if judged else self.starts[self.starts < self.train]


def _places(score: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows by group and falling score, and the group and place in it of each ordered row."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(score))))
    return np.lexsort((-score, group)), group, np.arange(len(score)) - starts[group]


def block_gradients(score: np.ndarray, rel: np.ndarray, ideal: np.ndarray, starts: np.ndarray, top: int) -> np.ndarray:
    """rank_gradients of whole groups, whose rows follow each other by symbol: (2, rows)."""
    n, sums = len(score), np.zeros((2, len(score)))
    order, group, place = _places(score, starts)
    score, gain, cut = score[order], 2.0 ** rel[order] - 1, 1.0 / np.log2(place + 2.0)
    share = np.where(ideal > 0, 1.0 / np.where(ideal > 0, ideal, 1.0), 0.0)
    sizes = np.diff(np.append(starts, n))
    at = np.arange(min(top, int(sizes.max(initial=0))))
    held = [np.empty((min(n, PAIRED), len(at)), kind) for kind in (np.int64, *(float,) * 4)]  # arrays made anew cost more than the sums
    for a in range(0, n, PAIRED):
        own = slice(a, min(n, a + PAIRED))
        mine = group[own]
        lead, g, h, chance, moved = (x[: len(mine)] for x in held)
        np.add(starts[mine][:, None], at, out=lead)
        # Of each row with each leader: what their exchange moves, signed, and the chance that they stand wrongly.
        np.subtract(gain.take(lead, out=g, mode="clip"), gain[own][:, None], out=g)
        np.subtract(score.take(lead, out=chance, mode="clip"), score[own][:, None], out=chance)
        np.multiply(chance, g, out=h)
        np.copysign(chance, h, out=chance)
        with np.errstate(over="ignore"):
            np.exp(chance, out=chance)
        chance += 1.0
        np.reciprocal(chance, out=chance)
        np.subtract(cut.take(lead, out=moved, mode="clip"), cut[own][:, None], out=moved)
        np.abs(moved, out=moved)
        moved *= share[mine][:, None]
        if sizes[mine].min() < len(at):
            moved *= at < sizes[mine][:, None]
        g *= moved
        g *= chance
        np.abs(g, out=h)
        np.subtract(1.0, chance, out=chance)
        h *= chance
        sums[0, own] += g.sum(1)
        sums[1, own] += h.sum(1)
        # A leader is given the other side of its pairs with the rows behind all leaders, too.
        ends = np.flatnonzero(np.diff(mine, prepend=-1))
        far = sizes[mine[ends]] > top
        if far.any():
            ahead = place[own] < top
            to = starts[mine[ends][far]][:, None] + at
            for i, pairs in ((0, np.negative(g, out=g)), (1, h)):
                pairs[ahead] = 0.0
                sums[i, to] += np.add.reduceat(pairs, ends, axis=0)[far]
    out = np.zeros_like(sums)
    out[:, order] = sums
    return out


def block_ndcg(score: np.ndarray, rel: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Of whole groups the NDCG of the first k rows by score."""
    gain = 2.0**rel - 1
    dcg = []
    for by in (score, rel):
        order, group, place = _places(by, starts)
        part = np.where(place < k, gain[order] / np.log2(place + 2.0), 0.0)
        dcg.append(np.bincount(group, part, len(starts)))
    return np.where(dcg[1] > 0, dcg[0] / np.where(dcg[1] > 0, dcg[1], 1.0), 0.0)


def _drawn(key: np.ndarray, s: Settings, turn: int) -> np.ndarray:
    """Which rows a tree is grown on: a share by the rows' hashes, another one every ``row_every`` trees."""
    if s.row_share >= 1:
        return np.ones(len(key), bool)
    x = key.view(np.uint64) + np.uint64(random.Random(s.seed * 1_000_003 + turn // s.row_every).getrandbits(64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) % np.uint64(1_000_000) < np.uint64(int(s.row_share * 1_000_000))


def _packed(rows: DataFrame, by: tuple[str, ...], features: int) -> RDD:
    """The rows as blocks, one a task."""
    keys = ("judged", *by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.unique(np.concatenate([[0], *(np.asarray(pc.run_end_encode(batch.column(c)).run_ends)[:-1] for c in keys)])).astype(np.int64)
            own, last_own = (tuple(batch.column(c)[i].as_py() for c in keys) for i in (0, n - 1))
            starts, last = starts[1:] if own == last else starts, last_own
            of = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("judged", "key", "label", "rel", "ideal")}
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).astype(np.int16).reshape(n, features)
            part = (int(n - of["judged"].sum()), starts, of["ideal"][starts], of["key"], of["label"], of["rel"].astype(np.int8), bins)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], names=["part"])

    def joined(found: Iterator) -> Iterator[_Block]:
        empty = (0, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int8), np.zeros((0, features), np.int16))
        train, starts, *columns = zip(empty, *(pickle.loads(r.part) for r in found), strict=True)
        ends = np.cumsum([len(x) for x in columns[1]])
        starts = [x + end for x, end in zip(starts[1:], ends[:-1], strict=True)]
        yield _Block(sum(train), np.concatenate([empty[1], *starts]), *map(np.concatenate, columns), *(np.zeros(ends[-1]) for _ in range(3)))

    return dealt(rows, *keys).sortWithinPartitions(*keys, "symbol").mapInArrow(run, "part binary").rdd.mapPartitions(joined)


class _Rounds:
    """The blocks of one round after the other; a round's stay in the executors' memory and on their disks until the next's are there.

    Every few rounds they are checkpointed, which cuts the lineage; older checkpoints are deleted.
    """

    def __init__(self, blocks: RDD, s: Settings, width: int):
        self.blocks, self.s, self.width, self.turn, self.kept = blocks, s, width, 0, None

    def __enter__(self) -> _Rounds:
        return self

    def __exit__(self, *_) -> None:
        self.blocks.unpersist()
        if self.kept:
            deleted(self.blocks.context, self.kept)

    def _gathered(self, look: Callable[[_Block], np.ndarray]) -> np.ndarray:
        found = self.blocks.map(look)
        return found.treeReduce(np.add) if found.getNumPartitions() > FEW else reduce(np.add, found.collect(), 0.0)

    def _rows(self, found: np.ndarray, nodes: list[int], features: list[int]) -> list[dict]:
        """The rows of histogram()."""
        found = np.zeros((len(nodes), len(features), self.width, 3)) + found.reshape(len(nodes), len(features), self.width, 3)
        at = np.argwhere(found[..., 2] > 0).tolist()
        return [{"node": nodes[i], "feature": features[j], "bin": b, "g": g, "h": h, "n": int(n)} for (i, j, b), (g, h, n) in zip(at, found[tuple(zip(*at, strict=True))].tolist() if at else [], strict=True)]

    def sums(self, tree: Tree, nodes: list[int], features: list[int]) -> list[dict]:
        """histogram() of the drawn rows in the tree's ``nodes``."""
        look = _histogram(tree, nodes, features, self.s, self.turn, self.width)
        found = self._gathered(look)
        return self._rows(found, nodes, features) if np.size(found) > 1 else []

    def moved(self, tree: Tree | None, base: float, features: list[int]) -> tuple[float, list[dict]]:
        """Adds a tree to the scores (or sets them); how they are judged, and the sums in the root of the next tree."""
        s, before = self.s, self.blocks
        self.turn += tree is not None
        self.blocks = before.map(_moved(tree, base, s)).persist(StorageLevel.MEMORY_AND_DISK)
        keep = self.turn % KEPT_EVERY == KEPT_EVERY - 1
        if keep:
            self.blocks.checkpoint()
        root = _histogram(Tree(), [1], features, s, self.turn, self.width)
        found = self._gathered(lambda block: np.concatenate([_judged(block, s), root(block)]))
        before.unpersist()
        if keep:
            if self.kept:
                deleted(self.blocks.context, self.kept)
            self.kept = self.blocks.getCheckpointFile()
        if np.size(found) == 1:  # no task, no rows
            return 0.0, []
        return (float(found[0] / found[1]) if found[1] else 0.0), self._rows(found[2:], [1], features)


def _histogram(tree: Tree, nodes: list[int], features: list[int], s: Settings, turn: int, width: int) -> Callable[[_Block], np.ndarray]:
    """g, h and number of a block's drawn rows by node, feature and bin, as one row of numbers."""

    def look(block: _Block) -> np.ndarray:
        used = np.flatnonzero(_drawn(block.key[: block.train], s, turn))
        bins, size = block.bins[used], len(nodes) * width
        slots = np.full(max(2 * max(tree.splits, default=0) + 2, max(nodes) + 1), -1)
        slots[nodes] = np.arange(len(nodes))
        slot = slots[tree.reached(bins)]
        inside = slot >= 0
        used, bins, slot = used[inside], bins[inside], slot[inside]
        out = np.zeros((len(nodes), len(features), width, 3))
        for j, f in enumerate(features):
            cell = slot * width + bins[:, f]
            for i, weights in enumerate((block.g[used], block.h[used], None)):
                out[:, j, :, i] = np.bincount(cell, weights, size).reshape(len(nodes), width)
        return out.ravel()

    return look


def _moved(tree: Tree | None, base: float, s: Settings) -> Callable[[_Block], _Block]:
    """Blocks with the scores after a tree, or all at ``base``, and their gradients."""

    def move(block: _Block) -> _Block:
        score = block.score + s.rate * tree.predict(block.bins) if tree else np.full(len(block.score), base)
        own = slice(0, block.train)
        g, h = np.zeros(len(score)), np.ones(len(score))
        if s.objective == "rank":
            starts = block.groups(judged=False)
            g[own], h[own] = block_gradients(score[own], block.rel[own], block.ideal[: len(starts)], starts, s.top)
        else:
            g[own] = score[own] - block.label[own]
        return replace(block, score=score, g=g, h=h)

    return move


def _judged(block: _Block, s: Settings) -> np.ndarray:
    """Sum and number of what a block's rows are judged by: NDCG of groups, or negative absolute errors."""
    score, rel, label = (x[block.train :] for x in (block.score, block.rel, block.label))
    if (s.judge or s.objective) in ("rank", "ndcg"):
        values = block_ndcg(score, rel, block.groups(judged=True), s.judged_at)
    else:
        values = -np.abs(score - label)
    return np.array([values.sum(), float(len(values))])


def boost(train: DataFrame, val: DataFrame, features: list[str], s: Settings | None = None, cuts: list[list[float]] | None = None, by: tuple[str, ...] = ("date",), label: str = "label", **more) -> Boosted:
    """Fits on ``train`` until ``val`` has not become better for ``patience`` rounds.

    Both have date, symbol and label; the rows that are ranked together agree in ``by``.
    """
    s = replace(s or Settings(), **more)
    checkpointing(train.sparkSession)
    cuts = cuts or spread_cuts(train, features)
    base = 0.0
    if s.objective == "squared":
        base = train.agg(F.avg(label)).first()[0] or 0.0
    sides = [
        binned(x.where(F.col(label).isNotNull()), features, cuts).select(*dict.fromkeys(("date", "symbol", *by)), F.col(label).cast("double").alias("label"), "bins", F.lit(judged).alias("judged"))
        for x, judged in ((train, False), (val, True))
    ]
    rows = sides[0].unionByName(sides[1]).withColumn("key", F.xxhash64("date", "symbol"))
    ranked = "rank" in (s.objective, s.judge) or s.judge == "ndcg"
    rows = graded(rows, "label", s.grades, s.top, ("judged", *by)) if ranked else rows.withColumns({"rel": F.lit(0.0), "ideal": F.lit(0.0)})

    def chosen(turn: int) -> list[int]:
        draw = random.Random(s.seed * 1_000_003 + turn)
        return sorted(draw.sample(range(len(features)), max(1, round(s.feature_share * len(features)))))

    trees, history, best = [], [], 0
    with _Rounds(_packed(rows, by, len(features)), s, max(map(len, cuts)) + 2) as table:
        start, root = table.moved(None, base, chosen(0))
        for turn in range(s.rounds):
            tree = _grown(lambda tree, nodes: root if nodes == [1] else table.sums(tree, nodes, chosen(turn)), s)  # noqa: B023
            trees.append(tree)
            value, root = table.moved(tree, base, chosen(turn + 1))
            history.append(value)
            if history[-1] > (history[best - 1] if best else start):
                best = turn + 1
            # A tree without a split, drawn with all rows and features, would come again for ever.
            stuck = not tree.splits and s.row_share >= 1 and s.feature_share >= 1
            if turn + 1 - best >= s.patience or stuck:
                break
    return Boosted(features, cuts, trees[:best], s, history, base)
