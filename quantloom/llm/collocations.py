"""Phrase collocations from depth-limited count tries.

A shard is some of a task's texts.  Its trie has a node for each sequence of one to four
words that occurs, below the language; a level is two sorted columns (parent, word) and a
count, so it is serialised as it stands, in the order of its paths.  The order of all paths
is cut in ranges, at paths taken from a sample of the corpus, and each shard's trie is cut
likewise.  A range's pieces of tries, sorted runs, are merged level by level, first those of
a task's shards, then those of all tasks; there, nodes under the least count and all below
them are left out.  A piece also holds the nodes above its first
path, with their counts, so that walking up from a node gives the counts of all its left
parts within the range.  Suffix links, joins of a node with the node of its path without the
first word, give the right parts.

A frequent path is one node a shard, however often it occurs, and ranges may begin at any
depth, so what stands below a frequent word or pair is spread over ranges.  What reaches the
driver and goes to every task is one path a range.

Defined cases: null and empty texts have no words; a null language counts as ``und``; rows
that repeat count again; words may hold any bytes but separators; an empty table gives an
empty result; only the text and ``lang`` are read.  Words are told apart by 64-bit hashes.  A
text is never split, so a task holds its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch, Texts, mix, signed, steps, text_bytes

#: Words of a phrase at most, occurrences at least, phrases of a language.
DEPTH, LEAST, MOST = 4, 30, 2000
#: Parts in a hundred of a phrase's occurrences that lie within a longer one, for it to be dropped.
COVERED = 80
#: Text bytes of a shard and of a range, about, and sampled paths for each range.
SHARD_BYTES, RANGE_BYTES, SAMPLED = 4 << 20, 16 << 20, 64
#: Bytes of serialised pieces that a task holds before it merges and sends them, about.
TASK_BYTES = 64 << 20
#: Bytes that end a piece, and those that end a word.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\v\f\r"]] = True
GAP = BREAK.copy()
GAP[[*b" \t"]] = True

_NODE = "key long, depth int, path array<long>, f long, lefts array<long>, word binary"


# --------------------------------------------------------------------------- words


def _words(part: Texts) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts, starts and ends of words, their rows, and whether the next word follows in the same piece."""
    part = part.lower()
    starts, ends, ranges = part.runs(~GAP[part.data])
    row = np.repeat(np.arange(part.rows), np.diff(ranges))
    breaks = np.zeros(len(part.data) + 1, np.int32)
    np.cumsum(BREAK[part.data], out=breaks[1:])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (row[1:] == row[:-1])
    return part, starts, ends, row, joined


def _survey(rate: float):
    """Of each task the words by language, and paths chosen by their hash, each once a step."""
    limit = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            keys = batch.column(0).to_numpy()
            for step in steps(batch.column(2)):
                part, starts, ends, row, joined = _words(step)
                for at, n in zip(*np.unique(row, return_counts=True), strict=True):
                    lang = langs[step.first_row + at]
                    counted[lang] = counted.get(lang, 0) + int(n)
                if not len(starts):
                    continue
                path = np.zeros((len(starts), DEPTH + 1), np.int64)
                path[:, 0] = keys[step.first_row + row]
                hashes, follows = signed(part.hash_spans(starts, ends)), np.ones(len(starts), bool)
                for d in range(DEPTH):
                    path[: len(starts) - d, d + 1] = np.where(follows[: len(starts) - d], hashes[d:], 0)
                    follows[: len(starts) - d - 1] &= joined[d : len(starts) - 1]
                    follows[len(starts) - d - 1 :] = False
                chosen = np.zeros(len(path), np.uint64)
                for d in range(DEPTH + 1):
                    chosen = mix(chosen * np.uint64(0x9E3779B97F4A7C15) + path[:, d].view(np.uint64))
                found = np.unique(path[chosen < limit], axis=0)
                if len(found):
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), DEPTH + 1).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.int64()), lists], names=["lang", "n", "path"])
        if counted:
            columns = [pa.array(list(counted)), pa.array(list(counted.values()), pa.int64()), pa.nulls(len(counted), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "path"])

    return run


def _bounds(sampled: DataFrame, ranges: int) -> np.ndarray:
    """Paths that cut the order of all paths in about equal ranges, sorted; one row a range at most."""
    columns = [f"p{d}" for d in range(DEPTH + 1)]
    paths = sampled.select(*(F.col("path")[d].alias(c) for d, c in enumerate(columns)))
    parts = paths.repartitionByRange(ranges, *columns).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*columns)).alias("least"))
    found = sorted(tuple(r.least) for r in parts.collect())[1:]
    return np.array(found, np.int64).reshape(-1, DEPTH + 1)


# --------------------------------------------------------------------------- a shard's trie


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True, return_counts=True)


class Trie:
    """Count trie of some words: for each level the sorted keys (parent * number of words + word) and counts."""

    def __init__(self, langs: np.ndarray, hashes: np.ndarray, joined: np.ndarray):
        self.langs, lang = np.unique(langs, return_inverse=True)
        self.words, self.first, word = np.unique(hashes, return_index=True, return_inverse=True)
        width = len(self.words)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at, keys = np.arange(len(hashes)), lang * width + word
        for depth in range(1, DEPTH + 1):
            if depth == DEPTH:
                keys.sort()
                begin = np.flatnonzero(np.diff(keys, prepend=-1))
                self.levels.append((keys[begin], np.diff(begin, append=len(keys))))
                break
            nodes, place, counts = _unique(keys)
            self.levels.append((nodes, counts))
            on = joined[at + depth - 1]
            at = at[on]
            keys = place[on] * width + word[at + depth]

    def cut(self, bounds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level, where the ranges begin and end among its nodes.

        A range begins with the node above its first path, if there is one, though the node
        itself belongs to a range before it; so it ends behind where the next one begins.
        """
        width = len(self.words)
        place = np.searchsorted(self.langs, bounds[:, 0])
        exact = self._is(self.langs, place, bounds[:, 0])
        begins, ends = [], []
        for depth, (nodes, _) in enumerate(self.levels, 1):
            word = np.searchsorted(self.words, bounds[:, depth])
            key = place * width + np.where(exact, word, 0)
            place = np.searchsorted(nodes, key)
            exact = exact & self._is(self.words, word, bounds[:, depth]) & self._is(nodes, place, key)
            above = exact if depth < DEPTH else np.zeros(len(exact), bool)
            begins.append(np.concatenate([[0], place]))
            ends.append(np.concatenate([place + above, [len(nodes)]]))
        return begins, ends

    @staticmethod
    def _is(values: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        found = at < len(values)
        found[found] = values[at[found]] == wanted[found]
        return found

    def pieces(self, bounds: np.ndarray, text) -> Iterator[tuple[int, bytes]]:
        """The number of each range that holds nodes, and its piece of the trie."""
        begins, ends = self.cut(bounds)
        width = len(self.words)
        for r in range(len(bounds) + 1):
            spans = [(int(b[r]), int(e[r])) for b, e in zip(begins, ends, strict=True)]
            if all(a == b for a, b in spans):
                continue
            # Whether a level begins with a node that belongs to a range before this one.
            above = [int(r > 0 and a < int(e[r - 1])) for (a, _), e in zip(spans, ends, strict=True)]
            parents, words, counts, before = [], [], [], 0
            for (a, b), (nodes, times) in zip(spans, self.levels, strict=True):
                parents.append(nodes[a:b] // width - before)
                words.append(nodes[a:b] % width)
                counts.append(times[a:b])
                before = a
            langs = np.unique(parents[0])
            parents[0] = np.searchsorted(langs, parents[0])
            used, place = np.unique(np.concatenate(words), return_inverse=True)
            place = np.split(place, np.cumsum([len(x) for x in words])[:-1])
            named = words[0][above[0] :]
            yield r, serialised(above, self.langs[langs], self.words[used], parents, place, counts, *text(self.first[named]))


def _planes(values: np.ndarray) -> bytes:
    """32-bit values byte plane by byte plane, so that bytes that hardly differ lie together."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _compressed(*parts: bytes) -> bytes:
    body = b"".join(parts)
    return np.int64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def serialised(above, langs, words, parents, place, counts, sizes: np.ndarray, texts: bytes) -> bytes:
    """A piece of a trie: head, languages and words, texts of the first level, then each level's
    steps between parents, words and counts, compressed one by one."""
    blocks = [_compressed(langs.tobytes(), words.tobytes()), _compressed(_planes(sizes), texts)]
    # Counts beyond 32 bits are kept in two halves.
    for up, word, times in zip(parents, place, counts, strict=True):
        blocks.append(_compressed(*map(_planes, (np.diff(up, prepend=0), word, times & 0xFFFFFFFF, times >> 32))))
    head = np.array([*map(len, parents), *above, len(langs), len(sizes), *map(len, blocks)], np.int64)
    return head.tobytes() + b"".join(blocks)


class Piece:
    """A serialised piece; a level is unpacked when it is asked for."""

    def __init__(self, blob: bytes):
        head = np.frombuffer(blob, np.int64, 3 * DEPTH + 4).tolist()
        self.lengths, self.above = head[:DEPTH], head[DEPTH : 2 * DEPTH]
        n_langs, self.n_texts = head[2 * DEPTH : 2 * DEPTH + 2]
        ends = 8 * (3 * DEPTH + 4) + np.cumsum([0, *head[2 * DEPTH + 2 :]])
        self.blocks = [blob[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        names = np.frombuffer(self._body(0), np.int64)
        self.langs, self.words = names[:n_langs], names[n_langs:]

    def _body(self, block: int) -> memoryview:
        held = self.blocks[block]
        size = int(np.frombuffer(held, np.int64, 1)[0])
        return memoryview(pa.decompress(held[8:], decompressed_size=size, codec="zstd"))

    @staticmethod
    def _ints(data: memoryview, at: int, n: int) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(data[4 * at * n : 4 * (at + 1) * n], np.uint8).reshape(4, n).T).view(np.uint32).ravel()

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parents, words and counts of the level's nodes (depth from 0)."""
        data, n = self._body(2 + depth), self.lengths[depth]
        up, place, low, high = (self._ints(data, i, n) for i in range(4))
        return np.cumsum(up, dtype=np.uint32), place, low + (high.astype(np.int64) << 32) if high.any() else low

    def texts(self) -> list[bytes]:
        """The words of the first level's own nodes."""
        data = self._body(1)
        ends = np.cumsum(self._ints(data[: 4 * self.n_texts], 0, self.n_texts), dtype=np.int64) + 4 * self.n_texts
        return [bytes(data[a:b]) for a, b in zip([4 * self.n_texts, *ends.tolist()], ends.tolist(), strict=False)]


# --------------------------------------------------------------------------- merging


def merged(pieces: list[Piece], langs: np.ndarray, words: np.ndarray, least: int):
    """Merges pieces of one range: for each level the parents (places in the level above), words
    (places in ``words``) and counts of the nodes that occur ``least`` times, which of them
    are the range's own, and for each piece what its nodes have become (-1 where too rare)."""
    width = len(words)
    ranks = [np.searchsorted(words, p.words) for p in pieces]
    became = [np.searchsorted(langs, p.langs) for p in pieces]
    for depth in range(DEPTH):
        runs, held, kept = [], [], []
        for p, above, rank in zip(pieces, became, ranks, strict=True):
            parent, word, times = p.level(depth)
            parent = above[parent]
            kept.append(parent >= 0)
            runs.append(parent[kept[-1]] * width + rank[word[kept[-1]]])
            held.append(times[kept[-1]])
        sizes = list(map(len, runs))
        keys = np.concatenate(runs)
        del runs
        order = np.argsort(keys, kind="stable")  # merges the sorted runs
        keys = keys[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        total = np.add.reduceat(np.concatenate(held).astype(np.int64)[order], begin) if len(keys) else np.zeros(0, np.int64)
        number = np.full(len(begin), -1)
        frequent = np.flatnonzero(total >= least)
        number[frequent] = np.arange(len(frequent))
        place = np.empty(len(keys), np.int64)
        place[order] = np.repeat(number, np.diff(begin, append=len(keys)))
        nodes = keys[begin[frequent]]
        del keys, order, held
        own = np.ones(len(frequent), bool)
        became = []
        for p, k, part in zip(pieces, kept, np.split(place, np.cumsum(sizes)[:-1]), strict=True):
            new = np.full(len(k), -1)
            new[k] = part
            became.append(new)
            if p.above[depth] and new[0] >= 0:
                own[new[0]] = False  # it belongs to a range before this one
        yield nodes // width, nodes % width, total[frequent], own, became


def _names(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([p.langs for p in pieces])), np.unique(np.concatenate([p.words for p in pieces]))


def combine(blobs: list[bytes]) -> bytes:
    """One piece of a range from several, with all nodes."""
    if len(blobs) == 1:
        return blobs[0]
    pieces = [Piece(x) for x in blobs]
    langs, words = _names(pieces)
    above, parents, place, counts, texts = [], [], [], [], []
    for parent, word, total, own, became in merged(pieces, langs, words, 1):
        if not above:
            texts = _texts(pieces, became, own)
        above.append(int(len(own) > 0 and not own[0]))
        for column, value in zip((parents, place, counts), (parent, word, total), strict=True):
            column.append(value)
    return serialised(above, langs, words, parents, place, counts, np.array([len(x) for x in texts], np.int64), b"".join(texts))


def _merge(least: int):
    def run(table: pa.Table) -> pa.Table:
        """The frequent nodes of a range, from the pieces of all tasks."""
        pieces = [Piece(x) for x in table.column("piece").to_pylist()]
        langs, words = _names(pieces)
        paths, counts, out = langs.reshape(-1, 1), np.zeros((len(langs), 0), np.int64), []
        for depth, (parent, word, total, own, became) in enumerate(merged(pieces, langs, words, least), 1):
            paths = np.column_stack([paths[parent], words[word]])
            counts = np.column_stack([counts[parent], total])
            out.append(_rows(paths[own], counts[own], depth, _texts(pieces, became, own) if depth == 1 else None))
        return pa.concat_tables(out)

    return run


def _shards(bounds: np.ndarray, limit: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        #: Pieces of the shards so far, by range, and their bytes.
        pieces: dict[int, list[bytes]] = {}
        size = kept = 0

        def cut() -> int:
            data, starts, ends, hashes, langs, joined = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            trie = Trie(langs, hashes, joined)
            del hashes, langs, joined

            def text(at: np.ndarray) -> tuple[np.ndarray, bytes]:
                sizes = ends[at] - starts[at]
                total = np.cumsum(sizes) - sizes
                return sizes, data[np.repeat(starts[at] - total, sizes) + np.arange(sizes.sum())].tobytes()

            found = 0
            for r, blob in trie.pieces(bounds, text):
                pieces.setdefault(r, []).append(blob)
                found += len(blob)
            return found

        def combined() -> Iterator[pa.RecordBatch]:
            for r in sorted(pieces):
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([combine(pieces.pop(r))], pa.binary())], names=["range", "piece"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for step in steps(batch.column(1)):
                part, starts, ends, row, joined = _words(step)
                if len(starts):
                    held.append((part.data, starts + size, ends + size, signed(part.hash_spans(starts, ends)), keys[step.first_row + row], joined))
                    size += len(part.data)
                if size >= limit:
                    kept, size = kept + cut(), 0
                if kept >= most:
                    yield from combined()
                    kept = 0
        if held:
            cut()
        yield from combined()

    return run


def _texts(pieces: list[Piece], became: list[np.ndarray], own: np.ndarray) -> list[bytes]:
    """The words of the first level's nodes."""
    found: list[bytes] = [b""] * len(own)
    for p, new in zip(pieces, became, strict=True):
        for node, text in zip(new[p.above[0] :].tolist(), p.texts(), strict=True):
            if node >= 0:
                found[node] = text
    return [x for x, o in zip(found, own.tolist(), strict=True) if o]


def _rows(paths: np.ndarray, counts: np.ndarray, depth: int, texts: list[bytes] | None) -> pa.Table:
    n = len(paths)

    def lists(x: np.ndarray) -> pa.Array:
        offsets = np.arange(n + 1, dtype=np.int32) * x.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel(), pa.int64()))

    return pa.table(
        {
            "key": pa.array(paths[:, 0].copy()),
            "depth": pa.array(np.full(n, depth, np.int32)),
            "path": lists(paths[:, 1:]),
            "f": pa.array(counts[:, -1].copy(), pa.int64()),
            "lefts": lists(counts[:, :-1]),
            "word": pa.array(texts, pa.binary()) if texts is not None else pa.nulls(n, pa.binary()),
        }
    )


def count_nodes(docs: DataFrame, scratch: Scratch, least: int = LEAST, text: str = "text", lang: str = "lang", shard: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables: lang, n; and the paths that occur often enough: key (hash of the language),
    depth, path (hashes of words), f, lefts (counts of its beginnings), word (at depth one)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_bytes(text).alias("bytes")).select(F.xxhash64("lang").alias("key"), "lang", "bytes")
    size = rows.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / RANGE_BYTES))
    # A path in some 8 bytes of text; a sample of it grows with the number of ranges.
    survey = scratch.write(rows.mapInArrow(_survey(SAMPLED * ranges * 8 / max(size, 1)), "lang string, n long, path array<long>"), "survey")
    bounds = _bounds(survey.where("path IS NOT NULL"), ranges)
    pieces = rows.select("key", "bytes").mapInArrow(_shards(bounds, shard, TASK_BYTES), "range long, piece binary")
    nodes = scratch.write(pieces.groupBy("range").applyInArrow(_merge(least), _NODE), "nodes")
    langs = survey.where("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return langs, nodes


# --------------------------------------------------------------------------- phrases


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes of two words and more with ``rights``: the counts of their ends, the longest first, by suffix links."""
    every = above = nodes.where("depth = 1").withColumn("rights", F.expr("cast(array() AS array<long>)"))
    for depth in range(2, DEPTH + 1):
        link = above.select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.concat(F.array("f"), "rights").alias("rights"))
        own = nodes.where(F.col("depth") == depth)
        above = own.join(link, (F.col("key") == F.col("_key")) & (F.slice("path", 2, depth - 1) == F.col("_path"))).select(*nodes.columns, "rights")
        every = above if depth == 2 else every.unionByName(above)
    return every


def _scored(phrases: DataFrame) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut, of equal ones the first."""
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("depth") - 1),
        lambda k: F.struct(k.alias("k"), F.get("lefts", k - 1).alias("l"), F.get("rights", k - 1).alias("r")),
    )
    # Decimals hold the products.
    scored = F.expr("transform(_cuts, c -> struct((cast(f AS decimal(19,0)) * 2000000) div (cast(c.l AS decimal(19,0)) + c.r) AS score, c.k AS k, c.l AS l, c.r AS r))")
    best = phrases.withColumn("_cuts", cuts).withColumn("_best", F.array_min(scored))
    return best.select("key", "depth", "path", F.col("f").alias("a"), F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), F.col("_best.score").alias("score"))


def _uncovered(phrases: DataFrame, nodes: DataFrame, covered: int) -> DataFrame:
    """Drops phrases of which so many parts in a hundred lie in a longer one.

    Of those that hold a phrase, one that is a word longer is the most frequent.
    """
    longer = nodes.where("depth > 2").select("key", "f", F.explode(F.array(F.expr("slice(path, 1, depth - 1)"), F.expr("slice(path, 2, depth - 1)"))).alias("path"))
    most = longer.groupBy(F.col("key").alias("_key"), F.col("path").alias("_path")).agg(F.max("f").alias("_most"))
    held = phrases.join(most, (F.col("key") == F.col("_key")) & (F.col("path") == F.col("_path")), "left")
    kept = F.col("_most").isNull() | (_exact("_most") * 100 < _exact("a") * covered)
    return held.where(kept).drop("_key", "_path", "_most")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST, covered: int = COVERED, shard: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``most`` phrases."""
    scratch = Scratch(docs.sparkSession, "collocations")
    langs, nodes = count_nodes(docs, scratch, least, text, lang, shard)
    phrases = _uncovered(_scored(linked(nodes)), nodes, covered)
    # First by figures alone, ties all kept; only what is left gets its words.
    first = phrases.withColumn("_rank", F.rank().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= most).drop("_rank")
    words = nodes.where("depth = 1").select(F.col("key").alias("_key"), F.col("path")[0].alias("_hash"), F.col("word").cast("string").alias("_word"))
    spread = first.select("*", F.posexplode("path").alias("_at", "_of"))
    spelt = spread.join(words, (F.col("key") == F.col("_key")) & (F.col("_of") == F.col("_hash")))
    figures = ["key", "path", "a", "l", "r", "score"]
    spelt = spelt.groupBy(*figures).agg(F.array_sort(F.collect_list(F.struct("_at", "_word"))).alias("_words"))
    named = spelt.select("key", F.array_join(F.col("_words._word"), " ").alias("phrase"), "a", "l", "r", "score")
    ordered = named.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= most)
    known = langs.select(F.xxhash64("lang").alias("_key"), "lang", "n")
    found = ordered.join(known, F.col("key") == F.col("_key"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
