"""Jaccard self-join of word n-gram sets by PartEnum signatures.

Sets are put in bands of like size.  Within a band, a similarity threshold bounds how
many elements two sets may differ in, k.  The feature domain is split into n1 parts of
three subparts each; as n1 is over k / 2, two similar sets differ in at most one
subpart of some part, so leaving one subpart out at a time (the enumeration of subsets)
gives them a signature in common.  A set that may meet sets of the band below has
signatures there too.

Some parts are spare: similar sets have more signatures in common than one, t at least.
All sets rank signatures by popularity alike, so the least popular common one is not among
the t - 1 most popular of either set.  A set leaves those out and still meets every similar
set.  Equal sets are one class that its least document stands for.

No group of equal signatures is turned into all its pairs.  Each task links its own rows
of a signature to their least and sends one of them on, so a signature that a third of
all rows have costs a shuffle one row a task.  Then a signature's members are compared in
rounds of stars: with its least one, then with the next few, and so on, some times as many
each round.  After a round its centres have met everyone and leave, verified links join
documents to components, and a signature whose members are all of one component is done.
Two documents that share several signatures meet under the first.

Defined cases: null or blank texts have no set, n_shingles 0, and form components of
their own; rows without doc_id are counted but linked with nothing (component_id null);
rows with the same doc_id are one node, linked by either text; repeated rows repeat; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch, Texts, mix, packed, signed, steps, text_bytes, unpacked, windows
from quantloom.llm.components import components, contracted, extended

WORDS, PERCENT = 4, 85
#: Upper end of a band over its lower end.
BAND_RATIO = 1.5
#: Signatures that a task gathers before it links its own equal ones and sends the rest,
#: and bytes of text whose signatures (about one in ten bytes) meet in a bucket.
CHUNK_ROWS, BUCKET_BYTES = 1 << 18, 4 << 20
#: Members of a signature up to which it is not worth leaving out.
UNPOPULAR = 4
#: Centres of each signature in the second round of stars (the first has one), and how many times more in each next.
STARS, MORE_STARS = 4, 8
#: Signatures that a row remembers, to meet each partner once.
REMEMBERED = 4


def shingles(part: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct word n-grams, ordered by both.

    Rows with fewer words have their whole sequence as one element.
    """
    part = part.lower()
    starts, ends, ranges = part.words()
    hashes = part.hash_spans(starts, ends)
    _, row, value = windows(hashes, ranges, words)
    counts = np.diff(ranges)
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for i in range(n):
                whole = mix(whole * np.uint64(31) + hashes[ranges[short] + i] + np.uint64(n))
            row, value = np.concatenate([row, short]), np.concatenate([value, whole])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    np.add.at(out, at, values)
    return out


def fingerprints(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two 64-bit hashes of it."""
    sizes = np.bincount(row, minlength=rows)
    salts = (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x3C3C3C3C3C3C3C3C))
    first, second = (mix(_sums(row, mix(value ^ x), rows) + sizes.astype(np.uint64)) for x in salts)
    return sizes, first, second


#: Words of 64 bits in a short parity sketch; in the join on signatures it is folded to half.
SKETCH = 8


def _parity_bits(place: np.ndarray, bucket: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, place + (bucket >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bucket & np.uint64(63)))
    return out


def parities(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """For each row and bucket of the domain whether an odd number of elements falls there.

    Two sets differ in at least as many elements as their sketches differ in bits.
    """
    bucket = (value >> np.uint64(7)) % np.uint64(64 * SKETCH)
    return _parity_bits(row * SKETCH, bucket, rows * SKETCH).reshape(rows, SKETCH)


def long_parities(row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """As parities(), with two to four buckets an element (a power of two, 512 at least)."""
    words = SKETCH << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / (32 * SKETCH)))).astype(np.int64)
    ends = np.cumsum(words)
    starts = ends - words
    bucket = (value >> np.uint64(7)) & (words[row].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    bits = _parity_bits(starts[row], bucket, int(ends[-1]) if len(ends) else 0)
    return [bits[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def folded(sketch: bytes, words: int) -> np.ndarray:
    """A long sketch folded to so many words, or as it is if it is shorter."""
    bits = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(bits.reshape(-1, min(words, len(bits))), axis=0)


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two long sketches differ, the longer one folded to the shorter."""
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


class Bands:
    """The bands up to a size: lower and upper ends, reach (the largest partner) and k.

    Of a band's parts, similar sets differ in two or more subparts of k // 2 at most.  One
    more must remain, ``spare`` ones may be without elements in a signature, others are there
    for popular signatures.  Of the p parts that are not spare, a equal ones, b with one differing
    subpart and c with more give 3 a + b common signatures; as b + 2 c is at most the number of
    elements that the sets differ in, d, these are 2 p - d at least.  ``common`` is 2 p.  ``words``
    is the length of a sketch with a bit an element or so, which sets apart what 256 bits cannot; 0
    where those do.
    """

    def __init__(self, largest: int, percent: int = PERCENT, ratio: float = BAND_RATIO):
        self.percent = percent
        low, self.low, self.high, self.reach, self.parts, self.spare, self.common, self.words = 1, [], [], [], [], [], [], []
        while low <= largest:
            high = max(low, ceil(low * ratio) - 1)
            reach = high * 100 // percent
            k = (100 - percent) * (high + reach) // (100 + percent)
            self.low.append(low)
            self.high.append(high)
            self.reach.append(reach)
            spare, more = k // 40, 0 if k < 16 else 2 + k // 16 * 2
            p = 0 if k == 0 else k // 2 + 1 + more
            self.spare.append(spare)
            self.common.append(2 * p)
            self.words.append(0 if reach < 512 else 1 << int(0.75 * low / 64).bit_length())
            self.parts.append(0 if k == 0 else p + spare)
            low = high + 1

    def leave(self) -> str:
        """How many popular signatures of ``band`` a set of ``n`` elements may leave out: one less than it has in common with any
        similar set that is to be met there, of ``high`` elements at most if this one has more."""
        high, reach, common = (f"array({', '.join(map(str, x))})[band]" for x in (self.high, self.reach, self.common))
        partner = f"if(n > {high}, {high}, least({reach}, n * 100 div {self.percent}))"
        return f"greatest(0, {common} - 1 - {_bound('n', partner, self.percent)})"


def signatures(row: np.ndarray, value: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and band of every signature of the sets."""
    low = np.array(bands.low)
    own = np.searchsorted(low, sizes, "right") - 1
    out_row, out_key, out_band = [], [], []
    first = np.searchsorted(row, np.arange(len(sizes) + 1))
    for band in np.unique(np.concatenate([own, own - 1])):
        if band < 0:
            continue
        chosen = np.flatnonzero((sizes >= bands.low[band]) & (sizes <= bands.reach[band]))
        if not len(chosen):
            continue
        n = bands.parts[band]
        counts = sizes[chosen]
        local = np.repeat(np.arange(len(chosen)), counts)
        take = np.repeat(first[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        element = value[take]
        salt = mix(np.array([0x5151 + 977 * int(band)], np.uint64))[0]
        body = mix(element ^ salt)
        if n == 0:  # no difference is allowed: the whole set is the signature
            out_row.append(chosen)
            out_key.append(mix(_sums(local, body, len(chosen)) ^ salt))
            out_band.append(np.full(len(chosen), band, np.int16))
            continue
        place = ((element >> np.uint64(32)) * np.uint64(3 * n) >> np.uint64(32)).astype(np.int64)
        size = len(chosen) * 3 * n
        total = _sums(local * (3 * n) + place, body, size).reshape(len(chosen), n, 3)
        held = (np.bincount(local * (3 * n) + place, minlength=size) > 0).reshape(len(chosen), n, 3)
        rest = total.sum(axis=2, keepdims=True, dtype=np.uint64) - total
        filled = held.sum(axis=2, keepdims=True) - held > 0
        # Signatures without an element are needed only where a set has too many of them.
        bare = (~filled).any(axis=2).sum(axis=1) > bands.spare[band]
        names = mix(np.arange(1, 3 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ salt).reshape(n, 3)
        keys = mix(rest ^ names)
        emit = filled | bare[:, None, None]
        out_row.append(np.repeat(chosen, emit.reshape(len(chosen), -1).sum(axis=1)))
        out_key.append(keys[emit])
        out_band.append(np.full(len(out_key[-1]), band, np.int16))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int16)
    return np.concatenate(out_row), np.concatenate(out_key), np.concatenate(out_band)


#: Columns of packed signatures: those of one bucket of keys, or ``direct`` ones that need none.
_PACKED = "bucket long, direct boolean, n long, keys binary, docs binary, notes binary"


def _pack(bucket: int, direct: bool, keys: np.ndarray, docs: np.ndarray, notes: np.ndarray) -> tuple:
    """Signatures in order of key; note 2 * band, and 1 more if several documents are known to have the key."""
    steps_of = np.diff(keys, prepend=np.uint64(0))
    return bucket, direct, len(keys), packed(steps_of), packed(docs), packed(notes.astype(np.int64))


def _link_own(keys: np.ndarray, docs: np.ndarray, bands: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One task's signatures, packed by bucket of key: of a key's documents the least goes to its
    bucket; the others are known to share the key and go anywhere."""
    order = np.lexsort((docs, keys))
    keys, docs, bands = keys[order], docs[order], bands[order].astype(np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    followed = np.zeros(len(keys), bool)
    followed[:-1] = ~new[1:]
    rest = ~new
    rows = []
    if rest.any():
        rows.append(_pack(int(keys[0] % np.uint64(buckets)), True, keys[rest], docs[rest], 2 * bands[rest] + 1))
    keys, docs, notes = keys[new], docs[new], (2 * bands + followed)[new]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    for i, (start, end) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)):
        rows.append(_pack(int(found[i]), False, keys[start:end], docs[start:end], notes[start:end]))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "direct", "n", "keys", "docs", "notes"])


_P = tuple(f"p{i}" for i in range(SKETCH))
_Q = tuple(f"q{i}" for i in range(SKETCH // 2))


def _bound(n: str, m: str, percent: int) -> str:
    """The elements that similar sets of n and m elements differ in, at most."""
    return f"{100 - percent} * ({n} + {m}) div {100 + percent}"


def set_table(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, the set's two hashes and its parity sketches, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, others, sketches, long = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((0, SKETCH), np.uint64)], []
            for part in steps(batch.column(1)):
                row, value = shingles(part, words)
                n, print_of, other = fingerprints(row, value, part.rows)
                sizes.append(n)
                prints.append(print_of)
                others.append(other)
                sketches.append(parities(row, value, part.rows))
                long += long_parities(row, value, n)
            bits = np.concatenate(sketches).T
            values = [np.concatenate(sizes).astype(np.int64), signed(np.concatenate(prints)), signed(np.concatenate(others)), *(signed(np.ascontiguousarray(x)) for x in bits)]
            columns = [batch.column(0), *map(pa.array, values), pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print", "print2", *_P, "sketch"])

    schema = "doc_id long, n_shingles long, print long, print2 long, " + ", ".join(f"{p} long" for p in _P) + ", sketch binary"
    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(run, schema)


def signature_rows(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """The signatures of all texts, packed (see ``_link_own``)."""
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / BUCKET_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(1 << 12, percent)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in steps(batch.column(1)):
                row, value = shingles(part, words)
                sizes, prints, _ = fingerprints(row, value, part.rows)
                fresh = np.zeros(part.rows, bool)  # exact copies are known by their hash already
                for i, x in enumerate(prints.tolist()):
                    if sizes[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                sizes = np.where(fresh, sizes, 0)
                keep = fresh[row]
                if not keep.any():
                    continue
                if bands.reach[-1] < sizes.max():
                    bands = Bands(2 * int(sizes.max()), percent)
                at, key, band = signatures(row[keep], value[keep], sizes, bands)
                held.append((key, ids[part.first_row + at], band))
                size += len(key)
                if size >= chunk:
                    yield _link_own(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, size = [], 0
                    seen.clear()
        if size:
            yield _link_own(*map(np.concatenate, zip(*held, strict=True)), buckets)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(run, _PACKED)


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's signatures those that several documents have."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row in table.to_pylist():
        n = row["n"]
        keys = np.cumsum(unpacked(row["keys"], n, np.uint64), dtype=np.uint64)
        part = keys, unpacked(row["docs"], n, np.int64), unpacked(row["notes"], n, np.int64)
        (found if row["direct"] else parts).append(part)
    if parts:
        keys, docs, notes = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        many = notes[order] % 2 > 0
        many[1:] |= same
        many[:-1] |= same
        found.append(tuple(x[order[many]] for x in (keys, docs, notes)))
    keys, docs, notes = map(np.concatenate, zip(*found, strict=True))
    return pa.table({"key": pa.array(signed(keys)), "doc": pa.array(docs), "band": pa.array((notes >> 1).astype(np.int16))})


def shared_signatures(rows: DataFrame) -> DataFrame:
    """key, doc, band of the signatures that more than one document has."""
    return rows.groupBy("bucket").applyInArrow(_shared, "key long, doc long, band short")


def id_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """of, bytes of the rows with a doc_id and a text."""
    return docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("of"), text_bytes(text).alias("bytes"))


def verified(pairs: DataFrame, docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold, from whole texts.

    Each row of a doc_id's texts is compared: repeated ones are best taken out before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                good = np.zeros(part.num_rows, bool)
                for side_a, side_b in zip(_sets(part.column(2), words), _sets(part.column(3), words), strict=True):
                    at, x = side_a
                    _, y = side_b
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[at] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], names=["a", "b"])

    texts = id_texts(docs, text)
    needed = pairs.select(F.col("a").alias("of")).unionAll(pairs.select(F.col("b").alias("of"))).distinct()
    texts = texts.join(needed, "of", "left_semi")
    left = texts.select(F.col("of").alias("a"), F.col("bytes").alias("x"))
    right = texts.select(F.col("of").alias("b"), F.col("bytes").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for part in steps(column):
        row, value = shingles(part, words)
        first = np.searchsorted(row, np.arange(part.rows + 1))
        for i in range(part.rows):
            yield part.first_row + i, value[first[i] : first[i + 1]]


def _screen(percent: int):
    """Of rows (a, b, sizes and long sketches of both) the pairs that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = (100 - percent) * (n + m) // (100 + percent)
            apart = [bits_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            good = pa.array(np.array(apart, np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return run


def _open_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes that sizes and sketches allow to be similar."""

    def side(x: str) -> DataFrame:
        return classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch_{x}"), *(F.col(p).alias(f"{x}_{p}") for p in _P))

    apart = " + ".join(f"bit_count(a_{p} ^ b_{p})" for p in _P)
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {apart} <= {_bound('na', 'nb', percent)}"
    met = pairs.join(side("a"), "a").join(side("b").withColumnRenamed("b", "bb"), F.expr(f"b = bb AND {near}"))
    return met.select("a", "b", "na", "nb", "sketch_a", "sketch_b").mapInArrow(_screen(percent), "a long, b long")


def _placed(met: DataFrame, bands: Bands, scratch: Scratch) -> DataFrame:
    """Of rows with key, band, rep and its size n what the classes keep, with each row's earlier keys k1, k2, ...

    Each class leaves out as many of its most popular signatures of a band as ``bands`` allow.
    """
    popular = scratch.write(met.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "popular")
    met = met.join(popular, "key").repartition("rep")
    by_popularity = Window.partitionBy("rep", "band").orderBy(F.desc("m"), "key")
    allowed = F.expr(bands.leave())
    met = met.withColumn("place", F.row_number().over(by_popularity)).where((F.col("m") <= UNPOPULAR) | (F.col("place") > allowed))
    by_key = Window.partitionBy("rep").orderBy("key")
    return met.drop("m", "place").withColumns({f"k{i}": F.lag("key", i).over(by_key) for i in range(1, REMEMBERED + 1)})


def _with_long_sketch(rows: DataFrame, words: list[int]) -> DataFrame:
    """Takes the sketch of each row to its band's length, as w; null where the short one does."""
    kept = [c for c in rows.columns if c not in ("band", "sketch")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(words)[batch.column("band").to_numpy()].tolist()
            found = [folded(x, n).view(np.int64) if n else None for x, n in zip(batch.column("sketch").to_pylist(), size, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.int64()))], names=[*kept, "w"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in kept) + ", w array<long>")


def _round(placed: DataFrame, stars: int, percent: int, scratch: Scratch, step: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of one round of stars that may be similar, and what is left of ``placed``.

    A signature's ``stars`` least members meet all its members of other components; rows
    that share an earlier signature have their meeting there.
    """
    by_key = Window.partitionBy("key")
    first = placed.withColumn("place", F.row_number().over(by_key.orderBy("rep"))).where(F.col("place") <= stars).drop("place")
    # Written before it is joined, so that Spark can split the rows of a frequent signature.
    first = scratch.write(first.withColumn("last", F.max("rep").over(by_key)), f"centres{step}")
    x = first.select(*(F.col(c).alias(f"x_{c}") for c in placed.columns))
    y = placed.select(*(F.col(c).alias(f"y_{c}") for c in placed.columns))
    wide = "aggregate(zip_with(x_w, y_w, (a, b) -> bit_count(a ^ b)), 0, (s, v) -> s + v)"
    earlier = ", ".join(f"{{0}}_k{i}" for i in range(1, REMEMBERED + 1))
    apart = " + ".join(f"bit_count(x_{q} ^ y_{q})" for q in _Q)
    near = (
        f"x_key = y_key AND x_rep < y_rep AND x_label != y_label AND 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)"
        f" AND {apart} <= {_bound('x_n', 'y_n', percent)} AND NOT arrays_overlap(array({earlier.format('x')}), array({earlier.format('y')})) IS TRUE"
        f" AND (x_w IS NULL OR y_w IS NULL OR {wide} <= {_bound('x_n', 'y_n', percent)})"
    )
    pairs = x.join(y, F.expr(near)).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).distinct()
    done = first.where("rep = last").select("key", "last").distinct()
    return pairs, placed.join(done, "key").where("rep > last").drop("last")


def _undecided(placed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of signatures whose members are of several components."""
    split = placed.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first != last")
    return placed.join(scratch.write(split.select("key"), name), "key", "left_semi")


def similar_documents(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    scratch = Scratch(docs.sparkSession, "ngram_join")
    members = scratch.write(shared_signatures(signature_rows(docs, text, words, percent)), "members")
    sets = scratch.write(set_table(docs, text, words), "sets")
    # Equal sets are one class, named by its least document.
    filled = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Written first, so that Spark can split the join where a third of all rows are copies.
    same = scratch.write(filled.groupBy("n_shingles", "print", "print2").agg(F.min("doc_id").alias("rep")), "same")
    nodes = filled.join(same, ["n_shingles", "print", "print2"])
    nodes = scratch.write(nodes.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "rep", *_P, "sketch").distinct(), "nodes")
    # Links join classes; copies get their class's component at the end.  A doc_id with several sets joins their classes.
    several = nodes.groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b != last").select("doc", "b")
    several = scratch.write(several, "several")
    links = nodes.join(several, "doc").where("rep != b").select(F.col("rep").alias("a"), "b").distinct()
    # One row of each class; a doc_id with several sets may have other rows of the same doc.
    classes = nodes.where("doc = rep")
    # Rows of the same doc_id and set would be compared each with each.
    texts = docs
    if filled.count() > nodes.count():
        once = id_texts(docs, text).distinct().select(F.col("of").alias("doc_id"), F.col("bytes").cast("string").alias(text))
        texts = scratch.write(once, "texts")
    largest = nodes.agg(F.max("n")).first()[0] or 1

    met = scratch.write(members.join(nodes.select("doc", "rep", "n"), "doc").select("key", "band", "rep", "n"), "met")
    scratch.drop("members")
    centres = scratch.write(met.groupBy("key").agg(F.min("rep").alias("a")), "centres")
    pairs = met.join(centres, "key").where("rep > a").select("a", F.col("rep").alias("b")).distinct()

    def linked(pairs: DataFrame, step: int) -> DataFrame:
        """Of the pairs those that are similar."""
        asked = scratch.write(_open_pairs(pairs, classes, percent), f"asked{step}")
        found = scratch.write(verified(asked, texts, text, words, percent), f"links{step}")
        scratch.drop(f"asked{step}")
        return found

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")

    links = links.unionAll(linked(pairs, 0))
    scratch.drop("centres")
    labels = components(links, scratch, "stars0_")
    halves = [F.expr(f"p{i} ^ p{i + SKETCH // 2}").alias(q) for i, q in enumerate(_Q)]
    bands = Bands(int(largest), percent)
    # A table of its own, so that no task holds the buffers of both halves at once.
    opened = scratch.write(_undecided(labelled(met), scratch, "split0").drop("label").distinct(), "opened")
    scratch.drop("met")
    placed = _placed(opened, bands, scratch).join(classes.select("rep", *halves, "sketch"), "rep")
    placed = scratch.write(labelled(_with_long_sketch(placed, bands.words)), "placed0")
    for done in ("opened", "popular", "split0"):
        scratch.drop(done)
    stars, step = STARS, 1
    while placed.take(1):
        pairs, rest = _round(placed, stars, percent, scratch, step)
        links = linked(pairs, step)
        if links.take(1):
            # Only between the components so far, of which the new labels are then made.
            more = components(contracted(links, labels), scratch, f"stars{step}_")
            labels = scratch.write(extended(labels, more), f"labels{step}")
            rest = labelled(rest.drop("label"))
        # Written, as it is read twice.
        rest = scratch.write(rest, f"rest{step}")
        for done in (f"placed{step - 1}", f"centres{step}"):
            scratch.drop(done)
        placed = scratch.write(_undecided(rest, scratch, f"split{step}"), f"placed{step}")
        for done in (f"rest{step}", f"split{step}", f"links{step}"):
            scratch.drop(done)
        stars, step = stars * MORE_STARS, step + 1
    # All classes of a doc_id are of one component.
    own = labelled(nodes.select("doc", "rep")).where("label != doc").groupBy("doc").agg(F.min("label").alias("label"))
    found = sets.join(scratch.write(own, "own"), F.col("doc_id") == F.col("doc"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
