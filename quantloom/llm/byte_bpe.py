"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that its encoding can end
with.  ``last[i]`` stores that token for the prefix of i bytes: of the tokens that end
at i, it is the one that is valid after ``last`` of the prefix before it, where two
tokens are valid side by side if encoding their bytes together gives just these two.
Following ``last`` back from the end gives the encoding.  Because a prefix's entry never
depends on later bytes, appending only adds entries, and after an edit only pieces
near it are encoded again.

Defined cases: a null text counts as empty; invalid UTF-8 is replaced by U+FFFD;
repeated rows give repeated results; an empty table gives an empty result; only
``doc_id`` and the text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Texts, bound_batches, steps, text_bytes

#: Bytes of encoded stretches that a Python worker keeps, about, and judged pairs of
#: tokens (about 130 bytes each); beyond that the table starts anew.
KEPT_BYTES, KEPT_PAIRS = 16 << 20, 150_000
#: White space of one byte, and the rest of Unicode's: two or three bytes.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_WIDE_WHITE = [chr(x).encode() for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = _WHITE[data]
    for lead in sorted({x[0] for x in _WIDE_WHITE}):
        at = np.flatnonzero(data == lead)
        if len(at):
            for char in (x for x in _WIDE_WHITE if x[0] == lead):
                found = at[at + len(char) <= len(data)]
                for i, byte in enumerate(char[1:], 1):
                    found = found[data[found + i] == byte]
                for i in range(len(char)):
                    white[found + i] = True
    return white


def stretches(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches, and for each row the range of its stretches.

    A place after another character and before white space is a boundary of pieces
    whatever stands around it, because no piece has white space behind other characters
    and patterns look ahead past white space only.  A stretch is what lies between two.
    """
    white = white_space(part.data)
    cut = np.zeros(len(white) + 1, bool)
    cut[1:-1] = white[1:] & ~white[:-1]
    cut[part.bounds] = True
    places = np.flatnonzero(cut)
    starts, ends = places[:-1], places[1:]
    return starts, ends, np.searchsorted(starts, part.bounds)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 token, space, rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.pieces = regex.compile(pattern).finditer
        self.longest = max(map(len, ranks))
        #: Finds at each end the tokens that end there, the longest first.
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (len(token), rank))
        self.matcher.make_automaton()
        self.valid: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: What tokens decode to, and their decimal form with a blank behind.
        self.bytes_of = pa.array(self.tokens, pa.large_binary())
        self.decimal_of = pa.array([b"%d " % i for i in range(len(self.tokens))], pa.large_binary())
        self.kept = Stretches(self)

    def merged(self, text: bytes) -> list[bytes]:
        """The encoding of a short text by its definition: merge the lowest rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; none for a byte or what merging never makes."""
        if token not in self.halves:
            text, found = self.tokens[token], None
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                found = self.ranks[parts[0]], self.ranks[parts[1]]
            self.halves[token] = found
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes gives the two again (left -1: the start).

        The halves at the boundary are undone from the last merge to the first.  If
        what then meets there merges before the merge just undone, the boundary is lost.
        Of equal ranks the one to the left merges first.
        """
        if len(self.valid) >= KEPT_PAIRS:
            self.valid.clear()
        found = self.valid[left << 32 | right] = self._follows(left, right)
        return found

    def _follows(self, left: int, right: int) -> bool:
        if any(len(self.tokens[x]) > 1 and self.parts_of(x) is None for x in (left, right) if x >= 0):
            return False  # no text is encoded to a token that merging never makes
        if left < 0:
            return True
        ranks, tokens, before = self.ranks, self.tokens, len(self.tokens)
        while True:
            if ranks.get(tokens[left] + tokens[right], before) < before:
                return False
            halves = (self.parts_of(left), self.parts_of(right))
            if halves[0] and (left > right or not halves[1]):
                before, left = left, halves[0][1]
            elif halves[1]:
                before, right = right + 1, halves[1][0]
            else:
                return True

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """Adds to ``last`` (which starts as [-1]) the entries of the prefixes it lacks."""
        done, valid = len(last), self.valid.get
        from_byte = max(0, done - self.longest)
        for at, (size, token) in self.matcher.iter(text.decode("latin-1"), from_byte):
            if at + 1 == done:
                before = last[done - size]
                good = valid(before << 32 | token)
                if good or good is None and self.follows(before, token):
                    last.append(token)
                    done += 1
        return last

    def walk_back(self, text: bytes, last: list[int]) -> list[int]:
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, text: bytes) -> list[int]:
        whole = self.ranks.get(text)
        return [whole] if whole is not None else self.walk_back(text, self.extend(text, [-1]))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            out += self.encode_piece(piece.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Stretches:
    """The ids of the stretches met so far, found by hash; texts are put together from them."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _add(self, part: Texts, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = part.data.tobytes()
        found = [self.bpe.encode(data[i:j].decode("utf-8", "replace")) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter((x for ids in found for x in ids), np.int32, int(sizes.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.sizes = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.starts, begin), (self.sizes, sizes)))

    def encode(self, part: Texts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of some texts, the bounds of each text's ids, and the tokens' bytes."""
        if self.ids.nbytes + 3 * self.hashes.nbytes > KEPT_BYTES:
            self._reset()
        starts, ends, ranges = stretches(part)
        distinct, first, place = np.unique(part.hash_spans(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != distinct[at < len(self.hashes)]
        if new.any():
            self._add(part, distinct[new], starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.hashes, distinct)
        sizes = self.sizes[at][place]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        ids = self.ids[np.repeat(self.starts[at][place] - total[:-1], sizes) + np.arange(total[-1])]
        bounds = total[ranges]
        tokens = self.bpe.bytes_of.take(pa.array(ids))
        decoded, offsets = _content(tokens)
        if not np.array_equal(decoded, part.data):  # invalid UTF-8, or hashes that met by chance
            return self._one_by_one(part, ids, bounds, decoded, offsets)
        return ids, bounds, tokens

    def _one_by_one(self, part: Texts, ids: np.ndarray, bounds: np.ndarray, decoded: np.ndarray, offsets: np.ndarray):
        rows = []
        for i, (a, b) in enumerate(zip(part.bounds[:-1], part.bounds[1:], strict=True)):
            if np.array_equal(decoded[offsets[bounds[i]] : offsets[bounds[i + 1]]], part.data[a:b]):
                rows.append(ids[bounds[i] : bounds[i + 1]])
            else:
                rows.append(np.array(self.bpe.encode(part.data[a:b].tobytes().decode("utf-8", "replace")), np.int32))
        ids = np.concatenate(rows)
        return ids, np.cumsum([0, *map(len, rows)]), self.bpe.bytes_of.take(pa.array(ids))


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's values, one behind the other, and their bounds."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[: bounds[-1]], bounds


class Encoded:
    """A text with its pieces' prefix tables, open to exact appends and edits."""

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, text
        #: (start, piece, last) of each piece, by code points.
        self.parts = [self._part(m.start(), m.group()) for m in bpe.pieces(text)]
        #: Pieces encoded since the start; the tests watch it.
        self.encoded = len(self.parts)

    def _part(self, start: int, piece: str, known: tuple[str, list[int]] | None = None):
        last = [-1]
        if known and piece.startswith(known[0]):
            last = known[1][: len(known[0].encode()) + 1]
        return start, piece, self.bpe.extend(piece.encode(), last)

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, piece, last in self.parts:
            whole = self.bpe.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.bpe.walk_back(piece.encode(), last)
        return out

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces code points start:end.  Pieces are matched again from two before the
        edit and until a piece begins where an old one behind the edit did."""
        shift = len(replacement) - (end - start)
        text = self.text[:start] + replacement + self.text[end:]
        keep = sum(1 for s, piece, _ in self.parts if s + len(piece) < start)
        keep = max(0, keep - 2)
        old = {s + shift: i for i, (s, _, _) in enumerate(self.parts) if s >= end}
        parts = self.parts[:keep]
        begin = self.parts[keep][0] if keep < len(self.parts) else 0
        begin = 0 if not parts else begin
        before = {s: (piece, last) for s, piece, last in self.parts[keep:]}
        for m in self.bpe.pieces(text, begin):
            at = m.start()
            if at in old and at >= start + len(replacement):
                parts += [(s + shift, piece, last) for s, piece, last in self.parts[old[at] :]]
                break
            parts.append(self._part(at, m.group(), before.get(at)))
            self.encoded += 1
        self.text, self.parts = text, parts


def encoder(path: str, pattern: str) -> PrefixBPE:
    """An encoder, of which each task makes its own and keeps nothing; the path is the same on every machine."""
    return PrefixBPE(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = encoder(path, pattern).kept
        for batch in batches:
            for part in steps(batch.column(1)):
                ids, bounds, _ = kept.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first_row, part.rows), lists], names=["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes; ids outside the vocabulary fail the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(column: pa.Array, bounds: np.ndarray, less: int = 0) -> list[str]:
    """Of each range of values the digest of their bytes (without the last ``less`` ones, if there are any)."""
    data, offsets = _content(column)
    ends = offsets[bounds].tolist()
    return [sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to.

    Encoding and decoding share a pass, so neither ids nor texts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for part in steps(batch.column(1)):
                ids, bounds, tokens = bpe.kept.encode(part)
                decimal = bpe.decimal_of.take(pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first_row, part.rows), pa.array(np.diff(bounds)), pa.array(digests(decimal, bounds, 1), pa.string()), pa.array(digests(tokens, bounds), pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(run, _SCHEMA)
