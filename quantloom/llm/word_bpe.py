"""BPE with word ends as a bounded-lookahead streaming transducer.

Merging the lowest rank first looks as if the end of a text could change its beginning.  How
far it can is computed from the merge list: ``horizon`` of a token is the number of bytes
behind it that settle whether it is formed and stays.  A merge of (u, v) is settled when u and v are,
when no earlier merge takes u from the left or v to the right, and when those that might are
settled themselves; in order of rank each horizon follows from those before it.  The
greatest one is the list's sufficient lookahead (150 bytes for the vocabulary of 49,408
entries).  The transducer holds back so much, emits a token as soon as it is settled and
forgets its bytes: memory stays constant however long a word is.

A text passes four such stages: special tokens are cut out of the raw text; normalisation
runs up to the last place that nothing behind can change; pieces are cut, a letter run that
is still going on is passed on in parts; pieces are encoded.  Decoding is a state machine
over bytes which gives characters as soon as they are complete.

Stretches without white space that were met lately are looked up by hash; only new ones
and texts longer than a step go through the transducer.

Defined cases: a null text counts as empty; invalid UTF-8 is replaced by U+FFFD; repeated
rows give repeated results; an empty table gives an empty result; only ``doc_id`` and the
text are read.  NFC has to hold a run of combining marks until it ends, so such a run is
the one thing that memory grows with.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from quantloom.llm.byte_bpe import digests, white_space
from quantloom.llm.common import STEP_BYTES, Texts, bound_batches, steps, text_bytes

END = "</w>"
#: Bytes that a transducer takes beyond its lookahead before it encodes again.
BLOCK = 256
#: Characters that the stages before it hold, about; stretches up to so many bytes are kept.
HELD, KEPT_STRETCH = 4096, 256
#: Bytes of encoded stretches that a Python worker keeps, about, and pieces.
KEPT_BYTES, KEPT_PIECES = 16 << 20, 50_000
#: Of two symbols' numbers one key.
_SHIFT = 20
_NEVER = 1 << 40
#: The pieces of a text whose letters beyond ASCII are written as a and digits as 0.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LETTERS, _OTHERS = regex.compile(r"[a-z]+"), regex.compile(r"[^\sa-z0-9]+")
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBPE:
    """Merges, their horizons, and the tables for normalising, cutting and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        vocabulary: dict[str, int] = found["model"]["vocab"]
        chars = byte_characters()
        self.inner = [vocabulary[c] for c in chars]
        self.final = [vocabulary[c + END] for c in chars]
        self.strings = [""] * (1 + max([*vocabulary.values(), *(x["id"] for x in found["added_tokens"])]))
        for token, i in vocabulary.items():
            self.strings[i] = token
        #: Of each pair the rank, of each rank the pair and what it becomes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        for rank, pair in enumerate(found["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.append((vocabulary[left], vocabulary[right]))
            self.ranks[self.pairs[-1][0] << _SHIFT | self.pairs[-1][1]] = rank
            self.made.append(vocabulary[left + right])
        self.size = [0] * len(self.strings)
        for i in (*self.inner, *self.final):
            self.size[i] = 1
        self.horizon = self._horizons()
        #: The bytes behind a token that always suffice to tell that it stays.
        self.lookahead = max(self.horizon)
        self.special = {x["content"]: x["id"] for x in found["added_tokens"]}
        for token, i in self.special.items():
            self.strings[i] = token
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.beginnings = tuple(t[:n] for t in self.special for n in range(1, len(t)))
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.kinds = Kinds()
        self.known: dict[str, list[int]] = {}
        byte = {c: b for b, c in enumerate(chars)}
        #: What a token stands for: its bytes, with a blank where it ends a word; a special one for its string.
        self.bytes_of = [t.encode() if t in self.special else bytes(byte[c] for c in t.removesuffix(END)) + b" " * t.endswith(END) for t in self.strings]

    def _horizons(self) -> list[int]:
        """For each token the bytes behind it that settle whether it is formed and stays.

        For u and v, what is nearer than v's bytes is known anyway, hence the subtractions.
        """
        count = len(self.strings)
        formed, to_right, from_left = [0] * count, [0] * count, [0] * count
        for (u, v), token in zip(self.pairs, self.made, strict=True):
            if not self.size[u] or not self.size[v] or self.size[token]:
                raise ValueError("a merge before its parts, or two merges that make the same: no horizon can be told")
            self.size[token] = self.size[u] + self.size[v]
            need = max(0, formed[v], to_right[v], formed[u] - self.size[v], from_left[u] - self.size[v])
            formed[token] = need
            to_right[u] = max(to_right[u], self.size[v] + need)
            from_left[v] = max(from_left[v], need)
        return [max(x) for x in zip(formed, to_right, from_left, strict=True)]

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges the lowest rank first, of equal ones the first, until none applies."""
        get = self.ranks.get
        ranks = [get(a << _SHIFT | b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NEVER:
            at = ranks.index(least)
            symbols[at : at + 2] = [self.made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(symbols[at - 1] << _SHIFT | symbols[at], _NEVER)
            if at < len(ranks):
                ranks[at] = get(symbols[at] << _SHIFT | symbols[at + 1], _NEVER)
        return symbols

    def piece(self, text: str) -> list[int]:
        """The ids of a whole piece; short ones are kept."""
        found = self.known.get(text)
        if found is None:
            data = text.encode()
            if len(data) <= BLOCK:  # no longer than what a transducer takes at once
                symbols = list(map(self.inner.__getitem__, data))
                symbols[-1] = self.final[data[-1]]
                found = self.merged(symbols)
            else:
                transducer = Transducer(self)
                found = transducer.push(data) + transducer.finish()
            if len(text) <= 32:
                if len(self.known) >= KEPT_PIECES:
                    self.known.clear()
                self.known[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        if text.isascii() and text.isalpha():
            return self.piece(text.lower())
        stream = Stream(self)
        if len(text) > HELD or self.special_at and self.special_at.search(text):
            return stream.push(text) + stream.finish()
        return stream.rest(text)

    def normalised(self, text: str) -> str:
        """Composed and in lower case; up to U+02FF all is composed already."""
        return text.lower() if text.isascii() or max(text) < "̀" else self.normal(text)

    def decode(self, ids: Iterable[int]) -> str:
        """What the tokens' bytes say, with a blank behind each word."""
        machine = Utf8()
        return "".join(machine.push(self.bytes_of[i]) for i in ids) + machine.finish()


class Kinds(dict):
    """For str.translate: a for a letter beyond ASCII, 0 for a digit and ¬ for all else but white space.

    Which is which the tokenizer's own expressions say, once a character.
    """

    def __init__(self):
        self.cut = [(mark, pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed", invert=True)) for mark, name in (("a", "L"), ("0", "N"))]

    def __missing__(self, code: int) -> int:
        char = chr(code)
        found = char if code < 128 or char.isspace() else next((mark for mark, split in self.cut if split.pre_tokenize_str(char)), "¬")
        self[code] = ord(found)
        return self[code]

    def plain(self, text: str) -> str:
        return text if text.isascii() else text.translate(self)


class Transducer:
    """Encodes one piece that comes in parts, holding back only what later bytes can change."""

    def __init__(self, bpe: WordBPE):
        self.bpe = bpe
        self.held = bytearray()

    def push(self, more: bytes) -> list[int]:
        """The tokens that are settled now."""
        out: list[int] = []
        for at in range(0, len(more), BLOCK):
            self.held += more[at : at + BLOCK]
            if len(self.held) > BLOCK + self.bpe.lookahead:
                out += self._settled()
        return out

    def _settled(self) -> list[int]:
        bpe, out, end = self.bpe, [], 0
        known = len(self.held) - 1  # the last byte may turn out to end the word
        for token in bpe.merged([bpe.inner[b] for b in self.held[:known]]):
            if end + bpe.size[token] + bpe.horizon[token] > known:
                break
            end += bpe.size[token]
            out.append(token)
        del self.held[:end]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, bytearray()
        return self.bpe.merged([self.bpe.inner[b] for b in held[:-1]] + [self.bpe.final[held[-1]]]) if held else []


def _safe(char: str) -> bool:
    """Whether normalising never joins the character to one before it."""
    return char < "̀" or category(char)[0] != "M" and category(char) != "Cn" and not "ᅠ" <= char <= "ᇿ"


class Stream:
    """Encodes a text that comes in parts."""

    def __init__(self, bpe: WordBPE):
        self.bpe = bpe
        self.raw, self.normal = "", ""
        self.beginnings = bpe.beginnings
        #: A piece that is going on: its kind and its transducer.
        self.going: regex.Pattern | None = None
        self.transducer = Transducer(bpe)

    def push(self, more: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(more), HELD):
            self.raw += more[at : at + HELD]
            out += self._specials()
            keep = next((i for i in range(len(self.raw) - 1, 0, -1) if _safe(self.raw[i])), 0)
            keep = min(keep, len(self.raw) - self._open_special())
            out += self._pieces(self.bpe.normalised(self.raw[:keep]), False)
            self.raw = self.raw[keep:]
        return out

    def finish(self) -> list[int]:
        out = self._specials()
        rest, self.raw = self.raw, ""
        return out + self.rest(rest)

    def rest(self, text: str) -> list[int]:
        """Ends with this text, in which no special token stands."""
        return self._pieces(self.bpe.normalised(text), True)

    def _specials(self) -> list[int]:
        """Cuts out whole special tokens and encodes what stands before them to its end."""
        out: list[int] = []
        while self.bpe.special_at and (found := self.bpe.special_at.search(self.raw)):
            out += [*self.rest(self.raw[: found.start()]), self.bpe.special[found.group()]]
            self.raw = self.raw[found.end() :]
        return out

    def _open_special(self) -> int:
        """The length of the longest beginning of a special token that the raw text ends with."""
        return max((len(t) for t in self.beginnings if self.raw.endswith(t)), default=0) if self.raw.endswith(self.beginnings) else 0

    def _pieces(self, more: str, last: bool) -> list[int]:
        bpe, out, start = self.bpe, [], 0
        text, self.normal = self.normal + more, ""
        plain = bpe.kinds.plain(text)
        if self.going and text:
            found = self.going.match(plain)
            start = found.end() if found else 0
            out += self.transducer.push(text[:start].encode())
            if start < len(text):
                out += self._ended()
        for found in _PIECE.finditer(plain, start):
            # A run may go on, and what follows may make 're, 've or 'll of an apostrophe.
            if not last and (found.end() == len(text) or found.start() + 3 > len(text)):
                self.normal = text[found.start() :]
                if len(self.normal) > HELD:  # long enough to be a run; what it goes on with is of its kind
                    self.going = _LETTERS if _LETTERS.match(plain, found.start()) else _OTHERS
                    out += self.transducer.push(self.normal.encode())
                    self.normal = ""
                break
            out += bpe.piece(text[found.start() : found.end()])
        return out + self._ended() if last else out

    def _ended(self) -> list[int]:
        self.going = None
        return self.transducer.finish()


class Utf8:
    """Bytes to text, a character as soon as it is complete, U+FFFD for what can be none.

    The state is the bits so far, how many bytes are missing and between which bounds the
    next one has to lie.
    """

    def __init__(self):
        self._start()

    def _start(self) -> None:
        self.bits = self.missing = 0
        self.low, self.high = 0x80, 0xBF

    def push(self, data: bytes) -> str:
        if not self.missing and data.isascii():
            return data.decode("ascii")
        out = []
        for byte in data:
            if self.missing:
                if self.low <= byte <= self.high:
                    self.bits, self.missing = self.bits << 6 | byte & 0x3F, self.missing - 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.bits))
                        self._start()
                    continue
                out.append("�")  # what came before is broken off; this byte begins anew
                self._start()
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.missing = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.bits = byte & (0x3F >> self.missing)
                # No overlong forms, no surrogates, nothing above U+10FFFF.
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        broken = self.missing
        self._start()
        return "�" if broken else ""


class Encoder:
    """A task's encoder: looks up stretches that it met before, by hash."""

    def __init__(self, path: str):
        self.bpe = WordBPE(path)
        #: Tokens' strings and decimals, with the blank that joins them behind each.
        self.strings = pa.array([t.encode() + b" " for t in self.bpe.strings], pa.large_binary())
        self.decimals = pa.array([b"%d " % i for i in range(len(self.bpe.strings))], pa.large_binary())
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encoded(self, part: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = part.data.tobytes()
        found = [self.bpe.encode(data[i:j].decode("utf-8", "replace")) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for ids in found for x in ids), np.int32, int(sizes.sum())), sizes

    def texts(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts and the bounds of each text's ids."""
        if self.ids.nbytes + 3 * self.hashes.nbytes > KEPT_BYTES:
            self._reset()
        starts, ends, ranges = part.runs(~white_space(part.data))
        distinct, first, place = np.unique(part.hash_spans(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        begin, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[~new], sizes[~new] = self.starts[at[~new]], self.sizes[at[~new]]
        ids, sizes[new] = self._encoded(part, starts[first[new]], ends[first[new]])
        begin[new] = len(self.ids) + np.cumsum(sizes[new]) - sizes[new]
        every = np.concatenate([self.ids, ids])
        if len(ids) <= KEPT_BYTES // 8:
            self.ids = every
            self.hashes, self.starts, self.sizes = (np.insert(x, at[new], y[new]) for x, y in ((self.hashes, distinct), (self.starts, begin), (self.sizes, sizes)))
        held = sizes[place]
        total = np.zeros(len(held) + 1, np.int64)
        np.cumsum(held, out=total[1:])
        return every[np.repeat(begin[place] - total[:-1], held) + np.arange(total[-1])], total[ranges]

    def parts(self, data: np.ndarray) -> Iterator[list[int]]:
        """The ids of one long text, in parts, through the stream."""
        stream, machine = Stream(self.bpe), Utf8()
        for at in range(0, len(data), STEP_BYTES):
            yield stream.push(machine.push(data[at : at + STEP_BYTES].tobytes()))
        yield stream.push(machine.finish()) + stream.finish()

    def round_trip(self, part: Texts) -> tuple[list[int], list[str], list[str]]:
        """For each text the number of its tokens and the digests of ids and decoded text."""
        if part.rows == 1 and len(part.data) > STEP_BYTES:
            n, of_ids, of_text, behind = 0, sha256(), sha256(), b""
            for ids in self.parts(part.data):
                n += len(ids)
                if ids:
                    of_ids.update(behind + " ".join(map(str, ids)).encode())
                    of_text.update(behind + " ".join(map(self.bpe.strings.__getitem__, ids)).encode())
                    behind = b" "
            return [n], [of_ids.hexdigest()], [of_text.hexdigest()]
        ids, bounds = self.texts(part)
        at = pa.array(ids)
        return np.diff(bounds).tolist(), digests(self.decimals.take(at), bounds, 1), digests(self.strings.take(at), bounds, 1)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in steps(batch.column(1)):
                if part.rows == 1 and len(part.data) > STEP_BYTES:
                    ids = np.array([x for ids in encoder.parts(part.data) for x in ids], np.int32)
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = encoder.texts(part)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first_row, part.rows), lists], names=["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the ids stand for; ids outside the vocabulary fail the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the tokens' strings joined by blanks.

    Encoding and decoding share a pass, so neither ids nor texts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in steps(batch.column(1)):
                counts, of_ids, of_text = encoder.round_trip(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first_row, part.rows), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(run, _SCHEMA)
