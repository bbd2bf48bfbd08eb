import base64
import random
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import tiktoken

from quantloom.llm import byte_bpe
from quantloom.llm.common import Texts, steps

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "Hello  world\n\n it's 1234.5 <|endoftext|>", "été 漢字 　x  y 😀😀", "a" * 5000, "ab" * 3000 + "\t\t  ", "naïve\r\n\r\nthe   end  ", "\x00\x01 \x85 z"]


def test_round_trip_equals_the_library(make, corpus):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(r[0], r[1]) for r in corpus]
    tool = plain()
    found = sorted((tuple(r) for r in byte_bpe.round_trip(make(rows), PATH, PATTERN).collect()), key=str)
    want = []
    for doc, text in rows:
        ids = tool.encode_ordinary(text or "")
        want.append((doc, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)


def test_encode_then_decode(make):
    docs = make([(i, t) for i, t in enumerate(TEXTS)])
    ids = byte_bpe.encode_documents(docs, PATH, PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode_documents(ids, PATH, PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_appends_and_edits_are_exact():
    bpe, tool = byte_bpe.encoder(PATH, PATTERN), plain()
    text = "The quick brown fox jumps over the lazy dog, 12 times. " * 20
    held = byte_bpe.Encoded(bpe, text)
    assert held.ids() == tool.encode_ordinary(text)
    before = held.encoded
    for start, end, new in [(10, 15, "red-ish"), (0, 0, "  Oh, "), (400, 420, ""), (len(text) - 3, len(text), "s' end"), (100, 101, " \n ")]:
        held.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert held.text == text and held.ids() == tool.encode_ordinary(text)
    held.append("ly and more")
    assert held.ids() == tool.encode_ordinary(text + "ly and more")
    assert held.encoded - before < 60


def test_pairs_are_judged_as_merging_does():
    rng = random.Random(3)
    bpe = byte_bpe.encoder(PATH, PATTERN)
    some = [rng.randrange(len(bpe.tokens)) for _ in range(60)] + [rng.randrange(256, 1500) for _ in range(60)] + list(range(60, 130))
    for left in some:
        for right in some:
            parts = [bpe.tokens[left], bpe.tokens[right]]
            assert bpe._follows(left, right) == (bpe.merged(b"".join(parts)) == parts)
    assert all(bpe._follows(-1, x) == (bpe.merged(bpe.tokens[x]) == [bpe.tokens[x]]) for x in some)


def test_any_text_equals_the_library(make):
    rng = random.Random(4)
    alphabet = "aabcethE 0159'.,<|é漢😀ß" + " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u200b\u2028\u202f\u205f\u3000"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(3000)]
    tool = plain()
    found = {r.doc_id: list(r.ids) for r in byte_bpe.encode_documents(make(rows), PATH, PATTERN).collect()}
    assert found == {i: tool.encode_ordinary(t) for i, t in rows}


def test_a_full_table_starts_anew_and_equal_hashes_are_noticed(make, monkeypatch):
    rows = [(i, f"some words {i} and {i * 7} more \u3000 of it" * 3) for i in range(200)]
    want = {i: plain().encode_ordinary(t) for i, t in rows}
    bpe = byte_bpe.PrefixBPE(byte_bpe.load_ranks(PATH), PATTERN)
    column = pa.array([t.encode() for _, t in rows])
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 2000)
    for limit in (300, 5000):
        at = 0
        for part in steps(column, limit):
            ids, bounds, _ = bpe.kept.encode(part)
            for i in range(part.rows):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == want[at + i]
            at += part.rows
    monkeypatch.setattr(Texts, "hash_spans", lambda self, starts, ends: (ends - starts).astype("uint64"))
    bpe.kept._reset()
    part = next(steps(column))
    ids, bounds, _ = bpe.kept.encode(part)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == list(want.values())[: part.rows]


def test_invalid_bytes_are_replaced(spark):
    raw = [b"ab\xff\xfe cd", b"\xe2\x80", b"x \xc2", b"\xe3\x80\x80\xe3\x80 y", b"fine"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "doc_id long, text binary")
    found = {r.doc_id: list(r.ids) for r in byte_bpe.encode_documents(docs, PATH, PATTERN).collect()}
    assert found == {i: plain().encode_ordinary(x.decode("utf-8", "replace")) for i, x in enumerate(raw)}


def test_long_texts_cross_the_step(make):
    text = "wörd another\n" * 120_000
    (found,) = byte_bpe.round_trip(make([(1, text)]), PATH, PATTERN).collect()
    assert found.n_tokens == len(plain().encode_ordinary(text)) and found.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_empty(make):
    assert byte_bpe.round_trip(make([(1, "x")]).where("false"), PATH, PATTERN).collect() == []
