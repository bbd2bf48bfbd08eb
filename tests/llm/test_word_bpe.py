"""The word-end BPE against the tokenizers library, whole and in parts."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quantloom.llm import word_bpe
from quantloom.llm.common import STEP_BYTES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Hello <|endoftext|> WORLD's  it's naïve <|ENDOFTEXT|>x12 ΣΑΣ",
    "",
    " \n\t",
    "'s'sll '' 's don't 'REALLY' i'LL we'Re",
    "ábc ȩ́ 각 한국어 ́x",
    "日本語のテキスト、漢字 ①②½ ٣٤",
    "<|startoftext|><|endof<|endoftext|>x<|",
    "ᲉꟋ\U00016ea0  　​  İKß",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    return lambda text: found.encode(text, add_special_tokens=False).ids, lambda ids: found.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def bpe():
    return word_bpe.WordBPE(PATH)


def in_parts(bpe, text, rng):
    stream, out, at = word_bpe.Stream(bpe), [], 0
    while at < len(text):
        size = rng.choice([1, 3, 50, 5000])
        out += stream.push(text[at : at + size])
        at += size
    return out + stream.finish()


def texts():
    rng = random.Random(3)
    letters = "aaabcdehinorstu'<|>!?.,0123 \n\té́ßİKΣ漢\U0001f600‍-_"
    yield from ODD
    for n in (5, 30, 300, 3000):
        for _ in range(30):
            yield "".join(rng.choice(letters) for _ in range(n))
    for some in ("abcdefghinorst", "aeinst", "!?.-_*", "th", "ha", "a", "!", "é", "漢", "é"):
        yield "".join(rng.choice(some) for _ in range(9000))


def test_equals_the_library_whole_and_in_parts(bpe, library):
    rng = random.Random(8)
    for text in texts():
        want = library[0](text)
        assert bpe.encode(text) == want, text[:100]
        assert in_parts(bpe, text, rng) == want, text[:100]


def test_every_character_is_taken_as_the_library_takes_it(bpe, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(4).shuffle(chars)
    for i in range(0, len(chars), 500):
        text = "x".join(chars[i : i + 500]) + "'" + "".join(chars[i : i + 500])
        assert bpe.encode(text) == library[0](text)


def test_memory_stays_constant(bpe):
    for some in ("abcdehinorst", "漢字", "!?*"):
        rng, stream, most = random.Random(1), word_bpe.Stream(bpe), 0
        for _ in range(300):
            stream.push("".join(rng.choice(some) for _ in range(700)))
            most = max(most, len(stream.raw) + len(stream.normal) + len(stream.transducer.held))
        assert most <= 2 * word_bpe.HELD + word_bpe.BLOCK + bpe.lookahead


def test_no_horizon_is_ever_broken(bpe):
    """A token with so many bytes behind it as its horizon says stays, whatever follows."""
    rng = random.Random(6)
    assert 0 < bpe.lookahead < 1000
    for _ in range(300):
        some = rng.choice(["abcdehinorst", "aeinst", "than", "ha!", "es"])
        text = "".join(rng.choice(some) for _ in range(260)).encode()
        whole = bpe.merged([bpe.inner[b] for b in text])
        ends = [0]
        for t in whole:
            ends.append(ends[-1] + bpe.size[t])
        for known in (40, 100, 180, 230):
            end = 0
            for i, token in enumerate(bpe.merged([bpe.inner[b] for b in text[:known]])):
                if end + bpe.size[token] + bpe.horizon[token] > known:
                    break
                assert token == whole[i] and end == ends[i]
                end += bpe.size[token]


def test_improper_merges_are_refused(tmp_path):
    chars = word_bpe.byte_characters()
    names = [*chars, *(c + word_bpe.END for c in chars), "abc", "ab"]
    held = {"added_tokens": [], "model": {"vocab": {t: i for i, t in enumerate(names)}, "merges": [["ab", "c"], ["a", "b"]]}}
    import json

    (tmp_path / "x.json").write_text(json.dumps(held))
    with pytest.raises(ValueError, match="before its parts"):
        word_bpe.WordBPE(str(tmp_path / "x.json"))


def test_decoding_is_incremental(bpe):
    rng = random.Random(2)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0]) for _ in range(rng.randint(0, 12)))
        machine = word_bpe.Utf8()
        assert "".join(machine.push(data[i : i + 1]) for i in range(len(data))) + machine.finish() == data.decode("utf-8", "replace")
    assert bpe.decode(bpe.encode("Naïve  漢字\U0001f600 <|endoftext|> x")) == "naïve 漢字 \U0001f600 <|endoftext|>x "


def test_round_trip_of_documents(spark, make, corpus, library):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdehinorstué!") for _ in range(rng.randint(1, 12))) for _ in range(70_000)) + "x" * 40_000
    assert len(long.encode()) > 2 * STEP_BYTES
    rows = corpus + [(900 + i, t) for i, t in enumerate(ODD)] + [(950, long), (951, "b" * (STEP_BYTES + 7)), (951, None), (952, "w " * 300_000)]
    found = {}
    for r in word_bpe.round_trip(make(rows), PATH).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {}
    for doc_id, text in rows:
        ids = library[0](text or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library[1](ids))]
        want.setdefault(doc_id, []).append((len(ids), *digest))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_ids_and_text_of_documents(spark, make, library):
    rows = [(1, "Two words"), (2, None), (3, ""), (4, "naïve\n漢")]
    encoded = word_bpe.encode_documents(make(rows), PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library[0](t or "") for i, t in rows}
    assert {r.doc_id: r.decoded for r in word_bpe.decode_documents(encoded, PATH).collect()} == {1: "two words ", 2: "", 3: "", 4: "naïve 漢 "}
    assert word_bpe.round_trip(make([]), PATH).collect() == []


def test_invalid_bytes_are_replaced(spark, make, library):
    from pyspark.sql import functions as F

    raw = b"ab\xff\xe4 c\x80"
    docs = make([(1, "x")]).withColumn("text", F.lit(bytearray(raw)).cast("string"))
    ids = library[0](raw.decode("utf-8", "replace"))
    assert word_bpe.encode_documents(docs, PATH).first().ids == ids
