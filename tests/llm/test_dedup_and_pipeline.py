"""Line and substring dedup, and the whole pipeline against a brute-force run of its stages."""

import random
import re
import sys
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from test_bpe import plain
from test_ngram_join import brute as near_groups
from test_rules_and_mix import brute_mix

from quantloom.llm import line_dedup, mixing, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line(i, n=10):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8])) == 2


def aligned(a, b):
    """Patience diff by its definition, recursively; without unique common lines the n-th equal lines are matched."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *aligned(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*aligned(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    once = [{x: [k for k, (_, y) in enumerate(side) if y == x] for _, x in side} for side in (a, b)]
    common = [(once[0][x][0], once[1][x][0]) for x in once[0] if len(once[0][x]) == 1 == len(once[1].get(x, ()))]
    if not common:
        common = [p for x in once[0] for p in zip(once[0][x], once[1].get(x, ()), strict=False)]
    common.sort(key=lambda p: p[1])
    best = []  # by place in b: the longest chain that ends here, the one with the least end in a first
    for i, j in common:
        before = [c for c in best if c[-1][0] < i]
        best.append([*max(before, key=lambda c: (len(c), -c[-1][0]), default=[]), (i, j)])
    if not best:
        return []
    chain = max(best, key=lambda c: (len(c), -c[-1][0]))
    out, at = [], (0, 0)
    for i, j in chain:
        out += [*aligned(a[at[0] : i], b[at[1] : j]), (a[i][0], b[j][0])]
        at = i + 1, j + 1
    return out + aligned(a[at[0] :], b[at[1] :])


def brute_lines(rows, least=8):
    """Positions gone of each document: pairs found by comparing runs of lines as texts."""
    texts = {}
    for d, t in rows:
        if d is not None and t is not None:
            texts.setdefault(d, t.split("\n"))
    words = lambda x: len(WORD.findall(x))
    owner, runs = {}, defaultdict(set)
    for d in sorted(texts):
        lines = texts[d]
        for i in range(len(lines)):
            n, j = 0, i
            while j < len(lines) and n < least:
                n, j = n + words(lines[j]), j + 1
            if words(lines[i]) and n >= least:
                runs[d].add(tuple(lines[i:j]))
        for run in runs[d]:
            owner.setdefault(run, d)
    gone = defaultdict(set)
    for d, lines in texts.items():
        for o in {owner[run] for run in runs[d]} - {d}:
            block = []
            for pair in [*aligned(list(enumerate(texts[o])), list(enumerate(lines))), (-9, -9)]:
                if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
                    if sum(words(lines[j]) for _, j in block) >= least:
                        gone[d] |= {j for _, j in block}
                    block = []
                block.append(pair)
    return {d: sorted(g) for d, g in gone.items() if g}


def dedup_rows():
    rows = [(1, "\n".join(line(i) for i in range(5))), (2, "new start\n" + line(1) + "\n" + line(2) + "\nnew end"), (3, "\n".join(line(i) for i in range(5)))]
    rows += [(4, "short line\nshort line"), (5, "short line"), (6, None), (7, ""), (None, line(1)), (8, line(50)), (9, line(51) + "\n" + line(0) + "\n" + line(51))]
    rows += [(20 + i, line(99) + f"\nown {i}") for i in range(120)]
    verse = "\n".join(line(300 + i, 4) for i in range(14))
    rows += [(200, "its title\n" + verse), (201, "another\n" + verse + "\nend"), (202, line(300, 4) + "\nx"), (203, "a\n\n" + line(301, 4) + "\n" + line(302, 4))]
    rows += [(210, "\n".join([line(60), line(61), line(60)])), (211, "\n".join([line(61), line(60), line(60), line(61)]))]
    rng = random.Random(8)
    rows += [(220 + i, "\n".join(line(400 + rng.randrange(6), rng.choice([3, 9])) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows.append((300, "\n".join(line(500 + i % 70, 3) for i in range(40_000))))
    return rows


def test_repetition_never_keeps_lines(make):
    # Many documents hold all lines of several one-line documents: the more there are, the same goes.
    for copies in (20, 150):
        rows = [(i, line(700 + i)) for i in range(5)] + [(10 + i, "\n".join(line(700 + k) for k in range(5))) for i in range(copies)]
        found = {r.doc_id: list(r.gone) for r in line_dedup.repeated(make(rows)).collect()}
        assert found == {10 + i: [0, 1, 2, 3, 4] for i in range(copies)}


def test_lines_equal_brute_force(make):
    rows = dedup_rows()
    found = {r.doc_id: list(r.gone) for r in line_dedup.repeated(make(rows)).collect()}
    assert found == brute_lines(rows)
    assert found[201] == list(range(1, 15)) and 202 not in found and found[203] == [2, 3] and 211 in found
    assert found[2] == [1, 2] and found[3] == [0, 1, 2, 3, 4] and 1 not in found and 8 not in found


def test_a_line_goes_however_many_documents_hold_it(make):
    for copies in (3, 100, 101, 150):
        rows = [(i, f"own {i}\n" + line(7, 8) + f"\nend {i}") for i in range(copies)]
        rows += [(500 + i, line(200 + i) + f"\nof {i}") for i in range(4)] + [(600, "\n".join(line(200 + i) for i in range(4)))]
        found = {r.doc_id: list(r.gone) for r in line_dedup.repeated(make(rows)).collect()}
        assert found == {i: [1] for i in range(1, copies)} | {600: [0, 1, 2, 3]}


def test_lines_taken_out(make):
    rows = dedup_rows() + [(8, "another text")]
    out = line_dedup.remaining(make(rows))
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
    assert texts[2] == ["new start\nnew end"] and sorted(texts[8]) == ["another text", line(50)] and texts[3] == [""] and texts[6] == [None] and texts[7] == [""] and texts[None] == [line(1)]
    counts = {r.doc_id: (r.lines_before, r.lines_gone) for r in line_dedup.removals(make(dedup_rows())).collect()}
    assert counts[3] == (5, 5) and counts[6] == (0, 0) and counts[7] == (1, 0)
    assert line_dedup.removals(make(rows).where("false")).collect() == []


def test_substrings(make):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(80) + " " + ("x" * i) + passage + " " + prose(80)) for i in range(5)] + [(10, prose(300)), (11, None), (12, ""), (None, passage), (13, "y" * 9000)]
    spans = defaultdict(list)
    for r in substring_dedup.repeated_spans(make(rows)).collect():
        spans[r.doc_id].append(r)
    assert set(spans) == {1, 2, 3, 4}
    for i in range(1, 5):
        text = rows[i][1]
        covered = "".join(text[s.start : s.end] for s in spans[i])
        assert len(WORD.findall(covered)) >= 45
        assert all(s.first_doc_id == 0 and text[s.start : s.end] in rows[0][1] for s in spans[i])
    assert substring_dedup.repeated_spans(make(rows).where("false")).collect() == []


def brute_spans(rows, least_words):
    """Chunks byte by byte, their owners in a dictionary, and runs of chunks that others own."""
    values = [int(x) for x in substring_dedup.GEAR]
    owner, chunked = {}, {}
    for doc, text in sorted(((d, t) for d, t in rows if d is not None and t), key=lambda r: r[0]):
        data, start, out = text.encode(), 0, []
        for i in range(len(data)):
            state = sum(values[data[i - k]] << k for k in range(min(16, i + 1))) % 2**32
            whole = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
            if i + 1 == len(data) or i + 1 - start >= 8 and state < 2**28 and whole:
                out.append(data[start : i + 1])
                start = i + 1
        chunked.setdefault(doc, []).append(out)
        for chunk in out:
            owner.setdefault(chunk, doc)
    spans = set()
    for doc, texts in chunked.items():
        for out in texts:
            at, before, run = 0, b" ", None
            for chunk in [*out, None]:
                if chunk is not None and owner[chunk] != doc:
                    words = sum(1 for x, y in zip(before[-1:] + chunk, chunk, strict=False) if y not in b" \t\n\v\f\r" and x in b" \t\n\v\f\r")
                    size = len(chunk.decode())
                    run = (run[0], run[1] + size, run[2] + words, run[3]) if run else (at, at + size, words, owner[chunk])
                elif run:
                    if run[2] >= least_words:
                        spans.add((doc, *run))
                    run = None
                if chunk is not None:
                    at, before = at + len(chunk.decode()), chunk
    return spans


def test_spans_equal_brute_force(make, corpus):
    rows = [(d, t) for d, t, *_ in corpus if d != 5] + [(2000 + i, "the same passage of words that many share " * 5 + f"tail {i}") for i in range(60)]
    rows.append((3000, "".join(f"word{i % 500} é" for i in range(9_000))))
    found = [tuple(r) for r in substring_dedup.repeated_spans(make(rows), span_words=8).select("doc_id", "start", "end", "n_words", "first_doc_id").collect()]
    assert len(found) == len(set(found)) > 60 and set(found) == brute_spans(rows, 8)


def test_copies_are_one_span(make):
    text = " ".join(f"word{i}" for i in range(200))
    found = substring_dedup.repeated_spans(make([(3, text), (5, text), (9, text), (3, text)])).collect()
    assert sorted((r.doc_id, r.start, r.end, r.first_doc_id) for r in found) == [(5, 0, len(text), 3), (9, 0, len(text), 3)]


def test_a_digest_over_many_ranges(spark, make):
    chunk = " ".join(f"word{i}" for i in range(30))
    rows = [(i, " ".join([chunk] * (1 + i % 3)) + f" end{i}") for i in range(300, 0, -1)] + [(900 + i, f"own text {i} " * 9) for i in range(20)]
    docs = make(rows)
    owner, want = {}, set()
    for r in substring_dedup.chunks(docs).orderBy("doc_id").collect():
        if owner.setdefault(r.digest, r.doc_id) != r.doc_id:
            want.add((r.doc_id, r.place, owner[r.digest]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = [tuple(r) for r in substring_dedup.later_chunks(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(want) and set(found) == want


def test_later_chunks_stream_over_ranges():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    every = sorted((int(d), int(rng.integers(0, 9)), p) for p, d in enumerate(rng.integers(0, 6, 200)))
    first = {}
    for digest, doc, _ in every:
        first.setdefault(digest, doc)
    want = sorted((doc, p, first[digest]) for digest, doc, p in every if doc != first[digest])
    for cuts in ([0, 200], [0, 50, 60, 61, 150, 200], list(range(0, 201, 4))):
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*every[i : min(i + 7, b)], strict=True)], names=["digest", "doc_id", "place"]) for i in range(a, b, 7)]
            rows += [r for out in substring_dedup._later(iter(batches)) for r in out.to_pylist()]
        ends = {}
        for r in rows:
            if r["place"] is None:
                ends[r["digest"]] = min(r["owner"], ends.get(r["digest"], r["owner"]))
        found = [(r["doc_id"], r["place"], r["owner"] if r["digest"] is None else ends[r["digest"]]) for r in rows if r["place"] is not None]
        assert sorted(x for x in found if x[0] != x[2]) == want


def test_chunks_resist_shifts():
    import numpy as np

    data = np.frombuffer(" ".join(f"token{i * 7919 % 1000}" for i in range(500)).encode(), np.uint8)
    a = substring_dedup.cuts(data)
    b = substring_dedup.cuts(np.concatenate([np.frombuffer(b"inserted ", np.uint8), data])) - 9
    assert len(set(a) & set(b)) >= 0.95 * len(a)


@pytest.mark.parametrize("raw", [b"\x80" * 5000, b"\xe4" + b"\x80" * 5000, b"ab" + b"\xbf" * 9000 + b"cd"])
def test_bytes_that_are_no_text_are_cut(raw):
    import numpy as np

    ends = substring_dedup.cuts(np.frombuffer(raw, np.uint8))
    assert ends[-1] == len(raw) and max(np.diff(ends, prepend=0)) <= substring_dedup.MOST and min(np.diff(ends, prepend=0)) > 0


def test_long_runs_are_cut_between_characters():
    import numpy as np

    raw = ("x" + "\U0001f600" * 3000).encode()
    ends = substring_dedup.cuts(np.frombuffer(raw, np.uint8))
    assert all(raw[e] & 0xC0 != 0x80 for e in ends[:-1]) and b"".join(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)) == raw


@pytest.fixture(scope="module")
def pipeline():
    sys.path.insert(0, "")
    import corpus_pipeline

    return corpus_pipeline


def test_pipeline_equals_brute_force(spark, make, sf_dir, pipeline):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    gone = brute_lines([(r[0], r[1]) for r in rows])
    cut = []
    for d, t, lang, source in rows:
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone.get(d, ())))
        if d not in gone or WORD.search(kept):
            cut.append((d, kept, lang, source))
    label = {d: c for d, _, c in near_groups([(r[0], r[1]) for r in cut], 5, 80)}
    one = [r for r in cut if label[r[0]] == r[0]]
    total, target = brute_mix(one)
    taken, copies, tool = Counter(), Counter(), plain()
    size = {r[0]: len(WORD.findall(r[1])) for r in one}
    source = {r[0]: r[3] for r in one}
    ids = {r[0]: tool.encode_ordinary(r[1]) for r in one}
    texts = {r[0]: r[1] for r in one}
    found = pipeline.run(spark, sf_dir).collect()
    for r in found:
        copies[r.doc_id] += 1
        taken[source[r.doc_id]] += size[r.doc_id]
        assert r.n_tokens == len(ids[r.doc_id]) and r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()
    # What the mix takes of the documents that brute force keeps is what comes out, document by document.
    assert copies == Counter(r.doc_id for r in mixing.mixed(make(one)).select("doc_id").collect())
    assert max(copies.values()) <= 2
    most = max(size.values())
    assert all(abs(taken[s] - target[s]) <= most for s in total)


def test_stages_return_documents(make, spark, sf_dir, pipeline):
    docs = make([(1, "a few words here"), (2, None), (3, ""), (4, "a few words here"), (None, "loose")])
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "print", "label"]
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert mixing.mixed(make([(1, "x")]).where("false")).collect() == []


CLASHING = "_of _hash _gone _copy _whole row rest whole own hash gone of of_hash text_hash size source_size target taken threshold component_id node lines_gone lines_before lang_pred print label key rep n".split()


def test_no_stage_touches_columns_of_its_names(spark, sf_dir, pipeline):
    texts = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(i, texts[i % 6] + ("\nsame line in every one of these documents here" if i % 2 else ""), "en", f"s{i % 3}", 7, 0.25, *(f"{c}{i}" for c in CLASHING)) for i in range(9)]
    rows.append((None, texts[0], "en", None, 7, 0.25, *(f"{c}9" for c in CLASHING)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", *CLASHING]
        kept = docs.collect()
        assert kept and all(r[c] == f"{c}{9 if r.doc_id is None else r.doc_id}" for r in kept for c in CLASHING) and {r.score for r in kept} == {0.25}
        assert all(r.n_chars in (7, len(r.text)) for r in kept)
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_rows_without_an_id_are_not_taken_as_one_block(make):
    docs = make([(None, f"text number {i} " * 5, "en", "a") for i in range(400)] + [(i, "w " * 40, "en", "b") for i in range(400)])
    taken = mixing.mix_sources(docs, share=0.7).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 40 for r in taken)


def test_near_duplicates_by_five_words_and_four_fifths(make, spark, sf_dir, pipeline):
    rows = []
    for i in range(12):
        words = [f"t{i}x{j}" for j in range(46 + i)]
        near = [*words[:20], "other", *words[21:]]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(near))]
    five = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    gone = {b for (_, x), (b, y) in zip(rows[::2], rows[1::2], strict=True) if 5 * len(five(x) & five(y)) >= 4 * len(five(x) | five(y))}
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, make(rows), sf_dir).collect()}
    assert 0 < len(gone) < 12 and kept == {d for d, _ in rows} - gone
