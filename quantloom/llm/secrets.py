"""Secret scans with multipart credential linking.

A credential often has parts that say little alone: an identifier, a secret and an
endpoint.  Strong findings (the base kinds) always count.  Weak candidates are reported
only if complementary parts lie near: within a scope, here a window of bytes that no form
feed interrupts, a weak secret needs an identifier or an endpoint, and a weak identifier
or endpoint needs a secret; a part that overlaps the candidate does not support it.
Parts are joined by a sweep over their sorted intervals, so a text with thousands of
parts stays linear, and a document is a row: nothing is shuffled.

Defined cases: a null text is empty; repeated rows repeat; an empty table gives an empty
result; invalid UTF-8 is read byte by byte; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import text_bytes

#: Base kinds in their order for equal starts, then the weak kinds.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Weak parts: a named account or key id, a long mixed token, a host with a port or a store's address.
_WEAK_ID = re.compile(rb"""(?i:client_?id|user(?:name)?|account|access_?key(?:_?id)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
_WEAK_SECRET = re.compile(rb"[A-Za-z0-9+/_=-]{28,}")
_ENDPOINT = re.compile(rb"(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>|]{3,}")
#: Bytes between parts of one credential, at most.
SCOPE = 400

Span = tuple[int, int, str]


def base_spans(text: bytes) -> list[Span]:
    """(start, end, kind) in bytes, leftmost and without overlap in each kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def weak_parts(text: bytes, strong: list[Span]) -> list[Span]:
    """Weak candidates outside the strong findings; a weak secret mixes letters and digits."""
    taken = sorted((s, e) for s, e, _ in strong)
    starts = [s for s, _ in taken]
    reach, ends = 0, []
    for _, e in taken:
        reach = max(reach, e)
        ends.append(reach)

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return not k or ends[k - 1] <= start

    out = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    out += [(m.start(), m.end(), "weak_id") for m in _WEAK_ID.finditer(text)]
    out += [
        (m.start(), m.end(), "weak_secret")
        for m in _WEAK_SECRET.finditer(text)
        if re.search(rb"[0-9]", m[0]) and re.search(rb"[a-z]", m[0]) and re.search(rb"[A-Z]", m[0])
    ]
    return [x for x in out if free(x[0], x[1])]


def link(strong: list[Span], weak: list[Span], breaks: list[int], scope: int = SCOPE) -> list[Span]:
    """The weak parts that complementary parts support within their scope."""
    roles = {"secret": ("assign", "hex", "weak_secret"), "id": ("access", "weak_id"), "endpoint": ("endpoint",)}
    role_of = {kind: role for role, kinds in roles.items() for kind in kinds}
    places: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    for start, end, kind in strong + weak:
        places[kind].append((start, end))
    # Spans of one kind do not overlap, so their ends rise with their starts.
    order = {kind: sorted(spans) for kind, spans in places.items()}
    begins = {kind: [s for s, _ in spans] for kind, spans in order.items()}

    def near(span: Span, role: str) -> bool:
        """A part of the role that does not overlap the span starts within the scope, in the same section."""
        start, end, _ = span
        section = bisect_right(breaks, start)
        low = max(start - scope, breaks[section - 1] if section else 0)
        high = min(end + scope, breaks[section] if section < len(breaks) else end + scope)
        for kind in roles[role]:
            first = bisect_left(begins[kind], low)
            if first < len(order[kind]) and order[kind][first][1] <= start:
                return True
            if bisect_right(begins[kind], high) > bisect_left(begins[kind], max(low, end)):
                return True
        return False

    out = []
    for span in weak:
        role = role_of[span[2]]
        if role == "secret":
            good = near(span, "id") or near(span, "endpoint")
        else:
            good = near(span, "secret")
        if good:
            out.append(span)
    return out


def _written(text: bytes, spans: list[Span]) -> list[str]:
    """kind:start:end in code points, by start, then kind as listed, then end."""
    places = sorted({x for s, e, _ in spans for x in (s, e)})
    at, seen, points = {}, 0, 0
    for place in places:
        part = text[seen:place]
        points += len(part) - sum(map(part.count, _CONTINUED)) if not part.isascii() else len(part)
        at[place], seen = points, place
    ordered = sorted((at[s], KINDS.index(kind), at[e], kind) for s, e, kind in spans)
    return [f"{kind}:{s}:{e}" for s, _, e, kind in ordered]


_CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]


def scan_text(text: bytes, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans and linked weak spans of one text, in bytes."""
    strong = base_spans(text)
    weak = weak_parts(text, strong)
    if weak:
        breaks = [m.start() for m in re.finditer(rb"\f", text)]
        weak = link(strong, weak, breaks, scope)
    return strong, weak


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(1):
            text = value.as_py()
            strong, weak = scan_text(text)
            counts = [sum(kind == k for *_, kind in strong) for k in KINDS[:3]]
            base = ",".join(_written(text, strong))
            spans = ",".join(_written(text, strong + weak)) if weak else base
            rows.append((*counts, sha256(base.encode()).hexdigest(), spans, len(weak)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
        )


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The findings in each whole text; map-only."""
    return docs.select(F.col("doc_id").cast("long"), text_bytes(text)).mapInArrow(_scan, _SCHEMA)
