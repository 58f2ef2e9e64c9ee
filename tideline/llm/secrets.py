"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

The window's entropy is kept by incremental counts: with c occurrences of each symbol in a window
of w characters, H = log2(w) - sum(c * log2(c)) / w, and one step changes two terms of that sum.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext
from .common import only, small_batches

BASE_KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy, so the same as runs of any length of which 20 characters and more stay
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

Span = tuple[str, int, int]


@dataclass(frozen=True)
class CharClass:
    """A class of characters in which secrets are written. A window counts where its entropy reaches `bits`
    and each of `needs` occurs in it."""

    kind: str
    letters: frozenset[str]
    window: int
    bits: float
    needs: tuple[re.Pattern, ...]


CLASSES = (
    CharClass("entropy_hex", frozenset("0123456789abcdefABCDEF"), 20, 3.0, (re.compile("[0-9]"), re.compile("[a-fA-F]"))),
    CharClass("entropy_base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.9, (re.compile("[0-9].*[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]"))),
)
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[a-z]+(?:[-_/][a-z]+)*[-_/]?"),  # words, slugs and paths
    re.compile(r"[0-9]+(?:[-_/][0-9]+)*[-_/]?"),  # dates, numbers of phones and cards
)
MARKER = re.compile(r"example|sample|placeholder|your[-_]|xxxx|dummy", re.IGNORECASE)
REACH = 64  # characters on either side of a marker, within its '='-separated token, that the marker explains
KINDS = (*BASE_KINDS, *(c.kind for c in CLASSES))
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
_PLOGP = [0.0, *(c * math.log2(c) for c in range(1, 4096))]


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and without overlap per kind; code points, end exclusive."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def window_runs(run: str, kind: CharClass) -> list[tuple[int, int]]:
    """Unions of the overlapping windows of a run, all of one class, that reach the class's entropy."""
    w = kind.window
    if len(run) < w:
        return []
    most = (math.log2(w) - kind.bits) * w + 1e-9  # H >= bits as a bound on the sum of c * log2(c)
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, letter in enumerate(run):
        c = counts.get(letter, 0)
        counts[letter] = c + 1
        total += _PLOGP[c + 1] - _PLOGP[c]
        if i >= w:
            old = run[i - w]
            c = counts[old]
            counts[old] = c - 1
            total += _PLOGP[c - 1] - _PLOGP[c]
        if i >= w - 1 and total <= most and all(need.search(run, i - w + 1, i + 1) for need in kind.needs):
            if found and i - w + 1 <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i - w + 1, i + 1))
    return found


def unexplained(run: str) -> list[tuple[int, int]]:
    """The parts of a candidate that no marker explains; the '=' beside an explained part is none of them."""
    out, at = [], 0
    for m in MARKER.finditer(run):
        first, last = max(run.rfind("=", 0, m.start()), m.start() - REACH), run.find("=", m.end())
        last = min(last + 1 if last >= 0 else len(run), m.end() + REACH)
        if first > at:
            out.append((at, first))
        at = max(at, last)
    return [*out, (at, len(run))]


def candidates(text: str) -> list[tuple[int, str]]:
    """Place and letters of the strings of a text that no allow-list entry explains as a whole."""
    found = ((m.start(), m[0]) for m in CANDIDATE.finditer(text))
    return [(at, run) for at, run in found if not (run.isalpha() or run.isdigit() or any(a.fullmatch(run) for a in ALLOWED))]


def entropy_spans(found: list[tuple[int, str]], kind: CharClass) -> list[Span]:
    """Windows of high entropy for a class, by start, in candidates but for what a marker explains."""
    out: list[Span] = []
    for at, run in found:
        for low, high in unexplained(run):
            start = None
            for i in range(low, high + 1):
                inside = i < high and run[i] in kind.letters
                if inside and start is None:
                    start = i
                elif not inside and start is not None:
                    out += [(kind.kind, at + start + a, at + start + b) for a, b in window_runs(run[start:i], kind)]
                    start = None
    return out


def secret_spans(text: str) -> list[Span]:
    """All spans by start, then kind. An entropy span inside a span of an earlier kind says nothing new and is left out."""
    base = base_spans(text)
    out, held, strings = list(base), list(base), candidates(text)
    for kind in CLASSES:
        if not strings:
            break
        held.sort(key=lambda s: s[1])
        at, reach, kept = 0, -1, []
        for span in entropy_spans(strings, kind):
            while at < len(held) and held[at][1] <= span[1]:
                reach = max(reach, held[at][2])
                at += 1
            if span[2] > reach:
                kept.append(span)
        out += kept
        held += kept
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every union of overlapping spans replaced by the mark."""
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrowtext.slices(batch):
            rows = [secret_spans(t) for t in arrowtext.texts(part).to_pylist()]
            of = lambda kind: pa.array([sum(s[0] == kind for s in r) for r in rows], pa.int64())
            base = [hashlib.sha256(written([s for s in r if s[0] in BASE_KINDS]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *map(of, BASE_KINDS), pa.array(base, pa.string()), pa.array(map(written, rows), pa.string()), pa.array([sum(s[0] not in BASE_KINDS for s in r) for r in rows], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each whole text; one row per input row, no shuffle.

    A null or empty text has no spans (the digest is that of the empty string); a null doc_id stays null;
    repeated rows are each scanned; other columns are ignored whatever their names.
    """
    small_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    )


def _redact(text_at: int, chars_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.slices(batch, batch.schema.names[text_at]):
                out = [None if t is None else redacted(t, secret_spans(t)) for t in part.column(text_at).to_pylist()]
                columns = list(part.columns)
                columns[text_at] = pa.array(out, part.schema.field(text_at).type)
                if chars_at >= 0:
                    columns[chars_at] = pa.array([n if t is None else len(t) for t, n in zip(out, columns[chars_at].to_pylist())], part.schema.field(chars_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Every row of docs, all columns, with secrets in `text` replaced by a mark and `n_chars`, where there is one, counted anew.

    A null text stays null and keeps its n_chars; an empty text stays empty.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    return docs.mapInArrow(_redact(names.index("text"), names.index("n_chars") if "n_chars" in names else -1), docs.schema)
