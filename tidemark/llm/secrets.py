"""Secret scans: fixed patterns, then sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of credential characters. For each character class a window
slides over the run; its counts change by one character in and one out at each step, and so
does the sum from which the entropy follows. Windows above the class's threshold join into
one span. An allow-list suppresses strings that are long but no secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"
_ORDER = {k: i for i, k in enumerate((*KINDS, ENTROPY))}
# The patterns of the contract. Only ASCII letters have two cases here.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")

WINDOW = 20
#: Bits a character in a window of 20, by class; a window holds at most log2(20) = 4.32.
THRESHOLDS = {"hex": 3.0, "base64": 3.8}
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
_CLASSES = {"hex": re.compile(r"[0-9a-fA-F]{20,}+"), "base64": re.compile(r"[A-Za-z0-9+/_=-]{20,}+")}
#: Suppressed: words and identifiers without digits, numbers, UUIDs, dated or dotted names, paths of words.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[A-Za-z/_=+-]+",
        r"[0-9/_=+-]+",
        r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
        r"(?:[A-Za-z]+[0-9]{0,4}[/_=+-]+)+[A-Za-z]*[0-9]{0,4}",
    )
)
_JOINERS = "/_=+-"
_PLOGP = [0.0, *[n * math.log2(n) for n in range(1, WINDOW + 1)]]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's matches in order of start, then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def high_windows(run: str, threshold: float, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """The unions of windows whose entropy reaches the threshold, by incremental counts."""
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    limit = math.log2(window)
    for i, ch in enumerate(run):
        n = counts.get(ch, 0)
        total += _PLOGP[n + 1] - _PLOGP[n]
        counts[ch] = n + 1
        if i >= window:
            old = run[i - window]
            n = counts[old]
            total += _PLOGP[n - 1] - _PLOGP[n]
            counts[old] = n - 1
        if i >= window - 1 and limit - total / window >= threshold - 1e-9:
            if start >= 0 and i - window + 1 > end:
                yield start, end
                start = -1
            if start < 0:
                start = i - window + 1
            end = i + 1
    if start >= 0:
        yield start, end


def _mixed(piece: str) -> bool:
    return any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece)


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching intervals joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def uncovered(start: int, end: int, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) outside of ``covered``, which is in order and disjoint."""
    at = bisect_left(covered, (start, 0))
    if at and covered[at - 1][1] > start:
        at -= 1
    while at < len(covered) and covered[at][0] < end:
        if covered[at][0] > start:
            yield start, covered[at][0]
        start = max(start, covered[at][1])
        at += 1
    if start < end:
        yield start, end


def entropy_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """High-entropy strings that overlap no base span; each needs letters and digits.

    Of a run that base spans cover in part, what is left is taken piece by piece. Joiners at
    the cuts count as no part of a piece where the allow-list is asked.
    """
    out: list[tuple[str, int, int]] = []
    covered = merge((s, e) for _, s, e in taken)
    for m in _CANDIDATE.finditer(text):
        if m.group().isalpha() or any(p.fullmatch(m.group()) for p in ALLOWED):
            continue
        for offset, end in uncovered(m.start(), m.end(), covered):
            if end - offset < WINDOW:
                continue
            run = text[offset:end]
            bare = run.lstrip(_JOINERS) if offset > m.start() else run
            bare = bare.rstrip(_JOINERS) if end < m.end() else bare
            if bare.isalpha() or any(p.fullmatch(bare) for p in ALLOWED):
                continue
            best: list[tuple[int, int]] = []
            for name, pattern in _CLASSES.items():
                for part in pattern.finditer(run):
                    for a, b in high_windows(part.group(), THRESHOLDS[name]):
                        if _mixed(part.group()[a:b]):
                            best.append((part.start() + a, part.start() + b))
            out += [(ENTROPY, offset + a, offset + b) for a, b in merge(best)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one whole text; null is an empty text. Offsets are code points."""
    text = text or ""
    base = base_spans(text)
    more = entropy_spans(text, base)
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]])) if more else base


def scan_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The op8 digest per document row.

    Null and empty texts have no spans and the digest of nothing; very long ones are scanned
    whole. Rows are independent, so ties and repeats need no rule; extra columns are not read,
    and an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS]
            bases = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            spans = [joined(every) for _, every in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(bases, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    if not text:
        return text
    _, spans = scan(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; secrets in ``text`` are replaced and ``n_chars`` follows.

    Documents without secrets come out as they are, with whatever ``n_chars`` they had; null
    and empty texts have none, and very long ones are taken whole. Rows are independent, so
    repeats, ties and other columns need no rule, and an empty table gives an empty result.
    """
    schema = docs.schema
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            before = batch.column(at).to_pylist()
            after = [redact(t, mark) for t in before]
            if counted is not None:
                sizes = [len(b) if a != b else n for a, b, n in zip(before, after, batch.column(counted).to_pylist(), strict=True)]
                batch = batch.set_column(counted, batch.schema.field(counted), pa.array(sizes, batch.schema.field(counted).type))
            yield batch.set_column(at, batch.schema.field(at), pa.array(after, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
