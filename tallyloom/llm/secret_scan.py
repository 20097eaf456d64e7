"""Secret scans: stated patterns, then sliding-window Shannon entropy over candidate strings.

A candidate is a run of base64 or URL-safe characters. Its character class (hexadecimal, letters and digits, base64) gives
the window's threshold; the entropy of each window follows from counts that change by one character in and one out.
Candidates on the allow-list (words, numbers, identifiers such as UUIDs, repeated signs) are suppressed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import add_columns, texts_of

# the stated patterns, in the stated order; fixed values
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

LEAST, SIGNS = 20, "+/_=-"
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
ALNUM_ONLY = re.compile(r"[A-Za-z0-9]+")
#: never secrets: words and paths of letters, numbers, UUIDs, words joined by signs with short numbers between them
ALLOWED = (
    r"[A-Za-z/_=+-]+",
    r"[0-9/_=+-]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*",
)


@dataclass(frozen=True)
class Rules:
    """window: characters in a window; bits: least entropy of a window by character class."""

    window: int = 20
    bits: dict[str, float] = field(default_factory=lambda: {"hex": 2.8, "alnum": 3.6, "base64": 3.6})
    allowed: tuple[str, ...] = ALLOWED


def highest_entropy(s: str, window: int) -> float:
    """The highest Shannon entropy (bits per character) of the windows of ``s``, by incremental counts."""
    width = min(window, len(s))
    if not width:
        return 0.0
    counts: dict[str, int] = {}
    term = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    held = 0.0  # sum of n log n over the counts of the window
    least = math.inf
    for i, ch in enumerate(s):
        n = counts.get(ch, 0)
        held += term[n + 1] - term[n] if n < width else 0.0
        counts[ch] = n + 1
        if i >= width - 1:
            least = min(least, held)
            out = s[i - width + 1]
            n = counts[out]
            held += term[n - 1] - term[n]
            counts[out] = n - 1
    return math.log2(width) - least / width


class Scanner:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.allowed = re.compile("|".join(f"(?:{p})" for p in rules.allowed)) if rules.allowed else None

    def is_random(self, s: str) -> bool:
        if self.allowed and self.allowed.fullmatch(s):
            return False
        kind = "hex" if HEX_ONLY.fullmatch(s) else "alnum" if ALNUM_ONLY.fullmatch(s) else "base64"
        return highest_entropy(s, self.rules.window) >= self.rules.bits[kind]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Random pieces of the candidates; what a stated pattern covers is cut out first, and the signs at a cut do not count."""
        covered: list[tuple[int, int]] = []
        for a, _, b in base:
            if covered and a <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(covered[-1][1], b))
            else:
                covered.append((a, b))
        found, at = [], 0
        for m in CANDIDATE.finditer(text):
            first, last = m.span()
            start = first
            while at < len(covered) and covered[at][1] <= first:
                at += 1
            upto = at  # both lists ascend, so what ends before this candidate is never looked at again
            while upto < len(covered) and covered[upto][0] < last:
                upto += 1
            for a, b in [*covered[at:upto], (last, last)]:
                end = min(a, last)
                if end - start >= LEAST:
                    piece = text[start:end]
                    piece = piece.lstrip(SIGNS) if start > first else piece
                    piece = piece.rstrip(SIGNS) if end < last else piece
                    if self.is_random(piece):
                        found.append((start, 3, end))
                start = max(start, b)
        return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, text: str = "text", rules: Rules = Rules(), mask: str | None = None) -> DataFrame:  # noqa: B008
    """``docs`` with n_assign, n_access, n_hex, n_entropy, base_spans and spans; with ``mask``, also ``masked``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind in the order of ``KINDS``. An entropy span never
    overlaps a span of the stated patterns. ``masked`` is the text with every span replaced by ``mask`` (overlapping spans by one).
    A null text is empty and has no spans (its masked text stays null); nulls elsewhere, repeated rows and other columns
    pass through; an empty table gives an empty table; columns named like the new ones are replaced.
    """

    def run(batch: pa.RecordBatch) -> list[list]:
        scanner = Scanner(rules)
        out: list[list] = [[] for _ in range(7 if mask is not None else 6)]
        column = batch.column(batch.schema.get_field_index(text))
        for whole, is_null in zip(texts_of(batch, text), column.is_null().to_pylist(), strict=True):
            base = scanner.base(whole)
            spans = sorted(base + scanner.added(whole, base))
            for kind in range(4):
                out[kind].append(sum(k == kind for _, k, _ in spans))
            out[4].append(listed(base))
            out[5].append(listed(spans))
            if mask is not None:
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [whole[at:start], mask]
                    at = max(at, end)
                out[6].append(None if is_null else "".join(parts) + whole[at:])
        return out

    ddl = "n_assign long, n_access long, n_hex long, n_entropy long, base_spans string, spans string"
    return add_columns(docs, ddl + (", masked string" if mask is not None else ""), run)


def digest(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``base_sha256``, the SHA-256 of its base spans."""
    return scanned.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256))
