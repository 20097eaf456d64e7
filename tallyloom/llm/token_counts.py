"""Token counts by heap-and-linked-list byte-pair merging; no identifier is ever made.

A text is cut at its special strings, then into pieces as the byte-level vocabulary does. Each piece starts as its UTF-8
bytes; the adjacent pair of lowest rank is merged again and again, and the count is initial symbols minus merges.
Counts of pieces that came before are kept in a bounded cache, which changes no result.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.common import add_columns, texts_of

# Unicode white space; fixed values
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs without inner white space, each with at most one blank before it: no piece crosses their borders.
RUNS = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: white space other than blanks and line ends
RARE_SPACE = re.compile(rf"[{SPACES}]".replace(" ", "").replace("\n", ""))
#: entries of the caches of counts, and the longest run that is cached
CACHED_RUNS, CACHED_LENGTH = 1_000_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Known(dict):
    """Counts of runs by need; it starts afresh when it is full."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, run: str) -> int:
        n = self.count(run) if run else 0
        if len(run) <= CACHED_LENGTH:
            if len(self) >= CACHED_RUNS:
                self.clear()
            self[run] = n
        return n


class Counter:
    """Counts tokens as the vocabulary file at ``path`` gives them, without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        import public_tokenizers

        pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
        self.pieces = regex.compile(pattern)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.piece_counts: dict[str, int] = {}
        self.known = Known(self.of_run)

    def merged(self, piece: str) -> int:
        """Tokens of one piece: the pair of lowest rank, leftmost first, leaves the heap until none is left."""
        symbols = [self.symbols[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        if n == 1:
            return 1
        ranks = self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, (left, right) = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbols[i] = joined = left + right
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = (joined, symbols[k])
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, i, pair))
            if (h := before[i]) >= 0:
                pair = (symbols[h], joined)
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, h, pair))
        return n - merges

    def of_run(self, run: str) -> int:
        total, pieces = 0, self.piece_counts
        for piece in self.pieces.findall(run):
            n = pieces.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) <= CACHED_LENGTH:
                    if len(pieces) >= CACHED_RUNS:
                        pieces.clear()
                    pieces[piece] = n
            total += n
        return total

    def of_plain(self, text: str) -> int:
        if not text:
            return 0
        if any(pair in text for pair in ("  ", " \n", "\n ", "\n\n")) or RARE_SPACE.search(text):
            return sum(map(self.known.__getitem__, RUNS.findall(text)))
        # single blanks and line ends only: a blank belongs to the word after it, a line end is a piece of its own
        first, *others = text.split("\n")
        total = sum(map(self.known.__getitem__, first.replace(" ", "\n ").split("\n")))
        for line in others:
            total += self.known["\n"] + sum(map(self.known.__getitem__, line.replace(" ", "\n ").split("\n")))
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.of_plain(text)
        return len(self.special.findall(text)) + sum(map(self.of_plain, self.special.split(text)))


@cache
def counter(name: str) -> Counter:
    """One counter for each worker and vocabulary."""
    import public_tokenizers

    return Counter(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null or empty text has no bytes and no tokens. Texts are counted whole, each row on its own, so repeated rows and
    nulls in other columns pass through; an empty table gives an empty table. Columns named like the new ones are replaced.
    ``vocabulary`` names a byte-level file of the installed public tokenizers.
    """

    def run(batch: pa.RecordBatch) -> list[list]:
        count = counter(vocabulary).count
        texts = texts_of(batch, text)
        tokens = [count(t) for t in texts]
        return [[len(t.encode("utf-8")) for t in texts], tokens, [n > limit for n in tokens]]

    return add_columns(docs, "n_bytes long, n_tokens long, over_limit boolean", run)
