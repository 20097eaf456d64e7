"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words. Patterns (windows of item words) of one length share a shift table over blocks of two words: a block
that no pattern holds lets the search skip all positions at which a pattern would cover it. Where the shift is zero, the
block's suffix bucket selects patterns, and comparing the words confirms an occurrence.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import add_columns, texts_of

#: words after A-Z is lower-cased: digits, letters and everything beyond ASCII, as UTF-8 bytes
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: bytes of benchmark text searched for in one pass
PASS_BYTES = 16 << 20


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8").lower())


class Patterns:
    """The patterns of one length, with the items that hold each."""

    def __init__(self, length: int, items: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shifts: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[tuple[bytes, ...], set[str]]]]] = {}
        for pattern, own in items.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block:end]
                self.shifts[block] = min(self.shifts.get(block, self.furthest), length - end)
            self.buckets.setdefault(pattern[-self.block:], {}).setdefault(pattern[0], []).append((pattern, own))

    def occurrences(self, words: list[bytes]):
        """Yield (start, items) of every occurrence, from left to right."""
        length, block, n = self.length, self.block, len(words)
        shift, furthest = self.shifts.get, self.furthest
        end = length
        if block == 2:
            while end <= n:
                step = shift((words[end - 2], words[end - 1]), furthest)
                if step:
                    end += step
                    continue
                yield from self.confirmed(words, end)
                end += 1
        else:
            for end in range(length, n + 1):
                if (words[end - 1],) in self.shifts:
                    yield from self.confirmed(words, end)

    def confirmed(self, words: list[bytes], end: int):
        start = end - self.length
        bucket = self.buckets.get(tuple(words[end - self.block:end]), {})
        for pattern, items in bucket.get(words[start], ()):
            if tuple(words[start:end]) == pattern:
                yield start, items


class Search:
    def __init__(self, items: list[tuple[str, str]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            if words:
                length = min(window, len(words))
                for start in range(len(words) - length + 1):
                    by_length[length][tuple(words[start:start + length])].add(item)
        self.patterns = [Patterns(length, found) for length, found in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit stretches of words as disjoint (start, end), in order, and the items found."""
        found, items = [], set()
        for patterns in self.patterns:
            for start, own in patterns.occurrences(words):
                found.append((start, start + patterns.length))
                items |= own
        return joined(found), items


def joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


@cache
def search_of(items, window: int) -> Search:
    """One search for each worker and broadcast set of items."""
    return Search(items.value, window)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (disjoint stretches of word positions, end exclusive) and items (sorted as strings).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The benchmark is
    searched for in passes of about ``pass_bytes`` of its text, so what is sent to the executors is bounded whatever its
    size; each pass goes over all documents. A null text has no words and no hits; a null item id is the empty string; items
    with no words never occur; an item id on several rows counts once; an empty benchmark hits nothing. Repeated
    documents, nulls in other columns and other columns pass through; columns named like the new ones are replaced.
    """
    items = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("item"), benchmark[item_text].alias("item_text")).where("item_text is not null")
    total = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    found = docs
    ddl = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
    for number in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(passes)) == number)
        sent = docs.sparkSession.sparkContext.broadcast([(r.item, r.item_text) for r in part.collect()])
        found = add_columns(found, ddl, one_pass(sent, text, window, merge=number > 0))
    return found


def one_pass(sent, text: str, window: int, merge: bool):
    def run(batch: pa.RecordBatch) -> list[list]:
        search = search_of(sent, window)
        counts, hits, items = [], [], []
        earlier = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hits", "items")] if merge else None
        for i, whole in enumerate(texts_of(batch, text)):
            words = words_of(whole)
            stretches, own = search.find(words)
            if earlier:
                stretches = joined(stretches + [(h["start"], h["end"]) for h in earlier[0][i]])
                own = own.union(earlier[1][i])
            counts.append(len(words))
            hits.append([{"start": a, "end": b} for a, b in stretches])
            items.append(sorted(own))
        return [counts, hits, items]

    return run


def report(found: DataFrame) -> DataFrame:
    """``found`` with n_hit, n_items, items_sha256 and contaminated."""
    return found.withColumns({
        "n_hit": F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["end"] - h["start"])),
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
        "contaminated": F.size("hits") > 0,
    })
