"""Language-model scores by online logistic context mixing, beside the scores of smoothed token counts.

A text is a sequence of tokens: its words, then one end. The model predicts the sequence byte by byte (words with a blank after
each, then a line end), every byte as the binary decisions of a Huffman code. Several predictors hash a context (three and
five bytes, the word so far, the word so far after the word before) and the node of the code to a slot with counts
of both outcomes. Their log odds are combined by weights that a gate selects, the gate being how surely the longer contexts
speak, or whether they are new; within a text the weights are refined after each block of decisions, so the total is a probability.

All training texts are counted. Tables of counts have a fixed number of slots; the tables of tasks are added up by a tree of
bounded groups, and what the scoring tasks get is one byte a slot. The weights are learnt on a share of the
training texts (by hash) under the counts of the others, then these are counted as well. Counts of tokens are exact
sums per 64-bit hash of the token, dealt to buckets whose number grows with the input; texts meet them bucket by bucket.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import chunks, release
from tallyloom.session import durable

END = b"\n"
PAD = 5  # bytes before a text, so that no context reaches into another
CHUNK = 2 << 20  # bytes of texts of a batch that are in work at once
SEGMENT = 256 << 10  # bytes of a text that are in work at once; contexts go on across segments
GROUP = 32 << 10  # bytes of short texts that weights are learnt from at once
FAST_GROUP = 16 << 10  # bytes of short texts that are counted or scored at once: their arrays stay in a core's cache
PREDICTORS = 4
#: of each predictor before anything is learnt
FIRST_WEIGHT = 0.3
NODES = 256  # a table has so many slots more, for the nodes of the last context
#: what a count starts at, by predictor: the longer a context, the more its first outcomes say
START = (0.3, 0.15, 0.1, 0.03)
#: the gate: the predictors it looks at, and the sizes of log odds (steps of a byte) at which it changes; below 1 is unseen
GATE, STEPS = (1, 2, 3), (1, 24, 56)
GATES = (1 + len(STEPS)) ** len(GATE)
UNIT = 8 / 127  # log odds of one step of a byte
MULTIPLIER = 0x9E3779B1
BLOCK_SLOTS = 1 << 18  # slots of one row of counts
FAN_IN = 32  # tables added up by one task


@dataclass(frozen=True)
class Settings:
    """table_bits: binary logarithm of the slots, by predictor; calibration: one of so many training texts is for the weights first;
    first_block: decisions before the first refinement (blocks double); inertia: how firmly a text's weights stay; bytes_per_table:
    text of one counting task at least while no core would be idle, as its table has a fixed size."""

    table_bits: tuple[int, ...] = (20, 22, 23, 23)
    calibration: int = 16
    first_block: int = 512
    inertia: float = 20_000.0
    bytes_per_table: int = 256 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()  # A-Z only, ASCII white space only


# ---- the code of bytes


@dataclass(frozen=True)
class Code:
    """Binary decisions of each byte: lengths, offset of the first, and all nodes and bits one byte after the other."""

    lengths: np.ndarray
    offsets: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray


def huffman(histogram: np.ndarray) -> Code:
    heap = [(int(n) + 1, i, i) for i, n in enumerate(histogram)]
    heapq.heapify(heap)
    children: list[tuple] = []
    while len(heap) > 1:
        (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a, b))
        heapq.heappush(heap, (m + n, 256 + len(children), 255 + len(children)))
    found: dict[int, tuple[list[int], list[int]]] = {}
    level, numbers = [(heap[0][2], [], [])], 0
    while level:  # level by level, so that the nodes of frequent bytes are close together
        below = []
        for at, nodes, bits in level:
            if at < 256:
                found[at] = (nodes, bits)
                continue
            for bit, child in enumerate(children[at - 256]):
                below.append((child, [*nodes, numbers], [*bits, bit]))
            numbers += 1
        level = below
    lengths = np.array([len(found[b][0]) for b in range(256)], np.int64)
    return Code(lengths, np.concatenate(([0], np.cumsum(lengths)[:-1])),
                np.array([n for b in range(256) for n in found[b][0]], np.int64), np.array([x for b in range(256) for x in found[b][1]], np.uint8))


# ---- contexts and decisions


def units_of(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """The sequence of a text in segments: (the bytes before, which are context only, and the segment)."""
    whole = b" ".join(words) + b" " + END if words else END
    if len(whole) <= SEGMENT:
        yield END * PAD, whole
        return
    start = 0
    lead = END * PAD
    while start < len(whole):
        end = min(start + SEGMENT, len(whole))
        if end < len(whole) and (cut := whole.rfind(b" ", start, end)) > start:
            end = cut + 1
        yield lead, whole[start:end]
        last = whole.rfind(b" ", max(start, end - 256), end - 1) + 1  # the word before, unless it is very long
        lead = END * PAD + whole[last or end - PAD:end]
        start = end


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(MULTIPLIER, -1, 1 << 32)
    return tuple(np.concatenate((np.ones(1, np.uint32), np.multiply.accumulate(np.full(n - 1, k, np.uint32), dtype=np.uint32))) for k in (MULTIPLIER, inverse))


def contexts(data: np.ndarray, table_bits: tuple[int, ...]) -> list[np.ndarray]:
    """The slot base of each predictor at each byte of ``data``, from the bytes before it."""
    n = len(data)
    up, down = (p[:n] for p in powers(1 << max(16, n.bit_length())))
    before = np.zeros((5, n), np.uint32)
    for k in range(5):
        before[k, k + 1:] = data[:n - k - 1]
    three = before[0] | before[1] << np.uint32(8) | before[2] << np.uint32(16)
    five = (three * np.uint32(MULTIPLIER)) ^ ((before[3] | before[4] << np.uint32(8)) * np.uint32(0x85EBCA6B))
    # the word so far: a polynomial hash of its bytes, by prefix sums
    sums = np.cumsum((data.astype(np.uint32) + np.uint32(1)) * up, dtype=np.uint32)
    ahead = np.concatenate((np.zeros(1, np.uint32), sums[:-1]))
    blank = (data == 0x20) | (data == 0x0A)
    starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(blank) + 1))
    sizes = np.diff(starts, append=n)  # bytes of each word, its blank included
    first = np.minimum(starts, n - 1)
    word = (ahead - np.repeat(ahead[first], sizes)) * np.repeat(down[first], sizes)
    ended = word[starts[1:] - 1] if len(starts) > 1 else np.empty(0, np.uint32)
    previous = np.repeat(np.concatenate((np.zeros(1, np.uint32), ended)), sizes)
    pair = word * np.uint32(0xC2B2AE35) ^ previous * np.uint32(0x27D4EB2F) ^ np.uint32(0x165667B1)
    out = []
    for k, (h, bits) in enumerate(zip((three, five, word, pair), table_bits, strict=True)):
        h = h + np.uint32(k + 1)
        h *= np.uint32(MULTIPLIER)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h &= np.uint32((1 << bits) - 1)
        out.append(h.astype(np.int64))
    return out


def picked(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``values[places]`` for places that are all valid; numpy is several times faster where it need not raise."""
    return values.take(places, out=np.empty(len(places), values.dtype), mode="clip")


@dataclass
class Decisions:
    """Decisions of a group of units: slots by predictor, bits, and where each unit's begin."""

    slots: list[np.ndarray]
    bits: np.ndarray
    begins: np.ndarray


def decisions(units: list[tuple[bytes, bytes]], code: Code, table_bits: tuple[int, ...]) -> Decisions:
    data = np.frombuffer(b"".join(lead + own for lead, own in units), np.uint8)
    leads = np.array([len(lead) for lead, _ in units])
    sizes = np.array([len(own) for _, own in units])
    bases = contexts(data, table_bits)
    counted = np.repeat(np.tile([False, True], len(units)), np.column_stack((leads, sizes)).ravel())
    where = np.flatnonzero(counted)
    own = picked(data, where)
    lengths = picked(code.lengths, own)
    ends = np.cumsum(lengths)
    byte = np.repeat(where, lengths)  # the byte of each decision
    before = np.zeros(len(data), np.int64)
    before[where] = picked(code.offsets, own) - ends + lengths
    places = picked(before, byte)
    places += np.arange(ends[-1])
    nodes = picked(code.nodes, places)
    slots = []
    for base in bases:
        slot = picked(base, byte)
        slot += nodes
        slots.append(slot)
    last = np.cumsum(sizes) - 1
    return Decisions(slots, picked(code.bits, places), np.concatenate(([0], ends[last])))


def groups_of(units: Iterator[tuple[int, bytes, bytes]], most: int) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]]]]:
    """Units in groups of about ``most`` bytes, with the text that each belongs to."""
    owners, held, size = [], [], 0
    for owner, lead, own in units:
        owners.append(owner)
        held.append((lead, own))
        size += len(lead) + len(own)
        if size >= most:
            yield owners, held
            owners, held, size = [], [], 0
    if held:
        yield owners, held


def groups_of_texts(texts: list[str], most: int = GROUP) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]]]]:
    return groups_of(((i, lead, own) for i, text in enumerate(texts) for lead, own in units_of(words_of(text))), most)


# ---- mixing


def odds_of(found: Decisions, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each predictor, float32 by predictor and decision, and the gate of each decision."""
    n = len(found.bits)
    odds, gates = np.empty((PREDICTORS, n), np.float32), np.zeros(n, np.uint8)
    for p, (table, slot) in enumerate(zip(tables, found.slots, strict=True)):
        steps = picked(table, slot)
        np.multiply(steps, np.float32(UNIT), out=odds[p])
        if p in GATE:
            gates *= np.uint8(1 + len(STEPS))
            np.abs(steps, out=steps)
            for step in STEPS:
                gates += steps >= step
    return odds, gates.astype(np.int64)


def certain(z: np.ndarray) -> np.ndarray:
    np.minimum(z, 13, out=z)
    np.maximum(z, -13, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.divide(1, z, out=z)


def mixed(found: Decisions, tables: list[np.ndarray], weights: np.ndarray, settings: Settings) -> list[float]:
    """Natural logarithm of the probability of each unit. ``weights``: by gate and predictor."""
    odds, gates = odds_of(found, tables)
    fixed = np.zeros(len(gates), np.float32)
    for p, own in enumerate(weights.T.astype(np.float32).copy()):
        part = picked(own, gates)
        part *= odds[p]
        fixed += part
    bits = found.bits.astype(np.float32)
    errors = np.empty(len(bits), np.float32)
    blocks = []  # unit, and its decisions from the first to the last
    for unit, (start, end) in enumerate(zip(found.begins[:-1].tolist(), found.begins[1:].tolist(), strict=True)):
        size, at = settings.first_block, start
        own = np.zeros(PREDICTORS, np.float32)
        while at < end:
            stop = min(at + size, end)
            block = odds[:, at:stop]
            p = certain(fixed[at:stop] + own @ block if at > start else fixed[at:stop].copy())
            error = np.subtract(bits[at:stop], p, out=errors[at:stop])
            blocks.append((unit, at, stop))
            if stop < end:
                own += (block @ error) / np.float32(settings.inertia + stop - start)
            at, size = stop, 2 * size
    np.abs(errors, out=errors)
    logs = np.log(np.subtract(1, errors, out=errors), out=errors)
    out = [0.0] * (len(found.begins) - 1)
    for unit, at, stop in blocks:
        out[unit] += float(logs[at:stop].sum(dtype=np.float64))
    return out


class Weights:
    """Weights by gate, learnt online by Newton steps on all curvature so far: first what all gates share, then what each differs by."""

    def __init__(self):
        self.shared = np.full(PREDICTORS, FIRST_WEIGHT)
        self.own = np.zeros((GATES, PREDICTORS))
        self.shared_curvature = np.eye(PREDICTORS) * 100.0
        self.curvature = np.tile(np.eye(PREDICTORS) * 300.0, (GATES, 1, 1))
        self.seen = 0

    @property
    def weights(self) -> np.ndarray:
        return self.shared + self.own

    def learn(self, found: Decisions, tables: list[np.ndarray]) -> None:
        odds, gates = odds_of(found, tables)
        odds, bits = odds.astype(np.float64), found.bits.astype(np.float64)
        p = certain((self.weights[gates].T * odds).sum(axis=0))
        self.shared_curvature += (odds * (p * (1 - p))) @ odds.T
        self.shared += np.linalg.solve(self.shared_curvature, odds @ (bits - p))
        order = np.argsort(gates, kind="stable")
        odds, bits = odds[:, order], bits[order]
        ends = np.cumsum(np.bincount(gates, minlength=GATES))
        for gate, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if end > start:
                own = odds[:, start:end]
                p = certain((self.shared + self.own[gate]) @ own)
                self.curvature[gate] += (own * (p * (1 - p))) @ own.T
                self.own[gate] += np.linalg.solve(self.curvature[gate], own @ (bits[start:end] - p))
        self.seen += len(bits)


# ---- counts of slots


class SlotCounts:
    """Counts of both outcomes by predictor and slot."""

    def __init__(self, table_bits: tuple[int, ...]):
        self.counts = [np.zeros((2 << bits) + 2 * NODES, np.uint32) for bits in table_bits]

    def add(self, found: Decisions) -> None:
        # both counts of a slot as one number, that of the bit 1 in its upper half
        ones = found.bits.astype("<u8")
        ones *= (1 << 32) - 1
        ones += 1
        for own, slot in zip(self.counts, found.slots, strict=True):
            np.add.at(own.view("<u8"), slot, ones)

    def rows(self, part: int) -> Iterator[dict]:
        for p, own in enumerate(self.counts):
            for block, start in enumerate(range(0, len(own), 2 * BLOCK_SLOTS)):
                yield {"predictor": p, "block": block, "part": part, "counts": packed(own[start:start + 2 * BLOCK_SLOTS])}


def packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)


def odds_bytes(counts: np.ndarray, start: float) -> np.ndarray:
    """Log odds of the bit 1 by slot in bytes; zero where nothing has been seen."""
    none, one = counts[0::2].astype(np.float32), counts[1::2].astype(np.float32)
    seen = none + one > 0
    odds = np.rint(np.log((one + np.float32(start)) / (none + np.float32(start))) / np.float32(UNIT))
    odds[seen & (odds == 0)] = 1
    return np.clip(odds, -127, 127).astype(np.int8)


COUNT_ROWS = "predictor int, block int, part int, counts binary"


def summed(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` of slot counts of ``parts`` tasks added up, a bounded number of tables in a group at each level."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for data in table.column("counts"):
            own = unpacked(data.as_py())
            total = own.copy() if total is None else np.add(total, own, out=total)
        first = table.slice(0, 1).to_pylist()[0]
        return pa.table({"predictor": pa.array([first["predictor"]], pa.int32()), "block": pa.array([first["block"]], pa.int32()),
                         "part": pa.array([first["part"] // FAN_IN], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})

    while True:
        rows = rows.groupBy("predictor", "block", F.floor(F.col("part") / FAN_IN).alias("_group")).applyInArrow(add, COUNT_ROWS)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return rows


def tables_of(counts: DataFrame, table_bits: tuple[int, ...]):
    """The summed counts as a broadcast array of bytes: of fixed size, one for each slot."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([row | {"counts": odds_bytes(unpacked(row["counts"]), START[row["predictor"]]).tobytes()}], batch.schema)

    tables = [np.zeros((1 << bits) + NODES, np.int8) for bits in table_bits]
    for row in counts.mapInArrow(run, COUNT_ROWS).collect():
        start = row["block"] * BLOCK_SLOTS
        own = np.frombuffer(row["counts"], np.int8)
        tables[row["predictor"]][start:start + len(own)] = own
    return counts.sparkSession.sparkContext.broadcast(tables)


# ---- counts of tokens


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


END_HASH = xxhash.xxh64_intdigest(END)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its hashes) of every bucket that has any."""
    own = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(own, kind="stable")
    own = own[order]
    cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(own[a]), order[a:b]


def token_counts(training: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, counts, types, total): one row per bucket with its distinct token hashes, ascending, and their counts."""

    def count(batches):
        for whole in batches:
            for batch in chunks(whole, "doc_text", CHUNK):
                texts = [words_of(t or "") for t in batch.column(0).to_pylist()]
                found, n = np.unique(np.concatenate([hashes_of(w) for w in texts] + [np.full(len(texts), END_HASH, np.uint64)]), return_counts=True)
                rows = [(b, found[at].tobytes(), n[at].astype(np.int64).tobytes()) for b, at in by_bucket(found, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["bucket", "hashes", "counts"])

    def add(table: pa.Table) -> pa.Table:
        hashes, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("counts", np.int64)))
        found, at = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, counts)
        return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "hashes": pa.array([found.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary()),
                         "types": pa.array([len(found)]), "total": pa.array([int(total.sum())])})

    rows = "bucket int, hashes binary, counts binary"
    return training.select("doc_text").mapInArrow(count, rows).groupBy("bucket").applyInArrow(add, f"{rows}, types long, total long")


def histogram_of(training: DataFrame) -> np.ndarray:
    """How often each byte is in the sequences of the training texts."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for whole in batches:
            for batch in chunks(whole, "doc_text", CHUNK):
                texts = batch.column(0).to_pylist()
                total += np.bincount(np.frombuffer("".join(t or "" for t in texts).encode("utf-8").lower(), np.uint8), minlength=256)
                total[0x0A] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["byte", "n"])
        release()

    out = np.zeros(256, np.int64)
    for row in training.select("doc_text").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[row.byte] = row.n
    out[0x20] += out[[0x09, 0x0B, 0x0C, 0x0D]].sum()
    return out


# ---- the operator


def counted(texts: DataFrame, code: Code, settings: Settings, parts: int) -> DataFrame:
    """Slot counts of ``texts``, added up."""

    def run(batches):
        own = SlotCounts(settings.table_bits)
        for whole in batches:
            for batch in chunks(whole, "doc_text", CHUNK):
                for _, units in groups_of_texts([t or "" for t in batch.column(0).to_pylist()], FAST_GROUP):
                    own.add(decisions(units, code, settings.table_bits))
        for row in own.rows(TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pylist([row], pa.schema([("predictor", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())]))
        del own, row
        release()

    return summed(texts.select("doc_text").coalesce(parts).mapInArrow(run, COUNT_ROWS), parts)


def learnt(texts: DataFrame, code: Code, tables, settings: Settings) -> np.ndarray:
    """Weights by gate and predictor: learnt online in each task, averaged by the decisions that each saw."""

    def run(batches):
        own = Weights()
        for whole in batches:
            for batch in chunks(whole, "doc_text", CHUNK):
                for _, units in groups_of_texts([t or "" for t in batch.column(0).to_pylist()]):
                    own.learn(decisions(units, code, settings.table_bits), tables.value)
        place = np.arange(GATES * PREDICTORS, dtype=np.int32)
        seen = np.full(len(place), float(own.seen))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(own.weights.ravel() * seen), pa.array(seen)], ["place", "w", "seen"])
        release()

    out = np.full(GATES * PREDICTORS, FIRST_WEIGHT)
    sums = texts.select("doc_text").mapInArrow(run, "place int, w double, seen double").groupBy("place").agg(F.sum("w").alias("w"), F.sum("seen").alias("seen"))
    for row in sums.collect():
        if row.seen:
            out[row.place] = row.w / row.seen
    return out.reshape(GATES, PREDICTORS)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return summed(a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1))), 2)


DOC = "held_out: boolean, n_tokens: bigint, n_bytes: bigint, score: double"


def scored(table: DataFrame, key: str, buckets: int, code: Code, tables, weights: np.ndarray, settings: Settings) -> DataFrame:
    """For each part of a task's texts: a row with what the mixed model says of them, and a row per bucket with their distinct tokens."""
    kind = table.schema[key].dataType.simpleString()
    ddl = f"bucket int, chunk long, docs array<struct<doc_key: {kind}, {DOC}>>, owners binary, hashes binary, times binary"
    table = table.select("doc_text", F.col(key).alias("doc_key"), "held_out")

    def run(batches):
        chunk = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in chunks(whole, "doc_text", CHUNK):
                texts = [words_of(t or "") for t in batch.column(0).to_pylist()]
                logs, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for owners, units in groups_of(((i, lead, own) for i, words in enumerate(texts) for lead, own in units_of(words)), FAST_GROUP):
                    found = mixed(decisions(units, code, settings.table_bits), tables.value, weights, settings)
                    for i, (_, own), log in zip(owners, units, found, strict=True):
                        logs[i] += log
                        sizes[i] += len(own)
                tokens = [np.unique(np.append(hashes_of(w), np.uint64(END_HASH)), return_counts=True) for w in texts]
                hashes = np.concatenate([h for h, _ in tokens])
                times = np.concatenate([n for _, n in tokens]).astype(np.uint32)
                owners = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(h) for h, _ in tokens])
                docs = pa.StructArray.from_arrays(
                    [batch.column(1), batch.column(2), pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(sizes), pa.array(logs / math.log(10))],
                    ["doc_key", "held_out", "n_tokens", "n_bytes", "score"])
                asked = list(by_bucket(hashes, buckets))
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk % buckets, *(b for b, _ in asked)], pa.int32()), pa.array([chunk] * (1 + len(asked)), pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, *[len(texts)] * (1 + len(asked))], pa.int32()), docs, mask=pa.array([False, *[True] * len(asked)])),
                    *(pa.array([None, *(x[at].tobytes() for _, at in asked)], pa.binary()) for x in (owners, hashes, times))], ["bucket", "chunk", "docs", "owners", "hashes", "times"])
                chunk += 1
        release()

    return table.mapInArrow(run, ddl)


def met_tokens(found: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """``found`` with the tokens of each row replaced by their sums: log10(count + 1) and known tokens by text."""
    docs = found.schema["docs"].dataType.simpleString()

    def meet(asked: pa.Table, known: pa.Table) -> pa.Table:
        hashes, counts = (np.frombuffer(known.column(c)[0].as_py() if len(known) else b"", kind) for c, kind in (("hashes", np.uint64), ("counts", np.int64)))
        made: list[list] = [[], [], []]
        for row in zip(*(asked.column(c).to_pylist() for c in ("owners", "hashes", "times")), strict=True):
            if row[0] is None:
                for out in made:
                    out.append(None)
                continue
            owners, wanted, times = (np.frombuffer(x, kind) for x, kind in zip(row, (np.uint32, np.uint64, np.uint32), strict=True))
            own = np.zeros(len(wanted), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                own = np.where(hashes[at] == wanted, counts[at], 0)
            texts, place = np.unique(owners, return_inverse=True)
            made[0].append(texts.tobytes())
            made[1].append(np.bincount(place, times * np.log10(own + 1.0)).tobytes())
            made[2].append(np.bincount(place, times * (own > 0)).astype(np.int64).tobytes())
        return pa.table([asked.column("chunk"), asked.column("docs"), *(pa.array(x, pa.binary()) for x in made)], ["chunk", "docs", "owners", "logs", "known"])

    return found.groupBy("bucket").cogroup(tokens.groupBy("bucket")).applyInArrow(meet, f"chunk long, docs {docs}, owners binary, logs binary, known binary")


def with_base(met: DataFrame, key: str, total: int, types: int) -> DataFrame:
    """A row per text, the sums of its buckets added up."""
    doc = met.schema["docs"].dataType.elementType
    kind = doc["doc_key"].dataType.simpleString()
    below = math.log10(total + types + 1)

    def finish(part: pa.Table) -> pa.Table:
        docs = part.filter(pc.is_valid(part.column("docs"))).column("docs").combine_chunks().flatten()
        keys, held, n_tokens, n_bytes, scores = docs.flatten()
        tokens = n_tokens.to_numpy()
        logs, known = np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
        for texts, log, n in zip(*(part.column(c).to_pylist() for c in ("owners", "logs", "known")), strict=True):
            if texts is not None:
                at = np.frombuffer(texts, np.uint32)
                logs[at] += np.frombuffer(log, np.float64)
                known[at] += np.frombuffer(n, np.int64)
        return pa.table([keys, held, n_tokens, pa.array(known), pa.array(np.full(len(tokens), total)), pa.array(logs - tokens * below), scores, n_bytes],
                        [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    ddl = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return met.groupBy("chunk").applyInArrow(finish, ddl).withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """A row per row of ``docs``: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Scores are log10 probabilities of the token sequence: base_score of the counts with add-one smoothing (the unseen as one type more),
    score of the mixed model. ``held_out`` (crc32 of the key as text modulo 7 is 2, unless given; null counts as held out) marks texts that nothing
    is learnt from. n_known counts tokens that the training texts have; n_bytes the bytes of the sequence. A null or empty text is the end alone. Repeated
    rows are learnt from and scored like any other; with no training texts every token is unseen and the predictors are
    silent. An empty table gives none. Other columns are not read. Texts of any length are in work a segment at a time.
    """
    out = F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2 if held_out is None else held_out
    share = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(settings.calibration))
    table = docs.select(docs[text].alias("doc_text"), docs[key].alias(key)).withColumns({"held_out": F.coalesce(out, F.lit(True)), "first": share == 0})
    training = table.where("not held_out")
    inputs = table.rdd.getNumPartitions()
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), inputs)

    tokens = durable(token_counts(training, buckets))
    totals = tokens.agg(F.sum("types").alias("types"), F.sum("total").alias("total")).first()
    histogram = histogram_of(training)
    code = huffman(histogram)
    parts = max(1, min(inputs, max(spark.sparkContext.defaultParallelism, -(-int(histogram.sum()) // settings.bytes_per_table))))
    most = durable(counted(training.where("not first"), code, settings, parts))
    sent = tables_of(most, settings.table_bits)
    weights = learnt(training.where("first"), code, sent, settings)
    sent.destroy()
    tables = tables_of(merged(most, counted(training.where("first"), code, settings, parts)), settings.table_bits)
    found = scored(table, key, buckets, code, tables, weights, settings)
    met = met_tokens(found, tokens, key)
    return with_base(met, key, totals.total or 0, totals.types or 0)
