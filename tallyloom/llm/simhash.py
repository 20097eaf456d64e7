"""Near duplicates by SimHash fingerprints and tiled exact comparison.

A fingerprint bit is the majority of that bit over the hashes of all word shingles. Distinct fingerprints are dealt to tiles by
the bit counts of their two halves; two tiles are compared only where those counts can be within the radius, by numpy's
exclusive-or and bit count, and split further by the counts of quarters and bytes while they are large. Every comparison
yields a spanning forest of its links, never all pairs of a group, and alternating star steps join the forests to components.

``keep_one`` is for a stated similarity of the sets of shingles: fingerprints of 256 bits, tiles by the sizes of the sets, and an
exact check of what lies within the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import add_columns, chunks, release, texts_of
from tallyloom.session import durable

SEED = 42
#: width of a tile in bits counted of each half, and fingerprints in a block of a tile
TILE_BITS, BLOCK = 4, 65_536
#: comparisons of one numpy step
LEAF = 1 << 18
#: words of a wide fingerprint, and shingles that one exact comparison holds
WORDS, HELD = 4, 2_000_000
#: radius of wide fingerprints, and that of sets of fewer shingles than ``FEW``, whose majorities differ more
WIDE_RADIUS, FEW_RADIUS, FEW = 68, 80, 6


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the text, A-Z lower-cased; of the whole sequence where it has fewer words; none without words."""
    words = text.encode("utf-8").lower().split()  # ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined = b" ".join(words)
    last = ends[min(shingle, len(words)) - 1:]
    hashed = map(partial(xxhash.xxh64_intdigest, seed=SEED), [joined[a:b] for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)])
    return np.fromiter(hashed, "<u8", n)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit set in over half of the hashes; signed, as a column holds it."""
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = n - n % 255  # bytes can hold the sums of 255 rows
    counts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the signed 64-bit fingerprint of the text; zero without words, as for a null text."""

    def run(batch: pa.RecordBatch) -> list[list]:
        return [[fingerprint(shingle_hashes(t, shingle)) for t in texts_of(batch, text)]]

    return add_columns(docs, "fp long", run)


def counts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Set bits of each of the equal ``parts`` of every value, side by side."""
    per_byte = np.bitwise_count(values.view(np.uint8).reshape(-1, 8))
    return per_byte.reshape(len(values), parts, 8 // parts).sum(axis=2, dtype=np.int16)


def compared(a: np.ndarray, b: np.ndarray, radius: int, parts: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (values of a, values of b, whether they are within the radius) for tiles whose bit counts allow a link."""
    if len(a) * len(b) <= LEAF or parts > 8:
        step = max(1, LEAF // max(1, len(b)))
        for start in range(0, len(a), step):
            near = np.bitwise_count(a[start:start + step, None] ^ b[None, :]) <= radius
            if a is b:
                own = np.arange(len(near))
                near[own, start + own] = False
            if near.any():
                yield a[start:start + step], b, near
        return
    keys_a, own_a = np.unique(counts_of(a, parts), axis=0, return_inverse=True)
    keys_b, own_b = (keys_a, own_a) if a is b else np.unique(counts_of(b, parts), axis=0, return_inverse=True)
    tiles_a = np.split(a[np.argsort(own_a, kind="stable")], np.cumsum(np.bincount(own_a))[:-1])
    tiles_b = tiles_a if a is b else np.split(b[np.argsort(own_b, kind="stable")], np.cumsum(np.bincount(own_b))[:-1])
    for i, tile in enumerate(tiles_a):
        for j in np.flatnonzero(np.abs(keys_b - keys_a[i]).sum(axis=1) <= radius):
            if a is not b or j >= i:
                yield from compared(tile, tiles_b[j], radius, 2 * parts)


def forest_of_tile(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, value) with the components of one comparison, at most one for each value."""
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(rows, columns)]
    of_row, n = np.arange(len(rows)), len(rows)
    while True:
        of_column = np.where(near, of_row[:, None], n).min(axis=0)
        new = np.where(near, of_column[None, :], n).min(axis=1)
        if (new == of_row).all():
            break
        of_row = new
    values = np.concatenate((a[rows], b[columns]))
    roots = a[rows][np.concatenate((of_row, of_column))]
    return values[values != roots], roots[values != roots]


def forest_of_blocks(a: np.ndarray, b: np.ndarray, radius: int) -> pd.DataFrame:
    """A spanning forest of the links between two blocks (or within one)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for one, other, near in compared(a, b, radius):
        for u, v in zip(*(x.tolist() for x in forest_of_tile(one, other, near)), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    return pd.DataFrame({"u": np.array([x for x, _ in pairs], np.uint64).view(np.int64), "v": np.array([r for _, r in pairs], np.uint64).view(np.int64)})


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that span the same components as all pairs within ``radius``.

    Blocks have a bounded number of fingerprints, so tasks stay bounded however many share a tile; the table of tiles has a
    fixed number of rows (the square of 32 / TILE_BITS + 1).
    """
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    tiled = prints.select("fp", (high / TILE_BITS).cast("int").alias("x"), (low / TILE_BITS).cast("int").alias("y"))
    sizes = tiled.groupBy("x", "y").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = (tiled.join(F.broadcast(sizes), ["x", "y"])
              .groupBy("x", "y", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("k"))
              .agg(F.collect_list("fp").alias("fps")))
    blocks = blocks.select("x", "y", "k", "fps")
    reach = -(-radius // TILE_BITS)
    steps = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    ends = sizes.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "blocks")
    here = F.struct("x", "y", "k")
    # each block goes to the comparisons with itself and with every block of the tiles in reach, named by the smaller block first
    sent = (blocks.select("x", "y", "k", "fps", F.explode(steps).alias("step"))
            .withColumns({"x2": F.col("x") + F.col("step.x"), "y2": F.col("y") + F.col("step.y")})
            .join(F.broadcast(ends), ["x2", "y2"])
            .withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("there", F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("k2").alias("k")))
            .select(F.least(here, "there").alias("first"), F.greatest(here, "there").alias("second"), "fps"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        both = [np.asarray(x, np.int64).view(np.uint64) for x in part["fps"]]
        return forest_of_blocks(both[0], both[-1], radius)

    return sent.groupBy("first", "second").applyInPandas(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that it reaches.

    Alternating large-star and small-star steps; every round is cut by a checkpoint and has only grouped minima and equality joins.
    """
    edges = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u")
        small = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", "least")).distinct()
        edges = durable(small)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """A row per row of ``docs``: ``key``, fp, fingerprint (16 hex digits), component_id (the smallest key reachable).

    Texts without words (nulls too) have fingerprint zero and are linked like any other. A row without a key takes part and gets
    its group's component_id, which is null if no row of the group has a key. Repeated rows are linked by distance zero. An
    empty table gives none. Other columns are not read.
    """
    prints = durable(fingerprints(docs.select(docs[key].alias("doc_key"), docs[text].alias("doc_text")), "doc_text", shingle).select("doc_key", "fp"))
    distinct = prints.groupBy("fp").agg(F.min("doc_key").alias("least"))
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return prints.join(named, "fp").select(
        F.col("doc_key").alias(key), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


# ---- similar sets of shingles, by wide fingerprints and an exact check


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """256 bits in four signed words; each is set where over half of the distinct ``hashes``, mixed anew for each word, have it."""
    if not len(hashes):
        return [0] * WORDS
    mixed = np.empty((len(hashes), WORDS), "<u8")
    for w in range(WORDS):
        z = hashes + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed[:, w] = z ^ (z >> np.uint64(31))
    counts = np.zeros(64 * WORDS, np.int64)
    for start in range(0, len(hashes), 255):  # bytes can hold the sums of 255 rows
        counts += np.unpackbits(mixed[start:start + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8").tolist()


def set_name(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


WIDE = "doc_key {key}, sid long, n int, p0 long, p1 long, p2 long, p3 long"


def wide_prints(keyed: DataFrame, shingle: int) -> DataFrame:
    """``doc_key``, sid (a hash of the set of shingles), n (its size) and the wide fingerprint of every row of (doc_key, doc_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "doc_text"):
                rows = []
                for text in texts_of(batch, "doc_text"):
                    own = np.unique(shingle_hashes(text, shingle))
                    rows.append((set_name(own), len(own), *wide_fingerprint(own)))
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * WORDS)
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_key", "sid", "n", "p0", "p1", "p2", "p3"])
                del rows
            del whole, batch
            release()

    return keyed.mapInArrow(run, WIDE.format(key=keyed.schema["doc_key"].dataType.simpleString()))


def sets_of(keyed: DataFrame, shingle: int) -> DataFrame:
    """``sid`` and ``shingles``, the sorted distinct hashes as bytes, of every row of (doc_key, doc_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "doc_text"):
                own = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(batch, "doc_text")]
                yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["sid", "shingles"])
                del own
            del whole, batch
            release()

    return keyed.mapInArrow(run, "sid long, shingles binary")


def near_rows(n: np.ndarray, prints: np.ndarray, radius: int, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (rows, later rows, differing bits) of pairs within the radius whose sizes allow the similarity; rows ascend by ``n``."""
    ends = np.searchsorted(n, n * least[1] // least[0], side="right")
    reach = np.where(n < FEW, max(radius, FEW_RADIUS), radius).astype(np.uint16)
    start = 0
    while start < len(n):
        # as many rows as one numpy step holds with all rows that they may be near to
        stop = min(len(n), start + max(1, LEAF // max(1, int(ends[start]) - start)))
        last = int(ends[stop - 1])
        bits = np.zeros((stop - start, last - start), np.uint16)
        for w in range(WORDS):
            bits += np.bitwise_count(prints[start:stop, None, w] ^ prints[None, start:last, w])
        i, j = np.nonzero(bits <= reach[start:stop, None])
        later = (j > i) & (j + start < ends[i + start])
        if later.any():
            i, j = i[later], j[later]
            yield i + start, j + start, bits[i, j]
        start = stop


def prints_of(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(f"p{w}").to_numpy() for w in range(WORDS)], axis=1).view(np.uint64)


def similar_links(sets: DataFrame, keyed: DataFrame, shingle: int, least: tuple[int, int], radius: int) -> DataFrame:
    """Links (u, v) of sets that span the same groups as all pairs with a Jaccard similarity of ``least`` or more.

    ``sets(sid, n, p0 .. p3, key)`` are distinct sets, ``key`` names a row of ``keyed`` that has this text. Sets are dealt to tiles by their size (a
    step is the ratio that ``least`` allows, so only neighbouring tiles are compared), tiles to blocks. The first comparison finds
    which sets have a neighbour within the radius at all; only their shingles are made again and sent to the comparisons where
    they have one. There the nearest pairs are checked first, exactly, and pairs already in one group not at all.
    """
    step = math.log(least[1] / least[0]) * 1.0001  # a little wider, so that rounding moves no pair two tiles apart
    smallest = -(-least[0] // (least[1] - least[0]))  # smaller sets are similar to equal ones only
    tiled = sets.where(F.col("n") >= smallest).withColumn("x", F.floor(F.log(F.col("n")) / step).cast("int"))
    sizes = tiled.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = tiled.join(F.broadcast(sizes), "x").withColumn("k", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    ends = F.broadcast(sizes.select(F.col("x").alias("x2"), F.col("blocks").alias("blocks2")))
    here, there = F.struct("x", "k"), F.struct(F.col("x2").alias("x"), F.col("k2").alias("k"))
    asked = (dealt.select("sid", "n", "p0", "p1", "p2", "p3", "x", "k", F.explode(F.array(F.col("x") - 1, "x", F.col("x") + 1)).alias("x2")).join(ends, "x2")
             .withColumn("k2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
             .select("sid", "n", "p0", "p1", "p2", "p3", F.least(here, there).alias("first"), F.greatest(here, there).alias("second")))

    def partners(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        n, prints = table.column("n").to_numpy()[order].astype(np.int64), prints_of(table)[order]
        met = np.zeros(len(n), bool)
        for i, j, _ in near_rows(n, prints, radius, least):
            met[i] = met[j] = True
        found = table.take(pa.array(order[met]))
        release()
        return found

    names = ["sid", "n", "p0", "p1", "p2", "p3", "first", "second"]
    ddl = "sid long, n int, p0 long, p1 long, p2 long, p3 long, first struct<x:int,k:int>, second struct<x:int,k:int>"
    taking = durable(asked.groupBy("first", "second").applyInArrow(partners, ddl).select(*names))
    # the shingles of one comparison have a bounded size: a larger one is cut into parts that meet pairwise
    parts = taking.groupBy("first", "second").agg(F.ceil(F.sum(F.col("n").cast("long")) / HELD).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "sid"), F.col("parts")).cast("int")
    split = (taking.join(parts, ["first", "second"]).withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("own", "other", "parts"))
    # texts are read again for the sets that take part, by the key of one of their rows
    needed = taking.select("sid").distinct().join(sets.select("sid", "key"), "sid")
    texts = keyed.join(needed.select("key").distinct(), keyed["doc_key"].eqNullSafe(F.col("key")), "left_semi")
    shingles = durable(sets_of(texts, shingle).join(needed.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))

    def check(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("n").to_numpy(), kind="stable")))
        sid, n, prints = table.column("sid").to_numpy(), table.column("n").to_numpy().astype(np.int64), prints_of(table)
        held = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        root = np.arange(len(sid))
        for i, j, bits in near_rows(n, prints, radius, least):
            apart = np.flatnonzero(root[i] != root[j])
            for a, b in zip(*(x[apart[np.argsort(bits[apart], kind="stable")]].tolist() for x in (i, j)), strict=True):
                if root[a] != root[b] and similar(held[a], held[b], least):
                    low, high = sorted((root[a], root[b]), key=sid.__getitem__)
                    root[root == high] = low
        # a star per group round its smallest set: as few links as a forest, and no long chains
        own = np.flatnonzero(root != np.arange(len(sid)))
        found = pa.table([pa.array(sid[own]), pa.array(sid[root[own]])], ["u", "v"])
        del table, held
        release()
        return found

    return split.join(shingles, "sid").groupBy("first", "second", "low", "high").applyInArrow(check, "u long, v long")


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    shared = int(np.count_nonzero(a[at] == b))
    return shared * least[1] >= (len(a) + len(b) - shared) * least[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: tuple[int, int] = (4, 5), radius: int = WIDE_RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest key, or any one if no row has a key; columns and values as they are.

    A group is what links of a Jaccard similarity of ``least`` (a fraction) or more, over sets of ``shingle`` words, join. A text of fewer words
    has one shingle, its whole sequence; texts without words (nulls too) are one group. Every link is checked exactly; candidates are
    the pairs of wide fingerprints within ``radius`` bits. Two sets of similarity 0.8 differ in 39 of 256 bits on average, deviation 6, so
    at 68 about one pair in a million of just that similarity may be missed (sets of under 6 shingles: 48 on average, radius 80). Rows repeated in key and text are one group, rows of one key
    with different texts are told apart by their sets; an empty table gives none. Very long texts are hashed whole, part by part of a batch.
    """
    keyed = docs.select(docs[key].alias("doc_key"), docs[text].alias("doc_text"))
    prints = durable(wide_prints(keyed, shingle))
    sets = prints.groupBy("sid", "n", "p0", "p1", "p2", "p3").agg(F.min("doc_key").alias("key"))
    found = components(similar_links(sets, keyed, shingle, least, radius))
    rooted = prints.select("doc_key", "sid").join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    kept = durable(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_key").isNull().alias("none"), "doc_key", "sid")).alias("least"))
                   .select(F.col("least.doc_key").alias("kept_key"), F.col("least.sid").alias("kept_sid")))
    repeated = prints.select("doc_key").join(kept, F.col("doc_key").eqNullSafe(F.col("kept_key")), "left_semi").groupBy("doc_key").count().where("count > 1 or doc_key is null")
    if repeated.isEmpty():
        return docs.join(kept, docs[key] == kept["kept_key"], "left_semi")
    # the key alone does not name the row
    sid = free_name(docs, "_sid")

    def name(batch: pa.RecordBatch) -> list[list]:
        return [[set_name(np.unique(shingle_hashes(t, shingle))) for t in texts_of(batch, text)]]

    named = add_columns(docs, f"`{sid}` long", name)
    rows = named.join(kept, named[key].eqNullSafe(kept["kept_key"]) & (named[sid] == kept["kept_sid"]), "left_semi").dropDuplicates([key, sid])
    return rows.select(*[rows[f"`{c}`"] for c in docs.columns])
