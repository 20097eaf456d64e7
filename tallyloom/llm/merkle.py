"""Merkle manifest of a dataset with octopus multiproofs.

Every row is a leaf. Leaves of one part (a language, say) form a tree, the roots of these trees form the tree above.
Positions come from a range sort, and trees grow in tiers: a task holds one block of 8^4 neighbouring nodes and yields the four
levels over it, so no task ever holds a part and a tier needs one shuffle.

Proofs are made per block of leaves: the block names the least set of nodes that the paths of all its leaves need and that
its leaves do not give (``missing``), these are fetched in one join, interiors shared by its leaves are derived once, and each leaf's
own proof is read off there. The path over the part's root is the same for all its leaves and is made once per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.ordering import with_rank
from tallyloom.session import durable

#: children of a node, and levels of a tier; fixed by the format
FAN, TIER = 8, 4
BLOCK = FAN ** TIER
#: up to this level a node is asked for by few blocks; above, nodes are copied under as many salts as they have more descendants
COOL = 6
#: stands for the tree above the parts
ABOVE = -1
#: places of the fetched rows that carry the roots and the path above
SUBROOT, ROOT, PATH = -1, -2, -3


def field(column: Column) -> Column:
    """``-`` for a null, else the count of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes of every level of a tree over ``n`` leaves, the root last."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def height(n: Column) -> Column:
    """Levels over the leaves of a tree."""
    return F.size(F.filter(F.array(*[F.lit(FAN ** k).cast("long") for k in range(21)]), lambda x: x < n))


# ---- one block of a tree


def run_of(place: int, size: int) -> range:
    """The places of the children of a node's parent, in a level of ``size`` nodes."""
    first = place - place % FAN
    return range(first, min(first + FAN, size))


def missing(places: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that proofs of the leaves ``places`` need and that cannot be derived from them."""
    own = set(places)
    for level, nodes in enumerate(level_sizes(size)[:-1]):
        parents = set()
        for place in own:
            if place // FAN not in parents:
                parents.add(place // FAN)
                yield from ((level, k) for k in run_of(place, nodes) if k not in own)
        own = parents


def routes(leaves: dict[int, str], fetched: dict[tuple[int, int], str], size: int) -> dict[int, list[tuple[str, str]]]:
    """For every leaf and level what stands before and after the node of its path, with all interiors derived once."""
    own = leaves
    sides: list[dict[int, tuple[str, str]]] = []
    for level, nodes in enumerate(level_sizes(size)[:-1]):
        here: dict[int, tuple[str, str]] = {}
        parents: dict[int, str] = {}
        for place in own:
            if place // FAN in parents:
                continue
            run = run_of(place, nodes)
            digests = [own[k] if k in own else fetched[level, k] for k in run]
            parents[place // FAN] = joined(digests)
            for i, k in enumerate(run):
                if k in own:
                    here[k] = "".join(digests[:i]), "".join(digests[i + 1:])
        sides.append(here)
        own = parents
    return {leaf: [here[leaf // FAN ** level] for level, here in enumerate(sides)] for leaf in leaves}


def folded(leaf: str, route: list[tuple[str, str]]) -> str:
    """The root that a leaf leads to along ``route``."""
    for before, after in route:
        leaf = sha256((before + leaf + after).encode()).hexdigest()
    return leaf


# ---- trees


@dataclass(frozen=True)
class Manifest:
    """leaves: key, part, tree, place, size, leaf and presented; nodes: tree, level, place, digest of all interiors; parts: tree,
    part, size, subroot, root and path (the siblings over the subroot, bottom up). ``n_parts`` counts the parts."""

    leaves: DataFrame
    nodes: DataFrame
    parts: DataFrame
    n_parts: int
    key: str


NODE = "tree long, level int, place long, digest string"


def climb(nodes: DataFrame, base: int) -> DataFrame:
    """The next levels over the nodes (tree, place, digest, size) of level ``base``; size is the number of the tree's leaves."""

    def grow(table: pa.Table) -> pa.Table:
        places, digests = table.column("place").to_pylist(), table.column("digest").to_pylist()
        tree, size = table.column("tree")[0].as_py(), table.column("size")[0].as_py()
        level = [d for _, d in sorted(zip(places, digests, strict=True))]
        first, rows = min(places), []
        for above in range(base + 1, min(base + TIER, len(level_sizes(size)) - 1) + 1):
            first //= FAN
            level = [joined(level[i:i + FAN]) for i in range(0, len(level), FAN)]
            rows += [(tree, above, first + i, d) for i, d in enumerate(level)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)],
                        ["tree", "level", "place", "digest"])

    blocks = nodes.where("size > 1").select("tree", "place", "digest", "size", F.expr(f"place div {BLOCK}").alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(grow, NODE)


def forest(leaves: DataFrame, highest: int) -> DataFrame:
    """All interiors over ``leaves`` (tree, place, digest, size), none of whose trees has more than ``highest`` leaves."""
    sizes = leaves.select("tree", "size").distinct()
    nodes, current = None, leaves
    for base in range(0, max(1, len(level_sizes(highest)) - 1), TIER):
        tier = durable(climb(current, base))
        nodes = tier if nodes is None else nodes.union(tier)
        current = tier.where(F.col("level") == base + TIER).join(sizes, "tree").where(height(F.col("size")) > base + TIER)
    return nodes


def build(docs: DataFrame, columns: list[str], key: str = "doc_id", part: str = "lang", altered: dict[str, Column] | None = None) -> Manifest:
    """The manifest of all rows of ``docs`` over ``columns``.

    Leaves of a part ascend by ``key`` (nulls first; rows equal in key by their digests, so the manifest does not depend on
    the order of the input), parts by name (null first). ``presented`` is the leaf of the row with ``altered`` columns put in place, which
    ``prove`` checks against the proofs of the original. Nulls in any column are part of a leaf; an empty table has no
    parts. Other columns of ``docs`` are not read.
    """
    altered = altered or {}
    rows = docs.select(
        docs[key].alias("key"), docs[part].alias("part"), digest_of([docs[c] for c in columns]).alias("leaf"),
        (digest_of([altered.get(c, docs[c]) for c in columns]) if altered else F.lit(None).cast("string")).alias("presented"))
    rows = rows.withColumn("presented", F.coalesce("presented", "leaf"))
    ranked = with_rank(rows, ["key", "leaf", "presented"], ["part"], "rank")
    parts = durable(with_rank(ranked.groupBy("part").agg(F.count("*").alias("size")), ["part"], [], "tree").withColumn("tree", F.col("tree") - 1))
    n_parts, highest = parts.agg(F.count("*"), F.max("size")).first()
    named = parts.withColumnRenamed("part", "_part")
    leaves = ranked.join(named, F.col("part").eqNullSafe(F.col("_part"))).select("key", "part", "tree", (F.col("rank") - 1).alias("place"), "size", "leaf", "presented")
    if not n_parts:
        empty = docs.sparkSession.createDataFrame([], T.StructType.fromDDL(NODE))
        return Manifest(leaves, empty, parts.selectExpr("tree", "part", "size", "'' AS subroot", "'' AS root", "array('') AS path"), 0, key)
    nodes = forest(leaves.select("tree", "place", F.col("leaf").alias("digest"), "size"), highest)
    tops = nodes.join(parts, "tree").where(F.col("level") == height(F.col("size"))).select("tree", "digest")
    tops = durable(tops.union(leaves.where("size = 1").select("tree", "leaf")))
    over = tops.select(F.lit(ABOVE).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(n_parts).cast("long").alias("size"))
    nodes_over = forest(over, n_parts)
    root = nodes_over.where(F.col("level") == len(level_sizes(n_parts)) - 1).select("digest") if n_parts > 1 else tops.select("digest")
    known = over.select("tree", F.lit(0).alias("level"), "place", "digest").union(nodes_over)
    paths = paths_of(over, known).select(F.col("place").alias("tree"), "path")
    parts = durable(parts.join(tops.withColumnRenamed("digest", "subroot"), "tree").join(paths, "tree").withColumn("root", F.lit(root.first()["digest"])))
    return Manifest(leaves, nodes, parts, n_parts, key)


def asked_by_blocks(leaves: DataFrame) -> DataFrame:
    """(tree, block, level, place) of the nodes that each block of ``leaves`` (tree, place, size) misses."""

    def ask(table: pa.Table) -> pa.Table:
        tree, block, size = (table.column(c)[0].as_py() for c in ("tree", "block", "size"))
        rows = list(missing(table.column("place").to_pylist(), size))
        return pa.table([pa.array([tree] * len(rows), pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([a for a, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.int64())],
                        ["tree", "block", "level", "place"])

    blocks = leaves.select("tree", "place", "size", F.expr(f"place div {BLOCK}").alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(ask, "tree long, block long, level int, place long")


def fetched_by_blocks(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, block, level, place, digest): what each block misses. High nodes, which many blocks ask for, are spread by salts."""
    salts = F.pow(F.lit(float(FAN)), F.greatest(F.col("level") - COOL, F.lit(0))).cast("long")
    asked = asked_by_blocks(leaves).withColumn("salt", F.pmod(F.col("block"), salts))
    spread = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return asked.join(spread, ["tree", "level", "place", "salt"]).select("tree", "block", "level", "place", "digest")


def dictionary(table: pa.Table) -> dict[tuple[int, int], str]:
    return {(a, b): d for a, b, d in zip(*(table.column(c).to_pylist() for c in ("level", "place", "digest")), strict=True)}


def paths_of(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, place, path) of all ``leaves`` (tree, place, digest, size): the siblings level by level, left to right."""

    def expand(own: pa.Table, found: pa.Table) -> pa.Table:
        places = own.column("place").to_pylist()
        tree, size = own.column("tree")[0].as_py(), own.column("size")[0].as_py()
        ways = routes(dict(zip(places, own.column("digest").to_pylist(), strict=True)), dictionary(found), size)
        flat = ["".join(before + after for before, after in ways[p]) for p in places]
        paths = [[text[i:i + 64] for i in range(0, len(text), 64)] for text in flat]
        return pa.table([pa.array([tree] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(paths, pa.list_(pa.string()))], ["tree", "place", "path"])

    blocks = leaves.select("tree", "place", "digest", "size", F.expr(f"place div {BLOCK}").alias("block"))
    return blocks.groupBy("tree", "block").cogroup(fetched_by_blocks(leaves, nodes).groupBy("tree", "block")).applyInArrow(
        expand, "tree long, place long, path array<string>")


def prove(manifest: Manifest, wanted: Column | None = None, siblings: bool = False) -> DataFrame:
    """A row per leaf (of those where ``wanted`` holds on ``manifest.leaves``; all of them by default): the manifest's key,
    leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, ``siblings``.

    The proof is the list of all siblings on the way to the root, ``proof_sha256`` the digest of it joined. ``folded_root`` is what
    ``presented`` leads to with this proof, ``verified`` whether that is the root. A single row has an empty proof.
    """
    kind = manifest.leaves.schema["key"].dataType
    ddl = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = T.StructType([T.StructField(manifest.key, kind), *T.StructType.fromDDL(ddl + (", siblings array<string>" if siblings else ""))])
    if not manifest.n_parts:
        return manifest.leaves.sparkSession.createDataFrame([], schema)
    sizes_above = level_sizes(manifest.n_parts)

    def expand(own: pa.Table, found: pa.Table) -> pa.Table:
        if not len(own):
            return schema_table([])
        keys = own.column("key")
        places, leaves, presented = (own.column(c).to_pylist() for c in ("place", "leaf", "presented"))
        tree, size = own.column("tree")[0].as_py(), own.column("size")[0].as_py()
        known = dictionary(found)
        subroot, root = known[SUBROOT, 0], known[ROOT, 0]
        over, at = [], 0
        for level, nodes in enumerate(sizes_above[:-1]):
            run, place = run_of(tree // FAN ** level, nodes), tree // FAN ** level
            digests = [known[PATH, at + i] for i in range(len(run) - 1)]
            at += len(digests)
            over.append(("".join(digests[:place - run[0]]), "".join(digests[place - run[0]:])))
        ways = routes(dict(zip(places, leaves, strict=True)), known, size)
        rows = []
        for place, shown in zip(places, presented, strict=True):
            route = ways[place] + over
            proof = "".join([part for side in route for part in side])
            end = folded(shown, route)
            rows.append((subroot, root, sha256(proof.encode()).hexdigest(), end, end == root, *([[proof[i:i + 64] for i in range(0, len(proof), 64)]] if siblings else [])))
        return schema_table([keys, own.column("leaf"), *[pa.array(c) for c in zip(*rows, strict=True)]])

    kinds = T.StructType(schema.fields)

    def schema_table(columns: list) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)
        if not columns:
            return target.empty_table()
        return pa.table([pa.chunked_array([c.cast(f.type)]) if isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    leaves = manifest.leaves if wanted is None else manifest.leaves.where(wanted)
    nodes = manifest.nodes
    if wanted is not None:  # a choice of leaves needs leaves as siblings too
        nodes = nodes.union(manifest.leaves.select("tree", F.lit(0).alias("level"), "place", "leaf"))
    leaves = leaves.withColumn("block", F.expr(f"place div {BLOCK}"))
    path = F.transform("path", lambda d, i: F.struct(F.lit(PATH).alias("level"), i.cast("long").alias("place"), d.alias("digest")))
    ends = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(0).cast("long").alias("place"), F.col(c).alias("digest")) for level, c in ((SUBROOT, "subroot"), (ROOT, "root"))])
    above = leaves.select("tree", "block").distinct().join(manifest.parts, "tree").select("tree", "block", F.explode(F.concat(ends, path)).alias("node")).select("tree", "block", "node.*")
    found = fetched_by_blocks(leaves, nodes).union(above)
    return leaves.groupBy("tree", "block").cogroup(found.groupBy("tree", "block")).applyInArrow(expand, schema)


def lower_plain(column: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
