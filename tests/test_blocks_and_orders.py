"""Copies placed by blocks of powers of two, and the order in which missing categories are created."""

import random

from tallyloom.operators import bank, scoring


def test_ten_thousand_versions_of_one_subject(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 1, 2, 3, 7, 64, 1000]) for _ in range(10_000)]
    versions, at = [], 1
    for i, size in enumerate(sizes):
        versions.append(("s", f"v{i}", at, at + size - 1))
        at += size
    versions += [("t", "only", 5, 5), ("t", "wide", 8, 1 << 40)]
    ranges = spark.createDataFrame(versions, "subject string, vid string, first_copy long, last_copy long")
    asked = [("s", rng.randrange(-5, at + 20), i) for i in range(5000)] + [("t", n, n) for n in (4, 5, 6, 7, 8, 9, 1 << 40, (1 << 40) + 1)] + [("u", 1, 0), ("s", 1, 1), ("s", 1, 1), ("s", None, 2)]
    numbers = spark.createDataFrame(asked, "subject string, n long, ord long")
    out = scoring.version_of_copy(numbers, ranges)
    import bisect
    starts = [v[2] for v in versions if v[0] == "s"]
    for r in out.collect():
        if r.subject == "s":
            want = versions[bisect.bisect_right(starts, r.n) - 1][1] if r.n is not None and 1 <= r.n < at else None
        else:
            want = next((v[1] for v in versions if v[0] == r.subject and v[2] <= r.n <= v[3]), None)
        assert r.vid == want, r
    assert out.count() == len(asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" not in plan.split("Join")[1].split("\n")[0] and "<=" not in plan.split("Join")[1].split("\n")[0]


def test_blocks_cover_their_range_once(spark):
    ranges = [(a, b) for a in range(0, 20) for b in range(a, 20)]
    rows = spark.createDataFrame(ranges, "a long, b long").select("a", "b", scoring.range_blocks("a", "b").alias("p")).collect()
    for r in rows:
        covered = [n for p in r.p for n in range(p.block << p.level, (p.block + 1) << p.level)]
        assert sorted(covered) == list(range(r.a, r.b + 1))


def test_parents_are_created_before_their_children(spark):
    ddl = "id string, parent_id string, name string, position int"
    chain = [(f"c{i}", f"c{i - 1}" if i else "", f"C{i}", 0) for i in range(40)]
    nodes = chain + [("a", "c5", "A", 0), ("b", "gone", "B", 0), ("bb", "b", "BB", 0), ("x", "y", "X", 0), ("y", "x", "Y", 0), ("z", "x", "Z", 0), ("self", "self", "S", 0),
                     ("taken", "c3", "Name", 0), ("under", "taken", "U", 0), ("deep", "under", "D", 0), ("root", None, "R", 0), ("root", None, "R", 0)]
    online = [("c0", None, "C0"), ("c1", "c0", "C1"), ("c2", "c1", "C2"), ("c3", "c2", "C3"), ("other", "c3", "NAME")]
    plan = bank.creation_order(spark.createDataFrame(nodes, ddl), spark.createDataFrame(online, "id string, parent_id string, name string"))
    got = {r.id: (r.level, r.reason) for r in plan.collect()}
    assert got == {**{f"c{i}": (i - 3, None) for i in range(4, 40)}, "a": (3, None), "b": (None, "unknown parent"), "bb": (None, "parent refused"), "x": (None, "cycle"), "y": (None, "cycle"),
                   "z": (None, "cycle"), "self": (None, "cycle"), "taken": (None, "sibling name"), "under": (None, "parent refused"), "deep": (None, "parent refused"), "root": (1, None)}
    nothing = spark.createDataFrame([], ddl)
    assert bank.creation_order(nothing, spark.createDataFrame(online, "id string, parent_id string, name string")).count() == 0
