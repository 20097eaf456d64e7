"""Order-dependent and graph operators against plain loops."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import cells, evaluate, merging, ordering, review, tree, variants


def scan_groups(pages):
    out, current, seen = [], [], set()
    for page, sheet in pages:
        if sheet in seen:
            out.append(current)
            current, seen = [], set()
        current.append(page)
        seen.add(sheet)
    return out + ([current] if current else [])


def test_scan_order_grouping_equals_a_loop(spark):
    rng = random.Random(3)
    batches = {b: [(p, rng.choice([15, 16, 17])) for p in range(1, n)] for b, n in (("x", 60), ("y", 8), ("z", 2))}
    batches["w"] = [(p, 15 + p % 2) for p in range(1, 31)]
    rows = [(b, p, s) for b, pages in batches.items() for p, s in pages]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "batch string, page long, sheet_page int")
    for chunk in (4, 7, 1000):
        groups = {}
        for r in merging.group_by_scan_order(df, chunk=chunk).collect():
            groups.setdefault((r["batch"], r["copy_group"]), []).append(r["page"])
        for b, pages in batches.items():
            assert sorted(sorted(v) for (k, _), v in groups.items() if k == b) == sorted(scan_groups(pages)), (b, chunk)


def test_copies_may_have_more_sheets_than_a_chunk_has_pages(spark):
    rng = random.Random(5)
    batches = {"long": [(p, p) for p in range(1, 41)], "mixed": [(p, rng.randrange(12)) for p in range(1, 80)],
               "late": [(p, p) for p in range(1, 30)] + [(p, 3) for p in range(30, 34)]}
    df = spark.createDataFrame([(b, p, s) for b, pages in batches.items() for p, s in pages], "batch string, page long, sheet_page int")
    groups = {}
    for r in merging.group_by_scan_order(df, chunk=3).collect():
        groups.setdefault((r["batch"], r["copy_group"]), []).append(r["page"])
    for b, pages in batches.items():
        assert sorted(sorted(v) for (k, _), v in groups.items() if k == b) == sorted(scan_groups(pages)), b


def test_printed_numbers_win_when_all_can_be_trusted(spark):
    df = spark.createDataFrame([("b", 1, 7, "printed", 15), ("b", 2, 8, "printed", 15), ("b", 3, 7, "printed", 16)],
                               "batch string, page long, copy_id int, copy_id_source string, sheet_page int")
    assert {r["page"]: r["copy_group"] for r in merging.group_sheets(df).collect()} == {1: "c7", 2: "c8", 3: "c7"}
    mixed = df.withColumn("copy_id_source", F.when(F.col("page") == 2, "default").otherwise(F.col("copy_id_source")))
    assert {r["page"]: r["copy_group"] for r in merging.group_sheets(mixed).collect()} == {1: "b:0", 2: "b:1", 3: "b:1"}


def normal(spark, rows):
    df = spark.createDataFrame(rows, "bank_id string, variant_of string, created_at string")
    return variants.normalize(df)


def test_variants_chains_dead_pointers_and_cycles(spark):
    rows = [("a", "", "1"), ("b", "a", "2"), ("c", "b", "3"), ("d", "gone", "4"), ("e", "e", "5"),
            ("x", "y", "9"), ("y", "z", "7"), ("z", "x", "8"), ("t", "x", "1"), ("u", "t", "1")]
    got = {r["bank_id"]: r["head"] for r in normal(spark, rows).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "x": "y", "y": "y", "z": "y", "t": "y", "u": "y"}


def test_long_chains_and_random_graphs(spark):
    rng = random.Random(11)
    n = 120
    pointer = {i: (i - 1 if 0 < i < 60 else rng.randrange(n)) for i in range(n)}
    rows = [(f"{i:03d}", f"{pointer[i]:03d}" if i else "", f"{rng.random():.6f}") for i in range(n)]
    order = {r[0]: (r[2], r[0]) for r in rows}
    ptr = {r[0]: r[1] for r in rows}

    def head(start):
        current, seen = start, [start]
        while True:
            nxt = ptr[current]
            if not nxt or nxt == current:
                return current
            if nxt in seen:
                return min(seen[seen.index(nxt):], key=order.get)
            current = nxt
            seen.append(current)

    got = {r["bank_id"]: r["head"] for r in normal(spark, rows).collect()}
    assert got == {r[0]: head(r[0]) for r in rows}


def test_a_deleted_head_promotes_its_oldest_variant(spark):
    fixed = normal(spark, [("a", "", "1"), ("b", "a", "3"), ("c", "a", "2"), ("d", "", "4")])
    gone = spark.createDataFrame([("a",), ("d",)], "bank_id string")
    assert {r["bank_id"]: r["variant_of"] for r in variants.promote_on_delete(fixed, gone).collect()} == {"c": "", "b": "c"}


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, parent_id string, name string, position int")


def test_tree_depth_six_is_the_limit(spark):
    chain = [(f"k{i}", f"k{i - 1}" if i > 1 else None, f"n{i}", 0) for i in range(1, 8)]
    found = {(r["id"], r["violation"]) for r in tree.validate_nodes(nodes(spark, chain), check_ids=False).collect()}
    assert found == {("k7", "too_deep")}
    assert tree.validate_nodes(nodes(spark, chain[:6]), check_ids=False).count() == 0


def test_moves_carry_their_subtree(spark):
    rows = [(f"k{i}", f"k{i - 1}" if i > 1 else None, f"n{i}", 0) for i in range(1, 5)] + [("r", None, "r", 1), ("s", "r", "s", 0), ("t", "s", "N4", 0)]
    table = nodes(spark, rows)
    moves = spark.createDataFrame([("r", "k3"), ("r", "k4"), ("r", "t"), ("t", "k3"), ("s", None)], "id string, new_parent string")
    got = {(r["id"], r["new_parent"]): r["reason"] for r in tree.check_moves(table, moves, tree.closure(table)).collect()}
    assert got == {("r", "k3"): None, ("r", "k4"): "too deep", ("r", "t"): "cycle", ("t", "k3"): "sibling name", ("s", None): None}


def test_prefix_order_and_orphans(spark):
    rows = [("b", None, "Beta", 0), ("a", None, "alpha", 0), ("c", "b", "x", 1), ("d", "b", "y", 0), ("o", "gone", "orphan", 0)]
    links = spark.createDataFrame([("q1", "c"), ("q1", "d"), ("q2", "d"), ("q3", "b")], "bank_id string, category_id string")
    out = tree.annotate(nodes(spark, rows), links).collect()
    assert [r["id"] for r in out] == ["a", "b", "d", "c", "o"]
    assert {r["id"]: (r["n_direct"], r["n_total"]) for r in out}["b"] == (1, 3) and out[-1]["orphan"]


def test_ranks_and_running_sums_with_one_dominant_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.random(), i, 1 + i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v double, i int, n int").repartition(7)
    ranks = {(r["k"], r["i"]): r["rank"] for r in ordering.with_rank(df, ["v", "i"], keys=["k"]).collect()}
    sums = {r["i"]: r["s"] for r in ordering.with_running_sums(df, ["v", "i"], ["k"], {"s": "n"}).collect()}
    near = {r["i"]: (r["p"], r["f"]) for r in ordering.with_neighbours(df, ["v", "i"], "i", "p", "f").collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for place, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            total += r[3]
            assert ranks[(key, r[2])] == place and sums[r[2]] == total
    line = [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    for j, i in enumerate(line):
        assert near[i] == (line[j - 1] if j else None, line[j + 1] if j + 1 < len(line) else None)


def test_cell_decisions(spark):
    nan = float("nan")
    rows = [(0.42, True, nan), (0.42, False, nan), (0.42, True, 0.9), (0.93, False, 0.9), (None, True, nan), (None, False, 0.9)]
    df = spark.createDataFrame(rows, "p double, e2 boolean, m double")
    got = [tuple(r) for r in df.select(*cells.decide_cell("p", "e2", "m")).collect()]
    assert got == [(True, None, True), (False, None, False), (False, 0.42, False), (True, 0.93, False), (True, None, False), (False, None, False)]


def test_void_probability_flags_nothing(spark):
    rows = [(0.42, float("nan"), 0.1, 0.5), (0.42, float("nan"), 0.9, 0.5), (0.42, 0.02, 0.1, 0.5)]
    out = cells.flag_reasons(spark.createDataFrame(rows, "proba double, masked double, ratio double, threshold double")).collect()
    assert [(r["published"], r["reasons"]) for r in out] == [(None, []), (None, ["no_masked"]), (0.42, ["uncertain"])]


def test_closure_goes_to_the_root_and_through_cycles_once(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i > 1 else None) for i in range(1, 10)]
    rows = [*chain, ("c", "a"), ("a", "b"), ("b", "a"), ("self", "self"), ("lost", "nowhere")]
    table = spark.createDataFrame([(i, p, i.upper(), 0) for i, p in rows], "id string, parent_id string, name string, position int")
    got = {}
    for r in tree.closure(table).collect():
        got.setdefault(r["id"], {})[r["ancestor"]] = r["distance"]
    assert got["n9"] == {f"n{i}": 9 - i for i in range(1, 10)}
    assert got["c"] == {"c": 0, "a": 1, "b": 2} and got["a"] == {"a": 0, "b": 1} and got["self"] == {"self": 0} and got["lost"] == {"lost": 0}
    path = {r["id"]: (r["depth"], "/".join(r["path"])) for r in tree.paths(table, tree.closure(table)).collect()}
    assert path["n9"] == (9, "/".join(f"N{i}" for i in range(1, 10))) and path["c"] == (3, "B/A/C")


def test_printed_code_bits(spark):
    bits = [("p", 1, r, 0.9 if r == 12 else 0.1) for r in range(1, 13)] + [("p", 2, r, 0.9 if r == 6 else 0.1) for r in range(1, 7)] \
        + [("p", 3, r, 0.9 if r <= 4 else 0.1) for r in range(1, 7)]
    table = spark.createDataFrame(bits, "page_key string, kind int, rank int, ratio double")
    codes = cells.decode_page_codes(table, {1: 12, 2: 6, 3: 6})
    assert tuple(codes.first())[1:] == (1, 1, 60)
    assert cells.known_codes(codes, spark.createDataFrame([(1, 1, 59)], "copy long, page long, checksum long")).count() == 0


def test_best_cut_equals_a_search(spark):
    rng = random.Random(9)
    rows = [(f"c{i}", i % 3, "A", round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "copy_key string, q int, ch string, v double, truth int")
    for r in evaluate.oracle_cuts(df, "v").collect():
        mine = sorted((x[3], x[4]) for x in rows if x[1] == r["q"])
        cuts = [None] + sorted({v for v, _ in mine})
        right = [sum((v > c if c is not None else True) == bool(t) for v, t in mine) for c in cuts]
        assert r["n_right"] == max(right)
        assert sum((v > r["threshold"]) == bool(t) for v, t in mine) == max(right)


def test_review_of_one_copy(spark):
    copies = spark.createDataFrame([("c", "", False), ("v", "", True)], "copy_key string, grp string, validated boolean")
    questions = spark.createDataFrame([(1, "single", ""), (2, "mult", "")], "q int, qtype string, grp string")
    options = spark.createDataFrame([(q, ch, False) for q in (1, 2) for ch in "ABC"], "q int, ch string, correct boolean")
    flags = spark.createDataFrame([("c", 2, "A", ["uncertain"], 0.5), ("c", 2, "B", ["disagree"], 0.95), ("v", 2, "A", ["diff"], None)],
                                  "copy_key string, q int, ch string, reasons array<string>, proba double")
    seen = spark.createDataFrame([("c", 2, "B")], "copy_key string, q int, ch string")
    current = spark.createDataFrame([("c", 2, "A")], "copy_key string, q int, ch string")
    judged = review.judged_cells(copies, flags, seen, questions, options)
    structure = review.structural_flags(copies, current, questions, options)
    items = review.review_items(copies, judged, structure, spark.createDataFrame([], "copy_key string, q int"))
    got = {(r["copy_key"], r["q"]): (r["reason"], r["n_flagged"], r["n_open"], round(r["risk"], 3), r["ambiguity"]) for r in items.collect()}
    assert got == {("c", 1): ("no_answer", 1, 1, 1.0, 0.5), ("c", 2): (None, 2, 1, 2.0, 1.0),
                   ("v", 1): ("no_answer", 1, 0, 0.0, 0.5), ("v", 2): (None, 1, 0, 0.0, 0.5)}
