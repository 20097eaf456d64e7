import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cohort, identity, roster, similarity


def students(spark, rows):
    return spark.createDataFrame([(*r, "", i) for i, r in enumerate(rows)], "id string, nom string, prenom string, email string, ord int")


def test_an_ambiguous_ending_resolves_to_nobody(spark):
    people = students(spark, [("13017", "A", "a"), ("23017", "B", "b"), ("14555", "C", "c"), ("0042", "D", "d")])
    reads = spark.createDataFrame([("3017",), ("13017",), ("555",), ("55",), ("00555",), ("?017",), ("",), (None,), ("042",)], "student_id string")
    got = {r["student_id"]: r["matched_id"] for r in identity.by_id(reads, people).collect()}
    assert got == {"3017": None, "13017": "13017", "555": "14555", "55": None, "00555": "14555", "?017": None, "": None, None: None, "042": "0042"}


def test_a_lost_override_is_never_replaced(spark):
    people = students(spark, [("13021", "A", "a")])
    copies = spark.createDataFrame([("13021", "99999"), ("77777", "13021"), ("13021", "")], "student_id string, student_override string")
    rows = identity.resolve_student(copies, people).collect()
    got = {(r["student_id"], r["student_override"]): (r["matched_id"], r["method"]) for r in rows}
    assert got[("13021", "99999")] == (None, "override_lost")
    assert got[("77777", "13021")] == ("13021", "override")
    assert got[("13021", "")] == ("13021", "id")


NAMES = ["martin paul", "martin paule", "durand anne", "le goff yann", "legoff yan", "dupont", "dupond", "ab", "ba", "anne durand", "zoe", "x"]
READS = ["martn paul", "durant anne", "le gof yann", "dupon", "ab", "aab", "zo", "xx", "paul martin", "yann le goff", "q"]


def test_fuzzy_pairs_equal_brute_force(spark):
    for cutoff in (0.4, 0.7, 0.9):
        pairs = similarity.similar_pairs(
            spark.createDataFrame([(r,) for r in READS], "read string"), spark.createDataFrame([(n,) for n in NAMES], "known string"), cutoff)
        got = {(r["read"], r["known"]): round(r["rank_score"], 9) for r in pairs.collect()}
        want = {}
        for read, known in itertools.product(READS, NAMES):
            score = difflib.SequenceMatcher(None, known, read).ratio()
            if score >= cutoff:
                want[(read, known)] = round(score, 9)
        assert got == want


def test_candidates_equal_the_standard_library(spark):
    index = spark.createDataFrame([(n, str(i)) for i, n in enumerate(NAMES)], "norm string, id string")
    raws = spark.createDataFrame([(r.upper() + " ",) for r in READS], "raw string")
    rows = similarity.candidates(raws, index).orderBy("raw", "rank").collect()
    for read in READS:
        got = [NAMES[int(r["id"])] for r in rows if r["raw"] == read.upper() + " "]
        assert got == difflib.get_close_matches(read, NAMES, n=5, cutoff=0.4)


def test_fuzzy_names_on_the_tables_equal_brute_force(spark):
    """The registered name queries against every pair of distinct names."""
    import __spark_entry__ as entry
    rows = entry.queries()["d14_by_name"](spark, "/root/testdata/sf0.001").select("raw", "id", "score").distinct().collect()
    from tallyloom.plans import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    index = {r["norm"]: r["id"] for r in roster.name_index(t.fx_name_roster).collect()}
    import re
    for row in rows:
        read = re.sub("[^a-zA-Z]+", " ", row["raw"]).strip().lower()
        best = difflib.get_close_matches(read, list(index), n=1, cutoff=0.7)
        assert row["id"] == (index[best[0]] if best else None)


def test_identity_folding(spark):
    def fold(pairs):
        people = spark.createDataFrame(pairs, "id string, name string")
        out = cohort.identity_map(people)
        return ({r["id"]: r["canonical"] for r in out["map"].collect()}, {r["id"]: r["reason"] for r in out["refused"].collect()})

    mapping, refused = fold([("3017", "BADETS Robin"), ("13017", "BADETS Robin")])
    assert mapping["3017"] == "13017" and not refused
    mapping, refused = fold([("017", "A"), ("13017", "A"), ("23017", "A")])
    assert mapping["017"] == "017" and refused == {"017": "ambiguous"}
    mapping, refused = fold([("3017", "ZOLA Emile"), ("13017", "ADAM Eve")])
    assert mapping["3017"] == "3017" and refused == {"3017": "names_differ"}
    mapping, _ = fold([("3017", "?"), ("13017", "ADAM Eve"), ("E3017", "X")])
    assert mapping == {"3017": "13017", "13017": "13017", "E3017": "E3017"}


def test_roster_sheet_is_understood(spark):
    lines = ["Liste 2024;;;", ";;;", "Nom;Prénom;N° étudiant;Groupe", "MARTIN;Paul;13021;A", "DURAND;Anne;13022;B", "PETIT;Zoé;13023;A"]
    table = spark.createDataFrame([("s", i, line.split(";")) for i, line in enumerate(lines)], "sheet string, row_no long, cells array<string>")
    guess = roster.analyze_roster(table).first()
    assert (guess["id_idx"], guess["nom_idx"], guess["prenom_idx"], guess["mail_idx"], guess["data_start"]) == (2, 0, 1, -1, 3)
    people = roster.load_students(table, 2, 0, 1, None, 3).orderBy("id").collect()
    assert [(p["id"], p["nom"], p["prenom"]) for p in people] == [("13021", "MARTIN", "Paul"), ("13022", "DURAND", "Anne"), ("13023", "PETIT", "Zoé")]


def test_leading_zeros_come_back_only_with_a_clear_width(spark):
    def ids(values):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "id string, ord int")
        return [r["id"] for r in roster.pad_leading_zeros(df).orderBy("ord").collect()]

    assert ids(["13021", "13022", "13023", "13024", "42", "AB"]) == ["13021", "13022", "13023", "13024", "00042", "AB"]
    assert ids(["13021", "42", "43"]) == ["13021", "42", "43"]
    assert ids(["42"]) == ["42"]


def test_wildcards_keep_everybody_when_nothing_matches(spark):
    people = students(spark, [("13021", "B", "b"), ("13022", "A", "a"), ("14999", "C", "c")])
    reads = spark.createDataFrame([("302?",), ("?9?9",), ("88?8",), ("?2??",)], "student_id string")
    got = {r["student_id"]: (r["n_candidates"], r["first_id"]) for r in identity.narrow(reads, people).collect()}
    assert got == {"302?": (2, "13022"), "?9?9": (1, "14999"), "88?8": (3, "13022"), "?2??": (3, "13022")}


def test_few_pairs_reach_the_ratio(spark, monkeypatch):
    """The bounds and the levels leave a small share of all pairs, at both cutoffs."""
    from tallyloom.plans import Tables
    t, seen, plain = Tables(spark, "/root/testdata/sf0.001"), [], similarity.candidate_pairs

    def counted(reads, known, cutoff):
        pairs = plain(reads, known, cutoff)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(similarity, "candidate_pairs", counted)
    index = roster.name_index(t.fx_name_roster)
    total = t.fx_name_read.select("raw").distinct().count() * index.select("norm").distinct().count()
    for operator, share in ((similarity.by_name, 0.04), (similarity.candidates, 0.5)):
        seen.clear()
        operator(t.fx_name_read, index).count()
        assert sum(seen) <= share * total


def test_every_sheet_is_loaded_with_its_own_width(spark):
    rows = [("a", i, ["1000" + str(i) if i else "37", "N", "P", "m"]) for i in range(6)] + [("b", i, ["10" + str(i) if i else "7", "N", "P", "m"]) for i in range(6)] + [("c", 0, ["5", "N", "P", "m"])]
    table = spark.createDataFrame(rows, "sheet string, row_no long, cells array<string>")
    out = roster.load_students(table, 0, 1, 2, 3, 0, by="sheet")
    assert out.count() == 13 and {(r.sheet, r.id) for r in out.where("ord = 0").collect()} == {("a", "00037"), ("b", "007"), ("c", "5")}


def test_the_query_of_all_sheets_loads_all_sheets(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    out = entry.queries()["d1_load_all_sheets"](spark, folder)
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    assert out.count() == customers.count() and out.select("sheet").distinct().count() == customers.select("c_mktsegment").distinct().count() > 1


def test_equal_endings_are_spelled_once(spark, monkeypatch):
    from tallyloom.operators import identity

    seen = []
    spell = identity.narrow_patterns
    monkeypatch.setattr(identity, "narrow_patterns", lambda rows, *more: seen.append(rows.count()) or spell(rows, *more))
    students = spark.range(500).selectExpr("CAST(10000 * (id + 1) + id % 5 AS string) AS id", "CAST(-id AS string) AS nom", "'' AS prenom")
    copies = spark.createDataFrame([(1, "0003"), (2, "?002"), (3, "0??4"), (4, "9999"), (5, None)], "copy_key int, student_id string")
    got = {r.copy_key: (r.n_candidates, r.first_id) for r in identity.narrow(copies, students).collect()}
    rows = [(str(10000 * (i + 1) + i % 5), str(-i)) for i in range(500)]

    def first(kept):
        return len(kept), min(kept, key=lambda r: (r[1], "", r[0]))[0]

    assert seen == [5]
    assert got == {k: first([r for r in rows if d is None or r[0].endswith(d)]) for k, d in ((1, "3"), (2, "2"), (3, "4"), (4, None), (5, None))}


def test_first_runs_across_blocks_of_rows(spark):
    from tallyloom.operators import roster

    sheets = {"edge": [3, 46, 47, 48, 49], "late": [0, 1, 47, 95, 96, 97, 200], "none": [500, 7, 9, 95, 96], "two": [0, 2, 4, 5, 5, 4], "first": [0, 1, 2, 3],
              "next": [47, 50, 51, 144, 145, 146]}
    rows = spark.createDataFrame([(s, r) for s, at in sheets.items() for r in at], "sheet string, row_no int")
    found = roster.first_run(rows, ["sheet"])
    assert dict(found.dtypes)["data_start"] == "int"
    assert {r.sheet: r.data_start for r in found.collect()} == {"edge": 46, "late": 95, "none": 7, "two": 0, "first": 0, "next": 144}
    assert "Expand" not in (plan := found._jdf.queryExecution().toString()) and plan.count("HashAggregate") <= 8
    with pytest.raises(ValueError, match="length"):
        roster.first_run(rows, ["sheet"], 17)
