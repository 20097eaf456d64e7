"""The joint table as it is shown."""

from tallyloom.operators import cohort


def test_shown_table_names_folded_numbers_and_counts_unlinked_copies(spark):
    member = "path string, exam_ord long, ord long, id string, name string, email string, raw double, absent boolean"
    rows = [("a", 0, 1, "1234", "?", "", 10.0, False), ("a", 0, 2, "", "X", "", 3.0, False), ("a", 0, 3, "", "Y", "", None, True),
            ("b", 1, 1, "91234", "Zoe Z", "z@x", 20.0, False), ("b", 1, 2, "555", "Ann A", "", None, True), ("b", 1, 3, "", "W", "", 1.0, False)]
    columns = spark.createDataFrame([("a", "a", "A", 20.0, 20.0, 1.0), ("b", "b", "B", 20.0, 20.0, 1.0)],
                                    "key string, path string, label string, norm double, max double, weight double")
    members = spark.createDataFrame(rows, member)
    out = [r.asDict() for r in cohort.shown_table(members, columns, 20.0).collect()]
    assert [(r["id"], r["name"], r["also_id"], r["n_columns"], r["final"], r["absent_in"], r["unlinked"]) for r in out] == [
        ("555", "Ann A", [], 0, None, ["B"], None), ("91234", "Zoe Z", ["1234"], 2, 15.0, [], None),
        ("", "(2 copie(s) non reliée(s))", [], 0, None, [], 2)]
    assert out[1]["notes"] == {"a": 10.0, "b": 20.0} and out[2]["notes"] == {}
    linked = cohort.shown_table(members.filter("id <> ''"), columns, 20.0).collect()
    assert [r["id"] for r in linked] == ["555", "91234"]
