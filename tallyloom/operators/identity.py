"""Linking copies to students: exact, suffix, wildcard and manual rules.

Readings repeat (blank, partial or common numbers), so every rule works on the distinct
readings first and the copies meet the result in one equality join. Ambiguity resolves
to nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.operators.roster import MIN_ID_WIDTH, full_name


def by_full_id(reads: DataFrame, students: DataFrame, column: str) -> DataFrame:
    known = students.select(F.col("id").alias("matched_id")).distinct()
    return reads.join(known, reads[column] == known["matched_id"], "left")


def suffix_lookup(students: DataFrame) -> DataFrame:
    """``(key, id)``: full numbers, and endings of three digits or more that one student alone carries."""
    ends = students.select("id", F.explode(F.sequence(F.lit(1), F.length("id"))).alias("n")) \
        .select("id", F.right("id", F.col("n")).alias("key"), (F.col("n") == F.length("id")).alias("whole"))
    usable = ends.filter(F.col("whole") | ((F.length("key") >= MIN_ID_WIDTH) & F.col("key").rlike("^[0-9]+$")))
    per = usable.groupBy("key").agg(
        F.max(F.when(F.col("whole"), F.col("id"))).alias("exact"), F.count("*").alias("n"), F.min("id").alias("only"))
    return per.select("key", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("id")).filter("id IS NOT NULL")


def by_id(copies: DataFrame, students: DataFrame, column: str = "student_id") -> DataFrame:
    """Adds ``matched_id`` for the number read on the grid, whatever its width."""
    read = strip(F.col(column))
    reads = copies.select(F.col(column).alias("_read"), read.alias("_c1"), F.ltrim(read, F.lit("0")).alias("_c2")) \
        .filter(F.col("_c1").rlike("^[0-9]+$")).distinct()
    lookup = suffix_lookup(students)
    one = lookup.select(F.col("key").alias("_c1"), F.col("id").alias("_m1"))
    two = lookup.select(F.col("key").alias("_c2"), F.col("id").alias("_m2"))
    resolved = reads.join(one, "_c1", "left").join(two, "_c2", "left") \
        .select("_read", F.coalesce("_m1", "_m2").alias("matched_id")).filter("matched_id IS NOT NULL")
    return copies.join(resolved, copies[column] == resolved["_read"], "left").drop("_read")


def resolve(copies: DataFrame, students: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Number first, name next, else nobody: adds ``matched_id``, ``method`` and ``match_score``.

    ``names(raw, id, score)`` comes from the fuzzy join over the distinct written names.
    """
    linked = by_id(copies, students).withColumnRenamed("matched_id", "_by_id")
    if names is None:
        linked = linked.withColumn("_by_name", F.lit(None).cast("string")).withColumn("_score", F.lit(None).cast("double"))
    else:
        named = names.select(F.col("raw").alias("_raw"), F.col("id").alias("_by_name"), F.col("score").alias("_score"))
        linked = linked.join(named, linked["student_name"] == named["_raw"], "left").drop("_raw")
    method = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name_fuzzy").otherwise("none")
    score = F.when(F.col("_by_id").isNotNull(), 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    return linked.select(*copies.columns, F.coalesce("_by_id", "_by_name").alias("matched_id"),
                         method.alias("method"), score.alias("match_score"))


def resolve_student(copies: DataFrame, students: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """As :func:`resolve`, but a manual link comes first and is never replaced when it is lost."""
    known = students.select(F.col("id").alias("_known")).distinct()
    found = resolve(copies, students, names)
    found = found.join(known, F.col("student_override") == F.col("_known"), "left")
    manual = F.coalesce(F.col("student_override"), F.lit("")) != ""
    kept = F.col("_known").isNotNull()
    return found.select(
        *copies.columns,
        F.when(manual, F.col("_known")).otherwise(F.col("matched_id")).alias("matched_id"),
        F.when(manual, F.when(kept, "override").otherwise("override_lost")).otherwise(F.col("method")).alias("method"),
        F.when(manual, F.when(kept, 1.0).otherwise(0.0)).otherwise(F.col("match_score")).alias("match_score"))


def id_state() -> Column:
    """Does the identity of a resolved copy need a look, and of which kind? Null means no."""
    return F.when(F.coalesce("reviewed_id", F.lit(False)), F.lit(None).cast("string")) \
        .when(F.col("method") == "override_lost", "lost") \
        .when(F.col("matched_id").isNull(), "unresolved") \
        .when((F.col("method") == "override") | F.array_contains("flags", "id_corrige"), F.lit(None).cast("string")) \
        .when(F.coalesce("student_id", F.lit("")).contains("?"), "weak")


def claims(resolved: DataFrame) -> DataFrame:
    """Number of copies claiming each student."""
    return resolved.filter("matched_id IS NOT NULL").groupBy("matched_id").agg(F.count("*").alias("n_claims"))


def assignment_board(resolved: DataFrame) -> DataFrame:
    """Group of each copy; a student claimed twice is given to nobody."""
    # counted apart and joined back: a claimed number may hold any share of the copies
    counted = claims(resolved)
    board = resolved.join(counted.filter("n_claims > 1").select(F.col("matched_id").alias("_dup")),
                          F.col("matched_id") == F.col("_dup"), "left")
    taken = F.col("matched_id").isNotNull() & F.col("_dup").isNull()
    group = F.when(~taken, "unresolved").when(F.col("method") == "override", "manual") \
        .when(F.col("method") == "id", "auto_id").otherwise("auto_name")
    order = F.when(~taken, 0).when(F.col("method") == "override", 2).when(F.col("method") == "id", 3).otherwise(1)
    return board.select(*resolved.columns, F.col("_dup").alias("dup_of"),
                        F.when(taken, F.col("matched_id")).alias("assigned_id"), group.alias("board"), order.alias("board_order"))


def student_pool(board: DataFrame, students: DataFrame) -> DataFrame:
    """Students with the copy they are given, the free ones first."""
    given = board.filter("assigned_id IS NOT NULL").select(F.col("assigned_id").alias("id"), "batch", "page")
    pool = students.select("id", "nom", "prenom").join(given, "id", "left")
    return pool.withColumn("free", F.col("page").isNull())


def absentees(students: DataFrame, resolved: DataFrame) -> DataFrame:
    """Students that no copy claims."""
    present = resolved.filter("matched_id IS NOT NULL").select(F.col("matched_id").alias("id"))
    return students.join(present, "id", "left_anti")


def narrow(copies: DataFrame, students: DataFrame, column: str = "student_id") -> DataFrame:
    """How many students the known digits of the last four leave open, and the first by name.

    Each student is filed under every wildcard spelling of their last four digits with two
    known ones or more, so the wildcard match is an equality join on at most 11^4 patterns.
    Equal last characters have the same spellings: they are counted before they are spelled.
    """
    first = F.struct("nom", "prenom", "id")
    endings = students.groupBy(F.right("id", F.lit(4)).alias("_last")).agg(F.count("*").alias("n"), F.min(first).alias("f")).select("n", "f.*")
    patterns = narrow_patterns(endings, "n").groupBy("pattern").agg(
        F.sum("n").alias("n_candidates"), F.min_by("id", first).alias("first_id"))
    everyone = students.agg(F.count("*").alias("n"), F.min_by("id", F.struct("nom", "prenom", "id")).alias("f"))
    asked = copies.withColumn("pattern", read_pattern(column))
    return asked.join(patterns, "pattern", "left").select(
        *copies.columns, F.coalesce("n_candidates", everyone.select("n").scalar()).alias("n_candidates"),
        F.coalesce("first_id", everyone.select("f").scalar()).alias("first_id"))


def read_pattern(column: str) -> Column:
    """Last four characters with blanks as wildcards; null when fewer than two digits are known."""
    last = F.right(F.coalesce(strip(F.col(column)), F.lit("????")), F.lit(4))
    known = F.length(F.regexp_replace(last, "[^0-9]", ""))
    return F.when(known >= 2, F.lpad(last, 4, "?"))


def narrow_patterns(students: DataFrame, *more: str) -> DataFrame:
    """``(pattern, id, nom, prenom)`` and columns ``more``: wildcard spellings of every student's last four characters."""
    last = F.right("id", F.lit(4))
    out = students.select("id", "nom", "prenom", *more)
    digits = F.array(*[F.lit(d) for d in "0123456789?"])
    for i in range(1, 5):
        char = F.substring(last, i, 1)
        out = out.withColumn(f"_{i}", F.explode(F.when(char == "", digits).otherwise(F.array(char, F.lit("?")))))
    pattern = F.concat("_1", "_2", "_3", "_4")
    out = out.select("id", "nom", "prenom", *more, pattern.alias("pattern"))
    return out.filter(F.length(F.regexp_replace("pattern", "[^0-9]", "")) >= 2)


def fill_template(rows: DataFrame, names: DataFrame, absent: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks written against the names of a given list: filled, absent (left blank) or missing.

    ``rows(row_no, name)``, ``names(raw, id, score)``, ``absent(id)``, ``marks(id, mark)``.
    """
    named = rows.filter(strip(F.col("name")) != "").join(names.select(F.col("raw").alias("name"), "id"), "name", "left")
    marked = named.join(absent.select(F.col("id"), F.lit(True).alias("_gone")), "id", "left").join(marks, "id", "left")
    status = F.when(F.coalesce("_gone", F.lit(False)), "absent").when(F.col("mark").isNull(), "missing").otherwise("filled")
    return marked.select("row_no", "name", "id", status.alias("status"), F.when(status == "filled", F.col("mark")).alias("mark"))


def verify_names(links: DataFrame, readings: DataFrame) -> DataFrame:
    """A second reading of the name against the current link: mismatch, suggestion, unknown or agreement."""
    joined = links.join(readings, "copy_key")
    verdict = F.when(F.col("best_id").isNull(), "unknown").when(F.col("matched_id").isNull(), "suggestion") \
        .when(F.col("best_id") != F.col("matched_id"), "mismatch").otherwise("agree")
    return joined.select("copy_key", "matched_id", "best_id", verdict.alias("verdict"))


def apply_assignments(copies: DataFrame, events: DataFrame, students: DataFrame) -> dict[str, DataFrame]:
    """Last valid assign / unassign event of each copy; numbers absent from the roster are rejected.

    ``copies(copy_key, student_override, student_name, flags)``, ``events(copy_key, ts, event_id, sid)``;
    an empty ``sid`` clears the link.
    """
    known = students.select(F.col("id").alias("sid"), full_name().alias("_full"))
    checked = events.withColumn("sid", F.coalesce(F.trim("sid"), F.lit(""))).join(known, "sid", "left")
    rejected = checked.filter((F.col("sid") != "") & F.col("_full").isNull()).select(
        "event_id", "copy_key", "sid", F.lit("not in the roster").alias("reason"))
    valid = checked.filter((F.col("sid") == "") | F.col("_full").isNotNull())
    last = valid.groupBy("copy_key").agg(F.max_by(F.struct("sid", "_full"), F.struct("ts", "event_id")).alias("e"))
    joined = copies.join(last, "copy_key", "left")
    touched, cleared = F.col("e").isNotNull(), F.col("e.sid") == ""
    without = F.array_remove("flags", "id_corrige")
    applied = joined.select(
        "copy_key",
        F.when(touched, F.nullif("e.sid", F.lit(""))).otherwise(F.col("student_override")).alias("student_override"),
        F.when(touched, F.coalesce("e._full", F.lit(""))).otherwise(F.col("student_name")).alias("student_name"),
        F.when(touched, F.when(cleared, without).otherwise(F.array_append(without, F.lit("id_corrige"))))
         .otherwise(F.col("flags")).alias("flags"))
    return {"copies": applied, "rejected": rejected}
