"""From page readings to copies: grouping sheets, merging them, and keeping human work on a new reading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import split_cell_key
from tallyloom.operators.ordering import with_rank
from tallyloom.session import durable

# Flags that only a person sets.
USER_FLAGS = ("manually_edited", "validated", "id_corrige", "open_answer_edited")
CHUNK = 50_000


def reading_diff(first: DataFrame, second: DataFrame, options: DataFrame) -> DataFrame:
    """Option cells where two readings differ, with both values."""
    cell = ["copy_key", "q", "ch"]
    sides = first.select(*cell, F.lit(1).alias("s")).unionByName(second.select(*cell, F.lit(2).alias("s")))
    seen = sides.groupBy(*cell).agg(F.bit_or("s").alias("s")).filter("s <> 3")
    return seen.join(options.select("q", "ch"), ["q", "ch"]).select(
        *cell, (F.col("s") == 1).alias("cv"), (F.col("s") == 2).alias("amc"))


def derive_flags() -> Column:
    """Flags of a reading: ``notes``, ``student_id``, ``n_validated`` (null without a second reading), ``n_diff``."""
    notes = F.coalesce("notes", F.lit(""))
    return F.array_compact(F.array(
        F.when(notes.contains("ambigu"), "ambiguous"), F.when(F.coalesce("student_id", F.lit("????")).contains("?"), "id_incomplet"),
        F.when(notes.contains("mires=FAIL"), "no_mires"), F.when(F.col("n_validated") == 0, "amc_unvalidated"),
        F.when(F.col("n_diff") > 0, F.concat(F.lit("cv_differs_amc("), F.col("n_diff").cast("string"), F.lit(")")))))


def answer_sheets(pages: DataFrame) -> DataFrame:
    """Pages that are answer sheets, or that somebody already reviewed."""
    return pages.filter(F.coalesce("preserved", F.lit(False)) | F.coalesce("is_answer_sheet", F.lit(True)))


def printed_everywhere(pages: DataFrame) -> bool:
    """True when every sheet carries a printed copy number and there are several of them.

    The rule chooses between two groupings of the whole scan, so it is the one value read back.
    """
    printed = F.coalesce((F.col("copy_id_source") == "printed") & F.col("copy_id").isNotNull(), F.lit(False))
    row = pages.agg(F.min(printed).alias("all"), F.min("copy_id").alias("lo"), F.max("copy_id").alias("hi")).first()
    return bool(row["all"]) and row["lo"] != row["hi"]


def group_sheets(pages: DataFrame) -> DataFrame:
    """Adds ``copy_group``: the printed copy number when it can be trusted, else the scan order."""
    if printed_everywhere(pages):
        return pages.withColumn("copy_group", F.concat(F.lit("c"), F.col("copy_id").cast("string")))
    return group_by_scan_order(pages)


def group_by_scan_order(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A new copy starts when a sheet number comes back since the current one began, batch by batch.

    The rule is sequential, but the copy open at a chunk border began within the last pages that
    are all different. Each chunk, seen with the one before, says where the next copy starts for
    every place the previous chunk may have been entered; chaining these short tables gives the real
    entry of each chunk, and the chunks are then cut independently. No task sees a whole batch. Where a
    copy has more different sheets than a chunk has pages, the chunks grow; the result does not depend on them.
    """
    columns = pages.columns
    ranked = durable(with_rank(pages.select("batch", "page", "sheet_page"), ["page"], keys=["batch"], name="rank")
                     .withColumn("pos", F.col("rank") - 1).withColumn("chunk", F.floor((F.col("rank") - 1) / chunk)))
    windows = ranked.select("batch", "pos", "sheet_page", "chunk", F.col("chunk").alias("target")).unionByName(
        ranked.select("batch", "pos", "sheet_page", "chunk", (F.col("chunk") + 1).alias("target"))).filter("target > 0")

    def landings(key, rows: pd.DataFrame) -> pd.DataFrame:
        target = key[1]
        rows = rows.sort_values("pos")
        pos, sheet = rows["pos"].tolist(), rows["sheet_page"].tolist()
        border = target * chunk
        following, best, last = {}, None, {}
        for i in range(len(pos) - 1, -1, -1):
            again = last.get(sheet[i])
            if again is not None and (best is None or again < best):
                best = again
            following[pos[i]] = best
            last[sheet[i]] = pos[i]
        lands, out = {}, []
        for i in range(len(pos) - 1, -1, -1):
            if pos[i] >= border:
                continue
            nxt = following[pos[i]]
            lands[pos[i]] = nxt if nxt is None or nxt >= border else lands[nxt]
        # the first start of a chunk is at most one full set of sheets after its border
        reach = (target - 1) * chunk + len(set(sheet)) + 1
        for start, land in lands.items():
            if start <= reach:
                out.append((key[0], target, start, land))
        return pd.DataFrame(out, columns=["batch", "target", "entry", "land"]).astype({"land": "Int64"})

    def chain(key, rows: pd.DataFrame) -> pd.DataFrame:
        table = {(t, e): l for t, e, l in zip(rows["target"], rows["entry"], rows["land"])}
        entry, out = 0, []
        for target in range(1, int(rows["target"].max()) + 1):
            land = None if entry is None else table.get((target, entry))
            stuck = entry is None
            entry = None if land is None or pd.isna(land) else int(land)
            out.append((key[0], target, entry, stuck))
        return pd.DataFrame(out, columns=["batch", "chunk", "entry", "stuck"]).astype({"entry": "Int64"})

    def cut(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        entry = rows["entry"].iloc[0]
        start, seen, starts = None, set(), []
        for p, s in zip(rows["pos"], rows["sheet_page"]):
            if not pd.isna(entry) and p == entry:
                start, seen = p, set()
            elif start is not None and s in seen:
                start, seen = p, set()
            if start is not None:
                seen.add(s)
            starts.append(start)
        out = rows[["batch", "page", "chunk"]].copy()
        out["start"] = pd.array(starts, dtype="Int64")
        return out

    table = windows.groupBy("batch", "target").applyInPandas(landings, "batch string, target long, entry long, land long")
    chained = durable(table.groupBy("batch").applyInPandas(chain, "batch string, chunk long, entry long, stuck boolean"))
    if not chained.filter("stuck").isEmpty():
        # a copy has more different sheets than a chunk has pages, so its sheets need larger chunks
        return group_by_scan_order(pages, chunk * 4)
    entries = durable(chained.drop("stuck").unionByName(ranked.select("batch").distinct().select("batch", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("entry"))))
    placed = ranked.join(entries, ["batch", "chunk"]).select("batch", "page", "chunk", "pos", "sheet_page", "entry")
    cuts = durable(placed.groupBy("batch", "chunk").applyInPandas(cut, "batch string, page long, chunk long, start long"))
    # pages before the first start of a chunk belong to the copy still open in an earlier chunk
    before = Window.partitionBy("batch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    opened = cuts.groupBy("batch", "chunk").agg(F.max("start").alias("s")).select(
        "batch", "chunk", F.max("s").over(before).alias("last_start"))
    filled = cuts.join(opened, ["batch", "chunk"])
    copy_start = F.coalesce("start", "last_start")
    grouped = filled.select("batch", "page", F.concat_ws(":", F.col("batch"), copy_start.cast("string")).alias("copy_group"))
    return pages.join(grouped, ["batch", "page"]).select(*columns, "copy_group")


def merge_sheets(sheets: DataFrame) -> DataFrame:
    """One reading per copy: the fullest number (earlier wins ties) and summed counters.

    ``sheets(copy_group, batch, page, student_id, n_frame_fail, n_cells)``; the copy takes the
    place of its first sheet.
    """
    order = F.struct("batch", "page")
    sid = F.nullif("student_id", F.lit(""))
    unknown = F.length("student_id") - F.length(F.replace("student_id", F.lit("?"), F.lit("")))
    return sheets.groupBy("copy_group").agg(
        F.min(order).alias("first"), F.count("*").alias("n_sheets"),
        F.coalesce(F.min_by(sid, F.when(sid.isNotNull(), F.struct(unknown, "batch", "page"))), F.lit("")).alias("student_id"),
        F.sum(F.coalesce("n_frame_fail", F.lit(0))).alias("n_frame_fail"), F.sum(F.coalesce("n_cells", F.lit(0))).alias("n_cells")) \
        .select("copy_group", "first.batch", "first.page", "n_sheets", "student_id", "n_frame_fail", "n_cells")


def merge_answers(sheets: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of a copy: union over its sheets, the later sheet wins a question."""
    placed = answers.join(sheets.select("batch", "page", "copy_group"), ["batch", "page"])
    return placed.groupBy("copy_group", "q").agg(F.max_by("letters", F.struct("batch", "page")).alias("letters"))


def merge_notes(sheets: DataFrame) -> DataFrame:
    """Notes of each copy in sheet order, one row each, prefixed by the sheet when there are several."""
    several = sheets.groupBy("copy_group").agg((F.count("*") > 1).alias("many"))
    text = F.coalesce("notes", F.lit(""))
    shown = F.when(F.col("many"), F.concat(F.lit("f"), F.col("sheet_page").cast("string"), F.lit(": "), text)).otherwise(text)
    return sheets.join(several, "copy_group").select("copy_group", "batch", "page", shown.alias("note")).filter("note <> ''")


def later_wins(maps: Column, kind: str) -> Column:
    """One map of an array of maps of type ``kind``; of equal keys the last map's value stays."""
    empty = F.create_map().cast(kind)
    return F.aggregate(maps, empty, lambda held, m: F.map_concat(F.map_filter(held, lambda k, v: ~F.map_contains_key(m, k)), m).cast(kind))


#: what a second reading says of a copy
SECOND = ("amc_copy", "amc_answers", "amc_validated_cells")


def merge_copies(sheets: DataFrame) -> DataFrame:
    """One whole reading per ``copy_group``, from all its sheets in (batch, page) order, in one shuffle.

    Answers and free answers are united by question (the later sheet wins), doubts follow each other, the fullest number
    wins (the earlier of equal ones), counters are summed, notes joined. All else is that of the first sheet, whose place
    the copy takes, a second reading (columns of ``SECOND``) that its row already carries included; a copy of several sheets lists
    them in ``sheets``. A group is as large as one copy.
    """
    carried = [c for c in SECOND if c in sheets.columns]
    fields = ["batch", "page", "sheet_page", "student_id", "answers", "ambiguous_cells", "open_answers", "notes", "n_frame_fail", "n_cells",
              "copy_id", "copy_id_source", "page_no", "sheet_source", "n_sheets", *carried]
    place = lambda x: F.struct(x["batch"], x["page"])
    ordered = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))
    grouped = sheets.groupBy("copy_group").agg(ordered.alias("s"))
    letters, free = (sheets.schema[c].dataType.simpleString() for c in ("answers", "open_answers"))
    several, s = F.size("s") > 1, F.col("s")

    def maps(name, kind):
        return later_wins(F.transform(s, lambda x: F.coalesce(x[name], F.create_map().cast(kind))), kind)

    def total(name):
        return F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x[name], F.lit(0)).cast("long"))

    unknown = lambda t: F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
    numbers = F.filter(F.transform(s, lambda x, i: F.struct(unknown(x["student_id"]).alias("n"), i.alias("i"), x["student_id"].alias("id"))),
                       lambda x: F.coalesce(x["id"], F.lit("")) != "")
    note = lambda x: F.coalesce(x["notes"], F.lit(""))
    notes = F.transform(s, lambda x: F.when(several, F.concat(F.lit("f"), F.coalesce(x["sheet_page"].cast("string"), F.lit("None")), F.lit(": "), note(x))).otherwise(note(x)))
    first = [F.get(s, F.lit(0))[c].alias(c) for c in ("batch", "page", "copy_id", "copy_id_source", "page_no", "sheet_page", "sheet_source", "n_sheets", *carried)]
    none = F.array().cast(sheets.schema["ambiguous_cells"].dataType)
    return grouped.select(
        "copy_group", *first, F.coalesce(F.array_min(numbers)["id"], F.lit("")).alias("student_id"), maps("answers", letters).alias("answers"),
        F.flatten(F.transform(s, lambda x: F.coalesce(x["ambiguous_cells"], none))).alias("ambiguous_cells"), maps("open_answers", free).alias("open_answers"),
        F.array_join(F.filter(notes, lambda n: n != ""), " | ").alias("notes"), total("n_frame_fail").alias("n_frame_fail"), total("n_cells").alias("n_cells"),
        F.when(several, F.transform(s, lambda x: F.struct(x["batch"].alias("batch"), x["page"].cast("long").alias("page"), x["sheet_page"].alias("sheet_page")))).alias("sheets"))


def cell_differences(first: str, second: str, options: str) -> Column:
    """Cells where two maps of letters by question differ, over ``options`` (map of all letters by question), in order."""
    cells = F.flatten(F.transform(F.array_sort(F.map_keys(options)), lambda q: F.transform(F.element_at(options, q), lambda ch: F.struct(
        q.alias("q"), ch.alias("char"), F.array_contains(_letters(first, q), ch).alias("cv"), F.array_contains(_letters(second, q), ch).alias("amc")))))
    return F.filter(cells, lambda c: c["cv"] != c["amc"])


def fresh_copies(merged: DataFrame, second: DataFrame | None, options: DataFrame) -> DataFrame:
    """Copies as a new reading gives them, ready for ``upsert_readings``.

    ``merged`` is the result of ``merge_copies``; ``second(batch, page, amc_copy, amc_answers, amc_validated_cells)`` the second reading,
    placed at the first sheet, or None if ``merged`` carries it; ``options(q, ch)`` in order of their position, one small table for the exam.
    """
    letters = options.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda o: o["ch"]).alias("l"))
    every = letters.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("q", "l")))))
    both = (merged if second is None else merged.join(second, ["batch", "page"], "left")).withColumn("_options", every.scalar())
    differ = F.when(F.col("amc_answers").isNotNull(), cell_differences("answers", "amc_answers", "_options"))
    both = both.withColumn("cv_amc_diff", differ).withColumn("n_diff", F.size("cv_amc_diff")).withColumn("n_validated", F.col("amc_validated_cells"))
    return both.select("batch", "page", "student_id", "answers", derive_flags().alias("flags"), *[c for c in MACHINE_COLUMNS if c != "source"],
                       F.lit("cv").alias("source"), "open_answers")


# ------------------------------------------------------------ new reading over an old copy


def _letters(answers: str, q: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(answers), q), F.array().cast("array<string>"))


def _same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def kept_cell_marks() -> Column:
    """Cell marks whose machine reading did not change (columns ``o_*`` old, ``n_*`` new)."""
    def unchanged(mark):
        q, ch = split_cell_key(mark)
        old, new = F.array_contains(_letters("o_cv_answers", q), ch), F.array_contains(_letters("n_cv_answers", q), ch)
        return q.isNotNull() & (ch != "") & (old == new)

    return F.filter(F.coalesce("o_reviewed_cells", F.array().cast("array<string>")), unchanged)


def kept_question_marks() -> Column:
    return F.filter(F.coalesce("o_reviewed_questions", F.array().cast("array<int>")),
                    lambda q: _same_set(_letters("o_cv_answers", q), _letters("n_cv_answers", q)))


def has_human_work(prefix: str = "o_") -> Column:
    flags = F.coalesce(f"{prefix}flags", F.array().cast("array<string>"))
    return F.arrays_overlap(flags, F.array(*[F.lit(f) for f in USER_FLAGS])) \
        | (F.coalesce(f"{prefix}student_override", F.lit("")) != "") | (F.coalesce(f"{prefix}cv_student_id", F.lit("")) != "")


COPY_COLUMNS = ("student_id", "student_name", "answers", "cv_answers", "flags", "reviewed_cells", "reviewed_questions",
                "reviewed_id", "student_override", "cv_student_id")
#: what every new reading replaces, whoever worked on the copy
MACHINE_COLUMNS = ("notes", "source", "amc_answers", "amc_copy", "amc_validated_cells", "cv_amc_diff", "ambiguous_cells", "copy_id",
                   "copy_id_source", "page_no", "sheet_page", "sheet_source", "n_sheets", "sheets")
OPEN_COLUMNS = ("open_answers", "cv_open_answers")
WHOLE_COLUMNS = COPY_COLUMNS + MACHINE_COLUMNS + OPEN_COLUMNS


def swallowed_pages(new: DataFrame) -> DataFrame:
    """Pages (batch, page) that are later sheets of a copy read anew, and no copies of their own."""
    parts = new.select("batch", "page", F.explode("sheets").alias("s")).select("s.batch", "s.page", F.struct("batch", "page").alias("own"))
    return parts.filter(F.struct("batch", F.col("page").cast("long")) != F.struct("own.batch", F.col("own.page").cast("long"))).select("batch", "page").distinct()


def upsert_readings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Copies after a new reading, by (batch, page): machine fields refreshed, human work kept.

    A copy a person worked on keeps its answers, name, user flags, override, edited number and, if it has any, its free
    answers (``cv_open_answers`` is always what was read); review marks survive where the machine reads the same. Columns of
    ``MACHINE_COLUMNS`` and the free answers take part if both tables have them. Copies not read again stay as they
    are, but for pages that a copy read anew lists among its ``sheets``: these are no copies any more.
    """
    key = ["batch", "page"]
    machine, free = shared_columns(old.columns, new.columns)
    if "sheets" in machine:
        old = old.join(swallowed_pages(new), key, "left_anti")
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in (*COPY_COLUMNS, *machine, *free)], F.lit(True).alias("_old"))
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("student_id", "answers", "flags", *machine, *free[:1])], F.lit(True).alias("_new"))
    return refreshed(o.join(n, key, "full"), key, machine, free)


def shared_columns(old: list[str], new: list[str]) -> tuple[list[str], list[str]]:
    """Machine fields and free answers that take part in ``upsert_readings`` of tables with these columns."""
    return [c for c in MACHINE_COLUMNS if c in old and c in new], [c for c in OPEN_COLUMNS if c in old and "open_answers" in new]


def refreshed(both: DataFrame, key: list[str], machine: list[str], free: list[str]) -> DataFrame:
    """The rule of ``upsert_readings`` for rows that hold a stored copy (``o_*``, ``_old``), its new reading (``n_*``, ``_new``) or both."""
    both = both.withColumn("n_cv_answers", F.col("n_answers"))
    fresh = F.col("_new").isNotNull()
    human = F.coalesce("_old", F.lit(False)) & has_human_work()
    edited_id = human & (F.coalesce("o_cv_student_id", F.lit("")) != "")
    kept_flags = F.filter(F.coalesce("o_flags", F.array().cast("array<string>")), lambda f: f.isin(*USER_FLAGS))
    flags = F.when(human, F.array_sort(F.array_union("n_flags", kept_flags))).otherwise(F.array_sort("n_flags"))
    complete = edited_id & ~F.coalesce("o_student_id", F.lit("")).contains("?")
    flags = F.when(complete, F.array_remove(flags, "id_incomplet")).otherwise(flags)

    def pick(value, name):
        return F.when(fresh, value).otherwise(F.col(f"o_{name}")).alias(name)

    same_id = F.coalesce("o_reviewed_id", F.lit(False)) & F.col("o_student_id").eqNullSafe(F.col("n_student_id"))
    read = {"open_answers": F.when(human & (F.coalesce(F.size("o_open_answers"), F.lit(0)) > 0), F.col("o_open_answers")).otherwise(F.col("n_open_answers")),
            "cv_open_answers": F.col("n_open_answers")} if free else {}
    return both.select(
        *key, pick(F.when(edited_id, F.col("o_student_id")).otherwise(F.col("n_student_id")), "student_id"),
        pick(F.coalesce("o_student_name", F.lit("")), "student_name"),
        pick(F.when(human, F.coalesce("o_answers", "n_answers")).otherwise(F.col("n_answers")), "answers"),
        pick(F.col("n_cv_answers"), "cv_answers"), pick(flags, "flags"), pick(kept_cell_marks(), "reviewed_cells"),
        pick(kept_question_marks(), "reviewed_questions"), pick(same_id, "reviewed_id"),
        pick(F.when(human, F.col("o_student_override")), "student_override"), pick(F.when(human, F.col("o_cv_student_id")), "cv_student_id"),
        *[pick(F.col(f"n_{c}"), c) for c in machine], *[pick(read[c], c) for c in free])
