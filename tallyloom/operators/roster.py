"""Student lists: reading columns out of raw sheets, their profile and their defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import zfill
from tallyloom.functions.text import cell_text, norm_name
from tallyloom.session import durable

MIN_ID_WIDTH = 3
ALPHABETIC = r"^\p{L}[^\d]*$"


class RosterError(ValueError):
    """The chosen columns do not fit the sheet."""


def cell(index: int | None) -> Column:
    if index is None or index < 0:
        return F.lit("")
    return cell_text(F.get("cells", F.lit(index)))


def column_index(header: list[str], name: str) -> int:
    """Index of a named column; a missing one raises and lists those present."""
    if name not in header:
        present = ", ".join(h for h in header if h) or "(none)"
        raise RosterError(f"no column {name!r} in this sheet; present: {present}")
    return header.index(name)


def load_students(table: DataFrame, id_idx: int, nom_idx: int, prenom_idx: int | None = None,
                  mail_idx: int | None = None, data_start: int = 1, by: str | None = None) -> DataFrame:
    """Students of a raw table, rows without a number dropped, lost leading zeros restored; with ``by``, of each of its sheets."""
    rows = table.filter(F.col("row_no") >= data_start).select(
        cell(id_idx).alias("id"), cell(nom_idx).alias("nom"), cell(prenom_idx).alias("prenom"),
        cell(mail_idx).alias("email"), F.col("row_no").alias("ord"), *([by] if by else []))
    return pad_leading_zeros(rows.filter("id <> ''"), by=by)


def pad_leading_zeros(students: DataFrame, share: float = 0.8, by: str | None = None) -> DataFrame:
    """Zero-fill short numeric ids when one width covers ``share`` of the (two or more) numeric ids; with ``by``, of those of the same value."""
    numeric = F.col("id").rlike("^[0-9]+$")
    widths = students.filter(numeric).groupBy(*([by] if by else []), F.length("id").alias("w")).agg(
        F.count("*").alias("n"), F.min("ord").alias("first"))
    total = F.sum("n")
    best = F.max_by("w", F.struct("n", -F.col("first")))
    chosen = F.when((total >= 2) & (F.max("n") >= total * share), best)
    if by:
        named = widths.groupBy(F.col(by).alias("_by")).agg(chosen.alias("_w"))
        padded = F.when(numeric & F.col("_w").isNotNull(), zfill("id", F.col("_w"))).otherwise(F.col("id"))
        return students.join(named, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("id", padded).select(students.columns)
    chosen = widths.agg(chosen.alias("w"))
    padded = F.when(numeric & chosen.scalar().isNotNull(), zfill("id", chosen.scalar())).otherwise(F.col("id"))
    return students.withColumn("id", padded)


def roster_report(students: DataFrame, id_width: int | None = None) -> DataFrame:
    """Counts of defects in one row."""
    numeric = F.col("id").rlike("^[0-9]+$")
    per_id = students.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(F.trim("nom") == "").alias("blank"))
    widest = F.max(F.when(numeric, F.length("id")))
    return per_id.agg(
        F.sum("n").alias("n_students"), F.count_if(F.col("n") > 1).alias("n_dup"),
        F.coalesce(F.sum(F.when(~numeric, F.col("n"))), F.lit(0)).alias("n_non_numeric"),
        F.sum("blank").alias("n_empty_names"),
        F.array_join(F.array_sort(F.collect_set(F.when(numeric, F.length("id")))).cast("array<string>"), ",").alias("widths"),
        F.coalesce(F.lit(id_width) > widest, F.lit(False)).alias("grid_too_wide"))


def roster_problems(report: DataFrame, same_column: bool = False) -> DataFrame:
    """One row per defect of a report, in the order they are shown."""
    def row(order, test, code, detail):
        return F.when(test, F.struct(F.lit(order).alias("ord"), F.lit(code).alias("problem"), detail.cast("string").alias("detail")))

    rows = F.array_compact(F.array(
        row(1, F.lit(same_column), "same_column", F.lit("")),
        row(2, F.col("n_dup") > 0, "duplicate_ids", F.col("n_dup")),
        row(3, F.col("n_non_numeric") > 0, "non_numeric_ids", F.col("n_non_numeric")),
        row(4, F.col("n_empty_names") > 0, "empty_names", F.col("n_empty_names")),
        row(5, F.col("widths").contains(","), "mixed_widths", F.col("widths")),
        row(6, F.col("grid_too_wide"), "grid_too_wide", F.col("widths"))))
    return report.select(F.explode(rows).alias("p")).select("p.ord", "p.problem", "p.detail")


# ------------------------------------------------------------ sheet analysis


def filled_cells(table: DataFrame) -> DataFrame:
    """Long form of a sheet: one row per non-empty cell."""
    return table.select("sheet", "row_no", F.posexplode("cells").alias("col", "raw")) \
        .withColumn("txt", cell_text("raw")).filter("txt <> ''")


def profile(table: DataFrame) -> DataFrame:
    """Per column: digit rows of the modal width, alphabetic rows, e-mails, upper-case ratio."""
    kind = F.when(F.col("txt").rlike("^[0-9]+$"), "digit").when(
        F.col("txt").rlike(ALPHABETIC), F.when(F.col("txt").contains("@"), "mail").otherwise("alpha"))
    cells = filled_cells(table).withColumn("kind", kind)
    widths = cells.groupBy("sheet", "col", "kind", F.when(F.col("kind") == "digit", F.length("txt")).alias("w")).agg(
        F.count("*").alias("n"), F.min("row_no").alias("first"),
        F.count_if(F.col("txt") == F.upper("txt")).alias("n_upper"))
    digit, alpha = F.col("kind") == "digit", F.col("kind") == "alpha"
    rank = F.struct(F.when(digit, F.col("n")).otherwise(-1), -F.col("first"))
    n_alpha = F.coalesce(F.sum(F.when(alpha, F.col("n"))), F.lit(0))
    return widths.groupBy("sheet", "col").agg(
        F.coalesce(F.max(F.when(digit, F.col("n"))), F.lit(0)).alias("n_digit"),
        F.coalesce(F.max_by(F.when(digit, F.col("w")), rank), F.lit(0)).alias("modal_width"),
        n_alpha.alias("n_alpha"), F.coalesce(F.sum(F.when(F.col("kind") == "mail", F.col("n"))), F.lit(0)).alias("n_email"),
        F.coalesce(F.try_divide(F.sum(F.when(alpha, F.col("n_upper"))), n_alpha), F.lit(0.0)).alias("upper_ratio"))


#: rows whose presence is held in one number
BLOCK = 48


def first_run(rows: DataFrame, keys: list[str], length: int = 3) -> DataFrame:
    """First index that starts ``length`` consecutive present rows, else the first row.

    The rows of a block of ``BLOCK`` are the bits of one number, and the next block's first ones follow them, so that every
    run lies in a block. A row is met once, but for those few, and whatever the size of a sheet nothing is gathered.
    """
    if not 1 <= length <= 64 - BLOCK:
        raise ValueError(f"length must be 1 to {64 - BLOCK}")
    kind = rows.schema["row_no"].dataType
    at = F.pmod(F.col("row_no").cast("long"), F.lit(BLOCK))
    block = ((F.col("row_no") - at) / BLOCK).cast("long")
    own = F.struct(block.alias("block"), at.cast("int").alias("bit"))
    before = F.struct((block - 1).alias("block"), (at + BLOCK).cast("int").alias("bit"))
    placed = rows.filter("row_no IS NOT NULL").select(*keys, F.explode(F.when(at < length - 1, F.array(own, before)).otherwise(F.array(own))).alias("p"))
    one = F.lit(1).cast("long")
    blocks = placed.groupBy(*keys, "p.block").agg(F.bit_or(F.call_function("shiftleft", one, F.col("p.bit"))).alias("bits"))
    runs = F.col("bits")
    for i in range(1, length):
        runs = runs.bitwiseAND(F.shiftright("bits", i))

    def lowest(bits):
        return F.when(bits != 0, F.col("block") * BLOCK + F.bit_count(bits.bitwiseAND(-bits) - 1)).cast(kind)

    present = F.col("bits").bitwiseAND(F.lit((1 << BLOCK) - 1))
    return blocks.select(*keys, lowest(runs).alias("run"), lowest(present).alias("low")).groupBy(*keys).agg(
        F.coalesce(F.min("run"), F.min("low")).alias("data_start"))


def column_labels(table: DataFrame, starts: DataFrame) -> DataFrame:
    """Last non-blank text above the data of each column, else ``Colonne n``."""
    width = table.groupBy("sheet").agg(F.max(F.size("cells")).alias("ncol"))
    columns = width.select("sheet", F.explode(F.sequence(F.lit(0), F.col("ncol") - 1)).alias("col"))
    above = filled_cells(table).join(starts, "sheet").filter(F.col("row_no") < F.col("data_start"))
    found = above.groupBy("sheet", "col").agg(F.max_by("txt", "row_no").alias("label"))
    default = F.concat(F.lit("Colonne "), (F.col("col") + 1).cast("string"))
    return columns.join(found, ["sheet", "col"], "left").select("sheet", "col", F.coalesce("label", default).alias("label"))


def analyze_roster(table: DataFrame, id_width: int | None = None) -> DataFrame:
    """Guessed columns of each sheet: number, family name, first name, e-mail and first data row.

    Data start at the first run of numbers of ``id_width`` digits, or of the most frequent width if it is not given.
    """
    prof = durable(profile(table))  # one row per column
    score = F.when(F.col("modal_width") >= MIN_ID_WIDTH, F.col("n_digit")).otherwise(0)
    picks = prof.groupBy("sheet").agg(
        F.max(score).alias("id_score"), F.max_by("col", F.struct(score, -F.col("col"))).alias("id_col"),
        F.max_by("modal_width", F.struct(score, -F.col("col"))).alias("id_width"),
        F.max("n_email").alias("mail_score"), F.max_by("col", F.struct("n_email", -F.col("col"))).alias("mail_col"))
    picks = picks.select(
        "sheet", "id_width", F.when(F.col("id_score") >= 2, F.col("id_col")).otherwise(-1).alias("id_idx"),
        F.when(F.col("mail_score") >= 2, F.col("mail_col")).otherwise(-1).alias("mail_idx"))
    # a sheet has a few dozen columns, so this window is short
    by_alpha = Window.partitionBy("sheet").orderBy(F.desc("n_alpha"), "col")
    names = prof.join(picks, "sheet").filter((F.col("col") != F.col("id_idx")) & (F.col("n_alpha") >= 2)) \
        .withColumn("rn", F.row_number().over(by_alpha)).filter("rn <= 2")
    names = names.groupBy("sheet").agg(
        F.count("*").alias("n_names"), F.min("col").alias("left_col"), F.max("col").alias("right_col"),
        F.min_by("upper_ratio", "col").alias("left_upper"), F.max_by("upper_ratio", "col").alias("right_upper"))
    swapped = F.col("right_upper") > F.col("left_upper") + 0.3
    width = F.col("id_width") if id_width is None else F.lit(id_width)
    id_rows = filled_cells(table).join(picks, "sheet").filter(
        (F.col("col") == F.col("id_idx")) & F.col("txt").rlike("^[0-9]+$") & (F.length("txt") == width))
    starts = first_run(id_rows, ["sheet"])
    return picks.join(names, "sheet", "left").join(starts, "sheet", "left").select(
        "sheet", "id_idx",
        F.when(F.col("n_names") == 2, F.when(swapped, F.col("right_col")).otherwise(F.col("left_col")))
         .otherwise(F.coalesce("left_col", F.lit(-1))).alias("nom_idx"),
        F.when(F.col("n_names") == 2, F.when(swapped, F.col("left_col")).otherwise(F.col("right_col")))
         .otherwise(-1).alias("prenom_idx"),
        "mail_idx", F.coalesce("data_start", F.lit(1)).alias("data_start"))


def sheet_summaries(table: DataFrame, id_width: int | None = None) -> DataFrame:
    """Rows, columns and usable students of every sheet; null students when not understood. ``id_width`` as in ``analyze_roster``."""
    sizes = table.groupBy("sheet").agg(F.count("*").alias("nrow"), F.max(F.size("cells")).alias("ncol"))
    guess = analyze_roster(table, id_width)
    usable = table.join(guess.filter("id_idx >= 0 AND nom_idx >= 0"), "sheet").filter(
        (F.col("row_no") >= F.col("data_start")) & (cell_text(F.get("cells", F.col("id_idx"))) != ""))
    counts = usable.groupBy("sheet").agg(F.count("*").alias("n_students"))
    return sizes.join(counts, "sheet", "left")


# ------------------------------------------------------------ ambiguities


def full_name() -> Column:
    return F.concat_ws(" ", F.col("nom"), F.col("prenom"))


def collisions(students: DataFrame, width: int) -> DataFrame:
    """Number endings of ``width`` digits shared by several students."""
    ending = F.right("id", F.lit(width))
    fits = (F.length("id") >= width) & ending.rlike("^[0-9]+$")
    return students.filter(fits).groupBy(ending.alias("suffix")).agg(F.count("*").alias("n_students")).filter("n_students > 1")


def collision_members(students: DataFrame, width: int) -> DataFrame:
    """The students of each shared ending, one row each (a group may be large)."""
    return students.withColumn("suffix", F.right("id", F.lit(width))).join(collisions(students, width), "suffix", "left_semi")


def homonyms(students: DataFrame) -> DataFrame:
    """Students whose normalised name an earlier one already carries: they leave the name index."""
    named = students.withColumn("norm", norm_name(full_name()))
    first = named.groupBy("norm").agg(F.min("ord").alias("first"))
    return named.join(first, "norm").filter(F.col("ord") > F.col("first")).drop("first")


def name_index(students: DataFrame) -> DataFrame:
    """``(norm, id)``: the first student of each normalised name."""
    return students.groupBy(norm_name(full_name()).alias("norm")).agg(F.min_by("id", "ord").alias("id")).filter("norm <> ''")


def warnings(students: DataFrame, id_width: int) -> DataFrame:
    """What makes a link ambiguous: counts of homonyms and shared endings, with the first examples."""
    spare = homonyms(students).select(full_name().alias("who")).distinct()
    five = spare.orderBy("who").limit(5)
    a = spare.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("homonyms").alias("warning"), "n")
    ex_a = five.agg(F.array_join(F.array_sort(F.collect_list("who")), ", ").alias("examples"))
    shared = collisions(students, id_width)
    b = shared.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("collisions").alias("warning"), "n")
    ex_b = shared.orderBy("suffix").limit(3).agg(F.array_join(F.array_sort(F.collect_list("suffix")), ", ").alias("examples"))
    return a.withColumn("examples", ex_a.scalar()).unionByName(b.withColumn("examples", ex_b.scalar()))
