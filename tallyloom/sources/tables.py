"""Header-less sheets, delimiters, scans and capture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ordering import with_rank, with_running_sums

# Candidate separators in order of preference, and file kinds read as sheets.
DELIMITERS = (";", ",", "\t", "|")
EXTENSIONS = (".csv", ".tsv", ".txt")
SNIFF_LINES = 10
# Fixed value: names of documents that are produced by the exam itself, not scanned copies.
ARTIFACT = r"(?i)^(?:exam|DOC-.*|amc-compiled.*|(?:corrige|solution|sujet|calage)(?:[-_].*)?|.*[-_](?:corrige|solution|sujet|calage)(?:[-_].*)?)$"


def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """Separator of each source from its first lines: ``lines(src, line_no, line)``.

    The best one cuts most lines into one same number of fields, then into more fields; the
    first candidate wins a tie and the comma is the default.
    """
    head = lines.filter((F.col("line_no") < SNIFF_LINES) & (F.trim("line") != ""))
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    counted = head.select("src", "line", F.explode(order).alias("o")).select(
        "src", "o.i", "o.d", (F.length("line") - F.length(F.replace("line", F.col("o.d"), F.lit("")))).alias("n")).filter("n > 0")
    modes = counted.groupBy("src", "i", "d", "n").agg(F.count("*").alias("k"))
    best = modes.groupBy("src").agg(F.max_by("d", F.struct("k", "n", -F.col("i"))).alias("d"))
    return lines.select("src").distinct().join(best, "src", "left").select("src", F.coalesce("d", F.lit(",")).alias("delimiter"))


def split_lines(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """Lines as ``cells`` padded to the widest row of their source; blank cells are null, a byte-order mark is dropped."""
    clean = F.regexp_replace("line", "^﻿", "")
    cut = lines.join(delimiters, "src").select(
        "src", "line_no", F.call_function("split", clean, F.concat(F.lit(r"\Q"), F.col("delimiter"), F.lit(r"\E"))).alias("c"))
    width = cut.groupBy("src").agg(F.max(F.size("c")).alias("w"))
    padded = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.nullif(F.coalesce(F.get("c", i), F.lit("")), F.lit("")))
    return cut.join(width, "src").select("src", F.col("line_no").alias("row_no"), padded.alias("cells"))


def select_sheet(table: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of one sheet of ``table(sheet, row_no, cells)``: the named one, else the only or first one.

    A named sheet that is missing raises, it is never replaced by another.
    """
    if sheet is None:
        first = table.agg(F.min("sheet"))
        return table.filter(F.col("sheet") == first.scalar())
    rows = table.filter(F.col("sheet") == sheet)
    if rows.isEmpty():
        present = sorted(r["sheet"] for r in table.select("sheet").distinct().limit(50).collect())
        raise ValueError(f"no sheet {sheet!r}; present: {', '.join(present)}")
    return rows


def read_table(spark: SparkSession, path: str, sheet: str | None = None, n_columns: int | None = None) -> DataFrame:
    """``(row_no, cells)`` of one delimited file, or of one sheet of a folder partitioned by ``sheet=``.

    The columns are addressed by position. A named sheet that is missing raises: falling back to
    another one would give a plausible, wrong result.
    """
    if sheet is not None:
        sheets = spark.read.text(path).select("sheet").distinct()
        if sheets.filter(F.col("sheet") == sheet).isEmpty():
            found = sorted(r["sheet"] for r in sheets.limit(50).collect())
            raise ValueError(f"no sheet {sheet!r}; present: {', '.join(found)}")
        path = f"{path}/sheet={sheet}"
    elif not path.lower().endswith(EXTENSIONS) and "." in path.rsplit("/", 1)[-1]:
        raise ValueError(f"unsupported file: {path}")
    text = spark.read.text(path)
    head = [r["value"] for r in text.limit(SNIFF_LINES).collect()]
    probe = spark.createDataFrame([("f", i, line) for i, line in enumerate(head)] or [("f", 0, "")], "src string, line_no int, line string")
    delimiter = sniff_delimiter(probe).first()["delimiter"]
    widest, broken = table_shape(spark, path, delimiter)
    widest = n_columns or widest
    schema = ", ".join(f"c{i} string" for i in range(widest))
    # only cells with line ends need a whole file in one task; else large files are cut into splits
    rows = spark.read.csv(path, schema=schema, sep=delimiter, header=False, multiLine=broken, encoding="UTF-8", mode="PERMISSIVE", escape='"')
    cells = F.array(*[F.nullif(F.regexp_replace(f"c{i}", "^\ufeff", ""), F.lit("")) for i in range(widest)])
    placed = rows.select(cells.alias("cells"), *_place())
    return with_rank(placed, ["_file", "_start", "_place"], name="_rank").select((F.col("_rank") - 1).alias("row_no"), "cells")


def _place() -> list:
    # inside a split the ids follow the rows, and splits of a file follow their offsets
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place")]


def table_shape(spark: SparkSession, path: str, delimiter: str) -> tuple[int, bool]:
    """Cells of the widest row of all files (at least 1), and whether a quoted cell holds a line end.

    Works line by line. Each line tells how many separators lie outside quotes for either state at its
    start; the state is the parity of the quotes before it, and a row ends where the parity is even.
    """
    parts = F.split("value", '"')
    marks = F.transform(parts, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))

    def total(parity):
        return F.aggregate(F.filter(marks, lambda x, i: i % 2 == parity), F.lit(0), lambda a, x: a + x)

    lines = spark.read.text(path).select(
        *_place(), (F.size(parts) - 1).alias("quotes"), total(0).alias("outside"), total(1).alias("inside"))
    row = lines.agg(F.max("outside").alias("widest"), F.coalesce(F.bool_or(F.col("quotes") % 2 == 1), F.lit(False)).alias("broken")).first()
    if not row["broken"]:
        return (row["widest"] or 0) + 1, False
    order = ["_start", "_place"]
    met = with_running_sums(lines, order, ["_file"], {"met": "quotes"})
    ended = met.withColumn("ends", (F.col("met") % 2 == 0).cast("int")) \
        .withColumn("n", F.when((F.col("met") - F.col("quotes")) % 2 == 0, F.col("outside")).otherwise(F.col("inside")))
    rows = with_running_sums(ended, order, ["_file"], {"row": "ends"}).withColumn("row", F.col("row") - F.col("ends"))
    widest = rows.groupBy("_file", "row").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    return widest + 1, True


def discover_scans(files: DataFrame, explicit: DataFrame, excluded: DataFrame) -> DataFrame:
    """Scans to process: the listed ones, else those found, less the excluded and the exam's own documents.

    ``files(project, name)``; ``explicit(project, name)`` replaces discovery for its project.
    """
    listed = explicit.select("project").distinct()
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    found = files.join(listed, "project", "left_anti").filter(F.lower("name").endswith(".pdf") & ~stem.rlike(ARTIFACT))
    return explicit.select("project", "name").unionByName(found.select("project", "name")).join(excluded, ["project", "name"], "left_anti")


def copy_files(captures: DataFrame, page: int = 1) -> DataFrame:
    """Scanned page behind each copy: ``captures(copy, src, page, ord)``; the last readable one wins."""
    pattern = r"(\d+)_.*pdf-page-(\d+)-"
    parsed = captures.filter(F.col("page") == page).select(
        "copy", "ord", F.regexp_extract("src", pattern, 1).alias("b"), F.regexp_extract("src", pattern, 2).try_cast("int").alias("scan_page"))
    return parsed.filter("b <> '' AND scan_page IS NOT NULL").groupBy("copy").agg(
        F.max_by(F.struct(F.concat(F.lit("batch"), F.col("b")).alias("batch"), "scan_page"), "ord").alias("f")).select("copy", "f.batch", "f.scan_page")


def read_captures(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Capture table over JDBC, read in ranges when the caller gives a partition column."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
