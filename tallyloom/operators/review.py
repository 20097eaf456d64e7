"""Review of doubtful cells: flags, open work, the queue, and edits made by people.

Cells are rows ``(copy_key, q, ch)``. Structural flags are recomputed from the current answers;
measured flags are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.answers import match_answer
from tallyloom.functions.numbers import uncertainty
from tallyloom.functions.text import cell_key, split_cell_key
from tallyloom.operators.ordering import with_neighbours
from tallyloom.operators.scoring import belongs, key_by_copy_group

CELL = ["copy_key", "q", "ch"]
# Reasons and flags as stored.
NO_ANSWER, MULTI_ANSWER, STRUCTURAL, DIFF = "no_answer", "multi_answer", "structural", "diff"


def edited_cells(current: DataFrame, machine: DataFrame) -> DataFrame:
    """Cells ticked on one side only; one shuffle for both directions."""
    sides = current.select(*CELL, F.lit(1).alias("s")).unionByName(machine.select(*CELL, F.lit(2).alias("s")))
    return sides.groupBy(*CELL).agg(F.bit_or("s").alias("s")).filter("s <> 3").select(*CELL)


def reviewed_cells(marks: DataFrame, edited: DataFrame) -> DataFrame:
    """Cells marked by hand (``marks(copy_key, cell)``) or edited; unreadable keys are ignored."""
    q, ch = split_cell_key("cell")
    marked = marks.select("copy_key", q.alias("q"), ch.alias("ch")).filter("q IS NOT NULL AND ch <> ''")
    return marked.unionByName(edited.select(*CELL)).distinct()


def reviewed_questions(marks: DataFrame) -> DataFrame:
    """``marks(copy_key, question)`` as numbers; bad ones are ignored."""
    return marks.select("copy_key", F.trim("question").try_cast("int").alias("q")).filter("q IS NOT NULL").distinct()


def flagged_cells(diffs: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Measured flags of each cell with merged reasons; a stored structural reason is dropped."""
    kept = ambiguous.withColumn("reasons", F.array_distinct(F.filter("reasons", lambda r: r != STRUCTURAL))).filter(F.size("reasons") > 0)
    left = diffs.select(*CELL, "cv", "amc", F.array(F.lit(DIFF)).alias("_d"))
    right = kept.select(*CELL, "reasons", "ratio", "masked", "proba")
    none = F.array().cast("array<string>")
    merged = F.array_distinct(F.concat(F.coalesce("_d", none), F.coalesce("reasons", none)))
    return left.join(right, CELL, "full").select(*CELL, merged.alias("reasons"), "cv", "amc", "ratio", "masked", "proba")


def structural_reason(qtype, n_selected) -> Column:
    n = F.coalesce(F.col(n_selected), F.lit(0))
    return F.when((F.col(qtype) if isinstance(qtype, str) else qtype) == "single", F.when(n == 0, NO_ANSWER).when(n > 1, MULTI_ANSWER))


def structural_flags(copies: DataFrame, current: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """``(copy_key, q, reason)`` of single questions with no or several valid ticks."""
    picked = current.join(options.select("q", "ch"), ["q", "ch"]).groupBy("copy_key", "q").agg(F.count("*").alias("n"))
    single = key_by_copy_group(questions.filter("qtype = 'single'").select("q", "qtype", "grp"), copies).select("q", "qtype", "copy_grp")
    asked = copies.select("copy_key", F.col("grp").alias("copy_grp")).join(single, "copy_grp")
    return asked.join(picked, ["copy_key", "q"], "left").select(
        "copy_key", "q", structural_reason("qtype", "n").alias("reason")).filter("reason IS NOT NULL")


def judged_cells(copies: DataFrame, flags: DataFrame, reviewed: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Flagged cells that are options of the copy's questions, each open or not."""
    valid = options.select("q", "ch").join(questions.select("q", F.col("grp").alias("q_grp")), "q")
    cells = flags.join(valid, ["q", "ch"]).join(copies.select("copy_key", "grp", "validated"), "copy_key") \
        .filter(belongs(F.col("q_grp"), F.col("grp")))
    seen = reviewed.withColumn("_seen", F.lit(True))
    return cells.join(seen, CELL, "left").select(
        *CELL, "reasons", "proba", (F.col("validated") | F.coalesce("_seen", F.lit(False))).alias("reviewed"))


def review_items(copies: DataFrame, cells: DataFrame, structure: DataFrame, done: DataFrame) -> DataFrame:
    """One row per question with something to look at.

    Risk adds up what is still open; ambiguity is the largest doubt of the measure, whatever was reviewed.
    """
    doubt = uncertainty("proba")
    per = cells.groupBy("copy_key", "q").agg(
        F.count("*").alias("n_cells"), F.count_if(~F.col("reviewed")).alias("n_open_cells"),
        F.coalesce(F.sum(F.when(~F.col("reviewed"), 1.0 + doubt)), F.lit(0.0)).alias("cell_risk"), F.max(doubt).alias("cell_doubt"))
    finished = done.withColumn("_done", F.lit(True))
    reasons = structure.join(copies.select("copy_key", "validated"), "copy_key").join(finished, ["copy_key", "q"], "left").select(
        "copy_key", "q", "reason", (~(F.col("validated") | F.coalesce("_done", F.lit(False)))).cast("int").alias("open_reason"))
    both = per.join(reasons, ["copy_key", "q"], "full")
    open_reason = F.coalesce("open_reason", F.lit(0))
    return both.select(
        "copy_key", "q", "reason", (F.coalesce("n_cells", F.lit(0)) + F.col("reason").isNotNull().cast("int")).alias("n_flagged"),
        (F.coalesce("n_open_cells", F.lit(0)) + open_reason).alias("n_open"),
        (F.coalesce("cell_risk", F.lit(0.0)) + open_reason).alias("risk"),
        F.round(F.greatest("cell_doubt", F.when(F.col("reason").isNotNull(), 0.5)), 4).alias("ambiguity"))


# ---- the same from one row per cell


CURRENT, MACHINE, SECOND, MARKED = 1, 2, 4, 8


def cell_states(current: DataFrame, machine: DataFrame, second: DataFrame, ambiguous: DataFrame, marks: DataFrame) -> DataFrame:
    """``(copy_key, q, ch, s, m)``: everything known of a cell in one row: one aggregation over all readings, met by the measures.

    ``s`` has a bit for each reading that ticks the cell (``CURRENT``, ``MACHINE``, ``SECOND``) and for a mark made by hand (``MARKED``);
    ``m`` holds the stored reasons and measures. Every rule of a review is a projection of this row; repeats change nothing.
    """
    q, ch = split_cell_key("cell")
    by_hand = marks.select("copy_key", q.alias("q"), ch.alias("ch")).filter("q IS NOT NULL AND ch <> ''")
    kind = "struct<reasons:array<string>,ratio:double,masked:double,proba:double>"
    measured = ambiguous.select(*CELL, F.struct("reasons", F.col("ratio").cast("double"), F.col("masked").cast("double"), F.col("proba").cast("double")).cast(kind).alias("m"))
    held = measured.groupBy(*CELL).agg(F.first("m", ignorenulls=True).alias("m"))
    rows = by_hand.select(*CELL, F.lit(MARKED).alias("s"))
    for source, bit in ((current, CURRENT), (machine, MACHINE), (second, SECOND)):
        rows = rows.unionByName(source.select(*CELL, F.lit(bit).alias("s")))
    bits = rows.groupBy(*CELL).agg(F.bit_or("s").alias("s"))  # numbers alone are hashed, not sorted
    return bits.join(held, CELL, "full").select(*CELL, F.coalesce("s", F.lit(0)).alias("s"), "m")


def has(bit: int) -> Column:
    return F.col("s").bitwiseAND(F.lit(bit)) != 0


def placed_cells(copies: DataFrame, states: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Cells that are options of the questions their copy carries: their state, reasons, ``flagged`` and ``reviewed``."""
    valid = options.select("q", "ch").join(questions.select("q", F.col("grp").alias("q_grp")), "q")
    cells = states.join(valid, ["q", "ch"]).join(copies.select("copy_key", "grp", "validated"), "copy_key").filter(belongs(F.col("q_grp"), F.col("grp")))
    none = F.array().cast("array<string>")
    kept = F.filter(F.coalesce("m.reasons", none), lambda r: r != STRUCTURAL)
    reasons = F.array_distinct(F.concat(F.when(has(MACHINE) != has(SECOND), F.array(F.lit(DIFF))).otherwise(none), kept))
    return cells.select(*CELL, "validated", has(CURRENT).alias("on"), reasons.alias("reasons"), (F.size(reasons) > 0).alias("flagged"),
                        F.when(F.size(kept) > 0, F.col("m.proba")).alias("proba"),  # measures belong to stored reasons that count
                        (F.col("validated") | has(MARKED) | (has(CURRENT) != has(MACHINE))).alias("reviewed"))


def _with_reasons(copies: DataFrame, per: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with something to look at: ``per(copy_key, q, n_cells, n_on, ..)`` and the structural reason of single questions."""
    single = key_by_copy_group(questions.filter("qtype = 'single'").select("q", "grp"), copies).select("q", "copy_grp")
    asked = copies.select("copy_key", F.col("validated").alias("_closed"), F.col("grp").alias("copy_grp")).join(single, "copy_grp").drop("copy_grp")
    joined = asked.join(per, ["copy_key", "q"], "full").withColumn("reason", F.when(F.col("_closed").isNotNull(), structural_reason(F.lit("single"), "n_on")))
    return joined.filter("reason IS NOT NULL OR n_cells > 0")


def items_of_states(copies: DataFrame, states: DataFrame, questions: DataFrame, options: DataFrame, done: DataFrame) -> DataFrame:
    """``review_items`` from ``cell_states``: the cells are placed and counted once per question."""
    doubt = uncertainty("proba")
    is_open = F.col("flagged") & ~F.col("reviewed")
    per = placed_cells(copies, states, questions, options).groupBy("copy_key", "q").agg(
        F.count_if("flagged").alias("n_cells"), F.count_if(is_open).alias("n_open_cells"), F.count_if("on").alias("n_on"),
        F.coalesce(F.sum(F.when(is_open, 1.0 + doubt)), F.lit(0.0)).alias("cell_risk"), F.max(F.when(F.col("flagged"), doubt)).alias("cell_doubt"))
    joined = _with_reasons(copies, per, questions).join(done.withColumn("_done", F.lit(True)), ["copy_key", "q"], "left")
    open_reason = (F.col("reason").isNotNull() & ~(F.col("_closed") | F.coalesce("_done", F.lit(False)))).cast("int")
    open_reason = F.coalesce(open_reason, F.lit(0))
    return joined.select(
        "copy_key", "q", "reason", (F.coalesce("n_cells", F.lit(0)) + F.col("reason").isNotNull().cast("int")).alias("n_flagged"),
        (F.coalesce("n_open_cells", F.lit(0)) + open_reason).alias("n_open"), (F.coalesce("cell_risk", F.lit(0.0)) + open_reason).alias("risk"),
        F.round(F.greatest("cell_doubt", F.when(F.col("reason").isNotNull(), 0.5)), 4).alias("ambiguity"))


def judged_of_states(copies: DataFrame, states: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """``judged_cells`` from ``cell_states``."""
    return placed_cells(copies, states, questions, options).filter("flagged").select(*CELL, "reasons", "proba", "reviewed")


def context_of_states(copies: DataFrame, states: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """``item_context`` from ``cell_states``: the known cells of a question travel as one short list, so no join is by cell."""
    cell = F.struct("ch", "on", "flagged", (F.col("flagged") & F.col("reviewed")).alias("reviewed"), F.array_join("reasons", ";").alias("reasons"))
    per = placed_cells(copies, states, questions, options).groupBy("copy_key", "q").agg(
        F.count_if("flagged").alias("n_cells"), F.count_if("on").alias("n_on"), F.collect_list(cell).alias("_cells"))
    own = F.get(F.filter("_cells", lambda c: c["ch"] == F.col("ch")), F.lit(0))
    context = _with_reasons(copies, per, questions).select("copy_key", "q", "_cells").join(options.select("q", "ch", "correct"), "q").withColumn("_own", own)
    return context.select(*CELL, F.coalesce("_own.on", F.lit(False)).alias("selected"), "correct", F.coalesce("_own.flagged", F.lit(False)).alias("flagged"),
                          F.coalesce("_own.reviewed", F.lit(False)).alias("reviewed"), F.coalesce("_own.reasons", F.lit("")).alias("reasons"))


def copy_review(items: DataFrame) -> DataFrame:
    return items.groupBy("copy_key").agg(
        F.count("*").alias("n_questions"), F.sum("n_flagged").alias("n_flagged"), F.sum("n_open").alias("n_open"),
        F.round(F.sum("risk"), 3).alias("risk"), F.max("ambiguity").alias("ambiguity"))


def item_context(items: DataFrame, options: DataFrame, current: DataFrame, cells: DataFrame) -> DataFrame:
    """Every option of the questions to review, flagged or not, with its current state."""
    context = items.select("copy_key", "q").join(options.select("q", "ch", "correct"), "q")
    ticked = current.select(*CELL).distinct().withColumn("_on", F.lit(True))
    marked = cells.select(*CELL, F.col("reviewed").alias("_rev"), F.array_join("reasons", ";").alias("reasons"))
    return context.join(ticked, CELL, "left").join(marked, CELL, "left").select(
        *CELL, F.coalesce("_on", F.lit(False)).alias("selected"), "correct", F.col("_rev").isNotNull().alias("flagged"),
        F.coalesce("_rev", F.lit(False)).alias("reviewed"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def review_queue(copies: DataFrame, reviews: DataFrame, identity: DataFrame) -> DataFrame:
    """Copies with doubtful answers or identity (``identity(copy_key, id_state)``), worst first."""
    joined = copies.select("copy_key", "batch", "page").join(reviews, "copy_key", "left").join(identity, "copy_key", "left")
    bad = F.col("id_state").isNotNull().cast("int")
    rows = joined.filter("n_questions IS NOT NULL OR id_state IS NOT NULL").select(
        "copy_key", "batch", "page", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), "id_state",
        F.coalesce("n_flagged", F.lit(0)).alias("n_cell_flags"), (F.coalesce("n_open", F.lit(0)) + bad).alias("n_open"),
        (F.coalesce("risk", F.lit(0.0)) + bad).alias("risk"), F.coalesce("ambiguity", F.lit(0.0)).alias("ambiguity"))
    return rows.orderBy(F.desc("ambiguity"), F.desc("risk"), "batch", "page")


def queue_totals(queue: DataFrame) -> DataFrame:
    return queue.agg(F.coalesce(F.sum("n_cell_flags"), F.lit(0)).alias("flagged"), F.count_if(F.col("n_questions") > 0).alias("answers"),
                     F.count_if(F.col("id_state").isNotNull()).alias("identities"))


def open_counts(copies: DataFrame, reviews: DataFrame, identity: DataFrame) -> DataFrame:
    """What is left on each copy, identity included."""
    joined = copies.select("copy_key").join(reviews.select("copy_key", "n_open"), "copy_key", "left").join(identity, "copy_key", "left")
    return joined.select("copy_key", (F.coalesce("n_open", F.lit(0)) + F.col("id_state").isNotNull().cast("int")).alias("n_open"))


def open_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(~F.col("reviewed")).select(*CELL)


# ------------------------------------------------------------ edits


def check_events(events: DataFrame, copies: DataFrame, questions: DataFrame, options: DataFrame) -> dict[str, DataFrame]:
    """Split edits into valid ones and rejects with a reason."""
    known = options.select("q", "ch", F.lit(True).alias("_letter"))
    asked = questions.select("q", F.col("grp").alias("q_grp"))
    joined = events.join(copies.select("copy_key", "grp"), "copy_key", "left").join(asked, "q", "left").join(known, ["q", "ch"], "left")
    reason = F.when(F.col("grp").isNull(), "unknown copy") \
        .when(F.col("q_grp").isNull() | ~belongs(F.col("q_grp"), F.col("grp")), "unknown question") \
        .when(F.col("_letter").isNull(), "letter outside the options")
    judged = joined.withColumn("reason", reason)
    return {"valid": judged.filter("reason IS NULL").select(*events.columns),
            "rejected": judged.filter("reason IS NOT NULL").select(*events.columns, "reason")}


def apply_toggles(current: DataFrame, events: DataFrame) -> DataFrame:
    """Answers after toggles: a cell flips once per event, so only the parity of its events matters."""
    odd = events.groupBy(*CELL).agg((F.count("*") % 2).cast("int").alias("s")).filter("s = 1")
    sides = current.select(*CELL).distinct().withColumn("s", F.lit(1)).unionByName(odd)
    return sides.groupBy(*CELL).agg(F.sum("s").alias("s")).filter("s = 1").select(*CELL)


def toggled_marks(events: DataFrame) -> DataFrame:
    """Editing a cell is a decision about it: the cells that leave the queue."""
    return events.select("copy_key", cell_key("q", "ch").alias("cell")).distinct()


def fold_review_marks(events: DataFrame, columns: list[str]) -> DataFrame:
    """Marks standing after ``reviewed`` true / false events: the last one of each target wins."""
    last = events.groupBy(*columns).agg(F.max_by("reviewed", F.struct("ts", "event_id")).alias("reviewed"))
    return last.filter("reviewed").select(*columns)


def set_id_digits(copies: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Numbers after digit edits at 1-based positions; the first machine reading is kept.

    ``events(copy_key, ts, event_id, position, digit)``. Only the last edit of a position counts.
    """
    last = events.filter(F.col("position").between(1, width) & F.col("digit").rlike("^[0-9?]$")) \
        .groupBy("copy_key", "position").agg(F.max_by("digit", F.struct("ts", "event_id")).alias("digit"))
    per = last.groupBy("copy_key").agg(F.map_from_entries(F.collect_list(F.struct("position", "digit"))).alias("m"))
    base = F.substring(F.rpad(F.coalesce("student_id", F.lit("")), width, "?"), 1, width)
    spelled = F.concat(*[F.coalesce(F.element_at("m", F.lit(i)), F.substring(base, i, 1)) for i in range(1, width + 1)])
    edited = F.col("m").isNotNull()
    return copies.join(per, "copy_key", "left").select(
        *[c for c in copies.columns if c != "student_id"], F.when(edited, spelled).otherwise(F.col("student_id")).alias("student_id"),
        F.when(edited, F.coalesce(F.nullif("student_id", F.lit("")), F.lit("?" * width))).alias("machine_id"), edited.alias("manually_edited"))


def override_open_answers(answers: DataFrame, events: DataFrame, expected: list[str], mode: str, points: float,
                          tolerance: float = 0.01) -> DataFrame:
    """Free answers after corrections: matched and scored again, the machine text kept aside."""
    last = events.groupBy("copy_key", "q").agg(F.max_by("raw_text", F.struct("ts", "event_id")).alias("_new"))
    joined = answers.join(last, ["copy_key", "q"], "left")
    text = F.coalesce("_new", "raw_text")
    hit = match_answer(text, expected, mode, tolerance)
    return joined.select("copy_key", "q", text.alias("raw_text"), F.when(F.col("_new").isNotNull(), F.col("raw_text")).alias("machine_text"),
                         F.when(hit, float(points)).otherwise(0.0).alias("score"), F.col("_new").isNotNull().alias("manually_edited"))


# ------------------------------------------------------------ navigation


def neighbours(copies: DataFrame) -> DataFrame:
    """Previous and next copy in (batch, page) order."""
    keyed = copies.select("copy_key", "batch", "page")
    return with_neighbours(keyed, ["batch", "page", "copy_key"], "copy_key", "previous_key", "next_key")


def sheet_of_question(copies: DataFrame, sheets: DataFrame, boxes: DataFrame) -> DataFrame:
    """Scanned sheet that carries each question.

    ``copies(copy_key, batch, page, copy_id, n_sheets)``; ``sheets(copy_key, batch, page, sheet_page)``
    for copies of several sheets; ``boxes(copy_id, page, q)`` is the layout.
    """
    carried = boxes.select("copy_id", "page", "q").distinct()
    single = copies.filter("n_sheets <= 1").join(carried.select("copy_id", "q").distinct(), "copy_id") \
        .select("copy_key", "q", "batch", "page")
    many = copies.filter("n_sheets > 1").select("copy_key", "copy_id").join(sheets.filter("sheet_page IS NOT NULL"), "copy_key")
    placed = many.join(carried.withColumnRenamed("page", "sheet_page"), ["copy_id", "sheet_page"])
    last = placed.groupBy("copy_key", "q").agg(F.max_by(F.struct("batch", "page"), F.struct("batch", "page")).alias("s"))
    return single.unionByName(last.select("copy_key", "q", "s.batch", "s.page"))
