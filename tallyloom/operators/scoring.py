"""Answer keys and marks.

The key of an exam is a handful of rows per question; readings are the large side. They are
reduced once, by (copy, question), to the set of ticked options kept as a bit mask, so
repeated readings of a cell collapse in the map-side combine and cost no separate distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import frac, frac_or_zero
from tallyloom.operators.ordering import with_rank, with_running_sums


def explode_answers(copies: DataFrame, keys: list[str], answers: str = "answers") -> DataFrame:
    """One row per (copy, question) with its distinct letters in order."""
    exploded = copies.select(*keys, F.explode(answers).alias("q", "letters"))
    return exploded.withColumn("letters", F.array_sort(F.array_distinct("letters")))


def ticked_cells(copies: DataFrame, keys: list[str], answers: str = "answers") -> DataFrame:
    return explode_answers(copies, keys, answers).select(*keys, "q", F.explode("letters").alias("ch"))


# ---------------------------------------------------------------- answer key


def effective_spec(options: DataFrame, copy_letters: DataFrame) -> DataFrame:
    """Letters of each copy zipped with the declared options of the question.

    ``options(q, pos, correct)``, ``copy_letters(copy, q, pos, ch)``. Both letter texts are
    empty when a copy does not carry as many letters as the question has options.
    """
    declared = options.groupBy("q").agg(F.count("*").alias("n_declared"))
    zipped = copy_letters.join(options.select("q", "pos", "correct"), ["q", "pos"], "left")
    spec = zipped.groupBy("copy", "q").agg(
        F.count("*").alias("n_letters"), F.count("correct").alias("n_known"),
        F.array_join(F.array_sort(F.collect_set("ch")), "").alias("options"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("correct"), F.col("ch")))), "").alias("correct"))
    spec = spec.join(declared, "q")
    whole = (F.col("n_letters") == F.col("n_declared")) & (F.col("n_known") == F.col("n_declared"))
    return spec.select("copy", "q", F.when(whole, F.col("options")).otherwise("").alias("options"),
                       F.when(whole, F.col("correct")).otherwise("").alias("correct"))


def option_points(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Value of single questions, points per letter of multiple ones (void if any is unreadable)."""
    per = options.groupBy("q").agg(
        F.min(frac("pts").isNotNull()).alias("readable"), F.count("*").alias("n_options"))
    single = F.col("qtype") == "single"
    return questions.join(per, "q", "left").select(
        "q", "qtype", F.when(single, F.coalesce(frac("value"), F.lit(1.0))).alias("value"),
        F.when(~single, F.coalesce("readable", F.lit(False))).alias("usable"))


def question_key(questions: DataFrame, options: DataFrame, floor: float | None = None,
                 ceiling: float | None = None, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """One row per question: masks, points, bounds, maximum and the score of a blank answer.

    ``questions(q, qtype, value, lo, hi, grp)``, ``options(q, pos, ch, correct, pts)``; ``by`` names the columns that tell questions
    apart, such as exam and q.
    """
    points = frac("pts")
    per = options.select(*by, "pos", "ch", "correct", points.alias("p")).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("pos", "ch", "correct", "p"))).alias("opts"),
        F.min(F.col("p").isNotNull()).alias("readable"),
        F.coalesce(F.sum(F.when(F.col("correct"), F.coalesce("p", F.lit(0.0)))), F.lit(0.0)).alias("right_points"))
    key = questions.join(per, list(by), "left")
    correct_mask = F.aggregate(
        F.coalesce("opts", F.array().cast("array<struct<pos:int,ch:string,correct:boolean,p:double>>")),
        F.lit(0).cast("bigint"),
        lambda acc, o: acc.bitwiseOR(F.when(o["correct"], bit_of(o["pos"])).otherwise(F.lit(0).cast("bigint"))))
    value = F.coalesce(frac("value"), F.lit(1.0))
    single = F.col("qtype") == "single"
    key = key.select(
        *by, "qtype", "grp", value.alias("value"), "opts", correct_mask.alias("correct_mask"),
        F.coalesce("readable", F.lit(False)).alias("readable"),
        F.coalesce(F.col("lo").cast("double"), F.lit(floor).cast("double")).alias("lo"),
        F.coalesce(F.col("hi").cast("double"), F.lit(ceiling).cast("double")).alias("hi"),
        F.when(single, value).otherwise(F.round(F.coalesce("right_points", F.lit(0.0)), 6)).alias("max_score"))
    return key.withColumn("blank_score", question_score(F.lit(0).cast("bigint")))


def bit_of(pos) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), pos.cast("int"))


def question_score(picked: Column) -> Column:
    """Score of a set of ticked options over the columns of :func:`question_key`."""
    total = F.aggregate(F.col("opts"), F.lit(0.0), lambda acc, o: acc + F.when(
        picked.bitwiseAND(bit_of(o["pos"])) != 0, F.coalesce(o["p"], F.lit(0.0))).otherwise(0.0))
    raw = F.when(F.col("qtype") == "single", F.when(picked == F.col("correct_mask"), F.col("value")).otherwise(0.0)) \
        .otherwise(F.when(F.col("readable"), F.round(total, 6)).otherwise(0.0))
    # a null bound is no bound: greatest and least skip it
    return F.least(F.greatest(raw, F.col("lo")), F.col("hi"))


def picked_options(ticks: DataFrame, options: DataFrame) -> DataFrame:
    """``(copy_key, q, picked)``: ticked options as a mask; letters that are no option are ignored."""
    bits = options.select("q", "ch", bit_of(F.col("pos")).alias("bit"))
    joined = ticks.select("copy_key", "q", "ch").join(bits, ["q", "ch"])
    return joined.groupBy("copy_key", "q").agg(F.bit_or("bit").alias("picked"))


def score_questions(ticks: DataFrame, options: DataFrame, key: DataFrame) -> DataFrame:
    """Score of every question that got at least one valid tick, whatever the copy's version."""
    scored = picked_options(ticks, options).join(key, "q")
    return scored.select("copy_key", "q", F.col("grp").alias("q_grp"), "picked", "max_score", "blank_score",
                         question_score(F.col("picked")).alias("score"))


def belongs(question_group: Column, copy_group: Column) -> Column:
    """Common questions carry no group and belong to every version."""
    return (question_group == "") | (question_group == copy_group)


def score_copies(copies: DataFrame, scored: DataFrame, key: DataFrame, total_floor: float | None = None) -> DataFrame:
    """Mark of every copy, unticked questions included.

    A copy starts from the blank score of its version and each answered question adds its
    difference to it, so the (copy x question) grid is never built.
    """
    group_base = key.groupBy(F.col("grp").alias("_g")).agg(F.sum("blank_score").alias("_base"))
    common = key.filter(F.col("grp") == "").agg(F.coalesce(F.sum("blank_score"), F.lit(0.0)))
    moved = F.when(belongs(F.col("q_grp"), F.col("grp")), F.col("score") - F.col("blank_score"))
    sums = copies.join(scored.select("copy_key", "q_grp", "score", "blank_score"), "copy_key", "left") \
        .groupBy("copy_key", "grp").agg(F.coalesce(F.sum(moved), F.lit(0.0)).alias("_moved"))
    based = sums.join(group_base.filter(F.col("_g") != ""), sums["grp"] == F.col("_g"), "left")
    total = F.round(F.col("_moved") + F.coalesce("_base", F.lit(0.0)) + common.scalar(), 4)
    return based.select("copy_key", "grp", F.greatest(total, F.lit(total_floor).cast("double")).alias("total"))


def key_by_copy_group(key: DataFrame, groups: DataFrame) -> DataFrame:
    """Key rows under every copy group they belong to (``copy_grp``), so that copies meet them by equality.

    ``groups(grp)`` are the groups in use: one per version of the subject.
    """
    used = groups.agg(F.collect_set("grp"))
    target = F.when(F.col("grp") == "", used.scalar()).otherwise(F.array("grp"))
    return key.withColumn("copy_grp", F.explode(target))


def copy_questions(copies: DataFrame, scored: DataFrame, key: DataFrame) -> DataFrame:
    """Every question a copy carries with its score, blank ones included."""
    carried = copies.select("copy_key", F.col("grp").alias("copy_grp")).join(
        key_by_copy_group(key.select("q", "grp", "max_score", "blank_score", "correct_mask"), copies), "copy_grp")
    found = scored.select("copy_key", "q", "picked", "score")
    return carried.join(found, ["copy_key", "q"], "left").select(
        "copy_key", "q", "max_score", "correct_mask", F.coalesce("picked", F.lit(0).cast("bigint")).alias("picked"),
        F.coalesce("score", "blank_score").alias("score"))


def mask_letters(mask, opts="opts") -> Column:
    """Letters of a mask, in option order."""
    chosen = F.filter(F.col(opts), lambda o: F.col(mask).bitwiseAND(bit_of(o["pos"])) != 0)
    return F.array_join(F.transform(chosen, lambda o: o["ch"]), "")


def version_total_max(key: DataFrame, versions: DataFrame) -> DataFrame:
    """Maximum of each version group: its questions and the common ones."""
    own = key.groupBy(F.col("grp").alias("_g")).agg(F.sum("max_score").alias("_own"))
    common = key.filter(F.col("grp") == "").agg(F.coalesce(F.sum("max_score"), F.lit(0.0)))
    joined = versions.join(own.filter(F.col("_g") != ""), versions["grp"] == F.col("_g"), "left")
    return joined.select(*versions.columns, F.round(F.coalesce("_own", F.lit(0.0)) + common.scalar(), 6).alias("total_max"))


def copy_total_max(question_map: DataFrame, key: DataFrame) -> DataFrame:
    """Maximum of the questions a copy really carries (``question_map(copy, num, q)``)."""
    return question_map.select("copy", "q").distinct().join(key.select("q", "max_score"), "q") \
        .groupBy("copy").agg(F.round(F.sum("max_score"), 6).alias("total_max"))


def subject_total_max(totals: DataFrame) -> DataFrame:
    """Largest positive maximum over representative copies; 0 means unknown."""
    best = F.max(F.when(F.col("total_max") > 0, F.col("total_max")))
    return totals.agg(F.coalesce(best, F.lit(0.0)).alias("total_max"))


# ------------------------------------------------------------ numbering


def question_map(boxes: DataFrame, names: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """Printed question number <-> document index, per copy.

    ``boxes(copy, num, ch)`` are the answer boxes, ``names(num, name)`` the printed names,
    ``questions(q, tag, n_answers)`` the document. Returns ``qcm`` (copy, num, q), ``ids``
    (copy, num), ``open`` (copy, num, block) and ``issues`` (copy, issue, num).
    """
    per = boxes.groupBy("copy", "num").agg(
        F.count("*").alias("n_boxes"),
        (F.count("ch") > 0).alias("has_char"),
        F.min(F.col("ch").rlike("^[0-9]+$")).alias("all_digits"))
    is_id = F.col("has_char") & F.coalesce("all_digits", F.lit(False))
    ids = per.filter(is_id).select("copy", "num")
    letters = per.filter(~is_id).select("copy", "num", "n_boxes")

    unique_tag = names.select(F.trim("name").alias("tag"), "num").groupBy("tag").agg(
        F.count("*").alias("n"), F.min("num").alias("num")).filter("n = 1").drop("n")
    tagged = questions.withColumn("tag", F.trim(F.coalesce("tag", F.lit("")))).join(unique_tag, "tag", "left")
    # two questions of one tag: the first keeps the number
    by_tag = tagged.filter("num IS NOT NULL").groupBy("num").agg(
        F.min("q").alias("q"), F.min_by("n_answers", "q").alias("n_answers"))
    matched = letters.join(by_tag, "num").select("copy", "num", "q", "n_answers", "n_boxes")

    # the rest is paired by position: the document side is a short list, the same for every copy
    waiting = tagged.filter("num IS NULL").agg(F.array_sort(F.collect_list(F.struct("q", "n_answers"))).alias("w"))
    free = letters.join(matched.select("copy", "num"), ["copy", "num"], "left_anti")
    by_copy = Window.partitionBy("copy").orderBy("num")  # a copy holds a few hundred numbers at most
    placed = free.withColumn("rn", F.row_number().over(by_copy)).withColumn("w", waiting.scalar())
    placed = placed.withColumn("o", F.get("w", F.col("rn") - 1))
    positional = placed.filter("o IS NOT NULL").select("copy", "num", "o.q", "o.n_answers", "n_boxes")
    qcm = matched.unionByName(positional)

    rest = placed.filter("o IS NULL").select("copy", "num", "n_boxes")
    # printed names of grading boxes are `bareme-<block>` (fixed value)
    open_ = rest.join(names.select("num", F.regexp_extract("name", "^bareme-(.*)$", 1).alias("block")), "num", "left") \
        .select("copy", "num", F.nullif("block", F.lit("")).alias("block"))

    sizes = qcm.filter(F.col("n_boxes") != F.col("n_answers")).select(
        "copy", F.lit("box_count").alias("issue"), "num")
    free_count = letters.select("copy").distinct().join(
        placed.groupBy("copy").agg(F.count("*").alias("n_free")), "copy", "left")
    lacking = F.size(waiting.scalar()) - F.coalesce("n_free", F.lit(0))
    missing = free_count.withColumn("lack", lacking).filter("lack > 0").select(
        "copy", F.lit("missing_in_layout").alias("issue"), F.col("lack").cast("int").alias("num"))
    surplus = open_.filter("block IS NULL").select("copy", F.lit("surplus_in_layout").alias("issue"), "num")
    issues = sizes.unionByName(missing).unionByName(surplus)
    return {"qcm": qcm.select("copy", "num", "q"), "ids": ids, "open": open_, "issues": issues}


def version_copy_ranges(versions: DataFrame) -> DataFrame:
    """Contiguous numbering of copies, version after version, inside each subject."""
    size = F.greatest(F.lit(1), F.col("num_copies")).cast("bigint")
    running = with_running_sums(versions.withColumn("_size", size), ["ord"], ["subject"], {"last_copy": "_size"})
    return running.select(*versions.columns, (F.col("last_copy") - F.col("_size") + 1).alias("first_copy"), "last_copy")


def range_blocks(first: str, last: str) -> Column:
    """A closed range as at most two blocks of each power of two: ``array<struct<level, block>>``, block n of level l covers n 2^l to (n + 1) 2^l - 1."""
    kind = "struct<lo:bigint,hi:bigint,out:array<struct<level:int,block:bigint>>>"
    start = F.struct(F.col(first).cast("bigint").alias("lo"), (F.col(last) + 1).cast("bigint").alias("hi"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out")).cast(kind)

    def halve(acc: Column, level: Column) -> Column:
        some = acc["lo"] < acc["hi"]
        left, right = some & (acc["lo"] % 2 == 1), some & (acc["hi"] % 2 == 1)

        def piece(test, block):
            return F.when(test, F.array(F.struct(level.alias("level"), block.alias("block")))).otherwise(F.array()).cast("array<struct<level:int,block:bigint>>")

        lo, hi = acc["lo"] + left.cast("bigint"), acc["hi"] - right.cast("bigint")
        # a block that both ends name is listed once
        out = F.concat(acc["out"], piece(left, acc["lo"]), piece(right & (hi >= lo), hi))
        return F.struct(F.floor(lo / 2).cast("bigint").alias("lo"), F.floor(hi / 2).cast("bigint").alias("hi"), out.alias("out")).cast(kind)

    return F.aggregate(F.sequence(F.lit(0), F.lit(61)), start, halve, lambda acc: acc["out"])


def version_of_copy(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Version whose range holds the copy number; null outside every range.

    Ranges are cut into blocks of powers of two and each distinct number is looked up by its block of every size in use, so
    the join has equalities only, however many versions a subject has.
    """
    blocks = ranges.filter("first_copy >= 0").select("subject", "vid", F.explode(range_blocks("first_copy", "last_copy")).alias("p")).select("subject", "vid", "p.level", "p.block")
    top = blocks.agg(F.coalesce(F.max("level"), F.lit(0)))
    asked = numbers.select("subject", "n").filter("n >= 0").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), top.scalar())))
    asked = asked.withColumn("block", F.call_function("shiftright", F.col("n").cast("bigint"), F.col("level")))
    found = asked.join(blocks, ["subject", "level", "block"]).select("subject", "n", "vid")
    return numbers.join(found, ["subject", "n"], "left").select(*numbers.columns, "vid")


def layout_roles(boxes: DataFrame) -> DataFrame:
    """Role of each printed column: copy grid, student grid or question, with its letters in order."""
    per = boxes.groupBy("question").agg(
        F.max("name").alias("name"), F.min(F.col("ch").rlike("^[0-9]$")).alias("digits"),
        F.array_join(F.array_sort(F.collect_set("ch")), "").alias("letters"))
    # printed names of the grids are `copie[n]` and `etu[n]` (fixed values)
    role = F.when(F.col("name").startswith("copie["), "copy").when(F.col("name").startswith("etu["), "student") \
        .when((F.coalesce("name", F.lit("")) == "") & F.col("digits"), "student").otherwise("question")
    return per.select("question", role.alias("role"), "letters")


def pdf_pages(pages: DataFrame) -> DataFrame:
    """Global page number of each (copy, page): its ordinal in that order."""
    return with_rank(pages.select("copy", "page").distinct(), ["copy", "page"], name="pdf_page")


def locate_pages(wanted: DataFrame, numbered: DataFrame) -> DataFrame:
    return wanted.join(numbered, ["copy", "page"], "left").select(
        *wanted.columns, F.coalesce("pdf_page", F.col("page").cast("bigint")).alias("pdf_page"))


def rank_in_version(questions: DataFrame) -> DataFrame:
    """Printed ordinal of a question inside its subject and group, in document order."""
    return with_rank(questions.select("subject", "grp", "q"), ["q"], keys=["subject", "grp"], name="ordinal")


# ------------------------------------------------------------ schemes


def natural_bounds(options: DataFrame) -> DataFrame:
    """Sum of the points of wrong options and of right options."""
    p = frac_or_zero("pts")
    return options.groupBy("q").agg(
        F.round(F.coalesce(F.sum(F.when(~F.col("correct"), p)), F.lit(0.0)), 6).alias("lo"),
        F.round(F.coalesce(F.sum(F.when(F.col("correct"), p)), F.lit(0.0)), 6).alias("hi"))


def scheme_census(options: DataFrame, n: int, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """The ``n`` most frequent marking structures with their clamped best, mixed and worst scores."""
    p = frac_or_zero("pts")
    per = options.groupBy("q").agg(
        F.count_if("correct").alias("n_good"), F.count_if(~F.col("correct")).alias("n_bad"),
        F.min_by(F.when(F.col("correct"), p), F.when(F.col("correct"), F.col("pos"))).alias("good"),
        F.min_by(F.when(~F.col("correct"), -p), F.when(~F.col("correct"), F.col("pos"))).alias("bad"))
    per = per.filter("n_good > 0 AND n_bad > 0")
    top = per.groupBy("n_good", "n_bad", "good", "bad").agg(F.count("*").alias("n_questions"), F.min("q").alias("first_q"))
    top = top.orderBy(F.desc("n_questions"), "first_q").limit(n)

    def clamp(x):
        return F.least(F.greatest(x, F.lit(floor).cast("double")), F.lit(ceiling).cast("double"))

    return top.select("n_good", "n_bad", "good", "bad", "n_questions",
                      clamp(F.col("n_good") * F.col("good")).alias("best"),
                      clamp(F.col("good") - F.col("bad")).alias("mixed"),
                      clamp(-F.col("n_bad") * F.col("bad")).alias("worst"))


def self_check(key: DataFrame) -> DataFrame:
    """Per question: scores of the perfect, blank, all-ticked and one-wrong answers."""
    everything = F.aggregate("opts", F.lit(0).cast("bigint"), lambda a, o: a.bitwiseOR(bit_of(o["pos"])))
    wrong = F.get(F.filter("opts", lambda o: ~o["correct"]), F.lit(0))
    one_wrong = F.when(wrong.isNotNull(), question_score(bit_of(wrong["pos"])))
    return key.select("q", "max_score", question_score(F.col("correct_mask")).alias("perfect"),
                      question_score(F.lit(0).cast("bigint")).alias("blank"),
                      question_score(everything).alias("all_ticked"), one_wrong.alias("one_wrong"))
