"""Explicit schemas of the stored documents."""

from pyspark.sql import types as T

_letters = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

DOUBT = T.StructType([
    T.StructField("q", T.IntegerType()), T.StructField("char", T.StringType()), T.StructField("decision", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()), T.StructField("masked", T.DoubleType()), T.StructField("proba", T.DoubleType()),
    T.StructField("reasons", T.ArrayType(T.StringType()))])

DIFFERENCE = T.StructType([
    T.StructField("q", T.IntegerType()), T.StructField("char", T.StringType()),
    T.StructField("cv", T.BooleanType()), T.StructField("amc", T.BooleanType())])

SHEET = T.StructType([T.StructField("batch", T.StringType()), T.StructField("page", T.LongType()), T.StructField("sheet_page", T.IntegerType())])

#: a free answer as it was read and scored, or as somebody corrected it
OPEN_ANSWER = T.StructType([
    T.StructField("bid", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("raw_text", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("expected", T.StringType()), T.StructField("match_mode", T.StringType()),
    T.StructField("numeric_tol", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("points", T.DoubleType()),
    T.StructField("error", T.StringType()), T.StructField("manually_edited", T.BooleanType())])

_open = T.MapType(T.StringType(), OPEN_ANSWER)

#: one scanned copy as stored, one document per file
COPY = T.StructType([
    T.StructField("student_id", T.StringType()), T.StructField("student_name", T.StringType()),
    T.StructField("answers", _letters), T.StructField("_cv_answers", _letters), T.StructField("_amc_answers", _letters),
    T.StructField("_ambiguous_cells", T.ArrayType(DOUBT)), T.StructField("_cv_amc_diff", T.ArrayType(DIFFERENCE)),
    T.StructField("_flags", T.ArrayType(T.StringType())), T.StructField("_reviewed_cells", T.ArrayType(T.StringType())),
    T.StructField("_reviewed_questions", T.ArrayType(T.StringType())), T.StructField("_reviewed_id", T.BooleanType()),
    T.StructField("_student_override", T.StringType()), T.StructField("_cv_student_id", T.StringType()),
    T.StructField("_copy_id", T.LongType()), T.StructField("_copy_id_source", T.StringType()),
    T.StructField("_sheet_page", T.IntegerType()), T.StructField("notes", T.StringType()), T.StructField("_source", T.StringType()),
    T.StructField("open_answers", _open), T.StructField("_cv_open_answers", _open), T.StructField("_amc_copy", T.LongType()),
    T.StructField("_amc_validated_cells", T.LongType()), T.StructField("_page_no", T.IntegerType()), T.StructField("_sheet_source", T.StringType()),
    T.StructField("_n_sheets", T.IntegerType()), T.StructField("_sheets", T.ArrayType(SHEET))])

#: an exam subject: its blocks in document order
SUBJECT = T.StructType([T.StructField("blocks", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("group", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("tag", T.StringType()), T.StructField("qtype", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("floor", T.StringType()), T.StructField("ceiling", T.StringType()), T.StructField("_bank_id", T.StringType()),
        T.StructField("answers", T.ArrayType(T.StructType([
            T.StructField("correct", T.BooleanType()), T.StructField("bareme", T.StringType())])))]))])))])

#: a page reading as it arrives (JSON keys are text)
READING = T.StructType([
    T.StructField("batch", T.StringType()), T.StructField("page", T.LongType()), T.StructField("student_id", T.StringType()),
    T.StructField("answers", _letters), T.StructField("flags", T.ArrayType(T.StringType())), T.StructField("notes", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("amc_answers", _letters), T.StructField("amc_copy", T.LongType()),
    T.StructField("amc_validated_cells", T.LongType()), T.StructField("cv_amc_diff", T.ArrayType(DIFFERENCE)),
    T.StructField("ambiguous_cells", T.ArrayType(DOUBT)), T.StructField("copy_id", T.LongType()), T.StructField("copy_id_source", T.StringType()),
    T.StructField("page_no", T.IntegerType()), T.StructField("sheet_page", T.IntegerType()), T.StructField("sheet_source", T.StringType()),
    T.StructField("n_sheets", T.IntegerType()), T.StructField("sheets", T.ArrayType(SHEET)), T.StructField("open_answers", _open)])

#: maps by question whose keys are text in JSON
BY_QUESTION = ("answers", "cv_answers", "amc_answers", "open_answers", "cv_open_answers")

REVIEW_EVENT = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("copy_key", T.LongType()),
    T.StructField("batch", T.StringType()), T.StructField("q", T.IntegerType()), T.StructField("ch", T.StringType())])
