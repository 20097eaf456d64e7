"""Text normalisation and formatting as built-in column expressions."""

from __future__ import annotations

import functools
import json
import re
import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\p{Z}]+"
# ranges whose compatibility forms spell several characters (ligatures, fractions, units)
_MULTI_RANGES = ((0x00A0, 0x024F), (0x1E00, 0x1EFF), (0x2000, 0x218F), (0xFB00, 0xFB06))


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _base(char: str) -> str:
    decomposed = unicodedata.normalize("NFKD", char)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


@functools.lru_cache(maxsize=1)
def _single_fold() -> tuple[str, str]:
    """One-to-one compatibility foldings of the basic plane, derived from the Unicode data."""
    source, target = [], []
    for point in range(0x80, 0x10000):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        base = _base(char)
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


@functools.lru_cache(maxsize=1)
def _multi_fold() -> dict[str, str]:
    out = {}
    for low, high in _MULTI_RANGES:
        for point in range(low, high + 1):
            base = _base(chr(point))
            if len(base) > 1:
                out[chr(point)] = base
    return out


@functools.lru_cache(maxsize=1)
def _multi_class() -> str:
    """Class of the characters of ``_multi_fold``, runs as ranges; all others of the first 128 leave it at the first test."""
    runs: list[list[int]] = []
    for point in sorted(map(ord, _multi_fold())):
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return r"[[^\x00-\x7F]&&[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in runs) + "]]"


def strip(value) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_column(value), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def multi_pieces(text: Column) -> Column:
    """The characters that stand for several ones, and the runs between them, each as a whole."""
    return F.split(text, f"(?<={_multi_class()})|(?={_multi_class()})")


def strip_accents(value) -> Column:
    """Compatibility decomposition without combining marks."""
    text = as_column(value)
    multi = _multi_fold()
    mapping = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")
    pattern = _multi_class()
    spelled = F.array_join(F.transform(multi_pieces(text), lambda c: F.coalesce(F.element_at(mapping, c), c)), "")
    source, target = _single_fold()
    # the slow branch runs only for rows that hold such a character
    folded = F.translate(F.when(text.rlike(pattern), spelled).otherwise(text), source, target)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"\p{Mn}", "")).otherwise(text)


def norm_name(value) -> Column:
    """Accent-free lower-case letters, every other run as one blank; missing gives an empty text."""
    letters = F.regexp_replace(strip_accents(F.coalesce(as_column(value), F.lit(""))), "[^a-zA-Z]+", " ")
    return F.lower(F.trim(letters))


def fold(value) -> Column:
    """Search form: no accents, single blanks, lower case."""
    text = strip_accents(F.coalesce(as_column(value), F.lit("")))
    return F.lower(F.trim(F.regexp_replace(text, _BLANK, " ")))


def slug(value, limit: int = 50, default: str = "untitled") -> Column:
    ascii_text = F.regexp_replace(strip_accents(F.coalesce(as_column(value), F.lit(""))), r"[^\x00-\x7F]", "")
    dashed = F.regexp_replace(ascii_text, "[^a-zA-Z0-9]+", "-")
    cut = F.substring(F.lower(F.regexp_replace(dashed, "^-+|-+$", "")), 1, limit)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def cell_text(value) -> Column:
    """Spreadsheet cell as text: ``13021.0`` reads ``13021``."""
    return F.regexp_replace(F.coalesce(strip(as_column(value).cast("string")), F.lit("")), r"^(\d+)\.0$", "$1")


def clean_name(value) -> Column:
    """Single blanks, trimmed; null when empty or longer than 80 characters."""
    name = F.trim(F.regexp_replace(as_column(value), _BLANK, " "))
    return F.when(F.length(name).between(1, 80), name)


def sibling_key(value) -> Column:
    return F.lower(clean_name(value))


def clip(value, limit: int) -> Column:
    """White space collapsed, cut at ``limit`` characters with an ellipsis."""
    text = F.trim(F.regexp_replace(as_column(value), _BLANK, " "))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def short_title(value, limit: int = 60) -> Column:
    text = F.regexp_replace(F.coalesce(as_column(value), F.lit("")), r"\\", "")
    text = F.trim(F.regexp_replace(text, _BLANK, " "))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


# The label shown when a block carries no usable text.
TITLE_DEFAULTS = {
    "question_qcm": "QCM",
    "question_open": "Question ouverte",
    "question_freeform": "Question libre",
    "answerbox": "Zone de réponse",
    "text": "Bloc texte",
}


def auto_title(kind, statement, tag, title, tex) -> Column:
    """Default title of a bank entry, by kind."""
    kind = as_column(kind)

    def filled(value):
        return F.nullif(as_column(value), F.lit(""))

    def shortened(value):
        return F.nullif(short_title(as_column(value)), F.lit(""))

    out = F.when(kind == "answerbox", F.coalesce(filled(title), F.lit(TITLE_DEFAULTS["answerbox"])))
    out = out.when(kind == "text", F.coalesce(shortened(tex), F.lit(TITLE_DEFAULTS["text"])))
    for name in ("question_qcm", "question_open", "question_freeform"):
        out = out.when(kind == name, F.coalesce(shortened(statement), filled(tag), F.lit(TITLE_DEFAULTS[name])))
    return out.otherwise(kind)


def search_text(*parts, answers=None, labels=None, limit: int | None = None) -> Column:
    """Folded text that searches look into: the parts, then answer texts, then case labels.

    Whole texts are kept unless the caller asks for the stored index's ``limit``.
    """
    pieces = [F.nullif(as_column(p), F.lit("")) for p in parts]
    pieces += [F.array_join(as_column(a), " ") for a in (answers, labels) if a is not None]
    text = fold(F.concat_ws(" ", *pieces))
    return F.substring(text, 1, limit) if limit else text


def cell_key(q, char) -> Column:
    return F.concat_ws("_", as_column(q).cast("string"), as_column(char))


def split_cell_key(key) -> tuple[Column, Column]:
    """Question number (null when unreadable) and letter of a ``q_letter`` key."""
    parts = F.split(as_column(key), "_", 2)
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1))


def render(template: str, fields: dict[str, Column]) -> Column:
    """``$name`` / ``${name}`` / ``$$`` template as one concatenation; a bad template raises at once."""
    parts: list[Column] = []
    last = 0
    for match in string.Template.pattern.finditer(template):
        parts.append(F.lit(template[last:match.start()]))
        last = match.end()
        name = match.group("named") or match.group("braced")
        if match.group("escaped") is not None:
            parts.append(F.lit("$"))
        elif name is None:
            raise ValueError(f"a lone $ at {match.start()}: write $$ for the sign itself")
        elif name not in fields:
            raise ValueError(f"unknown field ${name}; known: {', '.join('$' + k for k in fields)}")
        else:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    parts.append(F.lit(template[last:]))
    return F.concat(*parts)


def page_filter(column, spec: str) -> Column:
    """Predicate of a page list such as ``1-3,7``; plain comparisons, so it reaches the scan."""
    page = as_column(column)
    wanted = F.lit(False)
    for piece in filter(None, (p.strip() for p in spec.split(","))):
        if not re.fullmatch(r"\d+(-\d+)?", piece):
            raise ValueError(f"bad page range: {piece!r}")
        low, _, high = piece.partition("-")
        wanted = wanted | page.between(int(low), int(high or low))
    return wanted


# Accepted spellings of identifiers and states.
BANK_ID = r"^(?:[0-9a-f]{8}|[0-9a-fA-F-]{36})$"
CATEGORY_ID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
BATCH_NAME = r"^[A-Za-z0-9_][A-Za-z0-9._\- ]*$"
STATUSES = ("draft", "public", "archived")


def is_bank_id(value) -> Column:
    return F.coalesce(as_column(value), F.lit("")).rlike(BANK_ID)


def is_category_id(value) -> Column:
    return F.coalesce(as_column(value), F.lit("")).rlike(CATEGORY_ID)


def is_batch_name(value) -> Column:
    name = F.coalesce(as_column(value), F.lit(""))
    return name.rlike(BATCH_NAME) & ~name.contains("..")


def is_status(value) -> Column:
    return F.coalesce(as_column(value).isin(*STATUSES), F.lit(False))
