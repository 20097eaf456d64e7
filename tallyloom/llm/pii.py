"""Format-preserving pseudonyms by Feistel networks.

Numbers and dates that pass their validation (check digit, calendar, ranges) are permuted under a key within their own format:
a card number becomes another valid card number, a date another date in the same notation. The permutation is a bijection
of each format's values, so equal values stay linked across documents, different values stay different, and the key
holder can undo it. Only where a value would make the numbers around it be read otherwise, it is permuted again. Nothing about the values is stored or compared between tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import add_columns, texts_of

KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")
ROUNDS = 10
#: dates that are permuted: all days of these years
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", re.ASCII)
NUMBER = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<date>(?<![\d./])(?<!\d-)(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/]|[.-]\d))"
    r"|(?P<phone>(?<![\d(+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{3}\)[\x20.-]?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}(?![\d-])|(?<![\d(])\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,5}(?!\d))"
    r"|(?P<ipv4>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<card>(?<!\d)(?<!\d[.-])\d(?:[\x20-]?\d){12,18}(?!\d|-\d|\.\d{3}))", re.ASCII)
DIGIT_RUN, GROUP_BORDER = re.compile("[0-9]+"), re.compile("[\x20-]")
#: characters of an IBAN by country
IBAN_LENGTHS = {c: int(n) for n, own in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE "
    "31:MT,SC 32:LC 33:RU").split()) for c in own.split(",")}
#: characters that a match reaches, and that an e-mail does; most steps of a walk
REACH, MAIL_REACH, STEPS = 64, 400, 1_000
#: digits of a card at least
CARD_LEAST = 13
#: a number begins at most so many signs before its first digit (two letters of an IBAN)
LEAD = 2


def keyed(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permuted(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed bijection of range(size): a Feistel network over a x b >= size values, walked until it is inside again."""
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    rounds = range(ROUNDS)
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        if back:
            for n in reversed(rounds):
                if n % 2:
                    right = (right - keyed(key, tweak, size, n, left)) % b
                else:
                    left = (left - keyed(key, tweak, size, n, right)) % a
        else:
            for n in rounds:
                if n % 2:
                    right = (right + keyed(key, tweak, size, n, left)) % b
                else:
                    left = (left + keyed(key, tweak, size, n, right)) % a
        value = left * b + right
        if value < size:
            return value


def walked(value: int, size: int, fits: Callable[[int], bool], key: bytes, tweak: str, back: bool) -> int:
    """``permuted`` until the result fits; a bijection of the values that fit."""
    while True:
        value = permuted(value, size, key, tweak, back)
        if fits(value):
            return value


def refilled(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced by ``chars``, in order."""
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def check_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        n = int(c) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return str(-total % 10)


def is_card(digits: str) -> bool:
    return check_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def shorter_ends(kind: str, found: str) -> list[int]:
    """Ends before that of ``found`` at which a card or an IBAN may end: its group borders, from left to right; the end that an
    IBAN's country gives it comes first."""
    if kind not in ("card", "iban"):
        return []
    borders = [m.start() for m in GROUP_BORDER.finditer(found) if sum(c.isalnum() for c in found[:m.start()]) >= (CARD_LEAST if kind == "card" else 15)]
    if kind == "card":
        return borders
    signs = [i for i, c in enumerate(found) if c.isalnum()]
    n = IBAN_LENGTHS.get(found[:2], len(signs))
    return ([signs[n - 1] + 1] if n < len(signs) else []) + borders[::-1]


class Pseudonyms:
    """Replacement of one found string; None if it fails validation."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.of = lru_cache(maxsize=200_000)(self.replaced)

    def replaced(self, kind: str, found: str) -> str | None:
        return getattr(self, kind)(found)

    def digits(self, digits: str, tweak: str, fits: Callable[[str], bool] = lambda d: True) -> str:
        n = len(digits)
        return f"{walked(int(digits), 10 ** n, lambda v: fits(f'{v:0{n}d}'), self.key, tweak, self.back):0{n}d}"

    def mixed(self, chars: str, tweak: str) -> str:
        """Letters and digits, each kept a letter (of its case) or a digit at its place."""
        size, value = 1, 0
        for c in chars:
            base = 10 if c in DIGITS else 26
            value = value * base + (int(c) if base == 10 else LETTERS.index(c.lower()))
            size *= base
        shape = "".join("9" if c in DIGITS else "a" for c in chars)
        value = permuted(value, size, self.key, f"{tweak}|{shape}", self.back)
        out = []
        for c in reversed(chars):
            value, n = divmod(value, 10 if c in DIGITS else 26)
            out.append(DIGITS[n] if c in DIGITS else LETTERS[n].upper() if c.isupper() else LETTERS[n])
        return "".join(reversed(out))

    def email(self, s: str) -> str | None:
        """Letters and digits of the local part; the domain stays, like an issuer. Linked without regard to case."""
        local, _, domain = s.rpartition("@")
        if ".." in local or local.endswith("."):
            return None
        chars = "".join(c for c in local if c.isalnum())
        signs = "".join("" if c.isalnum() else c for c in local)
        return f"{refilled(local, self.mixed(chars, f'email|{domain.lower()}|{signs}'))}@{domain}"

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
            return None
        body = self.mixed(plain[4:], f"iban|{plain[:2]}")
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return refilled(s, f"{plain[:2]}{check:02d}{body}")

    def card(self, s: str) -> str | None:
        digits = "".join(c for c in s if c in DIGITS)
        if not is_card(digits):
            return None
        payload = self.digits(digits[:-1], "card", lambda d: len(set(d + check_digit(d))) > 1)
        return refilled(s, payload + check_digit(payload))

    def ssn(self, s: str) -> str | None:
        def fits(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = s.replace("-", "")
        return refilled(s, self.digits(digits, "ssn", fits)) if fits(digits) else None

    def phone(self, s: str) -> str | None:
        """The country code stays."""
        head = re.match(r"\+\d{1,3}(?=[\x20.(-])", s)
        at = head.end() if head else 0
        digits = "".join(c for c in s[at:] if c in DIGITS)
        if not 7 <= len(digits) <= 14 or len(set(digits)) == 1:
            return None
        return s[:at] + refilled(s[at:], self.digits(digits, f"phone|{s[:at]}", lambda d: len(set(d)) > 1))

    def ipv4(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        value = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, self.key, "ipv4", self.back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        """A slash date is month/day/year, a dotted one day.month.year. Equal days are linked across notations; the days of notations
        without leading zeros, which are as short again, are linked among themselves."""
        try:
            if "-" in s:
                day, shape = date.fromisoformat(s), "{0.year:04d}-{0.month:02d}-{0.day:02d}"
            else:
                a, b, year = map(int, re.split(r"[./]", s))
                padded = "02d" if s[2] in "./" and s[5] in "./" else "d"
                sign = "/" if "/" in s else "."
                first, second = ("month", "day") if sign == "/" else ("day", "month")
                day = date(year, **{first: a, second: b})
                shape = f"{{0.{first}:{padded}}}{sign}{{0.{second}:{padded}}}{sign}{{0.year:04d}}"
                if shape.format(day) != s:
                    return None  # one field padded and one not
        except ValueError:
            return None
        n = day.toordinal()
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        short = len(shape.format(day)) < 10

        def fits(v: int) -> bool:
            return not short or len(shape.format(date.fromordinal(FIRST_DAY + v))) < 10

        return shape.format(date.fromordinal(FIRST_DAY + walked(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, fits, self.key, "date", self.back)))

    def found(self, whole: str, at: int = 0) -> Iterator[tuple[int, int, str]]:
        """Start, end and kind of the values, from left to right (of e-mails, valid or not); numbers are looked for around digits only.

        What looks like a card or an IBAN may go on into the next number, so their shorter ends are tried too; where none is valid,
        the search goes on after the first group.
        """
        mails = [m.span() for m in EMAIL.finditer(whole)] if "@" in whole else []
        mails, mail = [x for x in mails if x[0] >= at], 0
        while run := DIGIT_RUN.search(whole, at):
            while mail < len(mails) and mails[mail][0] <= run.start():
                yield (*mails[mail], "email")
                at = max(at, mails[mail][1])
                mail += 1
            if run.start() < at:
                continue
            stop = mails[mail][0] if mail < len(mails) else len(whole)
            for start in range(max(at, run.start() - LEAD), run.start() + 1):
                if (match := NUMBER.match(whole, start, stop)) and (end := self.valid_end(match.lastgroup, match.group())):
                    yield start, start + end, match.lastgroup
                    at = start + end
                    break
            else:
                at = run.end()
        for span in mails[mail:]:
            yield (*span, "email")

    def valid_end(self, kind: str, found: str) -> int:
        """Where the value at the start of ``found`` ends; 0 if none is valid."""
        ends = shorter_ends(kind, found)
        whole = [len(found)]
        country = kind == "iban" and ends and sum(c.isalnum() for c in found[:ends[0]]) == IBAN_LENGTHS.get(found[:2])
        order = ends + whole if kind == "card" else ends[:1] + whole + ends[1:] if country else whole + ends
        return next((e for e in order if self.of(kind, found[:e]) is not None), 0)

    def text(self, whole: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)
        parts, kinds, at = [], [], 0  # gap, value, gap, value, ..., gap
        for start, end, kind in self.found(whole):
            parts += [whole[at:start], whole[start:end]]
            kinds.append(kind)
            at = end
        if not kinds:
            return whole, counts
        parts.append(whole[at:])
        # undone in the opposite order, so that each step sees the text that it saw
        for i in reversed(range(len(kinds))) if self.back else range(len(kinds)):
            new = self.of(kinds[i], parts[2 * i + 1])
            if new is not None:
                counts[kinds[i]] += 1
                for _ in range(STEPS):
                    parts[2 * i + 1] = new
                    if self.same_values(parts, kinds, i):
                        break
                    new = self.of(kinds[i], new)
        return "".join(parts), counts

    def same_values(self, parts: list[str], kinds: list[str], i: int) -> bool:
        """Whether the values up to the i-th, as far as their matches may reach it, are found where they are."""
        first, reach = i, len(parts[2 * i])
        while first and reach < REACH:
            first -= 1
            reach += len(parts[2 * first + 1]) + len(parts[2 * first])
        before = parts[2 * first - 1][-REACH:] if first else ""
        at, expected, window = len(before), [], [before]
        for k in range(first, i + 1):
            start = at + len(parts[2 * k])
            at = start + len(parts[2 * k + 1])
            expected.append((start, at, kinds[k]))
            window += parts[2 * k:2 * k + 2]
        after = 0
        for part in parts[2 * i + 2:]:
            window.append(part[:MAIL_REACH])
            after += len(part)
            if after >= MAIL_REACH:
                break
        return list(islice(self.found("".join(window), len(before)), len(expected))) == expected


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", out: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with ``out``, the text under pseudonyms, and n_<kind> for each kind of ``KINDS``.

    ``key`` is 1 to 64 secret bytes; ``back`` undoes the replacement under the same key. A string that fails validation stays as it
    is. A null text stays null and counts nothing; texts of any length are read whole; nulls elsewhere, repeated rows and
    other columns pass through; an empty table gives an empty table; columns named like the new ones are replaced.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")

    def run(batch: pa.RecordBatch) -> list[list]:
        names = pseudonyms(key, back)
        nulls = batch.column(batch.schema.get_field_index(text)).is_null().to_pylist()
        made = [names.text(t) for t in texts_of(batch, text)]
        return [[None if null else new for null, (new, _) in zip(nulls, made, strict=True)], *([counts[k] for _, counts in made] for k in KINDS)]

    return add_columns(docs, f"`{out}` string, " + ", ".join(f"n_{k} long" for k in KINDS), run)


@lru_cache(maxsize=4)
def pseudonyms(key: bytes, back: bool) -> Pseudonyms:
    """One for each worker and key."""
    return Pseudonyms(key, back)
