"""PII: format-preserving Feistel pseudonyms.

Candidates are found by pattern and then validated (checksum of a card or an account number, octets of an address,
ranges of a telephone or social security number, the calendar).  A valid value is numbered within its format, the
number goes through a keyed Feistel network over exactly that many numbers (cycle walking keeps it in range), and the
result is written back in the same format, valid again.  So one value has one pseudonym in all documents and in all of
its spellings, two values never share one, and the key's holder can turn it back:

* a telephone number is its E.164 digits: country code, then the rest, whatever stands between the digits; ten digits in
  American style are those of country 1;
* a date is a day, permuted among the days that are written with as many digits (days to 9, to 12 and above, months to 9
  and above), so that leading zeros, widths and the reading of slashes stay; slashes are month first where that is a
  date, else day first;
* an e-mail address's name is taken whole, in any alphabet and case; the domain stays.

The key is the caller's; ``key_of`` takes it from the session's configuration.

Defined results: a null text stays null, an empty one empty; long texts are read whole; repeated rows get equal
results; where two patterns begin at one place, the first of KINDS wins; an empty table gives an empty one; other
columns are kept, whatever their names and types, but that _found and _spans are this operator's own.  A value that
fails its check is no personal number and stays.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
import secrets
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bound_batches, tidy

ROUNDS = 10
MOST_VALUES = 100_000
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")

_EMAIL = r"(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)"
_NUMBERS = (
    r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\d.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
    r"|(?<![\d./-])(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![/-]?\d)"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?<![\d+])(?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?!1(?:\D|\d{10}(?!\d)))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){4,12}|\(\d{3}\)[ ]?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
    r"|(?<!\d)(?P<card>\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"
)
_FIND, _FIND_NUMBERS, _DIGIT = re.compile(f"{_EMAIL}|{_NUMBERS}"), re.compile(_NUMBERS), re.compile(r"\d")
#: Country codes of one and two digits (fixed values of E.164); all others have three.
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KEY_CONF = "spark.textloom.pseudonyms.key"


def luhn(digits: str) -> int:
    """The check digit that ``digits`` need."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


class Feistel:
    """A keyed permutation of 0..n-1 for any n, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, r: int, x: int, n: int, tweak: str) -> int:
        size = 16 + (n.bit_length() + 7) // 8
        data = hashlib.shake_256(b"|".join([self.key, str(r).encode(), str(x).encode(), str(n).encode(), tweak.encode()])).digest(size)
        return int.from_bytes(data, "big")

    def _once(self, x: int, a: int, b: int, n: int, tweak: str, back: bool) -> int:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2 == 0:
                left = (left + sign * self._round(r, right, n, tweak)) % a
            else:
                right = (right + sign * self._round(r, left, n, tweak)) % b
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:  # walks on until it is within the n numbers; a * b is less than n + 2 * sqrt(n) + 1
            x = self._once(x, a, b, n, tweak, back)
            if x < n:
                return x


@functools.cache
def _alphabet(c: str) -> str | None:
    """The characters that may stand for ``c``: digits, small Latin letters, or letters of its kind among its 64 neighbours."""
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else None
    if not c.isalpha():
        return None
    kind, base = unicodedata.category(c), ord(c) & ~63
    return "".join(x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == kind and x.lower() == x)


def _in_classes(text: str, f: Feistel, tweak: str, back: bool) -> str:
    """Digits to digits, letters to letters of the same alphabet and case; other characters stay.

    The case is none of the value: it is laid aside and put back, so that both spellings have one pseudonym.
    """
    low = "".join(c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in text)
    sets = [a if (a := _alphabet(c)) and c in a else None for c in low]
    n, x = 1, 0
    for c, s in zip(low, sets, strict=True):
        if s:
            n, x = n * len(s), x * len(s) + s.index(c)
    y, out = f.permute(x, n, f"{tweak}:{''.join('-' if s is None else s[0] for s in sets)}", back), []
    for c, d, s in zip(reversed(text), reversed(low), reversed(sets), strict=True):
        if s:
            y, k = divmod(y, len(s))
            c = s[k] if c == d else s[k].upper()
        out.append(c)
    return "".join(reversed(out))


def _width(day: datetime.date) -> int:
    return (day.day > 9) + (day.day > 12) + 3 * (day.month > 9)


@functools.cache
def _days(width: int) -> list[int]:
    return [n for n in range(_FIRST, _LAST + 1) if _width(datetime.date.fromordinal(n)) == width]


def _date(value: str, f: Feistel, back: bool) -> str | None:
    mark = next(c for c in value if not c.isdigit())
    parts = value.split(mark)
    for order in {"-": ("ymd",), ".": ("dmy",), "/": ("mdy", "dmy")}[mark]:
        own = dict(zip(order, parts, strict=True))
        try:
            day = datetime.date(int(own["y"]), int(own["m"]), int(own["d"]))
        except ValueError:
            continue
        if not _FIRST <= day.toordinal() <= _LAST:
            return None
        days = _days(_width(day))
        new = datetime.date.fromordinal(days[f.permute(bisect.bisect_left(days, day.toordinal()), len(days), f"date:{_width(day)}", back)])
        number = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(str(number[k]).zfill(len(own[k])) for k in order)
    return None


def _american(bare: str) -> bool:
    return len(bare) == 10 and bare[0] not in "01" and bare[3] not in "01"


def _phone(value: str, f: Feistel, back: bool) -> str | None:
    trunk = value[0] == "+" and "(0)" in value  # a zero that is only dialled at home
    bare = re.sub(r"\D", "", value.replace("(0)", "", 1) if trunk else value)
    code, rest = "1", bare
    if value[0] == "+":  # E.164: a country code, then up to 15 digits in all
        code = next((bare[:n] for n in (1, 2) if bare[:n] in _SHORT_CODES), bare[:3])
        rest = bare[len(code) :]
    if not 7 <= len(code + rest) <= 15 or len(rest) < 4:
        return None
    if code == "1":
        if len(rest) != 10 or (value[0] != "+" and not _american(rest)):
            return None
        if _american(rest):
            y, line = divmod(f.permute(((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10_000 + int(rest[6:]), 800 * 800 * 10_000, "phone", back), 10_000)
            new = f"{y // 800 + 200}{y % 800 + 200}{line:04d}"
        else:  # no American number: walks on among those that aren't
            new = _in_classes(rest, f, "phone:1", back)
            while _american(new):
                new = _in_classes(new, f, "phone:1", back)
    else:
        new = _in_classes(rest, f, f"phone:{code}", back)
    if value[0] != "+":
        code = ""
    return _refill(value.replace("(0)", "(\0)", 1), code + new).replace("\0", "0") if trunk else _refill(value, code + new)


def _refill(shape: str, characters: str) -> str:
    """``shape`` with its digits and letters replaced in order."""
    more = iter(characters)
    return "".join(next(more) if c.isalnum() else c for c in shape)


def pseudonym(kind: str, value: str, f: Feistel, back: bool = False) -> str | None:
    """The value's pseudonym, or None if it isn't valid."""
    bare = re.sub(r"[^A-Za-z0-9]", "", value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{_in_classes(local, f, 'email', back)}@{domain}"
    if kind == "iban":
        country, rest = bare[:2], bare[4:]
        if not 15 <= len(bare) <= 34 or iban_check(country, rest) != bare[2:4]:
            return None
        new = _in_classes(rest, f, f"iban:{country}", back)
        return _refill(value, country + iban_check(country, new) + new)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        return ".".join(map(str, f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back).to_bytes(4, "big")))
    if kind == "date":
        return _date(value, f, back)
    if kind == "ssn":
        area, group, serial = (int(x) for x in value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        x = f.permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", back)
        area, group = divmod(x // 9999, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{x % 9999 + 1:04d}"
    if kind == "phone":
        return _phone(value, f, back)
    if not 13 <= len(bare) <= 19 or int(bare[-1]) != luhn(bare[:-1]):
        return None
    body = bare[0] + _in_classes(bare[1:-1], f, f"card:{bare[0]}", back)
    return _refill(value, f"{body}{luhn(body)}")


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.f = Feistel(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, value: str) -> str | None:
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= MOST_VALUES:
                self.known.clear()
            self.known[at] = pseudonym(kind, value, self.f)
        return self.known[at]

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with pseudonyms, and (kind, start, end, pseudonym) of what was replaced, in places of the old text."""
        found: list[tuple[str, int, int, str]] = []

        def put(m: re.Match) -> str:
            new = self.value(m.lastgroup, m.group())
            if new is None:
                return m.group()
            found.append((m.lastgroup, m.start(), m.end(), new))
            return new

        if "@" in text:
            return _FIND.sub(put, text), found
        return (_FIND_NUMBERS.sub(put, text) if _DIGIT.search(text) else text), found


_drawn: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The session's key (``KEY_CONF``); without one, a key drawn at random for this application, which links its documents alone."""
    if key := spark.conf.get(KEY_CONF, None):
        return key.encode()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymize(docs: DataFrame, key: bytes, with_spans: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and _found: how many values of each kind; on demand _spans."""
    bound_batches(docs.sparkSession)
    own = ["_found", "_spans"] if with_spans else ["_found"]
    docs = docs.drop(*own)
    at = docs.columns.index("text")
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())])
    one = pa.struct([(k, pa.int32()) for k in KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymizer(key)
        for batch in batches:
            out = [(None, []) if t is None else p.text(t) for t in batch.column(at).to_pylist()]
            counts = [Counter(k for k, *_ in found) for _, found in out]
            cols = list(batch.columns)
            cols[at] = pa.array([t for t, _ in out], pa.string())
            cols.append(pa.array([{k: c[k] for k in KINDS} for c in counts], one))
            if with_spans:
                cols.append(pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), x, strict=True)) for x in f] for _, f in out], pa.list_(span)))
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *own])

    schema = T.StructType([*docs.schema.fields, T.StructField("_found", T.StructType([T.StructField(k, T.IntegerType()) for k in KINDS]))])
    if with_spans:
        schema.add("_spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pseudonym", T.StringType())])))
    return docs.mapInArrow(tidy(run), schema)
