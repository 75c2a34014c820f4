"""Format-preserving pseudonyms for personal data.

Candidates are found by patterns and validated (checksums, ranges, the calendar).  A valid value is
permuted inside its own format by a keyed Feistel network, so it stays a valid value of that format,
equal values get equal pseudonyms in all documents, and different values never collide.  A result
that is not valid is permuted again until it is (cycle walking), which keeps the map one to one.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices

ROUNDS = 10
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049  # to the end of 2099
# The lengths of the IBAN registry, and month names (a name belongs to the first list that has it).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
MONTHS = [x.split() for x in (
    "january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember", "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre")]


def _mix(key: bytes, tweak: bytes, i: int, value: int, size: int) -> int:
    data = tweak + i.to_bytes(1, "big") + value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")
    return int.from_bytes(hmac.digest(key, data, hashlib.sha256), "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network over two digits of mixed radix, with cycle walking."""
    if size < 2:
        return value
    left = int(size ** 0.5) or 1
    while left * left < size:
        left += 1
    right = -(-size // left)
    while True:
        a, b = divmod(value, right)
        for i in range(0, ROUNDS, 2):
            a = (a + _mix(key, tweak, i, b, left)) % left
            b = (b + _mix(key, tweak, i + 1, a, right)) % right
        value = a * right + b
        if value < size:
            return value


def _radix(c: str) -> tuple[int, str]:
    if "0" <= c <= "9":
        return 10, "0"
    if "a" <= c <= "z":
        return 26, "a"
    if "A" <= c <= "Z":
        return 26, "A"
    return 1, c


def permute_format(text: str, key: bytes, tweak: bytes) -> str:
    """Digits become digits, letters letters of their case; all else stays.  One number over all places is permuted."""
    radix = [_radix(c) for c in text]
    value, size = 0, 1
    for c, (r, base) in zip(text, radix):
        value, size = value * r + (ord(c) - ord(base)), size * r
    tweak += "".join(base if r > 1 else c for c, (r, base) in zip(text, radix)).encode()
    value = permute(value, size, key, tweak)
    out = []
    for r, base in reversed(radix):
        value, d = divmod(value, r)
        out.append(chr(ord(base) + d))
    return "".join(reversed(out))


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _walk(text: str, valid: Callable[[str], bool], key: bytes, tweak: bytes) -> str:
    while True:
        text = permute_format(text, key, tweak)
        if valid(text):
            return text


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


# -- one function for each kind: the pseudonym, or None when the value is not valid ---------------------
def card(value: str, key: bytes) -> str | None:
    """13 to 19 digits with a right Luhn digit; the body is permuted and the Luhn digit follows."""
    digits = _digits_of(value)
    if not (13 <= len(digits) <= 19 and luhn_valid(digits)) or len(set(digits)) == 1:
        return None
    body = _walk(digits[:-1], lambda b: len(set(b)) > 1, key, b"card")
    check = next(c for c in "0123456789" if luhn_valid(body + c))
    return _refill(value, body + check)


def phone(value: str, key: bytes) -> str | None:
    """At least 9 digits, 8 behind a +; a country code after + stays.

    The national digits alone are permuted, so one number in several spellings stays one number: with or without +1,
    and whatever separates the digits.  North American numbers stay such.
    """
    digits = _digits_of(value)
    if not 9 - (value[0] == "+") <= len(digits) <= 15:
        return None
    keep = 0 if value[0] != "+" else 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    code, rest = digits[:keep], digits[keep:]
    if code in ("", "1") and re.fullmatch(NORTH_AMERICAN, rest):
        return _refill(value, code + _walk(rest, lambda v: re.fullmatch(NORTH_AMERICAN, v) is not None, key, b"phone"))
    return _refill(value, code + permute_format(rest, key, b"phone"))


def ip(value: str, key: bytes) -> str | None:
    """Four numbers to 255; the 32 bits are permuted."""
    parts = value.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    number = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(str(b) for b in permute(number, 1 << 32, key, b"ip").to_bytes(4, "big"))


def email(value: str, key: bytes) -> str | None:
    """The part before the @ is permuted by classes of characters, its case and the domain stay; spellings in other case are linked."""
    local, _, domain = value.rpartition("@")
    if ".." in value or local[:1] == "." or local[-1:] == ".":
        return None
    new = permute_format(local.lower(), key, b"email")
    return "".join(n.upper() if c.isupper() else n for n, c in zip(new, local)) + "@" + domain


def ssn(value: str, key: bytes) -> str | None:
    valid = lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
    return _walk(value, valid, key, b"ssn") if valid(value) else None


def iban(value: str, key: bytes) -> str | None:
    """The account part is permuted and the two check digits follow; the country stays."""
    plain = value.replace(" ", "")
    if not iban_valid(plain):
        return None
    body = permute_format(plain[4:], key, b"iban" + plain[:2].encode())
    rest = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    it = iter(plain[:2] + f"{98 - rest:02d}" + body)
    return "".join(c if c == " " else next(it) for c in value)


def _month_list(name: str) -> int:
    return next(i for i, names in enumerate(MONTHS) if name.lower() in names)


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def named_date(value: str, key: bytes) -> str | None:
    """The same for a month in words; the language, the length of the name, its case and the form stay."""
    parts = re.split(r"(\d+|[^\W\d_]+)", value)
    at = next(i for i, p in enumerate(parts) if any(p.lower() in names for names in MONTHS))
    day_at, year_at = [i for i, p in enumerate(parts) if p.isdigit()]
    which, name = _month_list(parts[at]), parts[at]
    case = str.upper if name.isupper() else str.lower if name.islower() else str.capitalize
    suffix_at = next((i for i, p in enumerate(parts) if i > day_at and p.lower() in ("st", "nd", "rd", "th")), None)
    try:
        n = (datetime.date(int(parts[year_at]), MONTHS[which].index(name.lower()) + 1, int(parts[day_at])) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= n < DAYS:
        return None
    while True:
        n = permute(n, DAYS, key, b"date")
        day = FIRST_DAY + datetime.timedelta(n)
        new = MONTHS[which][day.month - 1]
        if _month_list(new) == which and len(str(day.day).zfill(len(parts[day_at]))) == len(parts[day_at]):
            out = list(parts)
            out[at], out[day_at], out[year_at] = case(new), str(day.day).zfill(len(parts[day_at])), str(day.year)
            if suffix_at is not None:
                out[suffix_at] = _ordinal(day.day)
            return "".join(out)


def date(value: str, key: bytes) -> str | None:
    """A day from 1900 to 2099, year first or last; the day number is permuted and the form kept."""
    if any(c.isalpha() for c in value):
        return named_date(value, key)
    parts = re.split(r"([./\-])", value)
    a, b, c = parts[0], parts[2], parts[4]
    order = (0, 2, 4) if len(a) == 4 else (4, 2, 0)
    numbers = [int(parts[i]) for i in order]
    if order[0] == 4 and parts[1] == "/":  # month before day
        numbers, order = [int(c), int(a), int(b)], (4, 0, 2)
    try:
        n = (datetime.date(*numbers) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= n < DAYS:
        return None
    while True:
        n = permute(n, DAYS, key, b"date")
        day = FIRST_DAY + datetime.timedelta(n)
        out = list(parts)
        for i, v in zip(order, (day.year, day.month, day.day)):
            out[i] = str(v).zfill(len(parts[i]))
        # a form without leading zeros keeps its width
        if [len(x) for x in out] == [len(x) for x in parts]:
            return "".join(out)


NORTH_AMERICAN = r"[2-9]\d\d[2-9]\d{6}"
SPACED = r"[2-9]\d\d[ .\-][2-9]\d\d[ .\-]\d{4}"
_MONTH = "(?i:" + "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m))) + ")"
_IBANS = "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![A-Za-z0-9])" for n, c in IBAN_COUNTRIES.items())
KINDS = {
    "email": (r"(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9@])", email),
    "iban": (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d)(?:{_IBANS}|" r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))", iban),
    "date": (r"(?<![\d.\-/])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d\-/]|\.\d)"
             rf"|(?<![\w.\-/])\d{{1,2}}(?:st|nd|rd|th|\.)?[ \-](?:de |of )?{_MONTH}\.?,?[ \-](?:de )?\d{{4}}(?!\w)|(?<!\w){_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}(?!\w)", date),
    "ssn": (r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", ssn),
    "ip": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", ip),
    "card": (r"(?<![\dA-Za-z.])(?:\d{13,19}|\d{4}(?P<cut>[ \-])\d{4}(?P=cut)\d{4}(?P=cut)\d{4}(?:(?P=cut)\d{3}(?![\dA-Za-z]))?|\d{4}(?P<part>[ \-])\d{6}(?P=part)\d{5}|\d{6}[ \-]\d{13})(?![\dA-Za-z])", card),
    "phone": (r"(?<![\dA-Za-z.])(?:\+\d{1,3}[ .\-]?)?\(\d{1,4}\)[ .\-]?\d{2,4}(?P<gap>[ .\-]?)\d{2,4}(?:(?P=gap)\d{2,4}){0,2}(?![\dA-Za-z])"
              r"|(?<![\dA-Za-z.])\+\d{1,3}[ .\-]?\(\d{1,4}\)(?:[ .\-]?\d){4,12}\d(?![\dA-Za-z])"
              r"|(?<![\dA-Za-z.])\+(?:1[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{4}|\d{8,15}|(?!\d{4}(?:[ \-]\d{4}){3})\d(?:[ .\-]?\d){6,13}\d)(?![\dA-Za-z])"
              rf"|(?<![\dA-Za-z.\-])(?:\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}|{SPACED})(?![\dA-Za-z\-])", phone),
}
CARD_AND_CODE = re.compile(r"(\d{4}([ \-])\d{4}\2\d{4}\2\d{4})\2\d{3}")  # 19 digits, or a card of 16 that a number follows
PATTERN = "|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items())
MAYBE = re.compile(r"[0-9@]")


class Pseudonymizer:
    """Finds, validates and replaces; equal values are worked out once."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = key
        self.find = re.compile(PATTERN)
        self.known: dict[tuple[str, str], str | None] = {}

    def replace(self, kind: str, value: str) -> str | None:
        if len(self.known) > 200_000:
            self.known.clear()
        if (kind, value) not in self.known:
            self.known[kind, value] = KINDS[kind][1](value, self.key)
        return self.known[kind, value]

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, str]]]:
        """The text with pseudonyms and (kind, start in the new text, pseudonym) of each."""
        if not MAYBE.search(text):
            return text, []
        out, found, at, length, start = [], [], 0, 0, 0
        while m := self.find.search(text, start):
            new, end = self.replace(m.lastgroup, m[0]), m.end()
            if new is None and m.lastgroup == "card" and (longer := CARD_AND_CODE.fullmatch(m[0])):
                new, end = self.replace("card", longer[1]), m.start() + len(longer[1])
            if new is None:  # not valid as this kind: look again behind its first run of digits or letters
                start = m.start() + len(re.match(r"\w+|\W", m[0])[0])
                continue
            before = text[at:m.start()]
            length += len(before)
            found.append((m.lastgroup, length, new))
            out += [before, new]
            length += len(new)
            at = start = end
        return ("".join([*out, text[at:]]), found) if found else (text, [])


def pseudonymize(documents: DataFrame, key: bytes, text: str = "text", spans: str = "pii") -> DataFrame:
    """All rows and columns; ``text`` with pseudonyms, ``spans`` (kind, start, length) of each in the new text.

    No shuffle.  A null text stays null with no spans, an empty one empty; repeated rows are treated alike;
    an older column named as ``spans`` is replaced.  Values that fail their check stay as they are.  Texts of any
    length are searched whole, and an empty table gives an empty one.  Who knows the key can undo the pseudonyms.
    """
    kept = [f for f in documents.schema.fields if f.name != spans]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(spans, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonymizer(key)
        for part in slices(batches, text):
            i = part.schema.get_field_index(text)
            done = [(None, []) if t is None else work(t) for t in part.column(i).to_pylist()]
            columns = [pa.array([d[0] for d in done], pa.string()) if n == text else part.column(part.schema.get_field_index(n)) for n in names]
            found = pa.array([[{"kind": k, "start": s, "length": len(v)} for k, s, v in d[1]] for d in done], kind)
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*names, spans])

    return documents.select(*names).mapInArrow(run, schema)


def summary(pseudonymized: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """doc_id, the new text and the number of pseudonyms of each kind."""
    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return pseudonymized.select("doc_id", text, F.size(spans).cast("bigint").alias("n_pii"), *counts)
