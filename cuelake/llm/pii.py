"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within each value's format.

A value that passes its validation is replaced by another valid value of the same format. The permutation
depends on the key and the format alone, so equal values get equal pseudonyms in all documents, different
ones different pseudonyms, and whoever holds the key can invert them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import merged

ROUNDS = 8
#: Characters that are permuted as one number; longer values are permuted in chained blocks of so many.
BLOCK = 512
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Permuter:
    """Keyed permutations of 0..n-1 for any n: a balanced Feistel network, walked until it stays below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        told = tweak + bytes([r]) + value.to_bytes(size, "big")
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(told + len(out).to_bytes(2, "big"), key=self.key, digest_size=min(64, size - len(out))).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return value
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mark = f"{tweak}:{n}:".encode()
        mask = (1 << half) - 1
        rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:
            left, right = value >> half, value & mask
            for r in rounds:
                if back:
                    left, right = right ^ self._round(mark, r, left, half), left
                else:
                    left, right = right, left ^ self._round(mark, r, right, half)
            value = left << half | right
            if value < n:
                return value

    def _blocks(self, value: str, tweak: str, back: bool, change: Callable[[str, str], str]) -> str:
        """change(part, tweak) over blocks of a long value, from left to right and then from right to left.

        Each block's tweak holds a digest of the neighbour that was changed before, so every character of the
        result depends on the whole value; both passes can be taken back in the opposite order.
        """
        if len(value) <= BLOCK:
            return change(value, tweak)
        parts = ["", *(value[k : k + BLOCK] for k in range(0, len(value), BLOCK)), ""]
        passes = [(0, range(1, len(parts) - 1)), (1, range(len(parts) - 2, 0, -1))]
        for turn, order in [(n, reversed(order)) for n, order in reversed(passes)] if back else passes:
            for k in order:
                beside = hashlib.blake2b(parts[k + (1 if turn else -1)].encode(), key=self.key, digest_size=16).hexdigest()
                parts[k] = change(parts[k], f"{tweak}:{len(value)}:{turn}:{k}:{beside}")
        return "".join(parts)

    def text(self, value: str, alphabet: str, tweak: str, back: bool = False) -> str:
        """A string over the alphabet, of the same length."""
        return self._blocks(value, tweak, back, lambda part, t: self._text(part, alphabet, t, back))

    def mixed(self, value: str, tweak: str, back: bool = False) -> str:
        """Letters and digits permuted within their kind and place; other characters stay."""
        return self._blocks(value, tweak, back, lambda part, t: self._mixed(part, t, back))

    def _text(self, value: str, alphabet: str, tweak: str, back: bool) -> str:
        base, number = len(alphabet), 0
        for c in value:
            number = number * base + alphabet.index(c)
        number = self.permute(number, base ** len(value), tweak, back)
        out = []
        for _ in value:
            number, rest = divmod(number, base)
            out.append(alphabet[rest])
        return "".join(reversed(out))

    def _mixed(self, value: str, tweak: str, back: bool) -> str:
        kinds = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in value]
        n, number = 1, 0
        for c, a in zip(value, kinds, strict=True):
            if a:
                n, number = n * len(a), number * len(a) + a.index(c)
        shape = "".join({DIGITS: "9", LOWER: "a", UPPER: "A"}.get(a, c) for c, a in zip(value, kinds, strict=True))
        number = self.permute(number, n, f"{tweak}:{shape}", back)
        out = []
        for c, a in zip(reversed(value), reversed(kinds), strict=True):
            if a:
                number, rest = divmod(number, len(a))
                c = a[rest]
            out.append(c)
        return "".join(reversed(out))


def refill(shown: str, digits: str) -> str:
    """The digits in the places of shown's digits."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shown)


def luhn_digit(payload: str) -> str:
    """The digit that makes payload + digit pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c)
        if k % 2 == 0:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return str(-total % 10)


def card(p: Permuter, shown: str, back: bool = False) -> str | None:
    """13 to 19 digits that pass the Luhn check; the first digit (the network, hence not 0) stays."""
    digits = re.sub(r"\D", "", shown)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or digits[0] == "0":
        return None
    body = digits[0] + p.text(digits[1:-1], DIGITS, "card" + digits[0], back)
    return refill(shown, body + luhn_digit(body))


def phone(p: Permuter, shown: str, back: bool = False) -> str | None:
    """7 to 15 digits; the country code and the first digit after it stay."""
    digits = re.sub(r"\D", "", shown)
    if not 7 <= len(digits) <= 15:
        return None
    keep = len(re.match(r"\+?(\d{0,3})", shown)[1]) if shown.startswith("+") and not shown[1:].isdigit() else 1
    keep = min(keep + 1, len(digits) - 4)
    return refill(shown, digits[:keep] + p.text(digits[keep:], DIGITS, "phone" + digits[:keep], back))


def ssn(p: Permuter, shown: str, back: bool = False) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    a, g, s = int(shown[:3]), int(shown[4:6]), int(shown[7:])
    if not (0 < a < 900 and a != 666 and g and s):
        return None
    area = a - 1 - (a > 666)
    value = p.permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn", back)
    value, s = divmod(value, 9999)
    area, g = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def address(p: Permuter, shown: str, back: bool = False) -> str | None:
    """Four numbers up to 255, not all of one digit; each keeps its count of digits, so that the text's length stays."""
    parts = shown.split(".")
    if len(shown) == 7 or any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    spans = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    n, value = 1, 0
    for x in parts:
        low, size = spans[len(x)]
        n, value = n * size, value * size + int(x) - low
    value = p.permute(value, n, "ip" + "".join(str(len(x)) for x in parts), back)
    out = []
    for x in reversed(parts):
        low, size = spans[len(x)]
        value, rest = divmod(value, size)
        out.append(str(low + rest))
    return ".".join(reversed(out))


def day_number(y: int, m: int, d: int) -> int | None:
    """The day's number, or None if there is no such day in the years taken."""
    try:
        at = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    return at if FIRST_DAY <= at <= LAST_DAY else None


def day(p: Permuter, y: int, m: int, d: int, back: bool) -> dt.date | None:
    """Another of all days."""
    at = day_number(y, m, d)
    return None if at is None else dt.date.fromordinal(FIRST_DAY + p.permute(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", back))


@cache
def late_days() -> list[int]:
    """The numbers of all days after the twelfth of a month."""
    return [at for at in range(FIRST_DAY, LAST_DAY + 1) if dt.date.fromordinal(at).day > 12]


def date_ymd(p: Permuter, shown: str, back: bool = False) -> str | None:
    """YYYY-MM-DD, YYYY/MM/DD or YYYY.MM.DD."""
    new = day(p, int(shown[:4]), int(shown[5:7]), int(shown[8:]), back)
    return new and f"{new.year:04d}{shown[4]}{new.month:02d}{shown[7]}{new.day:02d}"


def date_dmy(p: Permuter, shown: str, back: bool = False) -> str | None:
    """DD.MM.YYYY, DD/MM/YYYY or DD-MM-YYYY; with the month first if only that is a date.

    Those are the days after the twelfth; they are permuted among themselves, so that each pseudonym is read
    as its value was.
    """
    a, b, y = (int(x) for x in re.split(r"\D", shown))
    new = day(p, y, b, a, back)
    if new:
        return f"{new.day:02d}{shown[2]}{new.month:02d}{shown[5]}{new.year:04d}"
    at = day_number(y, a, b)
    if at is None:
        return None
    late = late_days()
    new = dt.date.fromordinal(late[p.permute(bisect_left(late, at), len(late), "month first", back)])
    return f"{new.month:02d}{shown[2]}{new.day:02d}{shown[5]}{new.year:04d}"


def iban(p: Permuter, shown: str, back: bool = False) -> str | None:
    """Country and 11 to 30 characters that pass the modulo 97 check, which is made anew."""
    plain = shown.replace(" ", "")

    def rest(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x)) % 97

    if not 15 <= len(plain) <= 34 or rest(plain[4:] + plain[:4]) != 1:
        return None
    body = p.mixed(plain[4:], "iban" + plain[:2], back)
    new = iter(plain[:2] + f"{98 - rest(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in shown)


def email(p: Permuter, shown: str, back: bool = False) -> str | None:
    """Letters and digits before the @; the domain stays."""
    name, _, domain = shown.rpartition("@")
    return p.mixed(name, "email", back) + "@" + domain


def secret(p: Permuter, shown: str, back: bool = False) -> str | None:
    """A key or password: what follows its marker."""
    m = re.match(r"(AKIA|(?:(?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*[\"']?))?(.*)", shown, re.S)
    body = m[2]
    if re.fullmatch(r"[0-9a-f]+", body):
        return (m[1] or "") + p.text(body, HEX, f"hex{len(body)}", back)
    return (m[1] or "") + p.mixed(body, "secret", back)


_NAMED: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
    ("secret", r"\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*[\"']?[A-Za-z0-9_+/-]{6,}|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}\b", secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("date", r"(?<![\d./-])\d{4}([-/.])(?:0[1-9]|1[0-2])\g<SEP>(?:0[1-9]|[12]\d|3[01])(?![\d/-]|\.\d)", date_ymd),
    ("date", r"(?<![\d./-])\d{2}([-/.])\d{2}\g<SEP>\d{4}(?![\d/-]|\.\d)", date_dmy),
    ("ip", r"(?<![\w.])(?<!version )(?<!release )\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", address),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("card", r"(?<![\d.-])[1-9]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])|(?<![\d.-])3\d{3}[ -]?\d{6}[ -]?\d{5}(?![\d-])", card),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", phone),
]
_PATTERNS: list[str] = []
_FOUND: list[tuple[str, Callable]] = []
for _kind, _pattern, _change in _NAMED:
    _sep = f"s{len(_PATTERNS)}"
    _PATTERNS.append(f"(?P<k{len(_PATTERNS)}>{_pattern.replace('([-/.])', f'(?P<{_sep}>[-/.])').replace(r'\g<SEP>', f'(?P={_sep})')})")
    _FOUND.append((_kind, _change))
_ANY = re.compile("|".join(_PATTERNS))
_HINT = re.compile(r"[0-9@]|(?i:passw|pwd|token|secret|api_?key)")


def replace(text: str, p: Permuter, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and what was replaced: kind, start and end in it, in characters."""
    if not _HINT.search(text):
        return text, []
    out, spans, done, shift = [], [], 0, 0
    for m in _ANY.finditer(text):
        kind, change = _FOUND[int(next(g for g in m.groupdict() if g[0] == "k" and m[g] is not None)[1:])]
        shown = m[0]
        new = change(p, shown, back)
        if new is None:
            continue
        out += [text[done : m.start()], new]
        spans.append((kind, m.start() + shift, m.start() + shift + len(new)))
        shift += len(new) - len(shown)
        done = m.end()
    if not spans:
        return text, []
    return "".join([*out, text[done:]]), spans


def session_key(spark: SparkSession) -> bytes:
    """The secret in spark.cuelake.pii.key; without one a random key, so that nobody can invert what a run makes."""
    given = spark.conf.get("spark.cuelake.pii.key", None)
    return given.encode() if given else secrets.token_bytes(32)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = "pii", back: bool = False) -> DataFrame:
    """docs with the personal data of text_col replaced, and spans_col: array of (kind, start, end).

    Cards, social security numbers, phones, IBANs, IP addresses, dates from 1900 to 2099, e-mail names and
    secrets are replaced where they are valid; all else stays, byte for byte: numbers that fail the card
    check or start with 0, and four one-digit numbers with dots, or four after a letter, "version " or
    "release ", which are versions more often than addresses. Null texts stay null, with no spans, empty
    ones empty. Equal values get equal pseudonyms under a key; back=True gives the originals again. Very
    long texts and values are done whole, repeated rows alike, an empty table stays empty. An input column named like
    spans_col is replaced. Whoever has the key can invert the pseudonyms, hence it has no default.
    """
    keep = [c for c in docs.columns if spans_col is None or c.lower() != spans_col.lower()]
    at = keep.index(text_col)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField(f"c{n}", docs.schema[c].dataType) for n, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("spans", kind)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                done = [(None, []) if t is None else replace(t, p, back) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in done], pa.string())
                spans = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in found] for _, found in done], arrow)
                yield pa.RecordBatch.from_arrays([*columns, spans], names=[f.name for f in schema.fields])

    out = merged(docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema), docs)
    names = {c: f"c{n}" for n, c in enumerate(keep)} | ({spans_col: "spans"} if spans_col else {})
    return out.select(*[F.col(v).alias(c) for c, v in names.items()])
