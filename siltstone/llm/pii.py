"""Format-preserving Feistel pseudonyms for personal data.

Numbers and dates that pass validation (card numbers by Luhn, IBANs by mod 97, IPv4 octets, social
security numbers by their ranges, dates by the calendar), telephone numbers and the local parts of
e-mail addresses are replaced by another value of the same format.  A value is a number below the
size N of its format's domain; E is a keyed Feistel permutation of [0, N) by cycle walking, and
the pseudonym is E(E^-1(x) + 1 mod N): a keyed permutation without fixed points, so equal values
stay linked over all documents, different values stay different, and no value stays as it is.

A date's domain are the days with as many digits in day and month, and with a day above or below 12:
so a date keeps its width however it is written, and equal dates in different styles stay linked.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import read, slices

ROUNDS = 8
#: The registered query's key; a real run passes a secret one.
DEMO_KEY = b"siltstone demo key"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
FIND = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<ymd>(?<!\d)\d{4}-\d{2}-\d{2}(?!\d))"
    r"|(?P<dmy>(?<!\d)\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<tel>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{1,4}){1,5}(?!\d)|(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))",
    re.A,
)
#: Characters of an IBAN by country.
IBAN_SIZE = {
    k: int(n)
    for n, ks in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT", 26: "IS TR", 27: "FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW", 31: "MT SC", 32: "LC",
    }.items()
    for k in ks.split()
}
MAIL = re.compile(r"([A-Za-z0-9._%+\-]+)(@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})", re.A)


class Permutation:
    """The fixed-point-free keyed permutation of [0, n)."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.size = (self.half + 7) // 8
        self.key = blake2b(f"{label}/{n}".encode(), key=key[:64], digest_size=32).digest()

    def _mix(self, i: int, x: int) -> int:
        h = blake2b(bytes((i,)) + x.to_bytes(self.size, "big"), key=self.key, digest_size=min(64, self.size))
        return int.from_bytes(h.digest(), "big") & self.mask

    def _walk(self, x: int, rounds) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in rounds:
                a, b = b, a ^ self._mix(i, b)
            x = b << self.half | a  # swapped, so the same walk with the rounds reversed inverts it
            if x < self.n:
                return x

    def encrypt(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def decrypt(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))

    def __call__(self, x: int) -> int:
        return self.encrypt((self.decrypt(x) + 1) % self.n) if self.n > 1 else x


@lru_cache(maxsize=4096)
def permutation(key: bytes, label: str, n: int) -> Permutation:
    return Permutation(key, label, n)


def luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def refill(template: str, symbols: str) -> str:
    """``template`` with its letters and digits replaced in order."""
    new = iter(symbols)
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in template)


def alnum(key: bytes, label: str, symbols: str) -> str:
    """Permute a string of ASCII letters and digits within its letter and digit places; lower
    case comes back lower, upper case upper."""
    radix = [10 if c.isdigit() else 26 for c in symbols]
    n, x = 1, 0
    for c, r in zip(symbols, radix):
        x = x * r + (int(c) if r == 10 else ord(c.lower()) - 97)
        n *= r
    x = permutation(key, label + "".join("d" if r == 10 else "a" for r in radix), n)(x)
    out = []
    for c, r in zip(reversed(symbols), reversed(radix)):
        x, d = divmod(x, r)
        out.append(str(d) if r == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym, or None if it is not valid."""
    own = re.sub(r"[^A-Za-z0-9]", "", value)
    if kind == "card":
        if luhn(own[:-1]) != int(own[-1]) or not own.strip("0"):
            return None
        body = f"{permutation(key, kind, 10 ** (len(own) - 1))(int(own[:-1])):0{len(own) - 1}d}"
        return refill(value, body + str(luhn(body)))
    if kind == "iban":
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if number(own[4:] + own[:4]) % 97 != 1:
            return None
        body = alnum(key, kind + own[:2], own[4:])
        return refill(value, f"{own[:2]}{98 - number(body + own[:2] + '00') % 97:02d}{body}")
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        return ".".join(map(str, permutation(key, kind, 1 << 32)(int.from_bytes(bytes(parts))).to_bytes(4)))
    if kind == "ssn":
        area, group, serial = (int(p) for p in value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(permutation(key, kind, 898 * 99 * 9999)(x), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind in ("ymd", "dmy"):
        return _date(kind, value, key)
    if kind == "email":
        local, at, host = value.partition("@")
        symbols = re.sub(r"[^A-Za-z0-9]", "", local)
        return refill(local, alnum(key, kind, symbols)) + at + host if symbols else None
    if kind == "tel":
        if not 7 <= len(own) <= 15:
            return None
        keep = len(re.match(r"\+\d+", value)[0]) - 1 if value[0] == "+" else 0
        if keep >= len(own):  # an unbroken international number: its first digit stays
            keep = 1
        rest = own[keep:]
        return refill(value, own[:keep] + f"{permutation(key, kind + own[:keep], 10 ** len(rest))(int(rest)):0{len(rest)}d}")
    raise ValueError(kind)


@lru_cache(maxsize=1)
def _days() -> tuple[dict[int, tuple[tuple[int, int], int]], dict[tuple[int, int], list[int]]]:
    """A day's domain and its place there; each domain's days in order."""
    place, domains = {}, {}
    for x in range(FIRST_DAY, LAST_DAY + 1):
        d = dt.date.fromordinal(x)
        domain = (0 if d.day < 10 else 1 if d.day <= 12 else 2, int(d.month >= 10))
        days = domains.setdefault(domain, [])
        place[x] = (domain, len(days))
        days.append(x)
    return place, domains


def _date(kind: str, value: str, key: bytes) -> str | None:
    fields = re.split(r"[-./]", value)
    a, b, c = map(int, fields)
    tries = [("ymd", a, b, c)] if kind == "ymd" else [("dmy", c, b, a), ("mdy", c, a, b)]
    for style, y, m, d in tries:
        try:
            x = dt.date(y, m, d).toordinal()
        except ValueError:
            continue
        place, domains = _days()
        if x not in place:
            return None
        domain, i = place[x]
        days = domains[domain]
        new = dt.date.fromordinal(days[permutation(key, f"date{domain}", len(days))(i)])
        if style == "ymd":
            return new.isoformat()
        sep = re.search(r"[./]", value)[0]
        both = (new.day, new.month) if style == "dmy" else (new.month, new.day)
        first, second = (f"{x:0{len(old)}d}" for x, old in zip(both, fields))
        return f"{first}{sep}{second}{sep}{new.year}"
    return None


def shorter(value: str) -> list[str]:
    """A possible IBAN's beginnings that end with a group, that of its country's length first,
    then the longest first."""
    ends = [i for i in range(1, len(value) + 1) if value[i - 1] != " " and (i == len(value) or value[i] == " ")]
    cuts = [value[:i] for i in reversed(ends)]
    size = IBAN_SIZE.get(value[:2])
    cuts.sort(key=lambda v: len(v.replace(" ", "")) != size)
    return [v for v in cuts if v == value or len(v.replace(" ", "")) >= 15]


def redact(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """-> (new text, [(kind, start, end) in the old text, in order]).  One pass over the old text: an
    e-mail address is one value, whatever numbers its local part holds."""
    found: list[tuple[str, int, int]] = []
    parts, done, at = [], 0, 0

    def put(kind: str, start: int, end: int, new: str) -> None:
        nonlocal done
        parts.extend((text[done:start], new))
        found.append((kind, start, end))
        done = end

    def numbers(at: int, end: int) -> None:
        while m := FIND.search(text, at, end):
            kind = m.lastgroup
            for value in shorter(m[0]) if kind == "iban" else (m[0],):
                new = pseudonym(kind, value, key)
                if new is not None:
                    at = m.start() + len(value)
                    put(kind, m.start(), at, new)
                    break
            else:
                at = m.start() + 1  # what was rejected may hide a value

    for m in MAIL.finditer(text) if "@" in text else ():
        new = pseudonym("email", m[0], key)
        if new is not None:
            numbers(at, m.start())
            put("email", m.start(), m.end(), new)
            at = m.end()
    numbers(at, len(text))
    return "".join((*parts, text[done:])), found


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, text, n_values, kinds): every row with its personal data replaced; ``kinds`` names
    what was found, sorted.  A null text stays null with none found; empty texts, repeated rows
    and empty tables pass through; other columns are not looked at."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                out = [redact(t, key) if t is not None else (None, []) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([t for t, _ in out], pa.string()),
                        pa.array([len(f) for _, f in out], pa.int32()),
                        pa.array([",".join(sorted({k for k, _, _ in f})) for _, f in out], pa.string()),
                    ],
                    names=["id", "text", "n_values", "kinds"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "id long, text string, n_values int, kinds string")


def op5(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents"), DEMO_KEY).withColumnRenamed("id", "doc_id")
