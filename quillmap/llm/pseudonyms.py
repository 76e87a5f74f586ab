"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes its format's check (Luhn, IBAN modulus, calendar, octets, area codes) is turned
into a number below the size of its format, permuted by a keyed Feistel network with cycle walking,
and written back in the same format with a valid check digit. The permutation is a bijection that
depends on the key and the format alone: equal values get equal pseudonyms in every document, and
different values stay different.

Defined results: a null text stays null (no values); empty and very long texts are searched whole;
rows are treated one by one; an empty table gives an empty table; `pseudonymise` keeps all columns.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices

ROUNDS = 8
BLOCK = 1_024  #: characters that are permuted as one number
KINDS = ("email", "card", "iban", "phone", "ssn", "ipv4", "date", "secret")
_DIGITS, _LOWERS, _UPPERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Dates of these years have pseudonyms in these years, dates of others in others.
_NEAR_YEARS, _FAR_YEARS = range(1900, 2100), [*range(1, 1900), *range(2100, 10_000)]


class Feistel:
    """Keyed permutation of range(n) for each (label, n)."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, label: bytes, k: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(value.to_bytes(size + 1, "big") + len(out).to_bytes(4, "big"), key=self.key, person=bytes([k]) + hashlib.blake2b(label, digest_size=15).digest(), digest_size=min(64, size)).digest()
        return int.from_bytes(out[:size], "big") & (1 << bits) - 1

    def permute(self, label: str, n: int, value: int, back: bool = False) -> int:
        if n < 2:
            return value
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        name, mask = f"{label}/{n}".encode(), (1 << half) - 1
        while True:  # the network permutes a power of two below 4n; walk until inside
            left, right = value >> half, value & mask
            for k in range(ROUNDS):
                if back:
                    left, right = right ^ self._round(name, ROUNDS - 1 - k, left, half), left
                else:
                    left, right = right, left ^ self._round(name, k, right, half)
            value = left << half | right
            if value < n:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows these."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _refill(pattern: str, chars: str, keep: Callable[[str], bool]) -> str:
    it = iter(chars)
    return "".join(next(it) if keep(c) else c for c in pattern)


def _alphabet(c: str) -> str:
    return next((a for a in (_DIGITS, _LOWERS, _UPPERS) if c in a), c)


class Pseudonyms:
    """Finds values in a text and replaces them. `back=True` restores the originals of its own output."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False) -> None:
        if not key:
            raise ValueError("a secret key is needed")
        unknown = set(kinds) - set(KINDS)
        if unknown:
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        self.feistel, self.back = Feistel(key), back
        self.pattern = re.compile("|".join(f"(?P<{k}>{_PATTERNS[k]})" for k in _PATTERNS if k in kinds))
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, label: str, n: int, value: int) -> int:
        return self.feistel.permute(label, n, value, self.back)

    def _digits(self, label: str, digits: str) -> str:
        n = 10 ** len(digits)
        return f"{self._permute(label, n, int(digits)):0{len(digits)}d}" if digits else ""

    def _mixed(self, label: str, chars: str, alphabets: list[str]) -> str:
        """Characters of the given alphabets, permuted as one mixed-radix number."""
        n = value = 0
        n = 1
        for c, a in zip(chars, alphabets):
            n, value = n * len(a), value * len(a) + (a.index(c) if len(a) > 1 else 0)
        value = self._permute(label, n, value)
        out = []
        for a in reversed(alphabets):
            value, k = divmod(value, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    def _in_blocks(self, kind: str, label: str, flat: list[str]) -> str:
        """Characters permuted over their alphabets; long values block by block, since their numbers
        would be too large to multiply, or to write."""
        if len(flat) <= BLOCK:
            return self._mixed(label, "".join(flat), [_alphabet(c) for c in flat])
        name = f"{kind}/{hashlib.blake2b(label.encode()).hexdigest()}"
        blocks = [(k, flat[k : k + BLOCK]) for k in range(0, len(flat), BLOCK)]
        return "".join(self._mixed(f"{name}/{k}", "".join(b), [_alphabet(c) for c in b]) for k, b in blocks)

    def _card(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        if not (13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1):
            return None
        body = self._digits("card", digits[:-1])
        return _refill(v, body + luhn_digit(body), str.isdigit)

    def _iban(self, v: str) -> str | None:
        flat = v.replace(" ", "")
        country, check, rest = flat[:2], flat[2:4], flat[4:]
        if not 15 <= len(flat) <= 34 or len(flat) != _IBAN_SIZES.get(country, len(flat)) or iban_check(country, rest) != check:
            return None
        body = self._mixed("iban/" + country, rest, [_alphabet(c) for c in rest])
        return _refill(v, country + iban_check(country, body) + body, str.isalnum)

    def _phone(self, v: str) -> str | None:
        m = re.match(r"(\+\d{1,3}(?=[ .(-])|1[ .-](?=\d{3}[ .-]))?(.*)", v, re.S)
        code, rest = m[1] or "", m[2]
        if rest[0] == "+":  # no mark behind the calling code
            code = "+" + _CALLING_CODE.match(rest, 1)[0]
            rest = rest[len(code) :]
        digits = re.sub(r"\D", "", rest)
        if not 6 <= len(digits) <= 14:
            return None
        label = "+1" if code[:1] == "1" else code
        return code + _refill(rest, self._digits("phone/" + label, digits), str.isdigit)

    def _ssn(self, v: str) -> str | None:
        area, group, serial = map(int, v.split("-"))
        areas = [k for k in range(1, 900) if k != 666]
        if area not in areas or not group or not serial:
            return None
        n = len(areas) * 99 * 9999
        x = self._permute("ssn", n, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ipv4(self, v: str) -> str | None:
        octets = [int(x) for x in v.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in v.split(".")):
            return None
        x = self._permute("ipv4", 1 << 32, int.from_bytes(bytes(octets), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _email(self, v: str) -> str | None:
        local, _, domain = v.rpartition("@")
        before = local[: len(local) - len(local.lstrip("._%+-"))]  # marks in front are not part of the address
        local = local[len(before) :]
        name, dot, rest = domain.partition(".")
        flat = [c for c in local + "@" + name if c.isascii() and c.isalnum()]
        label = "email/" + re.sub("[A-Za-z0-9]", "x", local) + "@" + re.sub("[A-Za-z0-9]", "x", name) + "." + rest
        out = self._in_blocks("email", label, flat)
        both = _refill(local + "@" + name, out, lambda c: c.isascii() and c.isalnum())
        return before + both + dot + rest

    def _date(self, v: str) -> str | None:
        parts = re.split(r"([-/.])", v)
        a, b, c = (int(parts[k]) for k in (0, 2, 4))
        if len(parts[0]) == 4:
            order = "ymd"
        else:
            order = "dmy" if parts[1] == "." or a > 12 else "mdy"
        numbers = dict(zip(order, (a, b, c)))
        try:
            datetime.date(numbers["y"], numbers["m"], numbers["d"])
        except ValueError:
            return None
        # the pseudonym is among the dates that are written, and read, in the same way
        width = {k: len(x) for k, x in zip(order, parts[::2])}
        late = order == "dmy" and parts[1] != "."  # day first only shows with a day above 12
        near = numbers["y"] in _NEAR_YEARS
        days = _calendar(near, width["m"], width["d"], late)
        label = ("late " if late else "") + "date" + ("" if near else " of other years") + ("" if width["m"] == width["d"] == 2 else f"/{width['m']}{width['d']}")
        new = dict(zip("ymd", days.date(self._permute(label, days.count, days.rank(numbers["y"], numbers["m"], numbers["d"])))))
        return parts[1].join(f"{new[k]:0{len(x)}d}" for k, x in zip(order, parts[::2]))

    def _secret(self, v: str) -> str | None:
        m = re.match(r"(AKIA|(?i:password|passwd|pwd|secret|token|api_key|apikey)[\"']?\s*[=:]\s*[\"']?)(.*)", v, re.S)
        flat = [c for c in m[2] if c.isascii() and c.isalnum()]
        if not flat:
            return None
        out = self._in_blocks("secret", "secret/" + re.sub("[A-Za-z0-9]", "x", m[2]), flat)
        return m[1] + _refill(m[2], out, lambda c: c.isascii() and c.isalnum())

    def value(self, kind: str, found: str) -> str | None:
        """The pseudonym; None if the value fails its check."""
        at = (kind, found)
        if at not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[at] = getattr(self, "_" + kind)(found)
        return self.known[at]

    def _first(self, kind: str, found: str) -> tuple[str, str | None]:
        """The longest part from the start of a candidate on that passes its check, and its pseudonym."""
        for part in _parts(kind, found):
            if (new := self.value(kind, part)) is not None:
                return part, new
        return found, None

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}
        out, done, at = [], 0, 0
        while m := self.pattern.search(text, at):
            part, new = self._first(m.lastgroup, m[0])
            if new is None:
                at = m.start() + 1  # another value may begin inside
                continue
            counts[m.lastgroup] = counts.get(m.lastgroup, 0) + 1
            out += [text[done : m.start()], new]
            done = at = m.start() + len(part)
        return "".join([*out, text[done:]]), counts


def _parts(kind: str, found: str) -> list[str]:
    """A candidate, then, where following words can look like its last groups, what is left without them."""
    if not (kind == "iban" and found[:2] in _IBAN_SIZES or kind == "phone" and found[0] == "+"):
        return [found]
    parts = [found, *(found[:k] for k in range(len(found) - 1, 0, -1) if not found[k].isalnum() and found[k - 1].isalnum())]
    if found[:2] == "+1":  # numbers of this zone have ten digits more
        parts.sort(key=lambda x: sum(map(str.isdigit, x)) != 11)
    return parts


class _Calendar:
    """The dates of some years whose month and day can be written with so many digits, in order."""

    def __init__(self, near: bool, month: int, day: int, late: bool) -> None:
        self.years = _NEAR_YEARS if near else _FAR_YEARS
        fits = lambda m, d: (month == 2 or m < 10) and (day == 2 or d < 10) and (not late or d > 12)
        self.days = [[(m, d) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1) if fits(m, d)] for y in (2023, 2024)]
        self.place = [{x: k for k, x in enumerate(days)} for days in self.days]
        self.starts = [0, *itertools.accumulate(len(self.days[calendar.isleap(y)]) for y in self.years)]
        self.count = self.starts[-1]

    def rank(self, y: int, m: int, d: int) -> int:
        return self.starts[bisect.bisect_left(self.years, y)] + self.place[calendar.isleap(y)][m, d]

    def date(self, rank: int) -> tuple[int, int, int]:
        k = bisect.bisect_right(self.starts, rank) - 1
        y = self.years[k]
        return y, *self.days[calendar.isleap(y)][rank - self.starts[k]]


_calendar = functools.cache(_Calendar)

#: Calling codes: zones 1 and 7, those of two digits, and all others of three.
_CALLING_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")

# Characters of an IBAN by country, as registered or in use; of other codes, a whole candidate with a right modulus counts.
_IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        28: "AL AZ BF BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

# In the order in which they are tried at a place. Each begins with a fixed kind of character.
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api_key|apikey)[\"']?\s?[=:]\s?[\"']?[^\s\"']{5,}[^\s\"'.,;:!?)\]}>]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{1,2}|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})(?![\d/-]|\.\d)",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?(?!\d{1,3}\.\d{1,3}\.\d{1,3}\.\d)\d{2,4}){1,3}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-](?!\d{1,3}\.\d{1,3}\.\d{1,3}\.\d)\d{2,8}){1,5}(?!\d)|(?<!\w)\+(?:\d{7,15}|\d{4,6}(?:[ .-](?!\d{1,3}\.\d{1,3}\.\d{1,3}\.\d)\d{2,8}){1,4})(?!\d)|(?<![\d.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
}

_HAS = re.compile(r"[@\d]|password|passwd|pwd|secret|token|api_key|apikey", re.I)


def pseudonymise(
    docs: DataFrame,
    key: bytes,
    kinds: tuple[str, ...] = KINDS,
    text_col: str = "text",
    counts_col: str | None = None,
    back: bool = False,
) -> DataFrame:
    """The documents with all their columns and pseudonyms in the text; with `counts_col`, also a
    map from kind to the number of values replaced. One pass of the scan, no shuffle. The key is
    the secret that the pseudonyms hang on: who has it can restore the originals."""
    ship(docs.sparkSession)
    if counts_col in docs.columns:
        raise ValueError(f"column {counts_col} is there already")
    Pseudonyms(key, kinds, back)  # wrong parameters fail here and not in a task
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)
    target = docs.withColumn(counts_col, F.lit(None).cast("map<string,int>")).schema if counts_col else docs.schema

    def run(batches):
        names = Pseudonyms(key, kinds, back)
        for batch in batches:
            for part, _ in text_slices(batch, at):
                texts, found = [], []
                for text in part.column(at).to_pylist():
                    new, counts = names(text) if text and _HAS.search(text) else (text, {})
                    texts.append(new)
                    found.append(list(counts.items()))
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                if counts_col:
                    columns.append(pa.array(found, pa.map_(pa.string(), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return docs.mapInArrow(run, target)
