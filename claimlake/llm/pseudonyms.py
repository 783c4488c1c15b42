"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each value found is checked first (Luhn, IBAN's modulo 97, number plans, calendar) and then permuted by a
keyed Feistel network over the values of its own format, so equal values have equal pseudonyms in all
documents, different values different ones, and pseudonyms pass the same checks.  With the key
they can be turned back.  Where a permuted value falls outside its format, it is permuted again
(cycle walking), which stays a permutation.

All values are found in the text as given and replaced once: e-mail addresses first, then IBANs, then numbers that do not
overlap these.  What does not pass its check stays.  Null texts stay null and have no kinds; empty texts and repeated rows are
treated like any others.  Of kept columns, those called ``text`` or ``kinds`` give way to the operator's own.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Permutation:
    """Keyed permutation of range(size), by an unbalanced mix of two digits a and b of about equal range."""

    def __init__(self, key: bytes, domain: str, size: int):
        self.key, self.domain, self.size = key, domain.encode(), size
        self.low = math.isqrt(max(1, size) - 1) + 1  # the least whose square holds the size
        self.bytes = self.low.bit_length() // 8 + 1

    def _value(self, turn: int, x: int) -> int:
        data = self.domain + b"\0" + turn.to_bytes(1, "big") + x.to_bytes(self.bytes, "big")
        seed = hashlib.blake2b(data, key=self.key, digest_size=32).digest()
        return int.from_bytes(hashlib.shake_256(seed).digest(self.bytes + 16), "big")

    def _once(self, x: int, turns: Iterator[int], sign: int) -> int:
        a, b = divmod(x, self.low)
        for turn in turns:
            if turn % 2:
                a = (a + sign * self._value(turn, b)) % self.low
            else:
                b = (b + sign * self._value(turn, a)) % self.low
        return a * self.low + b

    def forward(self, x: int) -> int:
        x = self._once(x, range(ROUNDS), 1)
        while x >= self.size:
            x = self._once(x, range(ROUNDS), 1)
        return x

    def backward(self, x: int) -> int:
        x = self._once(x, range(ROUNDS - 1, -1, -1), -1)
        while x >= self.size:
            x = self._once(x, range(ROUNDS - 1, -1, -1), -1)
        return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _like(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    def __init__(self, key: bytes, backward: bool = False):
        if not 0 < len(key) <= 64:
            raise ValueError("a key of 1 to 64 bytes is needed")
        self.key, self.backward = key, backward
        self._known: dict[tuple[str, str], str | None] = {}

    def _permuted(self, domain: str, size: int, x: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        p = Permutation(self.key, domain, size)
        step = p.backward if self.backward else p.forward
        x = step(x)
        while not valid(x):
            x = step(x)
        return x

    def _digits(self, domain: str, digits: str, valid: Callable[[str], bool] = lambda d: True) -> str:
        n = len(digits)
        return f"{self._permuted(f'{domain}{n}', 10**n, int(digits), lambda x: valid(f'{x:0{n}d}')):0{n}d}"

    def card(self, found: str) -> str | None:
        d = re.sub(r"\D", "", found)
        if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn_digit(d[:-1]) != d[-1]:
            return None
        payload = d[0] + self._digits(f"card{d[0]}", d[1:-1])
        return _like(found, payload + luhn_digit(payload))

    def phone(self, found: str) -> str | None:
        d = re.sub(r"\D", "", found)
        plan = lambda x: x[0] in "23456789" and x[3] in "23456789"
        if len(d) == 11 and d[0] == "1":
            return _like(found, "1" + self._digits("phone", d[1:], plan)) if plan(d[1:]) else self._phone_loose(found, d)
        return _like(found, self._digits("phone", d, plan)) if len(d) == 10 and plan(d) else self._phone_loose(found, d)

    def _phone_loose(self, found: str, d: str) -> str | None:
        """Other numbers written with a plus: their country's first digit stays."""
        return _like(found, d[0] + self._digits("tel" + d[0], d[1:], lambda x: True)) if found.lstrip().startswith("+") and 8 <= len(d) <= 15 else None

    def ssn(self, found: str) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = re.sub(r"\D", "", found)
        return _like(found, self._digits("ssn", d, valid)) if valid(d) else None

    def ip(self, found: str) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255:
            return None
        x = self._permuted("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, y: str, m: str, d: str, domain: str = "date", fits: Callable[[datetime.date], bool] = lambda day: True) -> datetime.date | None:
        """The date's pseudonym among those that fit, which the date itself must do."""
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY or not fits(day):
            return None
        of = lambda x: _FIRST_DAY + datetime.timedelta(x)
        return of(self._permuted(domain, (_LAST_DAY - _FIRST_DAY).days + 1, (day - _FIRST_DAY).days, lambda x: fits(of(x))))

    def date_iso(self, found: str) -> str | None:
        day = self._day(found[:4], found[5:7], found[8:10])
        return day and f"{day.year:04d}-{day.month:02d}-{day.day:02d}"

    def date_day_first(self, found: str) -> str | None:
        """Day first, or month first where only that is a date; the pseudonym reads the same way and has as many digits."""
        a, b, y = re.split(r"[/.]", found)
        mark, bare = found[len(a)], len(a) == 1 or len(b) == 1
        width = lambda n: len(str(n))
        for name, d, m in (("day", a, b), ("month", b, a)):
            like = lambda day, d=d, m=m: not bare or (width(day.day) == len(d) and width(day.month) == len(m))
            fits = like if name == "day" else (lambda day, like=like: like(day) and day.day > 12)
            day = self._day(y, m, d, "date" if name == "day" and not bare else f"date {name} {len(d)} {len(m)} {bare}", fits)
            if day:
                parts = [day.day, day.month] if name == "day" else [day.month, day.day]
                return mark.join([*(str(x) if bare else f"{x:02d}" for x in parts), f"{day.year:04d}"])
        return None

    def iban(self, found: str) -> str | None:
        bare = found.replace(" ", "")
        country, check, rest = bare[:2], bare[2:4], bare[4:]
        if not 15 <= len(bare) <= 34 or iban_digits(country, rest) != check:
            return None
        rest = self._mixed(f"iban{country}", rest)
        it = iter(country + iban_digits(country, rest) + rest)
        return "".join(" " if c == " " else next(it) for c in found)

    def email(self, found: str) -> str | None:
        local, _, domain = found.partition("@")
        return f"{self._mixed('email', local)}@{domain}"

    def _mixed(self, domain: str, text: str) -> str:
        """Digits to digits and letters to letters of the same case, as one number of mixed radix."""
        radix = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        x, size = 0, 1
        for c, r in zip(text, radix):
            x = x * r + (int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0)
            size *= r
        if size == 1:
            return text
        x, out = self._permuted(f"{domain}:{''.join('d' if r == 10 else 'a' if r == 26 else c for c, r in zip(text, radix))}", size, x), []
        for c, r in zip(reversed(text), reversed(radix)):
            x, v = divmod(x, r)
            out.append(str(v) if r == 10 else (chr(97 + v).upper() if c.isupper() else chr(97 + v)) if r == 26 else c)
        return "".join(reversed(out))

    def of(self, kind: str, found: str) -> str | None:
        key = (kind, found)
        if key not in self._known:
            if len(self._known) >= 200_000:
                self._known.clear()
            self._known[key] = getattr(self, kind)(found)
        return self._known[key]


#: Values that begin with a digit or a sign; ``kind`` is the group's name.
NUMBERS = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<date_iso>\d{4}-\d{2}-\d{2})"
    r"|(?P<date_day_first>\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"|(?P<card>\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})"
    r")(?![\w-]|\.\d)"
)
IBANS = re.compile(r"\b(?P<iban>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))\b")
#: A local part has at most 64 characters (RFC 5321).
EMAILS = re.compile(r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")

#: Characters of an IBAN by country (ISO 13616); spaced ones end there, other countries' where the groups do.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28,
    HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29,
    RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)


def _iban_end(found: str) -> int:
    """Where a spaced IBAN ends in the groups found: at its country's length, if a group ends there."""
    n, length = 0, IBAN_LENGTHS.get(found[:2])
    for i, c in enumerate(found):
        n += c != " "
        if n == length and found[i + 1 : i + 2] in ("", " "):
            return i + 1
    return len(found)


def values(text: str, names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, pseudonym`` of the values to replace, in the text's order; none overlap."""
    out: list[tuple[int, int, str, str]] = []
    for pattern in (EMAILS, IBANS, NUMBERS):
        if pattern is EMAILS and "@" not in text:
            continue
        taken, at = sorted(out), 0
        for m in pattern.finditer(text):
            a, b = m.span()
            if m.lastgroup == "iban":
                b = a + _iban_end(m.group())
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at < len(taken) and taken[at][0] < b:
                continue
            new = names.of(m.lastgroup, text[a:b])
            if new is not None:
                out.append((a, b, m.lastgroup, new))
    return sorted(out)


def pseudonymised(text: str, names: Pseudonyms) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds replaced."""
    found, parts, done = values(text, names), [], 0
    for a, b, _, new in found:
        parts += [text[done:a], new]
        done = b
    return "".join([*parts, text[done:]]), [kind for _, _, kind, _ in found]


def _apply(batches: Iterator[pa.RecordBatch], key: bytes, backward: bool) -> Iterator[pa.RecordBatch]:
    names = Pseudonyms(key, backward)
    for batch in batches:
        texts, found = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            new, kinds = (None, []) if text is None else pseudonymised(text, names)
            texts.append(new)
            found.append(kinds)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "text", "kinds"])


def pseudonymise(docs: DataFrame, keep: list[str], key: bytes, text_col: str = "text", backward: bool = False) -> DataFrame:
    """``keep``, ``text`` with pseudonyms and ``kinds`` replaced; ``backward`` restores with the same key."""
    Pseudonyms(key)
    keep = [c for c in keep if c.lower() not in ("text", "kinds")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:-1]
    return rows.mapInArrow(functools.partial(_apply, key=key, backward=backward), ", ".join([*kept, "text string", "kinds array<string>"]))


QUERY_KEY = b"of the registered query; users bring their own"


def digest(docs: DataFrame) -> DataFrame:
    """Every document with pseudonyms."""
    return pseudonymise(docs, ["doc_id"], QUERY_KEY).select("doc_id", F.size("kinds").cast("long").alias("n_replaced"), F.array_sort("kinds").alias("kinds"), "text")
