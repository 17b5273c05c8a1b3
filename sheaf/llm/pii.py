"""Personal data replaced by format-preserving Feistel pseudonyms.

Only validated values change: payment cards (Luhn), IBANs (mod 97 and the country's length), US social security numbers, phone
numbers (international, or North American without country code, which links with the same number after +1), IPv4 and global IPv6
addresses, e-mail addresses and calendar dates. Each is mapped to a number below the size of its format, permuted there
by a keyed Feistel network with cycle walking, and written in the same format, check digits and separators included; so
equal values get equal pseudonyms in every document, and with the key the mapping can be undone.

A date is permuted as a day, whatever its format, among the days whose day of the month is as long (under 10, to 12, above) and whose
month is as long: so 05.01.2020, 5.1.2020 and 2020-01-05 stay linked and every format keeps its widths.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import map_batches, table
from sheaf.llm.words import slices

#: A stand-in; a real run passes its own secret.
KEY = b"replace this key"
ROUNDS = 10
#: Setting of the session that names the key of the registered query.
KEY_SETTING = "spark.sheaf.pii.key"
KINDS = ("card", "iban", "ssn", "phone", "ip", "email", "date")
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), (date(2100, 1, 1) - date(1900, 1, 1)).days

_GLOBAL = ipaddress.IPv6Network("2000::/3")

_EMAIL = re.compile(r"(?<![\w.%+\-])([A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})@((?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w\-])")
_NUMBER = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w))"
    r"|(?P<date>(?<![\w./\-])(?:\d{4}(?P<s1>[\-/.])\d{1,2}(?P=s1)\d{1,2}(?=T\d\d|(?![\w/\-]|\.\d))|\d{1,2}(?P<s2>[\-/.])\d{1,2}(?P=s2)\d{4}(?![\w/\-]|\.\d)))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w))"
    r"|(?P<local>(?<![\w+.\-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[.\-])[2-9]\d\d[.\-]\d{4}(?![\w\-]|\.\d))"
    r"|(?P<card>(?<![\w.\-])\d(?:[ \-]?\d){12,40}(?!\w|[.\-]\d))"
)
_MAYBE = re.compile(r"[0-9]")
#: Most digits of a phone number, country code included, by the digits that stay; 15 for the rest.
_PHONE_DIGITS = {"1": 11, "7": 11, "20": 12, "27": 11, "31": 11, "32": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10, "48": 11, "52": 12, "61": 11, "65": 10, "81": 12, "86": 13, "91": 12}


#: Characters of an IBAN by country, of the public registry; elsewhere any length from 15 to 34.
_IBAN_LENGTH = {
    k: int(n)
    for n, countries in (x.split(":") for x in "15:NO 16:BE 18:DK FO FI GL NL SD 19:MK SI 20:AT BA EE KZ XK LT LU MN 21:CH HR LI LV 22:BG BH CR DE GB GE IE ME RS VA 23:AE GI IL IQ OM SO TL 24:AD CZ ES MD PK RO SA SE SK TN VG 25:LY PT ST 26:IS TR 27:BI DJ FR GR IT MC MR SM 28:AL AZ BY CY DO GT HU LB NI PL SV 29:BR EG PS QA UA 30:JO KW MU YE 31:MT SC 32:LC 33:RU".replace(" 1", ";1").replace(" 2", ";2").replace(" 3", ";3").split(";"))
    for k in countries.split()
}
#: How cards are grouped on paper.
_CARD_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), *((n,) for n in range(13, 20))}


class Feistel:
    """A keyed permutation of range(n) for each n and label."""

    def __init__(self, key: bytes = KEY, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, label: bytes, r: int, half: int, bits: int) -> int:
        h = hashlib.blake2b(half.to_bytes(32, "big"), key=self.key, digest_size=32, person=hashlib.blake2b(label + bytes([r]), digest_size=16).digest())
        return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1)

    def _once(self, x: int, label: bytes, bits: int, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(label, r, left, bits), left
            else:
                left, right = right, left ^ self._round(label, r, right, bits)
        return left << bits | right

    def permute(self, x: int, n: int, label: str, back: bool = False) -> int:
        if not 0 <= x < n:
            raise ValueError("out of range")
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        tag = f"{label}:{n}".encode()
        while True:  # cycle walking: at most about four steps on average
            x = self._once(x, tag, bits, back)
            if x < n:
                return x


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced by ``digits`` in turn."""
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in shape)


def _mixed(text: str, f: Feistel, label: str, back: bool) -> str:
    """Letters become letters of their case, digits digits; all else stays."""
    x, n, bases = 0, 1, []
    for c in text:
        base, zero = (10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c)
        bases.append((base, zero))
        x, n = x * base + ord(c) - ord(zero), n * base
    if n == 1:
        return text
    x, out = f.permute(x, n, label, back), []
    for base, zero in reversed(bases):
        x, r = divmod(x, base)
        out.append(chr(ord(zero) + r))
    return "".join(reversed(out))


def _card(s: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    n = 10 ** (len(digits) - 2)  # the first digit, the industry, stays, and the last is the check digit
    new = digits[0] + str(f.permute(int(digits[1:-1]), n, "card" + digits[0], back)).zfill(len(digits) - 2)
    return _fill(s, new + next(c for c in "0123456789" if luhn(new + c)))


def _iban_value(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


def _iban(s: str, f: Feistel, back: bool) -> str | None:
    flat = s.replace(" ", "")
    if _IBAN_LENGTH.get(flat[:2], len(flat)) != len(flat) or not 15 <= len(flat) <= 34 or _iban_value(flat) % 97 != 1:
        return None
    body = _mixed(flat[4:], f, "iban" + flat[:2], back)
    check = 98 - _iban_value(flat[:2] + "00" + body) % 97
    given = iter(flat[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(given) for c in s)


def _ssn(s: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute(x, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(s: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    code = 1 if digits[0] in "17" else 2  # the country code stays
    if len(digits) == 11 and digits[0] == "1":
        return _fill(s, "1" + _american(digits[1:], f, back))
    new = str(f.permute(int(digits[code:]), 10 ** (len(digits) - code), "phone" + digits[:code], back)).zfill(len(digits) - code)
    return _fill(s, digits[:code] + new)


def _ip(s: str, f: Feistel, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ip6(s: str, f: Feistel, back: bool) -> str | None:
    try:
        address = ipaddress.IPv6Address(s)
    except ValueError:
        return None
    if address not in _GLOBAL:
        return None
    new = ipaddress.IPv6Address(int(_GLOBAL[0]) + f.permute(int(address) - int(_GLOBAL[0]), _GLOBAL.num_addresses, "ip6", back))
    text = new.exploded if len(s) == 39 else ":".join(g.lstrip("0") or "0" for g in new.exploded.split(":")) if "::" not in s and s.count(":") == 7 and new.compressed.find("::") < 0 else new.compressed
    return text.upper() if s.upper() == s and s.lower() != s else text


def _local(s: str, f: Feistel, back: bool) -> str | None:
    return _fill(s, _american(re.sub(r"\D", "", s), f, back))


def _american(digits: str, f: Feistel, back: bool) -> str:
    """Ten digits to ten; those with an area and an exchange that may be dialled stay among such."""
    dialled = lambda d: d[0] > "1" and d[3] > "1"
    new = digits
    while new == digits or dialled(new) != dialled(digits):
        new = str(f.permute(int(new), 10**10, "phone1", back)).zfill(10)
        if new == digits:
            break
    return new


def _date(s: str, f: Feistel, back: bool) -> str | None:
    sep = next(c for c in s if not c.isdigit())
    parts = s.split(sep)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]  # year month day; day first unless only month first is a date
    for order in orders:
        try:
            day = date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        x = day.toordinal() - _FIRST_DAY
        if not 0 <= x < _DAYS:
            return None
        while True:  # within the days of the same class, so that any format the date comes in fits
            x = f.permute(x, _DAYS, "date", back)
            new = date.min + timedelta(days=x + _FIRST_DAY - 1)
            if _class(new) == _class(day):
                value = dict(zip(order, (new.year, new.month, new.day), strict=True))
                return sep.join(str(value[i]).zfill(len(parts[i])) for i in range(3))
    return None


def _class(day: date) -> tuple[bool, bool, bool]:
    return day.day < 10, day.day <= 12, day.month < 10


_BY_KIND: dict[str, Callable[[str, Feistel, bool], str | None]] = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "local": _local, "ip": _ip, "ip6": _ip6, "date": _date}
#: Kinds that are counted as another.
_COUNTED = {"local": "phone", "ip6": "ip"}


def _kind(m: re.Match) -> str:
    return next(k for k in _BY_KIND if m[k] is not None)


def _ends(m: re.Match) -> list[int]:
    """Where a match may end at a whole group of digits or letters, the longest first."""
    return [e for e in range(m.end(), m.start() + 7, -1) if m.string[e - 1].isalnum() and (e == m.end() or not m.string[e].isalnum())]


def _phone_end(m: re.Match, f: Feistel, back: bool) -> int | None:
    """Where the phone of a match ends: not across a value of another kind, and not beyond the digits that its country code allows."""
    s, at = m.string, m.start()
    fine = [e for e in _ends(m) if _phone(s[at:e], f, back) is not None]
    for i in range(at + 1, m.end()):
        if s[i].isdigit() and not s[i - 1].isalnum() and (o := _NUMBER.match(s, i)):
            strong = o["card"] is None and o["local"] is None and _BY_KIND[_kind(o)](o[0], f, back) is not None
            weak = o["card"] is not None and any(_card(s[i:e], f, back) is not None for e in _ends(o)) and any(e <= i for e in fine)
            if strong or weak:
                fine = [e for e in fine if e <= i]
                break
    digits = lambda e: re.sub(r"\D", "", s[at:e])
    most = lambda d: _PHONE_DIGITS.get(d[0] if d[0] in "17" else d[:2], 15)
    return next((e for e in fine if len(digits(e)) <= most(digits(e))), fine[-1] if fine else None)


def _card_span(m: re.Match) -> tuple[int, int] | None:
    """The card within a run of digit groups: first those grouped as cards are, then the first and longest of groups of three or more."""
    groups = [(g.start(), g.end()) for g in re.finditer(r"\d+", m[0])]
    fine = []
    for i, (a, _) in enumerate(groups):
        if m[0][a] not in "23456" and i:
            continue
        for j in range(i, len(groups)):
            digits = re.sub(r"\D", "", m[0][a : groups[j][1]])
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits) and len(set(digits)) > 1 and (digits[0] in "23456" or (i == 0 and j == len(groups) - 1)):
                shape = tuple(e - s for s, e in groups[i : j + 1])
                if shape in _CARD_SHAPES or min(shape) > 2:
                    fine.append((shape not in _CARD_SHAPES, i, -j, m.start() + a, m.start() + groups[j][1]))
    return min(fine)[3:] if fine else None


def _numbers(text: str, f: Feistel, back: bool, counts: dict[str, int]) -> str:
    """``text`` with its values other than e-mail addresses replaced. What doesn't validate is tried shorter, then from inside."""
    out, done, at = [], 0, 0
    while m := _NUMBER.search(text, at):
        kind = _kind(m)
        if kind == "card":
            spans = [span] if (span := _card_span(m)) else []
        else:
            spans = [(m.start(), e) for e in ([_phone_end(m, f, back)] if kind == "phone" else _ends(m) if kind == "iban" else [m.end()]) if e is not None]
        for start, end in spans:
            if (new := _BY_KIND[kind](text[start:end], f, back)) is not None:
                counted = _COUNTED.get(kind, kind)
                counts[counted] = counts.get(counted, 0) + 1
                out += [text[done:start], new]
                done = at = end
                break
        else:
            at = m.start() + 1
    return "".join([*out, text[done:]])


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind there were; ``back`` undoes it."""
    counts: dict[str, int] = {}

    def email(m: re.Match) -> str:
        counts["email"] = counts.get("email", 0) + 1
        return _mixed(m[1], f, "email", back) + "@" + m[2]

    if not _MAYBE.search(text) and "@" not in text:
        return text, counts
    if "@" not in text:
        return _numbers(text, f, back, counts), counts
    out, at = [], 0  # what lies between e-mail addresses is searched for numbers
    for m in _EMAIL.finditer(text):
        out += [_numbers(text[at : m.start()], f, back, counts), email(m)]
        at = m.end()
    return "".join([*out, _numbers(text[at:], f, back, counts)]), counts


def pseudonyms(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_card, n_iban, n_ssn, n_phone, n_ip, n_email, n_date), one row for each row of ``docs``.

    A null text stays null with counts of 0, an empty one empty; very long texts are searched whole; a null doc_id stays null; repeated
    rows are done each and alike; values that could be of two kinds count as the first of iban, ip, date, ssn, phone, card; other columns
    don't matter; an empty table gives none.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        f = Feistel(key)
        for part in slices(batch):
            new, counts = [], {k: [] for k in KINDS}
            for text in part.column("text").to_pylist():
                done, found = (None, {}) if text is None else pseudonymise(text, f)
                new.append(done)
                for k in KINDS:
                    counts[k].append(found.get(k, 0))
            yield {"doc_id": part.column("doc_id"), "text": new} | {f"n_{k}": v for k, v in counts.items()}

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, work, "doc_id bigint, text string, " + ", ".join(f"n_{k} int" for k in KINDS))


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key that the session's ``spark.sheaf.pii.key`` holds, or the stand-in."""
    return pseudonyms(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, KEY.decode()).encode())
