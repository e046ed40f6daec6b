"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern and validated (checksums, ranges, the calendar). Their digits go through a keyed Feistel network
over exactly the numbers of their format, walking on while a result is outside it: a permutation, so equal values get equal pseudonyms in every document and
different ones different pseudonyms, without a table of them. Separators, lengths and check digits stay valid.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import ensure_workers_import

ROUNDS = 10
#: Telephone country codes of one and of two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Most values that a worker remembers.
MEMO = 200_000
LOWER_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
KINDS = ("email", "phone", "card", "ip", "date", "ssn", "iban", "secret", "ip6")


class Feistel:
    """Keyed permutations of number ranges."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, size: int) -> int:
        h = hashlib.blake2b(value.to_bytes((value.bit_length() + 7) // 8 or 1, "big") + b"/" + tweak, key=self.key, digest_size=32, salt=i.to_bytes(8, "big"))
        return int.from_bytes(h.digest(), "big") % size

    def permute(self, value: int, size: int, tweak: bytes) -> int:
        """A permutation of range(size): alternating halves of a * b >= size, walked until the result is below size."""
        a = max(1, int(size**0.5)) if size < 1 << 52 else 1 << (size.bit_length() // 2)
        b = -(-size // a)
        tweak = tweak + b"|" + str(size).encode()
        while True:
            left, right = divmod(value, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(tweak, i, left, b)) % b
                else:
                    left = (left + self._round(tweak, i, right, a)) % a
            value = left * b + right
            if value < size:
                return value

    def word(self, text: str, alphabet: str, tweak: bytes) -> str:
        """The string of the same length over an alphabet."""
        n, base, value = len(text), len(alphabet), 0
        for c in text:
            value = value * base + alphabet.index(c)
        value = self.permute(value, base**n, tweak) if n else 0
        out = []
        for _ in range(n):
            value, r = divmod(value, base)
            out.append(alphabet[r])
        return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refilled(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    given = iter(digits)
    return "".join(next(given) if c.isascii() and c.isdigit() else c for c in shape)


def refilled_alnum(shape: str, plain: str) -> str:
    given = iter(plain)
    return "".join((x.upper() if c.isupper() else x) if c.isascii() and c.isalnum() and (x := next(given)) is not None else c for c in shape)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def card(f: Feistel, text: str) -> str | None:
    """Numbers of 13 to 19 digits; a valid check digit stays valid, an invalid one invalid."""
    d = only_digits(text)
    if len(set(d)) == 1:
        return None
    body = f.word(d[:-1], "0123456789", b"card")
    off = (int(d[-1]) - int(luhn_digit(d[:-1]))) % 10
    return refilled(text, body + str((int(luhn_digit(body)) + off) % 10))


def phone(f: Feistel, text: str) -> str | None:
    """The national digits are permuted, a country code stays. A number of ten digits without one is of North America, so it's the same with or without its +1."""
    d = only_digits(text)
    if "+" in text:
        code = next((d[:n] for n in (1, 2) if d[:n] in SHORT_CODES), d[:3])
        if not 8 <= len(d) <= 15:
            return None
    else:
        code = d[:-10]
    own = d[len(code) :]
    american = code in ("", "1")
    if american and len(own) != 10:
        return None
    tweak = b"phone" + (b"1" if american else code.encode())
    keep = (lambda s: s[0] >= "2") if american and own[0] >= "2" else (lambda s: s[0] != "0") if own[0] != "0" else (lambda s: True)
    while True:
        own = f.word(own, "0123456789", tweak)
        if keep(own):
            return refilled(text, code + own)


def ip(f: Feistel, text: str) -> str | None:
    """IPv4 addresses from 1.0.0.0 to 255.255.255.255."""
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or parts[0] < 1 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = (parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]) - (1 << 24)
    value = f.permute(value, 255 << 24, b"ip") + (1 << 24)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def ip6(f: Feistel, text: str) -> str | None:
    """IPv6 addresses but those of local use; written in full, so an address is the same in each of its spellings."""
    try:
        value = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if value.is_loopback or value.is_unspecified:
        return None
    return ipaddress.IPv6Address(f.permute(int(value), 1 << 128, b"ip6")).exploded


def ssn(f: Feistel, text: str) -> str | None:
    """United States social security numbers: area 001-899 without 666, group and serial not zero."""
    d = only_digits(text)

    def valid(s: str) -> bool:
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    if not valid(d):
        return None
    while True:
        d = f.word(d, "0123456789", b"ssn")
        if valid(d):
            return refilled(text, d)


def iban(f: Feistel, text: str) -> str | None:
    """IBANs that pass the modulo-97 check; country stays, check digits are made anew."""
    plain = text.replace(" ", "").upper()
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = refilled(plain[4:], f.word(only_digits(plain[4:]), "0123456789", b"iban" + plain[:2].encode()))
    out = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    given = iter(out)
    return "".join(c if c == " " else next(given) for c in text)


def calendar(f: Feistel, text: str) -> str | None:
    """Dates of the calendar from 1900 to 2099 as year-month-day, day.month.year, or month/day/year (day/month/year where only that is valid)."""
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    a, b, c = (int(x) for x in parts)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0)] if mark != "/" else [(2, 0, 1), (2, 1, 0)]
    for order in orders:
        y, m, d = ((a, b, c)[i] for i in order)
        try:
            day = date(y, m, d).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            continue
        new = date.fromordinal(FIRST_DAY + f.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date"))
        out = ["", "", ""]
        for i, v, w in zip(order, (new.year, new.month, new.day), (4, 2, 2)):
            out[i] = f"{v:0{w}d}"
        return mark.join(out)
    return None


def email(f: Feistel, text: str) -> str | None:
    """Letters and digits of the part before @; marks and the domain stay."""
    local, _, domain = text.rpartition("@")
    plain = "".join(c for c in local if c.isascii() and c.isalnum()).lower()
    if not plain:
        return None
    return refilled_alnum(local, f.word(plain, LOWER_ALNUM, b"email@" + domain.lower().encode())) + "@" + domain


def secret(f: Feistel, text: str) -> str | None:
    """Hexadecimal strings of 32 digits or more, and keys of letters and digits."""
    low = text.lower()
    if all(c in HEX for c in low):
        out = f.word(low, HEX, b"hex")
        return out.upper() if text == text.upper() and text != low else out
    plain = "".join(c for c in low if c.isalnum())
    return refilled_alnum(text, f.word(plain, LOWER_ALNUM, b"key"))


#: Pattern of each kind, the sooner one first where several match. Word limits are ASCII letters, digits and underscore.
PATTERNS: tuple[tuple[str, str, Callable[[Feistel, str], str | None]], ...] = (
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_%+\-])?@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", email),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:gh[pousr]|sk|pk|xox[abp])[_\-][A-Za-z0-9_\-]{16,})(?![A-Za-z0-9])", secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("date", r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9\-/]|\.[0-9])", calendar),
    ("ip6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:]|\.[0-9])", ip6),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", ip),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", ssn),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}(?:[ .\-/]?\(?[0-9]{1,12}\)?){1,6}(?![0-9])", phone),
    ("card", r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])", card),
)
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in PATTERNS))
#: Some part of every pattern's values, so no text with one is passed over: six digits close together are in each kind of number but short addresses and account numbers of letters.
LIKELY = re.compile(r"@|[0-9](?:[^0-9\n]{0,2}[0-9]){5}|\+[1-9]|[0-9A-Fa-f:]:[0-9A-Fa-f:]*:|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[0-9](?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{32}|AKIA|(?:gh[pousr]|sk|pk|xox[abp])[_\-]")


class Masker:
    """Replaces the values of texts under one key."""

    def __init__(self, key: bytes) -> None:
        self.feistel = Feistel(key)
        self.rules = {k: f for k, _, f in PATTERNS}
        self.memo: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, text: str) -> str | None:
        at = (kind, text)
        if at not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[at] = self.rules[kind](self.feistel, text)
        return self.memo[at]

    def text(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many of each kind."""
        counts = [0] * len(KINDS)
        if not LIKELY.search(text):
            return text, counts

        def swap(m: re.Match) -> str:
            new = self.value(m.lastgroup, m[0])
            if new is None:
                return m[0]
            counts[KINDS.index(m.lastgroup)] += 1
            return new

        return ANY.sub(swap, text), counts


def pseudonymised(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_replaced, and n_<kind> of each kind.

    A map over rows without a shuffle: linking needs no table, as the key makes equal values equal. A null text stays null with counts of 0. Values that fail their validation
    (dates that don't exist, addresses out of range, IBANs with wrong check digits) stay as they are; long numbers count as card
    numbers whether or not their check digit is right, which only stays as right or wrong as it was: a mistyped card number is personal data too. Repeated rows give repeated results, an empty table none. Very small formats are permuted too, so a value may be its own pseudonym by chance.
    """
    ensure_workers_import(docs.sparkSession)
    held: list[Masker] = []
    fields = ",".join(f"n_{k}:bigint" for k in KINDS)

    @F.arrow_udf(f"struct<text:string,n_replaced:bigint,{fields}>")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(Masker(key))
        for col in batches:
            rows = [(None, [0] * len(KINDS)) if (t := x.as_py()) is None else held[0].text(t) for x in col]
            counts = [pa.array([r[1][i] for r in rows], pa.int64()) for i in range(len(KINDS))]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([sum(r[1]) for r in rows], pa.int64()), *counts], ["text", "n_replaced", *(f"n_{k}" for k in KINDS)])

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), masked(F.col(f"`{text}`").cast("string")).alias("m")).select("doc_id", "m.*")
