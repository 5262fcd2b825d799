"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Found values are validated, then permuted inside their own format, so that a value always has the same
pseudonym in every document and the text around it keeps its shape:

kind     what is found                                         what stays                   domain
card     13 to 19 digits, single spaces or dashes between,      separators, length, Luhn     digits before the check digit
         that pass the Luhn check                              validity
ssn      ddd-dd-dddd that may be issued                         dashes, issuability          valid numbers
phone    +cc (ddd) ddd-dddd, the same without +cc or without    country code, separators,    the national digits; of ten
         the blank, and 10 digits alone if area and exchange    whether area and exchange    digits with +1 or without
         codes begin with 2-9                                   begin with 2-9               code the same ones
ip       four octets of 0..255                                  dots, private and loopback   the other bits
                                                                networks
iban     country, check digits that pass mod 97                 country, mod 97 validity     letters and digits each
email    local@domain                                           domain's top level, dots     letters and digits each
date     real calendar dates: yyyy-mm-dd (also before a T and   layout, validity, whether    days 1900-01-01 to 2099-12-31
         the time), dd.mm.yyyy, mm/dd/yyyy, also with single    day and month have one or
         digits in the last two                                 two digits

The value is permuted, not its spelling: one date, card, account or phone number has one pseudonym in all its layouts.

Where a match fails its check, the other kinds are tried at the same place, cards and IBANs also as the match's
shorter prefixes that end with a group; then the scan goes on after the match's first group.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

ROUNDS = 8
KEY = b"change me: the pseudonyms' secret"
#: The session's setting that holds the secret key; KEY is only for tests and trials.
SETTING = "spark.gridloom.pii.key"


def key_of(spark) -> bytes:
    return (spark.conf.get(SETTING, None) or KEY.decode()).encode()


class Feistel:
    """A keyed permutation of range(size), by a balanced Feistel network and cycle walking."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _round(self, i: int, tweak: bytes, value: int, modulus: int) -> int:
        data = b"%d|%s|%d" % (i, tweak, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key[:64], digest_size=16).digest(), "big") % modulus

    def permute(self, value: int, size: int, tweak: bytes, inverse: bool = False) -> int:
        if size < 2:
            return value
        side = math.isqrt(size - 1) + 1
        while True:
            left, right = divmod(value, side)
            if inverse:
                for i in reversed(range(self.rounds)):
                    left, right = (right - self._round(i, tweak, left, side)) % side, left
            else:
                for i in range(self.rounds):
                    left, right = right, (left + self._round(i, tweak, right, side)) % side
            value = left * side + right
            if value < size:  # else walk on: side * side may exceed size
                return value


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def is_luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


_DAY0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _DAY0

#: Private and loopback networks: first address and number of free bits.
NETWORKS = ((10 << 24, 24), (127 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16))

KINDS = {
    # a local part has at most 64 characters, which also bounds the look ahead from each place
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "ymd": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?:(?=[Tt]\d)|(?![\w-]))",
    "dmy": r"(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?![\w]|\.\d)",
    "mdy": r"(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<![\w.])[2-9]\d{2}[2-9]\d{6}(?!\w|[.,]\d)",
}
FOUND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in KINDS.items()))
APART = {kind: re.compile(p) for kind, p in KINDS.items()}
GROUPS = {"card": re.compile("[ -]"), "iban": re.compile(" ")}
FIRST = re.compile(r"\w+|.", re.S)
#: A text without any of these has nothing to find.
MAYBE = re.compile(r"[0-9@]")


class Pseudonyms:
    def __init__(self, key: bytes = KEY):
        self.key = key
        self.feistel = Feistel(key)

    # -- permutations inside a format
    def digits(self, digits: str, tweak: bytes, inverse: bool = False) -> str:
        n = len(digits)
        return str(self.feistel.permute(int(digits), 10**n, tweak + b"%d" % n, inverse)).zfill(n) if n else ""

    def letters(self, text: str, tweak: bytes, inverse: bool = False) -> str:
        """Digits stay digits and letters letters of their case; all else stays."""
        size, value = 1, 0
        kinds = []
        for c in text:
            base, count = ("0", 10) if c in "0123456789" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else (c, 1)
            kinds.append((base, count))
            value = value * count + ord(c) - ord(base)
            size *= count
        value = self.feistel.permute(value, size, tweak + "".join(b for b, _ in kinds).encode(), inverse)
        out = []
        for base, count in reversed(kinds):
            value, d = divmod(value, count)
            out.append(chr(ord(base) + d))
        return "".join(reversed(out))

    def _refill(self, layout: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in layout)

    def card(self, text: str, inverse: bool = False) -> str | None:
        d = re.sub(r"\D", "", text)
        if not 13 <= len(d) <= 19 or not is_luhn(d):
            return None
        body = self.digits(d[:-1], b"card", inverse)
        return self._refill(text, body + luhn_digit(body))

    def ssn(self, text: str, inverse: bool = False) -> str | None:
        d = text.replace("-", "")
        ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        if not ok(d):
            return None
        while True:
            d = self.digits(d, b"ssn", inverse)
            if ok(d):
                return self._refill(text, d)

    def _within(self, value: int, size: int, tweak: bytes, inverse: bool, group) -> int:
        """A permutation of range(size) that keeps group(value): the walk goes on until it is back in the group."""
        own = group(value)
        while True:
            value = self.feistel.permute(value, size, tweak, inverse)
            if group(value) == own:
                return value

    def phone(self, text: str, inverse: bool = False) -> str:
        m = re.match(r"\+\d{1,3}(?=[ .(-])|\+1(?=\d{10}$)", text)
        head = m.group() if m else ""
        rest = text[len(head) :]
        digits = re.sub(r"\D", "", rest)
        if len(digits) == 10 and head in ("", "+1") and not rest.startswith("+"):
            new = self._within(int(digits), 10**10, b"phone", inverse, lambda v: v // 10**9 > 1 and v // 10**6 % 10 > 1)
            return head + self._refill(rest, f"{new:010d}")
        return head + self._refill(rest, self.digits(digits, b"phone" + head.encode(), inverse))

    def ip(self, text: str, inverse: bool = False) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        value = int.from_bytes(bytes(map(int, octets)), "big")
        network = lambda v: next((net for net, bits in NETWORKS if v >> bits == net >> bits), None)
        new = self._within(value, 2**32, b"ip", inverse, network) if network(value) is None else network(value) + self.feistel.permute(value - network(value), 2 ** dict(NETWORKS)[network(value)], b"ip%d" % network(value), inverse)
        return ".".join(map(str, new.to_bytes(4, "big")))

    def iban(self, text: str, inverse: bool = False) -> str | None:
        s = text.replace(" ", "")
        if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
            return None
        body = self.letters(s[4:], b"iban" + s[:2].encode(), inverse)
        check = 98 - _mod97(body + s[:2] + "00")
        new = iter(s[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def email(self, text: str, inverse: bool = False) -> str:
        local, domain = text.rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return f"{self.letters(local, b'local', inverse)}@{self.letters(name, b'domain', inverse)}.{top}"

    def date(self, text: str, order: str, inverse: bool = False) -> str | None:
        parts = re.split(r"\D", text)
        at = {c: int(p) for c, p in zip(order, parts, strict=True)}
        try:
            day = datetime.date(at["y"], at["m"], at["d"]).toordinal() - _DAY0
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        def digits(day: int) -> tuple[bool, bool]:
            new = datetime.date.fromordinal(day + _DAY0)
            return new.day > 9, new.month > 9

        new = datetime.date.fromordinal(self._within(day, _DAYS, b"date", inverse, digits) + _DAY0)
        it = iter(str(getattr(new, {"y": "year", "m": "month", "d": "day"}[c])).zfill(len(p)) for c, p in zip(order, parts))
        return re.sub(r"\d+", lambda _: next(it), text)

    def value(self, kind: str, text: str, inverse: bool = False) -> str | None:
        if kind in ("ymd", "dmy", "mdy"):
            return self.date(text, kind, inverse)
        return getattr(self, kind)(text, inverse)

    def replace(self, text: str, inverse: bool = False) -> tuple[str, dict[str, int]]:
        """(text with pseudonyms, how many values of each kind)."""
        counts: dict[str, int] = {}
        if not text or not MAYBE.search(text):
            return text, counts

        out, done, at = [], 0, 0
        while m := FOUND.search(text, at):
            for kind, end in self._candidates(m):
                new = self.value(kind, text[m.start() : end], inverse)
                if new is not None:
                    name = "date" if kind in ("ymd", "dmy", "mdy") else kind
                    counts[name] = counts.get(name, 0) + 1
                    out += [text[done : m.start()], new]
                    done = at = end
                    break
            else:
                at = FIRST.match(text, m.start()).end()
        return "".join([*out, text[done:]]), counts

    @staticmethod
    def _candidates(m: re.Match):
        """(kind, end) of what may begin where m does, m itself first, and of each kind the longest first."""
        begin = m.start()
        for kind in [m.lastgroup, *(k for k in KINDS if k != m.lastgroup)]:
            own = m if kind == m.lastgroup else APART[kind].match(m.string, begin)
            if own:
                yield kind, own.end()
                if kind in GROUPS:
                    yield from ((kind, g.start()) for g in reversed([*GROUPS[kind].finditer(m.string, begin, own.end())]))


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with personal data in `text` replaced; all rows, columns and their order stay.

    Null stays null, empty stays empty; n_chars and other columns are not recomputed (lengths of characters
    do not change, but for IP addresses). Texts of any length are scanned whole; repeated rows and rows without
    doc_id are rows like others; other columns may have any names. Equal values get equal pseudonyms in all documents; `Pseudonyms(key).value(kind, text, inverse=True)` leads back. Empty in, empty out.
    """
    at = docs.columns.index("text")

    def run(batches):
        names = Pseudonyms(key)
        for batch in batches:
            new = [None if t is None else names.replace(t)[0] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.column(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text (replaced; null stays null), n_found, found (map of kind to count) for each row of docs."""

    def run(batches):
        names = Pseudonyms(key)
        for batch in batches:
            rows = [(None, {}) if t is None else names.replace(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([sum(r[1].values()) for r in rows], pa.int64()), pa.array([sorted(r[1].items()) for r in rows], pa.map_(pa.string(), pa.int64()))], names=["doc_id", "text", "n_found", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, n_found long, found map<string,long>")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), key_of(spark)).select("doc_id", "text", "n_found", F.to_json("found").alias("found"))
