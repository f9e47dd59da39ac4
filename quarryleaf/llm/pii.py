"""Format-preserving pseudonyms for validated numbers, addresses and dates.

Each value found is read as a number below the size of its format (the digits
of a card but its first and its check digit, the days of two centuries, the
letters and digits of a mailbox), and that number is permuted by a keyed
Feistel network with cycle walking. The permutation is f^-1(f(x) + shift), which
maps no value to itself. The result is written in the same format with its
check digits made anew, so it is as valid as the value was, and equal values
get equal pseudonyms in every document however they are spaced; a mailbox is
permuted without regard to case, and its letters' case is kept. A date keeps its
order of fields and whether they are padded.

Values are validated: cards by Luhn, IBANs by mod 97, social security numbers
by their ranges, IPv4 octets, dates by the calendar (1900 to 2099). Cards and
IBANs are tried at each length from the longest that is spelled out there, so
that what follows a value does not hide it; after a failure the scan goes on one
character further. What fails is left as it is.

Null text stays null and has no spans, an empty table gives no rows; repeated
rows give repeated rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import give_back

ROUNDS = 8


class Feistel:
    """A keyed permutation of range(size) without a fixed point (size > 1)."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = blake2b(tweak.encode() + b"/%d" % size, key=key[:64], digest_size=32).digest()
        self.shift = 1 + int.from_bytes(blake2b(b"shift", key=self.key, digest_size=32).digest(), "big") % max(1, size - 1)

    def _round(self, i: int, x: int) -> int:
        n = -(-self.half // 8)
        digest = b"".join(blake2b(b"%d/%d/%d" % (i, k, x), key=self.key, digest_size=64).digest() for k in range(-(-n // 64)))
        return int.from_bytes(digest[:n], "big") & self.mask

    def _walk(self, x: int, rounds) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in rounds:
                left, right = right, left ^ self._round(i, right)
            x = right << self.half | left  # halves swapped, so that the same steps backwards undo them
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        return self._walk((self._walk(x, range(ROUNDS)) + self.shift) % self.size, range(ROUNDS - 1, -1, -1))


@lru_cache(4096)
def _feistel(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


_ALPHABETS = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]


def _alphabet(c: str) -> str:
    return next((a for a in _ALPHABETS if c in a), c)


def _permuted(key: bytes, tweak: str, value: str, alphabets: list[str]) -> str:
    """The value permuted within the words that its alphabets allow."""
    number, size = 0, 1
    for c, a in zip(value, alphabets):
        number, size = number * len(a) + a.index(c), size * len(a)
    number, out = _feistel(key, tweak, size)(number), []
    for a in reversed(alphabets):
        number, i = divmod(number, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _respaced(like: str, plain: str) -> str:
    """plain's characters in place of like's letters and digits."""
    rest = iter(plain)
    return "".join(next(rest) if c.isalnum() else c for c in like)


def _lengths(m: str, least: int, most: int):
    """(length, its letters and digits) of m and of its beginnings that end
    before a separator, longest first."""
    for end in [len(m), *(i for i in range(len(m) - 1, 0, -1) if m[i] in " -" and m[i - 1].isalnum())]:
        plain = re.sub("[ -]", "", m[:end])
        if least <= len(plain) <= most:
            yield end, plain


def _card(key, m):
    found = next((x for x in _lengths(m, 13, 19) if luhn_valid(x[1])), None)
    if found is None:
        return None
    m, digits = m[: found[0]], found[1]
    body = digits[0] + _permuted(key, f"card{digits[0]}", digits[1:-1], ["0123456789"] * (len(digits) - 2))
    return _respaced(m, body + luhn_digit(body))


def _iban(key, m):
    found = next((x for x in _lengths(m, 15, 34) if _mod97(x[1][4:] + x[1][:4]) == 1), None)
    if found is None:
        return None
    m, plain = m[: found[0]], found[1]
    body = _permuted(key, f"iban{plain[:2]}", plain[4:], [_alphabet(c) for c in plain[4:]])
    return _respaced(m, f"{plain[:2]}{98 - _mod97(f'{body}{plain[:2]}00'):02d}{body}")


def _phone(key, m):
    code = re.match(r"\+\d{1,3}(?=[ .(-])", m)
    head = code[0] if code else ""
    digits = re.sub(r"\D", "", m[len(head) :])
    if not 7 <= len(digits) <= 12:
        return None
    plan = "23456789" if len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" else ""
    alphabets = [plan if plan and i in (0, 3) else "0123456789" for i in range(len(digits))]
    return head + _respaced(m[len(head) :], _permuted(key, f"phone{'n' if plan else 'x'}", digits, alphabets))


def _ssn(key, m):
    area, group, serial = map(int, m.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    n, serial = divmod(_feistel(key, "ssn", 898 * 99 * 9999)(n), 9999)
    area, group = divmod(n, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(key, m):
    octets = [int(x) for x in m.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
        return None
    n = _feistel(key, "ip", 1 << 32)(int.from_bytes(bytes(octets), "big"))
    return ".".join(map(str, n.to_bytes(4, "big")))


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(key, m):
    a, sep, b, c = re.match(r"(\d+)([-/.])(\d+)[-/.](\d+)$", m).groups()
    iso = len(a) == 4
    year, tries = (a, [(b, c)]) if iso else (c, [(b, a), (a, b)] if sep == "/" else [(b, a)])
    for i, (month, day) in enumerate(tries):
        try:
            n = (date(int(year), int(month), int(day)) - _FIRST).days
        except ValueError:
            continue
        if not 0 <= n < _DAYS:
            return None
        d = _FIRST + timedelta(_feistel(key, "date", _DAYS)(n))
        if iso:
            return f"{d.year:04d}{sep}{d.month:02d}{sep}{d.day:02d}"
        # A day that only month-first order allows is written in that order.
        fields = (d.month, d.day) if i else (d.day, d.month)
        width = 1 if min(len(a), len(b)) == 1 else 2
        return f"{fields[0]:0{width}d}{sep}{fields[1]:0{width}d}{sep}{d.year:04d}"
    return None


def _email(key, m):
    local, _, domain = m.partition("@")
    label, dot, rest = domain.partition(".")
    plain = (local + label).lower()
    out = _permuted(key, "email" + "".join(str(_ALPHABETS.index(a)) if (a := _alphabet(c)) in _ALPHABETS else c for c in plain), plain, [_alphabet(c) for c in plain])
    out = "".join(c.upper() if like.isupper() else c for c, like in zip(out, local + label))
    return f"{out[: len(local)]}@{out[len(local) :]}{dot}{rest}"


#: kind: (pattern, what writes its pseudonym or gives None for an invalid one)
KINDS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![a-z0-9])", _iban),
    "ip": (r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", _ip),
    "date": (r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?!(?!T[0-9]{2}:)[\w/-]|\.[0-9])", _date),
    "ssn": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    "phone": (r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])", _phone),
}
_ANY = re.compile("|".join(p for p, _ in KINDS.values()))
_EACH = [(k, re.compile(p).match, write) for k, (p, write) in KINDS.items()]
_SIGN = re.compile("[0-9@]")


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what they replace."""
    if not text or not _SIGN.search(text):
        return text, []
    out, spans, at, start = [], [], 0, 0
    while m := _ANY.search(text, start):
        start = m.start()
        tried = ((kind, x.end(), write(key, x[0])) for kind, match, write in _EACH if (x := match(text, start)))
        kind, end, new = next((x for x in tried if x[2] is not None), (None, None, None))
        if new is None:
            start += 1
            continue
        if kind in ("card", "iban"):  # as long as they were, which may be less than was matched
            end = start + len(new)
        out += [text[at:start], new]
        spans.append((kind, start, end))
        at = start = end
    return "".join([*out, text[at:]]), spans


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): every whole text with pseudonyms."""
    kind = dict(docs.dtypes)[id_col]

    @give_back
    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            done = [pseudonymise(t.as_py(), key) for t in b.column(1)]
            spans = [[dict(zip(("kind", "start", "end"), x)) for x in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, span)], ["doc_id", "text", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<kind:string,start:long,end:long>>")


def digest(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_found, spans as kind:start:end joined by commas, and the text."""
    written = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return pseudonyms(docs, key).select("doc_id", F.size("spans").cast("long").alias("n_found"), written.alias("spans"), "text")
