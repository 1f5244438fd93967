"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Card, account, phone and social security numbers, IPv4 addresses and dates are found, validated, and permuted
within their format; so are the letters and digits of e-mail addresses and access keys. The permutation
depends on the key and the kind of value alone, so equal values get equal pseudonyms in all documents, and
whoever has the key can undo them. A round's function is keyed BLAKE2b.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_slices

_ROUNDS = 10
_LONGEST = 64  # a half has 151 bits at most, well below the 256 of a round
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email", "key")


class Feistel:
    """Permutations of [0, a) x [0, b) for each kind of value, by modular additions on either half in turn."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, i: int, value: int, modulus: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}/{modulus}/{i}/{value}".encode(), key=self.key, digest_size=32).digest(), "big") % modulus

    def permute(self, kind: str, x: int, a: int, b: int, back: bool = False) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(kind, i, left, b)) % b
            else:
                left = (left + sign * self._round(kind, i, right, a)) % a
        return left * b + right

    def within(self, kind: str, x: int, a: int, b: int, valid: Callable[[int], bool], back: bool = False) -> int:
        """Permutes again until the result is valid; x must be, so the walk ends."""
        while True:
            x = self.permute(kind, x, a, b, back)
            if valid(x):
                return x

    def digits(self, kind: str, value: str, valid: Callable[[str], bool] = lambda _: True, back: bool = False) -> str:
        n = len(value)
        half = 10 ** (n - n // 2)
        return str(self.within(f"{kind}{n}", int(value), 10 ** (n // 2), half, lambda x: valid(str(x).zfill(n)), back)).zfill(n)

    def symbols(self, kind: str, value: str, back: bool = False) -> str:
        """Each letter and digit stays one of its alphabet; other characters stay as they are. Values longer than any real one are permuted piece by piece, in time that grows with their length."""
        if len(value) > _LONGEST:
            return "".join(self.symbols(f"{kind}{i}/", value[i : i + _LONGEST], back) for i in range(0, len(value), _LONGEST))
        own = [(a, a.index(c)) for c in value for a in _ALPHABETS if c in a]
        if not own:
            return value
        radix = [len(a) for a, _ in own]
        a, b = prod(radix[: len(radix) // 2]), prod(radix[len(radix) // 2 :])
        x = 0
        for (_, i), r in zip(own, radix, strict=True):
            x = x * r + i
        shape = "".join("0" if c in _ALPHABETS[0] else "a" if c in _ALPHABETS[1] else "A" if c in _ALPHABETS[2] else c for c in value)
        x = self.permute(kind + shape, x, a, b, back)
        out = []
        for (alphabet, _), r in zip(reversed(own), reversed(radix), strict=True):
            x, i = divmod(x, r)
            out.append(alphabet[i])
        return _fill(value, iter(reversed(out)), lambda c: any(c in a for a in _ALPHABETS))


def _fill(shape: str, new: Iterator[str], taken: Callable[[str], bool] = str.isdigit) -> str:
    return "".join(next(new) if taken(c) else c for c in shape)


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = f.digits("card", d[:-1], lambda x: x[0] != "0" and len(set(x + luhn_digit(x))) > 1, back) if d[0] != "0" else None
    return body and _fill(text, iter(body + luhn_digit(body)))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    country = re.match(r"\+\d{1,3}(?=\D)|\+1", text)
    start = country.end() if country else 0
    d = re.sub(r"\D", "", text[start:])
    if not 7 <= len(d) <= 12:
        return None
    sound = (lambda x: x[0] >= "2" and x[3] >= "2") if len(d) == 10 else (lambda x: x[0] != "0" or d[0] == "0")
    if not sound(d):
        return None
    code = "" if text[:start] == "+1" and len(d) == 10 else text[:start]  # with and without it, a number stays the same
    return text[:start] + _fill(text[start:], iter(f.digits("phone" + code + ("0" if d[0] == "0" and len(d) != 10 else ""), d, sound, back)))


def _ssn_sound(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    d = text.replace("-", "")
    return _fill(text, iter(f.digits("ssn", d, _ssn_sound, back))) if _ssn_sound(d) else None


def _public(x: int) -> bool:
    a, b = x >> 24, x >> 16 & 255
    return 0 < a < 224 and a not in (10, 127) and (a, b) not in ((169, 254), (192, 168)) and not (a == 172 and 16 <= b < 32)


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    if not _public(x):
        return None
    return ".".join(map(str, f.within("ip", x, 1 << 16, 1 << 16, _public, back).to_bytes(4, "big")))


def _date(f: Feistel, text: str, back: bool) -> str | None:
    p = re.split(r"[-/.]", text)
    order = (0, 1, 2) if len(p[0]) == 4 else (2, 0, 1) if "/" in text else (2, 1, 0)  # y-m-d, m/d/y, d.m.y and d-m-y
    try:
        day = datetime.date(*(int(p[i]) for i in order)).toordinal() - _DAY0
    except ValueError:
        if order != (2, 0, 1):
            return None
        order = (2, 1, 0)  # d/m/y
        try:
            day = datetime.date(*(int(p[i]) for i in order)).toordinal() - _DAY0
        except ValueError:
            return None
    if not 0 <= day < _DAYS:
        return None
    # one permutation for all ways to write a date, so they stay linked; undoing a d/m/y date needs to know that it is one
    new = datetime.date.fromordinal(_DAY0 + f.within("date", day, 271, 271, lambda x: x < _DAYS, back))
    out = [""] * 3
    for i, v in zip(order, (new.year, new.month, new.day), strict=True):
        out[i] = str(v).zfill(4 if i == order[0] else 2)
    return out[0] + text[len(p[0])] + out[1] + text[len(p[0]) + 1 + len(p[1])] + out[2]


def _iban_check(country: str, body: str) -> str:
    return str(98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97).zfill(2)


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    if _iban_check(text[:2], text[4:]) != text[2:4]:
        return None
    body = f.symbols("iban" + text[:2], text[4:], back)
    return text[:2] + _iban_check(text[:2], body) + body


def _email(f: Feistel, text: str, back: bool) -> str | None:
    local, _, host = text.rpartition("@")
    name, dot, top = host.rpartition(".")
    return f.symbols("local", local, back) + "@" + f.symbols("host", name, back) + dot + top


#: What a run of digits and number punctuation may hold, in order of preference.
_NUMBERS = (
    ("date", re.compile(r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}[/.-]\d{2}[/.-]\d{4})(?!\d)"), _date),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), _ip),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    ("phone", re.compile(r"(?<!\d)(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"), _phone),
    ("card", re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)"), _card),
)
_RUN = re.compile(r"[0-9+(][0-9 ().:/+-]*[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA([A-Z0-9]{16})(?![A-Za-z0-9])|(?:token|secret|api_?key|password)[\"']?[ ]?[=:][ ]?[\"']?([A-Za-z0-9]{16,})", re.IGNORECASE)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def _found(text: str, f: Feistel, back: bool) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of each value."""
    at = text.find("@")
    while at >= 0:
        start, host = at, _HOST.match(text, at + 1)
        while host and start and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < at:
            yield start, host.end(), "email", _email(f, text[start : host.end()], back)
        at = text.find("@", at + 1)
    for m in _KEY.finditer(text):
        g = 1 if m[1] else 2
        yield m.start(g), m.end(g), "key", f.symbols("key", m[g], back)
    for m in _IBAN.finditer(text):
        if new := _iban(f, m[0], back):
            yield *m.span(), "iban", new
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= 7:
            for kind, pattern, change in _NUMBERS:
                at, stop = max(0, run.start() - 1), min(len(text), run.end() + 1)
                while m := pattern.search(text, at, stop):
                    at = m.start() + 1  # a candidate that fails takes no characters from the next
                    end = m.end()
                    while m:
                        inside = text[m.start() - 1 : m.start()].isdigit() or text[m.end() : m.end() + 1].isdigit()
                        if not inside and (new := change(f, m[0], back)):
                            yield *m.span(), kind, new
                            at = m.end()
                            break
                        end = m.end() - 1  # a shorter one with the same start
                        m = pattern.match(text, m.start(), end)


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with all values replaced, and how many of each kind. Of overlapping values the one found first stands: e-mail, key, account, then as listed."""
    starts, cuts, counts = [], [], {}  # in order of place; what is taken doesn't overlap, so only neighbours matter
    for start, end, kind, new in _found(text, f, back):
        i = bisect(starts, start)
        if (not i or cuts[i - 1][1] <= start) and (i == len(starts) or end <= starts[i]):
            starts.insert(i, start), cuts.insert(i, (start, end, new))
            counts[kind] = counts.get(kind, 0) + 1
    out, at = [], 0
    for start, end, new in cuts:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), counts


def protect(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, and kinds (a count for each kind found), for each row of `docs`.

    A null text stays null; empty texts and those without values stay as they are. Equal values have equal
    pseudonyms in all rows and runs with the same key. Texts are read whole, of any length. Repeated rows get equal
    answers; an empty table gives an empty result; other columns don't matter.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in it:
            for begin, end in text_slices(batch, "text"):
                part, texts, kinds = batch.slice(begin, end - begin), [], []
                for text in part.column("text").to_pylist():
                    new, counts = pseudonymise(text, f) if text else (text, {})
                    texts.append(new), kinds.append(list(counts.items()))
                n = [sum(v for _, v in k) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(kinds, pa.map_(pa.string(), pa.int32()))], names=["doc_id", "text", "n_found", "kinds"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, text string, n_found int, kinds map<string,int>")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key here is a fixed one for repeatable results; a real run passes its own."""
    out = protect(table(spark, sf_dir, "documents"), b"an example key, not a secret")
    return out.select("doc_id", "text", "n_found", *[F.coalesce(F.col("kinds")[k], F.lit(0)).alias(f"n_{k}") for k in KINDS])
