"""Personal data (operator 8): format-preserving pseudonyms by a keyed Feistel permutation.

Values are found by pattern, validated (check digits, number plans, the calendar) and permuted within
their own format: a card number becomes a card number with a right check digit, a date a date. The
permutation depends on the key and the kind of value alone, so equal values get equal pseudonyms in
all documents, different values different ones, and whoever has the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlight.llm.common import table

#: Rounds of the Feistel network.
ROUNDS = 8
#: The days that dates are permuted among: 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Permutation:
    """A keyed permutation of 0..size-1 for any size; ``kind`` separates the formats from each other."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = hashlib.sha256(key).digest(), kind.encode()[:16]

    def _round(self, n: int, size: int, half: int, right: int) -> int:
        made = hashlib.blake2b(b"%d:%d:%d" % (n, size, right), key=self.key, person=self.kind, digest_size=-(-half // 8) + 8)
        return int.from_bytes(made.digest(), "big") & ((1 << half) - 1)

    def apply(self, value: int, size: int, undo: bool = False) -> int:
        """The image of ``value``, or with ``undo`` what it is the image of; values outside 0..size-1 in between are permuted again."""
        half = max(1, -(-(size - 1).bit_length() // 2))
        while True:
            left, right = value >> half, value & ((1 << half) - 1)
            for n in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
                if undo:
                    left, right = right ^ self._round(n, size, half, left), left
                else:
                    left, right = right, left ^ self._round(n, size, half, right)
            value = left << half | right
            if value < size:
                return value


def permute_characters(text: str, permutation: Permutation, undo: bool = False) -> str:
    """Digits, lower-case and upper-case ASCII letters of ``text`` permuted among the texts of its shape; other characters stay."""
    places = [(k, "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for k, c in enumerate(text) if c.isascii() and c.isalnum()]
    size, value = 1, 0
    for k, alphabet in places:
        size, value = size * len(alphabet), value * len(alphabet) + alphabet.index(text[k])
    if size < 2:
        return text
    value, out = permutation.apply(value, size, undo), list(text)
    for k, alphabet in reversed(places):
        value, at = divmod(value, len(alphabet))
        out[k] = alphabet[at]
    return "".join(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _walk(valid: Callable[[str], bool], text: str, step: Callable[[str], str]) -> str | None:
    """The next valid text in the cycle of a permutation; it stays within the valid ones, so it is a permutation of them. None if ``text`` isn't valid."""
    if not valid(text):
        return None
    text = step(text)
    while not valid(text):
        text = step(text)
    return text


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1


def _card(text: str, p: Permutation, undo: bool) -> str | None:
    """The longest valid card number that ``text`` begins with and that ends at a separator or with it; what follows it stays.

    A pseudonym that would be a longer card number with the digits that follow is passed over, so that
    it can be undone as long as these stay. Where they begin a value of another kind, which changes
    too, about one in ten of these cards can't be told from a longer one and isn't undone.
    """
    every = _digits(text)
    longer: list[int] = []

    def step(d: str) -> str:
        body = permute_characters(d[:-1], p, undo)
        return next(body + c for c in "0123456789" if luhn(body + c))

    for end in range(len(text), 12, -1):
        if end < len(text) and text[end] not in " -":
            continue
        digits = _digits(text[:end])
        if _is_card(digits):
            return _refill(text[:end], _walk(lambda d: len(set(d)) > 1 and not any(_is_card(d + every[len(d) : n]) for n in longer), digits, step))
        longer.append(len(digits))
    return None


def _iban(text: str, p: Permutation, undo: bool) -> str | None:
    """The longest valid account number that ``text`` begins with; what follows it stays."""
    for end in range(len(text), 14, -1):
        if (end == len(text) or text[end] == " ") and 15 <= len(plain := text[:end].replace(" ", "")) <= 34 and mod97(plain) == 1:
            return _one_iban(text[:end], p, undo)
    return None


def _one_iban(text: str, p: Permutation, undo: bool) -> str:
    plain = text.replace(" ", "")
    body = permute_characters(plain[4:], p, undo)
    full = f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}"
    rest = iter(full)
    return "".join(c if c == " " else next(rest) for c in text)


def _american_phone(digits: str) -> bool:
    return len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" and digits[1:3] != "11" and digits[4:6] != "11"


def _phone(text: str, p: Permutation, undo: bool) -> str | None:
    digits = _digits(text)
    national = _american_phone(digits[-10:])
    if len(digits) == 11 and text.startswith("+1") or len(digits) == 10 and national and text[0] != "+":
        # numbers of the plan become such, others (unassigned area codes) become others
        kept, own, valid = digits[:-10], digits[-10:], lambda d: _american_phone(d) == national
    elif text.startswith("+") and 8 <= len(digits) <= 15:
        code = _digits(re.match(r"\+\d{1,3}", text)[0])
        kept, own, valid = digits[: len(code)], digits[len(code) :], lambda d: True
    else:
        return None
    return _refill(text, kept + _walk(valid, own, lambda d: permute_characters(d, p, undo)))


def _security_number(text: str, p: Permutation, undo: bool) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = _walk(valid, _digits(text), lambda d: permute_characters(d, p, undo))
    return digits and _refill(text, digits)


def _address(text: str, p: Permutation, undo: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in parts):
        return None
    value = p.apply(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, undo)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, p: Permutation, undo: bool) -> str | None:
    """ISO dates, day.month.year and month/day/year; each is permuted among the days of two centuries."""
    a, b, c = re.split(r"[-./]", text)
    y, m, d = (a, b, c) if len(a) == 4 else (c, b, a) if "." in text else (c, a, b)
    try:
        day = datetime.date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + p.apply(day, DAYS, undo))
    mark = next(x for x in text if not x.isdigit())
    order = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
    return mark.join(order if len(a) == 4 else (order[2], order[1], order[0]) if "." in text else (order[1], order[2], order[0]))


def _email(text: str, p: Permutation, undo: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{permute_characters(local, p, undo)}@{domain}"


def _secret(text: str, p: Permutation, undo: bool) -> str | None:
    """Access keys keep their prefix; of an assignment only the value changes."""
    head = re.match(r"(?i)AKIA|gh[pousr]_|sk-|xox[abprs]-|.*?[:=]\s*[\"']?", text, re.DOTALL)[0]
    return head + permute_characters(text[len(head) :], p, undo)


#: Kind -> (pattern, its function: the pseudonym, or None for what isn't valid). The first pattern that matches at a place counts.
KINDS = {
    "secret": (r"\bAKIA[A-Z0-9]{16}\b|\b(?:gh[pousr]_|sk-|xox[abprs]-)[A-Za-z0-9_-]{16,}|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*[\"']?[A-Za-z0-9+/_-]{8,})", _secret),
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", _iban),
    "address": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _address),
    "date": (r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\-/]?\d)", _date),
    "security_number": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _security_number),
    "card": (r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)", _card),
    "phone": (r"(?<![\d+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)", _phone),
}
_ALL = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, (pattern, _) in KINDS.items()))
#: What every value has; texts without it are left at once.
_HINT = re.compile(r"[0-9@=]|sk-|gh[pousr]_|xox|(?i:password|passwd|pwd|secret|token|key)\s*:")


class Pseudonyms:
    """Replaces the personal data of texts under one key."""

    def __init__(self, key: bytes, undo: bool = False):
        self.one = lru_cache(100_000)(lambda kind, text: KINDS[kind][1](text, Permutation(key, kind), undo))

    def replace(self, text: str | None) -> tuple[str | None, Counter]:
        """(text with pseudonyms, number of values by kind); a null stays null."""
        found: Counter = Counter()
        if not text or not _HINT.search(text):
            return text, found

        out, done, m = [], 0, _ALL.search(text)
        while m:
            made = self.one(m.lastgroup, m[0])
            if made is None:  # nothing valid begins here; a value may begin one place on
                m = _ALL.search(text, m.start() + 1)
                continue
            found[m.lastgroup] += 1
            end = m.start() + len(made) if m.lastgroup in ("iban", "card") else m.end()
            out += [text[done : m.start()], made]
            done = end
            m = _ALL.search(text, end)
        return "".join([*out, text[done:]]), found


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and added n_values long and kinds map<string, long>.

    Whole texts are read; what isn't a valid value stays as it is, and so do null and empty texts. With
    ``undo`` and the same key the values come back. Added columns replace any of their names.
    """
    plain = docs.drop("n_values", "kinds")
    names = plain.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key, undo)
        at = names.index(text)
        for batch in batches:
            done = [work.replace(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            columns += [pa.array([c.total() for _, c in done], pa.int64()), pa.array([sorted(c.items()) for _, c in done], pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_values", "kinds"])

    kinds = {**{f.name: f.dataType.simpleString() for f in plain.schema}, text: "string"}
    return plain.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", n_values long, kinds map<string,long>")


#: The key of the queries; a job passes its own from its secret store.
QUERY_KEY = b"public example key"


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values of which kinds it had."""
    from pyspark.sql import functions as F

    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return found.select("doc_id", "text", "n_values", F.concat_ws(",", F.array_sort(F.map_keys("kinds"))).alias("kinds"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents with pseudonyms in their texts; n_chars follows the new text."""
    from pyspark.sql import functions as F

    return pseudonymise(docs, QUERY_KEY).select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else c for c in docs.columns))
