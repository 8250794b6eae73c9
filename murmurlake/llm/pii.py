"""Personal data by format-preserving Feistel pseudonyms.

Candidates found by pattern are validated (check digits, number plans, octet ranges, calendar); the digits of a
valid one are permuted by a keyed Feistel network over exactly the values of its format, walking the cycle until the
result is valid again.  The permutation depends on the key and the format alone, so equal values, also when written
with other separators, get equal pseudonyms in every document, and the holder of the key can invert them.

Kinds: card (Luhn), phone (North American plan or +country code), ipv4, date (ISO, dotted and slashed, real calendar days),
ssn, iban (mod 97) and email (letters and digits of the local part; the domain stays).

Edge cases: null and empty texts have no findings; overlapping findings keep the earliest, then longest valid one; repeated rows are
answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import ids_and_texts, map_rows

ROUNDS = 8
REMEMBERED = 100_000
_DATES = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())

_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])\d{3}-\d{3}-\d{4}(?![\w-])"
    r"|(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d))"
    r"|(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)


class Feistel:
    """A keyed permutation of range(size); ``tweak`` separates formats."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.key = hmac.new(key, tweak.encode(), hashlib.sha256).digest()
        self.mask = (1 << self.half) - 1

    def _round(self, i: int, x: int) -> int:
        made = hashlib.blake2b(b"%d:%d" % (i, x), key=self.key, digest_size=16).digest()
        return int.from_bytes(made, "big") & self.mask

    def _walk(self, x: int, rounds: range) -> int:
        back = rounds.step < 0
        while True:
            left, right = x >> self.half, x & self.mask
            for i in rounds:
                left, right = (right ^ self._round(i, left), left) if back else (right, left ^ self._round(i, right))
            x = left << self.half | right
            if x < self.size:
                return x

    def apply(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def invert(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(digits: str) -> str:
    odd = [sum(divmod(2 * int(d), 10)) for d in digits[::-1][::2]]
    return str(-(sum(odd) + sum(map(int, digits[::-1][1::2]))) % 10)


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _fill(shape: str, characters: str) -> str:
    """The shape with its digits and letters replaced in order."""
    it = iter(characters)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


def nanp(d: str) -> bool:
    """Ten digits of the North American plan: area and exchange start with 2 to 9 and aren't N11."""
    return d[0] > "1" and d[3] > "1" and d[1:3] != "11" and d[4:6] != "11"


def read_date(text: str) -> tuple[datetime.date, str] | None:
    """The day, and in which order its parts stand; day before month unless only the other order is a date."""
    parts = re.split(r"[-./]", text)
    orders = ("ymd",) if "-" in text else ("dmy", "mdy") if "/" in text else ("dmy",)
    for order in orders:
        try:
            day = datetime.date(*(int(parts[order.index(k)]) for k in "ymd"))
        except ValueError:
            continue
        if _DATES[0] <= day.toordinal() < _DATES[1]:
            return day, order
    return None


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.networks: dict[tuple[str, int], Feistel] = {}
        self.known: dict[tuple[str, str], str | None] = {}

    def network(self, kind: str, size: int) -> Feistel:
        if (kind, size) not in self.networks:
            self.networks[kind, size] = Feistel(self.key, f"{kind}/{size}", size)
        return self.networks[kind, size]

    def digits(self, kind: str, digits: str, valid: Callable[[str], bool]) -> str:
        """Permute a digit string among the valid ones of its length."""
        net, n = self.network(kind, 10 ** len(digits)), int(digits)
        while True:
            n = net.apply(n)
            if valid(made := str(n).zfill(len(digits))):
                return made

    def of(self, kind: str, text: str) -> str | None:
        """The pseudonym in the same format, None if the text isn't a valid value of its kind."""
        if (kind, text) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, text] = getattr(self, f"_{kind}")(text)
        return self.known[kind, text]

    def _card(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if not 13 <= len(d) <= 19 or d[0] == "0" or len(set(d)) == 1 or not luhn(d):
            return None
        body = self.digits("card", d[:-1], lambda s: s[0] != "0")
        return _fill(text, body + luhn_digit(body))

    def _phone(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if text.startswith("+") and not text.startswith("+1"):
            return _fill(text, d[:3] + self.digits("phone+", d[3:], lambda s: True)) if 8 <= len(d) <= 15 else None
        lead, d = d[:-10], d[-10:]
        return _fill(text, lead + self.digits("phone", d, nanp)) if nanp(d) else None

    def _ipv4(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets) or octets[0] == "0":
            return None
        n, net = sum(int(o) << 8 * i for i, o in enumerate(octets[::-1])), self.network("ipv4", 1 << 32)
        while True:
            n = net.apply(n)
            if n >> 24:
                return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def _date(self, text: str) -> str | None:
        got = read_date(text)
        if not got:
            return None
        day, order = got
        mark = re.search(r"[-./]", text)[0]
        padded = all(len(p) != 1 for p in re.split(r"[-./]", text))
        net = self.network("date", _DATES[1] - _DATES[0])
        new = datetime.date.fromordinal(net.apply(day.toordinal() - _DATES[0]) + _DATES[0])
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
        # One day has one pseudonym however it is written; where the month before the day would be read as another day, the day stands first.
        for written in (order, "dmy"):
            made = mark.join(parts[k] for k in written)
            if read_date(made) == (new, written):
                return made
        return None

    def _ssn(self, text: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        d = text.replace("-", "")
        return _fill(text, self.digits("ssn", d, valid)) if valid(d) else None

    def _iban(self, text: str) -> str | None:
        s = text.replace(" ", "")
        if not 15 <= len(s) <= 34 or _iban_rest(s) != 1:
            return None
        digits = "".join(c for c in s[4:] if c.isdigit())
        fresh = iter(self.digits("iban" + s[:2], digits, lambda _: True)) if digits else iter("")
        body = "".join(next(fresh) if c.isdigit() else c for c in s[4:])
        check = f"{98 - _iban_rest(s[:2] + '00' + body):02d}"
        return _fill(text, s[:2] + check + body)

    def _email(self, text: str) -> str | None:
        local, _, domain = text.partition("@")
        canonical = local.lower()
        size, n = 1, 0
        for c in canonical:
            base = 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1
            n, size = n * base + (int(c) if base == 10 else ord(c) - 97 if base == 26 else 0), size * base
        if size == 1:
            return None
        n, out = self.network("email:" + re.sub(r"[a-z]", "a", re.sub(r"\d", "9", canonical)), size).apply(n), []
        for c in reversed(local):
            base = 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1
            n, x = divmod(n, base)
            out.append(str(x) if base == 10 else chr((65 if c.isupper() else 97) + x) if base == 26 else c)
        return f"{''.join(reversed(out))}@{domain}"


_HAS = re.compile(r"\d|@")


def findings(text: str, names: Pseudonyms) -> list[tuple[str, int, int, str, str]]:
    """kind, start, end, value, pseudonym of each valid value, in order."""
    out, at = [], 0
    if not _HAS.search(text):
        return out
    while found := _FIND.search(text, at):
        kind = found.lastgroup
        end, made = found.end(), names.of(kind, found[0])
        if made is None and (kind in ("card", "iban") or (kind == "phone" and re.match(r"\+[2-9]", found[0]))):
            # What follows may have been taken in: shorter ends at group boundaries, the longest first.
            for end in range(found.end() - 1, found.start(), -1):
                if text[end] in " -." and (made := names.of(kind, text[found.start() : end])) is not None:
                    break
        if made is None:  # another kind may start within what failed
            step = re.compile(r"\w+").match(text, found.start())
            at = max(found.start() + 1, step.end() if step else 0)
            continue
        out.append((kind, found.start(), end, text[found.start() : end], made))
        at = end
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Per row: doc_id, findings array of (kind, start, end, pseudonym), text with every valid value replaced."""

    def make():
        names = Pseudonyms(key.encode())

        def work(columns: list) -> list:
            hits, texts = [], []
            for text in columns[1]:
                found = findings(text, names)
                parts, at = [], 0
                for _, start, end, _, made in found:
                    parts += [text[at:start], made]
                    at = end
                texts.append("".join([*parts, text[at:]]))
                hits.append([{"kind": k, "start": s, "end": e, "pseudonym": p} for k, s, e, _, p in found])
            return [columns[0], hits, texts]

        return work

    return map_rows(
        ids_and_texts(docs),
        make,
        "doc_id long, findings array<struct<kind:string,start:int,end:int,pseudonym:string>>, text string",
    )


def documents_with_pii(docs: DataFrame, key: str) -> DataFrame:
    """Per row with a finding: doc_id, n_found, kinds (sorted), pseudonyms, text (pseudonymised)."""
    return pseudonymise(docs, key).filter(F.size("findings") > 0).select(
        "doc_id",
        F.size("findings").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("findings.kind")), ",").alias("kinds"),
        F.array_join("findings.pseudonym", "|").alias("pseudonyms"),
        "text",
    )
