"""String expressions.

Regular expressions are written for ASCII word boundaries and Unicode white space: ``B`` and ``S`` stand in for the two escapes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII word boundary, also beside letters outside ASCII.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: One white-space character, Unicode ones and the byte order mark included.
S = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Filler words, entities.
FILLERS = ("the", "a", "an", "of", "and", "in", "on", "at", "to", "for", "by", "with", "from")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def pattern(regex: str) -> str:
    r"""``\b`` and ``\s`` of a pattern with the meaning described above."""
    return regex.replace(r"\b", B).replace(r"\s", S)


def rule(regex: str) -> str:
    r"""``pattern`` for rules whose every ``\b`` stands before or after a word: one look-around instead of two."""
    regex = re.sub(r"\\b(?=(?:\(\?:)?[A-Za-z])", "(?<![A-Za-z0-9_])", regex)
    return regex.replace(r"\b", "(?![A-Za-z0-9_])").replace(r"\s", S)


def any_rule(regexes: Sequence[str]) -> str:
    r"""One pattern for rules that all start with ``\b`` and a word; the boundary is tested once a place."""
    return "(?<![A-Za-z0-9_])(?:" + "|".join(rule(r.removeprefix(r"\b")) for r in regexes) + ")"


def found_rule(column: Column, regexes: Sequence[str]) -> Column:
    return column.rlike("(?i)" + any_rule(regexes))


def matches(column: Column, regex: str) -> Column:
    """Case-insensitive search."""
    return column.rlike("(?i)" + pattern(regex))


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(column: Column, values: Sequence[str]) -> Column:
    made = F.lit(False)
    for v in values:
        made = made | column.contains(v)
    return made


def round_half_up(value: Column, decimals: int) -> Column:
    """Rounding on doubles: floor(x * 10**n + 0.5) / 10**n."""
    p = float(10**decimals)
    return F.floor(value.cast("double") * p + 0.5).cast("double") / p


def plain_apostrophes(column: Column) -> Column:
    return F.translate(column, "’‘ʼ`", "''''")


def urls_in(column: Column) -> Column:
    """Addresses in a text without the punctuation that follows them."""
    found = F.regexp_extract_all(column, F.lit(r"""(?i)(https?://[^\s<>"')\]]+)"""), F.lit(1))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")), lambda u: F.length(u) > 0)


def first_url(column: Column) -> Column:
    """The first address up to white space; null without one."""
    return F.nullif(F.regexp_extract(column, f"(?i)(https?://[^{S[1:-1]}]+)", 1), F.lit(""))


def distinct_urls(column: Column) -> Column:
    return F.array_distinct(urls_in(column))


def squeezed(column: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.regexp_replace(F.trim(F.lower(column)), r"\s+", " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on squeezed strings; 1 for equal ones, 0 if one is empty."""
    x, y = squeezed(a), squeezed(b)
    longest = F.greatest(F.length(x), F.length(y))
    return (
        F.when(x == y, 1.0)
        .when((F.length(x) == 0) | (F.length(y) == 0), 0.0)
        .otherwise(1.0 - F.levenshtein(x, y) / longest)
    )


def _marked_letters() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks of U+0300-036F, with that character; then the marks alone."""
    marks = {chr(c) for c in range(0x300, 0x370)}
    bare = {}
    for code in range(0xC0, 0x10000):
        if not 0xD800 <= code < 0xE000:
            parts = unicodedata.normalize("NFD", chr(code))
            left = [c for c in parts if c not in marks]
            if len(parts) > 1 and len(left) == 1:
                bare[chr(code)] = left[0]
    return "".join([*bare, *sorted(marks)]), "".join(bare.values())


_MARKED, _BARE = _marked_letters()


def without_accents(column: Column) -> Column:
    """Letters of any script without their marks of U+0300-036F; letters that don't decompose (as a barred l) stay."""
    return F.translate(column, _MARKED, _BARE)


def content_words(column: Column) -> Column:
    """Distinct words of more than one letter that aren't fillers."""
    clean = F.regexp_replace(without_accents(F.lower(column)), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(F.trim(clean), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*FILLERS)))


def hashtags(column: Column) -> Column:
    found = F.regexp_extract_all(column, F.lit(r"#([\w\x{C0}-\x{24F}]+)"), F.lit(1))
    return F.transform(found, F.lower)


def strip_tags(column: Column) -> Column:
    return F.regexp_replace(column, r"<[^>]*>", "")


def clean_html(column: Column) -> Column:
    return F.trim(F.regexp_replace(strip_tags(column), r"\s+", " "))


def decoded(text: str) -> str:
    """``text`` without its references: those of ENTITIES, decimal and hexadecimal ones, again and again until nothing changes."""
    before = None
    while text != before:
        before = text
        for name, character in ENTITIES:
            text = text.replace(name, character)
        text = _DECIMAL.sub(lambda m: chr(int(m[1]) & 0xFFFF), text)
        text = _HEXADECIMAL.sub(lambda m: chr(int(m[1], 16) & 0xFFFF), text)
    # Two code units of a character beyond the first plane are one again; a single one has no meaning.
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


_DECIMAL, _HEXADECIMAL = re.compile(r"&#([0-9]+);"), re.compile(r"&#x([0-9a-fA-F]+);")


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: decoded(t) if t is not None and "&" in t else t)


def decode_entities(column: Column) -> Column:
    """Named and numeric references, also references to references however deep."""
    return _decoded(column)


def truncated(column: Column, size: int) -> Column:
    return F.when(F.length(column) > size, F.concat(F.substring(column, 1, size - 3), F.lit("..."))).otherwise(column)


def token_estimate(column: Column) -> Column:
    return F.ceil(F.length(column) / 4).cast("long")


def parse_boolean(column: Column) -> Column:
    """'true' and 'false' in any case, null for anything else."""
    low = F.lower(column)
    return F.when(low == "true", True).when(low == "false", False)


def plain_license(column: Column) -> Column:
    """A licence's name in lower case with hyphens, 'version 4' as '4'."""
    low = F.regexp_replace(F.lower(F.trim(column)), rf"version{S}*([0-9])", "$1")
    return F.regexp_replace(low, f"[_{S[1:-1]}]+", "-")


def event_date(time: Column) -> Column:
    """``Mar 5``: month and day of a time."""
    return F.date_format(time, "MMM d")


def safe_name(column: Column) -> Column:
    return F.regexp_replace(column, r"[^a-zA-Z0-9_-]", "_")


def number_text(number: Column) -> Column:
    """A double as text: whole ones without a fraction or exponent."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


def activity_id(*fields: Column) -> Column:
    """16 hex digits over the texts of field values in order (``number_text`` for numbers); nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]), 256), 1, 16)
