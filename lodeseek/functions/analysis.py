"""Terms of texts: one analyzer by field type."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.types import FieldType

TOKEN = r"[\p{L}\p{N}]+"
#: The same in Python's syntax, for queries.
_TOKEN = re.compile(r"[^\W_]+")
_EDGE = r"[\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the lowered text, in their order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def term_count(text: Column, term: str) -> Column:
    """How often the text has the token, without cutting it into tokens.

    The pattern is looked for only in texts that hold the letters at all.
    """
    low = F.lower(text)
    return F.when(low.contains(term), F.regexp_count(low, F.lit(f"(?<!{_EDGE}){re.escape(term)}(?!{_EDGE})"))).otherwise(0)


def characters(text: Column) -> Column:
    """Distinct characters."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def list_items(text: Column) -> Column:
    """Parts between semicolons, as they are: not trimmed, repeated ones repeated."""
    return F.split(text, ";")


def terms(text: Column, kind: FieldType) -> Column:
    """The array of terms that a field of this type puts into the index."""
    if kind == FieldType.STRING_SEG:
        return tokens(text)
    if kind == FieldType.STRING_LIST:
        return list_items(text)
    if kind == FieldType.STRING_SINGLE:
        return characters(text)
    return F.array(text)


def analyzed(value: str, kind: FieldType) -> list[str]:
    """The terms of a query value, as terms() has those of a column; each one once."""
    if kind == FieldType.STRING_SEG:
        return list(dict.fromkeys(_TOKEN.findall(value.lower())))
    if kind == FieldType.STRING_LIST:
        return list(dict.fromkeys(value.split(";")))
    if kind == FieldType.STRING_SINGLE:
        return list(dict.fromkeys(value))
    return [value]


def has_term(text: Column, term: str, kind: FieldType) -> Column:
    """Whether a field of this type has the term, from the text itself."""
    if kind == FieldType.STRING_SEG:
        return F.coalesce(term_count(text, term) > 0, F.lit(False))
    if kind == FieldType.STRING_LIST:
        return F.coalesce(F.array_contains(list_items(text), term), F.lit(False))
    if kind == FieldType.STRING_SINGLE:
        return F.coalesce(F.lit(len(term) == 1) & text.contains(term), F.lit(False))
    # as it is, so that it goes down to the files; null is no match either
    return text == term


def dictionary_tokens(words: set[str]):
    """A column function: text -> tokens by a dictionary, for scripts without blanks.

    At each place the longest word counts, after the shorter words that lie within it (search mode); what is
    in no word is cut as tokens() does. words goes along with each task: it should be a dictionary, not a corpus.
    """
    longest = max(map(len, words), default=0)

    def cut(text: str) -> list[str]:
        low, out, at, rest = text.lower(), [], 0, 0
        while at < len(low):
            size = next((n for n in range(min(longest, len(low) - at), 1, -1) if low[at : at + n] in words), 0)
            if not size:
                at += 1
                continue
            out += _TOKEN.findall(low[rest:at])
            word = low[at : at + size]
            out += [word[i : i + n] for n in range(2, size) for i in range(size - n + 1) if word[i : i + n] in words]
            out.append(word)
            at = rest = at + size
        return out + _TOKEN.findall(low[rest:])

    @F.arrow_udf("array<string>")
    def dictionary_cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return dictionary_cut


_INITIALS = ("zh", "ch", "sh", *"bpmfdtnlgkhjqxrzcs")
_TONES = str.maketrans("āáǎàēéěèōóǒòīíǐìūúǔùüǘǚǜńň", "aaaaeeeeooooiiiiuuuuvvvvnn")


def romanized(table: dict[str, str], style: str = "normal", phrases: dict[str, str] | None = None):
    """A column function: text -> array of readings by table (character -> readings, comma between).

    style: 'tone' gives the first reading, 'normal' that without tone marks, 'initials' its initial consonant.
    Phrases that phrases has (longest first) are read as it says, reading by reading. Runs of characters
    without a reading are one element each.
    """
    phrases = phrases or {}
    longest = max(map(len, phrases), default=0)

    def one(reading: str) -> str:
        first = reading.split(",")[0]
        if style == "initials":
            return next((i for i in _INITIALS if first.startswith(i)), "")
        return first if style == "tone" else first.translate(_TONES)

    def read(text: str) -> list[str]:
        out, other, at = [], "", 0
        while at < len(text):
            n = next((n for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in phrases), 0)
            found = [one(x) for x in phrases[text[at : at + n]].split(",")] if n else [one(table[text[at]])] if text[at] in table else None
            if found is None:
                other += text[at]
            else:
                out += [other] * bool(other) + found
                other = ""
            at += n or 1
        return out + [other] * bool(other)

    @F.arrow_udf("array<string>")
    def readings(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else read(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return readings
