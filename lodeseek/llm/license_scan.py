"""License scan: ordered signature rules behind a keyword prefilter.

One pass of a keyword automaton over the lowered text tells which rules can match and where: every match of
a rule holds one of its keywords, and no match is longer than the rule's pattern allows. So a pattern only
looks at the stretches around its own keywords, which gives the same matches as looking at the whole text.

Detections that overlap are resolved in order of priority (of equal ones the longer, the earlier, the rule
written first): one is dropped if it lies within a kept one, or overlaps a kept one of a higher priority.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm.common import table
from lodeseek.llm.license_rules import GAP, RULES

#: Characters beyond a match at which a pattern may look.
AHEAD = 64
#: Rows of a batch of results.
_ROWS = 4096


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern
    #: The longest match.
    width: int


def _blanks(pattern: str) -> str:
    """pattern with each blank outside of character classes as GAP; a blank with a question mark may be missing."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append((GAP if pattern[at + 1 : at + 2] != "?" else f"(?:{GAP})") if c == " " and not inside else c)
        at += 1
    return "".join(out)


def compiled(lines: str = RULES) -> tuple[Rule, ...]:
    found = []
    for n, line in enumerate(x for x in lines.splitlines() if x.strip()):
        name, priority, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
        p = re.compile(_blanks(pattern), re.I | re.A)
        width = re._parser.parse(p.pattern, p.flags).getwidth()[1]
        found.append(Rule(n, name, int(priority), tuple(k.strip() for k in keywords.split(",") if k.strip()), p, width))
    return tuple(found)


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections (start, end, rule) that stay, by start."""
    kept: list[tuple[int, int, int, Rule]] = []
    longest = 0
    for a, b, r in sorted(set(found), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].number)):
        at = bisect_left(kept, (a - longest,))
        while at < len(kept) and kept[at][0] < b:
            x, y, _, k = kept[at]
            if x <= a and b <= y or y > a and k.priority > r.priority:
                break
            at += 1
        else:
            insort(kept, (a, b, r.number, r))
            longest = max(longest, b - a)
    return [(a, b, r) for a, b, _, r in kept]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                by.setdefault(k, []).append(i)
        self.words = ahocorasick.Automaton()
        for k, own in by.items():
            self.words.add_word(k, (len(k), own))
        self.words.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, Rule]]:
        """All matches of all rules, before any is suppressed."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals lower to two characters
            low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, own) in self.words.iter(low):
            for i in own:
                hits.setdefault(i, []).append((end + 1 - size, end + 1))
        found = []
        for i, places in hits.items():
            r = self.rules[i]
            places.sort()
            a, b = places[0][1] - r.width, places[0][0] + r.width
            for x, y in [*places[1:], (len(text) + 3 * r.width, len(text) + 3 * r.width)]:
                if y - r.width <= b:
                    b = x + r.width
                    continue
                found += self._matches(r, text, max(0, a), min(len(text), b))
                a, b = y - r.width, x + r.width
        return found

    @staticmethod
    def _matches(r: Rule, text: str, a: int, b: int) -> list[tuple[int, int, Rule]]:
        # further characters are there for what a pattern looks ahead at; no match of its own ends beyond b
        return [(m.start(), m.end(), r) for m in r.pattern.finditer(text, a, min(len(text), b + AHEAD)) if m.end() <= b]

    def scan(self, text: str) -> list[tuple[int, int, Rule]]:
        return resolved(self.find(text))


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(compiled())


_OUT = [("license", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string())]


def detections(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule, priority, start, end, matched): a row per detection that stays, of the whole text.

    start and end count characters from 0. Null and empty texts have none. A null doc_id is passed on; repeated
    rows give repeated detections; columns other than doc_id and text are not read; an empty table gives no rows.
    """
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    names = ["doc_id", *(n for n, _ in _OUT)]

    def read(batches):
        own = scanner()
        for batch in batches:
            ids, rows = batch.column(0), []

            def flush():
                cols = list(zip(*rows))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(cols[1:], _OUT))], names)

            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    rows += [(i, r.license, r.number, r.priority, a, b, text[a:b]) for a, b, r in own.scan(text)]
                if len(rows) >= _ROWS:
                    yield flush()
                    rows = []
            if rows:
                yield flush()

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {id_type}, license string, rule int, priority int, start long, end long, matched string")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(table(spark, sf_dir, "documents"))
