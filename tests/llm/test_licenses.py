import random
import re

import pytest

from llm_helpers import messy_rows, rows_of
from lodeseek.llm import license_scan as ls

RULES = ls.compiled()


def brute(text):
    """All matches of all patterns over the whole text, without the prefilter."""
    return {(m.start(), m.end(), r.number) for r in RULES for m in r.pattern.finditer(text)}


def suppressed(found):
    """The same rules of suppression, each detection against each kept one."""
    kept = []
    for a, b, r in sorted(set(found), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].number)):
        if not any(x <= a and b <= y or (a < y and x < b and k.priority > r.priority) for x, y, k in kept):
            kept.append((a, b, r))
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].number))


PIECES = ["GNU General Public License", "version 3", "or later", "Affero", "Lesser", "CC BY", "CC-BY-SA-4.0", "MIT", "licence: ", "license\n", "Apache License 2.0", "(c) 2001", "Copyright 1999, 2001-2003", "İstanbul", "All rights reserved", "public domain", "released into the", "\n * ", "; either ", "BSD", "3-clause", "new BSD license", "under the", "GPLv2+", "LGPL-3.0", "SPDX-License-Identifier:", "not evil", "ſpdx K", "Creative Commons Attribution 4.0", "Mozilla Public License", "words in between"]


def mixed(seed, n=40):
    rnd = random.Random(seed)
    return "".join(rnd.choice(PIECES) + rnd.choice([" ", "\n", ", ", ""]) for _ in range(rnd.randint(1, n)))


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 250 and len({r.pattern.pattern for r in RULES}) == len(RULES)
    assert all(0 < r.width < 2000 and r.keywords and all(k == k.lower() for k in r.keywords) for r in RULES)


@pytest.mark.parametrize("seed", range(60))
def test_the_prefilter_loses_nothing(seed):
    text = mixed(seed, 200 if seed % 10 == 0 else 40)
    found = ls.scanner().find(text)
    assert {(a, b, r.number) for a, b, r in found} == brute(text)
    assert ls.resolved(found) == suppressed(found)


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("Released under the MIT License.", ["MIT"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT", ["GPL-2.0-or-later", "MIT"]),
        ("under the terms of the GNU Lesser General\n * Public License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("SPDX-License-Identifier: Foo-1.0", ["unknown-spdx"]),
        ("clean prose about mittens and apaches", []),
        ("MIT License MIT License", ["MIT", "MIT"]),
    ],
)
def test_texts(text, expect):
    assert [r.license for _, _, r in ls.scanner().scan(text)] == expect


def test_repeated_lines_are_found_each():
    assert len(ls.scanner().scan("Released under the MIT License.\n" * 5000)) == 5000


def test_messy(spark, messy, clashing, empty):
    lines = [(200, "Released under the MIT License."), (200, "Released under the MIT License."), (None, "GPLv3"), (201, None), (202, ""), (203, "word " * 50_000 + "CC0 1.0" + " word" * 50_000)]
    df = messy.select("doc_id", "text").unionByName(spark.createDataFrame(lines, "doc_id long, text string"))
    expect = sorted([(i, r.license, r.number, r.priority, a, b, t[a:b]) for i, t in [(x[0], x[1]) for x in messy_rows()] + lines if t for a, b, r in suppressed([(a, b, RULES[n]) for a, b, n in brute(t)])], key=repr)
    got = rows_of(ls.detections(df))
    assert got == expect and {r[0] for r in got} >= {200, None, 203}
    assert rows_of(ls.detections(clashing)) == rows_of(ls.detections(messy))
    assert ls.detections(empty).count() == 0


def without_keyword(rule):
    """Whether any match of rule's pattern may hold none of its keywords: its parts move the ends of keywords that are begun."""
    sre, starts = re._parser, {k[:i] for k in rule.keywords for i in range(len(k))}

    def step(states, chars):
        out = set()
        for s in states:
            for c in chars:
                t = s + c.lower()
                if not any(t.endswith(k) for k in rule.keywords):
                    out.add(next(t[i:] for i in range(len(t) + 1) if t[i:] in starts))
        return out

    def run(nodes, states):
        for op, arg in nodes:
            op = str(op)
            if op == "LITERAL":
                states = step(states, [chr(arg)])
            elif op in ("IN", "NOT_LITERAL", "ANY"):
                one = re.compile("[^%s]" % re.escape(chr(arg)) if op == "NOT_LITERAL" else "(?s:.)") if op != "IN" else None
                states = step(states, [c for c in map(chr, range(128)) if (one.match(c) if one else member(arg, c))] or ["\x80"])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                for _ in range(low):
                    states = run(inner, states)
                new = states
                for _ in range(min(int(high) - low, 200)):
                    new = run(inner, new)
                    if new <= states:
                        break
                    states = states | new
            elif op == "BRANCH":
                states = set().union(*(run(x, states) for x in arg[1]))
            elif op == "SUBPATTERN":
                states = run(arg[3], states)
            else:
                assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
        return states

    def member(items, c):
        found, negated = False, False
        for op, x in items:
            op = str(op)
            if op == "NEGATE":
                negated = True
            elif op == "LITERAL":
                found |= chr(x) == c
            elif op == "RANGE":
                found |= x[0] <= ord(c) <= x[1]
            else:
                found |= {"CATEGORY_DIGIT": c.isdigit(), "CATEGORY_SPACE": c.isspace(), "CATEGORY_WORD": c.isalnum() or c == "_", "CATEGORY_NOT_SPACE": not c.isspace()}[str(x)]
        return found != negated

    return bool(run(sre.parse(rule.pattern.pattern, rule.pattern.flags), {""}))


def test_every_branch_of_a_pattern_holds_a_keyword():
    assert [r.number for r in RULES if without_keyword(r)] == []


def test_phrases_of_the_other_branch():
    assert [r.license for _, _, r in ls.scanner().scan("Enterprise License Agreement")] == ["commercial"]
    assert [(r.license, r.priority) for _, _, r in ls.scanner().scan("Creative Commons CC0 1.0 Universal")] == [("CC0-1.0", 72)]
