"""Inputs that the tests of this folder share."""

import os
import random

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


def messy_rows(seed=5):
    """Nulls in each column, empty and blank texts, a very long one, ties, rows that are the same, copies and near copies."""
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.randint(1, 60)), rnd.choice(["en", "de", None]), f"src{rnd.randint(0, 6)}", 100) for i in range(40)]
    rows += [(100, rows[3][1], "en", "src1", 1), (101, rows[3][1], None, None, None), (102, rows[4][1] + " extra", "en", "src1", 1)]
    rows += [rows[5], rows[5], (103, None, "en", "src1", 0), (104, "", "en", "src1", 0), (105, " \n\t ", "fr", "src2", 4), (106, "!!", "fr", "", 2)]
    rows += [(None, "a null id here with words", "en", "src1", 3), (None, "a null id here with words", "en", "src1", 3), (None, None, None, None, None)]
    rows += [(107, prose(rnd, 30_000), "en", "src3", 5), (108, "x" * 300_000, "en", "src3", 5), (2**60 + 1, "large id with some words", "xx", "no number", 7), (109, "ünïcödé “text” 文字 \U0001f600 words", "zz", "src", 7)]
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
