import os
import random

import pytest
from pyspark.sql import functions as F

from llm_helpers import messy_rows, rows_of
from lodeseek.llm import toxicity as tx

HELD = os.environ.get("HELD_DIR", "/root/testdata/sf0.01")
MODEL = tx.lexicon()


LEARNED = {"blorf": 0.6, "zarg": 0.45}
TAUGHT = tx.lexicon(LEARNED)
LISTS = {w: c for c, ws in (("intent", tx.INTENTS), ("target", tx.TARGETS), ("report", tx.REPORTS), ("negation", tx.NEGATIONS), ("threat", tx.THREATS), ("insult", " ".join(tx.INSULTS.values()))) for w in ws.split()}
PHRASED = [(p.split(), c) for c, ps in tx.PHRASES.items() for p in ps]


def step_by_step(words, learned=LEARNED):
    """The transducers one after the other, as lists of labels, without composing them."""
    labels = [LISTS.get(w, "learned" if w in learned else "other") for w in words]
    i = 0
    while i < len(words):
        fits = [(p, c) for p, c in PHRASED if words[i : i + len(p)] == p]
        if fits:
            p, c = max(fits, key=lambda f: len(f[0]))
            labels[i : i + len(p)] = ["other"] * (len(p) - 1) + [c]
            i += len(p) - 1
        i += 1
    if not {"insult", "learned", "threat", "menace"} & set(labels):
        return None
    out, reach = [], 0
    for c in labels:  # negation: the next three words
        now = reach > 0
        reach = 3 if c == "negation" else max(0, reach - 1)
        out.append({"insult": "weak", "threat": "other", "menace": "other", "learned": "weak learned"}.get(c, c) if now and c != "negation" else c)
    labels, out, said = out, [], False
    for c in labels:
        out.append({"insult": "weak", "threat": "other", "menace": "other", "learned": "weak learned"}.get(c, c) if said and c != "report" else c)
        said = said or c == "report"
    total = 0.0
    for first, then, n in (("target", {"insult": 0.6, "learned": 0.3, "weak": 0.05}, 4), ("insult", {"target": 0.3}, 2), ("intent", {"threat": 0.3}, 3), ("threat", {"target": 0.6}, 3)):
        reach = 0
        for c in out:
            if c == first:
                reach = n
            else:
                total += then.get(c, 0.0) if reach > 0 else 0.0
                reach = max(0, reach - 1)
    own = [learned.get(w, 0) * {"learned": 1, "weak learned": 0.2}.get(c, 0) for w, c in zip(words, out)]
    return total + sum(own) + sum({"insult": 0.75, "weak": 0.15, "threat": 0.05, "menace": 0.7}.get(c, 0.0) for c in out)


def by_hand(text, learned=LEARNED):
    """(weight, clauses) of a text: split character by character, each clause step by step."""
    total, n = 0.0, 0
    for part in "".join("\n" if c in ".!?;" else c for c in text or "").split("\n"):
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in part).lower().split(" ")
        w = step_by_step([x for x in words if x], learned)
        total, n = total + (w or 0), n + (w is not None)
    return total, n


@pytest.mark.parametrize("seed", range(40))
def test_composed_is_as_step_by_step(seed):
    rnd = random.Random(seed)
    pool = ["you", "idiot", "not", "said", "will", "kill", "table", "green", "them", "never", "scum", "destroy", "he", "called", "blorf", "zarg", "drop", "dead", "piece", "of", "trash"]
    words = [rnd.choice(pool) for _ in range(rnd.randint(1, 14))]
    assert TAUGHT.clause(words) == pytest.approx(step_by_step(words) or 0, abs=1e-9) or step_by_step(words) is None


@pytest.mark.parametrize("text", ["they are not blorf, not blorf", "he said blorf blorf", "You are not a blorf.", "She wrote: blorf, you blorf"])
def test_negated_and_reported_learned_words_are_weak(text):
    assert 1 - 2.718281828 ** -TAUGHT.read(text)[0] < tx.TOXIC / 2
    assert TAUGHT.read("you are a blorf")[0] > 3 * TAUGHT.read("you are not a blorf")[0] > 0


def test_phrases():
    assert score("You piece of trash") >= score("You idiot") and score("Go to hell!") > 0.6 > score("They went to hell and back")
    assert score("I will not go to hell") == 0 and score("he said: drop dead") == 0


def test_documents_by_hand(spark):
    """Score and clauses of whole documents, held against the version that shares no code with the model."""
    rnd = random.Random(12)
    pool = "you idiot not said will kill table green them never scum destroy he called blorf zarg drop dead piece of trash crétin Watch YOUR back hölle zur fahr".split()
    texts = ["".join(rnd.choice(pool) + rnd.choice([" "] * 8 + [". ", "! ", ", ", ": ", "\n", "; "]) for _ in range(rnd.randint(0, 120))) for _ in range(150)]
    got = tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TAUGHT).collect()
    assert {r.doc_id: r.clauses for r in got} == {i: by_hand(t)[1] for i, t in enumerate(texts)}
    assert all(r.score == pytest.approx(1 - 2.718281828459045 ** -by_hand(texts[r.doc_id])[0], abs=1e-5) for r in got)


def score(text):
    return MODEL.read(text)[0]


def test_clauses():
    assert score("You are an idiot.") > score("What an idiot.") > score("You are not an idiot.") > 0
    assert score("He said you are an idiot.") < score("You are an idiot.")
    assert score("I will kill you.") > score("I will kill the process.") and score("I will never kill you.") < score("I will kill you.")
    assert score("You idiot! You idiot!") == pytest.approx(2 * score("You idiot!"))
    # the scope of a negation ends with its clause
    assert score("I do not. You are an idiot.") == pytest.approx(score("You are an idiot."))
    assert score("A clean text about tables and chairs, said to you.") == 0 and score("") == 0
    assert MODEL.read("Quiet. You idiot, you scum! Loser.")[3] == "you idiot you scum"
    assert score("DU IDIOT") == score("du idiot") > 0 and score("CRÉTIN") == score("crétin") > 0


def test_messy(spark, messy, clashing, empty):
    lines = [(300, "You idiot! " * 3), (300, "You idiot! " * 3), (None, "You idiot! You scum!"), (301, None), (302, "word " * 100_000 + "you are a pathetic loser, you idiot. " * 3 + " word" * 100_000), (303, "she said: idiot")]
    rows = [(r[0], r[1]) for r in messy_rows()] + lines
    df = messy.select("doc_id", "text").unionByName(spark.createDataFrame(lines, "doc_id long, text string"))
    got = tx.score(df, MODEL)
    expect = sorted([(i, round(1 - 2.718281828459045 ** -by_hand(t, {})[0], 5), by_hand(t, {})[1]) for i, t in rows], key=repr)
    assert sorted([(r.doc_id, round(r.score, 5), r.clauses) for r in got.collect()], key=repr) == expect
    assert {r.worst for r in got.where("doc_id = 302").collect()} == {"you pathetic loser you idiot"}
    assert {r.doc_id for r in got.where("toxic").collect()} == {300, None, 302}
    assert rows_of(tx.score(clashing, MODEL)) == rows_of(tx.score(messy, MODEL)) and tx.score(empty, MODEL).count() == 0


def test_nothing_to_learn(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert tx.learn(messy, labels) == {} and tx.learn(empty, labels) == {} and tx.learn(messy, labels.limit(0)) == {}


@pytest.mark.skipif(not os.path.isdir(HELD), reason="no tables here")
def test_held_out_labels(spark):
    documents, labels = spark.read.parquet(f"{HELD}/documents.parquet"), spark.read.parquet(f"{HELD}/labels.parquet")
    half = F.xxhash64(F.lit(7), "doc_id") % 2 == 0
    model = tx.lexicon(tx.learn(documents, labels.where(half)))
    pairs = [(r["toxic"], r["y"]) for r in tx.score(documents, model).join(labels.where(~half).select("doc_id", F.col("toxic").alias("y")), "doc_id").join(documents.where("lang = 'en'").select("doc_id"), "doc_id").collect()]
    found, clean = [t for t, y in pairs if y], [t for t, y in pairs if not y]
    # the few labels of the other languages teach too few words here
    assert sum(found) / len(found) > 0.8 and sum(clean) / len(clean) < 0.02
