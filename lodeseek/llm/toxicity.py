"""Toxicity by a weighted finite-state grammar over clauses.

Transducers are composed into one. The lexicon maps words, and phrases word by word (the class comes with the last
word, the longest phrase from a word counts), to classes. Negation and reported speech rewrite insults and threats that stand in their scope (the next words of the clause; the rest of the clause)
to weaker classes. Target and threat patterns raise an insult that is aimed at someone near it, and a threat
that has a victim. The last one weighs what is left. A clause's score is the weight of its path, and only
clauses that the grammar matches (that hold an insult or a threat) score; a document's is their sum w, given
as 1 - exp(-w).

Besides a hand-written lexicon of four languages, insults are learned from labelled documents: all words that stand in
many toxic and hardly any other of a bounded sample. As each stands in SHARE of the toxic ones at least, there are at most
1 / SHARE times the different words of a document. A learned word's weight follows its odds, and one alone doesn't make a
document toxic; where the grammar has weakened it, it has WEAK of that weight.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import table
from lodeseek.llm.ngram_join import gram_sets
from lodeseek.llm.quality_rules import labelled_sample
from lodeseek.llm.textfeat import _LOWER, _WORD, _power_tables, buffers, chunks

#: A document of this score is toxic.
TOXIC = 0.5
#: Bound of the labelled documents of each class from which insults are learned.
SAMPLE = 2000
#: Share of its weight that an insult keeps where it is negated or reported.
WEAK = 0.2
#: A learned word stands in so many toxic documents of the sample at least, this share of them, with these odds.
LEAST, SHARE, ODDS = 4, 0.01, 40.0

INSULTS = {
    1.0: "idiot idiots moron morons scum loser losers trash worthless pathetic disgusting stupid clown clowns imbecile dumbass asshole bastard vermin degenerate freak coward subhuman "
    "idiotin trottel dummkopf arschloch abschaum versager dreckskerl missgeburt widerlich "
    "imbécile crétin connard salaud ordure minable débile abruti "
    "imbécil estúpido estúpida cabrón escoria inútil patético basura asqueroso".replace("\n", " "),
}
THREATS = "kill hurt destroy crush punch stab shoot beat strangle burn töten umbringen verprügeln erschießen tuer frapper détruire matar golpear destruir"
TARGETS = "you your yours u ur he she they them him her those these du dich dir ihr euch sie tu toi te vous ton ta tú usted ustedes ti vosotros"
NEGATIONS = "not never no isn aren wasn weren don doesn didn without nicht kein keine keinen nie pas jamais aucun nunca jamás sin"
REPORTS = "said says say called calls quoted quote reported claimed claims according wrote sagte nannte zitierte laut dit disait appelé selon dijo llamó según citó"
INTENTS = "will would shall gonna going want should werde wird will vais va veux voy va quiero"

PHRASES = {
    "insult": ("piece of trash", "piece of garbage", "piece of filth", "waste of space", "waste of oxygen", "scum of the earth", "stück dreck", "fils de pute", "hijo de puta"),
    "menace": ("drop dead", "go to hell", "burn in hell", "rot in hell", "watch your back", "make you pay", "make you suffer", "end your life", "fahr zur hölle", "va au diable", "vete al infierno"),
}

CLASSES = ("other", "insult", "learned", "threat", "menace", "target", "negation", "report", "intent")
#: Classes that make a clause match.
MATCHED = ("insult", "learned", "threat", "menace")
_WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
#: A colon ends no clause: what is reported stands after it.
_CLAUSE = re.compile(r"[.!?;\n]+")


@dataclass
class Fst:
    """A deterministic transducer: arcs[state][label] = (label out, weight, next state). Missing labels loop unchanged through default[state]."""

    arcs: list[dict[str, tuple[str, float, int]]]
    #: Next state on any label that has no arc; the label passes as it is.
    default: list[int] = field(default_factory=list)

    def step(self, state: int, label: str) -> tuple[str, float, int]:
        return self.arcs[state].get(label) or (label, 0.0, self.default[state])


def compose(a: Fst, b: Fst, labels: tuple[str, ...]) -> Fst:
    """What feeding a's output to b does, over the given input labels; only states that can be reached."""
    index, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    while len(arcs) < len(todo):
        x, y = todo[len(arcs)]
        own = {}
        for label in labels:
            mid, w1, nx = a.step(x, label)
            out, w2, ny = b.step(y, mid)
            if (nx, ny) not in index:
                index[nx, ny] = len(todo)
                todo.append((nx, ny))
            own[label] = (out, w1 + w2, index[nx, ny])
        arcs.append(own)
    return Fst(arcs, [0] * len(arcs))


def _scope(trigger: str, words: int, rewrite: dict[str, str]) -> Fst:
    """In the words after trigger, labels are rewritten. words = 0: up to the clause's end."""
    if not words:
        return Fst([{trigger: (trigger, 0.0, 1)}, {k: (v, 0.0, 1) for k, v in rewrite.items()}], [0, 1])
    arcs = [{trigger: (trigger, 0.0, words)}]
    for i in range(1, words + 1):
        arcs.append({trigger: (trigger, 0.0, words)} | {k: (v, 0.0, i - 1) for k, v in rewrite.items()})
    return Fst(arcs, [0, *range(words)])


def _near(first: str, then: dict[str, float], words: int) -> Fst:
    """Adds then[label] to a label within so many words after first."""
    arcs = [{first: (first, 0.0, words)}]
    for i in range(1, words + 1):
        arcs.append({first: (first, 0.0, words)} | {k: (k, w, i - 1) for k, w in then.items()})
    return Fst(arcs, [0, *range(words)])


def grammar() -> Fst:
    """Negation, reported speech, target, victim and weights composed: from word classes to clause weights."""
    out = (*CLASSES, "weak", "weak learned")
    weak = {"insult": "weak", "threat": "other", "menace": "other", "learned": "weak learned"}
    parts = [
        _scope("negation", 3, weak),
        _scope("report", 0, weak),
        _near("target", {"insult": 0.6, "learned": 0.3, "weak": 0.05}, 4),  # you ... idiot
        _near("insult", {"target": 0.3}, 2),  # idiot ... you
        _near("intent", {"threat": 0.3}, 3),  # will ... hurt
        _near("threat", {"target": 0.6}, 3),  # hurt ... you
        Fst([{"insult": ("", 0.75, 0), "weak": ("", 0.75 * WEAK, 0), "threat": ("", 0.05, 0), "menace": ("", 0.7, 0)}], [0]),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = compose(whole, p, out)
    return whole


@dataclass
class Toxicity:
    """words: lowered word -> (class, weight besides the grammar's). phrases: lowered words -> class."""

    words: dict[str, tuple[str, float]]
    phrases: dict[tuple[str, ...], str] = field(default_factory=dict)

    def __post_init__(self):
        fst = grammar()
        own = {"learned": 1.0, "weak learned": WEAK}
        # weight, next state, and the share of a learned word's own weight: by the class that the grammar makes of it
        self.table = [{c: (fst.step(s, c)[1], fst.step(s, c)[2], own.get(fst.step(s, c)[0], 0.0)) for c in CLASSES} for s in range(len(fst.arcs))]
        self.starts: dict[str, list[tuple[str, ...]]] = {}
        for p in sorted(self.phrases, key=len, reverse=True):
            self.starts.setdefault(p[0], []).append(p)
        hot = [w for w, (c, _) in self.words.items() if c in MATCHED] + [p[-1] for p in self.phrases]
        # the vectorised search lowers ASCII only, so a word counts with a capital of any alphabet as well
        self.hashes = np.unique(_word_hashes({v for w in hot for v in (w, w.capitalize(), w.upper())}))

    def classed(self, words: list[str]) -> list[tuple[str, float]]:
        """Class of each word and its weight besides the grammar's."""
        out, i = [], 0
        while i < len(words):
            found = next((p for p in self.starts.get(words[i], ()) if tuple(words[i : i + len(p)]) == p), None)
            if found:
                out += [("other", 0.0)] * (len(found) - 1) + [(self.phrases[found], 0.0)]
                i += len(found)
            else:
                out.append(self.words.get(words[i], ("other", 0.0)))
                i += 1
        return out

    def weigh(self, classed: list[tuple[str, float]]) -> float:
        state, total = 0, 0.0
        for cls, more in classed:
            weight, state, share = self.table[state][cls]
            total += weight + more * share
        return total

    def clause(self, words: list[str]) -> float:
        return self.weigh(self.classed(words))

    def read(self, text: str) -> tuple[float, int, float, str]:
        """Weight, matched clauses, the heaviest one's weight and words."""
        total, n, most, what = 0.0, 0, 0.0, ""
        for part in _CLAUSE.split(text):
            words = [w.lower() for w in _WORDS.findall(part)]
            classed = self.classed(words)
            if any(c in MATCHED for c, _ in classed):
                w = self.weigh(classed)
                total, n = total + w, n + 1
                if w > most:
                    most, what = w, " ".join(x for x, (c, _) in zip(words, classed) if c != "other")
        return total, n, most, what


def _hash_words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(low)
    word = _WORD[low]
    edge = np.zeros(size + 1, bool)
    edge[off] = True
    first = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge[:-1]))
    last = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | edge[1:])) + 1
    up, down = _power_tables(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
    return first, (total[last] - total[first]) * down[first]


def _word_hashes(words: set[str]) -> np.ndarray:
    out = []
    for w in words:
        low = _LOWER[np.frombuffer(w.encode(), np.uint8)]
        out += list(_hash_words(low, np.array([0, len(low)]))[1])
    return np.asarray(out, np.uint64)


def lexicon(learned: dict[str, float] | None = None) -> Toxicity:
    words: dict[str, tuple[str, float]] = {w: ("learned", x) for w, x in (learned or {}).items()}
    for cls, names in (("intent", INTENTS), ("target", TARGETS), ("report", REPORTS), ("negation", NEGATIONS), ("threat", THREATS)):
        words |= {w: (cls, 0.0) for w in names.split()}
    for names in INSULTS.values():
        words |= {w: ("insult", 0.0) for w in names.split()}
    return Toxicity(words, {tuple(p.split()): cls for cls, names in PHRASES.items() for p in names})


def _distinct(texts: list[str]) -> list[int]:
    """Positions of texts without near copies of earlier ones, by the eight least hashes of their word trigrams."""
    seen: dict[int, list[int]] = {}
    out = []
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        least = [int(x) for x in np.sort(gram_sets(raw, np.array([0, len(raw)]))[1])[:8]]
        hits: dict[int, int] = {}
        for x in least:
            for j in seen.get(x, ()):
                hits[j] = hits.get(j, 0) + 1
        if max(hits.values(), default=0) < max(1, min(3, len(least))):
            out.append(i)
            for x in least:
                seen.setdefault(x, []).append(i)
    return out


def learn(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> dict[str, float]:
    """Insults of labelled documents and their weights; none without labels of both classes. Few labels give low odds, and so fewer insults."""
    rows = labelled_sample(documents, labels, target="toxic", per_class=per_class)
    texts, y = rows["text"].to_pylist(), rows["__y"].to_pylist()
    counts: list[dict[str, int]] = [{}, {}]
    sizes = [0, 0]
    for c in (0, 1):
        own = [t for t, k in zip(texts, y) if k == c]
        for i in _distinct(own):
            sizes[c] += 1
            for w in {w.lower() for w in _WORDS.findall(own[i])}:
                counts[c][w] = counts[c].get(w, 0) + 1
    if not min(sizes):
        return {}
    found = {}
    for w, k in counts[1].items():
        odds = (k + 0.5) / sizes[1] / ((counts[0].get(w, 0) + 0.5) / sizes[0])
        if k >= max(LEAST, SHARE * sizes[1]) and odds >= ODDS and not w.isdigit():
            found[w] = min(0.6, 0.12 * float(np.log(odds)))
    return found


def scores(model: Toxicity):
    """A column function: text -> (score, clauses, worst): of the whole text."""

    @F.arrow_udf("score double, clauses int, worst string")
    def toxic_scores(texts: pa.Array) -> pa.Array:
        data, off = buffers(texts)
        n = len(off) - 1
        score, clauses, worst = np.zeros(n), np.zeros(n, np.int32), [None] * n
        for i, j in chunks(off):
            o = off[i : j + 1] - off[i]
            low = _LOWER[data[off[i] : off[j]]]
            if not len(low):
                continue
            first, h = _hash_words(low, o)
            at = np.searchsorted(model.hashes, h)
            hit = first[(at < len(model.hashes)) & (model.hashes[np.minimum(at, len(model.hashes) - 1)] == h)]
            for r in np.unique(np.searchsorted(o, hit, "right") - 1):
                w, clauses[i + r], _, worst[i + r] = model.read(bytes(data[off[i + r] : off[i + r + 1]]).decode())
                score[i + r] = 1 - np.exp(-w)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(clauses), pa.array(worst, pa.string())], ["score", "clauses", "worst"])

    return toxic_scores


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score, clauses, worst, toxic) of every row; worst: the words of the heaviest clause that have a class.

    A text without a matched clause, empty or null, has score 0, no clauses and a null worst. Repeated rows
    give repeated results, a null doc_id is passed on, other columns are not read, an empty table gives no rows.
    """
    s = docs.select("doc_id", scores(model)("text").alias("s"))
    return s.select("doc_id", F.round("s.score", 6).alias("score"), "s.clauses", "s.worst", (F.col("s.score") >= TOXIC).alias("toxic"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, lexicon(learn(documents, table(spark, sf_dir, "labels"))))
