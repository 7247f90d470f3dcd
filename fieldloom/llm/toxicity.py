"""Toxicity by a weighted finite-state pattern grammar (operator 2).

Five small transducers, each a table of its own, read a clause word by word:

* negation counts the words since a negating word and, within its reach, turns
  insults and threats into negated ones;
* target and reported speech remember that the clause has named a person or quotes
  someone, and say so at its end;
* insult and threat remember what they were passed, plain or negated, and say so at
  the end.

They are composed into one cascade, lazily: a state of the composition is a tuple of their states,
made when first met, and so is each of its arcs. What leaves the cascade at the
end of a clause is its class, and the arcs that end a clause carry the learnt
weights of the classes. A document's score is a logistic function of the weights of its
matched clauses, each class damped by the logarithm of how often it matched; single words count only by their
clause.

Insults are learnt: words and word beginnings that toxic training rows hold and
others hardly do, by a likelihood ratio that must beat the number of candidates. Beginnings
that other rows hold too, but toxic ones far more often, are slurs, a kind of offence of their own that counts by its
share of the words. The
weights of the classes are fitted on the same rows. ``bound`` caps the training
sample (rows; ``common.SAMPLE_BYTES`` caps its text); every text is scored whole.

Null and empty texts match nothing and get the score of a text without
matches. Without training rows of both kinds every score is the share of toxic
rows (0.5 if there are none). Repeated rows are scored alike; a null doc_id counts as not held out; an
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, strings, table

# the grammar's own words in English, German, French and Spanish: a choice of this module, open to change
TARGETS = "you your yours he she they them him her du dich dir ihr euch sie er tu toi vous il elle ils tú usted ustedes él ella ellos vosotros".split()
NEGATIONS = "not no never none isn't aren't don't nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split()
REPORTS = "said says say called calls quoted quote wrote claimed sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()
THREATS = "kill hurt destroy burn stab shoot töten umbringen verletzen tuer frapper brûler matar golpear quemar".split()

#: What a word carries on the way through the cascade; the last two are made inside it.
INSULT, THREAT, TARGET, NEGATION, REPORT, END, SLUR, NOT_INSULT, NOT_THREAT, NOT_SLUR = (1 << k for k in range(10))
KINDS = ((INSULT, NOT_INSULT), (THREAT, NOT_THREAT), (SLUR, NOT_SLUR))
REACH = 4  # words over which a negation holds
BOUND = 8000
_HARMLESS = bytes(c for c in range(256) if not c & (INSULT | THREAT | SLUR))
_EDGES = re.compile(r"^\W+|\W+$")


def learn_insults(rows: list[tuple[str, int]], shortest: int = 3, longest: int = 8, strong: float = 0.85, weak: float = 0.4) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Words, and beginnings of words, that mark toxic rows; and beginnings that are a good part as often in other rows (slurs)."""
    seen, counts, known = {0: Counter(), 1: Counter()}, Counter(), set()
    for text, y in rows:
        run = text.lower().split()
        # copies in the sample count once: a row whose five-word runs (judged by one in eight, by hash) are mostly known
        # adds no evidence here; it still helps to fit the weights
        shingles = {h for h in (zlib.crc32(" ".join(run[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(run) - 4))) if h % 8 == 0}
        if len(shingles & known) * 2 > len(shingles):
            continue
        known |= shingles
        counts[y] += 1
        own: set[str] = set()
        for word in {_EDGES.sub("", w) for w in run}:
            own.add("=" + word)
            own.update(word[:k] for k in range(shortest, min(longest, len(word) - 1) + 1))
        seen[y].update(own)
    total = counts[0] + counts[1]
    if not counts[0] or not counts[1]:
        return frozenset(), frozenset(), frozenset()
    base, need = counts[1] / total, math.log(len(seen[1]) + 2) + 4
    good, fair = {}, {}
    for f, p in seen[1].items():
        n = seen[0][f]
        precision = (p + 0.5 * base) / (p + n + 0.5)
        if precision >= weak and p * math.log(precision / base) + n * math.log((1 - precision) / (1 - base)) > need:
            (good if precision >= strong else fair)[f] = p
    words = {f[1:] for f in good if f[0] == "="}
    starts = {f for f in good if f[0] != "="}
    # of the beginnings of one stem the longest that loses nothing, and none that a shorter one covers
    long = {f for f in starts if not any(g[: len(f)] == f and len(g) == len(f) + 1 and good[g] >= 0.95 * good[f] for g in starts)}
    long = {f for f in long if not any(f[:k] in long for k in range(shortest, len(f)))}
    # a beginning that one word alone carries is that word
    lone = {f for f in long if any(w.startswith(f) and good["=" + w] >= 0.9 * good[f] for w in words)}
    # of slurs the beginnings that are as frequent as their own beginning
    slurs = {f for f in fair if f[0] != "=" and not any(w.startswith(f) and 2 * good["=" + w] >= fair[f] for w in words)}
    slurs = {f for f in slurs if not any(g[: len(f)] == f and len(g) == len(f) + 1 and fair[g] >= 0.9 * fair[f] for g in slurs)}
    slurs = {f for f in slurs if not any(f[:k] in slurs or f[:k] in long for k in range(shortest, len(f)))}
    return frozenset(words), frozenset(long - lone), frozenset(slurs)


class Transducer:
    """A table (state, symbol) -> (next state, output symbol) over the marks in ``reads``; other marks pass through."""

    def __init__(self, reads: int, start: int, table: dict[tuple[int, int], tuple[int, int]]):
        self.reads, self.start, self.table = reads, start, table

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        new, out = self.table[state, symbol & self.reads]
        return new, (symbol & ~self.reads) | out


def _subsets(marks: int) -> list[int]:
    return [s for s in range(marks + 1) if not s & ~marks]


def negation(reach: int = REACH) -> Transducer:
    """State: words since a negating word, up to ``reach``; within reach insults and threats leave as negated ones."""
    reads, table = NEGATION | INSULT | THREAT | SLUR | END, {}
    for state in range(reach + 1):
        for s in _subsets(reads):
            out = s & ~NEGATION
            if state < reach:
                out = (s & END) | sum(no for yes, no in KINDS if s & yes)
            table[state, s] = (reach if s & END else 0 if s & NEGATION else min(reach, state + 1)), out
    return Transducer(reads, reach, table)


def remember(mark: int) -> Transducer:
    """State: whether the clause has shown the mark; at its end the mark leaves, before it nothing does."""
    table = {(state, s): (0 if s & END else int(state or bool(s & mark)), (s & END) | (mark if s & END and (state or s & mark) else 0)) for state in (0, 1) for s in _subsets(mark | END)}
    return Transducer(mark | END, 0, table)


def offence(plain: int, negated: int) -> Transducer:
    """State: nothing, negated or plain; at the clause's end the strongest leaves."""
    table = {}
    for state in (0, 1, 2):
        for s in _subsets(plain | negated | END):
            now = max(state, 2 if s & plain else 1 if s & negated else 0)
            table[state, s] = (0, END | (0, negated, plain)[now]) if s & END else (now, 0)
    return Transducer(plain | negated | END, 0, table)


class Cascade:
    """Transducers composed one after another; states and arcs are made when first met."""

    def __init__(self, parts: list[Transducer]):
        self.parts = parts
        self.states = [tuple(p.start for p in parts)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}  # state << 8 | symbol -> next state, output

    def arc(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.arcs.get(state << 8 | symbol)
        if found is None:
            new, out = [], symbol
            for part, own in zip(self.parts, self.states[state]):
                to, out = part.step(own, out)
                new.append(to)
            key = tuple(new)
            if key not in self.number:
                self.number[key] = len(self.states)
                self.states.append(key)
            found = self.arcs[state << 8 | symbol] = self.number[key], out
        return found


class Grammar(dict):
    """A word as written -> its symbol; and the composed machine that reads them."""

    CLASSES = 8 * len(KINDS)

    def __init__(self, words: frozenset[str], starts: frozenset[str], slurs: frozenset[str] = frozenset()):
        super().__init__()
        self.starts = [(k, {s for s in group if len(s) == k}, mark) for mark, group in ((INSULT, starts), (SLUR, slurs)) for k in sorted({len(s) for s in group})]
        self.symbols: dict[str, int] = {}
        for mark, group in ((INSULT, words), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in group:
                self.symbols[w] = self.symbols.get(w, 0) | mark
        self.machine = Cascade([negation(), remember(TARGET), remember(REPORT), *(offence(*kind) for kind in KINDS)])

    def __missing__(self, run: str) -> int:
        if len(self) > 300_000:
            self.clear()
        word = _EDGES.sub("", run.lower())
        symbol = self.symbols.get(word, 0)
        for k, group, mark in self.starts:
            if word[:k] in group:
                symbol |= mark
        if symbol & INSULT:
            symbol &= ~SLUR
        if run[-1] in ".!?;,:\"”»)":
            symbol |= END
        self[run] = symbol
        return symbol

    @staticmethod
    def matched(out: int) -> list[int]:
        """The classes of a clause by what leaves the cascade: kind, target, reported, negated."""
        both = 4 * bool(out & TARGET) + 2 * bool(out & REPORT)
        return [8 * kind + both + bool(out & no) for kind, (yes, no) in enumerate(KINDS) if out & (yes | no)]

    def classes(self, text: str) -> np.ndarray:
        """How many clauses of each class the text holds; of slurs, how many in 100 words."""
        counts = np.zeros(self.CLASSES)
        codes = bytes(map(self.__getitem__, text.split()))
        if not codes.translate(None, _HARMLESS):
            return counts
        arcs, arc, state = self.machine.arcs, self.machine.arc, 0
        for code in codes + bytes((END,)):
            state, out = arcs.get(state << 8 | code) or arc(state, code)
            if out & ~END:
                for c in self.matched(out):
                    counts[c] += 1
        counts[16:] *= 100 / max(50, len(codes))
        return counts


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], strength)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
    return w


def learn(rows: list[tuple[str, int]]) -> tuple[tuple[frozenset[str], frozenset[str], frozenset[str]], np.ndarray]:
    lexicon = learn_insults(rows)
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return lexicon, np.append(np.zeros(Grammar.CLASSES), math.log(p / (1 - p)))
    grammar = Grammar(*lexicon)
    x = np.log1p(np.array([grammar.classes(r[0]) for r in rows]))
    return lexicon, fit_weights(x, y)


def score_toxicity(docs: DataFrame, rows: list[tuple[str, int]]) -> DataFrame:
    """doc_id, score and the matched clauses by class, for every row of ``docs``."""
    lexicon, weights = learn(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*lexicon)
        for batch in batches:
            x = np.array([grammar.classes(t.as_py()) for t in strings(batch.column("text"))]).reshape(-1, Grammar.CLASSES)
            z = np.log1p(x) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(x.sum(axis=1))], ["doc_id", "score", "clauses"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, clauses double")


def op2_toxicity(spark: SparkSession, sf_dir: str, bound: int = BOUND) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled_sample(docs, labels, "toxic", F.coalesce(remainder("doc_id", 5) != 0, F.lit(True)), bound)
    out = score_toxicity(docs, rows)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
