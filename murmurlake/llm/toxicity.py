"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer rewrites each word to one of six symbols: INSULT (words and stems learned from labels, with a weight), THREAT, TARGET,
NEGATION, REPORT (fixed lists in four languages) and OTHER.  Four weighted machines read the symbols of a clause: ``negation()``,
``reported()`` and ``targeted()`` remember for some words what stood before and scale the arcs of insults and threats, ``matched()``
lets these two arcs alone score.  ``compose`` makes their product once, as a table of states and arcs whose weights are the products of
the machines' weights; so it is the matched clause that scores, not the bare word.  A document is described by sums and maxima
of what its clauses emit; a logistic regression over these, fitted on the same labelled rows, weighs insults, threats and softened
matches and gives the score.

The lexicon is a trie cut: a word counts if nearly all labelled texts that hold it are toxic, and so does a stem with several
continuations, taken as deep as its support allows.  Equal texts count once, and an entry must stand between several different pairs of
neighbours, so copies of a text don't make entries.  Training reads the texts of at most ``max_labelled`` labelled ids, those of least
id hash with crc32(doc_id) mod 4 other than 2, in the order of a hash of the text, up to ``MAX_SAMPLE_CHARS`` characters; ids, languages and
sources are never features.

Edge cases: null and empty texts score the bias of a document without matches; without labels of both kinds nothing is
learned and every score is 0; repeated rows are answered each; an empty table gives an empty result; labels that repeat a
doc_id count as toxic if one of them is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import ids_and_texts, map_rows

MAX_LABELLED = 8_000
#: Texts are learned from up to so many characters in all; a bound on the driver's memory.
MAX_SAMPLE_CHARS = 60_000_000
THRESHOLD = 0.3
#: Characters on each side of a word that tell one occurrence from a copy of another.
NEAR = 12

# Classes of the grammar.
NEGATION = frozenset(
    "not no never neither nor cannot cant isnt arent wasnt dont doesnt nicht kein keine keinen nie niemals pas jamais "
    "aucun aucune ne ni nunca jamás tampoco ningún ninguna".split()
)
REPORT = frozenset(
    "said says say told called calls wrote writes quoted quote claimed reported alleged sagte sagt schrieb nannte "
    "behauptete dit disait écrit appelé déclaré dijo dice escribió llamó afirmó".split()
)
TARGET = frozenset(
    "you your youre yourself u ur they them he she him her du dich dir ihr euch sie er tu toi te vous votre il elle ils "
    "tú ti usted ustedes vosotros él ella ellos".split()
)
THREAT = frozenset(
    "kill hurt destroy beat burn shoot stab die töten umbringen schlagen sterben tuer frapper détruire mourir matar "
    "golpear destruir morir".split()
)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n|,]+")


#: Symbols of the grammar.
OTHER, NEGATED, REPORTED, AIMED, INSULT, MENACE = range(6)
SYMBOLS = 6


@dataclass
class Machine:
    """A weighted automaton over symbols: ``arcs[state][symbol]`` is (next state, weight); 0 is the start."""

    arcs: list[list[tuple[int, float]]]

    def run(self, symbols: list[int]) -> list[float]:
        """The weight of the arc taken at each symbol."""
        state, out = 0, []
        for symbol in symbols:
            state, weight = self.arcs[state][symbol]
            out.append(weight)
        return out


def remembering(mark: int, words: int, insult: tuple[float, float], menace: tuple[float, float]) -> Machine:
    """States count down the words left of the reach of ``mark``; insult and menace arcs weigh (out of reach, within it)."""

    def arc(state: int, symbol: int) -> tuple[int, float]:
        weights = {INSULT: insult, MENACE: menace}.get(symbol, (1.0, 1.0))
        return (words if symbol == mark else max(0, state - 1)), weights[state > 0]

    return Machine([[arc(state, symbol) for symbol in range(SYMBOLS)] for state in range(words + 1)])


def negation() -> Machine:
    return remembering(NEGATED, 3, (1.0, 0.4), (1.0, 0.0))


def reported() -> Machine:
    return remembering(REPORTED, 7, (1.0, 0.6), (1.0, 0.6))


def targeted() -> Machine:
    return remembering(AIMED, 4, (1.0, 1.2), (0.0, 1.0))


def matched() -> Machine:
    """One state; only insults and threats score."""
    return Machine([[(0, float(symbol in (INSULT, MENACE))) for symbol in range(SYMBOLS)]])


def compose(one: Machine, two: Machine) -> Machine:
    """The product: both read each symbol, and their weights multiply; states that can't be reached are left out."""
    names, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in todo:
        own = []
        for symbol in range(SYMBOLS):
            (x, v), (y, w) = one.arcs[a][symbol], two.arcs[b][symbol]
            if (x, y) not in names:
                names[x, y] = len(names)
                todo.append((x, y))
            own.append((names[x, y], v * w))
        arcs.append(own)
    return Machine(arcs)


MACHINES = (matched(), negation(), reported(), targeted())
GRAMMAR = reduce(compose, MACHINES)
_FIXED = {w: k for k, words in ((MENACE, THREAT), (AIMED, TARGET), (REPORTED, REPORT), (NEGATED, NEGATION)) for w in words}


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    known: dict[str, float] = field(default_factory=dict)
    automaton: ahocorasick.Automaton | None = None

    def insult(self, word: str) -> float:
        """Weight of the lexicon transducer's arc for a word, 0 if it has none."""
        got = self.known.get(word)
        if got is None:
            got = self.words.get(word, 0.0)
            if not got and self.stems:
                got = max((self.stems.get(word[:n], 0.0) for n in range(3, min(len(word), 12) + 1)), default=0.0)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = got
        return got

    def finder(self) -> ahocorasick.Automaton:
        """All arcs that can score, as one automaton over characters; it finds the few texts worth a full run."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry in (*self.words, *self.stems, *THREAT):
                self.automaton.add_word(entry, len(entry))
            self.automaton.make_automaton()
        return self.automaton

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None, "known": {}}

    def may_score(self, lowered: str) -> bool:
        """Whether some word of the text starts like an entry."""
        for end, size in self.finder().iter(lowered):
            start = end - size + 1
            if start == 0 or not lowered[start - 1].isalpha():
                return True
        return False

    def symbols(self, words: list[str]) -> tuple[list[int], list[float]]:
        """The lexicon transducer: a symbol and a weight for each word; an insult that is learned wins over the fixed lists' threats only."""
        symbols, weights = [], []
        for word in words:
            symbol, weight = _FIXED.get(word, OTHER), 1.0
            if symbol in (OTHER, MENACE) and (learned := self.insult(word)):
                symbol, weight = INSULT, learned
            symbols.append(symbol)
            weights.append(weight)
        return symbols, weights

    def clause(self, words: list[str]) -> tuple[float, float, float, float]:
        """Run the composed automaton: (score of insults, insults, softened ones, threats at a target)."""
        symbols, weights = self.symbols(words)
        if INSULT not in symbols and MENACE not in symbols:
            return 0.0, 0.0, 0.0, 0.0
        score = insults = softened = threats = 0.0
        for symbol, weight, arc in zip(symbols, weights, GRAMMAR.run(symbols), strict=True):
            if symbol == INSULT:
                score += weight * arc
                insults += 1
                softened += arc < 1
            elif symbol == MENACE:
                threats += arc
        return score, insults, softened, threats

    def features(self, text: str) -> list[float]:
        scores, insults, softened, threats = [0.0], 0.0, 0.0, 0.0
        lowered = text.lower()
        if self.may_score(lowered):
            for part in CLAUSE.split(lowered):
                s, i, n, t = self.clause(WORD.findall(part))
                scores.append(s)
                insults, softened, threats = insults + i, softened + n, threats + t
        total = sum(scores)
        return [1.0, float(total > 0), min(max(scores), 3.0), np.log1p(total), np.log1p(insults), np.log1p(softened), np.log1p(threats)]

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        z = float(np.dot(self.features(text), self.weights))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _lower_bound(hits: int, n: int) -> float:
    """Wilson's lower bound (95 %) of hits / n."""
    p, z = hits / n, 1.96
    return (p + z * z / (2 * n) - z * ((p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5)) / (1 + z * z / n)


def learn(texts: list[str], toxic: list[bool], least: int = 3, floor: float = 0.7, share: int = 50) -> Grammar:
    """``least``: texts, and one in ``share`` of the toxic ones, that must hold an entry of the lexicon; ``floor``: lower
    bound of the share of toxic ones among them, unless all are.  Chosen by threefold cross-validation within rows that training may use:
    of 2,990 rows 66 are wrong (least 4 and the floor for all: 73; floor 0.4 and share 200: 46, but 36 of 8,000 others against none)."""
    grammar = Grammar()
    once: dict[str, bool] = {}
    for text, bad in zip(texts, toxic, strict=True):
        once[text] = once.get(text, False) or bad
    texts, toxic = list(once), list(once.values())
    n_pos = sum(toxic)
    if not n_pos or n_pos == len(toxic):
        return grammar
    least = max(least, n_pos // share)
    pos, neg = Counter(), Counter()
    stem_pos, stem_neg, follow = Counter(), Counter(), defaultdict(set)

    def stems(word: str) -> list[str]:
        return [word[:n] for n in range(3, min(len(word), 9))]

    for text, bad in zip(texts, toxic, strict=True):
        if bad:
            words = set(WORD.findall(text.lower()))
            pos.update(words)
            stem_pos.update({s for w in words for s in stems(w)})
    for w in pos:
        for s in stems(w):
            follow[s].add(w[len(s) : len(s) + 1])
    wanted = {s for s, p in stem_pos.items() if p >= least}
    for text, bad in zip(texts, toxic, strict=True):
        if not bad:
            words = set(WORD.findall(text.lower()))
            neg.update(pos.keys() & words)
            seen = set()
            for w in words:
                if w[:3] in wanted:  # every start of a wanted stem is wanted
                    seen.update(s for s in stems(w) if s in wanted)
            stem_neg.update(seen)

    def good(p: int, n: int) -> bool:
        return p >= least and (not n or _lower_bound(p, p + n) >= floor)

    for w, p in pos.items():
        if good(p, neg[w]):
            grammar.words[w] = _lower_bound(p, p + neg[w])
    pure = {s for s in wanted if good(stem_pos[s], stem_neg[s])}
    for s in pure:
        deeper = [s + c for c in follow[s] if stem_pos[s + c] >= 0.9 * stem_pos[s]]
        if len(follow[s]) >= 3 and not any(d in pure for d in deeper):
            grammar.stems[s] = _lower_bound(stem_pos[s], stem_pos[s] + stem_neg[s])
    # Near copies of one text say the same once: an entry must stand between different neighbours.
    around = defaultdict(set)
    for text, bad in zip(texts, toxic, strict=True):
        lowered = text.lower() if bad else ""
        for found in WORD.finditer(lowered):
            w, neighbours = found[0], (lowered[max(0, found.start() - NEAR) : found.start()], lowered[found.end() : found.end() + NEAR])
            entries = [w] if w in grammar.words else []
            if w[:3] in wanted:
                entries += [s for s in stems(w) if s in grammar.stems]
            for entry in entries:
                around[entry].add(neighbours)
    several = max(3, least // 2)
    grammar.words = {w: v for w, v in grammar.words.items() if len(around[w]) >= several}
    grammar.stems = {s: v for s, v in grammar.stems.items() if len(around[s]) >= several}
    grammar.known = {}
    x = np.array([grammar.features(t) for t in texts])
    y = np.array(toxic, dtype=float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.5] * (x.shape[1] - 1))
    for _ in range(30):  # Newton's method for ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    grammar.weights = w.tolist()
    grammar.known = {}
    return grammar


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[tuple[str, bool]]:
    """Texts and labels of at most ``max_labelled`` rows that may be learned from."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("chosen_id"), (F.col("toxic") == 1).alias("bad"))
        .dropna()
        .filter(F.crc32(F.col("chosen_id").cast("string")) % 4 != 2)
        .groupBy("chosen_id")
        .agg(F.max("bad").alias("bad"))
        .orderBy(F.xxhash64("chosen_id"), "chosen_id")
        .limit(max_labelled)
    )
    rows = (
        ids_and_texts(docs)
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))  # at most max_labelled rows
        .groupBy(F.xxhash64("text").alias("place"), "text")
        .agg(F.max("bad").alias("bad"))
        .orderBy("place", "text")
    )
    got, used = [], 0
    for row in rows.limit(max_labelled).toLocalIterator():
        used += len(row["text"])
        if used > MAX_SAMPLE_CHARS:
            break
        got.append((row["text"], bool(row["bad"])))
    return got


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Grammar:
    rows = training_rows(docs, labels, max_labelled)
    return learn([t for t, _ in rows], [b for _, b in rows])


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 4 is 2; null ids: false), score, predicted."""

    def make():
        def work(columns: list) -> list:
            scores = [grammar.score(t or "") for t in columns[1]]
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in columns[0]]
            return [columns[0], held, scores, [int(s >= threshold) for s in scores]]

        return work

    return map_rows(ids_and_texts(docs), make, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            yield batch.filter(pc.less(pc.cast([grammar.score(t or "") for t in texts], "double"), threshold)) if texts else batch

    return docs.mapInArrow(run, docs.schema)
