"""Toxicity by a weighted finite-state pattern grammar.

Transducers in four layers, each reading what the one below it writes:

* Letters to symbols: a trie of insult stems, threat words, targets, negations and verbs of report
  names each word's symbol (``Lexical``).
* Words of a clause: the negation transducer rewrites insults and threats close behind a negation, the
  insult transducer those next to a target, the threat transducer a target that a threat is aimed at,
  and the report transducer whatever follows a verb of report.  They are composed to one (``compose``).
* Matched clauses of a document: weak insults (stems that clean words also begin with) count only if
  another match stands within ``SPAN`` characters; a longer gap forgets the match before it.
* Weights: each output symbol has one, and a document's score is the logistic of the weighted counts.

The insult stems and the weights are learned from a bounded sample of labelled documents
(``SAMPLE`` of each label, by hash order, and of a longer text a window of ``SAMPLE_CHARS``).  Insult
stems are words or word beginnings that occur in toxic documents more often than chance allows (a
Chernoff bound, corrected for the number of candidates); weak stems do so only where they repeat
within ``SPAN``, and are kept if they explain toxic documents without other insults.  Weights are
fitted by ridge regression towards ``PRIOR``, so a pattern that the sample does not show keeps its
prior weight.  The other words are parameters (``Lexicon``), which can be read from a table.

Scale: scoring is one pass on Arrow batches without a shuffle; an automaton finds the stems at
once, and only clauses with a hit are tokenised.  The lexicon and weights are some kB.

Defined cases: null and empty texts, and texts without a match, get the score of the bias alone;
documents labelled twice count by the higher label; of rows that repeat an id the smallest text is
learned from; ties of the sample order go to the smaller id; null labels are not used; without toxic
or without clean labels nothing is learned and all scores are the base rate; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .store import text_batches

SAMPLE, SAMPLE_CHARS = 2000, 1 << 14
#: Characters between two matched clauses beyond which they do not support each other.
SPAN = 1000
#: Fixed word lists of the grammar.
THREATS = frozenset("""attack beat burn choke crush destroy hang hunt hurt kill murder poison punish shoot slap smash stab strangle torture
    erschieße erschießen erschlagen hängen quälen schlage schlagen töte töten umbringen verbrennen verprügeln vergiften
    brûler détruire étrangler frapper pendre poignarder torturer tuer
    ahorcar atacar destruir estrangular golpear matar matarte quemar""".split())
TARGETS = frozenset("du dich er ella elle elles euch he her him ihn ihr il ils it nous she sie te that them they this toi tu tú usted ustedes vos vous you your yourself".split())
NEGATIONS = frozenset("ain aint aren aucun cannot didn doesn don isn jamais jamás kein keine keinen never nicht nie niemals no not nunca pas sans sin tampoco wasn weder without won".split())
REPORTS = frozenset("""alleged called claimed claims dice dijo disait quoted reported reports said says shouted wrote yelled
    behauptet behauptete rief sagt sagte schrieb affirme cria écrit affirma escribió gritó""".split())
SYMBOLS = "IWTGNRO"
#: Outputs: plain, targeted, negated and reported insults; weak ones; plain, aimed, negated and reported threats.
OUTPUTS = ("I", "J", "i", "q", "W", "T", "U", "t", "p")
#: Weights before any label is seen.
PRIOR = {"I": 2.0, "J": 0.5, "W": 1.0, "T": 0.5, "U": 3.0}
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!?;\n]")


@dataclass(frozen=True)
class Lexicon:
    """The words of the grammar that are not learned."""

    threats: frozenset[str] = THREATS
    targets: frozenset[str] = TARGETS
    negations: frozenset[str] = NEGATIONS
    reports: frozenset[str] = REPORTS

    @staticmethod
    def read(table: DataFrame, most: int = 100_000) -> Lexicon:
        """From ``word, kind`` (threat, target, negation or report), at most ``most`` rows."""
        rows = table.where(F.col("word").isNotNull()).select(F.lower("word").alias("word"), "kind").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a lexicon has at most {most} words")
        return Lexicon(*(frozenset(r["word"] for r in rows if r["kind"] == k) for k in ("threat", "target", "negation", "report")))


class Lexical:
    """A letter transducer: reads a word's letters and writes its symbol at the end.

    ``words`` are matched whole; ``stems`` also as beginnings of words (a stem that ends in a blank is
    matched whole).  A stem goes before a word, and the stem named first before the others.
    """

    def __init__(self, words: list[tuple[frozenset, str]], stems: list[tuple[frozenset, str]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[dict[str, int]] = [{}]  # symbol at the word's end, by rank
        self.begun: list[dict[str, int]] = [{}]  # symbol from here on
        self.known: dict[str, str] = {}
        for rank, (entries, symbol) in enumerate(stems):
            for x in entries:
                (self.ends if x.endswith(" ") else self.begun)[self._node(x.rstrip(" "))].setdefault(symbol, rank)
        for rank, (entries, symbol) in enumerate(words, len(stems)):
            for x in entries:
                self.ends[self._node(x)].setdefault(symbol, rank)

    def _node(self, letters: str) -> int:
        at = 0
        for c in letters:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                for table in (self.next, self.ends, self.begun):
                    table.append({})
            at = self.next[at][c]
        return at

    def read(self, word: str) -> str:
        if word in self.known:
            return self.known[word]
        at, found = 0, {}
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                break
            found |= self.begun[at]
        if at >= 0:
            found |= self.ends[at]
        if len(self.known) >= 1 << 16:
            self.known.clear()
        self.known[word] = min(found, key=found.get) if found else "O"
        return self.known[word]


@dataclass
class Transducer:
    """Deterministic letter-to-letter transducer: (state, symbol) to (state, output)."""

    arcs: dict[tuple[int, str], tuple[int, str]]
    start: int = 0

    def run(self, symbols):
        state = self.start
        for s in symbols:
            state, out = self.arcs[state, s]
            yield out


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The transducer that feeds the output of ``first`` to ``second``."""
    number, todo, arcs = {(first.start, second.start): 0}, [(first.start, second.start)], {}
    while todo:
        pair = todo.pop()
        for s in alphabet:
            a, mid = first.arcs[pair[0], s]
            b, out = second.arcs[pair[1], mid]
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], s] = (number[a, b], out)
    return Transducer(arcs)


def windowed(opener: str, reach: int, rewrite: dict[str, str], alphabet: str) -> Transducer:
    """Rewrites symbols that follow an opener by at most ``reach`` words."""
    arcs = {}
    for state in range(reach + 1):
        for s in alphabet:
            arcs[state, s] = (reach, s) if s == opener else (max(state - 1, 0), rewrite.get(s, s) if state else s)
    return Transducer(arcs)


def latched(opener: str, rewrite: dict[str, str], alphabet: str) -> Transducer:
    """Rewrites symbols anywhere after an opener."""
    return Transducer({(state, s): (1, s) if s == opener else (state, rewrite.get(s, s) if state else s) for state in (0, 1) for s in alphabet})


def aimed(opener: str, reach: int, closer: str, output: str, alphabet: str) -> Transducer:
    """Writes ``output`` for a closer that stands at most ``reach`` words behind an opener."""
    arcs = {}
    for state in range(reach + 1):
        for s in alphabet:
            hit = s == closer and state
            arcs[state, s] = (reach if s == opener else 0 if hit else max(state - 1, 0), output if hit else s)
    return Transducer(arcs)


def clause_grammar() -> Transducer:
    """Negation, insult, threat and report transducers, composed."""
    negation = windowed("N", 2, {"I": "i", "W": "O", "T": "t"}, SYMBOLS)
    insult = compose(windowed("G", 3, {"I": "J"}, SYMBOLS + "it"), aimed("I", 2, "G", "J", SYMBOLS + "itJ"), SYMBOLS + "it")
    threat = aimed("T", 3, "G", "U", SYMBOLS + "itJ")
    report = latched("R", {"I": "q", "J": "q", "W": "O", "T": "p", "U": "p"}, SYMBOLS + "itJU")
    return compose(compose(compose(negation, insult, SYMBOLS), threat, SYMBOLS), report, SYMBOLS)


def document_grammar() -> Transducer:
    """Matches of a document in order, "|" for a gap: weak ones pass only behind another match."""
    arcs = {}
    for state in (0, 1):
        for s in OUTPUTS:
            arcs[state, s] = (1 if s in "IJTUW" else state, "O" if s == "W" and not state else s)
        arcs[state, "|"] = (0, "|")
    return Transducer(arcs)


@dataclass
class Grammar:
    stems: frozenset[str] = frozenset()
    weak: frozenset[str] = frozenset()
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    lexicon: Lexicon = Lexicon()

    def matcher(self):
        found = ahocorasick.Automaton()
        for s in self.stems | self.weak | self.lexicon.threats:
            found.add_word(s.strip(), len(s.strip()))
        if len(found):
            found.make_automaton()
        x = self.lexicon
        words = [(x.threats, "T"), (x.negations, "N"), (x.reports, "R"), (x.targets, "G")]
        return Matcher(self, found, Lexical(words, [(self.stems, "I"), (self.weak, "W")]), clause_grammar(), document_grammar())


@dataclass
class Matcher:
    grammar: Grammar
    automaton: ahocorasick.Automaton
    lexical: Lexical
    clause: Transducer
    document: Transducer

    def outputs(self, text: str | None) -> Counter:
        """Output symbols of the matched clauses."""
        if not text or not len(self.automaton):
            return Counter()
        low = text.lower()
        hits = [end - n + 1 for end, n in self.automaton.iter(low)]
        hits = [h for h in hits if h == 0 or not low[h - 1].isalpha()]
        if not hits:
            return Counter()
        breaks = [m.start() for m in _BREAK.finditer(low)]
        events: list[str] = []
        done, last = -1, None
        for h in sorted(hits):
            k = bisect.bisect_left(breaks, h)
            if k == done:
                continue
            done = k
            start, end = breaks[k - 1] + 1 if k else 0, breaks[k] if k < len(breaks) else len(low)
            out = [s for s in self.clause.run(map(self.lexical.read, _WORD.findall(low[start:end]))) if s in OUTPUTS]
            if out:
                if last is not None and start - last > SPAN:
                    events.append("|")
                events += out
                last = end
        return Counter(s for s in self.document.run(events) if s in OUTPUTS)

    def score(self, text: str | None) -> float:
        z = self.grammar.bias + sum(self.grammar.weights.get(s, 0.0) * x for s, x in features(self.outputs(text)).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def strength(n: int) -> float:
    """One match counts most; further ones add by their logarithm."""
    return 1 + math.log(n) if n else 0.0


def features(counts: Counter) -> dict[str, float]:
    """Strengths of the outputs; a targeted insult counts as a plain one and has a weight on top."""
    return {s: strength(counts[s] + (counts["J"] if s == "I" else 0)) for s in OUTPUTS}


def _beginnings(word: str):
    """Prefixes of three letters and more; the last one ends in a blank and is the whole word."""
    return ((word + " ")[:n] for n in range(3, len(word) + 2))


def _near_twice(words: list[str], among) -> set[str]:
    """Beginnings that stand twice within SPAN characters."""
    last: dict[str, int] = {}
    found, at = set(), 0
    for w in words:
        for p in _beginnings(w):
            if among is None or p in among:
                if at - last.get(p, -SPAN - 1) <= SPAN:
                    found.add(p)
                last[p] = at
        at += len(w) + 1
    return found


def learn_stems(toxic: list[list[str]], clean: list[list[str]], precision: float = 0.97, level: float = 0.01, twice: bool = False) -> frozenset[str]:
    """Word beginnings that chance does not put into toxic documents (given as lists of words), or
    with ``twice`` does not put there twice within SPAN characters.

    Copies of one toxic document would make any of its rare words look telling, so the support of
    a beginning is the number of its distinct neighbours (word before, word after) if that is less
    than the number of documents.
    """

    def documents(docs, among=None) -> Counter:
        found: Counter = Counter()
        for words in docs:
            found.update(_near_twice(words, among) if twice else {p for w in set(words) for p in _beginnings(w) if among is None or p in among})
        return found

    base = len(toxic) / max(1, len(toxic) + len(clean))
    tox = documents(toxic)
    limit = math.log(max(2, len(tox)) / level)
    few = max(3, limit / -math.log(base))  # even without a clean document fewer would not do
    tox = Counter({p: n for p, n in tox.items() if n >= few})
    cln = documents(clean, tox)

    def telling(k: int, against: int) -> bool:
        if k < 3 or k / (k + against) < precision:
            return False
        share = k / (k + against)
        return (k + against) * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)) >= limit

    found = {s for s in tox if telling(tox[s], cln[s])}
    around: dict[str, set[tuple[str, str]]] = {s: set() for s in found}
    for words in toxic:
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            for p in _beginnings(w):
                if p in found:
                    around[p].add((before, after))
    found = {s for s in found if telling(min(tox[s], len(around[s])), cln[s])}
    short = {s for s in found if not any(s[:n] in found for n in range(3, len(s)))}
    best = {s: s for s in short}
    for t in found:  # of the beginnings of nearly the same documents the cleanest, then the longest
        for p in (t[:n] for n in range(3, len(t))):
            if p in best and tox[t] >= 0.9 * tox[p]:
                best[p] = min(best[p], t, key=lambda x: (cln[x], x[-1] == " ", -len(x)))
    return frozenset(best.values())


def fit_weights(counts: list[Counter], labels: np.ndarray, rounds: int = 400, ridge: float = 0.0005) -> tuple[dict[str, float], float]:
    """Ridge logistic regression of the label on the strengths of the output counts, towards PRIOR."""
    x = np.array([[*features(c).values(), 1.0] for c in counts])
    prior = np.array([*(PRIOR.get(s, 0.0) for s in OUTPUTS), 0.0])
    w = prior.copy()
    penalty = np.diag([ridge] * len(OUTPUTS) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) / len(x) + penalty @ (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(OUTPUTS, w[:-1].tolist())), float(w[-1])


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: Lexicon | None = None) -> Grammar:
    """A grammar from the ``doc_id, text`` of labelled documents (``doc_id, toxic``)."""
    lexicon = lexicon or Lexicon()
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    over = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    window = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), over + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    slim = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").select("doc_id", window.alias("text"))
    texts, y = [], []
    for label in (1, 0):
        picked = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
        rows = slim.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text").toArrow()
        got = sorted(rows["text"].to_pylist())
        texts += got
        y += [label] * len(got)
    if not any(y) or all(y):
        return Grammar(lexicon=lexicon)
    pool: dict[str, str] = {}  # one object for each word, whose occurrences are many
    lists = [[pool.setdefault(w, w) for w in _WORD.findall(t.lower())] for t in texts]
    toxic, clean = ([s for s, v in zip(lists, y) if v == label] for label in (1, 0))
    strong = learn_stems(toxic, clean)
    left = [words for words in toxic if not any(p in strong for w in set(words) for p in _beginnings(w))]
    often = learn_stems(toxic, clean, precision=0.9, twice=True) if left else frozenset()
    needed = Counter(p for words in left for p in _near_twice(words, often))
    often = frozenset(p for p in often if needed[p] >= 3)
    # A weak stem takes the place of strong ones that are parts of it.
    weak = frozenset(w for w in often if not any(w.startswith(s) for s in strong))
    stems = frozenset(s for s in strong if not any(s.startswith(w) for w in weak))
    del lists, pool, toxic, clean
    matcher = Grammar(stems, weak, lexicon=lexicon).matcher()
    weights, bias = fit_weights([matcher.outputs(t) for t in texts], np.array(y, dtype=float))
    return Grammar(stems, weak, weights, bias, lexicon)


def score(documents: DataFrame, grammar: Grammar, name: str = "score") -> DataFrame:
    """``documents`` with a score (0 to 1) in the column ``name``."""
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(grammar)

    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = shared.value.matcher()
        for texts in parts:
            yield texts.map(matcher.score).astype("float64")

    return documents.withColumn(name, F.pandas_udf(toxic, "double")(F.col("text").cast("string")))


def held_out(fold: int = 0, of: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    grammar = learn(docs, labels.where(~held_out()))
    rows = score(docs.select("doc_id", "text"), grammar)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
