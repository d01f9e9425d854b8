"""Toxicity: a weighted finite-state pattern grammar over clauses.

Method: words become symbols (insult, harm, intent, target, negation, report, other). Small transducers (reported speech, negation, target,
intent, threat), each of which rewrites the insults and harms in its scope, are composed into one machine whose states are tuples of theirs.
Its arcs have weights: one that ends a match has its pattern's factor, all others none. A clause's symbols run through it once; the weight of a match is
its arc's times its word's, and a clause counts for each pattern by its strongest match. A document's evidence is the sum over its
clauses; score = 1 - 2^(-evidence / threshold).

Learned from labelled rows: word and word-stem weights (log odds of the share of toxic and of clean documents that
have them), pattern factors, and the threshold. Learning uses at most ``train_rows`` labelled rows that aren't held
out, those with the lowest hash of doc_id; this bound is the only sample, scoring reads every whole text.
Held out: crc32 of the doc_id as text, modulo 5, is 0. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts score 0; a null doc_id is scored, not held out and never learned from; without labelled rows the
seed lexicon and default factors are used; repeated rows are scored each and learned from once (the smallest text of a doc_id, toxic if any label says so); a label of
null is no label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import WORD_RE, bounded_batches, cut, fresh

#: Small word classes of the grammar, in the four languages of the corpus.
SEEDS = ("idiot", "moron", "stupid", "scum", "pathetic", "worthless", "loser", "imbécile", "dummkopf", "estúpido")
HARM = ("kill", "hurt", "beat", "destroy", "burn", "strangle", "tuer", "frapper", "töten", "schlagen", "matar", "golpear")
INTENT = ("will", "gonna", "shall", "going", "vais", "va", "werde", "wird", "voy", "vamos")
TARGETS = ("you", "your", "he", "she", "they", "them", "him", "her", "tu", "vous", "toi", "du", "dich", "ihr", "usted", "ti", "vosotros")
NEGATIONS = ("not", "never", "no", "isn", "aren", "wasn", "nicht", "kein", "keine", "pas", "jamais", "nunca", "ni")
REPORTS = ("said", "says", "called", "quoted", "wrote", "claimed", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió")

STEMS = (4, 5, 6)
PATTERNS = ("plain", "targeted", "negated", "reported", "threat")
#: Factors of the patterns before anything is learned.
PRIOR = {"plain": 1.0, "targeted": 1.2, "negated": 0.3, "reported": 0.4, "threat": 1.2}
SEED_WEIGHT, HARM_WEIGHT, TOP_WEIGHT = 3.0, 3.0, 6.0

_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(WORD_RE)
_LOWER = {i: i + 32 for i in range(65, 91)}
_CLASSES = {w: s for s, words in (("H", HARM), ("W", INTENT), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (next state, output); a symbol without an arc decays the state by one and passes."""

    arcs: dict[tuple[int, str], tuple[int, str]]
    decays: bool = True

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (state - 1 if self.decays and state else state, symbol)


def _scope(opens: str, marked: dict[str, str], reach: int, decays: bool = True) -> Transducer:
    """Rewrites ``marked`` symbols that come within ``reach`` symbols after ``opens``."""
    arcs = {(s, opens): (reach, opens) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, a): (s - 1 if decays else s, b) for a, b in marked.items()}
    return Transducer(arcs, decays)


#: i: an insult in someone's words, n: denied, t: aimed at someone. h: a harm that is meant, x: one with a target.
CASCADE = (
    _scope("R", {"I": "i", "H": "o"}, 1, decays=False),
    _scope("N", {"I": "n", "H": "o"}, 3),
    _scope("T", {"I": "t"}, 4),
    _scope("W", {"H": "h"}, 3),
    Transducer({(s, "h"): (3, "h") for s in range(4)} | {(s, "T"): (0, "x") for s in range(1, 4)}),
)
SYMBOLS = "IHWTNR-"
_PATTERN_OF = {"I": "plain", "t": "targeted", "n": "negated", "i": "reported", "x": "threat"}


def compose(cascade: tuple[Transducer, ...]) -> list[dict[str, tuple[int, str]]]:
    """One machine for all of ``cascade``, each reading what the one before it writes: for each state that can be reached from the start, 0, its arcs."""
    start = (0,) * len(cascade)
    number, order, out = {start: 0}, [start], []
    for state in order:  # grows as states are found
        arcs = {}
        for symbol in SYMBOLS:
            after, s = [], symbol
            for q, machine in zip(state, cascade):
                q, s = machine.step(q, s)
                after.append(q)
            if (to := tuple(after)) not in number:
                number[to] = len(order)
                order.append(to)
            arcs[symbol] = number[to], s
        out.append(arcs)
    return out


MACHINE = compose(CASCADE)


@dataclass
class Grammar:
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, SEED_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    threshold: float = 2.0

    def __post_init__(self) -> None:
        self.weigh(self.factors)

    def weigh(self, factors: dict[str, float]) -> None:
        """Put the patterns' factors on the arcs that end their matches."""
        self.factors = factors
        self.arcs = [{s: (to, (p := _PATTERN_OF.get(o)), factors[p] if p else 0.0) for s, (to, o) in arcs.items()} for arcs in MACHINE]

    def weight(self, word: str) -> float:
        w = self.weights.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                w = max(w, self.stems.get(word[:n], 0.0))
        return w

    def evidence(self, text: str | None) -> dict[str, float]:
        """Sum of the weights of a text's clauses, by pattern."""
        out = dict.fromkeys(PATTERNS, 0.0)
        if not text:
            return out
        lowered = text.translate(_LOWER) if not text.isascii() else text.lower()
        known: dict[str, float] = {}
        harm = False
        for w in set(_WORD.findall(lowered)):
            if x := self.weight(w):
                known[w] = x
            elif _CLASSES.get(w) == "H":
                harm = True
        if not known and not harm:
            return out
        for clause in _CLAUSE.split(lowered):
            words = _WORD.findall(clause)
            symbols = ["I" if w in known else _CLASSES.get(w, "-") for w in words]
            if "I" not in symbols and "H" not in symbols:
                continue
            state, best = 0, {}
            for s, w in zip(symbols, words):
                state, p, factor = self.arcs[state][s]
                if p:
                    best[p] = max(best.get(p, 0.0), factor * known.get(w, HARM_WEIGHT))
            for p, x in best.items():
                out[p] += x
        return out

    def score(self, text: str | None) -> float:
        return self._score(self.evidence(text))

    def _score(self, evidence: dict[str, float]) -> float:
        return 1.0 - 2.0 ** (-sum(evidence.values()) / self.threshold)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from, ``train_rows`` at most however often an id is repeated."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("of"))
        .agg((F.max("toxic") > 0).alias("toxic"))
        .orderBy(F.xxhash64("of"), "of")
        .limit(train_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("of"))
    return found.groupBy("of").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each word (kind 0) and each stem (kind 1), counted before the shuffle."""
    seen: Counter = Counter()
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = set(_WORD.findall((text or "").translate(_LOWER)))
            seen.update((0, w, toxic) for w in words)
            seen.update((1, s, toxic) for s in {w[:n] for w in words for n in STEMS if len(w) > n})
    keys = list(seen)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        n = [seen[k] for k in part]
        yield pa.record_batch({"kind": pa.array([k[0] for k in part], pa.int32()), "f": [k[1] for k in part], "pos": pa.array([x if k[2] else 0 for k, x in zip(part, n)], pa.int64()), "neg": pa.array([0 if k[2] else x for k, x in zip(part, n)], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, lexicon: int = 5_000, least: int = 5, odds: float = 4.0) -> Grammar:
    """Learn a grammar from at most ``train_rows`` labelled rows; its lexicon has at most ``lexicon`` entries.

    A word or stem enters with ``least`` toxic documents and log odds of ``odds`` or more. The default bound is the one of 3, 3.5, 4, 4.5 and 5
    with the fewest errors on folds of the training rows that were left out of the fit; rows held out had no part in it."""
    bounded_batches(docs.sparkSession)
    g = Grammar()
    train = cut(_training(docs, labels, train_rows), "toxic-rows")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        return g
    counts = train.mapInArrow(_features, "kind int, f string, pos long, neg long").groupBy("kind", "f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    log_odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    top = counts.where(F.col("pos") >= least).withColumn("w", log_odds).where(F.col("w") >= odds).orderBy(F.desc("w"), "kind", "f").limit(lexicon).collect()
    learned = [(r["kind"], r["f"], min(TOP_WEIGHT, r["w"])) for r in top]
    g.weights |= {f: w for k, f, w in learned if k == 0}
    g.stems = {f: w for k, f, w in learned if k == 1}
    bare = Grammar(g.weights, g.stems, dict.fromkeys(PATTERNS, 1.0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bare.evidence(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch({"toxic": b.column(1)} | {p: pa.array([e[p] for e in found], pa.float64()) for p in PATTERNS})

    rows = train.mapInArrow(look, "toxic boolean, " + ", ".join(f"{p} double" for p in PATTERNS)).collect()  # train_rows at most

    def gain(p: str) -> tuple[int, float]:
        pos = sum(r["toxic"] and r[p] > 0 for r in rows)
        neg = sum(not r["toxic"] and r[p] > 0 for r in rows)
        return pos + neg, math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1)) if pos + neg else 0.0

    _, plain = gain("plain")
    factors = dict(PRIOR)
    for p in PATTERNS[1:]:
        n, x = gain(p)
        if n >= 20 and plain > 0:
            factors[p] = min(1.5, max(0.1, x / plain))
    g.weigh(factors)
    points = sorted((sum(factors[p] * r[p] for p in PATTERNS), r["toxic"]) for r in rows)
    wrong = n_neg  # below the first point all rows count as toxic
    best = (wrong + 1, 0.0, 0.0)
    for i, (x, toxic) in enumerate(points):
        wrong += 1 if toxic else -1
        after = points[i + 1][0] if i + 1 < len(points) else x + 2
        if after > x and wrong < best[0]:
            best = (wrong, x, after)
    g.threshold = max(0.25, (best[1] + best[2]) / 2)
    return g


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from score 0.5 on) and matches, the evidence by pattern; these replace same-named columns."""
    names = ["score", "predicted", "matches"]

    def run(column: pa.Array) -> pa.Array:
        found = [grammar.evidence(t) for t in column.to_pylist()]
        scores = [grammar._score(e) for e in found]
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([[(p, x) for p, x in e.items() if x] for e in found], pa.map_(pa.string(), pa.float64()))],
            names,
        )

    bounded_batches(docs.sparkSession)
    (c,) = fresh(docs, "v")
    v = F.arrow_udf(run, "score double, predicted int, matches map<string,double>")(F.col(text))
    return docs.withColumn(c, v).withColumns({n: F.col(c)[n] for n in names}).drop(c)
