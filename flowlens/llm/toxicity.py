"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns the words of a clause into symbols: insults, threats, targets,
negations, verbs of reported speech, commas.  Small transducers for negation,
reported speech and target each rewrite the symbols they read; their composition
is one machine that labels every insult or threat of a clause, as in "targeted"
or "negated and reported".  Weights of the labels come from labelled documents,
starting from prior weights; a document's score is the logistic of the weighted
label counts of its matched clauses.

Insults are learned: words and stems (word beginnings) that occur in many
different contexts of toxic documents and hardly elsewhere.  Contexts, not
documents, are counted, so that copies of one text teach nothing by their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread
from .lm import fold

#: Labelled training rows that the grammar is fitted on, at most (by a hash of the id).
SAMPLE_ROWS = 20_000
#: Contexts that a learned insult needs, its share of toxic ones, lengths of stems, entries at most.
MIN_CONTEXTS, MIN_SHARE, STEMS, LEXICON = 5, 0.97, (4, 5, 6, 7, 8), 5000

#: Closed-class words of the grammar, by symbol.
WORDS = {
    "Y": "you your yours yourself u du dich dir euch ihr dein deine sie vous toi tu te ton ta votre tú ti usted ustedes vosotros tus",
    "N": "not never no isn't aren't wasn't don't nicht nie kein keine niemals ne jamais aucun nunca jamás ningún",
    "R": "said says wrote called calling quoted claimed alleged reported sagte schrieb behauptete nannte dit disait écrit appelé dijo decía escribió llamó",
    "T": "kill hurt destroy murder beat burn shoot töten umbringen zerstören schlagen tuer détruire frapper matar destruir golpear",
    "I": "idiot moron stupid scum dumm idiot trottel dummkopf imbécile connard crétin idiota imbécil estúpido",
}
#: Prior weights of the labels, before any document is seen.
PRIOR = {"I": 3.0, "I+": 4.0, "I-": 1.0, "I-+": 1.5, "Ir": 1.5, "Ir+": 2.0, "I-r": 0.5, "I-r+": 0.5, "T": 0.5, "T+": 2.5, "T-": 0.0, "T-+": 0.2, "Tr": 0.2, "Tr+": 0.5, "T-r": 0.0, "T-r+": 0.0}
LABELS = tuple(PRIOR)
#: How strongly weights are held at their priors; the intercept's prior.
HOLD, BASE = 0.5, -3.0

_TOKEN = re.compile(r"[\w'’]+|,")
_ENDS = ".!?;\n"


# --- transducers ----------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) to (state, symbol); what it doesn't name passes in the default state."""

    start: int
    moves: dict[tuple[int, str], tuple[int, str]]
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (self.default.get(state, state), symbol))


def negation(window: int = 3) -> Transducer:
    """Marks insults and threats within ``window`` words after a negation; a comma ends it."""
    moves: dict = {}
    for s in range(window + 1):
        moves[s, "N"] = (window, "O")
        moves[s, ","] = (0, ",")
        if s:
            moves |= {(s, x): (s - 1, x + "-") for x in "IT"}
    return Transducer(0, moves, {s: max(0, s - 1) for s in range(window + 1)})


def reported() -> Transducer:
    """Marks what follows a verb of saying in the clause."""
    moves: dict = {(s, "R"): (1, "O") for s in (0, 1)}
    moves |= {(1, x): (1, x + "r") for x in ("I", "T", "I-", "T-")}
    return Transducer(0, moves)


def target() -> Transducer:
    """Marks insults and threats of a clause that names a target (start state 1)."""
    return Transducer(0, {(1, x): (1, x + "+") for x in ("I", "T", "I-", "T-", "Ir", "Tr", "I-r", "T-r")})


def compose(parts: list[Transducer], symbols: str = "ITYNRO,") -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]]:
    """The machine that feeds each transducer's output to the next, over reachable states."""
    table: dict = {}
    todo = [tuple(p.start for p in parts[:-1]) + (s,) for s in (0, 1)]
    while todo:
        state = todo.pop()
        for symbol in symbols:
            if (state, symbol) in table:
                continue
            after, out = [], symbol
            for p, s in zip(parts, state, strict=True):
                s, out = p.step(s, out)
                after.append(s)
            table[state, symbol] = (tuple(after), out)
            todo.append(tuple(after))
    return table


MACHINE = compose([negation(), reported(), target()])


# --- lexicon --------------------------------------------------------------


@dataclass
class Grammar:
    """Insult words and stems, the trie that finds them, and label weights."""

    insults: frozenset[str]
    stems: frozenset[str]
    weights: dict[str, float]
    base: float

    def __post_init__(self):
        self.symbol = {w: s for s, ws in WORDS.items() for w in ws.split()} | dict.fromkeys(self.insults, "I")
        self.finder = None

    def __getstate__(self):
        return self.__dict__ | {"finder": None}

    def symbol_of(self, word: str) -> str:
        found = self.symbol.get(word)
        if found is None:
            found = "I" if any(word[:n] in self.stems for n in STEMS if len(word) > n) else "O"
        return found

    def clauses(self, low: str) -> list[str]:
        """The clauses that hold an insult or a threat."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for w in [*self.stems, *(w for w, s in self.symbol.items() if s in "IT")]:
                self.finder.add_word(w, len(w))
            self.finder.make_automaton()
        out, upto = [], -1
        for last, length in self.finder.iter(low):
            first = last - length + 1
            if first <= upto or (first and (low[first - 1].isalnum() or low[first - 1] == "_")):
                continue
            begin = max(low.rfind(c, upto + 1, first) for c in _ENDS) + 1
            begin = max(begin, upto + 1)
            stop = min((e for e in (low.find(c, last) for c in _ENDS) if e >= 0), default=len(low))
            out.append(low[begin:stop])
            upto = stop
        return out

    def labels(self, text: str) -> Counter:
        """Counts of the labels that the machine puts out over the text's matched clauses."""
        found: Counter = Counter()
        for clause in self.clauses(text.lower()):
            symbols = ["," if w == "," else self.symbol_of(w) for w in _TOKEN.findall(clause)]
            state = (0, 0, int("Y" in symbols))
            for s in symbols:
                state, out = MACHINE[state, s]
                if out[0] in "IT":
                    found[out] += 1
        return found

    def score(self, text: str) -> float:
        found = self.labels(text)
        z = self.base + sum(self.weights[k] * math.log2(1 + n) for k, n in found.items())
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


# --- learning -------------------------------------------------------------


def _features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each word and stem, toxic and other."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            own = {f for w in set(_TOKEN.findall(text.lower())) for f in _features(w)}
            for f in own:
                counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) > 1_000_000:
                yield _counted(counts)
                counts = {}
    yield _counted(counts)


def _counted(counts: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"feature": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}).astype({"feature": "object", "clean": "int64", "toxic": "int64"})


def _contexts(wanted: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                before = ""
                for w in _TOKEN.findall(text.lower()):
                    for f in _features(w):
                        if f in wanted:
                            rows.add((f, int(toxic), before))
                    before = w
            yield pd.DataFrame(sorted(rows), columns=["feature", "toxic", "before"]).astype({"toxic": "int64"})

    return run


def _label_counts(grammar: Grammar):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([[math.log2(1 + c[k]) for k in LABELS] for c in map(grammar.labels, batch["text"])], columns=list(LABELS), dtype=float)
            out.columns = [f"f{i}" for i in range(len(LABELS))]
            out["toxic"] = batch["toxic"].to_numpy()
            yield out

    return run


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, limit: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most ``limit`` labelled documents outside the held fold.

    Where an id repeats, the least of its texts stands for it, and it is toxic if
    any of its labels is.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Grammar:
    """Lexicon and label weights from labelled rows outside the held fold.

    Of the words and stems that the sample makes candidates, the ``LEXICON`` most
    frequent in toxic texts are looked at in their contexts.  Without labels, or with labels of one kind, the built-in words and prior
    weights stand.
    """
    sample = materialize(training_sample(docs, labels, folds, held), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    grammar = Grammar(frozenset(), frozenset(), dict(PRIOR), BASE)
    if len(sizes) < 2:
        return grammar
    schema = "feature string, clean long, toxic long"
    seen = sample.mapInPandas(_candidates, schema).groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    even = F.col("toxic") / sizes[1] / (F.col("toxic") / sizes[1] + F.col("clean") / sizes[0])
    likely = seen.where((F.col("toxic") >= MIN_CONTEXTS) & (even >= MIN_SHARE)).orderBy(F.desc("toxic"), "feature").limit(LEXICON)
    wanted = frozenset(r["feature"] for r in likely.collect())
    used = (
        sample.mapInPandas(_contexts(wanted), "feature string, toxic long, before string")
        .distinct().groupBy("feature")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where((F.col("t") >= MIN_CONTEXTS) & (F.col("t") >= MIN_SHARE * (F.col("t") + F.col("c"))))
    )
    learned = [r["feature"] for r in used.collect()]
    stems = frozenset(f[:-1] for f in learned if f.endswith("*"))
    insults = frozenset(f for f in learned if not f.endswith("*") and len(f) > 1)
    grammar = Grammar(insults, stems, dict(PRIOR), BASE)
    schema = ", ".join(f"f{i} double" for i in range(len(LABELS))) + ", toxic int"
    data = sample.mapInPandas(_label_counts(grammar), schema).toPandas()
    weights, base = fit(data.drop(columns="toxic").to_numpy(), data["toxic"].to_numpy(float))
    return Grammar(insults, stems, dict(zip(LABELS, weights.tolist(), strict=True)), base)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, held at the prior weights."""
    prior = np.array([*PRIOR.values(), BASE])
    x = np.column_stack([x, np.ones(len(x))])
    w = prior.copy()
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + HOLD * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


# --- scoring --------------------------------------------------------------


def toxic_score(grammar: Grammar) -> Callable[[Column], Column]:
    """A column function: score of a text, null texts as empty ones."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t or "") for t in texts], dtype=float)

    return score


def score_documents(docs: DataFrame, grammar: Grammar, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null texts count as empty and get the score of a text without a matched
    clause.  Repeated rows are scored one by one.  An empty table gives an
    empty result.  Columns other than doc_id and text are ignored.
    """
    scored = spread(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        toxic_score(grammar)(F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are.

    Null texts count as empty and stay; repeated rows are judged alike and all
    kept or all dropped; an empty table gives an empty result.
    """
    return docs.where(toxic_score(grammar)(F.col("text")) < 0.5)
