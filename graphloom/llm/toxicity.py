"""Toxicity by a weighted finite-state pattern grammar.

Insults and their weights are learned from labelled documents: a word's
evidence is the number of different contexts (neighbouring words) in which it
stands in toxic and in other documents, so copies of a text count once. A word
enters the lexicon when the odds that it is an insult, from a small prior odds
and how far its contexts are toxic beyond the base rate, exceed one.

Five transducers, each a table of transitions (state, symbol) -> (state,
symbol), are composed into one machine: INSULT keeps a word of the lexicon
apart from others, THREAT makes a verb of harm a threat where an intent came
before it, NEGATION turns symbols in its scope into negated ones, REPORTED
those after a verb of saying into reported ones, TARGET raises an insult or
threat that meets a second person or a named group in its clause. The machine
reads a clause's word classes; what it emits, weighted by the lexicon, is
counted per document. A logistic model, fitted to a bounded sample of labelled
documents with a pull towards the grammar's own weights, turns the counts into
a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import staged, table

#: Word lists of the grammar: fixed values, in English, German, French and Spanish.
NEGATIONS = frozenset("not never no isn't aren't nicht kein keine nie niemals pas jamais ni nunca jamás".split())
REPORTS = frozenset("said says claimed claims called calls quoted wrote sagte sagt nannte dit disait appelé dijo dice llamó".split())
INTENTS = frozenset("will shall gonna going want wanna should i'll we'll werde werden will wollen sollte vais vas va allons voy vas vamos quiero".split())
PERSONS = frozenset("you your you're yourself du dich dir dein deine ihr euch tu toi te vous ton ta votre tú ti usted ustedes tu".split())
GROUPS = frozenset("they them people women men immigrants foreigners sie leute frauen ausländer ils elles gens femmes étrangers ellos ellas gente mujeres extranjeros".split())
THREATS = frozenset("kill hurt destroy burn stab shoot beat murder töten umbringen schlagen tuer frapper matar golpear".split())
#: Words for which a negation, and an intent, holds.
SCOPE, INTENT_SCOPE = 3, 4

#: Word classes: Insult, verb of Harm, Negation, verb of saying (R), inteNt to act (W), second Person, Group, and other (O).
CLASSES = "IHNRWPGO"
#: What the whole machine emits, with the feature it counts for: insults plain, negated, reported or at a target; threats the same.
EMITS = {"I": "plain", "I-": "negated", "Ir": "reported", "It": "targeted", "H+": "threat", "H-": "negated", "Hr": "reported", "Ht": "aimed", "+I": "targeted", "+H": "aimed"}
FEATURES = ("plain", "negated", "reported", "targeted", "threat", "aimed")
#: The grammar's own weights, towards which the fit is pulled: bias, then FEATURES.
PRIOR = np.array([-3.0, 4.0, 1.5, 2.0, 5.0, 1.0, 4.0])
_WORDS = re.compile(r"[\w']+")
_CLAUSE = re.compile(r"[.!?;:\n]+")

#: A transducer: state -> symbol -> (state, symbol). What is not listed keeps the state and passes through. State 0 is the start.
Transducer = dict[int, dict[str, tuple[int, str]]]


def _insult() -> Transducer:
    """One state: the lexicon decides (see ``classes``), the symbol passes."""
    return {0: {}}


def _threat() -> Transducer:
    """States: words left in the scope of an intent. A verb of harm within it is a threat, else an ordinary word."""
    table: Transducer = {}
    for left in range(INTENT_SCOPE + 1):
        nxt = max(0, left - 1)
        table[left] = {c: (nxt, c) for c in CLASSES} | {"W": (INTENT_SCOPE, "O"), "H": (nxt, "H+" if left else "O")}
    return table


def _negation() -> Transducer:
    """States: words left in the scope of a negation."""
    table: Transducer = {}
    for left in range(SCOPE + 1):
        nxt = max(0, left - 1)
        table[left] = {c: (nxt, c) for c in (*CLASSES, "H+")} | {"N": (SCOPE, "O")}
        if left:
            table[left] |= {"I": (nxt, "I-"), "H+": (nxt, "H-")}
    return table


def _reported() -> Transducer:
    """States: whether a verb of saying came before."""
    return {0: {"R": (1, "O")}, 1: {"R": (1, "O"), "I": (1, "Ir"), "H+": (1, "Hr"), "I-": (1, "Ir"), "H-": (1, "Hr")}}


def _target() -> Transducer:
    """States: 0 nobody, 1 a target named; 2 an insult, 3 a threat that waits for its target, which then emits its raise (+I, +H)."""
    named = {"I": (1, "It"), "H+": (1, "Ht"), "P": (1, "O"), "G": (1, "O")}
    waits = lambda raised: {"I": (2, "I"), "H+": (3, "H+"), "P": (1, raised), "G": (1, raised)}
    return {0: waits("O"), 1: named, 2: waits("+I"), 3: waits("+H") | {"I": (3, "I")}}


CASCADE = (_insult(), _threat(), _negation(), _reported(), _target())


def compose(cascade: tuple[Transducer, ...] = CASCADE) -> tuple[list[list[int]], list[list[str]]]:
    """One machine over CLASSES that reads as the cascade does: next state and output by state and class; states are those reachable from the start."""
    start = (0,) * len(cascade)
    numbers, todo = {start: 0}, [start]
    follow, emit = [], []
    while todo:
        state = todo.pop(0)
        nexts, outs = [], []
        for symbol in CLASSES:
            new = []
            for t, s in zip(cascade, state, strict=True):
                s, symbol = t[s].get(symbol, (s, symbol))
                new.append(s)
            key = tuple(new)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            nexts.append(numbers[key])
            outs.append(symbol)
        follow.append(nexts)
        emit.append(outs)
    return follow, emit


_FOLLOW, _EMIT = compose()
#: The feature that an output counts for, or -1.
_COUNTS = [[FEATURES.index(EMITS[x]) if x in EMITS else -1 for x in row] for row in _EMIT]
_CLASS_OF = {w: CLASSES.index(c) for c, words in (("G", GROUPS), ("W", INTENTS), ("R", REPORTS), ("P", PERSONS), ("N", NEGATIONS), ("H", THREATS)) for w in words}
_INSULT, _OTHER = CLASSES.index("I"), CLASSES.index("O")


@dataclass
class Grammar:
    """The composed machine, the lexicon and the weights of what it emits."""

    lexicon: dict[str, float]
    base: float = -3.0
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def clause(self, words: list[str]) -> np.ndarray:
        """What the machine emits for one clause, counted by FEATURES; a raise has the weight of the last insult or threat."""
        out, state, last = np.zeros(len(FEATURES)), 0, 1.0
        for word in words:
            weight = self.lexicon.get(word)
            c = _INSULT if weight is not None else _CLASS_OF.get(word, _OTHER)
            if weight is not None:
                last = weight
            if (f := _COUNTS[state][c]) >= 0:
                out[f] += last if f != 4 and f != 5 else 1.0
            state = _FOLLOW[state][c]
        return out

    def features(self, text: str | None) -> np.ndarray | None:
        """Sums over matched clauses; None where no word of the lexicon or verb of harm stands in the text."""
        low = (text or "").lower()
        words = _WORDS.findall(low)
        if self.lexicon.keys().isdisjoint(words) and THREATS.isdisjoint(words):
            return None
        out = np.zeros(len(FEATURES))
        for part in _CLAUSE.split(low):
            w = _WORDS.findall(part)
            if not self.lexicon.keys().isdisjoint(w) or not THREATS.isdisjoint(w):
                out += self.clause(w)
        return out if out.any() else None

    def score(self, f: np.ndarray | None) -> float:
        z = self.base if f is None else float(self.weights[0] + self.weights[1:] @ f)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text, mod 3, is 1. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000) -> DataFrame:
    """doc_id, text and toxic of labelled documents that may be learned from: of ``max_labelled`` labels at most, chosen by a hash of doc_id.

    The labels so bounded are broadcast, so no text is shuffled; the rows are
    staged for the passes that learn from them.
    """
    known = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id"), F.col("text")).filter("text is not null").join(F.broadcast(known), "doc_id")
    return staged(rows.select("doc_id", "text", "toxic"), "toxicity-labelled")


def learn_lexicon(train: DataFrame, prior_odds: float = 1e-4) -> dict[str, float]:
    """word -> weight (0 to 1) of the learned insults.

    A first pass counts documents per word and leaves words that are toxic
    more often than not; a second counts the contexts of those alone, and the
    odds decide. What the driver holds is bounded by the labelled rows
    (``training_rows``): words that stand in three of them at least.
    """
    n, toxic = train.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return {}
    rate = toxic / n
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}_']+"), F.lit(0)))
    counted = train.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    likely = counted.filter("t >= 3 and t >= 0.5 * n")
    candidates = train.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in likely.select("word").collect()))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = candidates.value
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                w = ["", *_WORDS.findall(text.as_py().lower()), ""]
                if not some.isdisjoint(w):
                    rows += [(x, f"{w[i]} {w[i + 2]}", toxic) for i, x in enumerate(w[1:-1]) if x in some]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, [pa.string(), pa.string(), pa.int32()], strict=True)], names=["word", "context", "toxic"])

    seen = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(contexts, "word string, context string, toxic int")
    each = seen.groupBy("word", "context").agg(F.max("toxic").alias("toxic"))
    lexicon = {}
    for r in each.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        t, other = r["t"], r["n"] - r["t"]
        # an insult's contexts are toxic 98 times in 100, another word's at the base rate
        odds = math.log(prior_odds) + t * math.log(0.98 / rate) + other * math.log(0.02 / (1 - rate))
        if odds > 0:
            lexicon[r["word"]] = min(1.0, odds / 10)
    return lexicon


def fit(train: DataFrame, lexicon: dict[str, float], max_rows: int = 20_000, ridge: float = 2.0) -> Grammar:
    """The grammar with weights fitted to at most ``max_rows`` labelled rows that match it (by a hash of doc_id)."""
    grammar = Grammar(lexicon)
    shared = train.sparkSession.sparkContext.broadcast(grammar)
    schema = pa.schema([("toxic", pa.int32()), ("doc_id", pa.int64()), *[(f, pa.float64()) for f in FEATURES], ("matched", pa.int32())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            fs = [grammar.features(t.as_py()) for t in batch.column("text")]
            values = np.array([np.zeros(len(FEATURES)) if f is None else f for f in fs]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("doc_id"), *[pa.array(values[:, i]) for i in range(len(FEATURES))], pa.array([int(f is not None) for f in fs], pa.int32())], schema=schema)

    rows = train.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(of, ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long' if f.type == pa.int64() else 'int'}" for f in schema))
    n, toxic = rows.filter("matched = 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = (toxic + 0.5) / (n + 10)
    grammar.base = math.log(share / (1 - share))
    got = rows.filter("matched = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).drop("matched", "doc_id").toPandas()
    x, y = np.column_stack([np.ones(len(got)), got[list(FEATURES)].to_numpy()]), got["toxic"].to_numpy()
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    grammar.weights = w
    return grammar


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row: only the text is looked at; null text counts as empty; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            s = [grammar.score(grammar.features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from ``labels`` (doc_id, toxic) and scores every row: doc_id, held_out, score, predicted.

    Without usable labels nothing but threats is known and scores stay low; a
    document labelled twice is toxic if one label says so; equal rows get equal
    scores; an empty table gives no rows.
    """
    train = training_rows(docs, labels)
    grammar = fit(train, learn_lexicon(train))
    return score(docs, grammar).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
