"""Toxicity by a weighted grammar of finite-state transducers over clauses.

The lexical transducer reads a word and writes its class and weight: insult, threat, target, negation, reported speech, or
none. Its arcs are whole words and word stems; the weights of insult arcs are log odds learned from labelled
rows (stems catch inflected and compounded forms that were never seen whole), beside a few fixed words. Over the classes of a clause run
three context transducers: negation (within NEGATED words before), reported speech (from the reporting word
to the clause's end) and target (within TARGETED words on either side). They are composed with the insult and threat transducers, which
write the weight of each match under the context it stands in. A document's features are, for each context, the
greatest clause weight and the (log) sum over clauses; a logistic regression on labelled rows weighs them.

Words alone don't score: the same insult counts less when negated or reported, more when aimed at somebody.

Defined results: null and empty texts have no clauses and get the score of a text without matches; whole texts are
read; labels that are null are left out, and of several labels of a doc_id the largest counts; without labels the
fixed weights hold. Rows with null doc_id are scored like any other and are not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import cut, table, unused

#: Labelled rows that the fit uses, about; drawn by a hash of doc_id where there are more.
FIT_ROWS = 20_000
#: Lengths of the stems that are tried.
STEMS = (4, 5, 6)
#: Documents with label 1 that have a term at least; false discoveries among the learned terms at most; terms kept at most.
LEAST, FALSE, MOST = 3, 0.05, 5_000
NEGATED, TARGETED = 3, 5

NONE, END, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)

#: Fixed words of each class.
WORDS = {
    TARGET: "you your yours yourself u ur he she they them him her du dich dir ihr euch sie tu te toi vous ti usted ustedes vosotros",
    NEGATION: "not never no neither nor cannot isn aren wasn don doesn didn nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ni",
    REPORT: "said says say wrote writes called calls claimed quoted quotes reported according sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
    THREAT: "kill murder hurt stab shoot strangle töten umbringen verletzen tuer frapper matar golpear",
    INSULT: "idiot moron imbecile scum loser stupid worthless pathetic bastard dumb trottel dummkopf connard crétin imbécile estúpido cabrón",
}
#: Weight of a fixed word.
FIXED = 3.0
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_LEVELS = 40
_STEP = 0.2


class Transducer:
    """A start state and a step (state, symbol) -> (state, symbol); composed ones run one on what the other writes."""

    def __init__(self, start, step):
        self.start, self.step = start, step
        self.known: dict = {}

    def __matmul__(self, after: Transducer) -> Transducer:
        def step(state, symbol):
            one, written = self.step(state[0], symbol)
            two, written = after.step(state[1], written)
            return (one, two), written

        return Transducer((self.start, after.start), step)

    def run(self, symbols) -> list:
        state, out, known = self.start, [], self.known
        for symbol in symbols:
            if (found := known.get((state, symbol))) is None:
                found = known[state, symbol] = self.step(state, symbol)
            state, written = found
            out.append(written)
        return out


def _window(kind: int, flag: str, length: int) -> Transducer:
    """Marks the symbols up to length after one of a kind. Symbols are (kind, weight, flags)."""
    return Transducer(0, lambda left, x: (length if x[0] == kind else max(0, left - 1), (x[0], x[1], x[2] | {flag}) if left else x))


def _sticky(kind: int, flag: str) -> Transducer:
    return Transducer(False, lambda on, x: (on or x[0] == kind, (x[0], x[1], x[2] | {flag}) if on else x))


def _weigh(kind: int, contexts: dict[str, int], plain: int) -> Transducer:
    """Writes (feature, weight) for each symbol of a kind, by the first context that holds; other symbols pass."""

    def step(state, x):
        if x[0] != kind:
            return state, x
        return state, ("match", next((k for flag, k in contexts.items() if flag in x[2]), plain), x[1])

    return Transducer(None, step)


FEATURES = ("insult", "targeted insult", "negated insult", "reported insult", "threat", "targeted threat", "mitigated threat")
#: Weights before any label is seen, of the greatest clause and of the log sum; the fit is drawn to them.
PRIOR = np.array([1.0, 1.3, 0.5, 0.5, 0.5, 1.2, 0.2] + [0.3, 0.4, 0.1, 0.1, 0.1, 0.3, 0.1])
BIAS = -4.0

_BACKWARD = _window(TARGET, "target", TARGETED)
GRAMMAR = (
    _window(NEGATION, "negated", NEGATED) @ _sticky(REPORT, "reported") @ _window(TARGET, "target", TARGETED)
    @ _weigh(INSULT, {"negated": 2, "reported": 3, "target": 1}, 0) @ _weigh(THREAT, {"negated": 6, "reported": 6, "target": 5}, 4)
)
_CODES = [(kind, 0.0, frozenset()) for kind in (NONE, END, TARGET, NEGATION, REPORT)] + [(kind, round((k + 1) * _STEP, 3), frozenset()) for kind in (THREAT, INSULT) for k in range(_LEVELS)]


def _code(kind: int, weight: float = 0.0) -> int:
    if kind < THREAT:
        return kind
    return THREAT + (kind - THREAT) * _LEVELS + min(_LEVELS - 1, max(0, round(weight / _STEP) - 1))


class Lexicon(dict):
    """Word to code; what it has met it remembers, up to a bound."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words = {w: _code(kind, FIXED) for kind, some in WORDS.items() for w in some.split()}
        self.words |= {w: _code(INSULT, x) for w, x in words.items()}
        self.stems = {w: _code(INSULT, x) for w, x in stems.items()}

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        if word in ".!?;:\n":
            code = END
        elif (code := self.words.get(word)) is None:
            code = next((self.stems[s] for n in reversed(STEMS) if len(word) > n and (s := word[:n]) in self.stems), NONE)
        self[word] = code
        return code


_TRIGGERS = bytes(range(THREAT, len(_CODES)))


def clauses(text: str | None, lexicon: Lexicon) -> Iterator[list[tuple[int, float]]]:
    """The matches (feature, weight) of each clause that has any."""
    codes = bytes(map(lexicon.__getitem__, _TOKEN.findall((text or "").lower())))
    if not codes.strip(bytes(range(THREAT))) or len(codes.translate(None, _TRIGGERS)) == len(codes):
        return
    for clause in codes.split(bytes([END])):
        if len(clause.translate(None, _TRIGGERS)) == len(clause):
            continue
        symbols = [_CODES[c] for c in clause]
        # the target may stand on either side: the right one is found by running backward
        symbols = _BACKWARD.run(symbols[::-1])[::-1]
        yield [x[1:] for x in GRAMMAR.run(symbols) if x[0] == "match"]


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    greatest, total = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for matches in clauses(text, lexicon):
        own = np.zeros(len(FEATURES))
        for k, weight in matches:
            own[k] += weight
        greatest = np.maximum(greatest, own)
        total += own
    return np.r_[greatest, np.log1p(total)]


@dataclass(frozen=True)
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = tuple(PRIOR)
    bias: float = BIAS


def held_out(id: Column, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(text, label) of about `rows` labelled rows at most that may be learned from, written to the shared folder."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    # at most about `rows` rows of 12 bytes: that is the bound of what is sent to the executors
    return cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label"))


def _terms(text: str) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {f"{w[:n]}*" for n in STEMS for w in words if len(w) > n}


def _learn_terms(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that stand in documents with label 1 far more often than chance allows, and their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, zeros = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                (ones if label else zeros).update(_terms(text.as_py() or ""))
        terms = list(ones | zeros)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([ones[t] for t in terms], pa.int64()), pa.array([zeros[t] for t in terms], pa.int64())], ["term", "ones", "zeros"])

    n1, n0 = (sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first())
    if not n1 or not n0:
        return {}, {}
    counted = sample.mapInArrow(count, "term string, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).where(F.col("ones") + F.col("zeros") >= LEAST)
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1)) - F.log((F.col("zeros") + 0.5) / (n0 + 1))
    counted = cut(counted.withColumn("odds", odds))
    tested = counted.count()
    best = counted.where((F.col("ones") >= LEAST) & (F.col("odds") > 1.5)).orderBy(F.col("odds").desc(), "term").limit(4 * MOST).collect()
    rate = n1 / (n1 + n0)
    scored = sorted(((_tail(r["ones"], r["ones"] + r["zeros"], rate), r["term"], r["odds"]) for r in best))
    last = max((k for k, (p, _, _) in enumerate(scored) if p * tested / (k + 1) <= FALSE), default=-1)
    words, stems = {}, {}
    for _, term, weight in scored[: min(last + 1, MOST)]:
        (stems if term.endswith("*") else words)[term.rstrip("*")] = float(weight)
    return words, stems


def _tail(k: int, n: int, p: float) -> float:
    """Chance of k or more of n at rate p."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def _featured(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    width = 2 * len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.stems)
        for batch in batches:
            found = [features(t.as_py(), lexicon).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("label").cast(pa.int32())], ["x", "label"])

    rows = sample.mapInArrow(run, "x array<double>, label int").collect()
    order = sorted((r["x"], r["label"]) for r in rows)
    return np.array([x for x, _ in order]).reshape(-1, width), np.array([y for _, y in order], float)


def regress(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float = 2.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to prior; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = prior.copy()
    hold = np.full(len(w), pull)
    hold[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + hold * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), slope)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = FIT_ROWS) -> Model:
    """Lexical arcs and weights from labels.toxic of the rows for which `learn` holds."""
    sample = labelled(docs, labels, "toxic", learn, rows)
    words, stems = _learn_terms(sample)
    x, y = _featured(sample, Model(words, stems))
    if not len(y) or y.min() == y.max():
        return Model(words, stems)
    w = regress(x, y, np.r_[PRIOR, BIAS])
    return Model(words, stems, tuple(map(float, w[:-1])), float(w[-1]))


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each text."""
    kept = df.drop(out)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(tuple(model.words.items()), tuple(model.stems.items()))
        weights = np.array(model.weights)
        for batch in batches:
            found = [1 / (1 + math.exp(-min(30.0, max(-30.0, float(features(t.as_py(), lexicon) @ weights) + model.bias)))) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.float64())], [*names, out])

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _lexicon(words: tuple, stems: tuple) -> Lexicon:
    """One a worker process."""
    return Lexicon(dict(words), dict(stems))


def op6_transducer_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels are learned only from rows whose crc32 mod 5 isn't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    found = scored(docs, model).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents with a toxicity of 0.5 or more go."""
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    name = unused(docs, "score")["score"]
    return scored(docs, model, out=name).where(F.col(name) < 0.5).drop(name)
