"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (the last one shorter). Every passage is encoded as a vector of
what its characters and words look like; a hidden layer embeds it, gated attention (a tanh and a sigmoid branch) gives
each passage of a document a weight, the weights sum to one, and the weighted passage representation is scored by
a logistic output. Only documents have labels; which passages matter is learned with the rest, by Adam on the gradient
of all parts, from the labelled rows that may be learned from.

Defined results: null and empty texts have one passage whose encoding is zero; whole texts are read, whatever their
length, to be scored, and the fit takes FIT_PASSAGES of a text's passages, spread over all of it, where it has more; null labels are left out, of several labels of a doc_id the largest counts; with no labels, or one kind of
them, every score is that share of ones (0.5 without any). Rows with null doc_id are scored like any other and are not
held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Column

from marginalia.llm.shared import table
from marginalia.llm.toxicity import held_out, labelled

PASSAGE = 64
#: Labelled rows that the fit uses, about; drawn by a hash of doc_id where there are more.
FIT_ROWS = 6_000
#: Passages of a labelled text that the fit uses at most, so the driver gets FIT_ROWS * FIT_PASSAGES rows of WIDTH numbers, whatever the texts' length.
FIT_PASSAGES = 64
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY, SEED = 250, 0.02, 1e-3, 7

_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|", b"#$%&*+=~^@", b"'\"()[]-", b"/\\<>{}_`", bytes(range(128, 256)))
_GROUP_OF = np.full(256, len(_GROUPS), np.uint8)
for _k, _group in enumerate(_GROUPS):
    _GROUP_OF[np.frombuffer(_group, np.uint8)] = _k
#: Shares of the groups and of other bytes, then the words' features.
WIDTH = len(_GROUPS) + 1 + 9


def spread(passages: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    """At most so many passages, at even distances, the first and the last among them."""
    return passages if len(passages) <= most else passages[np.linspace(0, len(passages) - 1, most).round().astype(int)]


def encode(text: str | None) -> np.ndarray:
    """A row for each passage."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros((1, WIDTH))
    n = len(words)
    first = np.arange(0, n, PASSAGE)
    size = np.diff(np.r_[first, n])
    length = np.fromiter(map(len, words), np.int64, n)
    data = np.frombuffer(b"".join(words), np.uint8)
    begins = np.cumsum(length) - length
    chars = np.add.reduceat(length, first)
    groups = _GROUP_OF[data]
    passage = np.repeat(np.arange(len(first)), chars)
    shares = np.bincount(passage * (len(_GROUPS) + 1) + groups, minlength=len(first) * (len(_GROUPS) + 1)).reshape(len(first), -1) / chars[:, None]
    upper, last = groups[begins] == 1, groups[begins + length - 1]
    ids = np.fromiter(map(hash, words), np.int64, n)
    again = np.r_[False, ids[1:] == ids[:-1]]
    mean = lambda x: np.add.reduceat(np.asarray(x, float), first) / size
    distinct = np.array([len(set(words[k : k + PASSAGE])) for k in first.tolist()]) / size
    spread = np.sqrt(np.maximum(0, mean(length * length) - mean(length) ** 2))
    return np.c_[shares, mean(length) / 10, spread / 10, mean(length <= 3), mean(length == 1), mean(upper), mean(last >= 5), mean(again), distinct, np.log1p(size) / 5]


@dataclass(frozen=True)
class Model:
    """Parameters; `share` is the score where nothing could be learned."""

    parts: dict[str, np.ndarray] | None
    share: float = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(parts: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """x: passages of all bags; first: where each bag begins."""
    size = np.diff(np.r_[first, len(x)])
    x = (x - parts["mean"]) / parts["std"]
    h = np.tanh(x @ parts["E"] + parts["e"])
    t, g = np.tanh(h @ parts["V"] + parts["v"]), _sigmoid(h @ parts["U"] + parts["u"])
    raw = (t * g) @ parts["w"]
    a = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), size))
    a /= np.repeat(np.add.reduceat(a, first), size)
    z = np.add.reduceat(a[:, None] * h, first)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "size": size, "p": _sigmoid(z @ parts["c"] + parts["b"])}


def _gradient(parts: dict[str, np.ndarray], f: dict[str, np.ndarray], y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    out = (f["p"] - y) / len(y)
    back = lambda per_bag: np.repeat(per_bag, f["size"], axis=0)
    dz = back(out[:, None] * parts["c"])
    da = (dz * f["h"]).sum(axis=1)
    draw = f["a"] * (da - back(np.add.reduceat(f["a"] * da, first)))
    dt, dg = draw[:, None] * parts["w"] * f["g"] * (1 - f["t"] ** 2), draw[:, None] * parts["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ parts["V"].T + dg @ parts["U"].T) * (1 - f["h"] ** 2)
    return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "v": dt.sum(0), "U": f["h"].T @ dg, "u": dg.sum(0), "w": (f["t"] * f["g"]).T @ draw, "c": f["z"].T @ out, "b": out.sum()}


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    random = np.random.default_rng(SEED)
    draw = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    parts = {"E": draw(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "v": np.zeros(GATE), "U": draw(HIDDEN, GATE), "u": np.zeros(GATE), "w": draw(GATE), "c": draw(HIDDEN), "b": np.array(np.log(y.mean() / (1 - y.mean())))}
    fixed = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-3}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    for step in range(1, EPOCHS + 1):
        grad = _gradient(parts, forward(parts | fixed, x, first), y, first)
        for k, g in grad.items():
            g = g + DECAY * parts[k] * (k not in "evub")
            m, s = moments[k]
            moments[k] = m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            parts[k] = parts[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(parts | fixed, float(y.mean()))


def score(model: Model, passages: np.ndarray) -> float:
    if model.parts is None:
        return model.share
    return float(forward(model.parts, passages, np.array([0]))["p"][0])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = FIT_ROWS) -> Model:
    """The model, from labels.quality of the rows for which `learn` holds; the driver gets numbers of a bounded sample, no texts."""
    sample = labelled(docs, labels, "quality", learn, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spread(encode(t.as_py())).astype(np.float32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("label").cast(pa.int32())], ["x", "label"])

    # at most FIT_ROWS * FIT_PASSAGES * WIDTH floats
    rows_ = sorted((bytes(r["x"]), r["label"]) for r in sample.mapInArrow(run, "x binary, label int").collect())
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for x, _ in rows_]
    if not bags:
        return Model(None)
    return train(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]), np.array([y for _, y in rows_], float))


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of each text."""
    kept = df.drop(out)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(model, encode(t.as_py())) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.float64())], [*names, out])

    return df.mapInArrow(run, schema)


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels are learned only from rows whose crc32 mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    found = scored(docs, model).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
