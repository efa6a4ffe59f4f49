"""Quality by Bradley-Terry ranking: a document's score beats another's with a probability that their difference gives.

The score is linear in features of the whole text. Preference pairs set a labelled good document against a
labelled bad one; logistic loss on the differences of their features gives the weights. A quantile of the
scores, found on the same labelled documents, is the threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.toxicity import sample

GOOD_AT = 0.3


@dataclass(frozen=True)
class Settings:
    """per_class bounds the labelled rows that the model is fitted on; everything else is scored whole."""

    per_class: int = 3000
    pairs: int = 40_000
    steps: int = 600
    rate: float = 0.05
    decay: float = 1e-4
    #: Where a feature's effect may bend, as quantiles of the labelled documents.
    knots: tuple[float, ...] = (0.02, 0.1, 0.5, 0.9, 0.98)
    seed: int = 7


#: Classes of bytes whose shares are features.
BYTES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "beyond": bytes(range(128, 256)),
    "stop": b".,;:'\"-",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+<>\\/_{}[]()`",
    "line": b"\n",
    "blank": b" \t\r\x0b\x0c",
    "control": bytes([*range(9), *range(14, 32), 127]),
}
_CLASS = np.full(256, len(BYTES))
for _i, _chars in enumerate(BYTES.values()):
    _CLASS[list(_chars)] = _i
N_FEATURES = len(BYTES) + 12


def features(raw: bytes | None) -> np.ndarray:
    """Features of a whole text in UTF-8; those of a text without words are zero but for its length."""
    out = np.zeros(N_FEATURES)
    raw = raw or b""
    if not raw:
        return out
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(BYTES) + 1)
    out[: len(BYTES)] = counts[:-1] / len(raw)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if words:
        n = len(words)
        often = Counter(words)
        lengths = np.array([len(w) for w in words])
        top = max(often.values())
        pairs = len(set(zip(words, words[1:])))
        out[len(BYTES) :] = [
            math.log1p(n),
            lengths.mean(),
            lengths.std(),
            lengths.max() ** 0.5,
            math.log(len(often)) / math.log(n) if n > 1 else 1,
            top / n,
            pairs / (n - 1) if n > 1 else 1,
            1 - len(set(lines)) / len(lines),
            math.log1p(n / len(lines)),
            sum(1 for w in often if not w[:1].isalnum() and w[0] < 128) / len(often),
            sum(1 for w in often if w[-1:].isalnum() or w[-1] >= 128) / len(often),
            sum(1 for w in often if w.isupper() and len(w) > 1) / len(often),
        ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        bent = np.maximum(z[:, :, None] - self.knots[None], 0).reshape(len(z), -1)
        return np.concatenate([z, bent], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; GOOD_AT at the threshold."""
        at = (self.raw(x) - self.threshold) / self.spread + math.log(GOOD_AT / (1 - GOOD_AT))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def fit(x: np.ndarray, labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Weights from preference pairs, and the score quantile that divides the labelled documents best.

    Without documents of both classes every score is the same: 0.5, or 0.05 if all labelled ones are bad.
    """
    if len(labels) == 0 or len(set(labels.tolist())) < 2:
        width = N_FEATURES * (1 + len(s.knots))
        constant = 0.05 if len(labels) and not labels[0] else 0.5
        shift = math.log(GOOD_AT / (1 - GOOD_AT)) - math.log(constant / (1 - constant))
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, len(s.knots))), np.zeros(width), shift, 1.0)
    rng = np.random.default_rng(s.seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    model = Model(mean, scale, np.quantile(z, s.knots, axis=0).T, np.zeros(0), 0.0, 1.0)
    wide = model.expand(x)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    diff = wide[rng.choice(good, s.pairs)] - wide[rng.choice(bad, s.pairs)]
    w, m, v = np.zeros(wide.shape[1]), np.zeros(wide.shape[1]), np.zeros(wide.shape[1])
    for t in range(1, s.steps + 1):
        own = diff[rng.integers(len(diff), size=2048)]
        lost = 1 / (1 + np.exp(np.clip(own @ w, -30, 30)))  # the probability that the worse one wins
        grad = -(own * lost[:, None]).mean(0) + s.decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights = w
    raw = wide @ w
    cuts = np.quantile(raw, np.linspace(0.001, 0.999, 999))
    right = [((raw[good] >= c).mean() + (raw[bad] < c).mean()) for c in cuts]
    best = np.flatnonzero(np.array(right) == max(right))
    model.threshold = float((cuts[best[0]] + cuts[best[-1]]) / 2)
    model.spread = float(max(raw.std() / 4, 1e-6))
    return model


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from. A null id is not among them: it has no labels either way."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of a bounded sample of labelled rows; their features are made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    picked = sample(docs.select("doc_id", F.col("text").cast("binary").alias("text")), labels, "quality", ~held_out(), s.per_class)
    rows = picked.mapInArrow(run, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))  # so that the model doesn't depend on the order of tasks
    return fit(np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["label"] for r in rows], np.int64), s)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str | None = None) -> DataFrame:
    """docs with the score of each whole text added as a column, called name or else `_score`, which docs must not have.

    Null scores like the empty text. Without labels of both classes every score is the same: 0.5, or 0.05 if all
    labelled texts are bad. Texts of any length are read whole. Rows with equal or null ids are scored each on its own;
    an empty table gives an empty result.
    """
    name = name or "_score"
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return docs.withColumn(name, score(F.col(text_col).cast("binary")))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs; other columns, whatever their names, are not read."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= GOOD_AT).cast("int").alias("predicted"))
