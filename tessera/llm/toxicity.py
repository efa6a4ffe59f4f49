"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its character n-grams and of itself, all in one hashed table; a
document is the average of its words. An unseen misspelling shares n-grams with what was seen. After training,
a word's share of the logit is one number, so scoring a document is a weighted count of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_tables, materialize

TOXIC_AT = 0.7


@dataclass(frozen=True)
class Settings:
    """per_class and most_mb bound the labelled rows that the model is fitted on; everything else is scored whole."""

    per_class: int = 3000
    #: Megabytes of bags of a class: a text of a hundred thousand different words is 256 KB.
    most_mb: int = 128
    buckets: int = 1 << 16  # at most: a bucket's number takes two bytes
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    epochs: int = 20
    batch: int = 32
    rate: float = 0.5
    #: Averages over hundreds of words are small; the softmax sees them multiplied by this.
    gain: float = 20.0
    #: Gradient that a bucket must gather before its steps reach the full rate: what is rarely seen moves little.
    caution: float = 0.01
    #: Words without a meaning that every text has besides its own, so that a few chance words decide no short text.
    neutral: float = 16.0
    #: Share of a document's buckets that a step sees.
    stay: float = 0.5
    seed: int = 5


#: Not part of a word at its ends.
PUNCTUATION = ".,;:!?\"'()[]{}|"
#: Bytes of text that are split into words at once, about.
SLICE = 1 << 20
#: What a weight of one is stored as: in half precision, small weights would lose digits.
UNIT = 4096
#: Constants of the hashes.
FNV_BASIS, FNV_PRIME, POLYNOMIAL = np.uint32(2166136261), np.uint32(16777619), np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): for each of the words the bucket of the word itself and those of its n-grams, in UTF-8 bytes.

    All words are hashed at once: n-grams by FNV-1a, whole words as a polynomial, both with marks at the ends.
    """
    raw = [b"<%b>" % w.strip(PUNCTUATION).encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    word = np.repeat(np.arange(len(raw)), sizes)
    after = np.repeat(ends, sizes) - np.arange(len(flat))  # bytes from here to the end of the word
    powers = np.full(int(sizes.max(initial=0)), POLYNOMIAL, np.uint64).cumprod()
    whole = np.add.reduceat((flat + np.uint64(1)) * powers[np.repeat(sizes, sizes) - after], ends - sizes) if len(raw) else np.zeros(0, np.uint64)
    buckets, owners = [(whole ^ (whole >> np.uint64(32))) % np.uint64(s.buckets)], [np.arange(len(raw))]
    for n in range(s.shortest, s.longest + 1):
        there = max(len(flat) - n + 1, 0)
        h = np.full(there, FNV_BASIS, np.uint32)
        for i in range(n):
            h = (h ^ flat[i : i + there]) * FNV_PRIME
        real = after[:there] >= n
        h = h[real]
        buckets.append((h ^ (h >> np.uint32(16))) % np.uint32(s.buckets))
        owners.append(word[:there][real])
    return np.concatenate([b.astype(np.int64) for b in buckets]), np.concatenate(owners)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts of about SLICE bytes, one text at least, nulls as empty texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield texts.slice(at, end - at)
        at = end


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, word, n, words): how often each different word of words occurs in which text, by text; words are lowered."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    lengths, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
    coded = flat.dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    key, n = np.unique(np.repeat(np.arange(len(texts)), lengths) * max(len(words), 1) + code, return_counts=True)
    at, word = np.divmod(key, max(len(words), 1))
    real = np.array([bool(w) for w in words], bool)[word] if len(word) else np.zeros(0, bool)  # blanks at an end leave empty words
    return at[real], word[real], n[real], words


def bags(texts: pa.Array, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its buckets, as 16-bit numbers, and their weights, which sum to UNIT times the words' share of words and neutral words.

    A word counts less each time it is repeated.
    """
    for part in slices(texts):
        at, word, n, words = word_counts(part)
        weight = 1 + np.log(n)
        bucket, owner = subwords(words, s)
        bucket = bucket[np.argsort(owner, kind="stable")]
        of_word = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
        bounds = np.searchsorted(at, np.arange(len(part) + 1))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = [bucket[of_word[w] : of_word[w + 1]] for w in word[lo:hi].tolist()]
            total, sizes = weight[lo:hi].sum() + s.neutral, [len(o) for o in own]
            uniq, place = np.unique(np.concatenate([np.empty(0, np.int64), *own]), return_inverse=True)
            shares = np.repeat(weight[lo:hi] / total / np.array(sizes, float), sizes)
            yield uniq.astype(np.uint16), (UNIT * np.bincount(place, shares, len(uniq))).astype(np.float16)


@dataclass
class Model:
    """share: what a bucket with the whole weight of a document adds to the logit."""

    share: np.ndarray
    bias: float
    settings: Settings


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Embeddings and softmax weights by Adagrad on the cross-entropy of balanced classes."""
    rng = np.random.default_rng(s.seed)
    table = np.zeros((s.buckets, s.dim), np.float32)
    soft = rng.normal(0, 1, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if len(labels) == 0 or len(set(labels.tolist())) < 2:
        return Model(np.zeros(s.buckets, np.float32), 0.0 if len(labels) == 0 else (4.0 if labels[0] else -4.0), s)
    memory = [np.full(s.buckets, s.caution**2, np.float32), np.full_like(soft, 1e-2), np.full_like(bias, 1e-2)]
    share = {c: (labels == c).sum() for c in (0, 1)}
    weight = np.where(labels == 1, len(labels) / 2 / share[1], len(labels) / 2 / share[0]).astype(np.float32)
    for _ in range(s.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            sizes = [len(bags[i][0]) for i in own]
            if not sum(sizes):
                continue
            ids = np.concatenate([bags[i][0] for i in own])
            vals = np.concatenate([bags[i][1] for i in own]).astype(np.float32) * (s.gain / UNIT)
            rows = np.repeat(np.arange(len(own)), sizes)
            stay = rng.random(len(ids)) < s.stay
            ids, vals, rows = ids[stay], vals[stay] / s.stay, rows[stay]
            vectors = table[ids] * vals[:, None]
            hidden = np.stack([np.bincount(rows, vectors[:, d], len(own)) for d in range(s.dim)], 1).astype(np.float32)
            logits = hidden @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= weight[own][:, None] / len(own)
            grads = [None, hidden.T @ p, p.sum(0)]
            back = (p @ soft.T)[rows] * vals[:, None]
            uniq, where = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(where, back[:, d], len(uniq)) for d in range(s.dim)], 1).astype(np.float32)
            memory[0][uniq] += (step**2).mean(1)
            table[uniq] -= s.rate * step / np.sqrt(memory[0][uniq])[:, None]
            for k, param in ((1, soft), (2, bias)):
                memory[k] += grads[k] ** 2
                param -= 0.1 * s.rate * grads[k] / np.sqrt(memory[k])
    slope = soft[:, 1] - soft[:, 0]
    return Model((s.gain * (table @ slope)).astype(np.float32), float(bias[1] - bias[0]), s)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """0 to 1 for each text: the mean of what its words add, by their weights, with the neutral words, as one sum over many texts."""
    out = []
    for part in slices(texts):
        at, word, n, words = word_counts(part)
        weight = 1 + np.log(n)
        bucket, owner = subwords(words, model.settings)
        value = np.bincount(owner, model.share[bucket], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)
        logit = np.bincount(at, weight * value[word], len(part)) if len(at) else np.zeros(len(part))
        logit = logit / (np.bincount(at, weight, len(part)) + model.settings.neutral) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from. A null id is not among them: it has no labels either way."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, keep, per_class: int) -> DataFrame:
    """(text, label) of at most per_class rows of each class, chosen in the order of a hash of the id.

    Labels of one document that contradict each other, null labels and null ids teach nothing. Of rows that share
    an id, the one with the greatest text is taken.
    """
    known = labels.select("doc_id", F.col(column).alias("label")).where("doc_id is not null and label in (0, 1)").where(keep)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [known.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    chosen = few[0].union(few[1])
    # at most 2 x per_class rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").cast("int").alias("label")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of a bounded sample of labelled rows; their bags are made where the texts are.

    The sample of a class ends after per_class rows or most_mb of bags, in the order of a hash of their contents; this
    is all that the driver ever holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(bags(batch.column(0), s))
            cols = [batch.column(1), pa.array([b[0].tobytes() for b in found], pa.binary()), pa.array([b[1].tobytes() for b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "ids", "weights"])

    made = materialize(sample(docs, labels, "toxic", ~held_out(), s.per_class).mapInArrow(run, "label int, ids binary, weights binary"), "bags")
    # at most 2 x per_class rows
    sizes = made.select("label", F.xxhash64("ids", "weights").alias("order"), (F.octet_length("ids") + F.octet_length("weights")).alias("size"))
    through = Window.partitionBy("label").orderBy("order")
    last = sizes.withColumn("sum", F.sum("size").over(through)).where(F.col("sum") <= s.most_mb << 20).groupBy("label").agg(F.max("order").alias("last"))
    rows = made.join(F.broadcast(last), "label").where(F.xxhash64("ids", "weights") <= F.col("last")).select("label", "ids", "weights").toArrow()
    drop_tables(docs.sparkSession, [made])
    rows = sorted(zip(*(rows[c].to_pylist() for c in rows.column_names)))  # so that the model doesn't depend on the order of tasks
    found = [(np.frombuffer(ids, np.uint16), np.frombuffer(weights, np.float16)) for _, ids, weights in rows]
    return fit(found, np.array([label for label, _, _ in rows], np.int64), s)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str | None = None) -> DataFrame:
    """docs with the score of each whole text added as a column, called name or else `_score`, which docs must not have.

    Null and empty texts get the score of a text without words. Without labels of both classes every score is a
    constant: 0.5 if there are none, else on the side of the only class. Texts of any length are scored whole, a few
    megabytes at a time. Rows with equal or null ids are scored each on its own; an empty table gives an empty result.
    """
    name = name or "_score"
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(scores(batch, model), pa.float64())

    return docs.withColumn(name, score(F.col(text_col)))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs; other columns, whatever their names, are not read."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= TOXIC_AT).cast("int").alias("predicted"))
