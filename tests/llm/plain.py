"""Plain versions of the models and of near-duplicate groups, with loops instead of arrays, for tests on small tables."""

import math
import zlib
from collections import Counter

import numpy as np

from tessera.llm import quality, toxicity


def words_of(text):
    """(word without punctuation at its ends, weight) of a text."""
    return [(w.strip(".,;:!?\"'()[]{}|"), 1 + math.log(n)) for w, n in Counter((text or "").lower().split()).items()]


def grams(word, s):
    """Buckets of a word with marks at its ends and of its parts of three to five bytes."""
    marked = ("<" + word + ">").encode()
    whole = sum((b + 1) * 0x9E3779B97F4A7C15 ** (i + 1) for i, b in enumerate(marked)) % 2**64
    out = [(whole ^ whole >> 32) % s.buckets]
    for n in (3, 4, 5):
        for i in range(len(marked) - n + 1):
            h = 2166136261
            for b in marked[i : i + n]:
                h = (h ^ b) * 16777619 % 2**32
            out.append((h ^ h >> 16) % s.buckets)
    return out


def bag(text, s):
    words = words_of(text)
    total = sum(n for _, n in words) + s.neutral
    out = {}
    for word, n in words:
        own = grams(word, s)
        for b in own:
            out[b] = out.get(b, 0.0) + n / total / len(own)
    return sorted((b, float(np.float16(toxicity.UNIT * v))) for b, v in out.items())


class Toxic:
    """Embeddings of buckets, averaged into a linear softmax, fitted text by text."""

    def __init__(self, rows, s=toxicity.Settings()):
        self.s, rng = s, np.random.default_rng(s.seed)
        bags = sorted((label, np.array([b for b, _ in x], np.uint16).tobytes(), np.array([v for _, v in x], np.float16).tobytes(), x) for t, label in rows for x in [bag(t, s)])
        labels = [b[0] for b in bags]
        bags = [b[3] for b in bags]
        self.table = {}
        self.soft = rng.normal(0, 1, (s.dim, 2)).astype(np.float32).astype(float)
        self.bias = np.zeros(2)
        memory, of_soft, of_bias = {}, np.full((s.dim, 2), 1e-2), np.full(2, 1e-2)
        share = Counter(labels)
        for _ in range(s.epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), s.batch):
                own = order[at : at + s.batch]
                seen = rng.random(sum(len(bags[i]) for i in own)) < s.stay
                k, grads, g_soft, g_bias = 0, {}, np.zeros((s.dim, 2)), np.zeros(2)
                for i in own:
                    kept = [(b, v * s.gain / toxicity.UNIT / s.stay) for j, (b, v) in enumerate(bags[i]) if seen[k + j]]
                    k += len(bags[i])
                    hidden = sum((self.table.get(b, np.zeros(s.dim)) * v for b, v in kept), np.zeros(s.dim))
                    p = np.exp(hidden @ self.soft + self.bias)
                    p = p / p.sum()
                    p[labels[i]] -= 1
                    p *= len(labels) / 2 / share[labels[i]] / len(own)
                    g_soft += np.outer(hidden, p)
                    g_bias += p
                    for b, v in kept:
                        grads[b] = grads.get(b, 0) + self.soft @ p * v
                for b, g in grads.items():
                    memory[b] = memory.get(b, s.caution**2) + (g**2).mean()
                    self.table[b] = self.table.get(b, np.zeros(s.dim)) - s.rate * g / math.sqrt(memory[b])
                of_soft, of_bias = of_soft + g_soft**2, of_bias + g_bias**2
                self.soft = self.soft - 0.1 * s.rate * g_soft / np.sqrt(of_soft)
                self.bias = self.bias - 0.1 * s.rate * g_bias / np.sqrt(of_bias)

    def score(self, text):
        words = words_of(text)
        total = sum(n for _, n in words) + self.s.neutral
        hidden = np.zeros(self.s.dim)
        for word, n in words:
            own = grams(word, self.s)
            hidden += n / total * self.s.gain * sum(self.table.get(b, np.zeros(self.s.dim)) for b in own) / len(own)
        p = np.exp(hidden @ self.soft + self.bias)
        return p[1] / p.sum()


def features(text):
    """The features that quality.py describes, one by one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * quality.N_FEATURES
    shares = [sum(raw.count(bytes([c])) for c in chars) / len(raw) for chars in quality.BYTES.values()]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    if not words:
        return shares + [0.0] * 12
    n, often, lengths = len(words), Counter(words), [len(w) for w in words]
    mean = sum(lengths) / n
    return shares + [
        math.log1p(n), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / n), math.sqrt(max(lengths)), math.log(len(often)) / math.log(n) if n > 1 else 1.0, often.most_common(1)[0][1] / n,
        len({(a, b) for a, b in zip(words, words[1:])}) / (n - 1) if n > 1 else 1.0, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        sum(not w[:1].isalnum() and w[0] < 128 for w in often) / len(often), sum(w[-1:].isalnum() or w[-1] >= 128 for w in often) / len(often), sum(w.isupper() and len(w) > 1 for w in often) / len(often),
    ]


class Good:
    """Bradley-Terry: weights from pairs of a good and a bad text, one pair after another; a quantile of the scores is the threshold."""

    def __init__(self, rows, s=quality.Settings()):
        rows = sorted((label, features(t)) for t, label in rows)
        x, labels = [r[1] for r in rows], [r[0] for r in rows]
        columns = list(zip(*x))
        self.mean = [sum(c) / len(c) for c in columns]
        self.scale = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) + 1e-6 for c, m in zip(columns, self.mean)]
        self.knots = [np.quantile([self.z(r)[k] for r in x], s.knots) for k in range(len(self.mean))]
        wide = [self.wide(r) for r in x]
        rng = np.random.default_rng(s.seed)
        good, bad = [i for i, y in enumerate(labels) if y == 1], [i for i, y in enumerate(labels) if y == 0]
        pairs = list(zip(rng.choice(good, s.pairs), rng.choice(bad, s.pairs)))
        w = m = v = np.zeros(len(wide[0]))
        for t in range(1, s.steps + 1):
            grad = np.zeros(len(w))
            for k in rng.integers(len(pairs), size=2048):
                diff = wide[pairs[k][0]] - wide[pairs[k][1]]
                grad -= diff / (1 + math.exp(max(-30, min(30, diff @ w)))) / 2048
            grad += s.decay * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = w - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w = w
        raw = [r @ w for r in wide]
        cuts = [float(np.quantile(raw, q)) for q in np.linspace(0.001, 0.999, 999)]
        right = [np.mean([raw[i] >= c for i in good]) + np.mean([raw[i] < c for i in bad]) for c in cuts]
        best = [k for k, r in enumerate(right) if r == max(right)]
        self.threshold = (cuts[best[0]] + cuts[best[-1]]) / 2
        self.spread = max(float(np.std(raw)) / 4, 1e-6)

    def z(self, x):
        return [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(x, self.mean, self.scale)]

    def wide(self, x):
        z = self.z(x)
        return np.array(z + [max(v - k, 0) for v, ks in zip(z, self.knots) for k in ks])

    def score(self, text):
        at = (self.wide(features(text)) @ self.w - self.threshold) / self.spread + math.log(0.3 / 0.7)
        return 1 / (1 + math.exp(-max(-30, min(30, at))))


def learns(doc_id, mod, out):
    """Whether a model may learn from a row."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod != out
