import hashlib
import random
import zlib

import numpy as np

from tessera.llm import runs


def plain_runs(ids):
    """By every period, all stretches that keep it; of equal stretches the smallest period."""
    n, found = len(ids), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            start = k
            while k + q < n and ids[k] == ids[k + q]:
                k += 1
            if k + q - start >= max(12, 2 * q):
                found.setdefault((start, k + q), q)
            k += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def got(ids):
    return runs.runs(np.array(ids, np.uint16))


def test_scales_cover_every_period():
    for n in range(12, 300):
        # a scale is sure of a period if what a run of it repeats has room for an aligned block
        sure = {d for b, low, high in runs.scales(n) for d in range(low, high + 1) if 2 * b - 1 <= max(12 - d, d)}
        assert sure == set(range(1, n // 2 + 1))


def test_against_every_period():
    rng = random.Random(5)
    for trial in range(1500):
        n, kinds = rng.randrange(0, 140), rng.choice([1, 2, 3, 6, 40])
        ids = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 3:
                at, q = rng.randrange(n), rng.randrange(1, n // 2 + 1)
                for k in range(at + q, min(n, at + q * rng.randrange(1, 5) + rng.randrange(q))):
                    ids[k] = ids[k - q]
        assert got(ids) == plain_runs(ids), ids


def test_regular_sequences():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    cases = [[7] * 700, [7] * 300 + [8] + [7] * 300, [1, 2] * 300 + [1], [k % 97 for k in range(900)], ([3] * 40 + [4]) * 20, fib[-1], [bin(k).count("1") % 2 for k in range(900)], [k * k % 64 for k in range(800)], list(range(500)) * 2]
    for ids in cases:
        assert got(ids) == plain_runs(ids)


def test_long_regular_texts_stay_cheap():
    assert got([7] * 60_000) == [(0, 60_000, 1)]
    assert got(([3] * 300 + [4]) * 100)[0] == (0, 300, 1)
    half = [k % 5000 for k in range(60_000)]
    assert got(half) == [(0, 60_000, 5000)]


def plain(rows):
    out = []
    for doc, text in rows:
        words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        text = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        milli = 1000 * best[1] // best[2] if found else None
        out.append((doc, len(found), *best, milli, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(map(str, out))


def test_op11_against_plain_version(spark, docs, monkeypatch):
    monkeypatch.setattr(runs, "BATCH", 2000)
    rng = random.Random(8)
    words = ["a", "b", "A", "é", " ", "x y", "…"] + [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(words[: rng.choice([2, 9, 57])], k=rng.randrange(120)))) for k in range(250)]
    picked = [k for k in range(250) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert len(picked) > 10
    rows += [(900, None), (901, ""), (902, " \t\n\x0b"), (None, "a " * 30), (None, None), (-3, "b c\t" * 20), (5, rows[5][1]), (5, "same id"), (903, "x\ty\n" * 3000)]
    rows += [(picked[0], None), (picked[0], ""), (picked[1], "one"), (picked[2], "one two")]
    df = docs(rows)
    for name in ("runs", "start", "best", "period"):
        df = df.withColumn(name, df["lang"])
    found = runs.op11(df)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(rows)
    assert runs.op11(docs([])).count() == 0


def test_collapsed_text(docs):
    rows = {r["doc_id"]: r for r in runs.periodic_runs(docs(["x " + "a b c " * 9 + "y", "no runs here", None])).collect()}
    assert rows[0]["collapsed"] == "x a b c y" and [tuple(r) for r in rows[0]["runs"]] == [(1, 27, 3)] and rows[0]["n_words"] == 29
    assert rows[1]["collapsed"] == "no runs here" and rows[1]["runs"] == [] and rows[2]["collapsed"] == ""
