import hashlib
import math
from fractions import Fraction

import numpy as np

from tessera.llm import centroids

KIND = "vec_id long, embedding array<float>, cluster int, distance string, `_id` long, n long"


def plain(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * Fraction(float(np.float32(c)))) for c in v], v) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    found = [r[1] for r in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(found))

    for _ in range(rounds):
        own = [[] for _ in found]
        for _, v, _ in kept:
            own[near(v)[1]].append(v)
        found = [[sum(c) // len(vs) for c in zip(*vs)] if vs else c for c, vs in zip(found, own)]
    last = [(i, *near(v)[::-1]) for i, v, _ in kept]
    sums = {}
    for _, j, d in last:
        sums[j] = sums.get(j, 0) + min(d, 2**63 - 1)
    cut = lambda n: min(n, 2**63 - 1)
    total = cut(sum(sums.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return sorted((str(i), j, cut(d), cut(sums[j]), total, digest[j]) for i, j, d in last)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 9, "x", 1, 2) for i, v in rows], KIND).repartition(3)


def got(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert df.columns == names
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def vectors(n, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(k, (rng.standard_normal(64) * scale).astype(np.float32).tolist()) for k in range(n)]


def test_against_plain_version(spark):
    rows = vectors(150, scale=0.1)
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[5][1]), (None, [0.25] * 64), (-8, [0.0] * 64)] + [(500 + k, rows[7][1]) for k in range(60)]  # repeats, hot copies
    rows += [(800, None), (801, []), (802, [1.0] * 63), (803, [1.0] * 65), (804, [None] + [1.0] * 63), (805, [float("nan")] * 64), (806, [float("-inf")] * 64)]
    assert got(centroids.op13(table(spark, rows))) == plain(rows)


def test_ties_and_few_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-1, 2, 64).astype(float).tolist()) for k in range(90)] + [(100 + k, ([1.0, -1.0] * 32)[k % 2 :] + [0.0] * (k % 2)) for k in range(9)]
    assert got(centroids.op13(table(spark, rows))) == plain(rows)
    assert got(centroids.op13(table(spark, rows[:5]))) == plain(rows[:5])
    assert got(centroids.op13(table(spark, [(1, None), (2, [1.0])]))) == []
    assert got(centroids.op13(table(spark, []))) == []


def test_huge_components(spark):
    rows = vectors(60, 2, 1e3) + [(100 + k, (np.array(v) * 10.0 ** (6 * k)).tolist()) for k, (_, v) in enumerate(vectors(6, 3))] + [(200, [3.4e38] * 64), (201, [3.4e38] * 63 + [-3.4e38])]
    assert got(centroids.op13(table(spark, rows))) == plain(rows)


def test_intervals_hold_the_nearest():
    """Vectors that lie almost midway between centroids: the screen alone errs, its interval never does."""
    rng = np.random.default_rng(6)
    c = rng.integers(-(2**22), 2**22, (40, 64)).astype(float)
    x = np.floor((c[rng.integers(0, 40, 800)] + c[rng.integers(0, 40, 800)]) / 2) + rng.integers(-1, 2, (800, 64))
    near = centroids.shortlist(x, c)
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x[:200]]
    want = [min(range(40), key=lambda j, d=d: (d[j], j)) for d in far]
    label, distance = centroids.nearest(x[:200], c.astype(int).tolist())
    assert label.tolist() == want and distance.tolist() == [d[j] for d, j in zip(far, want)]
    assert all(near[i, j] for i, j in enumerate(want)) and 1 < near[:200].sum(1).mean() < 10


def test_sql(spark, duck, tmp_path):
    rows = vectors(120, 8, 0.2) + [(k, [0.5] * 64) for k in range(500, 520)] + [(7, [1.0]), (8, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/e")
    duck.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    want = duck.execute(centroids.op13_sql()).fetchall()
    assert got(centroids.op13(spark.read.parquet(f"{tmp_path}/e"))) == sorted((str(r[0]), *r[1:]) for r in want)
