import math
from fractions import Fraction

import numpy as np

from tessera.llm import embedding_dedup, topk

KIND = "vec_id long, embedding array<float>, label int, rep long, bucket long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], KIND)


def planted(n=120, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(k), rng.standard_normal(dim).astype(np.float32).tolist()) for k in range(n)]
    for k in range(30):
        rows.append((n + k, (np.array(rows[k % 6][1]) * 2 + rng.standard_normal(dim) * 0.1).astype(np.float32).tolist()))
    rows += [(n + 40 + k, rows[0][1]) for k in range(5)] + [(3, rows[3][1]), (None, rows[1][1])]
    rows += [(900, None), (901, []), (902, [0.0] * dim), (903, [1.0] * (dim - 1) + [float("nan")]), (904, [1.0, None]), (905, [float("inf")] * dim), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows):
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b) and any(a) and any(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), n[k], str(least.get(find(k))), i is not None and i == least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_links_against_brute_force(spark, monkeypatch):
    rows = planted()
    for block, small in ((1024, 64), (4, 3)):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "MATCHED", block)
        monkeypatch.setattr(embedding_dedup, "SMALL", small)
        got = embedding_dedup.op3(table(spark, rows)).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == brute_links(rows)
    assert embedding_dedup.op3(table(spark, [])).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs at cosine 0.9, and no other links: at least nine in ten are found."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.90001 * a + np.sqrt(1 - 0.90001**2) * b).tolist())]
    got = {r["vec_id"]: r for r in embedding_dedup.op3(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    hits = [got[2 * k]["n_links"] == 1 for k in range(1500)]
    assert np.mean(hits) >= 0.9
    assert all(got[2 * k + 1]["component_id"] == (2 * k if hit else 2 * k + 1) for k, hit in enumerate(hits))


def test_links_with_names_used_inside(spark):
    rows = [(k, [1.0, float(k % 3)], "x") for k in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    for name in ("rep", "h", "first", "_salt"):
        table = table.withColumn(name, table["id"])
    out = embedding_dedup.op3(table).orderBy("vec_id").collect()
    assert [r["n_links"] for r in out] == [5 if k % 3 else 2 for k in range(9)]


def brute_top(rows, every):
    found = [(i, [math.floor(256 * Fraction(float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for n, (q, x) in enumerate(found):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(found) if m != n and len(x) == len(y))
            out += [(q, r, i, max(min(-s, 2**63 - 1), 1 - 2**63)) for r, (s, i) in enumerate(scored[:5], 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK", 9)
    rows = planted(300, 24, 9) + [(1000 + k, [0.5] * 24) for k in range(40)]  # ties
    rows += [(10, rows[10][1]), (10, rows[50][1]), (10, rows[50][1]), (20, [float("inf")] * 24)]  # ids that occur more than once
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table(spark, rows), 10).collect())
    assert got == brute_top(rows, 10)
    assert topk.op5(table(spark, [])).count() == 0
    assert topk.op5(table(spark, [(0, [1.0])])).count() == 0


def test_top_k_of_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.standard_normal(4) * 10.0 ** (k % 3 * 15)).tolist()) for k in range(60)]
    rows += [(k, [3.0e38 * s, 2.0**62, 0.0, -1.0]) for k, s in zip(range(60, 70), (1, -1, 1, 0.5, -0.5, 1, 0.9, 0.8, 0.7, 0.6))]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table(spark, rows), 10).collect())
    assert got == brute_top(rows, 10)


def test_top_k_sql_with_repeated_ids(spark, duck, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(k % 130, rng.standard_normal(8).astype(np.float32).tolist()) for k in range(260)] + [(50, None), (None, [1.0] * 8)]
    table(spark, rows).write.parquet(f"{tmp_path}/e")
    duck.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    got = sorted(tuple(r) for r in topk.op5(spark.read.parquet(f"{tmp_path}/e")).collect())
    assert got == sorted(duck.sql(topk.OP5_SQL).fetchall()) and len(got) == 3 * 2 * 5
