"""Spans that overlap and marks at or before a time, on hot keys, against plain loops."""

import random

from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.plans import passages


def test_overlapping(spark):
    rng = random.Random(5)

    def spans(n, start):
        out = []
        for k in range(n):
            a = rng.randrange(-300, 3000)
            out.append((0 if rng.random() < 0.7 else rng.choice([1, 2, None]), a, a + rng.choice([0, 0, 1, 2, 5, 17, 64, 900, 5000, -3]), start + k))
        return out + [(0, None, 5, start + n), (0, 5, None, start + n + 1)]

    left, right = spans(300, 0), spans(260, 1000)
    a = spark.createDataFrame(left, "k int, s long, e long, id int")
    b = spark.createDataFrame(right, "k int, x long, y long, other int")
    got = folds.overlapping(a, b, "k", ("s", "e"), ("x", "y"))
    assert got.columns == ["k", "s", "e", "id", "x", "y", "other"]
    ok = lambda s, e: s is not None and e is not None and s <= e
    want = [(i, j) for k, s, e, i in left for m, x, y, j in right if k is not None and k == m and ok(s, e) and ok(x, y) and s <= y and e >= x]
    assert sorted((r["id"], r["other"]) for r in got.collect()) == sorted(want)
    assert folds.overlapping(a, b.limit(0), "k", ("s", "e"), ("x", "y")).count() == 0
    halves = folds.overlapping(a.withColumn("s", F.col("s") / 2).withColumn("e", F.col("e") / 2), b.withColumn("x", F.col("x") / 2).withColumn("y", F.col("y") / 2), "k", ("s", "e"), ("x", "y"))
    assert halves.count() == len(want)


def test_overlap_counts(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        a = rng.choice([rng.randrange(-300, 3000), 50])
        rows.append((0 if rng.random() < 0.7 else rng.choice([1, 2, None]), a, a + rng.choice([0, 0, 1, 2, 5, 17, 64, 900, 5000, -3]), k))
    rows += [(0, None, 5, 500), (0, 5, None, 501), (0, 7, 9, 3), (9, 4, 4, 502)]
    whole = [(k, s, e, i) for k, s, e, i in rows if k is not None and s is not None and e is not None and s <= e]
    want = {}
    for k, s, e, i in whole:
        met = [x for m, x, y, _ in whole if m == k and s <= y and e >= x]
        n, first = want.get(i, (0, min(met)))
        want[i] = (n + len(met), min(first, *met, first))
    spans = spark.createDataFrame(rows, "k int, s long, e long, id int")
    for stretches in (1, 16, 300):
        got = folds.overlap_counts(spans, "k", "s", "e", ["id"], stretches)
        assert {r["id"]: (r["n"], r["first"]) for r in got.collect()} == want
    assert folds.overlap_counts(spans.limit(0), "k", "s", "e", ["id"]).count() == 0


def test_overlapping_stays_makes_no_pairs(spark, sf_dir):
    plan = passages.overlapping_stays(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" not in plan and plan.count("Join") == 1  # with a row a key and stretch


def test_as_of(spark):
    rng = random.Random(6)
    left = [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice([None, *[rng.randrange(-50, 1200)] * 9]), k) for k in range(400)]
    right = [(g, t, 5000 + t) for g in (0, 1, None) for t in {rng.randrange(1000) for _ in range(60)}] + [(0, 500, None), (0, None, 7), (1, None, 8)]
    right = [r for r in right if r[:2] != (0, 500)] + [(0, 500, None)]
    a, b = spark.createDataFrame(left, "g int, t long, id int"), spark.createDataFrame(right, "g int, t long, v int")
    marks = {g: sorted((t, v) for o, t, v in right if o == g and t is not None and v is not None) for g in (0, 1, 2, None)}
    want = {}
    for g, t, k in left:
        before = [v for m, v in marks[g] if t is not None and m <= t]
        want[k] = before[-1] if before else marks[g][0][1] if marks[g] else None
    for stretches in (1, 7, 256):
        got = folds.as_of(a, b, ["g"], "t", "v", stretches)
        assert got.columns == ["g", "t", "id", "v"]
        assert {r["id"]: r["v"] for r in got.collect()} == want
    assert folds.as_of(a, b.limit(0), ["g"], "t", "v").where("v is not null").count() == 0
