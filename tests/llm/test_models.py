import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tests.llm import plain


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def split(out, labels, column):
    rows = out.join(labels, "doc_id").collect()
    return [(r["score"], r["predicted"], r[column]) for r in rows if r["held_out"]]


def test_quality_on_held_out_rows(spark, tables):
    out = quality.op6(*tables).persist()
    assert out.count() == tables[0].count()
    rows = split(out, tables[1], "quality")
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _ in rows)
    assert np.mean([p == y for _, p, y in rows]) >= 0.97


def test_toxicity_on_held_out_rows(spark, tables):
    out = toxicity.op4(*tables)
    rows = split(out, tables[1], "toxic")
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p, _ in rows)
    assert np.mean([p == y for _, p, y in rows]) >= 0.94


def test_held_out_rule(spark):
    ids = [0, 1, 2, 17, 12345, -3]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", toxicity.held_out().alias("t"), quality.held_out().alias("q")).collect()
    assert [(r["t"], r["q"]) for r in rows] == [(zlib.crc32(str(i).encode()) % 3 == 1, zlib.crc32(str(i).encode()) % 5 == 0) for i in ids]


def test_misspellings_share_subwords():
    s = toxicity.Settings(epochs=10)
    texts = ["the quiet house by the sea", "you are such an idiot today"] * 30
    bags = list(toxicity.bags(pa.array(texts), s))
    wrong, right = toxicity.scores(pa.array(["oh idiiot", "oh house"]), toxicity.fit(bags, np.array([0, 1] * 30), s))
    assert wrong > right


def test_odd_rows_and_no_labels(spark, docs):
    df = docs(["", None, " ", "a b c", "x" * 200_000, "a b c"]).withColumnRenamed("n_chars", "_chars")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for op in (toxicity.op4, quality.op6):
            out = op(df, labels).collect()
            assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
            assert op(docs([]), labels).count() == 0


def small_corpus():
    rng = random.Random(12)
    calm = "house sea quiet garden morning light water stone road letter winter music table bread window".split()
    rude = "idiot moron stupid scum loser".split()
    texts = [" ".join(rng.choices(calm, k=rng.randrange(5, 40))).capitalize() + "." for _ in range(60)]
    texts = [t if k % 3 else " ".join([*t.split()[:4], *rng.choices(rude, k=4), *t.split()[4:]]) for k, t in enumerate(texts)]
    texts = [t if k % 4 else (t + " !!! ").upper() * 3 + "\n|#|" for k, t in enumerate(texts)]
    return texts + ["", None, " \n ", "Idiiot, ganz böse", "x" * 5000, texts[3]]


def test_models_against_plain_versions(spark, docs):
    """Scores of both operators against training and scoring in plain loops, over rows with and without labels."""
    texts = small_corpus()
    df = docs([*enumerate(texts), (None, "idiot without id"), (5, texts[5])]).withColumn("_score", F.lit(9)).withColumn("label", F.lit("x"))
    labelled = [(k, int(k % 4 != 0), int(k % 3 == 0)) for k in range(50)] + [(7, 0, 1), (51, None, None), (None, 1, 1), (900, 1, 1)]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    clear = [r for r in labelled[:50] if r[0] != 7]  # 7 has two labels that contradict each other
    toxic = plain.Toxic([(texts[i], t) for i, _, t in clear if plain.learns(i, 3, 1)])
    good = plain.Good([(texts[i], q) for i, q, _ in clear if plain.learns(i, 5, 0)])
    for op, model, level, mod, out in ((toxicity.op4, toxic, 0.7, 3, 1), (quality.op6, good, 0.3, 5, 0)):
        rows = op(df, labels).collect()
        assert len(rows) == len(texts) + 2
        found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in rows)
        want = sorted([(False, k, model.score(t)) for k, t in enumerate(texts)] + [(True, 0, model.score("idiot without id")), (False, 5, model.score(texts[5]))])
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert np.allclose([f[2] for f in found], [w[2] for w in want], atol=2e-3)
        assert all(r["predicted"] == (r["score"] >= level) and r["held_out"] == (r["doc_id"] is not None and not plain.learns(r["doc_id"], mod, out)) for r in rows)


def test_sample_is_bounded_by_bytes(spark, docs):
    df = docs([" ".join(f"w{k}x{i}" for i in range(4000)) for k in range(12)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    few, all_of = (toxicity.train(df, labels, toxicity.Settings(epochs=1, most_mb=m)) for m in (0, 64))
    assert not few.share.any() and all_of.share.any()


def test_score_column_must_be_new(docs):
    df = docs(["a"]).withColumnRenamed("lang", "_SCORE")
    for scored in (toxicity.scored, quality.scored):
        with pytest.raises(ValueError):
            scored(df, None)
