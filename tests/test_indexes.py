"""The trigram index and the clustered vector index against plain searches."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import text_index, vector_index, vectors


def test_trigrams(spark):
    rng = random.Random(4)
    letters = ["a", "b", "C", "é", "😀", " ", "%", "_", "ab", "aaa"]
    texts = [(k, None if k % 19 == 0 else "".join(rng.choices(letters, k=rng.randrange(60)))) for k in range(120)]
    needles = [(k, "".join(rng.choices(letters, k=rng.randrange(1, 6)))) for k in range(150)] + [(200, ""), (201, None), (202, "zzz"), (203, "%"), (204, "aaaaa"), (205, texts[5][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame(needles, "n int, needle string")

    def low(t):
        return "".join(c.lower() if c.isascii() else c for c in t)

    def plain(rows):
        return sorted((n, d) for n, needle in needles if needle for d, t in rows if t is not None and low(needle) in low(t))

    known = text_index.index(docs, "doc_id", "text").cache()
    got = text_index.find(known, docs, asked, "doc_id", "text")
    assert got.columns == ["n", "needle", "doc"]
    assert sorted((r["n"], r["doc"]) for r in got.collect()) == plain(texts)
    new = [(3, "Aaab changed"), (7, None), (500, "abC%")]
    rows = [*[r for r in texts if r[0] not in (3, 7)], *new]
    changed = text_index.updated(known, spark.createDataFrame(new, docs.schema), "doc_id", "text")
    got = text_index.find(changed, spark.createDataFrame(rows, docs.schema), asked, "doc_id", "text")
    assert sorted((r["n"], r["doc"]) for r in got.collect()) == plain(rows)
    assert text_index.find(known, docs, asked.limit(0), "doc_id", "text").count() == 0


def test_trigram_postings_are_dealt(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('the same words ', id) as text")
    parts = text_index.index(docs, "doc_id", "text").where(F.col("gram") == int(text_index.grams("the")[0][0])).groupBy("part").count()
    assert parts.count() == text_index.PARTS and parts.agg(F.max("count")).first()[0] < 2000 / text_index.PARTS * 2


def test_the_index_takes_less_than_the_texts(spark, tmp_path):
    """A posting is a block's, not a document's; full blocks of 64, ids of any size and documents that went are found and left as a scan has them."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 8))) for _ in range(400)]
    texts = {(k * 7919 - 2000) * 10**9: " ".join(rng.choices(words, k=rng.randrange(80, 160))) for k in range(2600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    text_index.index(docs, "doc_id", "text").write.parquet(f"{tmp_path}/index")
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert size < 0.8 * sum(map(len, texts.values()))
    known = spark.read.parquet(f"{tmp_path}/index")
    assert known.agg(F.max(F.bit_count("docs"))).first()[0] == 64
    needles = [words[0], f"{words[1]} {words[2]}", "q", "zz", words[3][:3], texts[-2000 * 10**9][5:60], "Q" + words[4]]
    asked = spark.createDataFrame(list(enumerate(needles)), "n int, needle string")

    def plain():
        return sorted((n, d) for n, needle in enumerate(needles) for d, t in texts.items() if needle.lower() in t)

    assert sorted((r["n"], r["doc"]) for r in text_index.find(known, docs, asked, "doc_id", "text").collect()) == plain()
    gone = list(texts)[:300:2]
    known = text_index.updated(known, spark.createDataFrame([(d, None) for d in gone], docs.schema), "doc_id", "text")
    texts = {d: t for d, t in texts.items() if d not in gone}
    docs = spark.createDataFrame(list(texts.items()), docs.schema)
    assert sorted((r["n"], r["doc"]) for r in text_index.find(known, docs, asked, "doc_id", "text").collect()) == plain()
    one = known.where(F.col("gram") == int(text_index.keys(" ")[0]))
    assert one.agg(F.sum(F.bit_count("docs"))).first()[0] == len(texts)


def test_clusters_give_what_a_scan_gives(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((25, 16))
    rows = [(k, (middle[k % 25] + 0.15 * rng.standard_normal(16)).tolist()) for k in range(1500)]
    rows += [(1500 + k, rows[k % 3][1]) for k in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, 2.0]), (2004, [2.0, 1.0]), (2005, [float("nan")] * 16)]
    known = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = known.where("vec_id % 20 = 0 or vec_id >= 2000").selectExpr("vec_id as query_id", "embedding as query")
    index = vector_index.build(known, clusters=40)
    assert index.total == 1562 and index.rows.where("cluster = -1").count() == 2
    want = sorted(map(tuple, vectors.nearest(known, asked, 8).collect()))
    for most in (vectors.MAX_QUERIES, 17):
        scored = spark.sparkContext.accumulator(0)
        assert sorted(map(tuple, vector_index.nearest(index, asked, 8, scored, most).collect())) == want
        assert 0 < scored.value < 0.2 * asked.count() * index.total  # of all pairs
    few = known.limit(5)
    assert sorted(map(tuple, vector_index.nearest(vector_index.build(few), asked, 8).collect())) == sorted(map(tuple, vectors.nearest(few, asked, 8).collect()))
    assert vector_index.nearest(vector_index.build(known.limit(0)), asked, 3).count() == 0


def test_scores_of_a_part_are_held_a_few_at_a_time():
    rng = np.random.default_rng(5)
    unit = lambda n: {8: (np.arange(n), (x := rng.standard_normal((n, 8))) / np.linalg.norm(x, axis=1)[:, None])}
    asked, known = (np.arange(300), unit(300)), unit(vectors.PART)
    tracemalloc.start()
    got = list(vectors._best(asked, np.arange(vectors.PART), known, 8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 300 * 8 and peak < 64 << 20
