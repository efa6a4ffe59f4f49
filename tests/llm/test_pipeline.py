"""run() against a pipeline of plain versions, stage by stage, and stages over odd tables."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing
from tests.llm import plain
from tests.llm.test_models import small_corpus
from tests.llm.test_simhash import similar_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    """(doc_id, text) with toxic and bad texts, copies, near copies, an empty text, and rows without text or id."""
    rng = random.Random(5)
    texts = small_corpus()
    words = [f"plain{k}" for k in range(400)]
    long = [" ".join(rng.choices(words, k=150)) + "." for _ in range(6)]
    for t in long:
        near = t.split()
        near[70] = "other"
        texts += [t, t, " ".join(near), t.upper()]
    texts.append(" ".join(rng.choices(words, k=7000)))
    return [*enumerate(texts), (None, "a quiet row without any id by the sea")]


@pytest.fixture
def tables(spark, docs, tmp_path):
    rows = corpus()
    labelled = [(k, int(k % 4 != 0), int(k % 3 == 0)) for k in range(60)] + [(k, 1, 0) for k in range(66, 80)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, {k: (q, t) for k, q, t in labelled}


def judged(rows, labels, which, model, mod, out):
    return model([(t, labels[i][which]) for i, t in rows if i in labels and plain.learns(i, mod, out)])


def plain_stages(rows, labels, duck, full):
    """What each stage but the last keeps, as (doc_id, text) rows."""
    toxic = judged(rows, labels, 1, plain.Toxic, 3, 1)
    scores = [toxic.score(t) for _, t in rows]
    assert min(abs(s - 0.7) for s in scores) > 0.01  # so that rounding decides nothing
    rows = [r for r, s in zip(rows, scores) if s < 0.7]
    yield rows
    good = judged(rows, labels, 0, plain.Good, 5, 0)
    scores = [good.score(t) for _, t in rows]
    assert min(abs(s - 0.3) for s in scores) > 1e-5
    rows = [r for r, s in zip(rows, scores) if s >= 0.3]
    yield rows
    numbers = [(10**6 if i is None else i, t) for i, t in rows]
    kept = similar_components(sorted(numbers), 5, 0.8)
    rows = [r for r, (n, _) in zip(rows, numbers) if n in kept]
    yield rows
    ids = {r[0] for r in rows}
    duck.register("documents", full.where(F.col("doc_id").isin(*[i for i in ids if i is not None]) | (F.col("doc_id").isNull() & F.lit(None in ids))).toArrow())
    times = Counter(r[0] for r in duck.sql(f"select doc_id from ({mixing.op2_sql()})").fetchall())
    yield [r for r in rows for _ in range(times[r[0]])]


def plain_pieces(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(itertools.pairwise(cuts)):
            yield i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def test_run_against_plain_versions(spark, tables, duck):
    sf_dir, rows, labels = tables
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = list(plain_stages(rows, labels, duck, found))
    sizes = [len(w) for w in want]
    assert len(rows) > sizes[0] > sizes[1] > sizes[2]  # every stage has work to do
    for (_, stage), kept in zip(corpus_pipeline.STAGES, want):
        found = corpus_pipeline.materialize(stage(spark, found, sf_dir), "test")
        assert found.columns == COLUMNS
        assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter(kept)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = list(plain_pieces(want[-1]))
    assert Counter(tuple(r[n] for n in names) for r in out) == Counter(pieces)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 2048
    assert len(sequences) <= -(-sum(p[3] for p in pieces) // 2048) + 1


def test_stages_over_odd_tables(spark, tables, docs):
    """Clashing names come through as they are; tables without rows, or with nulls and repeats only, break nothing."""
    sf_dir, rows, _ = tables
    clashing = ["_score", "_epoch", "_doc", "_none", "_id", "_same", "fp", "row", "label", "tokens", "_tokens", "_domain", "_order", "a.b"]
    full = docs(rows[:40]).select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clashing])
    odd = docs([(None, None), (None, None), (3, ""), (3, ""), (3, " \n"), (4, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, full, sf_dir)
        assert out.columns == full.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in clashing)
        assert stage(spark, docs([]), sf_dir).count() == 0
    kept = corpus_pipeline.near_dedup(spark, odd, sf_dir).collect()
    assert [(r["doc_id"], r["text"] or "") for r in kept] in ([(3, "")], [(3, " \n")])
    assert corpus_pipeline.drop_toxic(spark, odd, sf_dir).count() == 6  # without labels of its own every score is 0.5
    assert corpus_pipeline.mix(spark, odd, sf_dir).where("text <> ''").count() >= 0
    assert corpus_pipeline.pack(spark, odd, sf_dir).agg(F.sum("length")).first()[0] >= 6
    assert corpus_pipeline.pack(spark, docs([]), sf_dir).count() == 0


def test_near_dedup_stage_against_brute_force(spark, sf_dir):
    """The stage keeps the smallest doc_id of each component of texts with a Jaccard index of 0.8 or more, 5-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert got == similar_components(rows, 5, 0.8)
