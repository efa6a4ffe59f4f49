"""Tables in buckets, batches of several tables, and kept replies."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import buckets, enrich
from tessera.streaming import batches, usage

KIND = "id long, v string, at long"


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_upserts_touch_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.range(200).selectExpr("id", "'old' as v", "0L as at")
    buckets.create(old, path, "id", 16)
    before = files(path)
    new = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (500, "n", 1), (None, "x", 1)], KIND)
    which = buckets.upsert(path, new, "id", 16, "at", gone=spark.createDataFrame([(7,)], "id long"))
    assert 1 <= len(which) <= 3
    changed = {f.split("/")[0] for f in before ^ files(path)}
    assert changed <= {f"{buckets.BUCKET}={b}" for b in which}

    def rows():
        return {r["id"]: r["v"] for r in buckets.read(spark, path, new.schema).collect()}

    want = {k: "old" for k in range(200) if k != 7} | {3: "b", 500: "n"}
    assert rows() == want
    buckets.upsert(path, new, "id", 16, "at", gone=spark.createDataFrame([(7,)], "id long"))
    assert rows() == want
    assert buckets.part(spark, path, new.schema, which)._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [") == 1
    everyone = spark.createDataFrame([(k,) for k in [*range(200), 500]], "id long")
    buckets.upsert(path, new.limit(0), "id", 16, gone=everyone)
    assert rows() == {} and buckets.upsert(path, new.limit(0), "id", 16) == []
    assert buckets.read(spark, f"{tmp_path}/none", new.schema).count() == 0


def test_owners_replaced(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(o, f"{o}-{k}", k) for o in range(20) for k in range(3)], KIND)
    buckets.create(rows, path, "id", 8)
    buckets.replace_owners(path, spark.createDataFrame([(5, "new", 9)], KIND), "id", 8)
    got = buckets.read(spark, path, rows.schema).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {o: 1 if o == 5 else 3 for o in range(20)}


def test_ingest_reads_the_buckets_of_its_keys(spark, tmp_path):
    schema = "id long, v string"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "a") for i in range(12)] + [(None, "b")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        usage.ingest_new(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "id", f"{tmp_path}/cp", 8).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["id"] for r in out.where("id is not null").collect()) == list(range(32))
    assert out.where("id is null").count() == 3
    usage.ingest_new(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "id", f"{tmp_path}/other", 8).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("id is not null").groupBy("id").count().where("count > 1").count() == 0


def test_batches_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], KIND)

    def broken(df):
        return df.withColumn("v", F.raise_error(F.lit("lost")))

    def seen():
        return [sorted(r["id"] for r in batches.read(spark, path, name, rows.schema).collect()) for name in ("one", "two")]

    batches.write({"one": rows, "two": rows.limit(1)}, path, 0)
    assert seen() == [[1, 2], [1]]
    with pytest.raises(Exception, match="lost"):
        batches.write({"one": rows.where("id = 2"), "two": broken(rows)}, path, 1)
    assert seen() == [[1, 2], [1]] and os.path.exists(f"{path}/one/batch=1")
    for _ in range(2):
        batches.write({"one": rows.where("id = 2"), "two": rows}, path, 1)
        assert seen() == [[1, 2, 2], [1, 1, 2]]
    assert batches.read(spark, f"{tmp_path}/none", "one", rows.schema).count() == 0


def test_stream_into_two_tables(spark, tmp_path):
    spark.createDataFrame([(k, "x" * k, k % 2) for k in range(10)], KIND).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")

    def split(rows):
        return {"even": rows.where("at = 0"), "sizes": rows.select("id", F.length("v").alias("n"))}

    batches.run_available(stream, split, f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    assert batches.read(spark, f"{tmp_path}/t", "even", stream.schema).count() == 5
    assert batches.read(spark, f"{tmp_path}/t", "sizes", split(stream)["sizes"].schema).count() == 10


def test_nothing_is_asked_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def chat(prompt):
        if "breaks" in prompt and not (tmp_path / "mended").exists():
            raise RuntimeError("no answer")
        (calls / str(len(list(calls.iterdir())))).write_text(prompt)
        import json
        import re

        found = {n: t.upper() for n, t in re.findall(r"(?m)^(\d+)\. (\w+)", prompt)}
        return "Sure: " + json.dumps({n: t for n, t in found.items() if t != "SKIP"})

    rows = [(k, "breaks" if k == 25 else "skip" if k == 3 else f"w{k}", "mine" if k % 10 == 4 else None, "admin" if k % 10 == 4 else None) for k in range(40)]
    items = spark.createDataFrame(rows, "id long, text string, word string, source string").coalesce(1)

    def run():
        return enrich.enriched(items, "id", F.col("text"), "word", "source", chat, f"file://{tmp_path}/kept", "m", "Words:", 5).orderBy("id").collect()

    with pytest.raises(Exception, match="no answer"):
        run()
    (tmp_path / "mended").touch()
    for _ in range(2):
        got = run()
        assert [(r["word"], r["source"]) for r in got] == [("mine", "admin") if k % 10 == 4 else (None, None) if k == 3 else (t.upper(), "ai") for k, t, _, _ in rows]
        assert len(list(calls.iterdir())) == 8 == len({f.read_text() for f in calls.iterdir()})  # 36 rows in eights of five and one of one
