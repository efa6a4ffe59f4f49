"""Requests, fetching, resumable transcription and idempotent ingest."""

from pyspark.sql import functions as F

from tessera.operators import catalog, folds, lifecycle, providers
from tessera.sources import feeds
from tessera.streaming import usage


def test_read_filters():
    assert catalog.read_filters({}) == {}
    assert catalog.read_filters({"series": [" Luke "], "from": ["2024-01-31"], "id": ["a, b", "a"]}) == {"series": "Luke", "from": "2024-01-31", "ids": ["a", "b"]}
    assert catalog.read_filters({"from": ["soon"]}) == "from must be a day like 2024-01-31"
    assert isinstance(catalog.read_filters({"id": ["a b!"]}), str)
    assert len(catalog.read_filters({"id": [",".join(map(str, range(99)))], "speaker": ["x" * 500]})["ids"]) == 50
    assert [catalog.read_count({"n": [v]}, "n", 8, 20) for v in ("", "5", "20")] == [8, 5, 20]
    assert all(isinstance(catalog.read_count({"n": [v]}, "n", 8, 20), str) for v in ("0", "21", "2.5", "x"))
    assert catalog.read_count({"offset": ["0"]}, "offset", 3, 100) == 0


def test_fetch(spark):
    def fetcher(url, seconds, most):
        if "slow" in url:
            raise TimeoutError
        return (404, b"") if "gone" in url else (200, b"<rss/>" if "big" not in url else b"x" * most)

    urls = ["https://h.example/a", "http://h.example/gone", "ftp://h.example/a", "nonsense", None, "https://slow.example/", "https://big.example/"]
    rows = feeds.fetch(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), fetcher).orderBy("i").collect()
    assert [r["problem"] for r in rows] == [None, "status 404", "not http or https", "not an address", "not an address", "no answer", "too large"]
    assert rows[0]["xml"] == "<rss/>" and rows[6]["xml"] is None


def test_transcription_resumes_and_halves(spark):
    def call(name, start, end):
        if name == "broken" and start >= 200:
            raise ValueError
        if end - start > 100:
            raise TimeoutError
        return [(f"{name} {start:g}", start, end)]

    rows = [("a", 250.0, 0.0, []), ("b", 90.0, 40.0, [("kept", 0.0, 40.0)]), ("broken", 500.0, 0.0, []), ("none", 0.0, 0.0, [])]
    table = spark.createDataFrame(rows, "id string, seconds double, done double, segments array<struct<text:string,start:double,end:double>>").coalesce(1)
    out = {r["id"]: r for r in providers.transcribe_parts(table, call).collect()}
    assert [s["start"] for s in out["a"]["segments"]] == [0, 60, 120, 180, 240] and out["a"]["done"] == 250 and out["a"]["part"] == 60
    assert [s["text"] for s in out["b"]["segments"]] == ["kept", "b 40"] and out["b"]["done"] == 90
    assert out["broken"]["done"] == 240 and out["none"]["segments"] == []


def test_first_import_queues_the_newest(spark):
    new = spark.createDataFrame([("a", 1, "x"), ("b", 3, None), ("c", 2, "y"), ("c", 2, "y"), (None, 9, "z")], "id string, at int, author string")
    old = spark.createDataFrame([], "id string, at int, author string, status string")
    out = {r["id"]: (r["status"], r["change"]) for r in lifecycle.record_items(old, new, "id", ["author"], [F.desc("at")], backfill=2).collect()}
    assert out == {"b": ("queued", "added"), "c": ("queued", "added"), "a": ("not_imported", "added")}


def test_ingest_repeats_nothing(spark, tmp_path):
    """Keys of earlier batches and repeated micro-batches add nothing; rows without a key all come."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "c")], "id int, v string")
    for k in range(3):
        rows.union(spark.createDataFrame([(10 + k, "n")], rows.schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        usage.ingest_new(stream, str(tmp_path / "out"), "id", str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in out.where("id is not null").collect()) == [1, 10, 11, 12]
    assert out.where("id is null").count() == 6


def test_packed_lines(spark):
    docs = spark.createDataFrame([(1, "aa\n\n bb \ncccccc\nd"), (2, ""), (3, None), (4, "x" * 50 + "\ny")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in folds.packed_lines(docs, 9, 1).collect())
    assert rows == [(1, 1, 2, 1, 2, 5, "aa bb"), (1, 2, 2, 3, 4, 8, "cccccc d"), (4, 1, 1, 1, 1, 50, "x" * 50), (4, 2, 1, 2, 2, 1, "y")]
    assert sorted(tuple(r) for r in folds.packed_lines(docs, 9, 1, texts=False).collect()) == [r[:-1] for r in rows]
