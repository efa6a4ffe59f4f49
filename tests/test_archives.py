"""Lines of zip archives in ranges, and streams of feeds that go on where they ended."""

import io
import random
import zipfile

from tessera.sources import archives
from tessera.streaming import exact


def zipped(files: dict[str, bytes], way=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", way) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def lines(data: bytes):
    at, out = 0, []
    for line in data.splitlines(keepends=True) if b"\r" not in data.replace(b"\r\n", b"") else []:
        out.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
        at += len(line)
    return out


def test_archives(spark, tmp_path):
    archives.register(spark)
    rng = random.Random(3)
    files, want = {}, []
    for a in range(6):
        members = {f"m{m}.{'txt' if m % 3 else 'bin'}": b"".join(rng.choice([b"", b"a line", "é long".encode() * rng.randrange(40), b"\xff odd"]) + rng.choice([b"\n", b"\r\n"]) for _ in range(rng.randrange(60))) + rng.choice([b"", b"no end"]) for m in range(4)}
        path = tmp_path / f"{a}.zip"
        path.write_bytes(zipped(members))
        files[a] = members
        want += [(str(path), m, at, text) for m, data in members.items() if m.endswith(".txt") for at, text in lines(data)]
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    (tmp_path / "cut.zip").write_bytes(zipped({"x.txt": b"a\nb\n"})[:40])
    (tmp_path / "other.txt").write_bytes(b"no archive\n")
    for size in (str(64 << 20), "300", "37"):
        df = spark.read.format("archive_lines").option("path", f"file://{tmp_path}").option("range", size).load()
        assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.rdd.getNumPartitions() > 30
    assert spark.read.format("archive_lines").option("path", str(tmp_path / "none")).load().count() == 0


def test_small_members_of_a_large_archive_share_tasks(spark, tmp_path):
    archives.register(spark)
    members = {f"m{m}.txt": b"line\n" * (m % 4) + b"some words of a line" * (m % 50 == 7) * 30 for m in range(400)}
    path = tmp_path / "many.zip"
    path.write_bytes(zipped(members, zipfile.ZIP_STORED).replace(members["m1.txt"] + b"PK", b"LINE\n" + b"PK", 1))  # m1 is damaged
    df = spark.read.format("archive_lines").option("path", str(tmp_path)).option("range", "500").load()
    want = sorted((m, at, text) for m, data in members.items() if m != "m1.txt" for at, text in lines(data))
    assert sorted(r[1:] for r in map(tuple, df.collect()) if r[1] != "m1.txt") == want
    assert 8 <= df.rdd.getNumPartitions() < 40
    whole = spark.read.format("archive_lines").option("path", str(tmp_path)).load()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.collect()))


def feed(*items):
    return ("<rss><channel><title>t</title>" + "".join(f"<item><guid>{g}</guid><title>{t}</title></item>" for g, t in items) + "</channel></rss>").encode()


def test_feed_stream_reads_what_is_new(spark, tmp_path):
    archives.register(spark)
    folder = tmp_path / "feeds"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("feed_files").option("path", str(folder)).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["guid"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.xml").write_bytes(feed(("a1", "x"), ("a2", "y"), ("a2", "again")))
    (folder / "b.xml").write_bytes(b"no feed")
    assert run() == ["a1", "a2"]
    assert run() == ["a1", "a2"]
    (folder / "a.xml").write_bytes(feed(("a3", "new"), ("a1", "x"), ("a2", "y")))
    (folder / "b.xml").write_bytes(feed(("b1", "z")))
    assert run() == ["a1", "a2", "a3", "b1"]
    reader = archives.FeedReader({"path": str(folder), "most": "1"})
    first, seen = reader.read(reader.initialOffset())
    second, end = reader.read(seen)
    assert [len(list(first)), len(list(second))] == [3, 1]
    assert [r[1] for r in reader.readBetweenOffsets(seen, end)] == ["b1"] and len(list(reader.readBetweenOffsets(reader.initialOffset(), end))) == 4


def test_feed_stream_reads_all_of_large_feeds(spark, tmp_path):
    """A run over what is there ends with one micro-batch; feeds of more items than the driver takes at once come whole."""
    archives.register(spark)
    folder = tmp_path / "feeds"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("feed_files").option("path", str(folder)).option("changed", True).option("most", 5).load()
        exact.run_available(stream.dropDuplicates(["feed", "guid"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r["guid"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for f in "abc":
        (folder / f"{f}.xml").write_bytes(feed(*((f"{f}{k}", "x") for k in range(9))))
    assert run() == run() == [f"{f}{k}" for f in "abc" for k in range(9)]
    (folder / "b.xml").write_bytes(feed(*((f"b{k}", "y") for k in range(3, 12))))
    assert run() == sorted([f"{f}{k}" for f in "abc" for k in range(9)] + ["b9", "b10", "b11"])
