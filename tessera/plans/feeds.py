"""Queries of feeds and replies, read from texts made of the tables' rows."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import refs
from tessera.functions import text as tx
from tessera.operators import tables
from tessera.plans.registry import query
from tessera.session import spread, table
from tessera.sources import archives, feeds
from tessera.streaming import exact


@query("""with o as (select o_orderkey as k, o_orderkey % 6 as v, 'https://cdn.example.org/' || o_orderkey || '.mp3?a=1&b=2' as sound, o_orderstatus as s, o_orderpriority as p, o_orderdate as d from orders)
    select k as feed, case v when 1 then sound when 2 then 'https://h.example/' || k else 'g-' || k end as guid, case when v = 3 then 'Untitled episode' else 'A & B ' || p end as title,
      case when v = 4 then null else strftime(d, '%Y-%m-%d') end as day, case when v <> 2 then sound end as audio_url,
      case v when 0 then 2730.0 when 1 then k % 4000 when 2 then null when 3 then 3600 + k % 60 + 0.5 when 4 then null else (k % 60) * 60.0 end as duration_seconds,
      case v when 5 then null when 2 then 'Sum ' || s when 3 then 'Sub <b>' || s else 'From John on ' || s end as description,
      case v when 0 then 'Jo & ' || s when 1 then 'Dee ' || s when 2 then 'Ann' else null end as author
    from o where v <> 5 or k % 4 <> 3""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of one item for each order, parsed: items differ in what they lack, and some have nothing that names them."""
    k, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    opt = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    named = ~((kind == 5) & (F.col("o_orderkey") % 4 == 3))
    minutes, seconds = (F.col("o_orderkey") % 60).cast("string"), (F.col("o_orderkey") % 4000).cast("string")
    item = F.concat(
        F.lit("<item>"), opt(~kind.isin(1, 2) & named, "<guid isPermaLink='false'>g-", k, "</guid>"), opt(kind == 2, "<link> https://h.example/", k, " </link>"),
        opt(kind != 3, "<title>A &amp; B ", F.col("o_orderpriority"), "</title>"), opt(kind == 3, "<title></title>"),
        F.when(kind == 4, "<pubDate>soon</pubDate>").otherwise(F.concat(F.lit("<pubDate>Sun, "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" 15:00:00 GMT</pubDate>"))),
        opt((kind != 2) & named, '<enclosure length="1" url="https://cdn.example.org/', k, '.mp3?a=1&amp;b=2" type="audio/mpeg"/>'),
        opt(kind == 0, "<itunes:duration>45:30</itunes:duration><itunes:author>Jo &amp; ", F.col("o_orderstatus"), "</itunes:author><author>x</author>"),
        opt(kind == 1, "<itunes:duration>", seconds, "</itunes:duration><dc:creator><![CDATA[ Dee <i>", F.col("o_orderstatus"), "</i> ]]></dc:creator>"),
        opt(kind == 2, "<itunes:duration>1:2:3:4</itunes:duration><author>Ann</author><itunes:summary>Sum ", F.col("o_orderstatus"), "</itunes:summary>"),
        opt(kind == 3, "<itunes:duration>1::", minutes, ".5</itunes:duration><description></description><itunes:subtitle>Sub &amp;lt;b&amp;gt;", F.col("o_orderstatus"), "</itunes:subtitle>"),
        opt(kind == 4, "<itunes:duration>long</itunes:duration>"), opt(kind == 5, "<itunes:duration>", minutes, ":</itunes:duration>"),
        opt(kind.isin(0, 1, 4), "<description><![CDATA[<p>From  <b>John</b> on ", F.col("o_orderstatus"), "</p>]]></description>"), F.lit("</item>"),
    )
    xml = F.concat(F.lit("<rss><channel><title>Feed</title>"), item, F.lit("</channel></rss>"))
    rows = feeds.parse_feed(spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("feed"), xml.alias("xml")))
    return rows.select("feed", "guid", "title", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "audio_url", "duration_seconds", "description", "author")


KINDS = ["audio/mp4; q=1", "audio/ogg", "audio/flac", "text/html", "audio/mpeg", "AUDIO/WAV"]


@query(f"""with u as (select page_id, case page_id % 9 when 0 then url when 1 then 'https://x.example/a.MP3?x=1' when 2 then 'https://x.example/' || page_id || '.opus#t' when 3 then 'https://x.opus' when 4 then 'https://x.example/a.flac'
        when 5 then 'https://x.example/v1.mp4' when 6 then 'https://x.example/mp3' when 7 then 'https://x.example/a.wav/b' else 'https://x.example/' || page_id || '.b.Aac' end as u,
        case page_id % 6 {" ".join(f"when {k} then '{t}'" for k, t in enumerate(KINDS))} end as t from pages),
    e as (select page_id, t, lower(regexp_extract(regexp_extract(u, '^[^:/?#]+://[^/?#]*(/[^?#]*)', 1), '\\.([A-Za-z0-9]{{2,4}})$', 1)) as e from u)
    select page_id, case when e in ('mp3', 'm4a', 'mp4', 'aac', 'wav', 'ogg', 'opus') then e when starts_with(t, 'audio/mpeg') then 'mp3' when starts_with(t, 'audio/mp4') then 'm4a' when starts_with(t, 'audio/aac') then 'aac'
        when starts_with(t, 'audio/wav') then 'wav' when starts_with(t, 'audio/ogg') then 'ogg' else 'mp3' end as ext from e""")
def audio_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key = F.col("page_id") % 9, F.col("page_id").cast("string")
    fixed = {1: "https://x.example/a.MP3?x=1", 3: "https://x.opus", 4: "https://x.example/a.flac", 5: "https://x.example/v1.mp4", 6: "https://x.example/mp3", 7: "https://x.example/a.wav/b"}
    url = F.when(kind == 0, F.col("url")).when(kind == 2, F.concat(F.lit("https://x.example/"), key, F.lit(".opus#t"))).when(kind == 8, F.concat(F.lit("https://x.example/"), key, F.lit(".b.Aac")))
    for k, u in fixed.items():
        url = url.when(kind == k, F.lit(u))
    given = F.get(F.array(*[F.lit(t) for t in KINDS]), (F.col("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", tx.audio_extension(url, given).alias("ext"))


@query("select conv_id, turn, trim(text) as text, cast(turn as double) as start, cast(turn + 1.5 as double) as stop from conversations where trim(text) <> ''")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a speech service with one good, one blank and one mistyped segment."""
    good = F.struct(F.concat(F.lit(" "), "text").alias("text"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.5).cast("double").alias("end"))
    reply = F.concat(F.lit('{"segments": ['), F.to_json(good), F.lit(', {"text": " ", "start": 1, "end": 2}, {"text": 7, "start": 1, "end": 2}]}'))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(feeds.reply_segments(reply)).alias("s"))
    return rows.select("conv_id", "turn", tx.full_trim("s.text").alias("text"), "s.start", F.col("s.end").alias("stop"))


@query("""select event_id, cast(case event_id % 10 when 0 then event_id when 1 then (event_id % 90) * 60 + event_id % 60 + 0.25 when 2 then 3600 + event_id % 60 when 3 then 3600.0 * (event_id % 5) + 60 * (event_id % 60) + event_id % 60
    when 7 then event_id * 100 when 9 then 60 * (event_id % 60) end as double) as seconds from events""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of all shapes, good and bad."""
    n = F.col("event_id")
    part = lambda most: (n % most).cast("string")
    shapes = [
        n.cast("string"), F.concat(part(90), F.lit(":"), part(60), F.lit(".25")), F.concat(F.lit(" 1::"), part(60)), F.concat(part(5), F.lit(":"), part(60), F.lit(" : "), part(60)), F.concat(F.lit("-"), n.cast("string"), F.lit("1")),
        F.concat(part(5), F.lit(":1:2:3")), F.lit(""), F.concat(n.cast("string"), F.lit("e2")), F.concat(n.cast("string"), F.lit(" min")), F.concat(part(60), F.lit(":")),
    ]
    return table(spark, sf_dir, "events").select("event_id", tx.duration_seconds(F.get(F.array(*shapes), (n % 10).cast("int"))).alias("seconds"))


@query("select r_regionkey as id, r_name as name from region")
def bulk_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sent as one JSON list per row."""
    json = F.to_json(F.array(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))))
    return feeds.bulk_rows(table(spark, sf_dir, "region").select(json.alias("json")), "json", "id int, name string")


#: Documents of an archive, about.
ARCHIVED = 2048


def _zipped(docs: DataFrame, path: str) -> None:
    """Writes documents as zip archives, one a task, each text a member; and an archive that is damaged."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with _created(path, f"{TaskContext.get().partitionId()}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:  # the same name when a task is repeated
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    z.writestr(f"{doc}.txt", text or "")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    docs = docs.select("doc_id", "text")
    docs.repartition(max(8, -(-docs.count() // ARCHIVED)), "doc_id").mapInArrow(pack, "n long").agg(F.sum("n")).first()
    _put(path, "damaged.zip", b"PK but no archive")


def _created(path: str, name: str) -> pa.NativeFile:
    store, base = archives.opened(path)
    store.create_dir(base, recursive=True)
    return store.open_output_stream(f"{base}/{name}")


def _put(path: str, name: str, data: bytes) -> None:
    with _created(path, name) as f:
        f.write(data)


@query("""with l as (select doc_id, string_split(text, chr(10)) as lines from documents),
    n as (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from l),
    a as (select doc_id, i, len(lines) as total, lines[i] as line, sum(strlen(lines[i]) + 1) over (partition by doc_id order by i rows between unbounded preceding and current row) - strlen(lines[i]) - 1 as begins from n)
    select doc_id, cast(begins as bigint) as begins, rtrim(line, chr(13)) as text from a where i < total or line <> ''""")
def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' lines, read back from zip archives."""
    archives.register(spark)
    path = tables.new_path(spark, "archives")
    _zipped(table(spark, sf_dir, "documents"), path)
    rows = spark.read.format("archive_lines").option("path", path).option("range", 1 << 20).load()
    return rows.select(F.regexp_extract("member", "^(-?[0-9]+)", 1).cast("long").alias("doc_id"), F.col("at").alias("begins"), "text")


@query("select source as feed, 'g' || doc_id as guid, lang as title from documents")
def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each source, read as a stream when half of its documents were out, and again when all were."""
    archives.register(spark)
    path, out, progress = (tables.new_path(spark, n) for n in ("feeds", "items", "progress"))
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    item = F.concat(F.lit("<item><guid>g"), F.col("doc_id").cast("string"), F.lit("</guid><title>"), F.coalesce("lang", F.lit("")), F.lit("</title></item>"))

    def write(rows: pa.Table) -> pa.Table:
        body = "".join(rows["item"].to_pylist())
        _put(path, f"{rows['source'][0].as_py()}.xml", f"<rss><channel><title>t</title>{body}</channel></rss>".encode())
        return pa.table({"n": pa.array([rows.num_rows], pa.int64())})

    for early in (docs.where("doc_id % 2 = 0"), docs):
        early.select("source", item.alias("item")).groupBy("source").applyInArrow(write, "n long").agg(F.sum("n")).first()
        stream = spark.readStream.format("feed_files").option("path", path).option("changed", True).load()
        exact.run_available(stream.dropDuplicates(["feed", "guid"]), out, progress).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select(F.regexp_extract("feed", "([^/]+)[.]xml$", 1).alias("feed"), "guid", F.regexp_extract("item", "<title>([^<]*)</title>", 1).alias("title"))


CODES = [code for code, _, _ in refs.BOOKS]


@query("""select cast(conv_id % 66 + 1 as integer) as book, cast(turn + 1 as integer) as chapter, cast(conv_id // 66 + 1 as integer) as verse, trim(replace(text, chr(10), ' ')) as text
    from conversations where trim(replace(text, chr(10), ' ')) <> ''""")
def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of a verse file, and lines that are none."""
    turns = table(spark, sf_dir, "conversations")
    place = F.concat_ws(" ", F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("conv_id") % 66).cast("int")), F.concat((F.col("turn") + 1).cast("string"), F.lit(":"), F.floor(F.col("conv_id") / 66 + 1).cast("string")))
    good = turns.select(F.concat_ws(" ", place, F.regexp_replace("text", "\\n", " ")).alias("value"))
    bad = turns.select(F.concat(F.lit("XXX 1:1 "), F.regexp_replace("text", "\\n", " ")).alias("value"))
    return feeds.parse_verses(spark, good.union(bad)).select("book", "chapter", "verse", "text")


@query("""select conv_id, cast(turn * 2.5 + 0.25 as double) as start, cast(greatest(turn * 2.5 + 0.25, turn * 2.5 + (turn % 3) * 1.125) as double) as stop, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations where turn % 5 <> 4
    union all select conv_id, 0.25, 12.75, 'all of ' || conv_id from (select conv_id, count(*) filter (turn % 5 <> 4) as n from conversations group by 1) where n = 0""")
def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as replies with turns in milliseconds, some without times."""
    ms = lambda c: F.when(F.col("turn") % 5 != 4, c.cast("long"))
    turn = F.struct(ms(F.col("turn") * 2500).alias("startMs"), ms(F.col("turn") * 2500 + (F.col("turn") % 3) * 1125 - 250).alias("endMs"), F.col("text").alias("transcript"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    found = whole.select("conv_id", F.explode(feeds.turn_segments("turns", F.concat(F.lit("all of "), F.col("conv_id").cast("string")), F.lit(0.25), F.lit(12.5))).alias("s"))
    return found.select("conv_id", "s.start", F.col("s.end").alias("stop"), "s.text")

