"""Queries of exports, probes, providers, schedules and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import refs
from tessera.functions import text as tx
from tessera.operators import catalog, documents, folds, lifecycle
from tessera.plans.registry import query
from tessera.session import table

TIME = "case when {0} >= 3600 then {0} // 3600 || ':' || lpad(cast({0} % 3600 // 60 as varchar), 2, '0') else cast({0} // 60 as varchar) end || ':' || lpad(cast({0} % 60 as varchar), 2, '0')"


def _picked(values: list[str], number) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


@query(f"""with s as (select conv_id, turn + 1 as n, role, turn, turn * 977 as t from conversations),
    l as (select conv_id, string_agg(n || '. [' || role || ' \\] ' || n || '](https://h.example/episodes/' || conv_id || '#t-' || turn || '), ' ||
      case when turn % 4 = 0 then 'summary' when turn % 4 = 1 then '2024-01-0' || turn % 9 when turn % 4 = 2 then 'at ' || {TIME.format('t')} else '2024-01-0' || turn % 9 || ', at ' || {TIME.format('t')} end, chr(10) order by n) as list from s group by conv_id)
    select conv_id, '# On ' || conv_id || chr(10) || chr(10) || 'Body [1]' || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || list || chr(10) as text from l""")
def document_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a written document whose turns are its sources."""
    turns, kind = table(spark, sf_dir, "conversations"), F.col("turn") % 4
    written = turns.select(F.col("conv_id").alias("document")).distinct().select("document", F.concat(F.lit("On "), F.col("document").cast("string")).alias("title"), F.lit("Body [1]").alias("markdown"))
    sources = turns.select(
        F.col("conv_id").alias("document"), (F.col("turn") + 1).alias("n"), F.concat("role", F.lit(" ] "), (F.col("turn") + 1).cast("string")).alias("title"), F.col("conv_id").alias("item"), F.col("turn").alias("seq"),
        F.when(kind == 0, "summary").otherwise("transcript").alias("kind"), F.when(kind > 1, F.col("turn") * 977.0).alias("start"),
        F.when(kind.isin(1, 3), F.concat(F.lit("2024-01-0"), (F.col("turn") % 9).cast("string"))).alias("day"),
    )
    return documents.export(written, sources, "https://h.example").withColumnRenamed("document", "conv_id")


def _transcripts(spark: SparkSession, sf_dir: str, markdown: bool) -> DataFrame:
    turns, n = table(spark, sf_dir, "conversations"), F.col("conv_id")
    items = turns.groupBy("conv_id").agg(F.min("text").alias("summary")).select(
        n.alias("item"), F.concat(F.lit("Talk "), n.cast("string")).alias("title"), F.when(n % 3 > 0, "2024-05-01").alias("day"), F.when(n % 2 == 0, "Ann").alias("speaker"), "summary",
        F.when(n % 4 == 0, "John 3:16").alias("main_reference"), F.when(n % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("topics"), F.array().cast("array<string>").alias("references"),
    )
    chunks = turns.select(n.alias("item"), F.col("turn").alias("seq"), "text", F.when(F.col("turn") % 2 == 1, F.col("turn") * 701.5).alias("start"))
    return documents.export_transcripts(items, chunks, "https://h.example", "Hall", markdown).withColumnRenamed("item", "conv_id")


TURNS = f"t as (select conv_id, turn, trim(text, ' ' || chr(10)) as text, case when turn % 2 = 1 then {TIME.format('cast(floor(turn * 701.5) as bigint)')} end as stamp from conversations)"
ABOUT = "case when conv_id % 3 > 0 then '2024-05-01 · ' else '' end || case when conv_id % 2 = 0 then 'Ann · ' else '' end || 'Hall'"


@query(f"""with {TURNS}, s as (select conv_id, min(text) as summary from conversations group by 1),
    b as (select conv_id, string_agg(case when stamp is null then '' else '**' || stamp || '** ' end || text, chr(10) || chr(10) order by turn) as body from t group by 1)
    select conv_id, replace('# Talk ' || conv_id || '~' || {ABOUT} || '~## Summary~' || trim(summary, ' ' || chr(10)) || case when conv_id % 4 = 0 then '~**Main text:** John 3:16' else '' end || case when conv_id % 5 = 0 then '~**Topics:** a, b' else '' end
      || '~## Transcript~', '~', chr(10) || chr(10)) || body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'From https://h.example/episodes/' || conv_id || chr(10) as text from b join s using (conv_id)""")
def transcript_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir, True)


@query(f"""with {TURNS}, b as (select conv_id, string_agg(case when stamp is null then '' else '[' || stamp || '] ' end || text || chr(10), chr(10) order by turn) as body from t group by 1)
    select conv_id, 'Talk ' || conv_id || chr(10) || {ABOUT} || chr(10) || chr(10) || body || chr(10) || 'From https://h.example/episodes/' || conv_id || chr(10) as text from b""")
def transcript_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir, False)


@query("""select o_orderkey, case when o_orderstatus <> 'F' or o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then 'running' when o_orderkey % 7 = 0 then 'failed' else 'waiting' end as state from orders""")
def redo_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), F.when(n % 3 > 0, "summary").alias("redo"), F.when(n % 5 == 0, "clean").alias("stage"), F.when(n % 7 == 0, "bad").alias("error")
    )
    return rows.select("o_orderkey", lifecycle.redo_state("status", "redo", "stage", "error").alias("state"))


@query("select 'toxic' as what, exists (select 1 from labels where toxic = 1) as found union all select 'none', exists (select 1 from labels where toxic = 7) or exists (select 1 from documents where lang = 'zz')")
def existence_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    some = lifecycle.any_rows(labels.where("toxic = 1"), docs.where("lang = 'zz'")).select(F.lit("toxic").alias("what"), "found")
    return some.union(lifecycle.any_rows(labels.where("toxic = 7"), docs.where("lang = 'zz'")).select(F.lit("none"), "found"))


@query("select doc_id, doc_id in (select doc_id from labels) or doc_id in (select vec_id from embeddings where label % 3 = 0) as found from documents")
def has_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document is in either of two tables."""
    vectors = table(spark, sf_dir, "embeddings").where("label % 3 = 0").select(F.col("vec_id").alias("doc_id"))
    return lifecycle.has_any(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels").select("doc_id"), vectors)


@query("select o_orderkey, c_name, c_mktsegment as role from orders join customer on o_custkey = c_custkey where o_orderdate > timestamp '1996-07-01' and o_orderstatus <> 'F'")
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that last, with their users."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_mktsegment").alias("role"))
    tokens = table(spark, sf_dir, "orders").withColumn("used", F.when(F.col("o_orderstatus") == "F", "x"))
    return lifecycle.unexpired(tokens, users, F.lit("1996-07-01").cast("timestamp"), "o_custkey", "o_orderdate", "used").select("o_orderkey", "c_name", "role")


@query("""with m as (select p_partkey as model, p_brand as provider from part where p_size > 10 and length(p_brand) % 2 = 0)
    select 'anyone' as who, provider, model from m union all select 'limited', provider, model from m where model % 7 = 0""")
def models_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled models of providers with a key, without a limit and with one."""
    part = table(spark, sf_dir, "part")
    models = part.select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("model"), (F.col("p_size") > 10).alias("enabled"))
    providers = part.select(F.col("p_brand").alias("provider"), F.concat(F.lit("slot:"), "p_brand").alias("slot")).distinct()
    keys = providers.where(F.length("provider") % 2 == 0).select("slot", F.lit("1234").alias("last4"))
    free = lifecycle.available_models(models, providers, keys).select(F.lit("anyone").alias("who"), "provider", "model")
    return free.union(lifecycle.available_models(models, providers, keys, models.where("model % 7 = 0")).select(F.lit("limited"), "provider", "model"))


@query("""with e as (select event_id, case when event_id % 3 = 0 then 'p/' || event_id % 8 end as choice, case when event_id % 10 < 9 then 'p/' || event_id % 5 end as wanted, event_id % 4 = 0 as limited,
      case when event_id % 6 = 0 then [] else ['p/1', 'p/' || event_id % 7, 'p/9'] end as fb from events),
    f as (select event_id, case when choice in ('p/1', 'p/3', 'p/4') then choice when wanted in ('p/1', 'p/3', 'p/4') then wanted when limited then 'p/3' end as first, list_filter(fb, lambda x: list_contains(['p/1', 'p/3', 'p/4'], x)) as fb from e)
    select event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as keys from (select event_id, case when first is null then fb else list_prepend(first, fb) end as l from f)""")
def resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice, the default or a limited person's first, then the fallbacks that are available."""
    n = F.col("event_id")
    key = lambda k: F.concat(F.lit("p/"), k.cast("string"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 3 == 0, key(n % 8)).alias("choice"), F.when(n % 10 < 9, key(n % 5)).alias("wanted"), (n % 4 == 0).alias("limited"),
        F.when(n % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p/1"), key(n % 7), F.lit("p/9"))).alias("fallbacks"),
    )
    known = F.array(F.lit("p/3"), F.lit("p/1"), F.lit("p/4"))
    found = lifecycle.targets(F.col("choice"), F.col("wanted"), F.col("fallbacks"), known, F.col("limited"))
    return rows.select("event_id", F.array_join(found, "|").alias("keys"))


@query("""with c as (select doc_id, source, lang, d as published from (select doc_id, source, lang, case when doc_id % 11 > 0 then timestamp '2024-01-01' + to_days(cast(doc_id * 7 % 300 as integer)) end as d from documents)),
    o as (select *, row_number() over (order by published desc nulls last, doc_id) as pos from c), t as (select count(*) as total, strftime(min(published), '%Y-%m-%d') as earliest, strftime(max(published), '%Y-%m-%d') as latest from c)
    select 'series' as kind, source as value, count(*) as n, cast(row_number() over (order by min(pos)) as integer) as rank, any_value(total) as total, any_value(earliest) as earliest, any_value(latest) as latest from o, t where source <> '' group by source
    union all select 'speaker', lang, count(*), cast(row_number() over (order by count(*) desc, lang) as integer), any_value(total), any_value(earliest), any_value(latest) from o, t where lang <> '' group by lang""")
def facet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    published = F.when(n % 11 > 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((n * 7 % 300).cast("int")))
    entries = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", published.alias("published"))
    return catalog.summary_of_facets(entries, {"series": "source", "speaker": "lang"}, "doc_id", "published")


@query(f"""with recursive seg as (select conv_id, row_number() over (partition by conv_id order by turn) as i, turn, text, length(text) as len from conversations),
    step as (select conv_id, i, turn, text, 1 as part, len as size from seg where i = 1
      union all select s.conv_id, s.i, s.turn, s.text, case when p.size + 1 + s.len <= 1200 then p.part else p.part + 1 end, case when p.size + 1 + s.len <= 1200 then p.size + 1 + s.len else s.len end
      from step p join seg s on s.conv_id = p.conv_id and s.i = p.i + 1)
    select conv_id, cast(part as integer) as seq, 'transcript' as kind, string_agg(text, ' ' order by i) as text, min(turn) * 10.0::double as start, max(turn) * 10.0 + 9.5::double as stop from step group by conv_id, part
    union all select conv_id, 0, 'summary', 'About ' || conv_id || case when conv_id % 2 = 0 then chr(10) || 'Main text: John ' || conv_id % 21 else '' end || case when conv_id % 3 = 0 then chr(10) || 'Topics: a, ' || conv_id else '' end
      || case when conv_id % 5 = 0 then chr(10) || 'Scripture: Luke 1' else '' end, null, null from (select distinct conv_id from conversations)""")
def chunks_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as chunk 0, then turns packed with their times."""
    turns, n = table(spark, sf_dir, "conversations"), F.col("conv_id")
    none = F.array().cast("array<string>")
    items = turns.select("conv_id").distinct().select(
        n.alias("item"), F.concat(F.lit("About "), n.cast("string")).alias("summary"), F.when(n % 2 == 0, F.concat(F.lit("John "), (n % 21).cast("string"))).alias("main_reference"),
        F.when(n % 3 == 0, F.array(F.lit("a"), n.cast("string"))).otherwise(none).alias("topics"), F.when(n % 5 == 0, F.array(F.lit("Luke 1"))).otherwise(none).alias("references"),
    )
    segments = turns.select(n.alias("item"), F.col("turn").alias("at"), "text", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 9.5).alias("end"))
    return folds.built_chunks(items, segments).withColumnsRenamed({"item": "conv_id", "end": "stop"})


@query("""with s as (select conv_id, turn, length(text) as len, (count(*) over (partition by conv_id)) // 2 as done from conversations),
    r as (select *, sum(len) over (w rows between unbounded preceding and current row) as total, row_number() over w as i from s where turn >= done window w as (partition by conv_id order by turn))
    select conv_id, min(turn) as first, max(turn) as last, count(*) as n from r where total <= 800 or i = 1 group by conv_id""")
def resume_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next turns to clean up where half are done."""
    w = Window.partitionBy("conv_id")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), F.floor(F.count(F.lit(1)).over(w) / 2).alias("done"))
    return lifecycle.next_batch(turns, ["conv_id"], "turn", "chars", "done", 800)


@query("select o_orderkey from (select * from orders order by o_orderdate desc nulls last, o_orderkey limit 500) where o_orderstatus = 'F' and o_orderpriority like '%URGENT%'")
def limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (F.col("o_orderstatus") == "F") & F.contains("o_orderpriority", F.lit("URGENT"))
    return catalog.limited_then_filtered(table(spark, sf_dir, "orders"), [F.desc_nulls_last("o_orderdate"), "o_orderkey"], 500, keep).select("o_orderkey")


@query("""with f as (select * from orders where o_orderstatus = 'F' and o_orderpriority like '%URGENT%') select o_orderkey, (select count(*) from f) as total from f order by o_orderdate desc nulls last, o_orderkey limit 100 offset 20""")
def filter_then_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (F.col("o_orderstatus") == "F") & F.contains("o_orderpriority", F.lit("URGENT"))
    return catalog.filtered_then_sliced(table(spark, sf_dir, "orders"), [F.desc_nulls_last("o_orderdate"), "o_orderkey"], 20, 100, keep).select("o_orderkey", "total")


@query("""select l_orderkey, l_linenumber, cast(row_number() over (partition by l_suppkey order by case when l_linenumber % 3 > 0 then l_shipdate end nulls first, l_orderkey, l_linenumber) as integer) as number from lineitem""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each owner in the order they are read, undated ones first."""
    rows = table(spark, sf_dir, "lineitem").withColumn("published", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_shipdate")))
    w = Window.partitionBy("l_suppkey").orderBy(*catalog.reading_order("published", "l_orderkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("number"))


@query("""select p_partkey, case when strpos(k, '/') > 1 and strpos(k, '/') < length(k) then left(k, strpos(k, '/') - 1) end as provider, case when strpos(k, '/') > 1 and strpos(k, '/') < length(k) then substr(k, strpos(k, '/') + 1) end as model
    from (select p_partkey, case p_partkey % 5 when 0 then p_brand || '/' || p_name when 1 then '/' || p_name when 2 then p_brand || '/' when 3 then p_name else p_brand || '/a/' || p_partkey end as k from part)""")
def model_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, slash = F.col("p_partkey") % 5, F.lit("/")
    key = F.when(kind == 0, tx.model_key(F.col("p_brand"), F.col("p_name"))).when(kind == 1, F.concat(slash, "p_name")).when(kind == 2, F.concat("p_brand", slash)).when(kind == 3, F.col("p_name"))
    key = key.otherwise(F.concat("p_brand", F.lit("/a/"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.parse_model_key(key).alias("k")).select("p_partkey", "k.provider", "k.model")


@query("""select event_id, case event_id % 8 when 0 then 'no ' || event_type when 1 then 'top ' || event_id when 2 then event_type when 3 then 'more ' || event_id when 4 then '' when 5 then 'plain ' || event_type || ' ' || event_id
    when 6 then '{"code":' || event_id || '}' else 'x' || repeat('y', 239) end as message from events""")
def provider_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What error replies of all shapes say."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    shapes = [
        F.concat(F.lit('{"error": {"message": "no  '), kind, F.lit('", "type": "x"}, "message": "other"}')), F.concat(F.lit('{"message": "top '), n, F.lit('", "error": {"type": "x"}}')),
        F.concat(F.lit('{"error": "'), kind, F.lit('", "detail": "later"}')), F.concat(F.lit('{"detail": " more '), n, F.lit('"}')), F.concat(F.lit(" <html>"), n, F.lit("</html>")), F.concat(F.lit("plain "), kind, F.lit("\n "), n),
        F.concat(F.lit('{"code":'), n, F.lit("}")), F.concat(F.lit('{"message": "x'), F.lit("y" * 400), F.lit('"}')),
    ]
    return table(spark, sf_dir, "events").select("event_id", tx.provider_message(F.get(F.array(*shapes), (F.col("event_id") % 8).cast("int"))).alias("message"))


@query("""select event_id, case when f is null then 'frequency' when w < 0 or w > 6 or event_id % 13 = 0 then 'weekday' when h > 23 then 'hour' when event_id % 5 = 0 then 'zone' end as problem,
      case when f is not null and w between 0 and 6 and event_id % 13 > 0 and h <= 23 and event_id % 5 > 0 then 'Every ' || case when f = 'daily' then 'day' else ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][w + 1] end || ' at ' || lpad(cast(h as varchar), 2, '0') || ':00 America/Chicago' end as described
    from (select event_id, case event_id % 3 when 0 then 'daily' when 1 then 'weekly' end as f, event_id % 9 - 1 as w, event_id % 26 as h from events)""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules checked and described."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.get(F.array(F.lit("daily"), F.lit("weekly"), F.lit("hourly")), (n % 3).cast("int")).alias("f"), F.when(n % 13 == 0, "2.5").otherwise((n % 9 - 1).cast("string")).alias("w"), (n % 26).cast("string").alias("h"),
        F.when(n % 5 == 0, "Mars/Olympus").otherwise("America/Chicago").alias("z"),
    )
    parts = [F.col(c) for c in "fwhz"]
    checked = rows.withColumn("problem", tx.schedule_problem(*parts))
    return checked.select("event_id", "problem", F.when(F.col("problem").isNull(), tx.describe_schedule(parts[0], parts[1].try_cast("int"), parts[2].try_cast("int"), parts[3])).alias("described"))


@query("""with old as (select doc_id as id, lang as author, 'done' as status from documents where doc_id % 3 = 0), new as (select doc_id as id, case when doc_id % 6 = 0 then lang when doc_id % 5 > 0 then source end as author from documents where doc_id % 2 = 0)
    select coalesce(o.id, n.id) as id, case when n.id is null then o.author else n.author end as author, coalesce(o.status, 'queued') as status,
      case when o.id is null then 'added' when n.id is not null and n.author is distinct from o.author then 'refreshed' end as change from old o full join new n on o.id = n.id""")
def recorded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items added, known ones refreshed where an attribute changed."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    old = docs.where("doc_id % 3 = 0").select(n.alias("id"), F.col("lang").alias("author"), F.lit("done").alias("status"))
    new = docs.where("doc_id % 2 = 0").select(n.alias("id"), F.when(n % 6 == 0, F.col("lang")).when(n % 5 > 0, F.col("source")).alias("author"))
    return lifecycle.record_items(old, new, "id", ["author"], ["id"])


@query("""with s as (select conv_id, turn, turn * 10.0 + 5 as start, turn * 10.0 + 14.5 as stop, text from conversations),
    t as (select conv_id, turn, turn * 10.0 + (conv_id * 7 + turn * 5) % 19 - 6 as moment from conversations),
    f as (select t.conv_id, t.turn, moment, s.turn as segment, start, stop, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w,
          row_number() over (partition by t.conv_id, t.turn order by start desc nulls last) as i from t left join s on s.conv_id = t.conv_id and start <= moment),
    k as (select *, case when len(w) > 0 then cast(floor(least(0.999, greatest(0.0, (moment - start) / greatest(0.001, stop - start))) * len(w)) as integer) end as index from f where i = 1)
    select conv_id, turn, start, index, w[index + 1] as word from k""")
def word_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turn is being read at a time, and which of its words; some times come before the first."""
    turns = table(spark, sf_dir, "conversations")
    segments = turns.select("conv_id", (F.col("turn") * 10.0 + 5).alias("start"), (F.col("turn") * 10.0 + 14.5).alias("end"), "text")
    times = turns.select("conv_id", "turn", (F.col("turn") * 10.0 + (F.col("conv_id") * 7 + F.col("turn") * 5) % 19 - 6).alias("at"))
    return folds.spoken(times, segments, ["conv_id"], "at").select("conv_id", "turn", F.col("segment.start").alias("start"), "index", "word")


SLUGS = "(values " + ", ".join(f"({k}, '{n.lower().replace(' ', '-')}', {c})" for k, (_, n, c) in enumerate(refs.BOOKS, 1)) + ") b(number, slug, chapters)"


@query(f"""select event_id, number, '/bible/' || slug || '/' || (event_id % 7 + 1) || case when event_id % 4 > 0 then '#v' || event_id % 4 else '' end as path from events join {SLUGS} on number = event_id % 66 + 1 where event_id % 7 + 1 <= chapters""")
def chapter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to chapters there are, by a book's number."""
    n = F.col("event_id")
    asked = table(spark, sf_dir, "events").select("event_id", (n % 66 + 1).cast("int").alias("number"), (n % 7 + 1).alias("chapter"), (n % 4).alias("verse"))
    known = asked.join(F.broadcast(refs.books(spark)), "number").where("chapter <= chapters")  # 66 rows
    return known.select("event_id", "number", refs.chapter_path(F.col("slug"), F.col("chapter"), F.col("verse")).alias("path"))


@query("""select event_id, case when k in (0, 1, 2, 3) then null when k = 4 then 'Luke ' || event_id % 24 || ':1-2' when k = 5 then 'a.' else left('R' || repeat('x', 120), 100) end as reference
    from (select event_id, event_id % 7 as k from events)""")
def normalized_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [F.lit("Topical"), F.lit("No  main passage;"), F.lit(" ... "), F.lit(None).cast("string"), F.concat(F.lit(" Luke\u00a0"), (F.col("event_id") % 24).cast("string"), F.lit(":1–2.,;")), F.lit("a. ."), F.lit("R" + "x" * 120)]
    return table(spark, sf_dir, "events").select("event_id", tx.normalize_reference(F.get(F.array(*shapes), (F.col("event_id") % 7).cast("int"))).alias("reference"))


@query("""select c_custkey, case c_custkey % 5 when 0 then 'Jo Li' when 1 then c_name when 2 then null when 3 then 'Pastor' else 'Ann ' || c_mktsegment end as speaker from customer""")
def known_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [F.lit("rev. dr.  jo LI"), F.concat(F.lit("Elder "), "c_name"), F.lit(" Not  sure "), F.lit("Pastor"), F.concat(F.lit("Sister  Bro. Ann "), "c_mktsegment")]
    return table(spark, sf_dir, "customer").select("c_custkey", tx.known_speaker(F.get(F.array(*shapes), (F.col("c_custkey") % 5).cast("int")), ["Pastor Jo Li", "Other One"]).alias("speaker"))


@query(f"""select event_id, {"case event_id % 66 " + " ".join(f"when {k} then '{n}'" for k, (_, n, _) in enumerate(refs.BOOKS)) + " end"} || ' ' || (event_id % 9 + 1) || ':' || (event_id % 5 + 1) || case when event_id % 3 > 0 then '-' || (event_id % 5 + 1 + event_id % 3) else '' end as label from events""")
def passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", refs.label((n % 66 + 1).cast("int"), n % 9 + 1, n % 5 + 1, n % 5 + 1 + n % 3).alias("label"))


@query("select o_orderkey as id, case when s in ('failed', 'not_imported') and o_orderkey % 4 <> 0 then 'queued' else s end as status from (select o_orderkey, case o_orderstatus when 'F' then 'done' when 'P' then 'failed' else 'not_imported' end as s from orders)")
def requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed and skipped ones put back into the queue, of those that were picked."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("not_imported")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    return lifecycle.requeue(rows, rows.where("id % 4 <> 0").select("id"), ["failed", "not_imported"])


EFFORTS = [["low", "medium"], ["medium", "high"], ["high", "low"], [], ["high"], None]


@query("""with e as (select event_id, case event_id % 6 when 0 then ['low', 'medium'] when 1 then ['medium', 'high'] when 2 then ['high', 'low'] when 3 then [] when 4 then ['high'] end as takes,
      case event_type when 'error' then 'high' when 'view' then 'medium' when 'click' then 'low' end as wanted, case when value < 60 then 'medium' when value < 120 then 'high' when value < 200 then 'x' end as own from events)
    select event_id, case when list_contains(takes, wanted) then wanted when list_contains(takes, own) then own when list_contains(takes, 'low') then 'low' else takes[1] end as effort from e""")
def fitted_efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted effort fitted to what a model takes and prefers."""
    n = F.col("event_id")
    takes = F.get(F.array(*[F.lit(None).cast("array<string>") if e is None else F.array(*[F.lit(x) for x in e]).cast("array<string>") for e in EFFORTS]), (n % 6).cast("int"))
    kind, v = F.col("event_type"), F.col("value")
    wanted = F.when(kind == "error", "high").when(kind == "view", "medium").when(kind == "click", "low")
    own = F.when(v < 60, "medium").when(v < 120, "high").when(v < 200, "x")
    return table(spark, sf_dir, "events").select("event_id", tx.fit_effort(wanted, takes, own).alias("effort"))


@query("""with s as (select source, lang, min(doc_id) as lo, max(doc_id) as hi, count(*) as n from documents group by source, lang),
    p as (select source, lang, nullif(concat_ws(', ', case when n = 1 then '\u201cText ' || lo || '\u201d' when n < 30 then n || ' chosen sermons' end, 'Series: ' || source, case when hi % 3 > 0 then 'Speaker: ' || lang end,
      case when lo % 3 > 0 and hi % 3 > 0 then lo || ' to ' || hi when lo % 3 > 0 then 'from ' || lo when hi % 3 > 0 then 'up to ' || hi end), '') as said, hi from s)
    select source, lang, case hi % 5 when 0 then 'The Bible' when 1 then coalesce(said, 'All sermons') || ', and the Bible' else coalesce(said, 'All sermons') end as scope from p""")
def scopes_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each series and language holds, as a scope in words."""
    groups = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    lo, hi = F.col("lo"), F.col("hi")
    titles = F.when(F.col("n") == 1, F.array(F.concat(F.lit("Text "), lo.cast("string")))).when(F.col("n") < 30, F.array_repeat(F.lit(None).cast("string"), F.col("n").cast("int")))
    asked = F.when(hi % 5 == 0, "bible").when(hi % 5 == 1, "both").otherwise("sermons")
    day = lambda c: F.when(c % 3 > 0, c.cast("string"))
    return groups.select("source", "lang", tx.describe_scope(asked, titles, F.col("source"), F.when(hi % 3 > 0, F.col("lang")), day(lo), day(hi)).alias("scope"))


@query(f"select doc_id from documents where contains(translate(text, '{tx.UPPER}', '{tx.LOWER}'), 'license') order by doc_id limit 50")
def verse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty matches in the order of the book."""
    return catalog.first_matches(table(spark, sf_dir, "documents"), ["text"], "License", ["doc_id"], 50).select("doc_id")


@query("select o_orderkey, cast(row_number() over (order by o_orderdate nulls first, o_orderkey) as integer) as number from (select * from orders where o_orderstatus = 'P' order by o_orderdate nulls first, o_orderkey limit 300)")
def planner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner lists, oldest first, at most three hundred."""
    order = [F.asc_nulls_first("o_orderdate"), F.asc("o_orderkey")]
    listed = catalog.with_status(table(spark, sf_dir, "orders"), "P", status="o_orderstatus").orderBy(*order).limit(300)
    return listed.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("number"))  # three hundred rows


@query("select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 256")
def pending_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 256 that are not done."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti").orderBy("doc_id").limit(256)
