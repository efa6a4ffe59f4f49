"""Queries of changing tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import buckets, enrich, lifecycle, tables
from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming import batches


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def semi_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity >= 5)")
def anti_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").where("l_quantity >= 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(kept, "o_orderkey", "left_anti")


@query("select distinct doc_id as id from documents where doc_id not in (select doc_id from labels)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return lifecycle.insert_missing(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), new, ["id"])


@query("""select c_custkey as id, coalesce(latest, 'none') as status, coalesce(seen, -1) as seen from customer left join (
    select o_custkey, arg_max(o_orderstatus, o_orderkey) as latest, max(o_orderkey) as seen from orders group by 1) on o_custkey = c_custkey""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("none").alias("status"), F.lit(-1).cast("long").alias("seen"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seen"))
    return lifecycle.upsert(old, new, ["id"], "seen").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi")


@query("""select conv_id, turn, role from conversations where conv_id % 3 <> 0 union all select conv_id, turn, 'new' from conversations where conv_id % 3 = 0 and turn < 2""")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    new = old.where("conv_id % 3 = 0 and turn < 2").withColumn("role", F.lit("new"))
    return lifecycle.replace_partition(old, new, "conv_id")


@query("select conv_id * 100 + turn as key from conversations where conv_id % 3 = 0 and turn >= 2")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("key"), "turn")
    return lifecycle.stale_keys(old, old.where("conv_id % 3 = 0 and turn < 2"), "conv_id", "key")


@query("""with o as (select o_orderkey as id, case when o_orderstatus = 'F' then 'done' when o_orderkey % 97 = 0 then 'running' when o_orderstatus = 'P' then 'queued' else 'failed' end as s, o_orderdate from orders),
    r as (select count(*) filter (s = 'running') as n from o),
    q as (select *, row_number() over (partition by s order by o_orderdate desc nulls last, id) as rn from o)
    select id, case when s = 'queued' and rn <= greatest(0, 150 - r.n) then 'running' else s end as status from q, r""")
def claim_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 150 orders run at once; what runs already takes its places."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 97 == 0, "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("failed")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), "o_orderdate")
    return lifecycle.claim(rows, [F.desc_nulls_last("o_orderdate"), "id"], 150).select("id", "status")


@query("""with o as (select o_orderkey as id, case when o_orderstatus = 'F' then 'done' when o_orderkey % 7 = 0 then 'running' else 'queued' end as s, o_orderdate, o_orderkey % 3 as k from orders),
    e as (select *, case when s = 'running' and k < 2 then case k when 0 then 'done' else 'failed' end else s end as t from o),
    r as (select count(*) filter (s = 'running') as most, count(*) filter (t = 'running') as n from e),
    q as (select *, row_number() over (partition by t order by o_orderdate desc nulls last, id) as rn from e)
    select id, case when t = 'queued' and rn <= most - n then 'running' else t end as status from q, r""")
def next_on_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that end hand their places to the next in the queue."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 7 == 0, "running").otherwise("queued")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), "o_orderdate")
    ended = rows.where("status = 'running' and id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "done").otherwise("failed").alias("outcome"))
    most = rows.where("status = 'running'").count()
    return lifecycle.finish(rows, ended, [F.desc_nulls_last("o_orderdate"), "id"], most).select("id", "status")


@query("""select l_orderkey, l_linenumber, case when late then 'failed' else s end as status, case when late then coalesce('stopped: ' || e, 'stopped') else e end as error from (
    select *, s = 'running' and l_shipdate < timestamp '1996-01-01' as late from (select *, case l_linestatus when 'O' then 'running' else 'done' end as s, case when l_linenumber % 2 = 0 then l_returnflag end as e from lineitem))""")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that stopped reporting fail, with the error there was."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "running").otherwise("done").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("error"),
    )
    return lifecycle.fail_stale(rows, F.lit("1996-01-01 06:00:00").cast("timestamp")).select("l_orderkey", "l_linenumber", "status", "error")


@query("""select o_orderkey, list_element(['transcribe', 'rewrite', 'summary', 'index'], least(o_orderkey % 4 + 1, case when o_orderstatus = 'F' then 2 else 3 end)) as redo,
    list_element(['transcribe', 'rewrite', 'summary', 'index'], o_orderkey % 4 + 2) as next from orders""")
def redo_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array(*[F.lit(s) for s in lifecycle.STEPS])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.get(steps, (F.col("o_orderkey") % 4).cast("int")).alias("step"))
    wanted = F.when(F.col("o_orderstatus") == "F", "rewrite").otherwise("summary")
    return rows.select("o_orderkey", lifecycle.earliest_step("step", wanted).alias("redo"), lifecycle.next_step("step").alias("next"))


@query("select l_orderkey, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by 1")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    kept = lifecycle.cascade(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), removed, "l_suppkey", "s_suppkey")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, case when n_regionkey = 1 then null else c_nationkey end as c_nationkey from customer left join nation on n_nationkey = c_nationkey")
def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    return lifecycle.detach(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), removed, "c_nationkey", "n_nationkey")


@query("select a.doc_id, 1 - quality as quality from labels a where a.doc_id % 7 = 0 union all select doc_id, null from labels where doc_id % 7 = 1")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = old.withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).when(F.col("doc_id") % 7 == 1, None).otherwise(F.col("quality")))
    return lifecycle.changed(old, new, "doc_id", ["quality"])


@query("""select doc_id, case when quality is null then lang when toxic = 1 then 'admin' else source end as speaker,
    case when quality is null then 'ai' else 'admin' end as speaker_source from documents left join labels using (doc_id)""")
def speaker_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer fills only what no administrator decided."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    decided = F.when(F.col("quality").isNotNull(), F.when(F.col("toxic") == 1, "admin").otherwise(F.col("source")))
    rows = joined.select("doc_id", "lang", decided.alias("speaker"), F.when(F.col("quality").isNotNull(), "admin").alias("speaker_source"))
    value, source = lifecycle.override("speaker", "speaker_source", F.col("lang"), "ai")
    return rows.select("doc_id", value.alias("speaker"), source.alias("speaker_source"))


@query("""select * from (select n_regionkey, n_nationkey, cast(row_number() over (partition by n_regionkey order by n_nationkey) as integer) as rank from nation where n_nationkey % 4 <> 0) where rank <= 3""")
def fallback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.resolve(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], "n_nationkey", "n_nationkey % 4 <> 0", 3)


@query("""with recursive n as (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || case p_partkey % 5 when 1 then '-2' when 2 then '-' || (p_partkey % 4 + 1) when 3 then '-with-a-name-that-is-rather-long' else '' end as s from part),
    t as (select *, regexp_replace(left(s, 26), '(-[0-9]*)+$', '') as stem from n), p as (select *, row_number() over (partition by stem order by p_partkey) as i from t),
    r as (select p_partkey, stem, i, s as slug, ['llm', s] as taken from p where i = 1
      union all select p_partkey, stem, i, slug, list_append(taken, slug) from (
        select p.p_partkey, p.stem, p.i, r.taken, case when list_contains(r.taken, p.s) then left(p.s, 26) || '-' || list_filter(range(2, len(r.taken) + 3), lambda k: not list_contains(r.taken, left(p.s, 26) || '-' || k))[1] else p.s end as slug
        from r join p on p.stem = r.stem and p.i = r.i + 1))
    select p_partkey, slug from r""")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs with many repeats, some of which look like counted ones."""
    from tessera.functions import text as tx

    kind = F.col("p_partkey") % 5
    number = F.concat(F.lit("-"), (F.col("p_partkey") % 4 + 1).cast("string"))
    name = F.concat(tx.slug("p_name"), F.when(kind == 1, "-2").when(kind == 2, number).when(kind == 3, "-with-a-name-that-is-rather-long").otherwise(""))
    return lifecycle.unique_slugs(table(spark, sf_dir, "part").select("p_partkey", name.alias("slug")), "slug", ["p_partkey"], ("llm",))


@query("select cast((row_number() over (order by doc_id) - 1) // 10 as integer) as batch, count(*) over () as total, doc_id from (select doc_id from labels where toxic = 1 order by doc_id limit 60)")
def enrichment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 60 items in numbered batches of ten."""
    due = table(spark, sf_dir, "labels").where("toxic = 1").orderBy("doc_id").limit(60).select("doc_id")
    batch = F.floor((F.row_number().over(Window.orderBy("doc_id")) - 1) / 10).cast("int")
    return due.withColumn("batch", batch).join(F.broadcast(due.agg(F.count(F.lit(1)).alias("total"))))


@query("""with n as (select o_custkey, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as seen from orders where o_custkey % 5 < 2 group by 1)
    select c_custkey as id, coalesce(status, 'none') as status, coalesce(seen, -1) as seen from customer left join n on o_custkey = c_custkey where c_custkey % 7 <> 3""")
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets after the newest orders of some customers came and others went; a second time changes nothing."""
    path, customers = tables.new_path(spark, "upserted"), table(spark, sf_dir, "customer")
    buckets.create(customers.select(F.col("c_custkey").alias("id"), F.lit("none").alias("status"), F.lit(-1).cast("long").alias("seen")), path, "id", 16)
    orders = table(spark, sf_dir, "orders").where("o_custkey % 5 < 2").join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    new = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seen"))
    for _ in range(2):
        buckets.upsert(path, new, "id", 16, "seen", gone=customers.where("c_custkey % 7 = 3").select(F.col("c_custkey").alias("id")))
    return buckets.read(spark, path, new.schema)


@query("""select vec_id, case when vec_id % 10 = 4 then label + 100 else label end as label, case when vec_id % 10 = 4 then cast(-embedding[1] as double) else cast(embedding[1] as double) end as first from embeddings where vec_id % 10 <> 6""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in buckets after some were replaced and some deleted."""
    path, known = tables.new_path(spark, "vectors"), table(spark, sf_dir, "embeddings")
    buckets.create(known, path, "vec_id", 16)
    new = known.where("vec_id % 10 = 4").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), (F.col("label") + 100).alias("label"))
    buckets.upsert(path, new.select(known.columns), "vec_id", 16, gone=known.where("vec_id % 10 = 6").select("vec_id"))
    return buckets.read(spark, path, known.schema).select("vec_id", "label", F.get("embedding", 0).cast("double").alias("first"))


@query("""select o_orderkey, o_orderstatus = 'O' and (epoch_us(timestamp '1998-12-01') - epoch_us(o_orderdate)) / 3600000000.0 > case o_orderkey % 4 when 0 then 6 when 1 then 2 when 2 then 1 / 3.0 else 0.25 end * 24 * 365 as stopped from orders""")
def stopped_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work of four kinds with limits of their own, an hour of which is a year here."""
    kinds = F.get(F.array(*[F.lit(k) for k in lifecycle.STALE_HOURS]), (F.col("o_orderkey") % 4).cast("int"))
    now, old = F.unix_micros(F.lit("1998-12-01").cast("timestamp")), F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    quick = F.timestamp_micros(((now - (now - old) / (24 * 365))).cast("long"))  # a year's silence as an hour's
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kinds.alias("kind"), F.when(F.col("o_orderstatus") == "O", F.concat(kinds, F.lit(" goes on"))).otherwise("done").alias("status"), quick.alias("updated"))
    words = {k: f"{k} goes on" for k in lifecycle.STALE_HOURS}
    return rows.select("o_orderkey", lifecycle.stopped("kind", "status", F.col("updated"), F.lit("1998-12-01").cast("timestamp"), words).alias("stopped"))


def _second_words(prompt: str) -> str:
    """A stand-in for a model: the second word of each numbered line, none where there is none."""
    lines = [line.split(". ", 1) for line in prompt.split("\n")[1:]]
    return "Here: " + json.dumps({n: text.split(" ")[1] for n, text in lines if len(text.split(" ")) > 1})


OPENING = "regexp_replace(substr(text, 1, 60), '[^A-Za-z]+', ' ', 'g')"


@query(f"""with d as (select doc_id, case when doc_id in (select doc_id from labels) then 'label' end as set_by, string_split({OPENING}, ' ') as w from documents)
    select doc_id, case when set_by is not null then 'kept' when len(w) > 1 then w[2] end as word, case when set_by is not null then set_by when len(w) > 1 then 'ai' end as source from d""")
def enriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says of each document's opening, but for those that have a label: asked in batches, the replies kept, asked again for nothing."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("source")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    items = docs.select("doc_id", F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z]+", " ").alias("line"), F.when(F.col("source").isNotNull(), "kept").alias("word"), "source")
    kept = tables.new_path(spark, "replies")
    out = enrich.enriched(items, "doc_id", F.col("line"), "word", "source", _second_words, kept, "stand-in", "Second words:")
    return out.select("doc_id", "word", "source")


@query("select 'even' as name, doc_id as id from documents where doc_id % 2 = 0 union all select 'long', doc_id from documents where length(text) > 1000")
def batches_of_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream into two tables that are written as one; a batch without its marker is not seen."""
    path, source = tables.new_path(spark, "marked"), tables.new_path(spark, "arriving")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    docs.repartition(3, "doc_id").write.parquet(source)
    split = lambda rows: {"even": rows.where("doc_id % 2 = 0").select("doc_id"), "long": rows.where("n > 1000").select("doc_id")}
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches.run_available(stream, split, path, tables.new_path(spark, "progress")).awaitTermination()
    docs.select("doc_id").write.parquet(f"{path}/even/batch=99")  # what a lost batch leaves
    found = [batches.read(spark, path, name, docs.select("doc_id").schema).select(F.lit(name).alias("name"), F.col("doc_id").alias("id")) for name in ("even", "long")]
    return found[0].union(found[1])

