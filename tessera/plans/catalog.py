"""Queries of the catalogue. Orders stand for episodes, documents for texts with a source and a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import catalog, tables, text_index
from tessera.plans.registry import query
from tessera.session import table

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query(f"select doc_id, source from documents where contains({FOLD.format('text')}, 'the and') or contains({FOLD.format('source')}, 'the and')")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keyword_search(table(spark, sf_dir, "documents"), ["text", "source"], "The AND").select("doc_id", "source")


@query("select doc_id from documents where contains(text, '%') or contains(text, '_')")
def keyword_search_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards of other engines are plain characters here."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(tx.any_contains(["text"], "%") | tx.any_contains(["text"], "_")).select("doc_id")


NEEDLES = "select item_id, 0 as kind, array_to_string(string_split(text, ' ')[3:4], ' ') as needle from benchmark union all select item_id, 1, substr(text, 7, 40) from benchmark union all select item_id, 2, string_split(text, ' ')[1] || '%' from benchmark union all select item_id, 3, upper(substr(text, 1 + item_id % 5, 2)) from benchmark union all select item_id, 4, upper(substr(text, 20, 3)) || '_' from benchmark"


@query(f"""with n as materialized (select item_id, kind, needle, {FOLD.format('needle')} as low from ({NEEDLES})), d as materialized (select doc_id, {FOLD.format('text')} as text from documents)
    select item_id, kind, needle, doc_id from n join d on length(needle) > 0 and contains(text, low)""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words, a passage, a word with a percent sign, two letters and three letters with an underscore of each benchmark text, in all documents, by an index of trigrams."""
    words, item = F.split("text", " "), F.col("item_id")
    ways = [F.array_join(F.slice(words, 3, 2), " "), F.substring("text", 7, 40), F.concat(F.get(words, 0), F.lit("%")), tx.upper_each(F.substr("text", item % 5 + 1, F.lit(2))), F.concat(tx.upper_each(F.substring("text", 20, 3)), F.lit("_"))]
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(*ways)).alias("kind", "needle"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = tables.written(text_index.index(docs, "doc_id", "text"), "trigrams")
    return text_index.find(known, docs, needles, "doc_id", "text").withColumnRenamed("doc", "doc_id")


@query("select o_orderkey from orders where starts_with(strftime(o_orderdate, '%Y-%m-%d'), '1995-0') or contains(lower(o_orderpriority), 'urgent')")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = F.startswith(catalog.day("o_orderdate"), F.lit("1995-0"))
    return _orders(spark, sf_dir).where(F.coalesce(dated, F.lit(False)) | tx.any_contains(["o_orderpriority"], "URGENT")).select("o_orderkey")


@query("select doc_id from documents where source = 'src3' and lower(lang) = 'en' and doc_id in (select doc_id from labels)")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return catalog.in_scope(docs, catalog.Scope(series="src3", speaker="EN"), "doc_id", "source", "lang").select("doc_id")


@query("select o_orderkey from orders where strftime(o_orderdate, '%Y-%m-%d') between '1995-03-01' and '1995-05-31' and o_orderstatus = 'F'")
def scope_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = catalog.Scope(series="F", first_day="1995-03-01", last_day="1995-05-31")
    return catalog.in_scope(_orders(spark, sf_dir), scope, "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate").select("o_orderkey")


@query("select doc_id from documents where lower(source) = 'src12' and contains(lower(lang), 'e')")
def api_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.api_filter(table(spark, sf_dir, "documents"), "SRC12", "E", "source", "lang").select("doc_id")


@query("select source as value, count(*) as n, max(doc_id) as newest from documents where source is not null group by 1")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facet(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""select o_orderpriority as value, count(*) as n, strftime(max(o_orderdate), '%Y-%m-%d') as newest,
          cast(row_number() over (order by max(o_orderdate) desc, o_orderpriority) as integer) as rank from orders group by 1""")
def series_recent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.facet(_orders(spark, sf_dir), "o_orderpriority", "o_orderdate")
    rank = F.row_number().over(Window.orderBy(F.desc("newest"), "value"))
    return found.select("value", "n", catalog.day("newest").alias("newest"), rank.alias("rank"))


@query("select lang as value, count(*) as n, cast(row_number() over (order by count(*) desc, lang) as integer) as rank from documents where lang is not null group by 1")
def speakers_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ranked_values(table(spark, sf_dir, "documents"), "lang")


@query("select s as status, count(o_orderkey) as n from (values ('O'), ('F'), ('P'), ('X')) v(s) left join orders on o_orderstatus = s group by 1")
def status_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_counts(_orders(spark, sf_dir), "o_orderstatus", ["O", "F", "P", "X"])


@query("""select count(*) as n, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_totalprice > 100000) as large,
          coalesce(sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end), 0)::bigint as urgent from orders""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.count_if(F.col("o_totalprice") > 100000).alias("large"),
        F.coalesce(F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.lit(0)).alias("urgent"),
    )


@query("""select count(*) as total, count(quality) as known, coalesce(sum(quality), 0)::bigint as good, count(nullif(lang, '')) as named
          from documents left join labels using (doc_id)""")
def tri_state_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count("quality").alias("known"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.count(F.nullif("lang", F.lit(""))).alias("named")
    )


@query("""select conv_id, count(*) as n, arg_min(text, turn) as question, max(turn) as updated from conversations group by conv_id order by updated desc, conv_id limit 40""")
def threads_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.threads(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", "turn")
    return found.orderBy(F.desc("updated"), "conv_id").limit(40)


ESTIMATE = """with t as (select case when o_orderstatus = 'P' then null else o_totalprice / 100 end as s from orders order by o_orderdate desc nulls last, o_orderkey limit 500),
    m as (select count(*) as n, cast(floor(sum(coalesce(s / 60, 40)) + 0.5) as bigint) as minutes, count(*) filter (where s is null) as guessed from t)
    select n, minutes, guessed, round(minutes * 0.003, 4) as usd, minutes * 600 + n * 4000 as tokens from m"""


@query(ESTIMATE)
def backfill_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _orders(spark, sf_dir).withColumn("seconds", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 100))
    return catalog.estimate(items, [F.desc_nulls_last("o_orderdate"), "o_orderkey"], 500, "seconds", 40.0, 0.003)


@query("""select o_orderkey as id, case when row_number() over (order by o_orderdate desc nulls last, o_orderkey) <= 100 then 'queued' else 'not_imported' end as status from orders""")
def backfill_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "o_orderdate")
    gated = catalog.newest_first(rows, [F.desc_nulls_last("o_orderdate"), "id"], 100)
    return gated.select("id", F.when(F.col("within"), "queued").otherwise("not_imported").alias("status"))


@query("select o_orderkey, o_orderstatus, (select count(*) from orders) as total from orders order by o_orderdate desc nulls last, o_orderkey limit 50 offset 100")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderdate"), [F.desc_nulls_last("o_orderdate"), "o_orderkey"], 50, 3).drop("o_orderdate")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'P') order by o_orderstatus = 'F' desc, o_orderdate desc nulls last, o_orderkey limit 5")
def dispatch_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = catalog.with_status(_orders(spark, sf_dir), "F", "P", status="o_orderstatus")
    return waiting.orderBy(F.desc(F.col("o_orderstatus") == "F"), F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey")


@query("select d.doc_id, source from documents d left join labels l on d.doc_id = l.doc_id where quality is null order by d.doc_id desc limit 60")
def catch_up_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where("quality is null").orderBy(F.desc("doc_id")).limit(60).select("doc_id", "source")


@query("select doc_id, source, substr(text, 1, 200) as opening, quality from documents left join labels using (doc_id)")
def cards_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.substring("text", 1, 200).alias("opening"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("""select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
          left join region on n_regionkey = r_regionkey where o_totalprice > 200000""")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = _orders(spark, sf_dir).where("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    out = large.join(people, "c_custkey").join(nations, "n_nationkey", "left").join(table(spark, sf_dir, "region"), "r_regionkey", "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("select c_custkey, c_name, (select count(*) from orders where o_custkey = c_custkey) as n from customer")
def correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(counts, "c_custkey", "left").na.fill(0, ["n"])


@query("""select n_nationkey, n_name, lag(n_name) over (order by n_regionkey, n_nationkey) as prev, lead(n_name) over (order by n_regionkey, n_nationkey) as next from nation""")
def prev_next_across_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter before and after, over the bounds of books; the list of chapters is a small fixed table."""
    w = Window.orderBy("n_regionkey", "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lag("n_name").over(w).alias("prev"), F.lead("n_name").over(w).alias("next"))


@query("""select o_orderstatus, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from (select *, row_number() over (partition by o_orderstatus order by o_orderdate desc nulls last, o_orderkey) as rn from orders) where rn = 1""")
def newest_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min_by(F.struct("o_orderkey", "o_orderdate"), F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey"))
    return _orders(spark, sf_dir).groupBy("o_orderstatus").agg(best.alias("b")).select("o_orderstatus", "b.o_orderkey", catalog.day("b.o_orderdate").alias("day"))


@query("select p_partkey from part where contains(lower(concat(p_name, ' ', p_type)), 'blue') and p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def catalog_not_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that match the words and are not chosen yet."""
    added = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("blue")))
    return parts.join(added, "p_partkey", "left_anti").select("p_partkey")


@query("select min(least(greatest(p_size * 1000, 4000), 40000))::bigint as budget, max(p_size)::bigint as widest from part")
def least_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = F.least(F.greatest(F.col("p_size") * 1000, F.lit(4000)), F.lit(40000))
    return table(spark, sf_dir, "part").agg(F.min(clamped).cast("long").alias("budget"), F.max("p_size").cast("long").alias("widest"))
