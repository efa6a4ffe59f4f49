"""Queries of model replies, exports and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.functions import text as tx
from tessera.operators import documents, vectors
from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming import usage


@query("""select event_id, 'About ' || event_type || ' ' || event_id as summary,
      case event_id % 7 when 0 then 'John 3:' || (event_id % 30 + 1) || '-40' when 1 then null when 2 then null when 3 then null when 4 then 'undefined' when 5 then null else 'Luke ' || (event_id % 24 + 1) end as main_reference,
      [event_type, 'b', 't' || (event_id % 11)] as topics from events where event_id % 5 <> 0 and event_id % 9 <> 4""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with prose around them; a number among topics is left out, a blank summary and a broken reply are none."""
    n = F.col("event_id")
    mains = [F.concat(F.lit('"John  3:'), (n % 30 + 1).cast("string"), F.lit('–40."')), F.lit('"Topical"'), F.lit("null"), F.lit('"no main passage"'), F.lit('"undefined"'), F.lit("7"), F.concat(F.lit('" Luke\\n'), (n % 24 + 1).cast("string"), F.lit(';"'))]
    main = F.get(F.array(*mains), (n % 7).cast("int"))
    body = F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("About "), "event_type", F.lit(" "), n.cast("string")))
    reply = F.concat(F.lit('Sure: {"summary": "'), body, F.lit('", "mainScripture": '), main, F.lit(', "topics": ["'), "event_type", F.lit('", 7, " b ", "", "t'), (n % 11).cast("string"), F.lit('"]'), F.when(n % 9 == 4, "").otherwise("} Bye"))
    rows = table(spark, sf_dir, "events").select("event_id", replies.summary(reply).alias("s")).where("s is not null")
    return rows.select("event_id", "s.summary", "s.main_reference", "s.topics")


@query("""select event_id, case when event_id % 4 = 3 then null else event_type || event_id end as first, cast(null as varchar) as second, case when event_id % 2 = 0 then 'c' || event_id % 13 end as third from events where event_id % 6 <> 5""")
def numbered_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by number in any order: numbers and missing ones are null, a reply without JSON is none."""
    n = F.col("event_id")
    first = F.when(n % 4 == 3, "17").otherwise(F.concat(F.lit('"'), "event_type", n.cast("string"), F.lit('"')))
    third = F.when(n % 2 == 0, F.concat(F.lit('"3": "c'), (n % 13).cast("string"), F.lit('", '))).otherwise("")
    reply = F.when(n % 6 == 5, "nothing here").otherwise(F.concat(F.lit("So {"), third, F.lit('"1": '), first, F.lit(', "2": 5}.')))
    rows = table(spark, sf_dir, "events").select("event_id", replies.numbered(reply, 3).alias("r")).where("r is not null")
    return rows.select("event_id", F.get("r", 0).alias("first"), F.get("r", 1).alias("second"), F.get("r", 2).alias("third"))


@query("""select event_id, event_type as heading, case when event_id % 2 = 0 then [3, 1, 9] else [cast(event_id % 50 + 10 as integer), 1] end as numbers, cast(case when event_id % 3 = 0 then 0 else floor(least(greatest(event_id % 6000, 150), 5000) + 0.5) end as integer) as words from events""")
def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("event_id") % 3 == 0, '"many"').otherwise(F.greatest(F.col("event_id") % 6000, F.lit(1)).cast("string"))
    numbers = F.when(F.col("event_id") % 2 == 0, '[3, "1", 9, 1, 2.5]').otherwise(F.concat(F.lit("["), (F.col("event_id") % 50 + 10).cast("string"), F.lit(', 0, -4, "x", 1, null]')))
    reply = F.concat(F.lit('{"title": "# T", "parts": [{"heading": " '), "event_type", F.lit(' ", "sermons": '), numbers, F.lit(', "words": '), words, F.lit("}]}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(replies.plan(reply)["parts"]).alias("p"))
    return rows.select("event_id", "p.heading", "p.numbers", "p.words")


WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


@query(f"""with t as (select conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as one from conversations),
    f as (select *, case turn % 6 when 0 then 'Well, ' || one when 1 then ' ' when 2 then 'far too short' when 3 then one || ' and more and more and more' when 4 then null else regexp_replace(one, '^\\S+', 'Changed') end as fix from t)
    select conv_id, turn, case when fix is null or trim(fix) = '' then text when abs({WORDS.format("fix")} - {WORDS.format("text")}) <= greatest(2, ceil({WORDS.format("text")} * 0.2)) then fix else text end as text from f""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of whole turns merged: blank, missing and too different ones change nothing; string ids count."""
    kind, one = F.col("turn") % 6, tx.squeeze("text")
    fix = F.when(kind == 0, F.concat(F.lit("Well,  "), one)).when(kind == 1, " ").when(kind == 2, "far too short").when(kind == 3, F.concat(one, F.lit(" and more and more and more\n")))
    fix = fix.otherwise(F.regexp_replace(one, r"^\S+", "Changed"))
    id_text = F.when(kind == 4, F.col("turn") + 1000).otherwise(F.col("turn")).cast("string")
    reply = F.concat(F.lit("Here: "), F.to_json(F.array(F.struct(id_text.alias("id"), fix.alias("text")), F.struct(F.lit("999").alias("id"), F.lit("no").alias("text")))), F.lit(" done"))
    items = F.array(F.struct(F.col("turn").alias("id"), F.col("text").alias("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(replies.merge_cleaned(items, reply), 0).alias("text"))


@query("""with t as (select conv_id, turn, trim(text, ' ' || chr(10)) as body from conversations)
    select conv_id, turn, case turn % 5 when 0 then 'On ' || conv_id when 1 then 'none' when 2 then 'Late ' || turn when 3 then 'none' else 'C# ' || turn end as title,
      case turn % 5 when 1 then '## Two' || chr(10) || body when 3 then body else body end as body from t""")
def split_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles split off whole turns, fenced or not, with and without one."""
    kind, turn, text = F.col("turn") % 5, F.col("turn").cast("string"), F.col("text")
    markdown = (
        F.when(kind == 0, F.concat(F.lit("```markdown\n# On *"), F.col("conv_id").cast("string"), F.lit("* #\n\n"), text, F.lit("\n```\n ")))
        .when(kind == 1, F.concat(F.lit("## Two\n"), text))
        .when(kind == 2, F.concat(F.lit("#\n\n Late `"), turn, F.lit("`  \n"), text))
        .when(kind == 3, F.concat(F.lit("\n"), text))
        .otherwise(F.concat(F.lit("``` \n# C# "), turn, F.lit("##\n"), text, F.lit("\n```")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", replies.split_title(markdown, "none").alias("t")).select("conv_id", "turn", "t.*")


@query("select o_orderkey, case when o_totalprice / 10000000 < 0.01 then 'under $0.01' else '$' || cast(cast(o_totalprice / 10000000 as decimal(20,2)) as varchar) end as price from orders")
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", replies.money(F.col("o_totalprice") / 10000000).alias("price"))


@query("""select conv_id, turn, '[' || (turn + 1) || '] "' || conv_id || '" (undated, ' || role || '), at 0:' || lpad(cast(turn as varchar), 2, '0') || ':' || chr(10) || text as block from conversations""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = replies.source_block(F.col("turn") + 1, F.col("conv_id").cast("string"), F.lit(None).cast("string"), F.col("role"), F.col("turn"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("block"))


@query("""with c as (select conv_id, max(turn) as t, min(text) as body from conversations group by conv_id)
    select conv_id, case when t % 3 = 0 then 'x [1, 2]' || chr(10) || chr(10) || trim(body, ' ' || chr(10)) || ' [2, 3]' when t % 3 = 1 then 'x [1, 2]' || chr(10) || chr(10) || trim(body, ' ' || chr(10)) || ' [2] []'
        else 'x [1, 2]' || chr(10) || chr(10) || trim(body, ' ' || chr(10)) || ' [1]' end as markdown,
      case when t % 3 = 0 then [conv_id || ':b', conv_id || ':a', conv_id || ':' || t] else [conv_id || ':b', conv_id || ':a'] end as sources from c""")
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts each, numbered together by first citation; what no part was given as a source has no number."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"), F.min("text").alias("body"))
    id_of = lambda x: F.concat(F.col("conv_id").cast("string"), F.lit(":"), x)
    a, b, t = id_of(F.lit("a")), id_of(F.lit("b")), id_of(F.col("t").cast("string"))
    cited = F.when(F.col("t") % 3 == 0, F.concat(F.lit("⟦"), a, F.lit("|"), t, F.lit("⟧"))).when(F.col("t") % 3 == 1, F.concat(F.lit("⟦"), a, F.lit("⟧ ⟦zz⟧"))).otherwise(F.concat(F.lit("⟦zz|"), b, F.lit("⟧")))
    first, second = F.concat(F.lit(" x ⟦"), b, F.lit("|"), a, F.lit("⟧ ")), F.concat(F.col("body"), F.lit(" "), cited)
    parts = c.select(F.col("conv_id").alias("document"), F.posexplode(F.array(F.struct(first.alias("text"), F.array(a, b).alias("ids")), F.struct(second.alias("text"), F.array(a, t).alias("ids")))).alias("part", "p"))
    return documents.assemble(parts.select("document", "part", "p.text", "p.ids")).withColumnRenamed("document", "conv_id")


@query("""select c_custkey, json_object('id', c_custkey, 'name', c_name, 'segment', c_mktsegment)::varchar as body from customer""")
def api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the objects an interface returns."""
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))


@query("""with q as (select cast(embedding as double[]) as qe from embeddings where vec_id = 3),
    s as (select vec_id, label, row_number() over (order by round(list_cosine_similarity(cast(embedding as double[]), qe), 6) desc, vec_id) as rank from embeddings, q)
    select distinct label from s where rank <= 100""")
def planner_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of the hundred nearest passages, when a catalogue is too long to list."""
    known = table(spark, sf_dir, "embeddings")
    asked = known.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vectors.nearest(known, asked, 100).select(F.col("id").alias("vec_id"))
    return known.join(near, "vec_id", "left_semi").select("label").distinct()


@query("""select o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') as day from orders left join customer on c_custkey = o_custkey and c_acctbal > 0
    where o_custkey % 2 = 1 order by o_orderdate desc nulls last, o_orderkey limit 25""")
def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents of some owners, with the author where known."""
    authors = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    newest = table(spark, sf_dir, "orders").where("o_custkey % 2 = 1").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(25)
    return newest.join(authors, "o_custkey", "left").select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""with recursive e as (select user_id, ts, (epoch_us(ts) // 1000) as ms, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as i from events),
    s as (select user_id, ts, i, ms as last, true as touched from e where i = 1
          union all select e.user_id, e.ts, e.i, case when e.ms - s.last > 10800000 then e.ms else s.last end, e.ms - s.last > 10800000 from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, epoch_us(max(ts)) // 1000 as last, count(*) as n from s where touched group by user_id""")
def key_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses that are over three hours after the last one that was written down."""
    events = table(spark, sf_dir, "events").withColumn("ms", usage.millis("ts"))
    touched = usage.touches(events, "user_id", "ms", "event_id", 3 * usage.HOUR_MS).where("touched")
    return touched.groupBy("user_id").agg(F.max("ms").alias("last"), F.count(F.lit(1)).alias("n"))


#: Two references for each part: alike up to dashes, blanks and case, or different in a verse or a final mark.
GIVEN = ["john  3:{n}–18", "John 3: {n} - 18", "JOHN 3:{n}—18", "John 3:{n}-18.", "John 3:1{n}-18", "", "Jöhn 3:{n}-18", "topical"]


@query(f"""select p_partkey, a <> '' and lower(regexp_replace(replace(replace(a, '–', '-'), '—', '-'), '\\s+', '', 'g')) = lower(regexp_replace(b, '\\s+', '', 'g')) as mentions
    from (select p_partkey, replace(case p_partkey % 8 {" ".join(f"when {k} then '{g}'" for k, g in enumerate(GIVEN))} end, '{{n}}', cast(p_size as varchar)) as a,
          case when p_partkey % 8 = 7 then 'Topical' when p_partkey % 8 = 5 then '' else 'John 3:' || (case when p_partkey % 3 = 0 then p_size + 1 else p_size end) || '-18' end as b from part)""")
def same_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_partkey") % 8, F.col("p_size")
    given = F.replace(F.get(F.array(*[F.lit(g) for g in GIVEN]), kind.cast("int")), F.lit("{n}"), size.cast("string"))
    other = F.concat(F.lit("John 3:"), F.when(F.col("p_partkey") % 3 == 0, size + 1).otherwise(size).cast("string"), F.lit("-18"))
    other = F.when(kind == 7, "Topical").when(kind == 5, "").otherwise(other)
    return table(spark, sf_dir, "part").select("p_partkey", tx.same_reference(given, other).alias("mentions"))
