"""Queries of nearest neighbours and retrieval. vec_id is taken as doc_id where both are needed; that is a convention of these queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import citations, retrieval, vector_index, vectors
from tessera.plans.registry import query
from tessera.session import table

KNN = """with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings {where}),
    q as (select vec_id as query_id, cast(embedding as double[]) as qe from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as id, round(list_cosine_similarity(e, qe), 6) as score from v, q),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from s)
    {rest}"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(KNN.format(where="", rest="select query_id, id, score, rank from r where rank <= 8"))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 8)


@query(KNN.format(where="", rest="select query_id, id, score, rank from r where rank <= 8"))
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index in clusters."""
    return vector_index.nearest(vector_index.build(table(spark, sf_dir, "embeddings")), _queries(spark, sf_dir), 8)


@query(KNN.format(where="where label % 2 = 0", rest="select query_id, id, score, rank from r where rank <= 8"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings")
    return vectors.nearest_in(known, _queries(spark, sf_dir), 8, known.where("label % 2 = 0").select("vec_id"))


@query(
    KNN.format(
        where="",
        rest=", f as (select r.query_id, r.id, r.score, cast(row_number() over (partition by query_id order by rank) as integer) as rank from r join embeddings on id = vec_id where r.rank <= 100 and label % 2 = 0) select * from f where rank <= 8",
    )
)
def knn_overfetch_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings")
    return vectors.nearest_in(known, _queries(spark, sf_dir), 8, known.where("label % 2 = 0").select("vec_id"), overfetch=True)


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, chunks, skip): a document is taken as chunk doc_id % 4 of the item doc_id // 4, chunk 0 as its summary, and as the
    text of the vector of its number. Each vector whose number divides by 20 is a question; it skips all items that end in the last digit of its label."""
    docs = table(spark, sf_dir, "documents")
    item, seq = F.floor(F.col("doc_id") / 4).cast("long"), (F.col("doc_id") % 4).cast("int")
    chunks = docs.select(item.alias("item"), seq.alias("seq"), F.when(seq == 0, "summary").otherwise("transcript").alias("kind"), "text")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    skip = chunks.select((F.col("item") % 10).alias("digit"), "item").distinct()
    return asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), (F.col("label") % 10).cast("long").alias("digit")), chunks, skip


@query("""with c as (select doc_id // 4 as item, doc_id % 4 as seq, text from documents),
    v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
    s as (select q.vec_id as query_id, q.label, v.vec_id as id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(v.e, q.e), 6) desc, v.vec_id) as rank
          from v, v q where q.vec_id % 20 = 0),
    h as (select query_id, id // 4 as item, id % 4 as seq, row_number() over (partition by query_id order by rank) as rank from s
          where rank <= 24 and (id // 4) % 10 <> label % 10),
    m as (select * from h where rank <= 8),
    n as (select distinct m.query_id, c.item, c.seq, c.text from c join m on c.item = m.item
          where c.seq = m.seq or (c.seq > 0 and c.seq between greatest(1, m.seq - 1) and greatest(1, m.seq + 1))),
    i as (select n.*, m.rank as hit, case when n.seq > 0 then n.seq - row_number() over (partition by n.query_id, n.item, n.seq > 0 order by n.seq) else -9 end as isl
          from n left join m on n.query_id = m.query_id and n.item = m.item and n.seq = m.seq),
    u as (select query_id, item, min(seq) as first, max(seq) as last, cast(min(hit) as integer) as rank, string_agg(text, chr(10) || chr(10) order by seq) as text from i group by query_id, item, isl),
    b as (select *, length(text) as n_chars, row_number() over w as rn, sum(length(text)) over (w rows between unbounded preceding and current row) as total
          from u window w as (partition by query_id order by rank nulls last, item, first))
    select query_id, item, cast(first as integer) as first, cast(last as integer) as last, rank, text, cast(n_chars as integer) as n_chars,
           cast(row_number() over (partition by query_id order by rank nulls last, item, first) as integer) as number from b where rn = 1 or total <= 12000""")
def retrieve_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's nearest passages but those of skipped items, with their neighbours, in runs, within a budget."""
    asked, chunks, skip = _answers(spark, sf_dir)
    limits = retrieval.Limits(8, 1, 1, 12_000)
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), asked, retrieval.fetched(limits, skips=True))
    found = found.join(asked.select("query_id", "digit"), "query_id")
    placed = found.select("query_id", "digit", F.floor(F.col("id") / 4).cast("long").alias("item"), (F.col("id") % 4).cast("int").alias("seq"), "rank")
    hits = retrieval.unskipped(placed, skip, limits, ["query_id"], "item", ["digit"])
    return retrieval.sources(hits, chunks, limits, "item", "seq", ["query_id"], "kind")


@query("""with k as (select doc_id from documents where contains(lower(text), 'license')),
    q as (select cast(embedding as double[]) as qe from embeddings where vec_id = 7),
    s as (select vec_id as doc_id, row_number() over (order by round(list_cosine_similarity(cast(embedding as double[]), qe), 6) desc, vec_id) as rank from embeddings, q),
    f as (select doc_id, rank from s where rank <= 30 and doc_id not in (select doc_id from k) order by rank, doc_id limit 12)
    select doc_id, 'keyword' as kind, cast(null as integer) as rank from k
    union all select doc_id, 'meaning', cast(row_number() over (order by rank, doc_id) as integer) from f""")
def hybrid_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings")
    keyword = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id")
    asked = known.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vectors.nearest(known, asked, 30).select(F.col("id").alias("doc_id"), "rank")
    return retrieval.hybrid(keyword, near)


@query("""select cast(row_number() over (order by g, id) as integer) as number, id, kind from (
    select 0 as g, item_id as id, 'benchmark' as kind from benchmark union all select 1, doc_id, 'label' from labels where toxic = 1)""")
def union_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"))
    second = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("label").alias("kind"))
    return retrieval.numbered([first, second], ["id"])


@query("select min(doc_id) as doc_id, count(*) as n from documents group by text")
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts once, the first seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), F.length("text").alias("l"))
    return docs.groupBy("h", "c", "l").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


#: What is added to turns, by turn: single numbers, lists, ranges, ranges that run backwards or too far, and none.
ADDED = [" [{n}].", " [2, 5]", " [4-6] and [{n}, 7–9]", " [9-2][3]", " [4-30]", " none [x] [ 1 ]", " [1 , 2 - 4, 8]"]
ADDED_SQL = "case turn % 7 " + " ".join(f"when {k} then '{a.replace('{n}', chr(39) + ' || (conv_id % 40) || ' + chr(39))}'" for k, a in enumerate(ADDED)) + " end"


@query(f"""with t as (select conv_id, turn, text || {ADDED_SQL} || ' and [' || (turn + 1) || ']' as text from conversations),
    b as (select conv_id, turn, list_filter(regexp_extract_all(text, '\\[([^\\[\\]]*)\\]', 1), lambda x: x = trim(x) and len(list_filter(string_split(replace(replace(x, '–', ','), '-', ','), ','), lambda n: not regexp_full_match(trim(n), '[0-9]+'))) = 0) as inside from t),
    p as (select conv_id, turn, generate_subscripts(g, 1) as i, unnest(g) as part from (select conv_id, turn, flatten(list_transform(inside, lambda x: string_split(x, ','))) as g from b)),
    e as (select *, try_cast(trim(regexp_split_to_array(part, '[-–]')[1]) as integer) as a, try_cast(trim(regexp_split_to_array(part, '[-–]')[2]) as integer) as b from p),
    n as (select conv_id, turn, i, unnest(case when b >= a and b - a < 20 then range(a, b + 1) else [a::bigint] end) as cited from e)
    select conv_id, turn, cast(cited as integer) as cited, cast(row_number() over (partition by conv_id order by turn, i, cited) as integer) as pos from n""")
def citation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations read from whole turns."""
    kinds = F.array(*[F.lit(a) for a in ADDED])
    added = F.replace(F.get(kinds, (F.col("turn") % len(ADDED)).cast("int")), F.lit("{n}"), (F.col("conv_id") % 40).cast("string"))
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", added, F.lit(" and ["), (F.col("turn") + 1).cast("string"), F.lit("]")))
    return citations.mentions(turns.select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "cited", "pos")


@query("select doc_id, substr(text, 1, 600) as text from documents")
def stored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.stored(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("chunk_id")))


@query("""with s as (select source, count(*) as n, sum(length(text)) as chars, coalesce(sum(length(text)) filter (where doc_id % 50 = 0), 0) as pinned, least(ascii(substr(source, 4)) % 3, 2) as m from documents group by source)
    select source, cast(chars as bigint) as chars, case when pinned > 0 and pinned <= 60000 then 'pinned' when n <= 40 and chars <= 60000 and m <> 2 then 'whole' else 'search' end as policy,
      case when pinned > 0 and pinned <= 60000 then null when n <= 40 and chars <= 60000 and m <> 2 then null when pinned > 0 then 'pinned texts too long'
           when m = 1 and n <= 40 then 'scope too long' when m = 1 then 'scope too wide' end as note from s""")
def policy_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way each series would be answered, by its size, what is pinned in it, and what was asked for."""
    pinned = F.coalesce(F.sum(F.when(F.col("doc_id") % 50 == 0, F.length("text"))), F.lit(0)).alias("pinned")
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), pinned)
    mode = F.get(F.array(F.lit("auto"), F.lit("full"), F.lit("search")), (F.ascii(F.substring("source", 4, 1)) % 3).cast("int"))
    chosen = retrieval.policy(F.col("n"), F.col("chars"), F.lit(60_000), F.col("pinned"), mode)
    return sizes.select("source", "chars", chosen.alias("p")).select("source", "chars", F.col("p.way").alias("policy"), "p.note")


@query("select doc_id, concat_ws(chr(10), source, text) as text from documents")
def indexed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each document: its series on a line of its own before the text."""
    return table(spark, sf_dir, "documents").select("doc_id", vectors.indexed_text(F.col("source"), F.col("text")).alias("text"))
