"""Queries of packing, budgets, runs, neighbours and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.plans.registry import query
from tessera.session import table

SEGMENTS = """seg as (
  select doc_id, row_number() over (partition by doc_id order by pos) as i, length(line) as len
  from (select doc_id, unnest(range(1, len(a) + 1)) as pos, trim(unnest(a), ' ') as line from (select doc_id, string_split(text, chr(10)) as a from documents))
  where line <> '')"""


def _packed_sql(key: str, seg: str, cap: int, between: int, each: int) -> str:
    fits = f"p.size + {between} + s.len + {each} <= {cap}"
    return f"""with recursive {seg},
      step as (
        select {key}, i, 1 as part, len + {each} as size, len from seg where i = 1
        union all
        select s.{key}, s.i, case when {fits} then p.part else p.part + 1 end,
               case when {fits} then p.size + {between} + s.len + {each} else s.len + {each} end, s.len
        from step p join seg s on s.{key} = p.{key} and s.i = p.i + 1)
      select {key}, cast(part as integer) as part, count(*) as n, cast(min(i) as integer) as first, cast(max(i) as integer) as last,
             cast(sum(len) + {between} * (count(*) - 1) + {each} * count(*) as bigint) as chars
      from step group by {key}, part"""


@query(_packed_sql("doc_id", SEGMENTS, 1200, 1, 0))
def pack_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.packed_lines(table(spark, sf_dir, "documents"), 1200, 1, texts=False)


@query(_packed_sql("doc_id", SEGMENTS, 8000, 0, 0))
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.packed_lines(table(spark, sf_dir, "documents"), 8000, 0, texts=False)


@query(
    _packed_sql(
        "conv_id",
        "seg as (select conv_id, row_number() over (partition by conv_id order by turn) as i, length(text) as len from conversations)",
        900,
        0,
        1,
    )
)
def pack_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed to 900 characters, never across conversations; each counts one more, the first too."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("len")))).alias("t"))
    packed = folds.pack_greedy(turns.select("conv_id", F.transform("t", lambda x: x["len"]).alias("sizes")), "sizes", 900, 0, 1)
    flat = packed.select("conv_id", F.posexplode(F.arrays_zip("sizes", "parts")).alias("i", "s")).select("conv_id", (F.col("i") + 1).alias("i"), "s.parts", "s.sizes")
    return flat.groupBy("conv_id", F.col("parts").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last"), (F.sum("sizes") + F.count(F.lit(1))).alias("chars")
    )


@query("""select conv_id, turn from (select *, row_number() over w as rn, sum(length(text)) over (w rows between unbounded preceding and current row) as total
          from conversations window w as (partition by conv_id order by turn)) where rn = 1 or total <= 600""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return folds.prefix_budget(turns, ["conv_id"], ["turn"], "chars", 600).select("conv_id", "turn")


@query("""with recursive c as (select conv_id, turn, length(text) as len, row_number() over (partition by conv_id order by turn) as i from conversations),
          s as (select conv_id, turn, i, 600 - case when len <= 600 then len else 0 end as left_, len <= 600 as kept from c where i = 1
                union all select c.conv_id, c.turn, c.i, s.left_ - case when c.len <= s.left_ then c.len else 0 end, c.len <= s.left_
                from s join c on c.conv_id = s.conv_id and c.i = s.i + 1)
          select conv_id, turn from s where kept""")
def budget_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return folds.first_fit(turns.withColumn("rank", F.col("turn")), ["conv_id"], ["rank"], "turn", "chars", 600)


@query("""select conv_id, min(turn) as first, max(turn) as last, count(*) as n, string_agg(text, chr(10) || chr(10) order by turn) as text
          from (select *, (row_number() over (partition by conv_id, isl order by turn) - 1) // 2 as sub
                from (select *, turn - row_number() over (partition by conv_id order by turn) as isl from conversations where turn % 4 <> 3))
          group by conv_id, isl, sub""")
def merge_runs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "conversations").where("turn % 4 <> 3")
    return folds.merge_runs(kept, ["conv_id"], "turn", 2, "text")


@query("""select distinct c.conv_id, c.turn, c.role from conversations c join (select conv_id, turn from conversations where length(text) > 400) h
          on c.conv_id = h.conv_id and c.turn between h.turn - 1 and h.turn + 2""")
def expand_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    hits = turns.where(F.length("text") > 400).select("conv_id", "turn")
    return folds.neighbours(hits, turns.select("conv_id", "turn", "role"), ["conv_id"], "turn", 1, 2).distinct()


@query("""with p as (select conv_id, turn, length(text) as len, row_number() over (partition by conv_id order by turn) as at from conversations where role <> 'system')
          select distinct a.conv_id, a.turn from p a join p h on a.conv_id = h.conv_id and a.at between h.at - 1 and h.at + 1 where h.len > 300""")
def position_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by place in the list, not by number: what is missing is stepped over."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    placed = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", F.length("text").alias("len"), F.row_number().over(w).alias("at"))
    hits = placed.where("len > 300").select("conv_id", "at")
    return folds.neighbours(hits, placed, ["conv_id"], "at", 1, 1).select("conv_id", "turn").distinct()


@query("""with m as (select user_id, ts, min(event_id) as mark from events where event_type = 'view' or event_id % 10 = 0 group by user_id, ts),
          f as (select user_id, arg_min(mark, ts) as first from m group by user_id),
          a as (select e.event_id, e.user_id, m.mark from events e asof left join m on e.user_id = m.user_id and e.ts >= m.ts)
          select event_id, coalesce(mark, first) as mark from a left join f on a.user_id = f.user_id""")
def asof_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    marks = events.where("event_type = 'view' or event_id % 10 = 0").groupBy("user_id", "ts").agg(F.min("event_id").alias("mark"))
    return folds.as_of(events.select("user_id", "ts", "event_id"), marks, ["user_id"], "ts", "mark").select("event_id", "mark")


@query("""with p as (select conv_id, turn, turn as lo, turn + 1 as hi from conversations), m as (select conv_id, min(turn) + 1 as a, min(turn) + 2 as b from conversations group by conv_id),
          r as (select p.*, row_number() over (partition by p.conv_id order by lo, turn) as rn from p join m on p.conv_id = m.conv_id and p.lo <= m.b and p.hi >= m.a)
          select conv_id, turn, cast(rn as integer) as rank from r where rn <= 8""")
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that overlap a mention's range: equal keys first, the range as what remains, the first eight of each."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("lo"), (F.col("turn") + 1).alias("hi"))
    mentions = turns.groupBy("conv_id").agg((F.min("turn") + 1).alias("a"), (F.min("turn") + 2).alias("b"))
    found = folds.overlapping(turns, mentions, "conv_id", ("lo", "hi"), ("a", "b"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("lo", "turn"))
    return found.withColumn("rank", rank).where("rank <= 8").select("conv_id", "turn", "rank")


@query("""with s as (select event_id as pos, value from events), n as (select count(*) as n from s),
          e as (select pos, sum(value * value) over (order by pos rows between current row and 49 following) as energy from s)
          select pos, round(energy, 4) as energy from e, n where pos % 10 = 0 and pos + 50 <= n and pos >= n - 500 order by energy, pos limit 1""")
def energy_min_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "value")
    return folds.quietest(samples, "pos", "value", 50, 10, 500).select("pos", F.round("energy", 4).alias("energy"))


@query("select cast(floor(event_id * 16 / 44.0) as bigint) as step, round(avg(value), 6) as level, count(*) as n from events group by 1")
def decimated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "value")
    return folds.decimate(samples, "pos", "value", 44, 16).select("step", F.round("level", 6).alias("level"), "n")


@query("""with t as (select *, row_number() over (partition by conv_id, text order by turn) as dup from conversations),
          d as (select *, row_number() over w as rn, sum(length(text)) over (w rows between unbounded preceding and current row) as total from t where dup = 1 window w as (partition by conv_id order by turn)),
          k as (select *, turn - row_number() over (partition by conv_id order by turn) as isl from d where rn = 1 or total <= 1500)
          select conv_id, min(turn) as first, max(turn) as last, count(*) as n from k group by conv_id, isl""")
def assemble_dedupe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated texts once, a budget in order, then adjacent ones joined."""
    turns = table(spark, sf_dir, "conversations").withColumn("dup", F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn"))).where("dup = 1")
    kept = folds.prefix_budget(turns.withColumn("chars", F.length("text")), ["conv_id"], ["turn"], "chars", 1500)
    return folds.merge_runs(kept, ["conv_id"], "turn", 1_000_000, "text").select("conv_id", "first", "last", "n")


@query("""with s as (select l_orderkey, l_linenumber, l_suppkey, epoch_us(l_shipdate) // 86400000000 as lo, epoch_us(l_shipdate) // 86400000000 + cast(l_quantity as bigint) as hi from lineitem)
    select a.l_orderkey, a.l_linenumber, count(*) as n, min(b.lo) as first from s a join s b on a.l_suppkey = b.l_suppkey and a.lo <= b.hi and a.hi >= b.lo group by a.l_orderkey, a.l_linenumber""")
def overlapping_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its supplier's goods are on the way while one is, itself included, and since when; a good is on the way as many days as it counts pieces."""
    lo = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400)
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi"))
    return folds.overlap_counts(spans, "l_suppkey", "lo", "hi", ["l_orderkey", "l_linenumber"])
