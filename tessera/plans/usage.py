"""Queries of usage over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import tables
from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming import exact, usage


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", usage.millis("ts"))


@query("""select event_id, count(*) over (partition by user_id order by (epoch_us(ts) // 1000) range between 3599999 preceding and current row) as used from events""")
def window_usage_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.window_counts(_events(spark, sf_dir), "user_id", "ms", usage.HOUR_MS).select("event_id", "used")


@query("select (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 as day, count(*) as n from events group by 1")
def day_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.day_counts(_events(spark, sf_dir), "ms")


ADMITTED = """with recursive e as (select user_id, event_id, (epoch_us(ts) // 1000) as ms, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as i from events),
    s as (select user_id, event_id, i, true as granted, [ms] as held from e where i = 1
          union all
          select e.user_id, e.event_id, e.i, len(list_filter(s.held, lambda h: h > e.ms - 86400000)) < 2,
                 case when len(list_filter(s.held, lambda h: h > e.ms - 86400000)) < 2 then list_append(list_filter(s.held, lambda h: h > e.ms - 86400000), e.ms)
                      else list_filter(s.held, lambda h: h > e.ms - 86400000) end
          from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, event_id, granted from s"""


@query(ADMITTED)
def admission_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.admissions(_events(spark, sf_dir), "user_id", "ms", "event_id", 2, usage.DAY_MS).select("user_id", "event_id", "granted")


HELD = """with recursive e as (select user_id, event_id, (epoch_us(ts) // 1000) as ms, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as i from events),
    s as (select user_id, event_id, i, true as valid, ms + 108000000 as expires, ms + 108000000 as ends, ms as refreshed from e where i = 1
          union all
          select e.user_id, e.event_id, e.i, coalesce(e.ms < s.ends, true),
            case when s.ends is null then e.ms + 108000000 when e.ms >= s.ends then s.ends when e.ms - s.refreshed >= 14400000 then e.ms + 108000000 else s.ends end,
            case when s.ends is null then e.ms + 108000000 when e.ms >= s.ends then null when e.ms - s.refreshed >= 14400000 then e.ms + 108000000 else s.ends end,
            case when s.ends is null then e.ms when e.ms >= s.ends then null when e.ms - s.refreshed >= 14400000 then e.ms else s.refreshed end
          from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, event_id, valid, expires from s"""


@query(HELD)
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sessions(_events(spark, sf_dir), "user_id", "ms", "event_id", 30 * usage.HOUR_MS, 4 * usage.HOUR_MS)


@query("""select event_id, strftime(ts - interval 6 hour, '%Y-%m-%dT%H') as slot, cast(dayofweek(ts - interval 6 hour) as integer) as weekday, cast(hour(ts - interval 6 hour) as integer) as hour from events""")
def local_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January in Chicago is six hours behind."""
    return table(spark, sf_dir, "events").select("event_id", tx.local_slot("ts", "America/Chicago").alias("s")).select("event_id", "s.*")


@query("""with s as (select event_id, strftime(ts, '%Y-%m-%dT%H') as slot, hour(ts) as h, dayofweek(ts) as d, strftime(ts - interval 1 hour, '%Y-%m-%dT%H') as last from events)
    select event_id from s where h = 9 and d = 1 and slot <> last""")
def due_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = F.date_format(F.col("ts") - F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH")
    return events.where(tx.is_due("ts", last, 9, 1, "UTC")).select("event_id")


@query("select event_id from events where (epoch_us(ts) // 1000) > (select max((epoch_us(ts) // 1000)) from events) - 86400000")
def purge_after_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    newest = events.agg((F.max("ms") - usage.DAY_MS).alias("bound"))
    return events.join(F.broadcast(newest)).where("ms > bound").select("event_id")  # one row


FAILED = """with e as (select event_id, user_id % 3 as bucket, (epoch_us(ts) // 1000) as ms, event_type from events),
    f as (select event_id, event_type, count(*) filter (where event_type = 'error') over (partition by bucket order by ms range between 14399999 preceding and current row) as failures from e)
    select event_id, failures, failures >= 10 as limited from f where event_type <> 'error'"""


@query(FAILED)
def failures_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that ten failures of their bucket in the four hours before would refuse."""
    events = _events(spark, sf_dir).withColumn("bucket", F.col("user_id") % 3)
    attempts = events.where("event_type <> 'error'").select("event_id", "bucket", "ms")
    return usage.limited(events.where("event_type = 'error'").select("bucket", "ms"), attempts, "bucket", "ms", 10, 4 * usage.HOUR_MS).select("event_id", "failures", "limited")


@query("""with recursive e as (select event_id, user_id % 5 as who, user_id % 5 = 0 as free, (epoch_us(ts) // 1000) as ms, row_number() over (order by (epoch_us(ts) // 1000), event_id) as i from events where event_type = 'purchase'),
    s as (select 0::bigint as i, null::bigint as event_id, null::varchar as refused, []::struct(w bigint, m bigint)[] as held, -1::bigint as day, 0 as used
          union all
          select i, event_id, refused, case when refused is null then list_append(held, {'w': who, 'm': ms}) else held end, day, case when refused is null and not free then used + 1 else used end
          from (select e.i, e.event_id, e.who, e.ms, e.free, e.ms // 86400000 as day, k.held, case when s.day = e.ms // 86400000 then s.used else 0 end as used,
                  case when len(list_filter(k.held, lambda x: x.w = e.who)) >= 2 then 'hour'
                       when not e.free and case when s.day = e.ms // 86400000 then s.used else 0 end >= 40 then 'day' end as refused
                from s join e on e.i = s.i + 1, lateral (select list_filter(s.held, lambda x: x.m > e.ms - 3600000) as held) k))
    select event_id, refused from s where i > 0""")
def site_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two an hour for each of five askers, forty a day for all, from which one asker is exempt."""
    asked = _events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "ms", (F.col("user_id") % 5).alias("who"))
    return usage.quota(asked.withColumn("free", F.col("who") == 0), "who", "ms", "event_id", 2, 40, "free")


def _streamed(spark: SparkSession, events: DataFrame, fold: exact.Fold, key: str, days: int = 8) -> DataFrame:
    """events through a stream whose batches hold them up to two days out of order.

    A batch is all the files that its rows were written to, however many, and the stream goes on once they are there: read
    one by one, the first would move the watermark past what the others hold. A last batch has an event of no one's, so
    late that the watermark passes all others.
    """
    path, out, progress = (tables.new_path(spark, n) for n in ("stream", "folded", "progress"))
    day = usage.DAY_MS
    rows = tables.written(events.withColumn("file", F.floor((F.col("ms") + F.pmod(F.xxhash64("event_id"), F.lit(2 * day))) / (days * day))), "events")
    last = rows.agg(F.max("ms")).first()[0] or 0
    end = spark.createDataFrame([(last + 99 * day, -1)], "ms long, event_id long").select(*(c if c in ("ms", "event_id") else F.lit(-1).cast("long").alias(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in events.dtypes))
    files = [r["file"] for r in rows.select("file").distinct().orderBy("file").collect()]  # a row for each batch of so many days
    what = "event_type" if "event_type" in events.columns else None
    for batch in [*(rows.where(F.col("file") == k).drop("file") for k in files), end]:
        batch.write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        exact.run_available(exact.folded(stream, fold, key, "ms", "event_id", "49 hours", what), out, progress).awaitTermination()
    tables.drop(rows)
    return spark.read.parquet(out).where("event_id >= 0")


@query(ADMITTED)
def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As admission_control, from a stream that brings events out of order."""
    events = _events(spark, sf_dir).select("user_id", "ms", "event_id")
    return _streamed(spark, events, exact.Admissions(2, usage.DAY_MS), "user_id").select("user_id", "event_id", "granted")


@query(HELD)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As session_fold, from a stream that brings uses out of order."""
    events = _events(spark, sf_dir).select("user_id", "ms", "event_id")
    return _streamed(spark, events, exact.Sessions(30 * usage.HOUR_MS, 4 * usage.HOUR_MS), "user_id").select("user_id", "event_id", "valid", "expires")


@query(FAILED)
def failure_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As failures_by_type, from a stream that brings failures and attempts out of order."""
    events = _events(spark, sf_dir).select((F.col("user_id") % 3).alias("bucket"), "ms", "event_id", "event_type")
    return _streamed(spark, events, exact.Failures("error", 10, 4 * usage.HOUR_MS), "bucket").select("event_id", "failures", "limited")
