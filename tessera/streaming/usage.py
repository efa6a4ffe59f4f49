"""Usage over time: sliding counts, admission, day caps and sessions, in batch and under Structured Streaming.

An admission counts only if it is granted, so a window count cannot decide it: what was rejected must not count. It
is a fold over a key's events in the order of (time, id), whose state holds at most `limit` times. exact.py runs the same
folds over streams.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import buckets, folds, tables

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _younger(asked: DataFrame, counted: DataFrame, key: str, ms: str, width_ms: int, out: str) -> DataFrame:
    """asked with how many of counted, by key, lie in the width that ends with each, strictly younger. Rows without a time count each other.

    A row adds one at its time and takes it away a width later, and what is asked is the sum up to there, so the work does
    not grow with how many rows a width holds. Keys are dealt by stretches of the width: a row also adds one at the start of the
    next stretch, where it ends; none reaches further.
    """
    at = F.col(ms).cast("long")
    start = at - F.pmod(at, F.lit(width_ms))
    mark = lambda stretch, when, n: F.struct(stretch.alias("_stretch"), when.alias("_at"), F.lit(n).alias("_n"))
    own, after = mark(start, at, 1), [mark(start + width_ms, start + width_ms, 1), mark(start + width_ms, at + width_ms, -1)]
    marks = counted.select(key, F.explode(F.when(at.isNull(), F.array(own)).otherwise(F.array(own, *after))).alias("_m")).select(key, "_m.*", F.lit(False).alias("_asks"))
    asks = asked.withColumns({"_stretch": start, "_at": at, "_n": F.lit(0), "_asks": F.lit(True)})
    w = Window.partitionBy(key, "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return asks.unionByName(marks, allowMissingColumns=True).withColumn(out, F.sum("_n").over(w)).where("_asks").drop("_stretch", "_at", "_n", "_asks")


def window_counts(events: DataFrame, key: str, ms: str, width_ms: int) -> DataFrame:
    """events with `used`: how many of the key's events lie in the width that ends with each, strictly younger. Rows without a time count each other."""
    return _younger(events, events, key, ms, width_ms, "used")


def day_counts(events: DataFrame, ms: str) -> DataFrame:
    """(day, n) by UTC day."""
    start = F.col(ms) - F.pmod(F.col(ms), F.lit(DAY_MS))
    return events.groupBy(start.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def admit(times: list[int], granted: list[int], limit: int, width_ms: int) -> tuple[list[bool], list[int]]:
    """Which of the times in order are granted, and the granted ones that still count."""
    out = []
    for t in times:
        granted = [g for g in granted if g > t - width_ms]
        ok = len(granted) < limit
        out.append(ok)
        if ok:
            granted.append(t)
    return out, granted


def _pieces(events: DataFrame, key: str, ms: str, event_id: str, gap_ms: int) -> DataFrame:
    """events with `_piece`: a key's history cut at events so long after the one before that nothing of it matters any more.

    A busy key's pieces are dealt to different tasks, and so is the cutting: events are compared within stretches of time,
    and what goes from one to the next are a last time and a number of cuts, a row a stretch.
    """
    spread = events.withColumn("_stretch", F.floor(F.col(ms) / F.lit(8 * gap_ms)))
    inside = Window.partitionBy(key, "_stretch").orderBy(ms, event_id)
    local = spread.withColumn("_gap", F.col(ms) - F.lag(ms).over(inside)).withColumn("_cut", F.coalesce((F.col("_gap") >= gap_ms).cast("int"), F.lit(0)))
    local = local.withColumn("_cuts", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(key, "_stretch").agg(F.min(ms).alias("_first"), F.max(ms).alias("_last"), F.max("_cuts").alias("_all"))
    along = Window.partitionBy(key).orderBy("_stretch")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(along) >= gap_ms).cast("int"), F.lit(0))
    ends = ends.withColumn("_opens", opens)
    before = F.coalesce(F.sum(F.col("_opens") + F.col("_all")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_opens")
    starts = ends.select(F.col(key).alias("_key"), F.col("_stretch").alias("_of"), before.alias("_before"))
    joined = local.join(starts, (F.col(key) == F.col("_key")) & (F.col("_stretch") == F.col("_of")))
    return joined.withColumn("_piece", F.col("_cuts") + F.col("_before")).drop("_stretch", "_gap", "_cut", "_cuts", "_key", "_of", "_before")


def admissions(events: DataFrame, key: str, ms: str, event_id: str, limit: int, width_ms: int) -> DataFrame:
    """(key, event_id, ms, granted) for each event with a key, which is a rate-limited actor."""

    def start():
        held: list[int] = []

        def step(actor, piece, at, event):
            granted, held[:] = admit([at], held, limit, width_ms)
            return actor, event, at, granted[0]

        return step

    rows = events.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(key, ms, event_id)
    kinds = dict(rows.dtypes)
    cut = _pieces(rows, key, ms, event_id, width_ms).select(key, "_piece", ms, event_id)
    return folds.running(cut, [key, "_piece"], [ms, event_id], f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, {ms} {kinds[ms]}, granted boolean", start)


def touches(events: DataFrame, key: str, ms: str, event_id: str, least_ms: int) -> DataFrame:
    """(key, event_id, ms, touched): whether a use writes down its time, which it does over least_ms after the last one that did."""

    def start():
        last: list[int] = []

        def step(actor, piece, at, event):
            touched = not last or at - last[0] > least_ms
            if touched:
                last[:] = [at]
            return actor, event, at, touched

        return step

    rows = events.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(key, ms, event_id)
    kinds = dict(rows.dtypes)
    cut = _pieces(rows, key, ms, event_id, least_ms + 1).select(key, "_piece", ms, event_id)
    return folds.running(cut, [key, "_piece"], [ms, event_id], f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, {ms} {kinds[ms]}, touched boolean", start)


def quota(events: DataFrame, key: str, ms: str, event_id: str, per_hour: int, per_day: int, exempt: str, told: list[int] | None = None) -> DataFrame:
    """(event_id, refused): null where granted, else 'hour' or 'day'.

    A key has per_hour grants in the hour before; all keys together have per_day in a UTC day, from which exempt
    ones are free. What either limit refuses counts for neither. Every day is a task of its own: what one day hands to
    the next are the grants of its last hour, and these are assumed first (none) and corrected in rounds. In a
    round only days whose assumption turned out otherwise are worked out again, until none did; a day's grants
    rarely reach through the next one, so rounds are few however many days there are. Their sizes, in days, go to `told`.
    """
    spark = events.sparkSession
    kind, id_kind = (dict(events.dtypes)[c] for c in (key, event_id))

    def start(decide: bool):
        """A fold over a day: grants handed over (state 0) and asks (state 1), by time."""
        held: dict = {}
        order: deque = deque()
        used = [0]

        def step(day, state, at, event, actor, free):
            while order and order[0][0] <= at - HOUR_MS:
                gone = order.popleft()[1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            refused = None
            if state:
                refused = "hour" if held.get(actor, 0) >= per_hour else "day" if not free and used[0] >= per_day else None
                used[0] += refused is None and not free
            if refused is None:
                held[actor] = held.get(actor, 0) + 1
                order.append((at, actor))
            if decide:
                return event, refused, state
            handed = state and refused is None and at >= (day + 1) * DAY_MS - HOUR_MS
            return (day + 1 if handed else None), at, actor

        return step

    rows = events.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(
        F.floor(F.col(ms) / DAY_MS).alias("_day"), F.lit(1).alias("_state"), F.col(ms).alias("_ms"), F.col(event_id).alias("_event"), F.col(key).alias("_who"), F.coalesce(F.col(exempt), F.lit(False)).alias("_free")
    )
    rows = tables.written(rows, "asked")

    def with_handed(asked: DataFrame, handed: DataFrame) -> DataFrame:
        given = handed.select("_day", F.lit(0).alias("_state"), "_ms", F.lit(None).cast(id_kind).alias("_event"), "_who", F.lit(True).alias("_free"))
        return asked.union(given.join(asked.select("_day").distinct(), "_day", "left_semi").select(asked.columns))

    def hand_over(asked: DataFrame, handed: DataFrame) -> DataFrame:
        found = folds.running(with_handed(asked, handed), ["_day"], ["_ms", "_state", "_event"], f"_day long, _ms long, _who {kind}", lambda: start(False))
        return found.where("_day is not null")

    def digests(handed: DataFrame) -> DataFrame:
        return handed.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"), F.expr("bit_xor(xxhash64(_ms, _who))").alias("_x"), F.sum(F.col("_ms") % 1_000_003).alias("_s"))

    assumed = spark.createDataFrame([], f"_day long, _ms long, _who {kind}")
    handed = tables.written(hand_over(rows, assumed), "handed")
    rounds = [rows.select("_day").distinct().count()]
    while True:
        # days that were worked out from other grants than they were handed; a row a day
        now, then = digests(handed), digests(assumed).select("_day", *(F.col(c).alias(f"{c}_then") for c in ("_n", "_x", "_s")))
        same = F.col("_n").eqNullSafe(F.col("_n_then")) & F.col("_x").eqNullSafe(F.col("_x_then")) & F.col("_s").eqNullSafe(F.col("_s_then"))
        wrong = now.join(then, "_day", "full").where(~same).select("_day").join(rows.select("_day").distinct(), "_day", "left_semi")
        wrong = tables.written(wrong, "wrong")
        count = wrong.count()
        if not count:
            break
        rounds.append(count)
        again = hand_over(rows.join(wrong, "_day", "left_semi"), handed)
        kept = handed.join(wrong.select((F.col("_day") + 1).alias("_day")), "_day", "left_anti")
        new = tables.written(kept.unionByName(again), "handed")
        tables.drop(wrong, assumed)
        assumed, handed = handed, new
    if told is not None:
        told += rounds
    schema = f"{event_id} {id_kind}, refused string, _state int"
    decided = folds.running(with_handed(rows, handed), ["_day"], ["_ms", "_state", "_event"], schema, lambda: start(True))
    return decided.where("_state = 1").drop("_state")


def limited(log: DataFrame, attempts: DataFrame, bucket: str, ms: str, most: int = 10, width_ms: int = 900_000) -> DataFrame:
    """attempts (bucket, ms, ...) with `failures` of their bucket in the width before, and `limited` where these are most or more.

    A failure counts if it is younger than width_ms; one at the attempt's own time does.
    """
    return _younger(attempts, log, bucket, ms, width_ms, "failures").withColumn("limited", F.col("failures") >= most)


def use_session(at: int, held: list[int], lasts_ms: int, refresh_ms: int) -> tuple[bool, int, list[int]]:
    """(valid, expires, held) at a use; held is empty or (expires, refreshed).

    A session starts with a first use, and is extended when its last refresh is old enough. A use after its end is
    not valid and ends it; the next one starts another.
    """
    if held and at >= held[0]:
        return False, held[0], []
    if not held or at - held[1] >= refresh_ms:
        held = [at + lasts_ms, at]
    return True, held[0], held


def extend_session(times: list[int], lasts_ms: int, refresh_ms: int) -> list[tuple[bool, int]]:
    """(valid, expires) at each of the uses of one session in order."""
    out, held = [], []
    for at in times:
        valid, expires, held = use_session(at, held, lasts_ms, refresh_ms)
        out.append((valid, expires))
    return out


def sessions(events: DataFrame, key: str, ms: str, event_id: str, lasts_ms: int, refresh_ms: int) -> DataFrame:
    """(key, event_id, valid, expires) for each use of a key's session; what is held of a key are two times."""

    def start():
        held: list[int] = []

        def step(actor, at, event):
            valid, expires, held[:] = use_session(at, held, lasts_ms, refresh_ms)
            return actor, event, valid, expires

        return step

    kinds = dict(events.dtypes)
    rows = events.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(key, ms, event_id)
    return folds.running(rows, [key], [ms, event_id], f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, valid boolean, expires long", start)


def ingest_new(stream: DataFrame, path: str, key: str, checkpoint: str, n: int = 64):
    """Appends each key of a stream to a Parquet table once; rows without a key are appended as they come.

    The table is in n buckets by key, and in each a micro-batch has a partition of its own, `batch`, that is overwritten
    when the batch is repeated. Keys that other batches brought are left out; for that only the key column of the
    buckets that the batch's keys fall into is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = tables.written(batch.withColumn(buckets.BUCKET, buckets.bucket(key, n)), "ingest")
        schema = T.StructType([*held.schema.fields, T.StructField("batch", T.LongType())])
        new = held.where(F.col(key).isNotNull()).dropDuplicates([key])
        which = [r[0] for r in held.select(buckets.BUCKET).distinct().collect()]  # n at most
        if tables.exists(spark, path):
            old = spark.read.schema(schema).parquet(path).where(F.col(buckets.BUCKET).isin(which) & (F.col("batch") != batch_id)).select(key)
            new = new.join(old, key, "left_anti").select(held.columns)
        whole = new.unionByName(held.where(F.col(key).isNull())).withColumn("batch", F.lit(batch_id).cast("long"))
        whole = tables.written(whole, "ingest")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(buckets.BUCKET, "batch").parquet(path)
        tables.drop(held, whole)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts_stream(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, key, n) of tumbling windows; events later than the watermark allows are left out."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n")
