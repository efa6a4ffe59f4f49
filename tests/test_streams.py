"""Streams that bring events out of order against the batch folds and plain loops."""

import random

from pyspark.sql import functions as F

from tessera.plans import usage as plans
from tessera.streaming import exact, usage

DAY, HOUR = usage.DAY_MS, usage.HOUR_MS


def streamed(spark, tmp_path, events, fold, key="user_id", files=10, late="49 hours", what=None):
    """events (…, file) written file by file and read a file a micro-batch; a last event moves the watermark past all."""
    names = [c for c in events.columns if c != "file"]
    for k in range(files):
        events.where(F.col("file") == k).select(names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = events.agg(F.max("ms")).first()[0] + 99 * DAY
    spark.createDataFrame([(last, -1)], "ms long, event_id long").select(*(c if c in ("ms", "event_id") else F.lit(-1 if c == key else None).cast(t).alias(c) for c, t in events.select(names).dtypes)).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.select(names).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = exact.run_available(exact.folded(stream, fold, key, "ms", "event_id", late, what), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert len(query.recentProgress) > files
    state = query.recentProgress[-1]["stateOperators"][0]
    return spark.read.parquet(f"{tmp_path}/out").where("event_id >= 0"), state


def rows(n=600, users=7, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ms = DAY + rng.randrange(29 * 24) * HOUR + rng.choice([0, 0, rng.randrange(HOUR)])  # ties, too
        out.append((rng.randrange(users) if k % 50 else None, ms, k, rng.choice(["error", "view"]), min(9, (ms + rng.randrange(2 * DAY)) // (3 * DAY))))
    return out


KIND = "user_id long, ms long, event_id long, event_type string, file long"


def test_admissions(spark, tmp_path):
    events = spark.createDataFrame(rows(), KIND)
    got, state = streamed(spark, tmp_path, events.drop("event_type"), exact.Admissions(2, DAY))
    want = usage.admissions(events, "user_id", "ms", "event_id", 2, DAY)
    assert sorted(map(tuple, got.select("user_id", "event_id", "ms", "granted").collect())) == sorted(map(tuple, want.collect()))
    assert state["numRowsTotal"] <= 4  # what is left is the last event's


def test_sessions(spark, tmp_path):
    events = spark.createDataFrame(rows(), KIND)
    got, _ = streamed(spark, tmp_path, events.drop("event_type"), exact.Sessions(30 * HOUR, 4 * HOUR))
    want = usage.sessions(events, "user_id", "ms", "event_id", 30 * HOUR, 4 * HOUR)
    assert sorted(map(tuple, got.drop("ms").collect())) == sorted(map(tuple, want.collect()))


def test_failures(spark, tmp_path):
    events = spark.createDataFrame(rows(900), KIND).where("user_id is not null")
    got, state = streamed(spark, tmp_path, events, exact.Failures("error", 3, 12 * HOUR), what="event_type")
    tries = events.where("event_type = 'view'").select("user_id", "ms", "event_id")
    want = usage.limited(events.where("event_type = 'error'").select("user_id", "ms"), tries, "user_id", "ms", 3, 12 * HOUR)
    assert sorted(map(tuple, got.select("event_id", "failures", "limited").collect())) == sorted(map(tuple, want.select("event_id", "failures", "limited").collect()))
    assert state["numRowsTotal"] <= 4


def test_state_is_of_buckets(spark, tmp_path):
    """Thousands of keys wait in a few rows of state, in few partitions, and come out as the batch form has them; one more day and those that fell silent are gone."""
    rng = random.Random(12)
    data = [(f"u{rng.randrange(3000)}", DAY + rng.randrange(4 * DAY), k) for k in range(6000)]
    events = spark.createDataFrame(data, "user_id string, ms long, event_id long")

    def run(rows):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        query = exact.run_available(exact.folded(stream, exact.Admissions(2, DAY), "user_id", "ms", "event_id", "49 hours", buckets=6), f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination()
        return query.recentProgress[-1]["stateOperators"][0]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        state = run(events)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "30"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    passed = max(r[1] for r in data) - 49 * HOUR
    assert state["numRowsTotal"] <= 2 * 6 and state["numShufflePartitions"] <= spark.sparkContext.defaultParallelism
    want = usage.admissions(events, "user_id", "ms", "event_id", 2, DAY)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.select("user_id", "event_id", "ms", "granted").collect())) == sorted(tuple(r) for r in want.collect() if r["ms"] <= passed)
    state = run(spark.createDataFrame([("u0", 99 * DAY, 9000), ("u1", 199 * DAY, 9001)], events.schema))
    got = spark.read.parquet(f"{tmp_path}/out").where("event_id < 9000")
    assert sorted(map(tuple, got.select("user_id", "event_id", "ms", "granted").collect())) == sorted(map(tuple, want.collect()))
    assert state["numRowsTotal"] <= 2


def test_a_failure_costs_no_more_the_more_are_held():
    class Counted(list):
        read = 0

        def __iter__(self):
            Counted.read += len(self)
            return super().__iter__()

    fold, held, out = exact.Failures("error", 3, 1000), Counted(), []
    for k in range(4000):
        held, result = fold.step(held, k, "error" if k % 2 else "view")
        out.append(result)
    assert [r for r in out if r] == [(min(k // 2, 500), k >= 6) for k in range(0, 4000, 2)]
    assert Counted.read == 0 and len(held) <= 1001


def test_a_batch_of_many_files(spark):
    """What the tasks of one batch wrote is read together: no file moves the watermark past the others."""
    events = spark.createDataFrame(rows(900), KIND).where("user_id is not null").repartition(12, "event_id")
    got = plans._streamed(spark, events.select("user_id", "ms", "event_id"), exact.Admissions(2, DAY), "user_id")
    want = usage.admissions(events, "user_id", "ms", "event_id", 2, DAY)
    assert sorted(map(tuple, got.select("user_id", "event_id", "ms", "granted").collect())) == sorted(map(tuple, want.collect()))


def plain_quota(asked, per_hour, per_day):
    granted, used, out = [], {}, {}
    for event, ms, who, free in sorted(asked, key=lambda r: (r[1], r[0])):
        day = ms // DAY
        if sum(1 for t, w in granted if w == who and t > ms - HOUR) >= per_hour:
            out[event] = "hour"
        elif not free and used.get(day, 0) >= per_day:
            out[event] = "day"
        else:
            out[event] = None
            granted.append((ms, who))
            used[day] = used.get(day, 0) + (not free)
    return out


def test_quota_in_rounds(spark):
    rng = random.Random(2)
    asked = [(k, rng.randrange(12 * DAY), rng.randrange(4), False) for k in range(500)]
    asked += [(1000 + 10 * d + k, d * DAY + DAY - HOUR // 2 + k * 60_000, 9, True) for d in range(11) for k in range(6)]  # every midnight is crossed
    asked += [(2000 + 10 * d + k, d * DAY + k * 600_000, 9, True) for d in range(1, 12) for k in range(6)]
    told = []
    out = usage.quota(spark.createDataFrame(asked, "id long, ms long, who long, free boolean"), "who", "ms", "id", 3, 20, "free", told)
    assert {r["id"]: r["refused"] for r in out.collect()} == plain_quota(asked, 3, 20)
    assert told[0] == 12 and 1 < len(told) <= 12 and all(a >= b for a, b in zip(told[1:], told[2:]))
    none = usage.quota(spark.createDataFrame([], "id long, ms long, who long, free boolean"), "who", "ms", "id", 3, 20, "free")
    assert none.count() == 0


def test_site_quota_has_a_task_a_day(spark, sf_dir):
    told = []
    asked = plans._events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "ms", (F.col("user_id") % 5).alias("who")).withColumn("free", F.col("who") == 0)
    assert usage.quota(asked, "who", "ms", "event_id", 2, 40, "free", told).count() == asked.count()
    assert told[0] == asked.select(F.floor(F.col("ms") / DAY)).distinct().count() >= 28


def test_window_counts_of_a_hot_key(spark):
    rng = random.Random(7)
    data = [(0 if rng.random() < 0.8 else rng.randrange(4), rng.randrange(40) * 250 + rng.randrange(3), k) for k in range(800)] + [(0, None, 900), (None, 5, 901), (None, 6, 902)]
    got = {r["id"]: r["used"] for r in usage.window_counts(spark.createDataFrame(data, "k int, ms long, id int"), "k", "ms", 1000).collect()}
    for key, ms, k in data:
        assert got[k] == (1 if ms is None else sum(1 for o, t, _ in data if o == key and t is not None and ms - 1000 < t <= ms))


def test_failures_of_a_hot_bucket(spark):
    """No window slides over what its width holds, and a bucket is dealt over its time."""
    rng = random.Random(9)
    log = [(rng.choice([0, 0, 0, 1, None]), rng.choice([None, -rng.randrange(900), rng.randrange(20) * 250 + rng.randrange(3)])) for _ in range(500)]
    tries = [(*rng.choice([(0, 250), (1, 2001), (None, None), *log]), k) for k in range(500)]
    out = usage.limited(spark.createDataFrame(log, "b int, ms long"), spark.createDataFrame(tries, "b int, ms long, id int"), "b", "ms", 4, 1000)
    got = {r["id"]: (r["failures"], r["limited"]) for r in out.collect()}
    for b, ms, k in tries:
        n = sum(1 for o, t in log if o == b and (t is None if ms is None else t is not None and ms - 1000 < t <= ms))
        assert got[k] == (n, n >= 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in plan and "RangeFrame, -" not in plan and "_stretch" in plan


def test_pieces_of_a_hot_key(spark):
    rng = random.Random(8)
    data = [(rng.choice([0, 0, 0, 1]), rng.randrange(3000) ** 2 // 100, k) for k in range(700)]
    got = {r["id"]: r["_piece"] for r in usage._pieces(spark.createDataFrame(data, "k int, ms long, id int"), "k", "ms", "id", 300).collect()}
    for key in (0, 1):
        own = sorted((ms, k) for o, ms, k in data if o == key)
        for (a, j), (b, k) in zip(own, own[1:]):
            assert got[k] - got[j] == (b - a >= 300)
