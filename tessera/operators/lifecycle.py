"""Tables that change: upserts, inserts, replacements, claims, states and what is stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds

#: Steps of a repeat, from the earliest.
STEPS = ["transcribe", "rewrite", "summary", "index"]


def _equal(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def redo_state(status: str, redo: str, stage: str, error: str) -> Column:
    """How a repeat of something done stands: 'running', 'waiting' or 'failed'; null if there is none."""
    repeats = (F.col(status) == "done") & F.col(redo).isNotNull()
    return F.when(repeats & F.col(stage).isNotNull(), "running").when(repeats & F.col(error).isNull(), "waiting").when(repeats, "failed")


def any_rows(*tables: DataFrame) -> DataFrame:
    """(found): one row that tells whether any of the tables has a row; no more than one of each is read."""
    probes = reduce(DataFrame.union, [t.select(F.lit(1).alias("one")).limit(1) for t in tables])
    return probes.agg((F.count(F.lit(1)) > 0).alias("found"))


def has_any(rows: DataFrame, key: str, *tables: DataFrame, flag: str = "found") -> DataFrame:
    """rows with a flag: whether any of the tables has a row of that key."""
    known = reduce(DataFrame.union, [t.select(F.col(key).alias("_key")) for t in tables]).distinct()
    return rows.join(known, F.col(key) == F.col("_key"), "left").withColumn(flag, F.col("_key").isNotNull()).drop("_key")


def unexpired(tokens: DataFrame, users: DataFrame, now: Column, user: str = "user_id", expires: str = "expires_at", used: str | None = None) -> DataFrame:
    """Sessions, invitations or links with their users, while they last and, given a column for it, are not used up."""
    good = F.col(expires) > now
    if used is not None:
        good = good & F.col(used).isNull()
    return tokens.where(good).join(users, user)


def available_models(models: DataFrame, providers: DataFrame, keys: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Models (provider, model, enabled) that are enabled and whose provider has a key; of the allowed ones if a person is limited.

    keys has (slot, last4), providers (provider, slot); no table of allowed ones (provider, model) is no limit, an
    empty one allows nothing.
    """
    usable = providers.join(keys, "slot", "left").where("last4 is not null").select("provider")
    out = models.where("enabled").join(usable, "provider", "left_semi")
    return out if allowed is None else out.join(allowed.select("provider", "model"), ["provider", "model"], "left_semi")


def targets(choice: Column, wanted: Column, fallbacks: Column, available: Column, limited: Column) -> Column:
    """Keys to try in order: the choice if available, else the default, else a limited person's first; then available fallbacks, once each."""
    has = lambda key: F.coalesce(F.array_contains(available, key), F.lit(False))
    first = F.when(has(choice), choice).when(has(wanted), wanted).when(limited, F.get(available, 0))
    return F.array_distinct(F.array_compact(F.concat(F.array(first), F.filter(F.coalesce(fallbacks, F.array().cast("array<string>")), has))))


def record_items(old: DataFrame, new: DataFrame, key: str, attributes: list[str], order: list, backfill: int | None = None) -> DataFrame:
    """The table (key, attributes, ..., status, change) after new items came: unknown ones are added, known ones get the attributes they have now.

    change is 'added', 'refreshed' or null. Added items are queued; in a first import only the newest `backfill` are,
    the others are 'not_imported'. Attributes are compared null-safely. New items without a key are left out.
    """
    unique = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    first = backfill is not None and old.isEmpty()
    added = unique.join(old.select(key), key, "left_anti")
    if first:
        head = added.orderBy(*order).limit(backfill).select(F.col(key).alias("_head"))
        added = added.join(head, F.col(key) == F.col("_head"), "left").withColumn("status", F.when(F.col("_head").isNotNull(), "queued").otherwise("not_imported")).drop("_head")
    else:
        added = added.withColumn("status", F.lit("queued"))
    fresh = unique.select(F.col(key).alias("_key"), F.struct(*attributes).alias("_now"))
    kept = old.join(fresh, F.col(key) == F.col("_key"), "left")
    differs = F.col("_key").isNotNull() & ~F.struct(*attributes).eqNullSafe(F.col("_now"))
    kept = kept.withColumn("change", F.when(differs, "refreshed")).withColumns({a: F.when(differs, F.col(f"_now.{a}")).otherwise(F.col(a)) for a in attributes}).drop("_key", "_now")
    return kept.unionByName(added.withColumn("change", F.lit("added")), allowMissingColumns=True)


def next_batch(items: DataFrame, group: list[str], order: str, size: str, done: str, cap: int) -> DataFrame:
    """(group, first, last, n): of items numbered from 0 the next ones to do, after the first `done`, while their sizes stay within cap; one at least."""
    waiting = items.where(F.col(order) >= F.col(done))
    w = Window.partitionBy(*group).orderBy(order)
    through = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    batch = waiting.withColumn("_sum", through).withColumn("_at", F.row_number().over(w)).where((F.col("_sum") <= cap) | (F.col("_at") == 1))
    return batch.groupBy(*group).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row per key: of new rows the latest by `newest`, else the old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc_nulls_last(newest))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_new", "_rank")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old does not have, one for each key."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new that differ from old's row of that key in any column; null equals null only."""
    a, b = old.alias("a"), new.alias("b")
    differs = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return b.join(a, F.col(f"a.{key}") == F.col(f"b.{key}")).where(differs).select("b.*")


def replace_partition(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """The table after every owner in new has new's rows and no others."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def stale_keys(old: DataFrame, new: DataFrame, owner: str, key: str) -> DataFrame:
    """Keys of new's owners in old that new no longer has."""
    touched = old.join(new.select(owner).distinct(), owner, "left_semi")
    return touched.join(new.select(key), key, "left_anti").select(key)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df so that the partitions it has replace those at the path, and others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def claim(rows: DataFrame, order: list, at_once: int, status: str = "status", queued: str = "queued", running: str = "running", key: str = "id", busy: Column | None = None) -> DataFrame:
    """rows with the first queued ones running, so many that at_once run in all; a running one cannot be claimed again.

    What runs already takes its places: rows with that status, and those that busy is true of.
    """
    taken = F.col(status) == running if busy is None else (F.col(status) == running) | F.coalesce(busy, F.lit(False))
    slots = max(0, at_once - rows.agg(F.count_if(taken)).first()[0])
    free = rows.where(F.col(status) == queued).orderBy(*order).limit(slots).select(F.col(key).alias("_key"))
    out = rows.join(free, F.col(key) == F.col("_key"), "left")
    return out.withColumn(status, F.when(F.col("_key").isNotNull(), running).otherwise(F.col(status))).drop("_key")


def finish(rows: DataFrame, ended: DataFrame, order: list, at_once: int, status: str = "status", running: str = "running", key: str = "id") -> DataFrame:
    """rows after runs ended (key, outcome): these have their outcome, and the next queued ones take their places."""
    known = ended.select(F.col(key).alias("_ended"), F.col("outcome").alias("_outcome")).dropDuplicates(["_ended"])
    out = rows.join(known, (F.col(key) == F.col("_ended")) & (F.col(status) == running), "left")
    out = out.withColumn(status, F.coalesce("_outcome", status)).drop("_ended", "_outcome")
    return claim(out, order, at_once, status=status, running=running, key=key)


def after_failure(status: str) -> Column:
    """What was done once stays done when a repeat fails."""
    return F.when(F.col(status) == "done", "done").otherwise("failed")


def earliest_step(current: str, wanted: Column) -> Column:
    """The earlier of a pending step and a wanted one."""
    steps = F.array(*[F.lit(s) for s in STEPS])
    rank = F.least(F.nullif(F.array_position(steps, F.col(current)), F.lit(0)), F.nullif(F.array_position(steps, wanted), F.lit(0)))
    return F.get(steps, (rank - 1).cast("int"))


def next_step(current: str) -> Column:
    """The step after one that is finished; null after the last."""
    steps = F.array(*[F.lit(s) for s in STEPS])
    return F.get(steps, F.array_position(steps, F.col(current)).cast("int"))


def stale(status: str, updated: Column, now: Column, running: str = "running", hours: float = 6.0) -> Column:
    return (F.col(status) == running) & (F.unix_micros(now) - F.unix_micros(updated) > F.lit(int(hours * 3_600_000_000)))


#: After how many hours without a report a run, a document being written, a re-processing and a book import count as stopped.
STALE_HOURS = {"run": 6.0, "writing": 2.0, "redo": 1 / 3, "import": 0.25}


def stopped(kind: str, status: str, updated: Column, now: Column, running: dict[str, str]) -> Column:
    """Whether a row of some kind, running in its own word for it, has been silent for longer than its kind may be."""
    late = [(F.col(kind) == k) & stale(status, updated, now, running=running[k], hours=h) for k, h in STALE_HOURS.items() if k in running]
    return F.coalesce(reduce(lambda a, b: a | b, late), F.lit(False))


def fail_stale(rows: DataFrame, now: Column, status: str = "status", updated: str = "updated_at", error: str = "error", hours: float = 6.0) -> DataFrame:
    """rows with those running too long failed; a message joins the error that is there, or stands alone."""
    old = stale(status, F.col(updated), now, hours=hours)
    message = F.coalesce(F.concat(F.lit("stopped: "), F.col(error)), F.lit("stopped"))
    return rows.withColumn(error, F.when(old, message).otherwise(F.col(error))).withColumn(status, F.when(old, after_failure(status)).otherwise(F.col(status)))


def requeue(rows: DataFrame, ids: DataFrame | None, from_statuses: list[str], status: str = "status", key: str = "id") -> DataFrame:
    """rows with those of the given states queued, of the given ids or of all."""
    chosen = F.col(status).isin(*from_statuses)
    if ids is None:
        return rows.withColumn(status, F.when(chosen, "queued").otherwise(F.col(status)))
    marked = rows.join(ids.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left")
    return marked.withColumn(status, F.when(chosen & F.col("_key").isNotNull(), "queued").otherwise(F.col(status))).drop("_key")


def cascade(children: DataFrame, removed: DataFrame, parent: str, key: str) -> DataFrame:
    """children without those of removed parents."""
    return children.join(removed.select(F.col(key).alias(parent)), parent, "left_anti")


def detach(children: DataFrame, removed: DataFrame, parent: str, key: str) -> DataFrame:
    """children with no parent where it was removed."""
    gone = removed.select(F.col(key).alias("_gone")).distinct()
    out = children.join(gone, F.col(parent) == F.col("_gone"), "left")
    return out.withColumn(parent, F.when(F.col("_gone").isNull(), F.col(parent))).drop("_gone")


def override(current: str, source: str, value: Column, by: str) -> tuple[Column, Column]:
    """(value, source) after a change: an administrator's stands; a model's fills only what nobody decided."""
    takes = F.lit(True) if by == "admin" else F.col(source).isNull()
    return F.when(takes, value).otherwise(F.col(current)), F.when(takes, F.lit(by)).otherwise(F.col(source))


def merged_settings(defaults: dict, saved: dict) -> dict:
    """Saved settings over defaults, one nested level deep."""
    return {k: ({**v, **saved.get(k, {})} if isinstance(v, dict) and isinstance(saved.get(k, {}), dict) else saved.get(k, v)) for k, v in defaults.items()}


def resolve(candidates: DataFrame, group: list[str], priority: str, allowed: str, most: int) -> DataFrame:
    """The first allowed candidates of each group by priority, numbered: the choice and its fallbacks."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(priority))
    return candidates.where(allowed).withColumn("rank", rank).where(F.col("rank") <= most)


def unique_slugs(rows: DataFrame, slug: str, order: list[str], reserved: tuple[str, ...] = (), most: int = 26) -> DataFrame:
    """rows with each slug that is taken, or reserved, cut and counted from 2 until it is free; slugs are given in order.

    Only slugs with one stem can get in each other's way, so each stem is a fold of its own. What it holds are the
    last number given to each slug and the slugs that came with a number of their own.
    """
    schema = rows.schema
    at = rows.columns.index(slug) + 1

    def start():
        taken: set[str] = set(reserved)
        last: dict[str, int] = {}

        def step(stem, *values):
            wanted = values[at - 1]
            if wanted not in taken and not given(wanted):
                taken.add(wanted)
                return values
            base = wanted[:most]
            n = last.get(base, 1) + 1
            while f"{base}-{n}" in taken:
                n += 1
            last[base] = n
            return *values[: at - 1], f"{base}-{n}", *values[at:]

        def given(name: str) -> bool:
            base, _, n = name.rpartition("-")
            return n.isdigit() and not n.startswith("0") and 2 <= int(n) <= last.get(base, 1)

        return step

    stem = F.regexp_replace(F.substring(slug, 1, most), "(-[0-9]*)+$", "")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return folds.running(rows.select(stem.alias("_stem"), *rows.columns), ["_stem"], order, kinds, start)
